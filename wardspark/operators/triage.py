"""Triage of findings with reply tables: batches, verdicts, audits, chains.

Replies of a scoring service are input rows; the joins below are on keys that
identify a batch or a finding, so no key is hotter than a batch of twelve.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grading import is_severe
from ..functions.replies import audit_demo, audit_fields, audit_fix, chain_fields, verdict_batch
from ..functions.text import CHAIN_BLOCK_MIN_CHARS, chain_block, head_and_tail, triage_block
from ..rules.fixed import BATCH_SIZE, CHAIN_CHAR_LIMIT, FILE_CHAR_LIMIT
from ..session import cut_lineage
from .numbering import running_sums

BATCH = ["target", "path", "batch_no"]


def assign_batches(numbered: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Consecutive batches inside each file: ``batch_no`` and ``batch_pos`` from ``file_pos``."""
    pos = F.col("file_pos")
    return numbered.withColumns({
        "batch_no": F.floor(pos / size).cast("int"),
        "batch_pos": (pos % size).cast("int"),
    })


def batch_texts(batched: DataFrame) -> DataFrame:
    """One prompt body per batch, at most twelve findings each, in finding order."""
    block = triage_block(F.col("finding_index"), F.col("rule_id"), F.col("severity"), F.col("path"),
                         F.col("line_number"), F.col("title"), F.col("description"), F.col("code_snippet"))
    return (
        batched.select(*BATCH, F.struct("batch_pos", block.alias("text")).alias("_b"))
        .groupBy(*BATCH)
        .agg(F.sort_array(F.collect_list("_b")).alias("_b"))
        .select(*BATCH, F.size("_b").alias("n_findings"), F.array_join(F.transform("_b", lambda b: b["text"]), "\n").alias("batch_text"))
    )


def score_batches(texts: DataFrame, scorer: Callable[[list[str]], list[str]]) -> DataFrame:
    """Replies of a user-supplied scorer, called with the prompt texts of an Arrow batch.

    The scorer maps texts to replies, one each.  If a call fails or returns another number of replies,
    every text is tried by itself, so that an error is that of its own prompt alone, whatever the size of
    Arrow batches.  An error keeps the findings of its prompt.
    """

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            replies = list(scorer([text]))
        except Exception as err:  # noqa: BLE001 - any failure keeps the batch
            return None, str(err) or type(err).__name__
        return (replies[0], None) if len(replies) == 1 else (None, f"{len(replies)} replies to one text")

    def run(frames: Iterator):
        for pdf in frames:
            texts = list(pdf["batch_text"])
            try:
                replies = list(scorer(texts))
            except Exception:  # noqa: BLE001 - tried again one by one
                replies = []
            pairs = [(r, None) for r in replies] if len(replies) == len(texts) else [one(t) for t in texts]
            yield pdf[BATCH].assign(reply=[r for r, _ in pairs], error=[e for _, e in pairs])

    return texts.mapInPandas(run, "target string, path string, batch_no int, reply string, error string")


def one_reply(replies: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: of repeated replies the smallest, one without an error before others."""
    best = F.min(F.struct(F.col("error").isNotNull().alias("bad"), "error", "reply")).alias("_r")
    return replies.groupBy(*keys).agg(best).select(*keys, "_r.reply", "_r.error")


def join_verdicts(batched: DataFrame, replies: DataFrame) -> DataFrame:
    """Add ``verdict``, ``reason`` and ``kept`` to the findings.

    REAL keeps a finding; another verdict or none drops it; a failed or missing
    reply keeps its whole batch.  A verdict past the end of its batch that says
    REAL keeps the finding whose index it names.

    Everything is decided on narrow keys; the findings with their texts are joined once.  What the replies say is written
    before verdicts that name other findings are looked up in it, so that a reply is read one time.
    """
    read = one_reply(replies, BATCH).select(*BATCH, "error", verdict_batch(F.col("reply")).alias("_v"))
    read = read.select(
        *BATCH,
        (F.col("error").isNotNull() | F.coalesce(F.col("_v.failed"), F.lit(True))).alias("_failed"),
        F.col("_v.items").alias("_items"),
    )
    failed = F.coalesce("_failed", F.lit(True))
    item = F.try_element_at("_items", F.col("batch_pos") + 1)
    narrow = batched.select("target", "finding_index", *BATCH[1:], "batch_pos").join(read, BATCH, "left")
    # the last finding of a batch carries what is said beyond it
    last = F.col("batch_pos") == F.max("batch_pos").over(Window.partitionBy(*BATCH))
    decided = cut_lineage(narrow.select(
        "target", "finding_index", failed.alias("_failed"),
        F.when(~failed, item["verdict"]).alias("verdict"), F.when(~failed, item["reason"]).alias("reason"),
        F.when(~failed & last & (F.size("_items") > F.col("batch_pos") + 1),
               F.slice("_items", F.col("batch_pos") + 2, F.size("_items"))).alias("_beyond"),
    ))
    named = (
        decided.where(F.col("_beyond").isNotNull())
        .select("target", F.explode("_beyond").alias("_i"))
        .where("_i.verdict = 'REAL'")
        .select("target", F.col("_i.index").alias("finding_index"), F.lit(True).alias("_named"))
        .distinct()
    )
    kept_ = F.col("_failed") | (F.coalesce("verdict", F.lit("")) == "REAL") | F.coalesce("_named", F.lit(False))
    decided = decided.join(named, ["target", "finding_index"], "left").select(
        "target", "finding_index", "verdict", "reason", kept_.alias("kept"))
    return batched.join(decided, ["target", "finding_index"])


def kept(judged: DataFrame) -> DataFrame:
    return judged.where("kept")


def dropped(judged: DataFrame) -> DataFrame:
    return judged.where(~F.col("kept"))


def file_payloads(findings: DataFrame, files: DataFrame, limit: int | None = FILE_CHAR_LIMIT) -> DataFrame:
    """The content of its file next to every severe finding: ``file_text``, ``n_chars`` of the whole, ``was_cut``.

    Texts over ``limit`` characters keep head and tail; ``None`` cuts nothing.  The
    cut happens before the join, so with a limit at most one limited text per file is
    shuffled; a file with very many findings is split by the adaptive skew join.
    """
    content = F.col("content")
    shown = content if limit is None else head_and_tail(content, limit)
    was_cut = F.lit(False) if limit is None else F.length(content) > limit
    texts = files.select("target", "path", shown.alias("file_text"), F.length(content).alias("n_chars"), was_cut.alias("was_cut"))
    return findings.where(is_severe(F.col("severity"))).join(texts, ["target", "path"], "left").withColumn(
        "file_text", F.coalesce("file_text", F.concat(F.lit("[File not found: "), F.col("path"), F.lit("]")))
    )


def join_audits(findings: DataFrame, audits: DataFrame) -> DataFrame:
    """Enrich severe findings with audit replies ``(target, finding_index, reply, error)``.

    Adds ``audit_status``: skipped (not severe), failed (error or no reply), audited.
    """
    read = one_reply(audits, ["target", "finding_index"])
    read = read.select("target", "finding_index", "error", audit_fields(F.col("reply")).alias("_audit"),
                         F.lit(True).alias("_has"))
    joined = findings.join(read, ["target", "finding_index"], "left")
    status = (
        F.when(~is_severe(F.col("severity")), "skipped")
        .when(F.col("_has").isNull() | F.col("error").isNotNull(), "failed")
        .otherwise("audited")
    )
    audit, audited = F.col("_audit"), F.col("audit_status") == "audited"
    return (
        joined.withColumn("audit_status", status)
        .withColumns({
            "attack_demo": F.when(audited, audit_demo(audit, F.col("attack_demo"))).otherwise(F.col("attack_demo")),
            "fix_suggestion": F.when(audited, audit_fix(audit, F.col("fix_suggestion"))).otherwise(F.col("fix_suggestion")),
        })
        .drop("error", "_audit", "_has")
    )


def _chain_texts(chainable: DataFrame) -> DataFrame:
    block = chain_block(F.col("rule_id"), F.col("severity"), F.col("path"), F.col("line_number"), F.col("title"),
                        F.col("description"), F.col("attack_demo"))
    return chainable.select("target", "finding_index", "rule_id", block.alias("chain_text"))


def chain_budget(chainable: DataFrame, limit: int = CHAIN_CHAR_LIMIT) -> DataFrame:
    """Findings whose text fits the budget of their target, with the text and the number left out.

    Every block has a fixed minimum length, so only the first ``limit //
    minimum`` findings of a target can fit.  That bound goes into a per-task
    top-k before the shuffle; the running sum then sees a few hundred rows per
    target however many findings it has.  ``chain_parts`` has the others too.
    """
    texts = _chain_texts(chainable)
    most = limit // CHAIN_BLOCK_MIN_CHARS
    order = Window.partitionBy("target").orderBy("finding_index")
    first = texts.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)
    running = F.sum(F.length("chain_text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    fitting = first.withColumn("used_chars", running).where(F.col("used_chars") <= limit).drop("_rank")
    totals = chainable.groupBy("target").agg(F.count("*").alias("_all"))
    per_target = fitting.groupBy("target").agg(F.count("*").alias("_in"))
    left_out = totals.join(per_target, "target", "left").select(
        "target", (F.col("_all") - F.coalesce("_in", F.lit(0))).alias("n_omitted")
    )
    return fitting.join(left_out, "target")


def chain_parts(chainable: DataFrame, limit: int = CHAIN_CHAR_LIMIT) -> DataFrame:
    """Every finding with its text and ``part_no``: part 0 is what fits the budget of the target, the others follow in order
    (from 1 on also where not even the first finding fits).

    No part has more than ``limit`` characters, unless a single finding has.  Behind part 0 the text is cut at equal
    distances: a finding belongs to the stretch it begins in, and stretches are shorter than the limit by the longest
    text of the target, so what stands out at the end still fits.  Texts over half the limit are parts of their own.
    ``used_chars`` is the running sum over the target, from sums over blocks of the sorted findings: a target
    with very many findings is never one task.  ``n_omitted`` counts findings behind part 0.
    """
    sized = _chain_texts(chainable).withColumn("_chars", F.length("chain_text").cast("long"))
    summed = running_sums(sized, ["target", "finding_index"], "target", "_chars", "used_chars")
    in_first, giant = F.col("used_chars") <= limit, F.col("_chars") > limit // 2
    per_target = summed.groupBy("target").agg(
        F.coalesce(F.max(F.when(in_first, F.col("used_chars"))), F.lit(0)).alias("_base"),
        F.coalesce(F.max(F.when(~in_first & ~giant, F.col("_chars"))), F.lit(0)).alias("_longest"),
        F.count_if(~in_first).alias("n_omitted"))
    begins = F.col("used_chars") - F.col("_chars") - F.col("_base")
    stretch = F.floor(begins / (limit - F.col("_longest"))).cast("long")
    # a text of its own comes behind the shorter ones that begin in its stretch
    place = F.when(in_first, F.struct(F.lit(-1).cast("long").alias("stretch"), F.lit(-1).cast("long").alias("own"))).otherwise(
        F.struct(stretch.alias("stretch"), F.when(giant, F.col("finding_index").cast("long")).otherwise(F.lit(-1).cast("long")).alias("own")))
    placed = summed.join(per_target, "target").withColumn("_place", place)
    # numbers without gaps, one row a part
    numbers = placed.groupBy("target", "_place").agg(F.count("*").alias("_n")).withColumn("_first", F.col("_place.stretch") < 0)
    rank = F.row_number().over(Window.partitionBy("target").orderBy("_place"))
    has_first = F.max("_first").over(Window.partitionBy("target"))
    numbers = numbers.select("target", "_place", (rank - F.when(has_first, 1).otherwise(0)).alias("part_no"))
    return placed.join(numbers, ["target", "_place"]).select("target", "finding_index", "rule_id", "chain_text", "used_chars", "n_omitted", "part_no")


def chain_prompts(budgeted: DataFrame) -> DataFrame:
    """One prompt body per target and part, each bounded by the budget; only the first says how many findings are not in it.

    Takes the findings of ``chain_budget`` (one prompt a target) or of ``chain_parts`` (all parts).
    """
    keys = ["target", "part_no"] if "part_no" in budgeted.columns else ["target"]
    first = F.col("part_no") == 0 if "part_no" in keys else F.lit(True)
    return (
        budgeted.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("finding_index", "chain_text"))).alias("_t"), F.max("n_omitted").alias("n_omitted"))
        .select(
            *keys, F.size("_t").alias("n_included"), "n_omitted",
            F.concat(
                F.array_join(F.transform("_t", lambda t: t["chain_text"]), "\n"),
                F.when(first & (F.col("n_omitted") > 0), F.concat(
                    F.lit("\n\n[... "), F.col("n_omitted").cast("string"),
                    F.lit(" more findings omitted to stay within context window]"))).otherwise(F.lit("")),
            ).alias("prompt_text"),
        )
    )


def read_chains(replies: DataFrame) -> DataFrame:
    """Chains out of ``(target, reply)`` with defaults filled in; null where a reply held nothing.

    Through a one-element generator: a test of a plain column would be put below whatever gave the replies (a
    ``distinct`` for example), and every row in front of that would be read as a reply.
    """
    return replies.select(*[c for c in replies.columns if c != "chain"], F.explode_outer(F.array(chain_fields(F.col("reply")))).alias("chain"))
