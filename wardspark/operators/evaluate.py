"""Quality gates: findings against labelled truth, stability over runs, layer effect, rule and field checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grading import is_severe
from ..rules.fixed import (
    GATE_COUNT_SPREAD, GATE_CRITICAL_RECALL, GATE_F1, GATE_JACCARD, GATE_NOISE_CUT, GATE_PRECISION, GATE_RECALL,
    GATE_VERDICT_AGREEMENT, SEVERITY_RANK,
)
from .report import FINDING_FIELDS


KEY = ["target", "path", "rule_id"]


def match_truth(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """Full outer join on (target, path, rule); both sides are reduced to one row per key first."""
    found = findings.groupBy(*KEY).agg(F.count("*").alias("n_findings"))
    labels = truth.groupBy(*KEY).agg(
        F.max("is_vulnerable").alias("is_vulnerable"), F.max(F.col("severity") == "critical").alias("is_critical")
    )
    both = labels.join(found, KEY, "full_outer")
    outcome = (
        F.when(F.col("is_vulnerable").isNull(), "unlabelled")
        .when(F.col("is_vulnerable") & F.col("n_findings").isNotNull(), "TP")
        .when(F.col("is_vulnerable"), "FN")
        .when(F.col("n_findings").isNotNull(), "FP")
        .otherwise("TN")
    )
    return both.withColumn("outcome", outcome)


def detection_metrics(matched: DataFrame) -> DataFrame:
    """TP, FP, FN, TN, precision, recall, F1, critical recall and whether each gate holds.  Unlabelled pairs do not count."""
    o = F.col("outcome")
    counts = matched.agg(
        *[F.count_if(o == k).alias(k.lower()) for k in ("TP", "FP", "FN", "TN")],
        F.count_if((o == "TP") & F.col("is_critical")).alias("critical_tp"),
        F.count_if((o == "FN") & F.col("is_critical")).alias("critical_fn"),
    )
    tp = F.col("tp")
    rates = counts.withColumns({
        "precision": F.try_divide(tp, tp + F.col("fp")),
        "recall": F.try_divide(tp, tp + F.col("fn")),
        "f1": F.try_divide(2 * tp, 2 * tp + F.col("fp") + F.col("fn")),
        "critical_recall": F.try_divide(F.col("critical_tp"), F.col("critical_tp") + F.col("critical_fn")),
    })
    passed = (
        (F.col("recall") >= GATE_RECALL) & (F.col("precision") >= GATE_PRECISION) & (F.col("f1") >= GATE_F1)
        & (F.coalesce("critical_recall", F.lit(1.0)) >= GATE_CRITICAL_RECALL)
    )
    return rates.withColumn("passed", F.coalesce(passed, F.lit(False)))


def missing_detections(findings: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.where("is_vulnerable").join(findings.select(*KEY).distinct(), KEY, "left_anti")


def run_counts(runs: DataFrame) -> DataFrame:
    """Spread of the number of findings over runs: (max - min) / mean, against the gate."""
    per_run = runs.groupBy("run_id").agg(F.count("*").alias("n"))
    return per_run.agg(
        F.count("*").alias("n_runs"), F.min("n").alias("min_findings"), F.max("n").alias("max_findings"),
        F.try_divide(F.max("n") - F.min("n"), F.avg("n")).alias("count_spread"),
    ).withColumn("passed", F.col("count_spread") <= GATE_COUNT_SPREAD)


def run_jaccard(runs: DataFrame, run_ids: list[int], key: list[str]) -> DataFrame:
    """Jaccard similarity of the severe findings of every two runs.

    Most findings are in the same runs, so findings are counted by their sorted list of runs first.  Pairs are
    emitted from each different list once, with its count, and what two runs have in either follows from their sizes.
    The plan is the same for any number of runs.
    """
    known = F.array(*[F.lit(r) for r in run_ids])
    seen = runs.where(is_severe(F.col("severity")) & F.array_contains(known, F.col("run_id"))).groupBy(*key).agg(F.sort_array(F.collect_set("run_id")).alias("_in"))
    lists = seen.groupBy("_in").agg(F.count("*").alias("_n"))
    sizes = lists.select(F.explode("_in").alias("run"), "_n").groupBy("run").agg(F.sum("_n").alias("size"))
    # an element with all behind it, then its partners
    ahead = lists.select("_n", "_in", F.posexplode("_in").alias("_at", "run_a"))
    both = ahead.select("_n", "run_a", F.explode(F.slice("_in", F.col("_at") + 2, F.size("_in"))).alias("run_b"))
    both = both.groupBy("run_a", "run_b").agg(F.sum("_n").alias("n_both"))
    every = runs.sparkSession.range(1).select(F.explode(F.sort_array(known)).alias("run_a"))
    every = every.select("run_a", F.explode(F.filter(F.sort_array(known), lambda r: r > F.col("run_a"))).alias("run_b"))
    rows = every.join(both, ["run_a", "run_b"], "left")
    for name in ("run_a", "run_b"):
        rows = rows.join(sizes.withColumnsRenamed({"run": name, "size": f"_{name}"}), name, "left")
    rows = rows.na.fill(0, ["n_both", "_run_a", "_run_b"])
    rows = rows.select("run_a", "run_b", "n_both", (F.col("_run_a") + F.col("_run_b") - F.col("n_both")).alias("n_either"))
    return rows.withColumn("jaccard", F.coalesce(F.try_divide("n_both", "n_either"), F.lit(1.0))).withColumn(
        "passed", F.col("jaccard") >= GATE_JACCARD
    )


def verdict_agreement(runs: DataFrame, key: list[str]) -> DataFrame:
    """Share of findings that got the same verdict in every run."""
    per_finding = runs.groupBy(*key).agg((F.min("verdict") == F.max("verdict")).alias("same"))
    return per_finding.agg(
        F.count("*").alias("n_findings"), F.count_if("same").alias("n_same"),
        F.try_divide(F.count_if("same"), F.count("*")).alias("agreement"),
    ).withColumn("passed", F.col("agreement") >= GATE_VERDICT_AGREEMENT)


def match_layers(judged: DataFrame, truth: DataFrame) -> DataFrame:
    """One match of truth with judged findings (``kept``): ``in_l1`` where there is a finding, ``in_l2`` where one stays."""
    found = judged.groupBy(*KEY).agg(F.lit(True).alias("in_l1"), F.max("kept").alias("in_l2"))
    labels = truth.groupBy(*KEY).agg(F.max("is_vulnerable").alias("is_vulnerable"))
    return labels.join(found, KEY, "full_outer").na.fill(False, ["in_l1", "in_l2"])


def layer_effect(matched: DataFrame, severe_per_target: DataFrame, chains: DataFrame) -> DataFrame:
    """False positives removed by the verdict layer (of ``match_layers``), and chains present where two severe findings exist."""
    safe = F.coalesce(~F.col("is_vulnerable"), F.lit(False))
    noise = matched.agg(F.count_if(safe & F.col("in_l1")).alias("fp_l1"), F.count_if(safe & F.col("in_l2")).alias("fp_l2"))
    due = severe_per_target.where("n_severe >= 2").select("target").join(
        chains.select("target", F.lit(1).alias("_c")).distinct(), "target", "left"
    ).agg(F.count("*").alias("chains_due"), F.count("_c").alias("chains_present"))
    # two one-row aggregates side by side
    one = F.lit(1).alias("_k")
    out = noise.select("*", one).join(due.select("*", one), "_k").drop("_k")
    cut = F.try_divide(F.col("fp_l1") - F.col("fp_l2"), F.col("fp_l1"))
    return out.withColumn("noise_cut", cut).withColumn(
        "passed", F.coalesce(F.col("noise_cut") >= GATE_NOISE_CUT, F.lit(True)) & (F.col("chains_due") == F.col("chains_present"))
    )


def rule_audit(rules: DataFrame) -> DataFrame:
    """Problems in rule metadata; an empty list for a sound rule."""
    problems = {
        "rule_id": ~F.col("rule_id").rlike(r"^[A-Z]+-[0-9]{3}$"),
        "title": F.length(F.trim("title")) == 0,
        "description": F.length("description") < 30,
        "globs": F.size("globs") == 0,
        "owasp_ids": F.size("owasp_ids") == 0,
        "fix": F.length("fix") == 0,
        "severity": ~F.col("severity").isin(*SEVERITY_RANK),
    }
    return rules.withColumn("problems", F.array_compact(F.array(*[F.when(bad, name) for name, bad in problems.items()])))


def completeness(findings: DataFrame) -> DataFrame:
    """How many findings lack a value, per field (text fields may not be empty either)."""
    types = dict(findings.dtypes)
    cols = {n: ("path" if n == "file_path" and "file_path" not in types else n) for n in FINDING_FIELDS}

    def lacking(c: str):
        col = F.col(c)
        if types[c] == "string":
            return col.isNull() | (F.length(col) == 0)
        return col.isNull() | (F.size(col) == 0) if types[c].startswith("array") else col.isNull()

    return findings.agg(F.count("*").alias("n_findings"), *[F.count_if(lacking(c)).alias(f"lacks_{n}") for n, c in cols.items()])


def json_round_trip(findings: DataFrame) -> DataFrame:
    """Findings that change when written as JSON and read back; none should."""
    whole = F.struct(*[F.col(c) for c in findings.columns])
    back = F.from_json(F.to_json(whole, {"ignoreNullFields": "false"}), findings.schema)
    return findings.where(~back.eqNullSafe(whole))
