"""Detection: files in, findings out, in one pass over the files and without a shuffle.

A file is one unit; a long one is also cut into blocks of lines before any pattern
runs, each with a few lines of its neighbours for context, so that no row holds the
candidate lines of more than a block.  Every unit yields an array of hits and is exploded once:

* line patterns: the unit is split into lines, lines without any of the anchor
  words that the unit holds are dropped, and what is left is exploded and tested
  by the patterns of the words it holds.  Context lines travel with the few lines that pass the anchor test,
  so no second read of the files is needed for snippets.
* file patterns: tested on the whole text; matches become hits with the line
  of their start.
* tool-server configs: JSON texts are parsed once and three rules look at the
  result.

Patterns are literals in the plan, so each is compiled once per task.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name
from ..functions.sqltext import sql_text
from ..functions.text import match_lines, render_context, split_lines
from ..rules import ALL_RULES
from ..rules.fixed import CONTEXT_LINES, DESCRIPTION_SHOWN_CHARS, INJECTION_PHRASES, PHRASE_SHOWN_CHARS
from ..rules.spec import FILE, LINE, Pattern, RuleSpec, any_glob, patterns_table, rules_table
from .configs import config_hits
from .hits import NO_HITS, context, hit

#: Texts over so many bytes are matched line by line in blocks of so many lines.
LONG_BYTES, BLOCK_LINES = 1 << 20, 2000


def scan_files(files: DataFrame, rules: tuple[RuleSpec, ...] = ALL_RULES, *, match_globs: bool = True,
               snippets: bool = True, modes: tuple[str, ...] = (LINE, FILE)) -> DataFrame:
    """Lean findings of ``files(path, content, ...)``; other columns are passed through.

    One row per finding: ``rule_ord, pattern_ord, line_number, match_ord, note,
    code_snippet``.  ``match_globs=False`` applies every rule to every row, for
    table corpora whose ids are not file names.  ``snippets=False`` leaves the
    context out for jobs that only count.  ``modes`` leaves out patterns of the
    other mode before anything is matched.
    """
    keep = [c for c in files.columns if c != "content"]
    globs = list(dict.fromkeys(r.globs for r in rules))
    applies = {g: f"_applies{i}" for i, g in enumerate(globs)}
    line_rules = [r for r in rules if LINE in modes and r.kind == "regex" and any(p.mode == LINE for p in r.patterns)]

    name = file_name(F.col("path"))
    flags = [(any_glob(name, g) if match_globs else F.lit(True)).alias(applies[g]) for g in globs]
    prepared = files.select(*keep, "content", *flags)
    if match_globs:
        prepared = prepared.where(reduce(or_, [F.col(c) for c in applies.values()]))
    whole_too = any(r.kind != "regex" or FILE in modes and any(p.mode == FILE for p in r.patterns) for r in rules)
    unit = F.explode_outer(F.expr(_units(bool(line_rules), whole_too))).alias("_unit")
    prepared = prepared.select(*keep, *applies.values(), unit).select(*keep, *applies.values(), "_unit.*")
    prepared = prepared.withColumns({"_lines": split_lines(F.col("content")), "_folded": fold_case(F.col("content"))})
    if line_rules:
        prepared = prepared.withColumn("_seen", F.expr(_seen_words(line_rules)))

    hits = []
    if line_rules:
        hits.append(_line_candidates(line_rules, applies, snippets))
    for rule in rules:
        if rule.kind == "regex":
            for k, p in enumerate(rule.patterns):
                if p.mode == FILE and FILE in modes:
                    hits.append(_file_hits(rule, k, applies[rule.globs], snippets))
        elif rule.kind == "tool_description":
            hits.append(_description_hits(rule, applies[rule.globs], snippets))
    config_rules = [r for r in rules if r.kind.startswith("config_")]
    if config_rules:
        hits.append(config_hits(config_rules, f"_whole AND {applies[config_rules[0].globs]}", snippets))

    # explode_outer and a null test: for a plain explode the optimizer would put
    # a size() > 0 filter below, and with it every regex twice
    all_hits = F.expr("concat(" + ", ".join(hits) + ")")
    seen = ["_seen"] if line_rules else []
    found = prepared.select(*keep, *applies.values(), *seen, F.explode_outer(all_hits).alias("hit")).where("hit is not null")
    found = _match_lines(found, keep, line_rules, applies) if line_rules else found.select(*keep, "hit")
    hit_col = F.col("hit")
    return found.select(
        *keep,
        *[hit_col[n].alias(n) for n in ("rule_ord", "pattern_ord", "line_number", "match_ord", "note")],
        F.coalesce(hit_col["snippet"], render_context(hit_col["context"], hit_col["line_number"])).alias("code_snippet"),
    )


def _units(line_rules: bool, whole_too: bool) -> str:
    """SQL: the text itself, or if it is long its blocks of lines and, for what looks at whole texts, the text.

    ``_own`` lines from line ``_before + 1`` of ``content`` are the unit's own, and the first line of ``content`` is
    line ``_skipped + 1`` of the file; a unit without own lines is only for patterns of whole texts (``_whole``).
    """
    around = CONTEXT_LINES
    whole = f"""array(named_struct('_skipped', 0, '_before', 0, '_own', {0 if line_rules else 1 << 30}, '_whole', true, 'content', content))"""
    blocks = f"""
        flatten(transform(array(split(content, '\n')), lines -> transform(sequence(0, size(lines) - 1, {BLOCK_LINES}),
            n -> named_struct('_skipped', greatest(n - {around}, 0), '_before', least(n, {around}), '_own', {BLOCK_LINES}, '_whole', false,
                              'content', array_join(slice(lines, greatest(n - {around}, 0) + 1, least(n, {around}) + {BLOCK_LINES + around}), '\n')))))"""
    long = {(True, True): f"concat({whole}, {blocks})", (True, False): blocks}.get((line_rules, whole_too), whole)
    short = "array(named_struct('_skipped', 0, '_before', 0, '_own', 1 << 30, '_whole', true, 'content', content))".replace("1 << 30", str(1 << 30))
    return f"CASE WHEN coalesce(octet_length(content), 0) <= {LONG_BYTES} THEN {short} ELSE {long} END"


def fold_case(text: Column) -> Column:
    """Lower case, with the few letters that regexes treat as an ASCII letter mapped to it.

    Ignoring case, the long s, the dotless i and the dotted capital I (lower
    case: i and a combining dot) match ``s`` and ``i``.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(F.lower(text), "\u017f\u0131\u0307", "si"))


def may_match(folded: str, pattern: Pattern) -> str:
    """SQL predicate: the folded text holds a literal of each of the pattern's anchor groups."""
    return " AND ".join(_holds_any(folded, group) for group in pattern.anchors) or "true"


def _holds_any(folded: str, words) -> str:
    return "(" + " OR ".join(f"contains({folded}, {sql_text(w)})" for w in _shortest(words)) + ")"


def _shortest(words) -> list[str]:
    """A word that contains another listed word adds nothing."""
    return [w for w in words if not any(o != w and o in w for o in words)]


def _line_patterns(rules) -> list[tuple[int, RuleSpec, Pattern]]:
    return [(r.ordinal * 100 + k, r, p) for r in rules for k, p in enumerate(r.patterns) if p.mode == LINE]


def _unanchored(rules) -> list[int]:
    """Codes of the line patterns that may match on any line."""
    return [code for code, _, p in _line_patterns(rules) if not p.anchors]


def _seen_words(rules) -> str:
    """SQL: of the words of all first anchor groups those that the folded text holds at all, each with the codes of its patterns.

    So lines are tested for these few words only, and a line only by the patterns of the words it holds.
    """
    firsts = {code: p.anchors[0] for code, _, p in _line_patterns(rules) if p.anchors}
    words = _shortest(dict.fromkeys(w for g in firsts.values() for w in g))
    codes = {w: [str(code) for code, group in firsts.items() if any(w in longer for longer in group)] for w in words}
    listed = ", ".join(f"named_struct('word', {sql_text(w)}, 'codes', array({', '.join(codes[w])}))" for w in words)
    return f"filter(array({listed}), w -> contains(_folded, w.word))" if words else f"CAST(array() AS array<{_SEEN}>)"


_SEEN = "struct<word:string,codes:array<int>>"


def _line_candidates(rules, applies, snippets: bool) -> str:
    """Lines on which some pattern may match, with their context, as hits without a rule."""
    wanted = " OR ".join(dict.fromkeys(applies[r.globs] for r in rules))
    around = {"context": context("(i + 1)")} if snippets else {}
    file_may, line_may = ("true", "true") if _unanchored(rules) else ("size(_seen) > 0", "exists(_seen, w -> contains(f, w.word))")
    return f"""
        CASE WHEN _own > 0 AND ({wanted}) AND {file_may} THEN
            array_compact(transform(split(_folded, '\\n'), (f, i) ->
                CASE WHEN i >= _before AND i < _before + _own AND {line_may}
                THEN {hit(-1, -1, "_skipped + i + 1", "_skipped + i + 1", line="get(_lines, i)", folded="f", **around)} END))
        ELSE {NO_HITS} END"""


def _match_lines(found: DataFrame, keep, rules, applies) -> DataFrame:
    """Replace each candidate line by one row per pattern that matches it."""
    tests = " ".join(f"WHEN {code} THEN {applies[r.globs]} AND {may_match('f', p)} AND rlike(hit.line, {sql_text(p.java)})"
                     for code, r, p in _line_patterns(rules))
    held = "flatten(transform(filter(_seen, w -> contains(f, w.word)), w -> w.codes))"
    anywhere = ", ".join(map(str, _unanchored(rules)))
    # the folded line is bound to a variable: a look at a field of the hit costs more than a test
    matched = f"get(transform(array(hit.folded), f -> filter(array_distinct(concat(CAST(array({anywhere}) AS array<int>), {held})), c -> CASE c {tests} END)), 0)"
    ready = F.array(F.col("hit.rule_ord") * 100 + F.col("hit.pattern_ord"))
    codes = F.when(F.col("hit.rule_ord") < 0, F.expr(matched)).otherwise(ready)
    rows = found.select(*keep, "hit", F.explode_outer(codes).alias("_code")).where("_code is not null")
    return rows.select(
        *keep,
        F.col("hit")
        .withField("rule_ord", F.floor(F.col("_code") / 100).cast("int"))
        .withField("pattern_ord", (F.col("_code") % 100).cast("int"))
        .alias("hit"),
    )


def _file_hits(rule: RuleSpec, k: int, flag: str, snippets: bool) -> str:
    p = rule.patterns[k]
    around = {"context": context("n")} if snippets else {}
    return f"""
        CASE WHEN _whole AND {flag} AND {may_match('_folded', p)}
        THEN transform({match_lines('content', p.java)}, (n, i) -> {hit(rule.ordinal, k, "n", "i", **around)})
        ELSE {NO_HITS} END"""


def _description_hits(rule: RuleSpec, flag: str, snippets: bool) -> str:
    """Description literals and docstrings that hold an injection phrase."""
    place = rule.patterns[0]
    java, phrase = "(?iudU)" + place.regex, sql_text("(?iudU)" + INJECTION_PHRASES)
    shown = {"snippet": f"left(x.text, {DESCRIPTION_SHOWN_CHARS})"} if snippets else {}
    note = f"concat('tool description holds the phrase: ', left(regexp_extract(x.text, {phrase}, 0), {PHRASE_SHOWN_CHARS}))"
    return f"""
        CASE WHEN _whole AND {flag} AND {may_match('_folded', place)} AND rlike(content, {phrase}) THEN
            transform(
                filter(
                    transform(arrays_zip(regexp_extract_all(content, {sql_text(java)}, 0), {match_lines('content', java)}),
                              x -> named_struct('text', x.`0`, 'n', x.`1`)),
                    x -> rlike(x.text, {phrase})),
                (x, i) -> {hit(rule.ordinal, 0, "x.n", "i", note=note, **shown)})
        ELSE {NO_HITS} END"""


def describe(findings: DataFrame, rules: tuple[RuleSpec, ...] = ALL_RULES) -> DataFrame:
    """Full findings: rule and pattern metadata joined to lean ones.

    Both dimension tables are as long as the list of rules compiled into the
    scan, so broadcasting them is bounded by the size of the plan itself.
    """
    spark = findings.sparkSession
    meta = rules_table(spark, rules).select("rule_ord", "rule_id", "title", "severity", "owasp_ids",
                                            F.col("fix").alias("fix_suggestion"), F.col("description").alias("_rule_text"))
    texts = patterns_table(spark, rules).select("rule_ord", "pattern_ord", "pattern_text")
    return (
        findings.join(F.broadcast(meta), "rule_ord")
        .join(F.broadcast(texts), ["rule_ord", "pattern_ord"], "left")
        .withColumn("description", F.coalesce("note", "pattern_text", "_rule_text"))
        .withColumn("attack_demo", F.lit(""))
        .drop("note", "pattern_text", "_rule_text")
    )


def scan(files: DataFrame, rules: tuple[RuleSpec, ...] = ALL_RULES, **options) -> DataFrame:
    """Full findings of a file table."""
    return describe(scan_files(files, rules, **options), rules)
