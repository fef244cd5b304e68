"""Rules as data: what a detection rule is and how its regexes become Java patterns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE, FILE = "line", "file"

# i: ignore case, u: Unicode case folding, d: '.' stops at \n only,
# U: Unicode \s \w \b, s: '.' also takes \n.
_FLAGS = {LINE: "(?iudU)", FILE: "(?isudU)"}


@dataclass(frozen=True)
class Pattern:
    """One regex of a rule.

    ``anchors`` are groups of lower-case literals: every match holds at least
    one literal of each group.  They let a scan drop most lines (or files) by
    substring tests before any regex runs, and never change the result.  Put
    the rarest group first.  Without anchors the regex is tried everywhere.
    """

    regex: str
    text: str
    mode: str = LINE
    anchors: tuple[tuple[str, ...], ...] = ()

    @property
    def java(self) -> str:
        return _FLAGS[self.mode] + self.regex


@dataclass(frozen=True)
class RuleSpec:
    """A rule: metadata, the file names it applies to, and its regexes.

    ``ordinal`` fixes the order of findings inside one file.  ``kind`` is
    ``regex`` for pattern rules; the built-in structural rules name their own
    kind and carry no patterns.
    """

    rule_id: str
    name: str
    ordinal: int
    severity: str
    owasp_ids: tuple[str, ...]
    globs: tuple[str, ...]
    title: str
    description: str
    fix: str
    patterns: tuple[Pattern, ...] = field(default=())
    kind: str = "regex"


RULE_SCHEMA = (
    "rule_ord int, rule_id string, name string, title string, description string, severity string, "
    "globs array<string>, owasp_ids array<string>, fix string, kind string, n_patterns int"
)


def rules_table(spark: SparkSession, rules: tuple[RuleSpec, ...]) -> DataFrame:
    """The rule set as a table; as long as the list of rules the job was built from."""
    rows = [
        (r.ordinal, r.rule_id, r.name, r.title, r.description, r.severity, list(r.globs), list(r.owasp_ids),
         r.fix, r.kind, len(r.patterns))
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def patterns_table(spark: SparkSession, rules: tuple[RuleSpec, ...]) -> DataFrame:
    rows = [
        (r.ordinal, r.rule_id, k, p.regex, p.text, p.mode)
        for r in rules
        for k, p in enumerate(r.patterns)
    ]
    return spark.createDataFrame(
        rows, "rule_ord int, rule_id string, pattern_ord int, regex string, pattern_text string, mode string"
    )


def glob_to_column(name: Column, glob: str) -> Column:
    """File-name glob as a predicate: suffix or equality where that is enough, a regex otherwise."""
    wild = set("*?[")
    if not wild & set(glob):
        return name == F.lit(glob)
    if glob.startswith("*") and not wild & set(glob[1:]):
        return name.endswith(glob[1:])
    return name.rlike("(?s)" + _glob_regex(glob))


def _glob_regex(glob: str) -> str:
    out, i = ["^"], 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1:close].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body.replace("^", "\\^")) + "]")
            i = close
        else:
            out.append(ch if ch.isalnum() or ch == "_" else "\\" + ch)
        i += 1
    return "".join(out) + "\\z"


def any_glob(name: Column, globs) -> Column:
    """True where the file name matches at least one glob."""
    tests = [glob_to_column(name, g) for g in globs]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def usable_rules(spark: SparkSession, rules) -> tuple[tuple[RuleSpec, ...], list[tuple[str, str]]]:
    """Rules whose patterns the JVM accepts, and ``(rule_id, reason)`` for those left out.

    A rule with a broken pattern is dropped as a whole, the others go on.  All
    regexes are tried in one query over no data; only if that fails is each
    rule tried on its own.
    """
    if _compile_error(spark, rules) is None:
        return tuple(rules), []
    good, bad = [], []
    for rule in rules:
        reason = _compile_error(spark, [rule])
        if reason is None:
            good.append(rule)
        else:
            bad.append((rule.rule_id, reason))
    return tuple(good), bad


def _compile_error(spark: SparkSession, rules) -> str | None:
    probes = [F.lit("").rlike(p.java) for rule in rules for p in rule.patterns]
    if not probes:
        return None
    try:
        spark.range(1).select(*probes).collect()
    except Exception as err:
        return str(err).splitlines()[0]
    return None
