"""Text column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sqltext import sql_text
from ..rules.fixed import CONTEXT_LINES, FILE_CHAR_LIMIT, FILE_CUT_MARK, NOT_ANALYSED, REDACTED

# Marks match starts inside a text.  A private-use character is neither a word
# nor a space character, so exchanging a stray one for U+FFFD (same classes)
# cannot change what a pattern matches.
MARK = "\ue000"
_MARK_STAND_IN = "\ufffd"


def decode_content(raw: Column) -> Column:
    """Bytes to text: UTF-8 with bad bytes replaced, every newline form as ``\\n``."""
    return normalise_newlines(F.make_valid_utf8(raw.cast("string")))


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("\r\n?"), F.lit("\n"))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_of_offset(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return F.size(split_lines(F.left(text, offset)))


def match_lines(text: str, java_regex: str) -> str:
    """SQL: 1-based line of the start of every non-overlapping match, in match order.

    Every match start gets a mark, the marked text is split into lines, and a
    line number is repeated once per mark in its line.
    """
    mark = sql_text(MARK)
    safe = f"CASE WHEN contains({text}, {mark}) THEN translate({text}, {mark}, {sql_text(_MARK_STAND_IN)}) ELSE {text} END"
    marked = f"regexp_replace({safe}, {sql_text(java_regex)}, {sql_text(MARK + '$0')})"
    return f"""
        flatten(transform(
            filter(transform(split({marked}, '\\n'), (l, i) -> named_struct('n', i + 1, 'line', l)), x -> contains(x.line, {mark})),
            x -> array_repeat(x.n, length(x.line) - length(replace(x.line, {mark}, '')))))"""


def context_lines(lines: Column, n: Column, around: int = CONTEXT_LINES) -> Column:
    """The lines ``n - around .. n + around`` that exist."""
    first = F.greatest(n - around, F.lit(1))
    return F.slice(lines, first, n + around - first + 1)


def render_context(context: Column, n: Column, around: int = CONTEXT_LINES) -> Column:
    """``"{number}: {line}"`` per context line."""
    first = F.greatest(n - around, F.lit(1))
    return F.array_join(F.transform(context, lambda line, i: F.concat((first + i).cast("string"), F.lit(": "), line)), "\n")


def context_snippet(lines: Column, n: Column, around: int = CONTEXT_LINES) -> Column:
    return render_context(context_lines(lines, n, around), n, around)


def redact(text: Column, java_regex: str) -> Column:
    return F.regexp_replace(text, F.lit(java_regex), F.lit(REDACTED.replace("$", "\\$")))


def head_and_tail(text: Column, limit: int = FILE_CHAR_LIMIT, mark: str = FILE_CUT_MARK) -> Column:
    """Texts over the limit keep their first and last half, joined by a marker."""
    half = limit // 2
    return F.when(
        F.length(text) > limit,
        F.concat(F.left(text, F.lit(half)), F.lit(mark), F.right(text, F.lit(half))),
    ).otherwise(text)


def triage_block(seq: Column, rule_id: Column, severity: Column, path: Column, line: Column, title: Column,
                 description: Column, snippet: Column) -> Column:
    """A finding as text for a classification batch."""
    return F.concat(
        F.lit("--- Finding "), seq.cast("string"), F.lit(" ---\nRule: "), rule_id, F.lit(" | Severity: "), severity,
        F.lit("\nFile: "), path, F.lit(":"), line.cast("string"), F.lit("\nTitle: "), title,
        F.lit("\nDescription: "), description, F.lit("\nCode context:\n"), snippet, F.lit("\n"),
    )


def chain_block(rule_id: Column, severity: Column, path: Column, line: Column, title: Column,
                description: Column, demo: Column) -> Column:
    """A finding as text for chain analysis."""
    return F.concat(
        F.lit("--- Finding "), rule_id, F.lit(" ---\nSeverity: "), F.upper(severity), F.lit("\nFile: "), path,
        F.lit(":"), line.cast("string"), F.lit("\nTitle: "), title, F.lit("\nDescription: "), description,
        F.lit("\nAttack demo (if available): "), F.coalesce(F.nullif(demo, F.lit("")), F.lit(NOT_ANALYSED)), F.lit("\n"),
    )


# every chain block holds at least this much fixed text (rule id etc. left empty)
CHAIN_BLOCK_MIN_CHARS = len("--- Finding  ---\nSeverity: \nFile: :\nTitle: \nDescription: \nAttack demo (if available): \n")
