"""Severity ranks, letter grades and gate codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.fixed import DISPLAY_RANK, GRADE_LIMITS, GRADE_WEIGHTS, SEVERE, SEVERITY_RANK, WORST_GRADE


def _lookup(table: dict, key: Column, default: int) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def gate_rank(severity: Column) -> Column:
    """info 0 .. critical 4; an unknown severity counts as info."""
    return _lookup(SEVERITY_RANK, severity, 0)


def threshold_rank(threshold: str) -> int:
    """An unknown threshold counts as critical."""
    return SEVERITY_RANK.get(threshold, SEVERITY_RANK["critical"])


def display_rank(severity: Column, info_known: bool = True) -> Column:
    """critical 0 .. info 4, unknown 99.  The quick listing puts info at 99 as well."""
    table = dict(DISPLAY_RANK) if info_known else {k: v for k, v in DISPLAY_RANK.items() if k != "info"}
    return _lookup(table, severity, 99)


def is_severe(severity: Column) -> Column:
    return severity.isin(*SEVERE)


def grade_points(critical: Column, high: Column, medium: Column) -> Column:
    return (
        critical * GRADE_WEIGHTS["critical"] + high * GRADE_WEIGHTS["high"] + medium * GRADE_WEIGHTS["medium"]
    )


def letter_grade(points: Column) -> Column:
    out = F.lit(WORST_GRADE)
    for limit, grade in reversed(GRADE_LIMITS):
        out = F.when(points <= limit, grade).otherwise(out)
    return out


def count_of(severity: Column, value: str) -> Column:
    return F.count_if(severity == value)
