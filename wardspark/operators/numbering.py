"""Positions inside groups of any size.

``row_number()`` sorts a whole group in one task.  Here the rows are sorted
once across the cluster by range (group first), so a large group spreads over
many blocks.  A row's position is its place inside its block minus the place of
the group's first row there, plus the rows of the group in earlier blocks.
Only one row per (group, block) is ever windowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_lines
from ..session import cut_lineage

FINDING_ORDER = ("path", "rule_ord", "pattern_ord", "match_ord", "line_number")


def with_positions(df: DataFrame, order: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """Add 0-based positions: ``groups`` maps a new column to the columns it counts within.

    Every group must be a prefix of ``order``, and ``order`` should identify a
    row.  The sorted rows are written, so that block numbers stay fixed
    however often the result is read and whatever is lost on the way.
    """
    for cols in groups.values():
        if list(order[: len(cols)]) != list(cols):
            raise ValueError(f"{cols} is not a prefix of {order}")
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id())).withColumn(
        "_block", F.shiftright("_at", 33)
    )
    # the groups are nested, so the shifts of the wider ones join the spans of the
    # narrowest (small tables), and the rows themselves are joined once
    nested = sorted(groups.items(), key=lambda g: len(g[1]), reverse=True)
    finest = nested[0][1]
    shifts = None
    for name, cols in nested:
        spans = placed.groupBy(*cols, "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
        earlier = Window.partitionBy(*cols).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        shift = (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias(name)
        starts = spans.select(*cols, "_block", shift)
        shifts = starts if shifts is None else shifts.join(starts, [*cols, "_block"])
    out = placed.join(shifts, [*finest, "_block"])
    return out.withColumns({name: F.col("_at") + F.col(name) for name in groups}).drop("_at", "_block")


def numbered_rows(findings: DataFrame) -> DataFrame:
    """``finding_index`` inside the target and ``file_pos`` inside the file, in path, rule, pattern, match order.

    The findings are written with a row key before anything is sorted: a range sort reads its input twice
    (once for a sample), and the scan behind it should run once.  Only the keys are sorted; the numbers
    come back to the rows by the row key.
    """
    rows = cut_lineage(findings.withColumn("_row", F.monotonically_increasing_id()))
    numbers = with_positions(
        rows.select("target", *FINDING_ORDER, "_row"),
        ["target", *FINDING_ORDER],
        {"finding_index": ["target"], "file_pos": ["target", "path"]},
    )
    return rows.join(numbers.select("_row", "finding_index", "file_pos"), "_row").drop("_row")


def number_findings(findings: DataFrame) -> DataFrame:
    """The numbered rows, written: the findings table every later step reads."""
    return cut_lineage(numbered_rows(findings))


def running_sums(df: DataFrame, order: list[str], group: str, weight: str, name: str) -> DataFrame:
    """Add the sum of ``weight`` up to and with each row of its group.

    As with positions, rows are sorted once by range.  A sum runs inside one block of one group, and the sums of
    the earlier blocks of the group are added, one row for each block.  ``order`` begins with the group and identifies a row.
    """
    if order[0] != group:
        raise ValueError(f"{group} is not the first of {order}")
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id())).withColumn("_block", F.shiftright("_at", 33))
    inside = F.sum(weight).over(Window.partitionBy(group, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    totals = placed.groupBy(group, "_block").agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(group, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    return placed.withColumn(name, inside).join(shifts, [group, "_block"]).withColumn(name, F.col(name) + F.col("_before")).drop("_at", "_block", "_before")


def neighbor_lines(files: DataFrame, around: int = 3, block: int = 10_000) -> DataFrame:
    """``path, line_number, around``: every line with those before and after it.

    Lines are rows.  A window runs over a block of lines of one file, with the ``around`` lines on either side
    of the block as context, so a file of any length is many small groups and no row holds more than its lines.
    """
    lines = files.select("path", F.posexplode(split_lines(F.col("content"))).alias("n", "line"))
    blocks = F.array_distinct(F.array(*[F.floor((F.col("n") + d) / block) for d in (-around, 0, around)]))
    dealt = lines.withColumn("block", F.explode(blocks))
    frame = Window.partitionBy("path", "block").orderBy("n").rowsBetween(-around, around)
    shown = dealt.withColumn("around", F.array_join(F.collect_list("line").over(frame), "\n"))
    return shown.where(F.col("block") == F.floor(F.col("n") / block)).select("path", (F.col("n") + 1).alias("line_number"), "around")
