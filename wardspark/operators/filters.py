"""Which files are scanned: targets, skipped directories, globs, minified files, config files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name, parent, relative_dirs
from ..rules.fixed import (
    DEFAULT_GLOBS, MINIFIED_FEW_LINES, MINIFIED_MEAN_LINE, MINIFIED_MIN_CHARS, SEVERE, SKIPPED_DIRS,
)
from ..rules.spec import any_glob
from .configs import is_tool_config


def in_skipped_dir(path: Column, target: Column) -> Column:
    """Some directory below the target has a skipped name (exact, case-sensitive)."""
    return F.arrays_overlap(relative_dirs(path, target), F.array(*[F.lit(d) for d in SKIPPED_DIRS]))


def collected(path: Column, target: Column, globs=DEFAULT_GLOBS) -> Column:
    """A scan of the target picks this file up; a target that is the file itself is taken as it is."""
    return (path == target) | (~in_skipped_dir(path, target) & any_glob(file_name(path), globs))


def is_minified(path: Column, content: Column) -> Column:
    newlines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    n_lines = newlines + 1
    folder = parent(path)
    return (
        F.lower(file_name(path)).contains(".min.")
        | folder.contains("Min")
        | (file_name(folder) == "min")
        | ((n_lines < MINIFIED_FEW_LINES) & (F.length(content) - newlines > MINIFIED_MIN_CHARS))
        | (F.length(content) / n_lines > MINIFIED_MEAN_LINE)
    )


def tool_config() -> Column:
    return F.expr(is_tool_config("path", "content"))


def select_targets(files: DataFrame, requested: DataFrame, globs=DEFAULT_GLOBS) -> DataFrame:
    """Files of the requested targets: ``files(target, path, ..)`` by ``requested(request)``.

    A request that names a directory applies the directory and name filters; a
    request that names one file takes it as it is.  Both are equi-joins on
    unique request names.  Run it on a listing, before contents are read.
    """
    wanted = requested.select(F.col("request")).distinct()
    by_dir = files.join(wanted, files["target"] == wanted["request"]).where(collected(F.col("path"), F.col("target"), globs))
    by_file = files.join(wanted, files["path"] == wanted["request"])
    return by_dir.unionByName(by_file)


def missing_targets(files: DataFrame, requested: DataFrame) -> DataFrame:
    """One INFO finding per request that is neither a directory nor a file of the listing."""
    wanted = requested.select("request").distinct()
    names = files.select(F.col("target").alias("request")).distinct().unionByName(files.select(F.col("path").alias("request")))
    # only names that were asked for go into the anti join, however large the listing is
    known = names.join(wanted, "request", "left_semi")
    return not_found(wanted.join(known, "request", "left_anti"))


def not_found(requests: DataFrame) -> DataFrame:
    """The INFO finding of every request."""
    return requests.select(
        F.col("request").alias("target"),
        F.lit("engine").alias("rule_id"),
        F.lit("Target not found").alias("title"),
        F.lit("info").alias("severity"),
        F.col("request").alias("path"),
        F.lit(0).alias("line_number"),
        F.concat(F.lit("Path does not exist: "), F.col("request")).alias("description"),
        F.lit(0).alias("total_checks"),
    )


def severe(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity").isin(*SEVERE))


def chain_eligible(findings: DataFrame) -> DataFrame:
    """Severe findings of the targets that have at least two of them."""
    chainable = severe(findings)
    enough = chainable.groupBy("target").agg(F.count("*").alias("_n")).where("_n >= 2").select("target")
    return chainable.join(enough, "target", "left_semi")


def at_or_above(findings: DataFrame, threshold: str) -> DataFrame:
    from ..functions.grading import gate_rank, threshold_rank

    return findings.where(gate_rank(F.col("severity")) >= threshold_rank(threshold))


def by_rule_set(findings: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """The findings of every rule set, put together as a bag with the name of the set in ``rule_set``.

    A finding of several sets comes once for each.  One pass: the names a finding belongs to are exploded.
    """
    names = F.array_compact(F.array(*[F.when(F.col("rule_id").isin(rules), F.lit(name)) for name, rules in sets.items()]))
    return findings.withColumn("rule_set", F.explode(names))
