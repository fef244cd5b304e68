"""The whole pipeline: files, findings, triage, report, at a chosen depth."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import describe, scan_files
from ..operators.filters import chain_eligible, collected, is_minified, severe
from ..operators.numbering import numbered_rows
from ..operators.report import report_header, tier_summary, total_checks
from ..operators.triage import assign_batches, join_audits, join_verdicts, read_chains
from ..rules import ALL_RULES, SHIPPED_RULES
from ..rules.fixed import DEFAULT_GLOBS
from ..rules.spec import usable_rules
from ..session import cut_lineage
from ..sources.tree import list_tree, missing, read_listed
from .store import StageStore


class ScanResult:
    """What a scan gives.  Each table is made when it is first asked for, so a count does not pay for snippets.

    ``findings`` (numbered; kept and audited ones from depth 2 and 3 on), ``judged`` (with ``kept``, dropped ones too),
    ``header`` (a row for every target: also empty and missing ones), ``chains``, ``chain_status``, ``tiers``,
    ``missing`` (INFO findings), ``minified`` (files left out by size or shape), ``left_out_rules``.

    The stages ``numbered``, ``judged`` and ``audited`` are written once in ``store`` and read by everything behind
    them.  ``at_depth`` gives the same scan at another depth: it shares the store, so nothing is scanned or joined again.
    """

    def __init__(self, *, source, minified, targets, checks, rules, detectors, depth, replies, left_out, missing, store):
        self._given = dict(source=source, minified=minified, targets=targets, checks=checks, rules=rules, detectors=detectors,
                           replies=replies, left_out=left_out, missing=missing, store=store)
        self._source, self._asked, self._checks, self._rules = source, targets, checks, rules
        self._detectors, self._depth, self._replies = detectors, depth, replies
        self.minified, self.left_out_rules, self.missing, self.store = minified, left_out, missing, store

    def at_depth(self, depth: int) -> ScanResult:
        return ScanResult(depth=depth, **self._given)

    @cached_property
    def _targets(self) -> DataFrame:
        return self.store.table("targets", lambda: self._asked)

    def _scan(self, **options) -> DataFrame:
        lean = scan_files(self._source, tuple(r for r in self._rules if r.kind != "custom"), **options)
        for detector in self._detectors:
            lean = lean.unionByName(detector(self._source).select(*lean.columns))
        return lean

    @property
    def _lean(self) -> DataFrame:
        return self.store.table("numbered", lambda: numbered_rows(self._scan()))

    @cached_property
    def judged(self) -> DataFrame:
        verdicts = self._replies[0]
        if self._depth < 2 or verdicts is None:
            return describe(self._lean, self._rules).withColumn("kept", F.lit(True))
        return describe(self.store.table("judged", lambda: join_verdicts(assign_batches(self._lean), verdicts)), self._rules)

    @cached_property
    def _audited(self) -> DataFrame:
        """Judged findings, dropped ones too, with audits where there are any."""
        audits = self._replies[1]
        if self._depth < 3 or audits is None:
            return self.judged.withColumn("audit_status", F.lit("skipped"))
        return self.store.table("audited", lambda: join_audits(self.judged, audits))

    @cached_property
    def findings(self) -> DataFrame:
        if self._depth >= 3 and self._replies[1] is not None:
            return self._audited.where("kept")
        return self.judged.where("kept")

    @cached_property
    def chains(self) -> DataFrame | None:
        if self._depth < 3 or self._replies[2] is None:
            return None
        eligible = chain_eligible(self.findings).select("target").distinct()
        return read_chains(self._replies[2].join(eligible, "target", "left_semi"))

    @cached_property
    def chain_status(self) -> DataFrame:
        """``target, n_severe, status``: chained, unread (a reply without a chain), no reply, or too few findings."""
        severe_ = severe(self.findings).groupBy("target").agg(F.count("*").alias("n_severe"))
        out = self._targets.join(severe_, "target", "left").na.fill(0, ["n_severe"])
        if self.chains is None:
            return out.withColumn("status", F.when(F.col("n_severe") < 2, "too few findings").otherwise("no reply"))
        read = self.chains.groupBy("target").agg(F.max(F.col("chain").isNotNull()).alias("_read"))
        status = F.when(F.col("n_severe") < 2, "too few findings").when(F.col("_read").isNull(), "no reply")
        return out.join(read, "target", "left").select("target", "n_severe", status.when(F.col("_read"), "chained").otherwise("unread").alias("status"))

    @cached_property
    def tiers(self) -> DataFrame:
        """The funnel per target: found, dropped, audited, chained."""
        chained = self.chains.where("chain is not null") if self.chains is not None else self._targets.limit(0)
        return tier_summary(self._audited, chained)

    @cached_property
    def header(self) -> DataFrame:
        """Grades and counts.  At depth 1 they come from a scan without snippets unless the findings are there already.

        ``duration_ms`` is what the stages behind it took, those written by an earlier run included.
        """
        lean = self._depth == 1 and not self._detectors and not self.store.has("numbered")
        start, made_before = time.perf_counter(), sum(self.store.seconds.values())
        found = describe(self._scan(snippets=False), self._rules) if lean else self.findings
        columns = ["target", "rule_id", "severity", "owasp_ids"]
        found = found.select(*columns)
        if self.missing is not None:
            nothing = F.array().cast("array<string>")
            found = found.unionByName(self.missing.select("target", "rule_id", "severity", nothing.alias("owasp_ids")))
        checks = self.store.table("checks", lambda: self._checks)
        made = cut_lineage(report_header(self._targets, found, checks))
        # what was read ready-made counts with the seconds it took then, the rest as measured here
        here = time.perf_counter() - start - (sum(self.store.seconds.values()) - made_before)
        return made.withColumn("duration_ms", F.lit(round(1000 * (here + sum(self.store.seconds.values())), 1)))


def scannable(files: DataFrame, globs=DEFAULT_GLOBS) -> DataFrame:
    """Files a directory scan looks into: collected and not minified.

    The content test looks at its text several times.  Inside ``exists`` the
    text is bound once, so a content that is itself an expression (decoding)
    is not evaluated for every look after the filter is pushed below it.
    """
    return files.where(collected(F.col("path"), F.col("target"), globs) & ~minified())


def minified() -> Column:
    return F.exists(F.array("content"), lambda text: is_minified(F.col("path"), text))


def run_scan(files: DataFrame, depth: int = 1, *, rules=SHIPPED_RULES, globs=DEFAULT_GLOBS,
             listing: DataFrame | None = None, targets: DataFrame | None = None, missing: DataFrame | None = None,
             minified_too: bool = False,
             detectors: tuple[Callable[[DataFrame], DataFrame], ...] = (),
             verdict_replies: DataFrame | None = None, audit_replies: DataFrame | None = None,
             chain_replies: DataFrame | None = None, scan_key: str | None = None) -> ScanResult:
    """Depth 1 detects, depth 2 adds verdicts, depth 3 adds audits and chains.

    A layer without replies passes findings on.  ``result.at_depth(n)`` is the same scan at another depth, from
    the same stored stages.  With a ``scan_key`` the stages are kept under that name: a run that names it again, at any
    depth or after a failure, goes on from what is there (the key stands for files, rules and replies).

    ``listing(target, path)`` names the files without their contents; where contents
    are costly to read it keeps targets and check counts from reading them again,
    and it also counts files that could not be read.  ``targets(target)`` are those asked for: one without a
    collected file has its header row too, as have those of ``missing``, INFO findings of targets that are not there.

    Minified files are left out and listed in the result, unless ``minified_too``.

    ``detectors`` are functions from files to lean findings for what patterns
    cannot say; list a ``RuleSpec`` of kind ``custom`` for each in ``rules``.
    Rules that do not compile are left out and reported.
    """
    left_out: list = []
    if not set(rules) <= set(ALL_RULES):
        rules, left_out = usable_rules(files.sparkSession, rules)
    names = files if listing is None else listing
    every = names.select("target")
    for more in (targets, missing):
        if more is not None:
            every = every.unionByName(more.select("target"))
    checks = total_checks(names.where(collected(F.col("path"), F.col("target"), globs)), len(rules))
    picked = files.where(collected(F.col("path"), F.col("target"), globs))
    return ScanResult(
        source=picked if minified_too else scannable(files, globs), minified=picked.where(minified()).select("target", "path"),
        targets=every.distinct(), checks=checks, rules=rules, detectors=detectors, depth=depth,
        replies=(verdict_replies, audit_replies, chain_replies), left_out=tuple(left_out), missing=missing, store=StageStore(files.sparkSession, scan_key))


def scan_tree(spark: SparkSession, targets: list[str], depth: int = 1, *, globs=DEFAULT_GLOBS, **options) -> ScanResult:
    """Scan directories or files of a shared file system.

    The tree is listed once and every file is read once.  Targets that do not
    exist come back as INFO findings in ``missing``, and every target has a row in the header.
    """
    listing = cut_lineage(list_tree(spark, targets, globs))
    asked = spark.createDataFrame([(t,) for t in targets], "target string")
    return run_scan(read_listed(listing), depth, globs=globs, listing=listing, targets=asked, missing=missing(spark, targets), **options)
