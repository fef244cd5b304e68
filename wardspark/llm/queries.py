"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, contamination, divergence, html_text, language, licenses, near_dedup, phrases, quality, repeats, token_files, toxicity, url_filter
from .common import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents, linked at a shingle similarity of 0.75."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents, encoded and decoded again."""
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")), "doc_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents against all items of the benchmark."""
    found = contamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return contamination.digests(found)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents against the estimates of their language and source."""
    judged = quality.quality_rules(table(spark, sf_dir, "documents"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *counts, "base_failed", "kept", "distance")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents, by a machine fitted on labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents."""
    return licenses.digests(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents as sequence files in the shared folder, read back."""
    docs = table(spark, sf_dir, "documents")
    folder = token_files.default_folder(docs)
    manifest = token_files.write_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_files.read_documents(written(manifest, "token-manifest"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents without the 400-byte strings that also start elsewhere; ``text`` also without those of 240."""
    return repeats.digests(repeats.remove_repeats(table(spark, sf_dir, "documents"), shorter=repeats.PASSAGE))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of whole texts of documents, priced for every language and source."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of whole texts of documents, the best of every language."""
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents, by profiles of the rows outside the held-out fold."""
    return language.identify(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_bpe": op2_bpe,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_url_filter": op5_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_html_text": op7_html_text,
    "op8_token_files": op8_token_files,
    "op9_licenses": op9_licenses,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_divergence": op11_divergence,
    "op12_phrases": op12_phrases,
    "op13_language": op13_language,
}
ORACLE = {
    "op1_near_dedup": near_dedup.ORACLE,
    "op3_decontamination": contamination.ORACLE,
    "op5_url_filter": url_filter.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op12_phrases": phrases.ORACLE,
}
