"""From raw documents to token ids, in five stages that each work on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import bpe, contamination, near_dedup, quality, repeats
from wardspark.llm.common import written

TOKENIZER = "word_bpe_49k.json"
#: A passage of 51 words of prose has more bytes than this.
PASSAGE_BYTES = 240


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; needs ``lang`` and ``source`` besides ``text``.

    Null and empty texts have no words and go.  Null languages and sources are a group of their own.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Null and empty texts are like nothing else; of repeated rows with one id and text one stays, as of equal texts without an id.
    """
    return near_dedup.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``PASSAGE_BYTES`` that also start elsewhere are cut out of the texts; all documents stay.

    Null texts stay null, shorter ones stay as they are, and ``n_chars`` is counted anew where something went.
    """
    return repeats.cleaned(docs, PASSAGE_BYTES)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go; null and empty texts stay, all do with an empty benchmark."""
    return contamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_chars``, the ids, their number, and digests of ids and decoded text; null texts have no ids."""
    packed = docs.select(F.struct("doc_id", "lang", "source", "n_chars").alias("doc"), "text")
    encoded = bpe.encode_decode(packed, public_tokenizers.path(TOKENIZER), id_col="doc")
    return bpe.digests(encoded, "doc", "ids").select("doc.*", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", token_ids),
]


def check_workers(spark: SparkSession) -> None:
    """Fail before the first stage, and clearly, where Python workers would not find the package."""

    def run(batches):
        import wardspark.llm  # noqa: F401

        yield from batches

    try:
        spark.range(1).mapInArrow(run, "id long").collect()
    except PySparkException as err:
        raise RuntimeError("workers cannot import wardspark: install it on the executors or ship it with --py-files") from err


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``; what each returns is written and read again.  An empty table stays empty."""
    check_workers(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{n}")
    return docs


#: The robust estimates and the merges of the vocabulary are not for SQL; tests compare with brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
