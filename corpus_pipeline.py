"""From raw documents to packed training sequences, in five written stages."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialize, new_path, table
from docloom.llm.decontaminate import without_contaminated
from docloom.llm.near_dup import without_near_duplicates
from docloom.llm.packing import cut_pieces, pack
from docloom.llm.pii import redact_pii
from docloom.llm.quality import ACCEPT, fit_quality, with_quality, with_statistics

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their labels, accepts."""
    docs = docs.select(*DOCUMENTS)
    seen = materialize(with_statistics(docs), "quality-statistics")
    model = fit_quality(seen, table(spark, sf_dir, "labels"))
    return with_quality(docs, model).where(F.col("quality_score") >= ACCEPT).select(*DOCUMENTS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return without_near_duplicates(docs.select(*DOCUMENTS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return without_contaminated(docs.select(*DOCUMENTS), table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return redact_pii(docs.select(*DOCUMENTS)).withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENTS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of at most 2048 tokens."""
    return pack(cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: No stage but the last could be SQL without being another method; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
