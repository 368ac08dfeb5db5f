"""Token counts through a digest cache.

Content digests join a stored table of counts per tokenizer version; only texts
whose digest is missing there are encoded, once for each distinct text, and
their counts are appended to the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialize, new_path, path_exists, small_batches, table

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens long"
#: Texts given to the tokenizer in one call.
ENCODE_BLOCK = 64


def tokenizer_digest(model_path: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    kind = "tokenizers" if model_path.endswith(".json") else "sentencepiece"
    library = __import__(kind)
    with open(model_path, "rb") as f:
        return hashlib.sha256(f"{kind} {library.__version__}\n".encode() + f.read()).hexdigest()


def _counter(model_path: str):
    if model_path.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(model_path)
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


def _encode(model_path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(model_path)
        for batch in batches:
            texts, counts = batch.column("text"), []
            for at in range(0, len(texts), ENCODE_BLOCK):
                counts += count(texts.slice(at, ENCODE_BLOCK).to_pylist())
            n = len(counts)
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array([version] * n, pa.string()), pa.array(counts, pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    return run


def token_counts(documents: DataFrame, model_path: str, cache_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of every text: ``(id_col, n_bytes, n_tokens, over_limit, content_digest)``.

    One row for each input row, repeated rows and null ids included.  A null
    text counts as empty: 0 bytes, 0 tokens.  An empty table gives no rows.
    Other columns of the input are ignored, whatever their names.  The digest
    is of the text's exact UTF-8 bytes: any further normalising could join
    texts whose counts differ.  ``cache_path`` may be new, or hold counts of
    any tokenizer versions; rows that two writers both appended count once.
    """
    spark = documents.sparkSession
    small_batches(spark)
    version = tokenizer_digest(model_path)
    texts = documents.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("content_digest", F.sha2("text", 256))

    def stored() -> DataFrame:
        if not path_exists(spark, cache_path):
            return spark.createDataFrame([], CACHE_SCHEMA)
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version)

    distinct = texts.select("content_digest", "text").dropDuplicates(["content_digest"])
    misses = distinct.join(stored(), "content_digest", "left_anti") if path_exists(spark, cache_path) else distinct
    misses.mapInArrow(_encode(model_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # a table of its own, so that Spark can split a digest that very many rows have
    counts = materialize(stored().groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    keys = texts.select(F.col(id_col), "content_digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return keys.join(counts, "content_digest", "left").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "content_digest")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``documents``, against a cache of this run's own."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), new_path(spark, "token-cache"))
