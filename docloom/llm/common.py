"""Reading tables, the shared folder, and cutting lineage with written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.batches import small_batches as small_batches

#: Most rows of a narrow table of keys that is sent to all tasks; a longer one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Without it, one of our own where all run on this machine, else an error."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return f"{tempfile.gettempdir()}/docloom-shared"
    raise RuntimeError(f"spark.checkpoint.dir is unset on {master}: set it to a folder that the driver and all executors share")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``df`` written and read back like ``materialize``, for as long as the block lasts: what leaves the block must be written by then."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def for_lookup(keys: DataFrame) -> DataFrame:
    """A written table of keys, marked for broadcast where its size allows it."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def held_out(doc_id: Column, modulus: int) -> Column:
    """True where crc32 of the id as text has remainder 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == 2


def about(df: DataFrame, key: str, wanted: int, total: int) -> DataFrame:
    """About ``wanted`` of ``total`` rows, those whose key hashes low: a plain filter, so that no task gathers the others' candidates."""
    if total <= wanted:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int((1 << 30) * (wanted / total))))
