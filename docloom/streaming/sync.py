"""A folder of text files as a stream into the store, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docloom.plans.ingest import ingest_texts
from docloom.store import Store

EVENTS = "source_id string, title string, text string, folder string, at timestamp"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Change events as Parquet files that arrive in a folder."""
    return spark.readStream.schema(EVENTS).parquet(folder)


def latest(events: DataFrame) -> DataFrame:
    """The last event of each source within a batch."""
    last = events.groupBy("source_id").agg(F.max_by(F.struct("title", "text", "folder"), "at").alias("e"), F.max("at").alias("at"))
    return last.select("source_id", "e.*", F.unix_micros("at").alias("seq"))


def sync_stream(events: DataFrame, store: Store, checkpoint: str, delay: str = "1 hour") -> DataStreamWriter:
    """A writer that upserts each micro-batch; repeated events within the delay are dropped, and a batch that is run again changes nothing, as equal hashes are skipped."""
    once = events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["source_id", "at"])

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest_texts(store, latest(batch))

    return once.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def chunk_counts(events: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events and characters of each time window, late ones within the delay included."""
    return events.withWatermark("at", delay).groupBy(F.window("at", window)).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
