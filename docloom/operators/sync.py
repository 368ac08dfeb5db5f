"""Keeping stored tables in step with their sources: actions, deltas, tombstones, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_actions(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Add ``action`` and ``reason`` to incoming ``(source_id, content_hash, seq)``, as if handled one by one in the order of ``seq``.

    A stored source with the same hash is skipped, one with another hash
    updated; a new source whose hash is stored, or that an earlier new source
    brought, is skipped as a duplicate.  The first of equal new hashes is a
    pre-aggregated minimum that joins back, so that content that very many
    sources share is no task of its own.  Of sources that share ``seq`` too, the
    smallest id is the first.
    """
    known = stored.select("source_id", F.col("content_hash").alias("__stored"))
    hashes = stored.select("content_hash").distinct().withColumn("__seen", F.lit(True))
    joined = incoming.join(known, "source_id", "left").join(hashes, "content_hash", "left")
    fresh = F.col("__stored").isNull() & F.col("__seen").isNull()
    first = joined.where(fresh).groupBy("content_hash").agg(F.min(F.struct("seq", "source_id")).alias("__first"))
    joined = joined.join(first, "content_hash", "left")
    repeated = fresh & (F.struct("seq", "source_id") != F.col("__first"))
    action = (
        F.when(F.col("__stored") == F.col("content_hash"), "skipped").when(F.col("__stored").isNotNull(), "update")
        .when(F.col("__seen"), "skipped").when(repeated, "skipped").otherwise("create")
    )
    reason = F.when(F.col("__stored") == F.col("content_hash"), "unchanged").when(F.col("__stored").isNull() & (F.coalesce("__seen", F.lit(False)) | repeated), "duplicate_content")
    return joined.withColumns({"action": action, "reason": reason}).drop("__stored", "__seen", "__first")


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def email_actions(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Add ``action`` to incoming ``(source_id, content_hash, labels)``: labels compare as sets with the stored ones."""
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    joined = incoming.join(stored.select("source_id", F.col("content_hash").alias("__hash"), F.col("labels").alias("__labels")), "source_id", "left")
    same = F.col("__hash") == F.col("content_hash")
    action = F.when(same & (as_set(F.col("labels")) == as_set(F.col("__labels"))), "skipped").when(same, "metadata_updated").when(F.col("__hash").isNotNull(), "update").otherwise("create")
    return joined.withColumn("action", action).drop("__hash", "__labels")


def tombstones(stored: DataFrame, listing: DataFrame, source_type: str | None = None) -> DataFrame:
    """Stored documents, of one source type if given, that the current listing lacks."""
    own = stored if source_type is None else stored.where(F.col("source_type") == source_type)
    return own.join(listing.select("source_id").distinct(), "source_id", "left_anti")


def with_attachments(gone: DataFrame, stored: DataFrame) -> DataFrame:
    """``source_id`` of the documents to delete and of those attached to them."""
    children = stored.where(F.col("parent_id").isNotNull()).join(gone.select(F.col("source_id").alias("parent_id")).distinct(), "parent_id", "left_semi")
    return gone.select("source_id").union(children.select("source_id")).distinct()


def cascade_delete(gone: DataFrame, key: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the deleted documents."""
    ids = gone.select(key).distinct()
    return {name: df.join(ids, key, "left_anti") for name, df in tables.items()}


def row_delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``change`` (new, changed, removed) of the rows whose hashes differ."""
    joined = old.select(*keys, F.col("row_hash").alias("__old")).join(new.select(*keys, F.col("row_hash").alias("__new")), keys, "full")
    change = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "changed")
    return joined.select(*keys, change.alias("change")).where("change is not null")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Stored rows overwritten by incoming ones of the same keys; of several incoming, the last by ``order``."""
    both = stored.withColumn("__new", F.lit(0)).withColumn("__o", F.lit(None).cast("long"))
    both = both.unionByName(incoming.withColumn("__new", F.lit(1)).withColumn("__o", (order if order is not None else F.lit(0)).cast("long")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc("__o")))
    return both.withColumn("__n", rank).where("__n = 1").drop("__new", "__o", "__n")


def merge_labels(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace the labels of matched documents and leave the rest of their metadata alone."""
    fresh = incoming.select("source_id", F.col("labels").alias("__labels"))
    return stored.join(fresh, "source_id", "left").withColumn("labels", F.coalesce("__labels", "labels")).drop("__labels")


def without_rows(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """Chunks but those of the given ``(doc_id, sheet_name, row_index)``."""
    return chunks.join(rows.select("doc_id", "sheet_name", "row_index").distinct(), ["doc_id", "sheet_name", "row_index"], "left_anti")


def run_summary(log: DataFrame) -> DataFrame:
    """One row of counts over a log ``(status, action, chunks_stored)``; an unknown status counts as an error."""
    success, skipped = F.col("status") == "success", F.col("status") == "skipped"
    return log.agg(
        F.count_if(success & (F.col("action") == "create")).alias("ingested"), F.count_if(success & (F.col("action") == "update")).alias("re_ingested"),
        F.count_if(skipped).alias("skipped"), F.count_if(~F.coalesce(success | skipped | F.col("status").isin("metadata_updated", "deleted"), F.lit(False))).alias("errors"),
        F.coalesce(F.sum(F.when(success, F.col("chunks_stored"))), F.lit(0)).cast("long").alias("chunks"),
    )


def delete_results(asked: DataFrame, stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(source_id, status, chunks_deleted)`` of each asked deletion: deleted, or not_found."""
    counts = chunks.groupBy("source_id").agg(F.count("*").alias("n"))
    known = stored.select("source_id").distinct().withColumn("__there", F.lit(True))
    joined = asked.select("source_id").distinct().join(known, "source_id", "left").join(counts, "source_id", "left")
    there = F.coalesce("__there", F.lit(False))
    return joined.select("source_id", F.when(there, "deleted").otherwise("not_found").alias("status"), F.when(there, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("chunks_deleted"))
