"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of every id in ``links(a, b)``: the smallest id reachable.

    Labels fall to the smallest of the neighbours' and then to their own
    label's label, so that chains shorten fast.  Minima are pre-aggregated
    before each shuffle, and every round is a written table: a hub with very
    many links costs no single task, and a lost executor one round at most.
    Null ends are left out; repeated links and loops change nothing.
    """
    links = links.where("a is not null and b is not null and a <> b")
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.id).select(F.col("a").alias("id"), "label", F.lit(None).cast("long").alias("old"))
        least = seen.union(labels.select("id", "label", F.col("label").alias("old"))).groupBy("id").agg(F.min("label").alias("near"), F.max("old").alias("old"))
        jump = labels.select(F.col("id").alias("near"), F.col("label").alias("further"))
        fresh = materialize(least.join(jump, "near").select("id", F.least("near", "further").alias("label"), "old"), "labels")
        if fresh.where("label <> old").isEmpty():
            return fresh.select("id", F.col("label").alias("component"))
        labels = fresh.select("id", "label")
