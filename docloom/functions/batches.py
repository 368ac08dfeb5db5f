"""The size of the Arrow batches in which rows go to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows in an Arrow batch: bounds a Python worker's memory where texts are long.
ARROW_ROWS = 256


def small_batches(spark: SparkSession | None = None) -> None:
    """Keep Arrow batches of the session, or the active one, small unless it already asks for smaller ones."""
    conf, key = (spark or SparkSession.active()).conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
