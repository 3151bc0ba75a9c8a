"""A change log as a stream: each micro-batch is applied to a change feed table once.

Applying is idempotent (a change that is stored already changes nothing), and the
batch id is published with the version, so a batch that is delivered again after
a failure is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.changefeed import ChangeFeedTable


def read_log(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files below the path, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def keep_current(changes: DataFrame, table: ChangeFeedTable, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Applies a stream of (keys, eff, tie, live, payload) to the table.

    `once` takes what is there and ends; otherwise the stream goes on.
    """

    def apply(batch: DataFrame, number: int) -> None:
        head = table.table.head()
        if head is None or head.get("batch", -1) < number:
            table.apply(batch, batch=number)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(changes: DataFrame, at: str, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, live, n): puts and deletes by window of the time `at`; rows later than `late` are left out in streams."""
    grouped = changes.withWatermark(at, late).groupBy(F.window(at, every).alias("w"), "live").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), "live", "n")
