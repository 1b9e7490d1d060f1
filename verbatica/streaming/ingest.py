"""Resumable incremental ingest of keyed rows.

New rows are appended to a Parquet table until every group has its quota. Seen identifiers and filled quotas are read
from the table itself, so that a restarted job, or one whose batch is delivered again, adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def accept(rows: DataFrame, stored: DataFrame | None, key: str, group: str, quota: int, order: str, duration: str | None = None, low: float = 0.0, high: float = 1e9) -> DataFrame:
    """The rows of a batch to add: unseen keys, durations in range, the first ones up to what is left of the quota."""
    fresh = rows.filter(F.col(key).isNotNull())
    if duration is not None:
        fresh = fresh.filter(F.col(duration).between(low, high))
    once = fresh.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("__r = 1").drop("__r")
    used = None
    if stored is not None:
        once = once.join(stored.select(key), key, "left_anti")
        used = stored.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__used"))
    # a null group is a group; only the quota's rows of a group are ever shuffled
    placed = once.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("__r") <= quota)
    if used is None:
        return placed.drop("__r")
    left = placed.join(used, F.col(group).eqNullSafe(F.col("__g")), "left")
    return left.filter(F.col("__r") + F.coalesce("__used", F.lit(0)) <= quota).drop("__r", "__g", "__used")


def stored_rows(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001 - nothing has been stored yet
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def start_ingest(stream: DataFrame, path: str, checkpoint: str, key: str, group: str, quota: int, order: str, duration: str | None = None, low: float = 0.0, high: float = 1e9, once: bool = True) -> StreamingQuery:
    """Append a stream's acceptable rows to the table at ``path``.

    The offsets are kept in ``checkpoint``. ``once``: take what is there, then stop.
    """
    schema = stream.schema

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        accept(batch, stored_rows(spark, path, schema), key, group, quota, order, duration, low, high).write.mode("append").parquet(path)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """A stream without repeated keys; its state is bounded by how late a repeat may come."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
