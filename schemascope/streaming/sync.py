"""Keeping a catalog snapshot up to date from a stream, and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import upsert


def sync(changes: DataFrame, read: Callable[[], DataFrame], swap: Callable[[DataFrame, int], None], keys: list[str], checkpoint: str, order: str) -> StreamingQuery:
    """Merges every micro-batch into the snapshot: the latest change of each key by ``order``.

    ``swap(frame, batch)`` writes a new snapshot and puts it in place; a batch
    that is repeated after a failure gives the same snapshot.
    """
    def merge(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        swap(upsert(read(), last, keys), number)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 day", every: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(F.window("ts", size, every).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
