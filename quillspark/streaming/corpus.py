"""Incremental ingest: line-JSON folders as a stream, merged into a published table batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import records as R


def read(spark: SparkSession, folder: str) -> DataFrame:
    return R.with_defaults(spark.readStream.schema(R.input_schema()).json(folder).drop("_corrupt_record"))


def ingest(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls ``merge`` with every batch; a batch that is repeated after a failure has the same number."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Windowed counts of an event stream; events later than the watermark are left out."""
    ts = F.col("ts").cast("timestamp")
    return events.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
