"""Places in one order over a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def dense_ids(rows: DataFrame, order: list[str | Column], name: str = "dense_id") -> DataFrame:
    """Numbers rows 0 .. n-1 in ``order``, which must be total for the numbers to be the same each time.

    Rows are dealt by range of the order and written once; places within a range come from a window on that range, and the rows
    of the ranges before (one number a range) are added. So no task sees more than its range.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/ordinal-{uuid.uuid4().hex}"
    rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema(rows.schema.add("_range", "integer")).parquet(path)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # a row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_place", place).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_place") - 1).drop("_range", "_place", "_start")


def in_order(sources: list[DataFrame], order: list[str], name: str = "dense_id") -> DataFrame:
    """UNION ALL of sources, numbered by source and then by each source's own order."""
    both = None
    for k, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(k))
        both = s if both is None else both.unionByName(s, allowMissingColumns=True)
    return dense_ids(both, ["_source", *order], name).drop("_source")
