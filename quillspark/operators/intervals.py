"""Joins on ranges and on the nearest earlier row, as equi-joins and range-partitioned sorts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

#: Cells into which the points are cut; the cuts travel as literals.
CELLS = 128


def interval_join(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, place: Callable[[Column], Column] = lambda c: c, cells: int = CELLS) -> DataFrame:
    """Every pair with low <= at < high (null high: open), columns of both sides.

    ``place`` maps a value to a long and never turns the order round; the points' places are cut at quantiles of their
    distinct values. A point stands in one cell, an interval in those from its low to its high cell, and cell by cell an
    equi-join brings them together; the exact condition decides. An interval that spans many cells holds the points of
    all cells between its ends, so its rows are bounded by its matches, and no pair is looked at outside a common cell.
    Null points and lows match nothing.
    """
    some = [i / cells for i in range(1, cells)]
    p = points.where(F.col(at).isNotNull())
    row = p.select(place(F.col(at)).alias("p")).distinct().agg(F.percentile_approx("p", some, 10_000).alias("c")).first()  # cells - 1 numbers
    cuts = sorted(set(row.c or []))

    def cell(c: Column) -> Column:
        return F.size(F.filter(F.lit(cuts), lambda x: x <= place(c))) if cuts else F.lit(0)

    last = F.when(F.col(high).isNull(), F.lit(len(cuts))).otherwise(cell(F.col(high)))
    i = intervals.where(F.col(low).isNotNull() & (F.col(high).isNull() | (F.col(low) < F.col(high))))
    i = i.withColumn("_cell", F.explode(F.sequence(cell(F.col(low)), last)))
    inside = (F.col(at) >= F.col(low)) & (F.col(high).isNull() | (F.col(at) < F.col(high)))
    return p.withColumn("_cell", cell(F.col(at))).join(i, "_cell").where(inside).drop("_cell")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str]) -> DataFrame:
    """Every row of ``left`` with the columns ``take`` of the row of ``right`` that has the same ``by`` and the largest
    ``on`` not above its own; null where there is none. Of right rows with equal ``by`` and ``on`` the largest ``take`` counts.

    Both sides are laid end to end, dealt by range of (by, on), right before left at equal places, and written once with the
    number of each row's range: dealt twice, the same row may fall into two ranges, as cuts are sampled and small ranges merged.
    Within a range the last right row is carried forward, and what a range inherits is the last right row of the ranges
    before it, a row a range. So a group of any size is spread over as many tasks as its rows need, and no group is sorted in
    one task. Null ``by`` or ``on`` on the left finds nothing; on the right it is left out.
    """
    spark = left.sparkSession
    known = F.struct(*(F.col(c) for c in by), F.col(on), F.struct(*take).alias("_take"))
    r = right.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, on])).select(*by, on, F.lit(0).alias("_side"), known.alias("_right"), F.lit(None).alias("_left"))
    whole = F.struct(*left.columns)
    lft = left.select(*by, on, F.lit(1).alias("_side"), F.lit(None).alias("_right"), whole.alias("_left"))
    order = [*by, on, "_side", F.col("_right._take").asc_nulls_last()]
    laid, path = r.unionByName(lft), f"{shared_dir(spark)}/asof-{uuid.uuid4().hex}"
    laid.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()).write.parquet(path)
    both = spark.read.schema(laid.schema.add("_pid", "integer")).parquet(path)
    upto = (Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_last", F.last("_right", ignorenulls=True).over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(*upto)))
    ends = both.groupBy("_pid").agg(F.max(F.when(F.col("_side") == 0, F.col("_right"))).alias("_end"))
    before = ends.select("_pid", F.last("_end", ignorenulls=True).over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row a range
    done = seen.where("_side = 1").join(F.broadcast(before), "_pid")
    found = F.coalesce("_last", F.col("_before"))
    same = F.lit(True)
    for c in by:
        same = same & (found[c] == F.col(f"_left.{c}"))
    ok = same & F.col(f"_left.{on}").isNotNull()
    return done.select("_left.*", *(F.when(ok, found["_take"][c]).alias(c) for c in take))
