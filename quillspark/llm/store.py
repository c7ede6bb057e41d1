"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost executor loses no finished step.
The setting is read from the session and is set here only when it is unset (local tests).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

DEFAULT_DIR = "/tmp/checkpoints"
SALTS = 16
#: Rows of a table that may be broadcast: at 300 bytes a row at most 15 MB.
BROADCAST_ROWS = 50_000

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = DEFAULT_DIR
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """Tables of one run of an operator; ``drop`` frees those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _written.append(self.root)

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{tag}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quill_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if getattr(t, "_quill_path", None):
                _delete(self.spark, t._quill_path)

    def free_shuffles(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of steps that are written already."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Deletes every table written so far; for callers who have written their results elsewhere."""
    while _written:
        _delete(spark, _written.pop())


def saved(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read again; ``release`` leaves it."""
    tables = Tables(spark, name)
    _written.remove(tables.root)
    return tables.save(df, "rows")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def arrow_rows(spark: SparkSession, rows: int = 500) -> None:
    """Bounds the rows of an Arrow batch, so that a Python worker holds few whole texts at a time."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def join_small(big: DataFrame, small: DataFrame, on: list[str], salt_by: str, how: str = "inner") -> DataFrame:
    """Joins a written table of groups. It is counted first: up to BROADCAST_ROWS it is broadcast,
    beyond that both sides are dealt by the key and a salt, so that no hot group meets in one task."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    if how in ("left_semi", "left_anti"):
        return big.join(small, on, how)  # a written side of keys only: Spark deals it by size, and splits hot keys
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"], how).drop("_salt")


def running_sum(tables: Tables, df: DataFrame, order: list, values: dict[str, str], tag: str) -> DataFrame:
    """Exclusive running sums (``values``: column to name of its sum) in the order of ``order`` without gathering all
    rows in one task: ranges of the order are summed apart, then the (one row a range) totals are added up and joined."""
    from pyspark.sql import Window

    n = partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id())
    upto = (Window.unboundedPreceding, Window.currentRow)
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(*upto)
    local = tables.save(ranged.withColumns({f"_run_{v}": F.sum(v).over(w) - F.col(v) for v in values}), f"{tag}-ranges")
    totals = local.groupBy("_pid").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    # One row a range, so this window's size is the number of shuffle partitions.
    all_ = Window.orderBy("_pid").rowsBetween(*upto)
    starts = totals.select("_pid", *((F.sum(f"_t_{v}").over(all_) - F.col(f"_t_{v}")).alias(f"_start_{v}") for v in values))
    done = local.join(F.broadcast(starts), "_pid")
    for v, out in values.items():
        done = done.withColumn(out, F.col(f"_run_{v}") + F.col(f"_start_{v}")).drop(f"_run_{v}", f"_start_{v}")
    return done.drop("_pid")
