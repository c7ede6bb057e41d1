"""Tables that are written once, clustered by a key, and then probed: only the folders and row groups of the asked keys
are opened.

Layout: ``<root>/segment=<name>/bucket=<crc32(key) mod buckets>/part-*.parquet``, sorted by key within files of small row groups, and
``<root>/_commits/<name>`` for every segment that is complete. A segment without its commit is never read, so a
write that died leaves nothing behind but files to sweep; new rows come as new segments beside the old.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group, so that a key's rows can be read without the rest of its file.
ROW_GROUP = 1 << 20


class Files:
    """Folders of any store that Spark knows."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def mark(self, path: str) -> None:
        """An empty file; the store makes it appear at once or not at all."""
        p, fs = self._at(path)
        fs.create(p, True).close()

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def state(self, path: str) -> str:
        """A digest of the names, sizes and times of a file, or of the files of a folder."""
        p, fs = self._at(path)
        seen = sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in (fs.listStatus(p) if fs.getFileStatus(p).isDirectory() else [fs.getFileStatus(p)]))
        return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:16]


class KeyedTable:
    """Rows by key, in segments and buckets."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 16):
        self.spark, self.root, self.key, self.buckets, self.files = spark, root.rstrip("/"), key, buckets, Files(spark)

    def segments(self) -> list[str]:
        return self.files.names(f"{self.root}/_commits")

    def bucket(self, key: str | Column) -> Column | int:
        return zlib.crc32(key.encode()) % self.buckets if isinstance(key, str) else F.crc32(F.encode(key, "UTF-8")) % self.buckets

    def write(self, rows: DataFrame, segment: str, order: Iterable[str] = (), ranged: bool = False) -> None:
        """Adds a segment. ``ranged``: the rows are dealt by range of bucket, key and ``order`` already, so that a key of any
        size spreads over as many files as it needs."""
        if segment in self.segments():
            raise ValueError(f"segment {segment} is there already")
        self.files.delete(f"{self.root}/segment={segment}")
        if "bucket" not in rows.columns:
            rows = rows.withColumn("bucket", self.bucket(F.col(self.key)))
        keys = ["bucket", self.key, *order]
        dealt = rows if ranged else rows.repartitionByRange(*keys)
        dealt.sortWithinPartitions(*keys).write.option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(f"{self.root}/segment={segment}")
        self.files.mark(f"{self.root}/_commits/{segment}")

    def read(self, keys: list[str] | None = None, segments: list[str] | None = None) -> DataFrame | None:
        """Rows of some keys (None: all); only their buckets' folders are opened, and the key reaches the scan. None
        where no folder has any."""
        names = [f"{self.root}/segment={s}" for s in (self.segments() if segments is None else segments)]
        if keys is not None:
            names = [f"{n}/bucket={b}" for n in names for b in sorted({self.bucket(k) for k in keys})]
        paths = [n for n in names if self.files.exists(n)]
        if not paths:
            return None
        rows = self.spark.read.option("basePath", self.root).parquet(*paths)
        return rows if keys is None else rows.where(F.col(self.key).isin(*keys))
