"""A keyed table of buckets: a commit rewrites the buckets it touches and swaps a manifest.

Layout below one folder::

    rows/<version>/bucket=<n>/part-…   rows of bucket n as of that version
    manifest/<version>                 for each bucket that has rows, the version that wrote them

A commit first writes the touched buckets to a folder of its own, then its manifest; the complete manifest of the highest
number is the table. Until it is there readers see the table as it was, and what a dead commit left is overwritten by the
next. Untouched buckets keep their files. A commit costs what its buckets cost, whatever the table holds. Commits follow
each other: a table has one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .writers import upsert

MANIFEST = "bucket int, version int"


class BucketedTable:
    """``keys`` are unique in the table; ``buckets`` stays what it was when the table was made (some hundred MB of rows each)."""

    def __init__(self, spark: SparkSession, base: str, keys: Sequence[str], schema: StructType, buckets: int = 64):
        self.spark, self.base, self.keys, self.schema, self.buckets = spark, base.rstrip("/"), list(keys), schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # -- reading -------------------------------------------------------------------------------------------

    def version(self) -> int:
        """Number of the newest complete manifest; -1 before the first commit."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.base}/manifest")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n) for n in names if fs.exists(hadoop.Path(f"{self.base}/manifest/{n}/_SUCCESS"))), default=-1)

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Version of each bucket that has rows: as many entries as the table has buckets, at most."""
        version = self.version() if version is None else version
        rows = self.spark.read.schema(MANIFEST).json(f"{self.base}/manifest/{version}").collect() if version >= 0 else []
        return {r["bucket"]: r["version"] for r in rows}

    def read(self, buckets: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
        """The table (or as of a version), or only the given buckets of it: files of other buckets are not opened."""
        held = self.manifest(version)
        paths = [f"{self.base}/rows/{v}/bucket={b}" for b, v in sorted(held.items()) if buckets is None or b in set(buckets)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets the rows' keys fall in."""
        return sorted(r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    # -- writing -------------------------------------------------------------------------------------------

    def upsert(self, rows: DataFrame, order: Sequence[str]) -> None:
        """Lay rows over the table by key; the last by ``order`` of each key wins. Doing it again changes no row.

        ``rows`` is read several times: pass a written frame where it is costly.
        """
        self._commit(rows, lambda held: upsert(held, rows, self.keys, list(order)))

    def append_new(self, rows: DataFrame) -> None:
        """Add the rows whose key the table does not hold, one of each key. Doing it again changes no row."""
        def added(held: DataFrame) -> DataFrame:
            return held.unionByName(rows.dropDuplicates(self.keys).join(held.select(*self.keys), self.keys, "left_anti").select(*held.columns))

        self._commit(rows, added)

    def _commit(self, rows: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        touched = self.touched(rows)
        if not touched:
            return
        version = self.version()
        held, now = self.manifest(version), version + 1
        made = change(self.read(touched, version)).select(*self.schema.names).withColumn("bucket", self.bucket())
        made.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/rows/{now}")
        listed = sorted({**held, **dict.fromkeys(touched, now)}.items())
        self.spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.base}/manifest/{now}")
