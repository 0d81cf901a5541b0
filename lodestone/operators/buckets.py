"""Tables in buckets of their key: a change reads and writes the buckets that it touches, not the table.

A bucket is a partition (a folder) of Parquet files, named by the hash of the key. What a delta replaces is joined with its own
buckets only, and these alone are written anew, by dynamic partition overwrite. So the cost of a small delta is that of its
buckets; one that touches all of them rewrites the table, as any upsert would.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import InvalidRequest

BUCKETS = 256


@dataclass(frozen=True)
class BucketTable:
    """A table at ``path`` whose rows are found by ``key`` and lie in the bucket of ``by``, some or all of its columns.

    One writer at a time: buckets are replaced one by one when a write commits, and a write that was cut short is run again.
    """

    spark: SparkSession
    path: str
    key: Sequence[str]
    by: Sequence[str] | None = None
    buckets: int = BUCKETS

    def __post_init__(self):
        if self.by is not None and not set(self.by) <= set(self.key):
            raise InvalidRequest("a table's buckets follow columns of its key")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(self.by or self.key)), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, mode: str) -> None:
        # A frequent key (one name in every source) is dealt to several tasks and files of its bucket.
        dealt = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64(*self.key), F.lit(4)))
        dealt.sortWithinPartitions("bucket", *self.key).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def create(self, rows: DataFrame) -> BucketTable:
        """Writes ``rows`` as the whole table."""
        self._write(rows.withColumn("bucket", self._bucket()), "errorifexists")
        return self

    def touched(self, *deltas: DataFrame) -> list[int]:
        """The buckets of the keys of ``deltas``: at most as many numbers as there are buckets."""
        found: set[int] = set()
        for d in deltas:
            found |= {r["bucket"] for r in d.select(self._bucket()).distinct().collect()}
        return sorted(found)

    def all(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def near(self, delta: DataFrame) -> DataFrame:
        """The rows of all buckets that ``delta`` touches: what a join with it can need."""
        return self._of(self.touched(delta)).drop("bucket")

    def _of(self, buckets: list[int]) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))

    def replace(self, keys: DataFrame, rows: DataFrame) -> list[int]:
        """Rows of ``keys`` (distinct or not) go and ``rows`` come; returns the buckets that were written anew."""
        touched = self.touched(keys, rows)
        if not touched:
            return []
        old = self._of(touched)
        gone = keys.select(*self.key).distinct()
        left = old.join(gone, list(self.key), "left_anti").select(*old.columns)
        before = {b: self._files(b) for b in touched}
        self._write(left.unionByName(rows.withColumn("bucket", self._bucket()).select(*old.columns)), "overwrite")
        for b in touched:  # nothing was written for a bucket that is empty now, so it still has what it had
            if before[b] and before[b] == self._files(b):
                at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}")
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return touched

    def _files(self, bucket: int) -> set[str]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return {s.getPath().getName() for s in fs.listStatus(at)} if fs.exists(at) else set()
