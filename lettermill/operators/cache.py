"""A result cache as a merge table: buckets by the key's hash, each batch reads and rewrites the buckets that it touches.

A bucket has a folder for each batch that changed it, with all of its rows; the newest one before a batch is what that batch reads. A
batch that runs again finds the same folders and overwrites its own. Compaction drops folders that a newer one has replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators import store

ROW = "cache_key string, data_list string, result string, updated_at timestamp"
BUCKETS = 64
#: Replaced folders of a bucket that stay, for readers that have begun and batches that run again.
KEPT = 2


class MergeCache:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def versions(self) -> dict[int, list[int]]:
        """The batches that wrote each bucket, ascending: names of folders alone, at most (1 + KEPT) * buckets of them after a compaction."""
        found: dict[int, list[int]] = {}
        for status in self.fs.globStatus(self.root.suffix("/bucket=*/batch=*/_SUCCESS")) or []:
            folder = status.getPath().getParent()
            found.setdefault(int(folder.getParent().getName().split("=")[1]), []).append(int(folder.getName().split("=")[1]))
        return {b: sorted(v) for b, v in found.items()}

    def read(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The rows (ROW) of some buckets (all, if none are given) as they were before a batch (now, if none is given)."""
        newest = {b: [v for v in vs if before is None or v < before] for b, vs in self.versions().items() if buckets is None or b in buckets}
        paths = [f"{self.path}/bucket={b}/batch={vs[-1]}" for b, vs in newest.items() if vs]
        return self.spark.read.schema(ROW).parquet(*paths) if paths else self.spark.createDataFrame([], ROW)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of keys (cache_key): at most as many numbers as there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col("cache_key"))).distinct().collect())

    def probe(self, requests: DataFrame, before: int | None = None) -> DataFrame:
        """requests with hit and result, as store.probe() gives them, from the buckets of their keys alone."""
        return store.probe(requests, self.read(self.touched(requests), before))

    def merge(self, new: DataFrame, batch: int) -> list[int]:
        """Upserts rows (ROW) as a batch: of a key the later stamp wins, of equals the new row. Returns the buckets that it rewrote."""
        touched = self.touched(new)
        names = [x.split()[0] for x in ROW.split(", ")]
        once = store.latest(new.select(*names), ["cache_key"], ["updated_at"])
        rows = store.upsert(self.read(touched, batch).select(*names), once.select(*names)).select(*names)
        dealt = rows.withColumn("bucket", self.bucket(F.col("cache_key"))).repartition(max(1, len(touched)), "bucket").cache()
        try:
            for b in touched:  # a folder is there when its _SUCCESS is
                dealt.filter(F.col("bucket") == b).drop("bucket").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/bucket={b}/batch={batch}")
        finally:
            dealt.unpersist()
        return touched

    def compact(self) -> int:
        """Drops folders that newer ones have replaced, but for the last KEPT of a bucket; their number."""
        gone = [(b, v) for b, vs in self.versions().items() for v in vs[: -1 - KEPT]]
        for b, v in gone:
            self.fs.delete(self.root.suffix(f"/bucket={b}/batch={v}"), True)
        return len(gone)

    def bytes_of(self, buckets: list[int], before: int | None = None) -> int:
        """Bytes that read() of the buckets reads."""
        paths = [f"/bucket={b}/batch={[v for v in vs if before is None or v < before][-1]}" for b, vs in self.versions().items() if b in buckets and any(before is None or v < before for v in vs)]
        return sum(self.fs.getContentSummary(self.root.suffix(p)).getLength() for p in paths)
