"""Event-time windows over a stream: sliding ones and sessions, with a watermark behind which late rows are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators import store
from lettermill.sources.tables import shared_dir


def _timed(events: DataFrame, late: str) -> DataFrame:
    """events with a watermark; times without a zone are the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def sliding_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    """begin, event_type and n of events (ts, event_type) in windows of a size, one of which begins at every slide."""
    seen = _timed(events, late).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return seen.select(F.col("w.start").alias("begin"), "event_type", "n")


def session_counts(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """user_id, begin, end and n of sessions: events (ts, user_id) of a user that are at most a gap apart."""
    seen = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return seen.select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def run_windows(windows: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Starts a query that writes windows below a path as Parquet, in folders of their batches; append: each once, when the watermark has passed it."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return windows.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_of(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A table of Parquet, a folder or a single file, as a stream, so many files a batch."""
    schema = spark.read.parquet(path).schema
    found = f"{path[:-1]}[{path[-1]}]"  # as a pattern: Spark takes a plain path for a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(found)


def latest_windows(spark: SparkSession, windows: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """A stream's windows as they stand when all that is there has been read, closed or not: the last state of each (by keys), or with
    mode complete, which sessions need, those of the last batch."""
    out, checkpoint = shared_dir(spark), shared_dir(spark)
    run_windows(windows, out, checkpoint, mode).awaitTermination()
    rows = spark.read.schema(windows.schema.add("batch", "long")).option("basePath", out).parquet(out)
    if mode == "complete":
        last = F.broadcast(rows.agg(F.max("batch").alias("batch")))  # one row
        return rows.join(last, "batch").drop("batch")
    return store.latest(rows, keys, ["batch"]).drop("batch")
