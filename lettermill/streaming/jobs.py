"""Jobs as a stream: each message once, results by cache key, failures as states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators.cache import MergeCache

MESSAGE = "job_id string, cache_key string, data_list string, file_ids array<string>, file_paths array<string>, force_reprocess boolean"


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a folder of JSON files, one file a batch."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).json(path)


def run_jobs(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], states: str, checkpoint: str, cache: str | None = None):
    """Starts a query that appends job states (job_id, cache_key, status, result, error, batch) below a path.

    work gets the messages of a batch, one for each cache_key, and returns cache_key, result and error. If
    it raises, the batch's jobs are failed with that error, and the stream goes on. With a cache folder, what has a result
    there isn't worked on (unless force_reprocess), and new results are merged in, see MergeCache. A
    batch that runs again overwrites its own folders, so each message has one outcome.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            table = MergeCache(rows.sparkSession, cache) if cache else None
            todo, hits = rows, None
            if table:
                probed = table.probe(rows, number)
                todo, hits = probed.filter("NOT hit").drop("hit", "result"), probed.filter("hit").select("job_id", "cache_key", F.lit("succeeded").alias("status"), "result", F.lit(None).cast("string").alias("error"))
            try:
                finish(table, todo, hits, number, work(todo.dropDuplicates(["cache_key"])).select("cache_key", "result", "error"))
            except Exception as e:  # noqa: BLE001  a message that can't be worked on must not come back for ever
                finish(table, todo, hits, number, todo.select("cache_key", F.lit(None).cast("string").alias("result"), F.lit(f"{type(e).__name__}: {e}"[:2000]).alias("error")).dropDuplicates(["cache_key"]))
        finally:
            rows.unpersist()

    def finish(table: MergeCache | None, todo: DataFrame, hits: DataFrame | None, number: int, done: DataFrame) -> None:
        failed = F.col("error").isNotNull() | F.col("result").isNull()
        out = todo.join(done, "cache_key", "left").select("job_id", "cache_key", F.when(failed, "failed").otherwise("succeeded").alias("status"), "result", "error")
        folder = f"{states}/batch={number}"
        (out if hits is None else out.unionByName(hits)).write.mode("overwrite").parquet(folder)
        if table:
            made = todo.sparkSession.read.parquet(folder).filter("status = 'succeeded'").join(todo.select("job_id", "data_list"), "job_id").dropDuplicates(["cache_key"])
            table.merge(made.withColumn("updated_at", F.current_timestamp()), number)
            table.compact()

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
