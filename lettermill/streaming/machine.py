"""Job states in the state store: one row of state a job, an aggregate of Spark's; jobs that stall are told by a table of those that haven't ended."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators import store

EVENT = "job_id string, status string, result string, error string, updated_at timestamp, seq long"
CHANGE = EVENT
OPEN = "job_id string, updated_at timestamp, seq long"
ENDED = ("succeeded", "failed")
#: States of many jobs don't fit the memory of the default state store.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def job_changes(events: DataFrame) -> DataFrame:
    """A stream's EVENT rows (job_id, updated_at and seq not null) by job: the latest message, by (updated_at, seq), of each job of which a batch has messages.

    Older and repeated messages change nothing; then the state as it was comes again. Late messages are in here, see run_machine().
    """
    events.sparkSession.conf.set(*PROVIDER)
    message = F.struct("updated_at", F.col("seq").cast("long").alias("seq"), "status", "result", "error")
    return events.groupBy("job_id").agg(F.max(message).alias("m")).select("job_id", *[f"m.{c.split()[0]}" for c in CHANGE.split(", ")[1:]])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run_machine(events: DataFrame, states: str, checkpoint: str, late: str = "10 minutes", stall: int = 3_600_000):
    """Starts a query that writes the states that each batch has touched below a path; a batch that runs again overwrites its own folders.

    Messages that event time had passed by more than late before their batch are dropped. A job that hasn't ended is failed when event time (less late)
    passes its last message by stall milliseconds; a later message takes it up again. The aggregate keeps late messages too,
    but no message that comes after one is older and counts, so that it is enough to drop them behind it.
    """
    lag, kept = pd.Timedelta(late) // pd.Timedelta(milliseconds=1), f"{checkpoint}/machine"
    at: Column = F.unix_millis("updated_at")

    def batch(rows: DataFrame, number: int) -> None:
        spark, here, before = rows.sparkSession, f"{kept}/{number}", f"{kept}/{number - 1}"
        rows.write.mode("overwrite").parquet(f"{here}/rows")  # read for event time, states and what is open
        fresh = spark.read.schema(CHANGE).parquet(f"{here}/rows")
        seen = spark.read.parquet(f"{before}/newest").first()["newest"] if number else None  # one number
        newest = max((x for x in (seen, fresh.agg(F.max(at)).first()[0]) if x is not None), default=None)
        if seen is not None:
            fresh = fresh.filter(at >= seen - lag)
        names = [c.split()[0] for c in OPEN.split(", ")]
        waiting = fresh.filter(~F.coalesce("status", F.lit("")).isin(*ENDED)).select(*names)
        if number:
            waiting = waiting.unionByName(spark.read.schema(OPEN).parquet(f"{before}/open").join(fresh.select("job_id"), "job_id", "left_anti"))
        due = F.lit(False) if newest is None else at + stall <= newest - lag
        none = F.lit(None).cast("string")
        stalled = waiting.filter(due).select("job_id", F.lit("failed").alias("status"), none.alias("result"), F.lit("stalled").alias("error"), "updated_at", "seq")
        fresh.unionByName(stalled).write.mode("overwrite").parquet(f"{states}/batch={number}")
        waiting.filter(~due).write.mode("overwrite").parquet(f"{here}/open")
        spark.createDataFrame([(newest,)], "newest long").write.mode("overwrite").parquet(f"{here}/newest")
        _delete(spark, f"{kept}/{number - 2}")  # the batch before may be needed again

    return job_changes(events).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_states(changes: DataFrame) -> DataFrame:
    """The state of each job now, from what run_machine() has written: as store.job_states() says it."""
    ordered = changes.withColumn("seq", F.col("seq") * 2 + F.when(F.col("error") == "stalled", 1).otherwise(0))  # a stalled job has its last message's stamp
    return store.job_states(ordered.drop("batch")).withColumn("seq", F.floor(F.col("seq") / 2).cast("long"))
