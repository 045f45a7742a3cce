"""Tables between jobs: intermediate results in a folder that all executors share, and the job and cache tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "jobs": "job_id string, status string, input string, result string, error string, created_at timestamp, updated_at timestamp, seq bigint",
    "result_cache": "cache_key string, data_list string, result string, created_at timestamp, updated_at timestamp",
}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; below the warehouse
    where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir')}/lettermill-shared"
    return f"{base.rstrip('/')}/lettermill-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage, and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if it has fewer: a small file can be one row group, and so one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def create_tables(spark: SparkSession) -> None:
    """The job and cache tables, where they aren't there yet."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
