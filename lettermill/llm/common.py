"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.sources.tables import shared_dir, spread, written

__all__ = ["id_and_text", "shared_dir", "slices", "small_batches", "table", "utf8_length", "worker_state", "written"]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB: a task holds one each way in the JVM and one in Python, besides the operator's own data."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns of docs can't clash; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


_state: dict[object, object] = {}


def worker_state(key: object, make: Callable[[], object]):
    """What a Python worker keeps from task to task: of one operator at a time, so that memory doesn't add up over stages."""
    if key not in _state:
        _state.clear()
        _state[key] = make()
    return _state[key]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column of strings has about most_bytes in each, whatever the length of its rows."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < n:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most_bytes, "right")))
            yield batch.slice(start, end - start)
            start = end


def utf8_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")
