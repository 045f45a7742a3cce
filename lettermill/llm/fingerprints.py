"""Document fingerprints by winnowing.

The hashes of all k-grams of a text roll along as differences of one running sum modulo 2**64. Of
each window of w hashes the least is chosen, the rightmost of equals, and kept with its position; so
any two texts that share w + k - 1 characters in a row share a chosen hash.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill.llm.common import id_and_text

K = 24
WINDOW = 40
#: An odd base, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)


@functools.lru_cache(8)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all k-grams."""
    n = len(codes)
    up, down = powers(1 << max(10, n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * up[k - 1 : n]
    h ^= h >> np.uint64(32)
    h *= MIX
    return h ^ (h >> np.uint64(29))


def winnow(codes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (32 bits) and their positions, ascending; a text shorter than k is one gram."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = rolling(codes, min(k, n)) >> np.uint64(32)
    at = np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64)  # of equal hashes the rightmost is the least
    keys = (h << np.uint64(32)) | at
    width, done = min(window, len(keys)), 1
    while done < width:
        step = min(done, width - done)
        keys = np.minimum(keys[:-step], keys[step:])
        done += step
    chosen = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return chosen >> np.uint64(32), (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sets of hashes (sorted, without repeats); 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def ranges(keyed: DataFrame, n: int) -> DataFrame:
    """keyed (key, h) with bucket: n ranges of (key, h), in their order.

    Borders are quantiles of key. A key that is several of them is frequent, and its rows are cut into as many ranges by h, which
    is a hash; so of one key only rows with the same text have to stay together.
    """
    borders = sorted(keyed.stat.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n)) if n > 1 else []
    if not borders:
        return keyed.withColumn("bucket", F.lit(0))
    values = sorted(set(borders))
    times = [0, *(borders.count(v) for v in values)]
    before = [0, *np.cumsum(times)[:-1].tolist()]
    found = Bucketizer(splits=[-float("inf"), *values, float("inf")], inputCol="at", outputCol="b").transform(keyed.withColumn("at", F.col("key").cast("double")))
    of = lambda x: F.get(F.array(*[F.lit(v) for v in x]), F.col("b").cast("int"))
    share = F.col("h").cast("double") / 2.0**64 + 0.5  # 0 to 1, ascending with h
    slot = F.least(F.floor(share * (of(times) + 1)).cast("int"), of(times))
    return found.withColumn("bucket", of(before) + F.when(F.col("at") == of([None, *values]).cast("double"), slot).otherwise(of(times))).drop("at", "b")


def with_next(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id and text, dealt by ranges of doc_id and sorted by (doc_id, text's hash, text) in each partition, where
    each partition also holds the rows that follow its last one (copy = true).

    The first row's key of each range, and no more, goes through the driver.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumns({"key": F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), "h": F.xxhash64("text")})  # null ids come first
    dealt = ranges(keyed, n)
    firsts = sorted((r["bucket"], *r["first"]) for r in dealt.groupBy("bucket").agg(F.min(F.struct("key", "h")).alias("first")).collect())  # a row for each range
    before = [(key, h, firsts[i - 1][0], i == 0) for i, (_, key, h) in enumerate(firsts)]  # the first of all follows the last
    to = spark.createDataFrame(before, "key long, h long, to int, wraps boolean")
    joined = dealt.join(F.broadcast(to), ["key", "h"], "left")
    own = F.struct(F.col("bucket"), F.lit(False).alias("copy"), F.lit(False).alias("wraps"))
    other = F.struct(F.col("to").alias("bucket"), F.lit(True).alias("copy"), F.col("wraps"))
    out = joined.withColumn("place", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, other)))).select("place.*", "key", "h", "doc_id", "text")
    return out.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "copy", "wraps", "key", "h", "text").select("bucket", "copy", "doc_id", "text")


SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType())]
    + [T.StructField(x, T.StringType()) for x in ("fingerprint", "edited_fingerprint")]
    + [T.StructField(x, T.DoubleType()) for x in ("near_edited", "near_next")]
    + [T.StructField("positions", T.ArrayType(T.IntegerType()))]
)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """A row for each document, with its fingerprint, that of its edited text, and likenesses.

    A fingerprint is the ascending set of chosen hashes, 8 hex digits each; positions are where the
    hashes were chosen (in text order). The edited text has the last quarter of the code points
    replaced by the first as many of the next document in doc_id order (equal ids by their texts' hashes); the first follows the
    last, and a single document follows itself. A null text is empty and has an empty fingerprint; a
    null doc_id comes first; repeated rows follow each other; an empty table gives no rows. Only
    doc_id and text are read, so other columns can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(doc: int | None, text: str, after: str) -> tuple:
            own, other = of(text), of(after)
            n = len(text)
            edited = text[: n - n // 4] + after[: n // 4]
            hashes, positions, mine = own
            changed = np.unique(winnow(codes_of(edited), k, window)[0])
            return doc, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(mine), as_text(changed), likeness(mine, changed), likeness(mine, other[2]), positions.tolist()

        @functools.lru_cache(2)
        def of(text: str) -> tuple:
            hashes, positions = winnow(codes_of(text), k, window)
            return hashes, positions, np.unique(hashes)

        def flush(out: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=SCHEMA.names)

        last, out, size = None, [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("bucket", "copy", "doc_id", "text")]
            for values in zip(*columns, strict=True):
                bucket, copy, doc, text = (v.as_py() for v in values)
                if last is not None and last[0] == bucket:
                    out.append(row(last[1], last[2], text))
                    size += len(text)
                last = None if copy else (bucket, doc, text)
                if size > 4 << 20:
                    yield flush(out)
                    out, size = [], 0
        if out:
            yield flush(out)

    return with_next(id_and_text(docs)).mapInArrow(run, SCHEMA)
