"""Exact top-k inner products by columnar branch-and-bound.

Vectors lie in blocks, column by column. For a block of queries and one of candidates the scores
add up a few dimensions at a time. After each step the k-th best of what is certain (score so far
minus the most that is left) is a threshold, and candidates whose score so far plus the most that is
left (product of the remaining norms) is below it leave the block. Blocks of candidates and of queries
meet in a grid with a cell for each shuffle partition: a candidate block goes to the cells of its row, a query block
to those of its column, and there are so many more rows than columns as candidates are more than queries. So neither side is copied to
every partition (Spark broadcasts blocks of queries only if they are small), and a task holds one block of either side at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import written

#: Vectors in a block of candidates and in one of queries.
CANDIDATES = 8192
QUERIES = 1024
#: Dimensions that are added at a time.
STEP = 16


def quantized(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as exact numbers, in the narrowest type in which all inner products are exact."""
    x = np.floor(values.astype(np.float64) * scale)
    most, dims = float(np.abs(x).max(initial=0)), x.shape[1] if x.ndim == 2 else 1
    if most < 2**15 and most * most * dims < 2**24:
        return x.astype(np.float32)
    if most * most * dims < 2**53:
        return x
    return np.array([[int(y) for y in row] for row in x], object).reshape(x.shape)


def branch_and_bound(queries: np.ndarray, columns: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the scores and ids of its k best candidates (ties to the smaller id), its own row apart.

    columns has a row for each dimension; own is the id of each query.
    """
    if object in (queries.dtype, columns.dtype):
        queries, columns = queries.astype(object), columns.astype(object)
    elif queries.dtype != columns.dtype:
        queries, columns = queries.astype(np.float64), columns.astype(np.float64)
    dims = columns.shape[0]
    steps = list(range(0, dims, STEP)) or [0]
    exact = columns.dtype == object
    left = lambda x, at: np.sqrt((x[at:].astype(np.float64) ** 2).sum(0)) * (1 + 1e-6) + 1e-3  # noqa: E731  a bit more, for rounding
    rest_c = [left(columns, s + STEP) for s in steps]
    rest_q = [left(queries.T, s + STEP) for s in steps]
    first = queries[:, :STEP] @ columns[:STEP]
    out = []
    for i in range(len(queries)):
        alive = np.flatnonzero(ids != own[i])
        score = first[i, alive]
        for n, s in enumerate(steps):
            if n:
                score = score + queries[i, s : s + STEP] @ columns[s : s + STEP, alive]
            if s + STEP >= dims:
                break
            if not exact and len(alive) > k:
                slack = rest_q[n][i] * rest_c[n][alive]
                sure = np.partition(score - slack, len(alive) - k)[len(alive) - k]
                keep = score + slack >= sure
                if not keep.all():
                    alive, score = alive[keep], score[keep]
        if len(alive) > k and not exact:
            bar = np.partition(score, len(alive) - k)[len(alive) - k]
            alive, score = alive[score >= bar], score[score >= bar]
        order = sorted(range(len(alive)), key=lambda j: (-score[j], ids[alive[j]]))[:k]
        out.append((np.array([int(score[j]) for j in order], object), ids[alive[order]] if order else ids[:0]))
    return out


def blocks(vectors: DataFrame, size: int, query: bool) -> DataFrame:
    """Rows (dims, n, ids, values): blocks of vectors of one dimension each, values as doubles row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, list[tuple[int, bytes]]] = {}

        def flush(dims: int) -> pa.RecordBatch:
            rows = open_blocks.pop(dims)
            ids = np.array([x for x, _ in rows], np.int64).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([ids], pa.binary()), pa.array([b"".join(v for _, v in rows)], pa.binary())], names=["dims", "n", "ids", "values"])

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    open_blocks.setdefault(len(x), []).append((i, x.tobytes()))
                    if len(open_blocks[len(x)]) == size:
                        yield flush(len(x))
        for dims in list(open_blocks):
            yield flush(dims)

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    if query:
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))  # NaN would be the greatest
        rows = rows.filter((F.col("vec_id") % 50 == 0) & finite).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    return rows.mapInArrow(run, "dims int, n int, ids binary, values binary")


def top_k(vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id and score: the k best integer inner products of each query.

    Components become floor(scale * x). Queries are the rows whose vec_id is divisible by 50,
    candidates all rows but the query's own; ties go to the smaller vec_id. Vectors that are null or
    hold null or non-finite components, or whose vec_id is null, take no part; vectors are compared
    with those of the same dimension only. Repeated candidates count as often as they occur; of
    repeated queries the greatest valid vector is one, and rows with a query's id are its own. Scores beyond 64 bits are shown as the
    largest or smallest that fit (and are ordered exactly). An empty table gives no rows. Only vec_id and embedding are read.
    """
    if every != 50:
        raise ValueError("queries are the rows whose id is divisible by 50")
    both = written(blocks(vectors, CANDIDATES, False).withColumn("side", F.lit(0)).unionByName(blocks(vectors, QUERIES, True).withColumn("side", F.lit(1))))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = max(1, math.isqrt(n // every))
    lots = n // columns
    dealt = lambda k, *c: F.pmod(F.xxhash64(*c), F.lit(k)).cast("int")
    across = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: F.col("lot") * columns + c)
    down = F.transform(F.sequence(F.lit(0), F.lit(lots - 1)), lambda lot: lot * columns + F.col("column"))
    candidates = both.filter("side = 0").withColumn("lot", dealt(lots, "ids", "values")).select("dims", F.explode(across).alias("cell"), "ids", "values").repartitionById(n, F.col("cell"))
    queries = both.filter("side = 1").withColumn("column", dealt(columns, "ids")).select("dims", F.explode(down).alias("cell"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values")).repartitionById(n, F.col("cell"))
    met = queries.join(candidates, ["dims", "cell"])  # the queries stream past the cell's candidates, which are a shuffle partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, own = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                dims = r["dims"]
                c = quantized(np.frombuffer(r["values"], np.float64).reshape(len(ids), dims), scale)
                q = quantized(np.frombuffer(r["q_values"], np.float64).reshape(len(own), dims), scale)
                found = branch_and_bound(q, np.ascontiguousarray(c.T), ids, own, k)
                most = (1 << 63) - 1
                columns = [[o for o, (s, _) in zip(own.tolist(), found, strict=True) for _ in s], [v for _, v in found for v in v.tolist()], [max(-most, min(most, x)) for s, _ in found for x in s]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])

    best = met.mapInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
