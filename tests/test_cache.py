"""The cache as a merge table, against plain upserts."""

import datetime as dt
import random


from pyspark.sql import functions as F

from lettermill.operators.cache import KEPT, ROW, MergeCache


def test_batches_read_their_buckets_alone(spark, tmp_path):
    rng, table, want, sizes, read = random.Random(1), MergeCache(spark, str(tmp_path / "c"), 8), {}, [], []
    stamp = lambda i: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i)
    for batch in range(25):
        keys = rng.sample([f"k{i}" for i in range(40)], 3)
        rows = [(k, "[]", f"{batch}-{k}" + "x" * 200, stamp(rng.randrange(100))) for k in keys]
        new = spark.createDataFrame(rows, ROW)
        touched = table.touched(new)
        sizes.append(table.bytes_of(touched, batch))
        assert table.merge(new, batch) == touched and len(touched) <= 3
        for k, _, result, at in rows:
            if k not in want or at >= want[k][1]:
                want[k] = (result, at)
        read.append(len(table.versions()))
        if batch % 5 == 4:
            table.compact()
            assert all(len(v) <= 1 + KEPT for v in table.versions().values())
    assert {r.cache_key: (r.result, r.updated_at) for r in table.read().collect()} == want
    assert max(sizes[15:]) < 3 * (1 + max(sizes[5:15]))  # as many keys as ever, and no batch reads what others wrote beside them
    again = spark.createDataFrame([("k1", "[]", "again", stamp(1000))], ROW)
    table.merge(again, 25)
    table.merge(again.withColumn("result", F.lit("run again")), 25)  # the batch that failed runs again and overwrites its own
    got = table.probe(spark.createDataFrame([("k1", False), ("k1", True), ("none", False)], "cache_key string, force_reprocess boolean"))
    assert {(r.cache_key, r.force_reprocess, r.hit, r.result) for r in got.collect()} == {("k1", False, True, "run again"), ("k1", True, False, None), ("none", False, False, None)}
    assert {r.result for r in table.read(before=25).filter("cache_key = 'k1'").collect()} == {want["k1"][0]}
