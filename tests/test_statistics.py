"""Sketches of batches, merged, against exact statistics."""

import random

from pyspark.sql import functions as F

from lettermill.operators import statistics


def test_batches_merge_into_grouping_sets(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10), rng.choice(["a", "b", None]), rng.choice(["x", "y"]), f"t{rng.randrange(4000)}", rng.randrange(10_000)) for _ in range(30_000)] + [(0, "few", "x", None, None), (1, "few", "x", "one", 7)]
    d = spark.createDataFrame(rows, "batch int, lang string, source string, text string, length long")
    kept = None
    for batch in range(10):  # each batch alone, as a stream would keep them
        one = statistics.sketches(d.filter(F.col("batch") == batch), ["lang", "source"], F.col("text"), F.col("length"))
        kept = one if kept is None else kept.unionByName(one)
    got = {(r.level, r.lang, r.source): r for r in statistics.merged(kept, [["lang", "source"], ["lang"], []], (0.1, 0.5, 0.9)).collect()}
    groups = {}
    for _, lang, source, text, length in rows:
        for key in ((0, lang, source), (1, lang, None), (2, None, None)):
            groups.setdefault(key, []).append((text, length))
    assert set(got) == set(groups)
    for key, own in groups.items():
        kinds, lengths = len({t for t, _ in own if t is not None}), sorted(x for _, x in own if x is not None)
        assert got[key].n == len(own) and abs(got[key].distinct - kinds) <= max(1, 3 * 1.04 / 64 * kinds)
        for q, x in ((0.1, got[key].q10), (0.5, got[key].q50), (0.9, got[key].q90)):
            below, upto = sum(v < x for v in lengths) / len(lengths), sum(v <= x for v in lengths) / len(lengths)
            assert below - 0.03 <= q <= upto + 0.03
    assert statistics.merged(kept.limit(0), [["lang"]]).count() == 0
