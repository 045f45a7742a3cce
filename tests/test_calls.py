"""Calls of services: limits, order, retries; groups of letters with many units."""

import asyncio
import threading
import time

import pytest
from pyspark.sql import functions as F

from lettermill.functions import calls
from lettermill.operators import modelled, units
from lettermill.sources import files


class Gauge:
    """How many are inside at once, at most."""

    def __init__(self):
        self.lock, self.now, self.most = threading.Lock(), 0, 0

    def __enter__(self):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)

    def __exit__(self, *_):
        with self.lock:
            self.now -= 1


@pytest.mark.parametrize("plain", [True, False])
def test_limit_and_order(plain):
    gauge = Gauge()

    def slow(x):
        with gauge:
            time.sleep(0.05 if x % 3 else 0.001)
        return x * 2

    async def slow_too(x):
        with gauge:
            await asyncio.sleep(0.05 if x % 3 else 0.001)
        return x * 2

    read = []
    questions = (read.append(i) or i for i in range(24))
    start, got = time.time(), []
    for q, answer, error in calls.in_order(questions, lambda pool, x: calls.once(slow if plain else slow_too, pool, x), 6):
        got.append((q, answer, error))
        assert len(read) <= len(got) + 6  # no reading ahead
    assert got == [(i, 2 * i, None) for i in range(24)] and 2 <= gauge.most <= 6 and time.time() - start < 0.9
    with pytest.raises(ValueError):
        next(calls.in_order([1], None, 0))


def test_retries_and_waits_dont_hold_others_up():
    tried = {}

    async def service(x):
        tried[x] = tried.get(x, 0) + 1
        if x == 0 and tried[x] < 4:
            return 503, ""
        if x == 1:
            return 400, ""
        if x == 2:
            raise ConnectionError("down")
        return 200, f"body {x}"

    waits = []

    async def sleep(s):
        waits.append(s)
        await asyncio.sleep(0.02)

    got = list(calls.in_order(range(5), lambda pool, x: calls.retried(service, pool, x, tries=4, base=1.0, jitter=0.0, sleep=sleep), 5))
    assert [(q, a) for q, a, _ in got] == [(0, "body 0"), (1, None), (2, None), (3, "body 3"), (4, "body 4")]
    assert got[1][2] == "Rejected: HTTP 400" and got[2][2] == "ConnectionError: down" and tried == {0: 4, 1: 1, 2: 4, 3: 1, 4: 1}
    assert sorted(waits) == [1.0, 1.0, 2.0, 2.0, 4.0, 4.0]


def test_limit_over_tasks(spark):
    assert [calls.tasks_for(*x) for x in ((None, 4), (4, 4), (10, 4), (1, 1))] == [None, 1, 2, 1]
    with pytest.raises(ValueError):
        calls.tasks_for(3, 4)

    async def ocr(content):
        await asyncio.sleep(0.01)
        return (200, f"{bytes(content).decode()}\\nx") if content != b"7" else (400, "")

    rows = spark.createDataFrame([(str(i), bytearray(str(i).encode())) for i in range(20)], "path string, content binary")
    got = files.recognised(rows, ocr, most=8, in_flight=4)
    assert got.rdd.getNumPartitions() == 2
    assert {r.path: r.text for r in got.collect()} == {str(i): None if i == 7 else f"{i}\nx" for i in range(20)}

    async def model(label, prompt, hint):
        return '[["U1"]]' if label == "KN" else '[["U2"]]'

    docs = spark.createDataFrame([(i, f"Hỏi {i}.\nTrả lời {i}.") for i in range(6)], "doc_id long, text string")
    assert {r.doc_id: (r.kien_nghi, r.tra_loi) for r in modelled.extract(docs, model, most=4).collect()} == {i: ([f"Hỏi {i}."], [f"Trả lời {i}."]) for i in range(6)}


def test_ten_thousand_units_in_a_letter(spark):
    """A surplus of 4,999 groups merges unless another group's unit lies between; the work is one pass over the letter's units."""
    n = 10_000
    kn = lambda d, ids: [(d, "KN", i, [f"U{u}"], u, u) for i, u in enumerate(ids)]
    rows = kn(1, range(1, n // 2 + 1)) + [(1, "TL", 0, [f"U{n}"], n, n)] + kn(2, [u for u in range(1, n) if u != 5000]) + [(2, "TL", 0, ["U5000"], 5000, 5000)]
    groups = spark.createDataFrame(rows, "doc_id long, label string, group_ord int, unit_ids array<string>, first int, last int")
    start = time.time()
    got = {(r.doc_id, r.label): (r.warning, r.n, r.groups) for r in units.balance_groups(groups).groupBy("doc_id", "label", "warning").agg(F.sum(F.size("unit_ids")).alias("n"), F.count(F.lit(1)).alias("groups")).collect()}
    assert got == {(1, "KN"): ("CAN_BANG", n // 2, 1), (1, "TL"): ("CAN_BANG", 1, 1), (2, "KN"): ("MISMATCH", n - 2, n - 2), (2, "TL"): ("MISMATCH", 1, 1)}
    assert time.time() - start < 60
