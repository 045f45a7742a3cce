"""The job machine and windows over streams of files, one file a batch, against the batch versions."""

import datetime as dt
import json
import os
import random
import time

from pyspark.sql import functions as F

from lettermill.operators import store, units
from lettermill.streaming import machine, windows

DAY = dt.datetime(2026, 1, 1)


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


class Feed:
    """A folder to which a test adds files of JSON lines, and the query that reads it."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        (folder / "in").mkdir(parents=True)

    def add(self, rows):
        self.n += 1
        names = [x.split()[0] for x in self.schema.split(", ")]
        text = "\n".join(json.dumps({k: v.isoformat() if isinstance(v, dt.datetime) else v for k, v in zip(names, r, strict=True)}) for r in rows)
        path = self.folder / "in" / f"{self.n:04}.json"
        path.write_text(text)
        os.utime(path, (1_700_000_000 + self.n, 1_700_000_000 + self.n))  # files are taken in the order of their times

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.folder / "in"))

    def out(self):
        return self.spark.read.parquet(str(self.folder / "out"))


def machine_run(feed, **options):
    machine.run_machine(feed.stream(), str(feed.folder / "out"), str(feed.folder / "ckpt"), **options).awaitTermination()
    return machine.current_states(feed.out())


def test_machine_restarts_and_equals_job_states(spark, tmp_path):
    rng, feed, sent = random.Random(1), Feed(spark, tmp_path, machine.EVENT), []
    for batch in range(3):  # each batch is a run of its own, from the checkpoint
        rows = [(f"j{rng.randrange(12)}", rng.choice(["queued", "processing", "succeeded", "failed"]), f"r{batch}-{i}", None, at(rng.randrange(50)), batch * 100 + i) for i in range(25)]
        rows += rng.choices(sent, k=5) if sent else []  # repeated messages
        sent += rows
        feed.add(rows)
        got = machine_run(feed, late="2 hours", stall=10**12)
        want = store.job_states(spark.createDataFrame(sent, machine.EVENT))
        key = lambda d: sorted(tuple(r) for r in d.select("job_id", "status", "result", "updated_at", "seq", "api_status").collect())
        assert key(got) == key(want)


def test_machine_stalls_and_drops_late_messages(spark, tmp_path):
    feed = Feed(spark, tmp_path, machine.EVENT)
    feed.add([("a", "processing", None, None, at(0), 1), ("b", "processing", None, None, at(0), 2), ("c", "succeeded", "ok", None, at(0), 3)])
    feed.add([("b", "processing", None, None, at(40), 4), ("d", "queued", None, None, at(80), 5)])  # by now an hour has passed a's message, not b's last
    feed.add([("d", "succeeded", "done", None, at(81), 6), ("e", "queued", None, None, at(30), 7)])  # e is late by more than ten minutes
    states = {r.job_id: (r.api_status, r.error, r.result) for r in machine_run(feed, late="10 minutes", stall=3_600_000).collect()}
    assert states == {"a": ("FAILED", "stalled", None), "b": ("PROCESSING", None, None), "c": ("FINISHED", None, "ok"), "d": ("FINISHED", None, "done")}
    feed.add([("a", "succeeded", "late but newer", None, at(82), 8), ("b", "failed", None, "x", at(10), 9)])  # a goes on; b's is dropped, and older anyway
    feed.add([("f", "queued", None, None, at(200), 10)])
    states = {r.job_id: (r.api_status, r.error, r.result) for r in machine_run(feed, late="10 minutes", stall=3_600_000).collect()}
    assert states["a"] == ("FINISHED", None, "late but newer") and states["b"] == ("FAILED", "stalled", None) and states["f"] == ("PROCESSING", None, None)


def test_machine_of_many_jobs(spark, tmp_path):
    """A job's state cost some milliseconds of Python before."""
    k = F.col("id")
    rows = spark.range(60_000).select(F.concat(F.lit("j"), k % 30_000).alias("job_id"), F.when(k < 30_000, "queued").when(k % 2 == 0, "succeeded").otherwise("failed").alias("status"), F.lit("r").alias("result"), F.lit(None).cast("string").alias("error"), F.timestamp_seconds(k).alias("updated_at"), k.alias("seq"))
    rows.write.parquet(str(tmp_path / "in"))
    start = time.time()
    machine.run_machine(spark.readStream.schema(machine.EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ckpt"), late="100 days", stall=10**12).awaitTermination()
    got = machine.current_states(spark.read.parquet(str(tmp_path / "out"))).groupBy("api_status").count().collect()
    assert dict(map(tuple, got)) == {"FINISHED": 15_000, "FAILED": 15_000} and time.time() - start < 40


EVENTS = "ts timestamp, event_type string, user_id long"


def test_sliding_windows_drop_late_rows(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS)
    feed.add([(at(5), "a", 1), (at(50), "a", 1), (at(70), "b", 2)])  # the watermark is 60 then, and late rows go from the batch after the next on
    feed.add([(at(71), "b", 2)])
    feed.add([(at(58), "a", 1), (at(20), "a", 2), (at(200), "a", 1)])  # 20 is in windows that begin at -30 (closed) and 0 (closed); 58 in 0 (closed) and 30 (open)
    feed.add([(at(400), "b", 1)])
    q = windows.run_windows(windows.sliding_counts(feed.stream()), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    got = {(int((r.begin - DAY).total_seconds() // 60), r.event_type): r.n for r in feed.out().collect()}
    assert got == {(-30, "a"): 1, (0, "a"): 2, (30, "a"): 2, (30, "b"): 2, (60, "b"): 2, (150, "a"): 1, (180, "a"): 1}


def test_sessions(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS)
    feed.add([(at(0), "a", 1), (at(20), "a", 1), (at(0), "a", 2), (at(31), "a", 2)])
    feed.add([(at(45), "a", 1), (at(300), "a", 3)])
    feed.add([(at(301), "a", 4)])
    feed.add([(at(50), "a", 1), (at(600), "a", 3)])  # 50 is behind the watermark of 290
    q = windows.run_windows(windows.session_counts(feed.stream()), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    minutes = lambda x: int((x - DAY).total_seconds() // 60)
    assert {(r.user_id, minutes(r.begin), minutes(r.end)): r.n for r in feed.out().collect()} == {(1, 0, 75): 3, (2, 0, 30): 1, (2, 31, 61): 1, (3, 300, 330): 1, (4, 301, 331): 1}


def test_segment_units_moves_nothing(spark):
    rows = spark.createDataFrame([(1, "a\n\nb. Đề nghị c"), (2, None)], "doc_id long, text string")
    got = units.segment_units(rows)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.unit_id, r.idx, r.text) for r in got.collect()] == [("U1", 0, "a"), ("U2", 2, "b."), ("U3", 3, "Đề nghị c")]
    assert got.schema == got.select("doc_id", F.col("unit_no"), "unit_id", "idx", "text").schema


def test_units_are_dealt_by_their_number(spark, monkeypatch):
    """Partitions were joined by their compressed bytes, so that a task sorted millions of units."""
    monkeypatch.setattr(units, "PER_TASK", 10, raising=False)
    u = spark.range(600).select(F.expr("id div 6").alias("doc_id"), (F.col("id") % 6 + 1).alias("unit_no")).withColumns({"unit_id": F.concat(F.lit("U"), "unit_no"), "idx": F.col("unit_no"), "text": F.lit("x")})
    refs = u.filter("unit_no < 3").select("doc_id", F.lit("KN").alias("label"), F.lit(0).alias("group_ord"), F.col("unit_no").alias("pos"), "unit_id")
    for got, n in ((units.resolve_groups(refs, u), 100), (units.discarded_units(refs, u), 400)):
        assert got.rdd.getNumPartitions() >= 60 and got.count() == n
