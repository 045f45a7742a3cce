from pyspark.sql import functions as F

from lettermill.functions import text as X
from lettermill.operators import answering, letters, matching, modelled, store, units
from lettermill.plans import fixtures
from lettermill.sources import files, tables
from lettermill.streaming import jobs


def _letters(spark):
    return letters.prepared(spark.createDataFrame([(a, c) for a, _, c in fixtures.LETTERS], "doc_id long, text string"))


def test_labels_and_pairs(spark):
    d = _letters(spark)
    assert dict(letters.classify(d).collect()) == {1: "f1", 2: "f2", 3: "f3", 4: "llm"}
    got = [(r.doc_id, r.noi_dung, r.tra_loi) for r in letters.pairs(d).orderBy("doc_id", "pair_ord").collect()]
    whole = "Mở đầu chung.\n2.1. Về kiến nghị số 04 và số 13\nSẽ tăng biên chế.\n2.2. Đối với kiến nghị số 20\nNội dung khác."
    assert got == [
        (1, "Đề nghị hỗ trợ nông dân trồng lúa.", "Bộ đã ban hành chính sách hỗ trợ nông dân trong **năm 2026**."),
        (2, "Xây cầu mới qua sông.", "Đang lập dự án.\nNội dung kiến nghị đã được ghi nhận."),
        (2, "Sửa đường liên xã.", "Đã bố trí vốn."),
        (3, "(1) Kiến nghị số 04: Tăng bác sĩ cho xã.", "Mở đầu chung.\nSẽ tăng biên chế."),
        (3, "(2) Kiến nghị số 13: Mua máy X quang.", "Mở đầu chung.\nSẽ tăng biên chế."),
        (3, "(3) Kiến nghị số 99: Giảm viện phí.", whole),
    ]


def test_metadata_and_units(spark):
    d = _letters(spark)
    got = {r.doc_id: tuple(r)[1:] for r in letters.letter_metadata(d).collect()}
    assert got == {1: ("4512/BABC-KHTC", "05/08/2026", "Bộ trưởng Lê Thị Mẫu"), 2: ("3366/BABC-VPĐP", None, "Bộ trưởng"), 3: ("/BYT-VP", None, None), 4: (None, "01/12/2026", None)}
    assert dict(letters.delegation_ids(d, fixtures.UNITS).collect()) == {1: 1, 2: 2, 3: 1, 4: None}
    u = units.segment_units(d.filter("doc_id = 4")).orderBy("unit_no").collect()
    assert [(r.unit_id, r.idx) for r in u] == [("U1", 0), ("U2", 1), ("U3", 2), ("U4", 3), ("U5", 5), ("U6", 6)]


def test_matching(spark):
    pairs = letters.pairs(_letters(spark)).withColumn("pair_ord", F.col("doc_id") * 10_000_000 + F.col("pair_ord"))
    petitions = spark.createDataFrame(fixtures.PETITIONS, "petition_id long, donvi_id long, noi_dung string")
    got = {r.petition_id: (r.pair_ord, r.score and round(r.score, 6)) for r in matching.best_matches(petitions, pairs).collect()}
    assert got == {101: (10000000, 1.0), 102: (20000000, 0.6), 103: (None, None), 104: (30000001, 0.888889)}
    kept = matching.keep_units(petitions, letters.delegation_ids(_letters(spark), fixtures.UNITS))
    assert tuple(matching.summary(matching.best_matches(kept, pairs)).first()) == (2, 1)


def test_scalars(spark):
    def one(f, s):
        return spark.createDataFrame([(s,)], "t string").select(f(F.col("t"))).first()[0]

    assert sorted(one(X.tokens, "Đề nghị hỗ trợ")) == ["e", "ho", "nghi", "tro"]


def test_cache_and_sources(spark, tmp_path):
    old = spark.createDataFrame([("a", "1", 1), ("b", "2", 5)], "cache_key string, result string, updated_at int")
    new = spark.createDataFrame([("a", "3", 1), ("b", "4", 4)], "cache_key string, result string, updated_at int")
    assert {(r.cache_key, r.result) for r in store.upsert(old, new).collect()} == {("a", "3"), ("b", "2")}
    got = files.recognised(spark.createDataFrame([("p", bytearray(b"1")), ("q", bytearray(b"2"))], "path string, content binary"), lambda c: (200, "a\\nb") if c == b"1" else (400, "bad")).collect()
    assert {(r.path, r.text, r.error is None) for r in got} == {("p", "a\nb", True), ("q", None, False)}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"job_id":"j","cache_key":"k","data_list":"[]"}\n{"job_id":"i","cache_key":"k","data_list":"[]"}')
    q = jobs.run_jobs(jobs.read_jobs(spark, str(tmp_path / "in")), lambda b: b.select("cache_key", F.lit("ok").alias("result"), F.lit(None).cast("string").alias("error")), str(tmp_path / "states"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    assert {(r.job_id, r.status) for r in spark.read.parquet(str(tmp_path / "states")).collect()} == {("j", "succeeded"), ("i", "succeeded")}


def test_model_answers(spark):
    rows = [("[[\"U1\"],[],\"U2\"] rest", 3), ("so: [1] [[\"U1\"]]", 1), ("{\"a\": [[\"U1\"]]}", None), ("none", None), (None, None)]
    d = spark.createDataFrame([(x,) for x, _ in rows], "a string").select("a", F.size(units.answer_groups(F.col("a"))).alias("n"), units.answer_groups(F.col("a")).isNull().alias("none"))
    assert {r.a: None if r.none else r.n for r in d.collect()} == dict(rows)
    smart = spark.createDataFrame([("[“a”, \"b “c” \\\" ”\", ‘d’]",)], "t string").select(X.clean_json_text(F.col("t"))).first()[0]
    assert smart == "[\"a\", \"b “c” \\\" ”\", 'd']"


def test_balance(spark):
    groups = "doc_id long, label string, group_ord int, unit_ids array<string>, first int, last int"
    apart = [(1, "KN", 0, ["U1"], 1, 1), (1, "KN", 1, ["U4"], 4, 4), (1, "TL", 0, ["U2"], 2, 2)]
    near = [(2, "KN", 0, ["U4"], 4, 4), (2, "KN", 1, ["U3"], 3, 3), (2, "TL", 0, ["U3", "U5"], 3, 5), (3, "KN", 0, ["U1"], 1, 1)]
    got = {(r.doc_id, r.label, r.group_ord): (r.unit_ids, r.warning) for r in units.balance_groups(spark.createDataFrame(apart + near, groups)).collect()}
    assert got == {
        (1, "KN", 1): (["U1"], "MISMATCH"), (1, "KN", 2): (["U4"], "MISMATCH"), (1, "TL", 1): (["U2"], "MISMATCH"),
        (2, "KN", 1): (["U4", "U3"], "CAN_BANG"), (2, "TL", 1): (["U3", "U5"], "CAN_BANG"),
    }


def test_model_is_asked_again_with_a_hint(spark):
    def model(label, prompt, hint):
        if "failing" in prompt:
            raise ValueError("down")
        if label == "KN":
            return '[["U1"]]' if hint else "no array"
        return '[["U2"]]'

    docs = spark.createDataFrame([(1, "Hỏi a.\nTrả lời b."), (2, " "), (3, "failing"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in modelled.extract(docs, model).collect()}
    assert (got[1].kien_nghi, got[1].tra_loi, got[1].warnings, got[1].error) == (["Hỏi a."], ["Trả lời b."], [], None)
    assert [b.label for b in got[1].blocks] == ["KN", "TL"] and got[1].n_units == 2
    assert got[2].warnings == got[4].warnings == ["KHONG_UNIT"] and got[2].n_units == 0 and got[2].kien_nghi == []
    assert "down" in got[3].error
    assert modelled.pairs(modelled.extract(docs.filter("doc_id < 3"), model)).count() == 1


def test_job(spark):
    docs = spark.createDataFrame(fixtures.LETTERS[:2], "doc_id long, file_id string, text string")
    petitions = spark.createDataFrame([(101, 1, "Đề nghị hỗ trợ nông dân trồng lúa"), (104, 3, "x")], "petition_id long, donvi_id long, noi_dung string")
    got = {r["KN_KIENNGHI.ID"]: r.answers for r in answering.answer(petitions, docs, fixtures.UNITS, keep_filtered=True).collect()}
    assert got[101][0].file_id == "FILE_001" and got[101][0].metadata.so_cong_van == "4512/BABC-KHTC" and got[104] == []
    assert answering.answer(petitions, docs, fixtures.UNITS).count() == 1


def test_tables_and_dump(spark):
    tables.create_tables(spark)
    tables.create_tables(spark)
    assert spark.table("jobs").count() == 0
    jobs_ = spark.sql("SELECT 'a' AS job_id, 'failed' AS status, '{}' AS input, NULL AS result, 'e' AS error, timestamp'2026-01-01' AS created_at, timestamp'2026-01-02' AS updated_at UNION ALL SELECT 'b', 'succeeded', '[]', '1', NULL, timestamp'2026-01-03', NULL")
    lines = [r.value for r in store.dump_lines(jobs_).collect()]
    assert lines[0].startswith("job_id: b\n") and "updated_at: NULL" in lines[0] and "RESULT:\nNULL" in lines[1]
    assert tuple(store.outcome_counts(jobs_).first()) == (1, 1)
