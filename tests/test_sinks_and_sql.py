"""Sinks that commit, and jobs in SQL."""

import pytest
from pyspark.sql import functions as F

from lettermill.operators import answering
from lettermill.plans import fixtures, surface
from lettermill.sources import sinks


def files_in(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_a_file_for_each_document(spark, tmp_path):
    docs = spark.createDataFrame([(f"thư {i}", f"# {i}\nẩ") for i in range(30)] + [("none", None)], "stem string, text string").repartition(5)
    done = sinks.write_markdown(docs, str(tmp_path / "out"))
    assert files_in(tmp_path / "out") == {f"thư {i}.md": f"# {i}\nẩ".encode() for i in range(30)} | {"none.md": b"", "_SUCCESS": b""}
    assert sorted(r.length for r in done.collect())[:2] == [0, 7]
    again = sinks.write_markdown(docs.limit(1).withColumn("text", F.lit("new")), f"file://{tmp_path / 'out'}")
    assert (tmp_path / "out" / again.first().name).read_text() == "new" and len(files_in(tmp_path / "out")) == 32


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    @F.udf("string")
    def failing(i):
        if i == 37:
            raise ValueError("broken document")
        return "x" * 1000

    docs = spark.range(40).repartition(4).select(F.col("id").cast("string").alias("stem"), failing("id").alias("text"))
    with pytest.raises(Exception, match="broken document"):
        sinks.write_markdown(docs, str(tmp_path / "out"))
    assert not [x for x in files_in(tmp_path / "out") if not x.startswith("_staged/")]
    good = docs.withColumn("text", F.lit("y" * 10))
    sinks.write_markdown(good, str(tmp_path / "out"))
    assert {x for x in files_in(tmp_path / "out") if not x.startswith("_staged/")} == {f"{i}.md" for i in range(40)} | {"_SUCCESS"}


@pytest.mark.parametrize("names", [["a", "a"], ["../a"], ["/etc/a"], ["x/../y"], [None], [""], ["_SUCCESS"]])
def test_odd_names_are_refused(spark, tmp_path, names):
    rows = spark.createDataFrame([(n, "t") for n in names], "name string, content string")
    with pytest.raises(ValueError, match="single ones"):
        sinks.write_objects(rows, str(tmp_path / "out"))
    assert files_in(tmp_path / "out") == {}


def test_uploads(spark, tmp_path):
    rows = spark.createDataFrame([("r1", [bytearray(b"%PDF 1"), bytearray(b"")]), ("r2", [bytearray(b"2")]), ("r3", [])], "request_id string, contents array<binary>")
    got = {(r.request_id, r.file_ord): (r.path, r.length) for r in sinks.write_uploads(rows, str(tmp_path / "up")).collect()}
    assert got == {("r1", 0): (f"{tmp_path}/up/r1/0.pdf", 6), ("r1", 1): (f"{tmp_path}/up/r1/1.pdf", 0), ("r2", 0): (f"{tmp_path}/up/r2/0.pdf", 1)}
    assert files_in(tmp_path / "up") == {"r1/0.pdf": b"%PDF 1", "r1/1.pdf": b"", "r2/0.pdf": b"2", "_SUCCESS": b""}


def test_a_job_in_sql_equals_the_api(spark):
    docs = spark.createDataFrame(fixtures.LETTERS, "doc_id long, file_id string, text string")
    petitions = spark.createDataFrame(fixtures.JOB_PETITIONS, "petition_id long, donvi_id long, noi_dung string")
    rows = lambda d: sorted((r["KN_KIENNGHI.ID"], [(a.content, a.file_id, tuple(a.metadata)) for a in r.answers]) for r in d.collect())
    in_sql = surface.job_in_sql(docs, petitions, fixtures.UNITS, model=fixtures.model)
    assert rows(in_sql) == rows(answering.answer(petitions, docs, fixtures.UNITS, fixtures.model))
    assert any(a for _, a in rows(in_sql))
    got = spark.sql("SELECT fold_text('Đề Nghị') AS f, sort_array(word_set('Đề nghị, đề NGHỊ 12')) AS w, set_similarity(array('a', 'b'), array('b', 'c')) AS s, set_similarity(array(), array('b')) AS z, api_status('failed') AS a").first()
    assert (got.f, got.w, round(got.s, 6), got.z, got.a) == ("đe nghi", ["12", "e", "nghi"], 0.333333, 0.0, "FAILED")
    assert {r.label for r in spark.sql("SELECT label FROM letter_labels").collect()} == {"f1", "f2", "f3", "llm"}
