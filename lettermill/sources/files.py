"""Files in and out: PDFs, OCR and rendering by injected callables, markdown."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import calls
from lettermill.functions import text as X
from lettermill.operators import store

#: Names of a dictionary that goes through the driver.
MOST_NAMES = 500_000


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, stem, length and content of the PDFs below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("stem"), "length", "content")


def by_name(files: DataFrame) -> DataFrame:
    return files.orderBy("path")


def missing(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected paths without a file."""
    return expected.join(found.select("path"), "path", "left_anti")


def all_or_fail(expected: DataFrame, found: DataFrame) -> DataFrame:
    """The found files of expected (path, file_ord); raises, with their number and paths, if any isn't there."""
    gone = missing(expected, found)
    store.fail_on_any(gone.select("file_ord", F.concat(F.col("path"), F.lit(": no such file")).alias("error")))
    return expected.join(found, "path")


def names_with_ids(spark: SparkSession, path: str) -> dict[str, int]:
    """A dictionary of units: a JSON object of names and ids, in their order."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "id")).selectExpr("name", "CAST(id AS BIGINT) AS id")
    found = rows.limit(MOST_NAMES + 1).collect()
    if len(found) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names are no dictionary")
    return {r["name"]: r["id"] for r in found}


def pending(inputs: DataFrame, outputs: DataFrame, overwrite: bool = False, key: str = "stem") -> DataFrame:
    """Inputs without an output yet; all, if outputs are overwritten."""
    return inputs if overwrite else inputs.join(outputs.select(key), key, "left_anti")


def recognised(files: DataFrame, ocr: Callable[[bytes], tuple[int, str]], most: int | None = None, in_flight: int = calls.IN_FLIGHT, **options) -> DataFrame:
    """path, text and error of files by an OCR callable, a plain or a coroutine function.

    A task has in_flight calls at once, on an event loop of its own; all tasks together have most, if given (1: one after another, with in_flight 1).
    """
    return _called(files, ocr, most, in_flight, options).withColumn("text", X.real_newlines("text"))


def _called(files: DataFrame, ocr: Callable[[bytes], tuple[int, str]], most: int | None, in_flight: int, options: dict) -> DataFrame:
    def ask(pool, question: tuple[str, bytes]):
        return calls.retried(ocr, pool, question[1], **options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        questions = (q for b in batches for q in zip(b["path"], b["content"], strict=True))
        for (path, _), text, error in calls.in_order(questions, ask, in_flight):
            yield pd.DataFrame([(path, text, error)], columns=["path", "text", "error"])

    rows, tasks = files.select("path", "content"), calls.tasks_for(most, in_flight)
    rows = rows.repartition(tasks) if tasks else rows
    return rows.mapInPandas(run, "path string, text string, error string")


def canonical(files: DataFrame, ocr: Callable[[bytes], tuple[int, str]], most: int | None = None, in_flight: int = calls.IN_FLIGHT, **options) -> DataFrame:
    """path, canonical (the JSON text that OCR answers with), content (its field of that name) and error; an answer without content is an error."""

    def checked(status: int, text: str) -> tuple[int, str]:
        if status < 400 and "content" not in (found if isinstance(found := json.loads(text), dict) else {}):
            raise ValueError("the answer has no content")
        return status, text

    with_content = calls.then(ocr, checked)
    rows = _called(files, with_content, most, in_flight, options)
    return rows.select("path", F.col("text").alias("canonical"), X.real_newlines(F.get_json_object("text", "$.content")).alias("content"), "error")


def rendered(recognised: DataFrame, render: Callable[[bytes], tuple[int, str]], tries: int = 3, most: int | None = None, in_flight: int = calls.IN_FLIGHT, **options) -> DataFrame:
    """path, content and rendered of canonical() rows: the markdown that a service makes of the JSON; null if it fails or is blank, so that the content stands in."""

    def content_of(status: int, text: str) -> tuple[int, str]:
        if status < 400:
            text = json.loads(text).get("content") or ""
            if not text.strip():
                raise ValueError("the rendering is blank")
        return status, text

    markdown = calls.then(render, content_of)
    good = recognised.filter("error IS NULL")
    made = _called(good.select("path", F.encode("canonical", "UTF-8").alias("content")), markdown, most, in_flight, {"tries": tries, **options})
    return good.select("path", "content").join(made.select("path", X.real_newlines(F.col("text")).alias("rendered")), "path")


def rendered_or_plain(rendered: str = "rendered", content: str = "content") -> F.Column:
    """The rendered markdown if it has structure, else the plain content."""
    return F.when(X.has_structure(F.col(rendered)), F.col(rendered)).otherwise(X.real_newlines(F.col(content)))


def json_of_markdown(spark: SparkSession, path: str, extract: Callable[[DataFrame], DataFrame], out: str) -> None:
    """A JSON line for each markdown file below a path, in a folder of its stem: what extract makes of (doc_id, text)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
    docs = files.select(F.xxhash64("path").alias("doc_id"), F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("stem"), F.decode("content", "UTF-8").alias("text"))
    extract(docs.select("doc_id", "text")).join(docs.select("doc_id", "stem"), "doc_id").drop("doc_id").write.partitionBy("stem").json(out)


LOG_LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) \[(\w+)\] \[([^:\]]+):(\d+)\] - (.*)$"


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    parts = [F.regexp_extract(column, LOG_LINE, i) for i in range(1, 6)]
    return lines.filter(F.col(column).rlike(LOG_LINE)).select(F.to_timestamp(parts[0]).alias("ts"), parts[1].alias("level"), parts[2].alias("logger"), parts[3].cast("int").alias("line"), parts[4].alias("message"))
