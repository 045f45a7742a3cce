"""Every pattern on texts of 100,000 words, on megabyte lines and on long runs: none may take Java's stack or more than linear time."""

import time

import pytest
from pyspark.sql import functions as F

from lettermill.functions import patterns as P
from lettermill.functions import text as X
from lettermill.functions.markdown import plain_text
from lettermill.operators import letters, requests, units

N = 100_000
TEXTS = {
    "words": "Word " * N, "capitals": "- Đoàn đại biểu Quốc hội tỉnh " + "Alpha " * N, "number and words": "Số: 1/A" + " ab" * N, "number, no end": "Số: 1/A" + " ab" * N + " !", "number, lines": "Số: 1/A\n" + "ab\n" * N,
    "spaces": "a" + " " * N + "b", "tabs": "a" + "\t" * N + "b", "blank lines": "a" + "\n" * N + "b", "lines of blanks": "a" + "\n \t" * N + "b", "quotes": "a" + "”\" " * N + "b", "marks": "a" + ". ”" * N, "stars": "a" + "*_# " * N + "b",
    "quoted lines": "x\n" + "> n\n" * N + "y", "notes": "x\n" + "<sup>1</sup> n\n" * (N // 10) + "y", "minister": "BỘ TRƯỞNG " * (N // 10), "minister, spaces": "BỘ TRƯỞNG" + " " * N + "*x", "minister, gap": "BỘ TRƯỞNG a" + " " * N + "b*x",
    "phrase": "nội dung kiến nghị " * (N // 10), "date": "Hà Nội, ngày 1 tháng" + " _" * N, "roman": "I" * N, "digits": "1" * N, "digits and dots": "1." * N, "item": "(1) " + "_*" * N, "fence": "```json\n" + " " * N, "cues": "x. Đề nghị " * (N // 10),
    "closing": "trân trọng" + " " * N + "x", "gaps before Số": " " * N + "Số" + " " * N + "x", "semicolons": ";" * N + "x", "hashes": "# " * N, "hash runs": "a" + " " * N + "#" * N,
}
FUNCTIONS = {
    k: getattr(X, k)
    for k in (
        "strip", "fold", "tokens", "folded_name", "clean_footer", "remove_footnotes", "clean_text", "clean_petition", "clean_answer", "normalize_markdown", "clean_line", "clean_block", "trim_list_mark",
        "delegation", "letter_number", "issue_date", "signer", "is_header", "is_petition_heading", "is_stop", "has_structure", "strip_fence", "after_thinking", "clean_json_text", "outer_json",
    )
}
FUNCTIONS |= {"item": lambda x: x.rlike(P.ITEM), "answer_head": lambda x: F.regexp_extract(x, P.ANSWER_HEAD, 1), "s2": lambda x: x.rlike(P.S2), "ministry": letters.ministry, "file_ids": requests.file_ids, "groups": units.answer_groups, "cues": lambda x: F.size(F.split(x, P.UNIT_CUE))}


@pytest.mark.parametrize("name", FUNCTIONS)
def test_long_texts(spark, name):
    rows = spark.createDataFrame(list(TEXTS.items()), "k string, t string").repartition(4)
    start = time.time()
    got = rows.select("k", F.length(FUNCTIONS[name](F.col("t")).cast("string"))).collect()
    assert len(got) == len(TEXTS) and time.time() - start < 60


def test_what_long_texts_give(spark):
    rows = spark.createDataFrame(list(TEXTS.items()), "k string, t string")
    got = {r.k: r for r in rows.select("k", X.letter_number(F.col("t")).alias("number"), X.delegation(F.col("t")).alias("delegation"), X.signer(F.col("t")).alias("signer")).collect()}
    assert got["number and words"].number == "1/A" + "ab" * N and got["number, no end"].number is None and got["number, lines"].number == "1/A" + "ab" * N
    assert got["capitals"].delegation == "Đoàn đại biểu Quốc hội tỉnh" + " Alpha" * N and got["words"].delegation == P.DELEGATION
    assert (got["minister"].signer, got["minister, spaces"].signer, got["words"].signer) == (P.MINISTER, None, None)


def test_units_of_long_texts(spark):
    rows = spark.createDataFrame([(1, "x. Đề nghị a\n" * 20_000), (2, "y" * 1_000_000), (3, "\n" * N)], "doc_id long, text string")
    assert {r.doc_id: r["count"] for r in units.segment_units(rows).groupBy("doc_id").count().collect()} == {1: 40_000, 2: 1}


@pytest.mark.parametrize("text", [">" * N + "x", "> " * N, "_*" * N, "*a_" * N, "**a" * N + "b**" * N, "`a" * N, "[" * N, "[a](" * N, "a  \n" * N, "<" * N, "&amp;" * N], ids=lambda x: x[:4])
def test_markdown_of_long_texts(text):
    start = time.time()
    assert isinstance(plain_text(text), str) and time.time() - start < 30
