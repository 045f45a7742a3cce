"""Letters: layout labels, petition-answer pairs, look-ups.

All of a letter's lines are in its own row, so positions, as-of pairing and interval slices are array
expressions: nothing is shuffled, whatever the number of letters. What several expressions use is
computed once, see once().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions import names as N
from lettermill.functions import patterns as P
from lettermill.functions import text as X


def places(lines: Column, flag) -> Column:
    """Positions (from 0) of the lines with a flag."""
    return F.filter(F.transform(lines, lambda x, i: F.when(flag(x), i)), lambda i: i.isNotNull())


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns. They come out of a generator of one row, over which projections don't
    merge: else every use of a column would compute its expression again."""
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("made")
    return df.select("*", made).select(*df.columns, *[F.col(f"made.{k}").alias(k) for k in columns])


def marked(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with lines, positions of headings (s1: those with an s2 behind, s2) and stops."""
    out = once(docs, lines=X.lines(F.coalesce("text", F.lit(""))))
    out = once(out, s2=places(F.col("lines"), lambda x: x.rlike(P.S2)), heads=places(F.col("lines"), X.is_petition_heading), ends=places(F.col("lines"), X.is_stop))
    last = F.array_max("s2")
    out = once(out, s1=F.filter("heads", lambda i: i < last))
    return out.withColumn("stops", F.array_union(F.array_union("s1", "s2"), "ends")).drop("heads", "ends")


def _slice(lines: Column, start: Column, end: Column) -> Column:
    """Lines from start to before end."""
    return F.slice(lines, start + 1, F.greatest(F.lit(0), end - start))


def label() -> Column:
    """Layout of a marked letter: f1, f2, f3 or llm."""
    one = (F.size("s1") == 1) & (F.size("s2") == 1)
    start, end = F.element_at("s1", 1), F.element_at("s2", 1)
    items = F.size(F.filter(_slice(F.col("lines"), start, end), lambda x: x.rlike(P.ITEM)))
    return F.when((F.size("s1") == 0) | (F.size("s2") == 0), "llm").when(one & (start < end) & (items >= 2), "f3").when(one, "f1").otherwise("f2")


def classify(docs: DataFrame) -> DataFrame:
    return marked(docs).select("doc_id", label().alias("label"))


def _segments(lines: Column, starts: Column, first: int) -> Column:
    """Runs of lines from each start (plus first lines) to the next."""
    return F.transform(starts, lambda i, k: _slice(lines, i + first, F.coalesce(F.try_element_at(starts, k + 2), F.size(lines))))


def sections(docs: DataFrame) -> DataFrame:
    """A row for each answer heading that has a petition heading before it: petition and answer lines."""
    out = once(marked(docs), label=label()).filter("label <> 'llm'")
    near = F.transform("s2", lambda j: F.struct(F.array_max(F.filter("s1", lambda i: i < j)).alias("i"), j.alias("j"), F.coalesce(F.array_min(F.filter("stops", lambda k: k > j)), F.size("lines")).alias("end")))
    out = out.withColumn("near", F.filter(near, lambda s: s["i"].isNotNull()))
    out = out.select("*", F.posexplode("near").alias("section", "at"))
    lines = F.col("lines")
    rows = out.select("doc_id", "label", "section", "lines", "at")
    return once(rows, asked=_slice(lines, F.col("at.i") + 1, F.col("at.j")), answered=_slice(lines, F.col("at.j") + 1, F.col("at.end"))).drop("lines", "at")


def pairs(docs: DataFrame) -> DataFrame:
    """doc_id, label, pair_ord, noi_dung and tra_loi of the letters with a known layout."""
    out = sections(docs)
    items = places(F.col("asked"), lambda x: x.rlike(P.ITEM))
    heads = places(F.col("answered"), lambda x: x.rlike(P.ANSWER_HEAD))
    out = once(out, items=items, heads=heads)
    bodies = _segments(F.col("answered"), F.col("heads"), 1)
    numbers = F.transform("heads", lambda h: F.transform(F.regexp_extract_all(F.regexp_extract(F.get("answered", h), P.ANSWER_HEAD, 1), F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("bigint")))
    opening = _slice(F.col("answered"), F.lit(0), F.element_at("heads", 1))  # goes with the first block
    blocks = F.transform(bodies, lambda b, k: F.struct(F.get(F.col("numbers"), k).alias("numbers"), F.when(k == 0, F.concat(opening, b)).otherwise(b).alias("body")))
    out = once(out, numbers=F.when(F.size("heads") > 0, numbers).otherwise(F.array().cast("array<array<bigint>>")))
    out = once(out, blocks=F.when(F.size("heads") > 0, blocks))
    listed = (F.col("label") == "f3") & (F.size("items") >= 2) & (F.size("heads") > 0)
    number = lambda ls: F.regexp_extract(F.element_at(ls, 1), P.ITEM, 1).cast("bigint")
    first = lambda n: F.try_element_at(F.filter("blocks", lambda b: F.array_contains(b["numbers"], n)), F.lit(1))["body"]
    split = F.transform(_segments(F.col("asked"), F.col("items"), 0), lambda ls: F.struct(ls.alias("asked"), F.coalesce(first(number(ls)), F.col("answered")).alias("answered")))
    out = out.select("doc_id", "label", "section", F.posexplode(F.when(listed, split).otherwise(F.array(F.struct("asked", "answered")))).alias("item", "pair"))
    text = lambda c: F.array_join(c, "\n")
    out = once(out, asked=text("pair.asked"), answered=text("pair.answered")).drop("pair")
    return out.select(
        "doc_id", "label", (F.col("section") * 100_000 + F.col("item")).alias("pair_ord"), X.clean_petition(X.clean_text(F.col("asked"))).alias("noi_dung"), X.clean_answer(F.col("answered")).alias("tra_loi")
    )


def prepared(docs: DataFrame) -> DataFrame:
    """Letters as they come from OCR, cleaned."""
    return docs.withColumn("text", X.fix_misread(X.clean_footer(X.real_newlines("text"))))


def letter_metadata(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.metadata(F.col("text")).alias("m")).select("doc_id", "m.*")


def delegation_ids(docs: DataFrame, names: dict[str, int]) -> DataFrame:
    """doc_id and donvi_id: the unit named in the first header line with the phrase and a known name, else
    right behind the phrase in the joined header; the longest name wins."""
    header = F.transform(F.slice(X.lines(F.coalesce("text", F.lit(""))), 1, P.HEADER_LINES), X.folded_name)
    return docs.select("doc_id", N.delegation(docs.sparkSession, header, names).alias("donvi_id"))


def ministry(line: Column) -> Column:
    """The first name of the list that a line holds."""
    return F.coalesce(*[F.when(F.lower(line).contains(x.lower()), F.lit(x)) for x in P.MINISTRIES])


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, bo and daibieu: first ministry and delegation in header lines; null unless both are there."""
    header = F.filter(X.lines(F.coalesce("text", F.lit(""))), X.is_header)
    bo = F.try_element_at(F.filter(F.transform(header, ministry), lambda v: v.isNotNull()), F.lit(1))
    named = F.filter(header, lambda x: F.lower(x).contains(P.DELEGATION.lower()))
    daibieu = X.delegation(F.try_element_at(named, F.lit(1)))
    both = docs.select("doc_id", bo.alias("bo"), F.when(F.size(named) > 0, daibieu).alias("daibieu"))
    ok = F.col("bo").isNotNull() & F.col("daibieu").isNotNull()
    return both.select("doc_id", F.when(ok, F.col("bo")).alias("bo"), F.when(ok, F.col("daibieu")).alias("daibieu"))
