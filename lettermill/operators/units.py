"""Numbered text units, and the groups of them that a language model proposes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions import patterns as P
from lettermill.functions import text as X


def segment_units(docs: DataFrame) -> DataFrame:
    """doc_id, unit_no, unit_id, idx and text: lines, and parts of lines before a cue; blank lines take an idx."""
    rows = F.transform(F.split(X.strip(F.coalesce("text", F.lit(""))), "\n"), X.strip)
    split = lambda x: F.when((x == "") | x.rlike(P.HEADING), F.array(x)).otherwise(F.filter(F.split(x, P.UNIT_CUE), lambda p: X.strip(p) != ""))
    parts = F.flatten(F.transform(rows, split))
    kept = F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("idx"), p.alias("text"))), lambda u: u["text"] != "")
    numbered = docs.select("doc_id", F.posexplode(kept).alias("place", "u")).withColumn("unit_no", F.col("place") + 1)  # a unit's place in its letter's array is its number
    return numbered.select("doc_id", "unit_no", F.concat(F.lit("U"), F.col("unit_no")).alias("unit_id"), "u.idx", "u.text")


def prompts(units: DataFrame) -> DataFrame:
    """doc_id and prompt: "[U1] ..." joined by blank lines."""
    ordered = F.array_sort(F.collect_list(F.struct("unit_no", F.format_string("[%s] %s", "unit_id", "text").alias("x"))))
    return units.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["x"]), "\n\n").alias("prompt"))


def answer_groups(answer: Column) -> Column:
    """Groups (JSON text each) of a model's answer: its first array, also amid other text; null if it has none."""
    outer = X.outer_json(X.strip_fence(X.after_thinking(answer)))
    return F.when(outer.startswith("["), F.from_json(outer, "array<string>"))


def group_refs(answers: DataFrame) -> DataFrame:
    """References (doc_id, label, group_ord, pos, unit_id) of model answers (doc_id, label, answer: JSON array of arrays)."""
    each = answers.select("doc_id", "label", F.posexplode(answer_groups(F.col("answer"))).alias("group_ord", "g"))
    return each.select("doc_id", "label", "group_ord", F.posexplode(F.from_json("g", "array<string>")).alias("pos", "unit_id"))


#: Units, or references to them, that a task sorts at once.
PER_TASK = 100_000


def _tasks(units: DataFrame) -> int:
    """So many tasks that none has more than PER_TASK units, evenly dealt. Spark joins partitions by their compressed
    bytes, of which numbers and short ids have next to none: a task got millions of them."""
    return max(units.sparkSession.sparkContext.defaultParallelism, -(-units.count() // PER_TASK))


def _once(refs: DataFrame, units: DataFrame, tasks: int) -> DataFrame:
    """References to known units, numbered (n) among those of the same label to the same unit."""
    known = refs.repartition(tasks, "doc_id", "unit_id").join(units.select("doc_id", "unit_id", "unit_no").repartition(tasks, "doc_id", "unit_id"), ["doc_id", "unit_id"])
    return known.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "label", "unit_id").orderBy("group_ord", "pos")))


def resolve_groups(refs: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, label, group_ord, unit_ids (by place), first, last, in_order and contiguous of each group.

    Unknown units go, and of repeated references of a label the first stays.
    """
    tasks = _tasks(units)
    once = _once(refs, units, tasks).filter("n = 1").repartition(tasks, "doc_id")
    by_pos = F.transform(F.array_sort(F.collect_list(F.struct("pos", "unit_no"))), lambda s: s["unit_no"])
    g = once.groupBy("doc_id", "label", "group_ord").agg(by_pos.alias("given"), F.min("unit_no").alias("first"), F.max("unit_no").alias("last"), F.count(F.lit(1)).alias("n"))
    sorted_ids = F.transform(F.array_sort("given"), lambda n: F.concat(F.lit("U"), n.cast("string")))
    return g.select("doc_id", "label", "group_ord", sorted_ids.alias("unit_ids"), "first", "last", (F.array_sort("given") == F.col("given")).alias("in_order"), (F.col("last") - F.col("first") + 1 == F.col("n")).alias("contiguous"))


def with_texts(groups: DataFrame, units: DataFrame) -> DataFrame:
    """groups (doc_id, label, group_ord, unit_ids) with text: that of their units, cleaned, paragraphs apart."""
    each = groups.select("doc_id", "label", "group_ord", F.posexplode("unit_ids").alias("pos", "unit_id")).join(units.select("doc_id", "unit_id", "text"), ["doc_id", "unit_id"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"])
    texts = each.groupBy("doc_id", "label", "group_ord").agg(X.trim_list_mark(X.clean_block(F.array_join(ordered, "\n\n"))).alias("text"))
    return groups.join(texts, ["doc_id", "label", "group_ord"])


def issues(answers: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, label and issue of what is dropped from or odd about model answers: groups that are none,
    unknown and repeated units, groups out of order or with gaps."""
    each = answers.select("doc_id", "label", F.explode(answer_groups(F.col("answer"))).alias("g"))
    refs = group_refs(answers)
    groups = resolve_groups(refs, units)
    listed = F.array_join("unit_ids", ",")
    parts = [
        each.filter(F.coalesce(F.size(F.from_json("g", "array<string>")), F.lit(0)) <= 0).select("doc_id", "label", F.concat(F.lit("no group: "), "g").alias("issue")),
        unknown_refs(refs, units).select("doc_id", "label", F.concat(F.lit("unknown unit: "), F.coalesce("unit_id", F.lit("null"))).alias("issue")),
        _once(refs, units, _tasks(units)).filter("n > 1").select("doc_id", "label", F.concat(F.lit("repeated unit: "), "unit_id").alias("issue")),
        groups.filter("NOT in_order").select("doc_id", "label", F.concat(F.lit("put in order: "), listed).alias("issue")),
        groups.filter("NOT contiguous").select("doc_id", "label", F.concat(F.lit("not contiguous: "), listed).alias("issue")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _without(rows: DataFrame, others: DataFrame, tasks: int) -> DataFrame:
    """Rows whose unit the others don't have."""
    key = ["doc_id", "unit_id"]
    return rows.repartition(tasks, *key).join(others.select(*key).repartition(tasks, *key), key, "left_anti")


def unknown_refs(refs: DataFrame, units: DataFrame) -> DataFrame:
    return _without(refs, units, _tasks(units))


def discarded_units(refs: DataFrame, units: DataFrame) -> DataFrame:
    """Units that no group refers to."""
    return _without(units, refs, _tasks(units))


def balance_groups(groups: DataFrame) -> DataFrame:
    """Groups with the larger side merged down to the smaller: doc_id, label, group_ord, unit_ids, warning.

    The surplus groups go into the last kept one, in their order (CAN_BANG), unless a unit that is in
    none of them but in another group lies between (MISMATCH, nothing merges); if a side has no group,
    the other has none either.
    """
    counts = groups.groupBy("doc_id").agg(F.count_if(F.col("label") == "KN").alias("kn"), F.count_if(F.col("label") == "TL").alias("tl"))
    w = Window.partitionBy("doc_id", "label").orderBy("group_ord")
    rows = groups.join(counts.filter("kn > 0 AND tl > 0"), "doc_id").withColumn("n", F.row_number().over(w))
    least, own = F.least("kn", "tl"), F.when(F.col("label") == "KN", F.col("kn")).otherwise(F.col("tl"))
    rows = rows.withColumns({"slot": F.least("n", least), "surplus": own > least})
    merged = rows.filter("surplus").groupBy("doc_id", "label", "slot").agg(F.min("first").alias("lo"), F.max("last").alias("hi"), F.count(F.lit(1)).alias("parts"), F.flatten(F.collect_list("unit_ids")).alias("own"))
    taken = rows.groupBy("doc_id").agg(F.array_distinct(F.transform(F.flatten(F.collect_list("unit_ids")), lambda u: F.substring(u, 2, 20).cast("long"))).alias("taken"))
    inside = F.size(F.filter("taken", lambda u: (u >= F.col("lo")) & (u <= F.col("hi"))))  # the merged group's own are all inside
    between = merged.filter("parts > 1").join(taken, "doc_id").filter(inside > F.size(F.array_distinct("own")))
    out = rows.join(between.select("doc_id").distinct().withColumn("blocked", F.lit(True)), "doc_id", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    slot = F.when(F.col("blocked"), F.col("n")).otherwise(F.col("slot"))
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "unit_ids"))), lambda s: s["unit_ids"]))
    done = out.groupBy("doc_id", "label", slot.alias("group_ord")).agg(ids.alias("unit_ids"), F.bool_or("blocked").alias("blocked"), F.bool_or(F.col("kn") != F.col("tl")).alias("uneven"))
    return done.select("doc_id", "label", "group_ord", "unit_ids", F.when(F.col("blocked"), "MISMATCH").when(F.col("uneven"), "CAN_BANG").alias("warning"))


def zip_groups(groups: DataFrame, texts: str = "text") -> DataFrame:
    """The n-th petition with the n-th answer; what is left over on a side goes."""
    kn = groups.filter("label = 'KN'").select("doc_id", "group_ord", F.col(texts).alias("noi_dung"))
    return kn.join(groups.filter("label = 'TL'").select("doc_id", "group_ord", F.col(texts).alias("tra_loi")), ["doc_id", "group_ord"])
