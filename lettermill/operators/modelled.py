"""Letters without a known layout: a language model, given as a callable, groups their numbered units."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.functions import calls
from lettermill.operators import units
from lettermill.sources.tables import written

#: Asked in this order.
LABELS = ("KN", "TL")
#: Called with label, prompt and hint (null at first), returns the answer.
Model = Callable[[str, str, str | None], str]
BAD_JSON = "The last answer was no JSON array. Answer with one array of arrays of the listed unit ids alone."
UNEVEN = "The last answer had %d petitions but %d answers. Each petition has exactly one answer; give the whole array again."


def ask(prompts: DataFrame, model: Model, most: int | None = None, tries: int = 3, in_flight: int = calls.IN_FLIGHT) -> DataFrame:
    """doc_id, label, answer and error for each prompt (doc_id, prompt, hint) and label.

    An empty answer or an exception is tried again, tries times in all. model is a plain or a coroutine function; a task has in_flight
    calls at once, and all tasks together most (what the service bears), if given; else there are as many tasks as cores.
    """

    async def one(pool, question: tuple) -> str:
        error: Exception = ValueError("empty answer")
        for _ in range(tries):
            try:
                if answer := await calls.once(model, pool, *question[1:]):
                    return answer
            except Exception as e:  # noqa: BLE001  the last one is reported
                error = e
        raise error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        questions = ((d, label, p, h) for b in batches for d, p, h in zip(b["doc_id"], b["prompt"], b["hint"], strict=True) for label in LABELS)
        for (d, label, _, _), answer, error in calls.in_order(questions, one, in_flight):
            yield pd.DataFrame([(d, label, answer, error)], columns=["doc_id", "label", "answer", "error"])

    tasks = calls.tasks_for(most, in_flight) or prompts.sparkSession.sparkContext.defaultParallelism
    return prompts.select("doc_id", "prompt", "hint").repartition(tasks, F.xxhash64("doc_id")).mapInPandas(run, "doc_id long, label string, answer string, error string")


def propose(numbered: DataFrame, model: Model, tries: int = 3, most: int | None = None, in_flight: int = calls.IN_FLIGHT) -> DataFrame:
    """Answers (doc_id, label, answer, error) for the units of letters.

    A letter is asked about again, with a hint, while an answer can't be read or the sides differ in
    number; the last try counts of which both answers could be read. Each try is written, so no call is repeated.
    """
    pending, all_tries = units.prompts(numbered).withColumn("hint", F.lit(None).cast("string")), None
    for i in range(tries):
        got = written(ask(pending, model, most, in_flight=in_flight).withColumn("try", F.lit(i)))
        all_tries = got if all_tries is None else all_tries.unionByName(got)
        sides = units.resolve_groups(units.group_refs(got), numbered).groupBy("doc_id").agg(F.count_if(F.col("label") == "KN").alias("kn"), F.count_if(F.col("label") == "TL").alias("tl"))
        read = got.groupBy("doc_id").agg(F.bool_and(units.answer_groups(F.col("answer")).isNotNull()).alias("read"), F.bool_or(F.col("error").isNotNull()).alias("failed"))
        state = read.join(sides, "doc_id", "left").fillna(0, ["kn", "tl"]).filter("NOT failed AND (NOT read OR kn <> tl)")
        again = written(state.select("doc_id", F.when(~F.col("read"), BAD_JSON).otherwise(F.format_string(UNEVEN, "kn", "tl")).alias("hint")))
        if not again.limit(1).count():
            break
        pending = pending.drop("hint").join(again, "doc_id")
    by_try = all_tries.groupBy("doc_id", "try").agg(F.bool_and(units.answer_groups(F.col("answer")).isNotNull()).alias("read"), F.bool_or(F.col("error").isNotNull()).alias("failed"))
    last = by_try.groupBy("doc_id").agg(F.coalesce(F.max(F.when(F.col("failed") | F.col("read"), F.col("try"))), F.max("try")).alias("try"))
    return all_tries.join(last, ["doc_id", "try"]).select("doc_id", "label", "answer", "error")


def extract(docs: DataFrame, model: Model, tries: int = 3, most: int | None = None, in_flight: int = calls.IN_FLIGHT) -> DataFrame:
    """doc_id, n_units, kien_nghi, tra_loi, blocks, warnings and error of each letter (doc_id, text).

    blocks are in the order of the groups, a petition before its answer. A letter without units isn't asked about (KHONG_UNIT).
    """
    numbered = written(units.segment_units(docs))
    answers = propose(numbered, model, tries, most, in_flight)
    groups = units.with_texts(units.balance_groups(units.resolve_groups(units.group_refs(answers), numbered)), numbered)
    block = F.struct("group_ord", "label", F.col("unit_ids").alias("source_unit_ids"), F.element_at("unit_ids", 1).alias("start_id"), F.element_at("unit_ids", -1).alias("end_id"), "text")
    texts = lambda label: F.transform(F.filter("blocks", lambda b: b["label"] == label), lambda b: b["text"])
    found = groups.groupBy("doc_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"), F.collect_set("warning").alias("evened"))
    noted = units.issues(answers, numbered).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("VALIDATE: "), "label", F.lit(" "), "issue"))).alias("noted"))
    sizes = numbered.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"))
    errors = answers.groupBy("doc_id").agg(F.min("error").alias("error"))
    out = docs.select("doc_id").join(sizes, "doc_id", "left").join(found, "doc_id", "left").join(noted, "doc_id", "left").join(errors, "doc_id", "left")
    none = F.array().cast("array<string>")
    warnings = F.concat(F.coalesce("noted", none), F.coalesce("evened", none), F.when(F.col("n_units").isNull(), F.array(F.lit("KHONG_UNIT"))).otherwise(none))
    return out.select("doc_id", F.coalesce("n_units", F.lit(0)).alias("n_units"), F.coalesce(texts("KN"), none).alias("kien_nghi"), F.coalesce(texts("TL"), none).alias("tra_loi"), "blocks", warnings.alias("warnings"), "error")


def pairs(extracted: DataFrame) -> DataFrame:
    """doc_id, pair_ord, noi_dung and tra_loi: the n-th petition with the n-th answer; what is left over on a side goes."""
    both = F.slice(F.arrays_zip(F.col("kien_nghi").alias("noi_dung"), F.col("tra_loi").alias("tra_loi")), F.lit(1), F.least(F.size("kien_nghi"), F.size("tra_loi")))
    return extracted.select("doc_id", F.posexplode(both).alias("pair_ord", "p")).select("doc_id", "pair_ord", F.col("p.noi_dung").alias("noi_dung"), F.col("p.tra_loi").alias("tra_loi"))
