"""A whole job: letters as they come from OCR and petitions in, each petition with no or one answer out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.functions import patterns as P
from lettermill.functions import text as X
from lettermill.operators import letters, matching, modelled, store
from lettermill.sources.tables import written

#: Pairs of a letter have numbers below this.
PER_LETTER = 10_000_000_000


def letter_pairs(docs: DataFrame, model: modelled.Model | None = None, **options) -> DataFrame:
    """doc_id, pair_ord, noi_dung and tra_loi of prepared letters; those without a known layout go to the model, if there is one."""
    columns = ["doc_id", F.col("pair_ord").cast("long").alias("pair_ord"), "noi_dung", "tra_loi"]
    known = letters.pairs(docs).select(*columns)
    if model is None:
        return known
    rest = letters.marked(docs).filter(letters.label() == "llm").select("doc_id", "text")
    extracted = written(modelled.extract(rest, model, **options))
    store.fail_on_any(extracted.select(F.col("doc_id").alias("file_ord"), "error"))
    return known.unionByName(modelled.pairs(extracted).select(*columns))


def numbered_pairs(docs: DataFrame, model: modelled.Model | None = None, **options) -> DataFrame:
    """letter_pairs() with numbers that are unique over all letters."""
    return letter_pairs(docs, model, **options).withColumn("pair_ord", F.col("doc_id") * PER_LETTER + F.col("pair_ord"))


def answer(petitions: DataFrame, docs: DataFrame, names: dict[str, int], model: modelled.Model | None = None, threshold: float = P.THRESHOLD, keep_filtered: bool = False, **options) -> DataFrame:
    """`KN_KIENNGHI.ID` and answers (content, file_id, metadata) of petitions (petition_id, donvi_id, noi_dung).

    docs: doc_id (the place of the file), file_id and text. Petitions of units that no letter names are
    left out, unless keep_filtered: then they have no answers.
    """
    ready = written(letters.prepared(docs))  # read for pairs, metadata and units
    of_file = ready.select("doc_id", "file_id", X.metadata(F.col("text")).alias("metadata"))
    pairs = written(numbered_pairs(ready, model, **options))  # matched, and looked up for the answers
    pairs = pairs.join(of_file, "doc_id")
    kept = matching.keep_units(petitions, letters.delegation_ids(ready, names))
    out = matching.answers(matching.best_matches(kept, pairs.select("pair_ord", "noi_dung"), threshold), pairs)
    if not keep_filtered:
        return out
    left = petitions.join(kept.select("petition_id"), "petition_id", "left_anti").select(F.col("petition_id").alias("KN_KIENNGHI.ID"))
    return out.unionByName(left, allowMissingColumns=True).withColumn("answers", F.coalesce("answers", F.array().cast(out.schema["answers"].dataType)))


def totals(results: DataFrame) -> DataFrame:
    """matched_count and unmatched_count of answered petitions."""
    hit = F.count_if(F.size("answers") > 0)
    return results.agg(hit.alias("matched_count"), (F.count(F.lit(1)) - hit).alias("unmatched_count"))


def formatted(results: DataFrame, plain_text: bool) -> DataFrame:
    """results with contents as plain text or tidy markdown; metadata is always tidy."""
    body = X.strip_markdown if plain_text else X.normalize_markdown
    tidy = lambda m: F.struct(*[X.normalize_markdown(m[c]).alias(c) for c in ("so_cong_van", "ngay_ban_hanh", "nguoi_ky")])
    a = F.get("answers", 0)
    one = F.struct(body(F.coalesce(a["content"], F.lit(""))).alias("content"), a["file_id"].alias("file_id"), F.when(a["metadata"].isNotNull(), tidy(a["metadata"])).alias("metadata"))
    return results.withColumn("answers", F.array_compact(F.array(F.when(F.size("answers") > 0, one))))
