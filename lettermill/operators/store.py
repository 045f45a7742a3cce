"""Result cache and job states, as append-only tables with latest-state views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], recency: list[str]) -> DataFrame:
    """The latest row of each key. max(struct) aggregates before the shuffle, so a frequent key isn't a large task."""
    rest = [c for c in rows.columns if c not in keys and c not in recency]
    return rows.groupBy(*keys).agg(F.max(F.struct(*recency, *rest)).alias("x")).select(*keys, "x.*")


def upsert(table: DataFrame, new: DataFrame, key: str = "cache_key", stamp: str = "updated_at") -> DataFrame:
    """Rows of both by key; the later stamp wins, of equals the new row."""
    both = table.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)))
    return latest(both, [key], [stamp, "seq"]).drop("seq")


def _json_strings(x: Column) -> Column:
    """JSON text of each of an array of strings."""
    return F.transform(x, lambda s: F.coalesce(F.regexp_extract(F.to_json(F.array(s)), r"(?s)^\[(.*)\]$", 1), F.lit("null")))


def cache_key(petitions: Column, hashes: Column, ids: Column) -> Column:
    """SHA-256 of the canonical request: JSON with sorted keys of petitions (structs of petition_id, donvi_id and noi_dung), file hashes and ids, in order."""
    shown = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    one = lambda p: F.concat(F.lit('{"KN_KIENNGHI.DONVI_TIEPNHAN": '), shown(p["donvi_id"]), F.lit(', "KN_KIENNGHI.ID": '), shown(p["petition_id"]), F.lit(', "KN_KIENNGHI.NOI_DUNG": '), F.get(_json_strings(F.array(p["noi_dung"])), 0), F.lit("}"))
    listed = lambda x: F.concat(F.lit("["), F.array_join(F.coalesce(x, F.array().cast("array<string>")), ", "), F.lit("]"))
    return F.sha2(F.concat(F.lit('{"data_list": '), listed(F.transform(petitions, one)), F.lit(', "file_hashes": '), listed(_json_strings(hashes)), F.lit(', "file_ids": '), listed(_json_strings(ids)), F.lit("}")), 256)


def keys_by_data(cache: DataFrame, data_list: str) -> DataFrame:
    """Keys of the cached results of a data_list (JSON text, as stored)."""
    return cache.filter(F.col("data_list") == data_list).select("cache_key")


def probe(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests with hit and result from the cache, unless force_reprocess."""
    joined = requests.join(cache.select("cache_key", "result"), "cache_key", "left")
    hit = F.col("result").isNotNull() & ~F.coalesce("force_reprocess", F.lit(False))
    return joined.withColumn("hit", hit).withColumn("result", F.when(hit, F.col("result")))


def job_status(status: Column) -> Column:
    return F.when(status == "succeeded", "FINISHED").when(status == "failed", "FAILED").otherwise("PROCESSING")


def job_states(events: DataFrame) -> DataFrame:
    """Latest state of each job (job_id, status, result, error, updated_at, seq); results of others than succeeded ones go."""
    now = latest(events, ["job_id"], ["updated_at", "seq"])
    return now.withColumn("result", F.when(F.col("status") == "succeeded", F.col("result"))).withColumn("api_status", job_status(F.col("status")))


def job_count(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count(F.lit(1)).alias("n_jobs"))


def newest_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc())


def fail_on_any(outcomes: DataFrame) -> None:
    """Raises if any row (file_ord, error) has an error, with their number and messages in order."""
    bad = outcomes.filter("error IS NOT NULL")
    n = bad.count()
    if n:
        first = [r["error"] for r in bad.orderBy("file_ord").limit(20).collect()]
        raise RuntimeError(f"{n} files failed: " + "; ".join(first))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """n_ok and n_failed of rows with an error column."""
    return outcomes.agg(F.count_if(F.col("error").isNull()).alias("n_ok"), F.count_if(F.col("error").isNotNull()).alias("n_failed"))


def dump_lines(jobs: DataFrame) -> DataFrame:
    """A readable value for each job (job_id, status, input, result, error, created_at, updated_at), newest first, for a text sink."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NULL"))
    stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("NULL"))
    head = [F.concat(F.lit(f"{c}: "), x) for c, x in (("job_id", shown("job_id")), ("status", shown("status")), ("created_at", stamp("created_at")), ("updated_at", stamp("updated_at")))]
    body = [F.concat(F.lit(f"{c.upper()}:\n"), shown(c)) for c in ("input", "result", "error")]
    return newest_first(jobs).select(F.concat_ws("\n", *head, *body, F.lit("")).alias("value"))
