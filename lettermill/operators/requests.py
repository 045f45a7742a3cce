"""Parsing and validation of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions import text as X

ITEM = "struct<`KN_KIENNGHI.ID`:string,`KN_KIENNGHI.DONVI_TIEPNHAN`:string,`KN_KIENNGHI.NOI_DUNG`:string>"

def data_list(raw: Column) -> Column:
    """Petitions of a request: an array, an object with data_list, or an array of JSON strings; null if none of these."""
    x = X.clean_json_text(raw)
    body = F.when(x.startswith("{"), F.get_json_object(x, "$.data_list")).otherwise(x)
    direct = F.from_json(body, f"array<{ITEM}>")
    nested = F.transform(F.from_json(body, "array<string>"), lambda s: F.from_json(s, ITEM))
    found = F.when(F.size(F.filter(direct, lambda p: p["KN_KIENNGHI.ID"].isNotNull())) > 0, direct).otherwise(nested)
    ready = F.transform(found, lambda p: F.struct(p["KN_KIENNGHI.ID"].try_cast("long").alias("petition_id"), p["KN_KIENNGHI.DONVI_TIEPNHAN"].try_cast("long").alias("donvi_id"), p["KN_KIENNGHI.NOI_DUNG"].alias("noi_dung")))
    complete = F.forall(ready, lambda p: p["petition_id"].isNotNull() & p["donvi_id"].isNotNull() & p["noi_dung"].isNotNull())
    return F.when((F.size(ready) > 0) & complete, ready)


def file_ids(raw: Column) -> Column:
    """Ids of a request: a JSON array of strings, a bare id or a list with commas; null if there is none, or if what starts as JSON isn't such an array."""
    x = X.clean_json_text(raw)
    listed = F.filter(F.transform(F.split(x, ","), lambda s: X.strip(F.regexp_replace(s, r"[\[\]{}\"']", ""))), lambda s: s != "")
    parsed = F.try_parse_json(x)
    one = X.outer_json(x) == X.strip(x)  # nothing behind it
    strings = F.when(one & (F.schema_of_variant(parsed) == "ARRAY<STRING>"), F.try_variant_get(parsed, "$", "array<string>"))
    whole = F.forall(strings, lambda s: F.coalesce(X.strip(s) != "", F.lit(False)))
    found = F.when(x.rlike(r"^[\[{]"), F.when(whole, strings)).otherwise(listed)
    return F.when(F.size(found) > 0, found)


def parse(requests: DataFrame) -> DataFrame:
    """requests (request_id, data_list, file_ids, n_files) with petitions, ids and reject (a code, null if good)."""
    out = requests.withColumns({"petitions": data_list(F.col("data_list")), "ids": file_ids(F.col("file_ids"))})
    reject = F.when(F.col("petitions").isNull(), "data_list").when(F.col("ids").isNull() | (F.size("ids") == 0), "file_ids").when(F.size("ids") != F.col("n_files"), "400")
    return out.withColumn("reject", reject)


def file_status(path: Column, mime: Column, length: Column, most: int = 50 << 20) -> Column:
    """HTTP status of an uploaded file: 415 no PDF, 413 too large, 400 empty, else 200."""
    pdf = F.lower(path).endswith(".pdf") | F.coalesce(mime == "application/pdf", F.lit(False))
    return F.when(~pdf, 415).when(length > most, 413).when(length == 0, 400).otherwise(200)


def is_uuid(x: Column) -> Column:
    return x.rlike("(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$")


def preview(x: Column, n: int = 80) -> Column:
    """The first n characters of a text, for messages."""
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("…"))).otherwise(x)
