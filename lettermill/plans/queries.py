"""The queries over the tables and the synthetic letters, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lettermill.functions import text as X
from lettermill.operators import answering, letters, matching, modelled, requests, statistics, store, units
from lettermill.plans import fixtures, surface
from lettermill.sources import files
from lettermill.sources.tables import shared_dir, spread, written
from lettermill.streaming import machine, windows


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def _letters(spark: SparkSession, d: str) -> DataFrame:
    """A letter for each customer, as OCR gives it, prepared."""
    return letters.prepared(spread(fixtures.customer_letters(_t(spark, d, "customer"))))


def _benchmark_petitions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("petition_id"), F.col("text").alias("noi_dung"))


def _document_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("pair_ord"), F.col("text").alias("noi_dung"))


def norm_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(X.tokens(F.col("text"))), " ").alias("tokens"))


def jaccard_best_match(spark: SparkSession, d: str) -> DataFrame:
    out = matching.best_of_all(_benchmark_petitions(spark, d), _document_pairs(spark, d))
    return out.select("petition_id", "pair_ord", F.round("score", 6).alias("score"))


def jaccard_threshold_match(spark: SparkSession, d: str) -> DataFrame:
    out = matching.best_matches(_benchmark_petitions(spark, d), _document_pairs(spark, d), 0.1)
    return out.select("petition_id", "pair_ord", F.round("score", 6).alias("score"))


def match_summary(spark: SparkSession, d: str) -> DataFrame:
    return matching.summary(matching.best_matches(_benchmark_petitions(spark, d), _document_pairs(spark, d), 0.1))


def donvi_semi_filter(spark: SparkSession, d: str) -> DataFrame:
    people = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("donvi_id"))
    found = _t(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("donvi_id"))
    return matching.keep_units(people, found).select("c_custkey")


def donvi_guard_empty(spark: SparkSession, d: str) -> DataFrame:
    people = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("donvi_id"))
    return matching.keep_units(people, _t(spark, d, "nation").filter("n_regionkey < 0").select(F.col("n_nationkey").alias("donvi_id"))).select("c_custkey")


def turn_pairs_asof(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    asked = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return _t(spark, d, "conversations").withColumn("asked", asked).filter("role = 'assistant' AND asked IS NOT NULL").select("conv_id", "turn", "asked")


def turn_stop_boundary(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    stop = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    return _t(spark, d, "conversations").withColumn("stop", stop).filter("role = 'assistant'").select("conv_id", "turn", "stop")


def section_slice_agg(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, d, "conversations").withColumn("section", F.sum((F.col("role") == "user").cast("long")).over(w)).filter("section > 0 AND role <> 'user'")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return rows.groupBy("conv_id", "section").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("body"))


def segment_units(spark: SparkSession, d: str) -> DataFrame:
    out = units.segment_units(_t(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "unit_no", "idx", F.length("text").alias("n_chars"))


def header_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "documents").select("doc_id", F.posexplode(X.lines(F.regexp_replace("text", r"(?m)^(De|The|En) ", "# $1 "))).alias("ln", "line"))
    return lines.filter(X.is_header(F.col("line"))).select("doc_id", "ln", "line")


def has_structure(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", X.has_structure(F.col("text")).alias("structured"))


def head_tail_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = X.lines(F.col("text"))
    tail = F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 39), 40)
    return _t(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.md5(F.array_join(F.slice(lines, 1, 50), "\n")).alias("head"), F.md5(F.array_join(tail, "\n")).alias("tail"))


def letter_numbers(spark: SparkSession, d: str) -> DataFrame:
    return letters.letter_metadata(_letters(spark, d))


def fmt_classify(spark: SparkSession, d: str) -> DataFrame:
    return letters.classify(_letters(spark, d))


def extract_pairs(spark: SparkSession, d: str) -> DataFrame:
    return letters.pairs(_letters(spark, d)).withColumn("pair_ord", F.col("pair_ord").cast("long"))


def donvi_lookup(spark: SparkSession, d: str) -> DataFrame:
    return letters.delegation_ids(_letters(spark, d), fixtures.PROVINCES)


def letter_matches(spark: SparkSession, d: str) -> DataFrame:
    pairs = letters.pairs(_letters(spark, d)).withColumn("pair_ord", F.col("doc_id") * 10_000_000 + F.col("pair_ord"))
    return matching.best_matches(fixtures.customer_petitions(_t(spark, d, "customer")), pairs).select("petition_id", "pair_ord", F.round("score", 6).alias("score"))


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Six units for each customer, and three kinds of model answers by custkey % 3."""
    k = F.col("c_custkey")
    people = spread(_t(spark, d, "customer")).select(k.cast("long").alias("doc_id"), (k % 3).alias("kind"))
    u = people.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("unit_no")).select("doc_id", "unit_no", F.concat(F.lit("U"), "unit_no").alias("unit_id"), (F.col("unit_no") - 1).alias("idx"), F.lit("x").alias("text"))
    said = lambda *x: F.when(F.col("kind") == 0, x[0]).when(F.col("kind") == 1, x[1]).otherwise(x[2])
    kn, tl = said('[["U2"],["U3","U99"],["U4","U2"]]', 'So: [["U1"],["U2"]] and more', '[["U1"],["U4"]]'), said('```json\n[["U6","U5"]]\n```', '[["U4"],["U5","U6"]]', '[["U2"]]')
    answers = people.select("doc_id", F.explode(F.map_from_arrays(F.array(F.lit("KN"), F.lit("TL")), F.array(kn, tl))).alias("label", "answer"))
    return units.group_refs(answers), u


def group_validate(spark: SparkSession, d: str) -> DataFrame:
    g = units.resolve_groups(*_groups(spark, d))
    return g.select("doc_id", "label", F.col("group_ord").cast("long").alias("group_ord"), F.array_join("unit_ids", ",").alias("unit_ids"), "in_order", "contiguous")


def discarded_units(spark: SparkSession, d: str) -> DataFrame:
    return units.discarded_units(*_groups(spark, d)).select("doc_id", "unit_id")


def balance_merge(spark: SparkSession, d: str) -> DataFrame:
    g = units.balance_groups(units.resolve_groups(*_groups(spark, d)))
    return g.select("doc_id", "label", F.col("group_ord").cast("long").alias("group_ord"), F.array_join("unit_ids", ",").alias("unit_ids"), "warning")


def file_sha256(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def cache_key(spark: SparkSession, d: str) -> DataFrame:
    asked = F.array(F.struct(F.col("doc_id").alias("petition_id"), (F.col("doc_id") % 7).alias("donvi_id"), F.col("text").alias("noi_dung")))
    return _t(spark, d, "documents").select("doc_id", store.cache_key(asked, F.array(F.sha2("text", 256)), F.array(F.col("source"), F.lit("a,b"))).alias("cache_key"))


def cache_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return store.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def cache_probe(spark: SparkSession, d: str) -> DataFrame:
    docs, known = _t(spark, d, "documents"), _t(spark, d, "labels")
    asked = docs.select("doc_id", F.col("doc_id").alias("cache_key"), (F.col("source") == "src1").alias("force_reprocess"))
    cache = known.select(F.col("doc_id").alias("cache_key"), F.col("quality").cast("string").alias("result"))
    return store.probe(asked, cache).select("doc_id", "hit", "result")


def job_status_map(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "failed").otherwise("processing")
    return _t(spark, d, "orders").groupBy(store.job_status(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def jobs_newest_first(spark: SparkSession, d: str) -> DataFrame:
    return store.newest_first(_t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("created_at"))).select("o_orderkey")


def pending_anti(spark: SparkSession, d: str) -> DataFrame:
    return files.pending(_t(spark, d, "documents"), _t(spark, d, "labels"), key="doc_id").select("doc_id")


def parse_requests(spark: SparkSession, d: str) -> DataFrame:
    """A request for each customer, good and bad by custkey % 8."""
    k = F.col("c_custkey")
    kinds = lambda *x: F.get(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in x]), (k % 8).cast("int"))
    one = F.to_json(F.struct(k.alias("KN_KIENNGHI.ID"), F.col("c_nationkey").cast("string").alias("KN_KIENNGHI.DONVI_TIEPNHAN"), F.col("c_name").alias("KN_KIENNGHI.NOI_DUNG")))
    plain = F.concat(F.lit("["), one, F.lit("]"))
    data = kinds(plain, F.concat(F.lit('{"data_list":'), plain, F.lit("}")), "no json", "[]", plain, F.concat(F.lit("```json\n"), plain, F.lit("\n```")), F.to_json(F.array(one)), plain)
    ids = kinds("F1", F.concat(F.lit("F"), k.cast("string"), F.lit(", F2")), "F1", "F1", '["F1"], ["F2"]', '["F1"]', '["F\\"1","\\u0046,2"]', "[1]")
    out = requests.parse(_t(spark, d, "customer").select(k.alias("request_id"), data.alias("data_list"), ids.alias("file_ids"), kinds(*map(F.lit, (1, 2, 1, 1, 2, 2, 2, 1))).alias("n_files")))
    return out.select("request_id", F.get("petitions", 0)["noi_dung"].alias("noi_dung"), F.array_join("ids", "|").alias("ids"), "reject")


def upload_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    path, mime = F.concat(F.lit("in/"), k.cast("string"), F.when(k % 3 == 0, ".PDF").when(k % 3 == 1, ".bin").otherwise(".pdf")), F.when(k % 2 == 0, "application/pdf")
    uuid = F.when(k % 5 == 0, "x").otherwise(F.expr("concat(substr(md5(cast(o_orderkey AS string)), 1, 8), '-', substr(md5('a'), 1, 4), '-', substr(md5('b'), 1, 4), '-', substr(md5('c'), 1, 4), '-', substr(md5('d'), 1, 12))"))
    length = (F.col("o_totalprice") * 1000).cast("long") * (k % 10)
    return _t(spark, d, "orders").select(k, requests.file_status(path, mime, length).alias("status"), requests.is_uuid(uuid).alias("known"), F.length(requests.preview(F.repeat(F.lit("x"), (k % 100).cast("int")))).alias("shown"))


def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.outcome_counts(_t(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "late").alias("error")))


def job_count(spark: SparkSession, d: str) -> DataFrame:
    return store.job_count(_t(spark, d, "orders"))


def job_dump(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.col("o_orderdate").cast("timestamp")
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.lit("[]").alias("input"), F.col("o_orderpriority").alias("result"), F.lit(None).cast("string").alias("error"), stamp.alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    return store.dump_lines(rows)


def misread_and_lines(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("- (1) ḗ ṓ "), "c_name", F.lit("\n## 2. Ḗ Ṓ "), "c_mktsegment")
    return _t(spark, d, "customer").select("c_custkey", X.fix_misread(text).alias("fixed"), X.clean_line(X.fix_misread(text)).alias("plain"))


def files_by_name(spark: SparkSession, d: str) -> DataFrame:
    return files.by_name(_t(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path")))


def clean_text_block(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("cleaned"), F.md5(X.clean_block(F.col("text"))).alias("block"))


def footnote_clean(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("Bộ đã trả lời việc "), k, F.lit("\n> Chú thích "), k, F.lit("\n\nvà nêu rõ.\n> Chú thích cuối\n> trang\nHết "), "c_mktsegment")
    return _t(spark, d, "customer").select("c_custkey", X.remove_footnotes(text).alias("text"))


def letter_entities(spark: SparkSession, d: str) -> DataFrame:
    return letters.entities(_letters(spark, d))


def markdown_forms(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("### Mục **"), "c_mktsegment", F.lit("**\nsnake_case_"), "c_name", F.lit(" [xem *tại*](b(c)d) đây\n\n(I)** Về a\\*b &amp; `x`\n1. một #### hai\n\n> trích\n> dẫn"))
    return _t(spark, d, "customer").select("c_custkey", X.strip_markdown(text).alias("plain"), X.normalize_markdown(text).alias("tidy"))


def model_groups(spark: SparkSession, d: str) -> DataFrame:
    free = fixtures.customer_letters(spread(_t(spark, d, "customer")).filter("c_custkey % 4 = 3"), header=False)
    out = modelled.extract(free.select("doc_id", "text"), fixtures.customer_model)
    return out.select("doc_id", F.col("n_units").cast("long").alias("n_units"), F.array_join("kien_nghi", "|").alias("kien_nghi"), F.array_join("tra_loi", "|").alias("tra_loi"), F.array_join("warnings", "|").alias("warnings"))


def _job(spark: SparkSession, d: str) -> DataFrame:
    people = spread(_t(spark, d, "customer"))
    return answering.answer(fixtures.customer_petitions(people), fixtures.customer_letters(people), fixtures.PROVINCES)


def job_answers(spark: SparkSession, d: str) -> DataFrame:
    first = F.get("answers", 0)
    out = answering.formatted(_job(spark, d), plain_text=True)
    return out.select(F.col("`KN_KIENNGHI.ID`").alias("petition_id"), first["file_id"].alias("file_id"), first["content"].alias("content"), first["metadata"]["so_cong_van"].alias("so_cong_van"))


def job_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """job_answers without formatting, written in SQL over the views of its stages."""
    people = spread(_t(spark, d, "customer"))
    out = surface.job_in_sql(fixtures.customer_letters(people), fixtures.customer_petitions(people), fixtures.PROVINCES)
    first = F.get("answers", 0)
    return out.select(F.col("`KN_KIENNGHI.ID`").alias("petition_id"), first["file_id"].alias("file_id"), first["content"].alias("content"), first["metadata"]["so_cong_van"].alias("so_cong_van"))


def similarity_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """The functions for SQL over the tables: similarity of each labelled document to its lang's and source's names."""
    surface.register(spark)
    _t(spark, d, "documents").createOrReplaceTempView("surface_documents")
    return spark.sql("SELECT doc_id, size(word_set(text)) AS n_words, round(set_similarity(word_set(text), word_set(concat('The ', lang, ' of and in ', source))), 9) AS similarity FROM surface_documents")


def job_totals(spark: SparkSession, d: str) -> DataFrame:
    return answering.totals(_job(spark, d))


def log_job_stats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    level = F.when(k % 5 == 0, "ERROR").otherwise("INFO")
    line = F.when(k % 9 == 0, "no log line").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), level, F.lit("] [pipeline:"), k.cast("string"), F.lit("] - done in 7 s")))
    return files.parse_log(_t(spark, d, "orders").select(line.alias("value"))).groupBy("level", F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last"))


def fmt_rollup(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").withColumn("fmt", F.when(X.has_structure(F.col("text")), "md").otherwise("plain"))
    return docs.rollup("lang", "fmt").agg(F.count(F.lit(1)).alias("n"))


def event_window(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def corpus_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Units of documents by lang and source, in eight batches whose sketches are kept and merged; whether the estimates are within
    three standard errors (distinct texts) and 3 % of the ranks (median length) of the exact ones."""
    docs = _t(spark, d, "documents")
    numbered = written(units.segment_units(docs.select("doc_id", "text")).join(docs.select("doc_id", "lang", "source"), "doc_id"))
    size, batch = F.length("text"), F.pmod("doc_id", F.lit(8)).alias("batch")
    kept = written(statistics.sketches(numbered.withColumn("batch", batch), ["batch", "lang", "source"], F.col("text"), size))
    found = statistics.merged(kept, [["lang", "source"], ["lang"], []])
    sets = [[F.col("lang"), F.col("source")], [F.col("lang")], []]
    exact = numbered.groupingSets(sets, "lang", "source").agg((F.grouping("lang") + F.grouping("source")).cast("int").alias("level"), F.countDistinct("text").alias("kinds"), F.percentile(size, F.array(*map(F.lit, (0.3, 0.47, 0.53, 0.7)))).alias("near"))
    same = lambda c: found[c].eqNullSafe(exact[c])
    both = found.join(exact, same("level") & same("lang") & same("source"))
    close = F.abs(found["distinct"] - exact["kinds"]) <= F.greatest(3 * 1.04 / 2 ** (statistics.DISTINCT_BITS / 2) * exact["kinds"], F.lit(1.0))
    few = found["n"] < 100  # a row more or less is more than 3 %
    middle = found["q50"].between(F.floor(F.when(few, exact["near"][0]).otherwise(exact["near"][1])), F.ceil(F.when(few, exact["near"][3]).otherwise(exact["near"][2])))
    return both.select(found["level"], found["lang"], found["source"], found["n"], exact["kinds"], close.alias("distinct_close"), middle.alias("median_close"))


def cached_keys(spark: SparkSession, d: str) -> DataFrame:
    cache = _t(spark, d, "orders").select(F.col("o_orderkey").alias("cache_key"), F.to_json(F.array("o_orderpriority")).alias("data_list"))
    return store.keys_by_data(cache, '["1-URGENT"]')


def unit_prompts(spark: SparkSession, d: str) -> DataFrame:
    return units.prompts(units.segment_units(_t(spark, d, "documents").select("doc_id", "text"))).select("doc_id", F.md5("prompt").alias("prompt"))


def ocr_forms(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files: OCR to JSON (every seventh fails), rendering (every third is blank), and what stands in for it."""
    pages = _t(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode(F.concat_ws(" ", F.col("page_id").cast("string"), "url"), "UTF-8").alias("content"))
    read = files.canonical(pages, fixtures.page_ocr, tries=1)
    made = files.rendered(read, fixtures.page_render, tries=1)
    errors = read.select("path", F.col("error").isNotNull().alias("failed"))
    shown = made.select("path", F.coalesce(files.rendered_or_plain(), F.col("content")).alias("text"))
    return errors.join(shown, "path", "left").select(F.col("path").cast("long").alias("page_id"), "failed", "text")


def petitions_kept(spark: SparkSession, d: str) -> DataFrame:
    """A job whose dictionary lacks five provinces: petitions of these have no answers, and stay."""
    people = spread(_t(spark, d, "customer"))
    known = {k: v for k, v in fixtures.PROVINCES.items() if v > 5}
    out = answering.answer(fixtures.customer_petitions(people), fixtures.customer_letters(people), known, keep_filtered=True)
    return out.select(F.col("`KN_KIENNGHI.ID`").alias("petition_id"), F.get("answers", 0)["file_id"].alias("file_id"))


def event_sliding(spark: SparkSession, d: str) -> DataFrame:
    """A stream over events: one-hour windows, one of which begins every half hour."""
    rows = windows.latest_windows(spark, windows.sliding_counts(windows.stream_of(spark, f"{d}/events.parquet")), ["begin", "event_type"])
    return rows.select(F.date_format("begin", "yyyy-MM-dd HH:mm").alias("begin"), "event_type", "n")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """A stream over events: sessions of users, half an hour apart."""
    rows = windows.latest_windows(spark, windows.session_counts(windows.stream_of(spark, f"{d}/events.parquet")), ["user_id", "begin"], "complete")
    return rows.select("user_id", F.date_format("begin", "yyyy-MM-dd HH:mm:ss").alias("begin"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


def job_machine(spark: SparkSession, d: str) -> DataFrame:
    """The state machine over a stream of lineitem: each order is a job, its lines are messages."""
    lines = windows.stream_of(spark, f"{d}/lineitem.parquet")
    status = F.when(F.col("l_linestatus") == "F", "succeeded").when(F.col("l_returnflag") == "R", "failed").otherwise("processing")
    at, seq = F.col("l_shipdate").cast("timestamp"), F.col("l_linenumber").cast("long") * 8 + F.when(F.col("l_linestatus") == "F", 4).otherwise(0) + F.instr(F.lit("ANR"), F.col("l_returnflag"))
    events = lines.select(F.col("l_orderkey").cast("string").alias("job_id"), status.alias("status"), F.col("l_linenumber").cast("string").alias("result"), F.lit(None).cast("string").alias("error"), at.alias("updated_at"), seq.alias("seq"))
    out, checkpoint = shared_dir(spark), shared_dir(spark)
    machine.run_machine(events, out, checkpoint, late="100000 days", stall=1 << 45).awaitTermination()
    states = machine.current_states(spark.read.schema(f"{machine.CHANGE}, batch long").option("basePath", out).parquet(out))
    return states.select(F.col("job_id").cast("long").alias("job_id"), "api_status", "result", "seq")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        norm_tokens, jaccard_best_match, jaccard_threshold_match, match_summary, donvi_semi_filter, donvi_guard_empty, turn_pairs_asof, turn_stop_boundary, section_slice_agg, segment_units,
        header_lines, has_structure, head_tail_lines, letter_numbers, fmt_classify, extract_pairs, donvi_lookup, letter_matches, group_validate, discarded_units, balance_merge, file_sha256,
        cache_key, cache_upsert_latest, cache_probe, job_status_map, jobs_newest_first, pending_anti, parse_requests, clean_text_block, log_job_stats, fmt_rollup, event_window,
        footnote_clean, letter_entities, markdown_forms, model_groups, job_answers, job_totals, upload_status, outcome_counts, job_count, job_dump, misread_and_lines, files_by_name, cached_keys, unit_prompts, ocr_forms, petitions_kept, corpus_sketches, event_sliding, event_sessions, job_machine, job_in_sql, similarity_in_sql,
    )
}

_TOKENS = "list_distinct(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+'))"
_SCORES = f"""
    WITH p AS (SELECT item_id, unnest({_TOKENS}) AS t, len({_TOKENS}) AS n FROM benchmark),
    q AS (SELECT doc_id, unnest({_TOKENS}) AS t, len({_TOKENS}) AS n FROM documents),
    s AS (SELECT item_id, doc_id, count(*) / CAST(any_value(p.n) + any_value(q.n) - count(*) AS DOUBLE) AS score FROM p JOIN q USING (t) GROUP BY item_id, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s)"""
_LINES = r"regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
_NUMBERED = f"SELECT doc_id, unnest(l) AS line, unnest(generate_series(0, len(l) - 1)) AS ln FROM (SELECT doc_id, {_LINES} AS l FROM documents)"

_MARKED = r"FROM (SELECT doc_id, regexp_replace(text, '(^|\n)(De|The|En) ', '\1# \2 ', 'g') AS text FROM documents) marked"

_WS = r"[\s\v\pZ\x{85}]"
_CUES = r"(Đề nghị|Kiến nghị|Đồng thời[, ]+đề nghị|Ngoài ra,?\s*đề nghị|Bên cạnh đó,?\s*đề nghị)([^\pL\pN_]|$)"
_ROW = f"regexp_replace(r, '^{_WS}+|{_WS}+$', '', 'g')"
_PIECES = rf"CASE WHEN {_ROW} = '' OR regexp_matches({_ROW}, '^#{{1,6}}\s') THEN [{_ROW}] ELSE list_filter(string_split(regexp_replace({_ROW}, '([.;])\s*{_CUES}', '\1' || chr(1) || '\2\3', 'g'), chr(1)), lambda p: trim(p) <> '') END"

_IN = r"[\t\v\f\r \pZ\x{85}]"  # white space within a line
_BLANK = r"[ \t\v\f\r]"


def _replaced(x: str, *steps: tuple[str, str]) -> str:
    """SQL that replaces one pattern after the other."""
    for pattern, by in steps:
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return x


_ENDS = (rf"(?m)^{_IN}+|{_IN}+$", "''")
_CLEANED = _replaced(
    "text", (r"\r\n|[\n\r\v\f\x1c-\x1e\x{85}\x{2028}\x{2029}]", "chr(10)"), _ENDS, (r"(?m)^(?:#+[ \t]*|\*\*|\*|_+|>[ \t]*)", "''"), (r"(?m)^[ *_#>]+|[ *_#>]+$", "''"), ("<br>|<br/>|</br>", "' '"),
    (r"<sup>[^<\n]*</sup>", "''"), (f"{_IN}+", "' '"), _ENDS, (r"\n{3,}", "chr(10) || chr(10)"), (r"^\n+|\n+\z", "''"),
)
_LINES_CLEANED = _replaced("text", (rf"(?m)^{_BLANK}*[-*•◦▪▸]{_BLANK}+", "''"), (rf"(?m)^#{{1,6}}{_BLANK}*", "''"), (rf"(?m)^\d{{1,3}}{_BLANK}*[.．)\]]{_BLANK}+", "''"), _ENDS, (r"\n{2,}", "chr(10) || chr(10)"), (r"^\n+", "''"))
_BLOCK = _replaced(f"translate({_LINES_CLEANED}, '”“\"''‘’*_', '')", (r"[ \t]+", "' '"), (rf"^{_WS}+|{_WS}+\z", "''"))

ORACLE_SQL: dict[str, str] = {
    "clean_text_block": f"SELECT doc_id, md5({_CLEANED}) AS cleaned, md5({_BLOCK}) AS block FROM documents",
    "norm_tokens": f"SELECT doc_id, array_to_string(list_sort({_TOKENS}), ' ') AS tokens FROM documents",
    "jaccard_best_match": f"{_SCORES} SELECT b.item_id AS petition_id, coalesce(r.doc_id, (SELECT min(doc_id) FROM documents)) AS pair_ord, round(coalesce(score, 0.0), 6) AS score FROM benchmark b LEFT JOIN r ON r.item_id = b.item_id AND k = 1",
    "jaccard_threshold_match": f"{_SCORES} SELECT b.item_id AS petition_id, r.doc_id AS pair_ord, round(score, 6) AS score FROM benchmark b LEFT JOIN r ON r.item_id = b.item_id AND k = 1 AND score >= 0.1",
    "match_summary": f"{_SCORES} SELECT count(r.doc_id) AS matched_count, count(*) - count(r.doc_id) AS unmatched_count FROM benchmark b LEFT JOIN r ON r.item_id = b.item_id AND k = 1 AND score >= 0.1",
    "donvi_semi_filter": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "donvi_guard_empty": "SELECT c_custkey FROM customer",
    "turn_pairs_asof": "SELECT * FROM (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS asked FROM conversations) x WHERE asked IS NOT NULL",
    "turn_stop_boundary": "SELECT conv_id, turn, stop FROM (SELECT conv_id, turn, role, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM conversations) x WHERE role = 'assistant'",
    "section_slice_agg": "SELECT conv_id, section, string_agg(text, chr(10) ORDER BY turn) AS body FROM (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS section FROM conversations) x WHERE section > 0 AND role <> 'user' GROUP BY conv_id, section",
    "header_lines": f"SELECT doc_id, CAST(ln AS INTEGER) AS ln, line FROM ({_NUMBERED.replace('FROM documents', _MARKED)}) x WHERE regexp_matches(line, '^\\s*(#|\\*\\*|Kính gửi|Số:|-)')",
    "has_structure": r"SELECT doc_id, contains(text, '**') OR regexp_matches(text, '(?m)^\s*#') AS structured FROM documents",
    "head_tail_lines": f"SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, md5(array_to_string(l[1:50], chr(10))) AS head, md5(array_to_string(l[greatest(1, len(l) - 39):len(l)], chr(10))) AS tail FROM (SELECT doc_id, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM (SELECT doc_id, {_LINES} AS l FROM documents) x) y",
    "letter_numbers": """SELECT c_custkey AS doc_id, c_custkey || '/BXD-QLN' AS so_cong_van,
        CASE WHEN c_custkey % 7 > 0 THEN lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '/2025' END AS ngay_ban_hanh,
        CASE c_custkey % 4 WHEN 0 THEN 'Bộ trưởng Lê Thị Mẫu' WHEN 1 THEN 'Bộ trưởng' END AS nguoi_ky FROM customer""",
    "fmt_classify": "SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'f1' WHEN 1 THEN 'f2' WHEN 2 THEN 'f3' ELSE 'llm' END AS label FROM customer",
    "donvi_lookup": "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 11 > 0 THEN c_nationkey + 1 END AS donvi_id FROM customer",
    "letter_matches": "SELECT c_custkey AS petition_id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 10000000 END AS pair_ord, CASE WHEN c_custkey % 4 = 0 THEN CAST(0.875 AS DOUBLE) END AS score FROM customer",
    "group_validate": "SELECT c_custkey AS doc_id, label, CAST(g AS BIGINT) AS group_ord, ids AS unit_ids, o AS in_order, true AS contiguous FROM customer JOIN (VALUES (0, 'KN', 0, 'U2', true), (0, 'KN', 1, 'U3', true), (0, 'KN', 2, 'U4', true), (0, 'TL', 0, 'U5,U6', false), (1, 'KN', 0, 'U1', true), (1, 'KN', 1, 'U2', true), (1, 'TL', 0, 'U4', true), (1, 'TL', 1, 'U5,U6', true), (2, 'KN', 0, 'U1', true), (2, 'KN', 1, 'U4', true), (2, 'TL', 0, 'U2', true)) t(kind, label, g, ids, o) ON c_custkey % 3 = kind",
    "discarded_units": "SELECT c_custkey AS doc_id, u AS unit_id FROM customer JOIN (VALUES (0, 'U1'), (1, 'U3'), (2, 'U3'), (2, 'U5'), (2, 'U6')) t(kind, u) ON c_custkey % 3 = kind",
    "balance_merge": "SELECT c_custkey AS doc_id, label, CAST(g AS BIGINT) AS group_ord, ids AS unit_ids, w AS warning FROM customer JOIN (VALUES (0, 'KN', 1, 'U2,U3,U4', 'CAN_BANG'), (0, 'TL', 1, 'U5,U6', 'CAN_BANG'), (1, 'KN', 1, 'U1', NULL), (1, 'KN', 2, 'U2', NULL), (1, 'TL', 1, 'U4', NULL), (1, 'TL', 2, 'U5,U6', NULL), (2, 'KN', 1, 'U1', 'MISMATCH'), (2, 'KN', 2, 'U4', 'MISMATCH'), (2, 'TL', 1, 'U2', 'MISMATCH')) t(kind, label, g, ids, w) ON c_custkey % 3 = kind",
    "segment_units": f"""
        WITH p AS (SELECT doc_id, flatten(list_transform(string_split(regexp_replace(coalesce(text, ''), '^{_WS}+|{_WS}+$', '', 'g'), chr(10)), lambda r: {_PIECES})) AS p FROM documents),
        u AS (SELECT doc_id, unnest(p) AS text, unnest(generate_series(0, len(p) - 1)) AS idx FROM p)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS INTEGER) AS unit_no, CAST(idx AS INTEGER) AS idx, CAST(length(text) AS INTEGER) AS n_chars FROM u WHERE text <> ''""",
    "extract_pairs": """WITH c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS s, CAST(c_custkey + 1 AS VARCHAR) AS n, lower(c_mktsegment) AS m FROM customer)
        SELECT k AS doc_id, 'f1' AS label, CAST(0 AS BIGINT) AS pair_ord, 'Việc ' || s || 'a ' || s || 'b ' || s || 'c ' || s || 'd ' || s || 'e tại chỗ.' AS noi_dung, 'Bộ đã xem xét việc ' || s || ' và trả lời như sau.' AS tra_loi FROM c WHERE k % 4 = 0
        UNION ALL SELECT k, 'f2', 0, 'Xây cầu ' || s || '.', 'Đang lập dự án ' || s || '.' FROM c WHERE k % 4 = 1 UNION ALL SELECT k, 'f2', 100000, 'Sửa đường ' || s || '.', 'Đã bố trí vốn cho ' || m || '.' FROM c WHERE k % 4 = 1
        UNION ALL SELECT k, 'f3', 0, '(1) Kiến nghị số ' || s || ': Tăng bác sĩ.', 'Mở đầu ' || s || '.' || chr(10) || 'Sẽ tăng biên chế.' FROM c WHERE k % 4 = 2
        UNION ALL SELECT k, 'f3', 1, '(2) Kiến nghị số ' || n || ': Mua máy.', 'Sẽ mua máy ' || m || '.' FROM c WHERE k % 4 = 2""",
    "letter_entities": "SELECT c_custkey AS doc_id, CASE WHEN ok THEN 'Bộ Xây dựng' END AS bo, CASE WHEN ok THEN 'Đoàn đại biểu Quốc hội tỉnh Vùng ' || chr(c_nationkey + 65) END AS daibieu FROM (SELECT *, c_custkey % 2 = 0 AND c_custkey % 11 > 0 AS ok FROM customer) x",
    "markdown_forms": """SELECT c_custkey, 'Mục ' || c_mktsegment || chr(10) || chr(10) || 'snake_case_' || c_name || ' xem tại đây' || chr(10) || chr(10) || '(I) Về a*b & x 1. một hai' || chr(10) || chr(10) || 'trích dẫn' AS plain,
        '### Mục **' || c_mktsegment || '**' || chr(10) || 'snake_case_' || c_name || ' [xem *tại*](b(c)d) đây' || chr(10) || chr(10) || '(I) Về a\\*b &amp; `x`' || chr(10) || '1. một hai' || chr(10) || chr(10) || '> trích' || chr(10) || '> dẫn' AS tidy FROM customer""",
    "model_groups": """SELECT c_custkey AS doc_id, CAST(5 AS BIGINT) AS n_units, 'Cử tri phản ánh việc ' || c_custkey || '.' || chr(10) || chr(10) || 'Đề nghị giảm giá;' || chr(10) || chr(10) || 'Kiến nghị minh bạch ' || lower(c_mktsegment) || '.' AS kien_nghi,
        '(1) Về ' || lower(c_mktsegment) || chr(10) || chr(10) || 'Giá ' || c_custkey || ' được điều chỉnh.' AS tra_loi, 'VALIDATE: KN unknown unit: U77|VALIDATE: TL put in order: U4,U5|CAN_BANG' AS warnings FROM customer WHERE c_custkey % 4 = 3""",
    "job_answers": "SELECT c_custkey AS petition_id, CASE WHEN ok THEN 'FILE_' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS file_id, CASE WHEN ok THEN 'Bộ đã xem xét việc ' || c_custkey || ' và trả lời như sau.' END AS content, CASE WHEN ok THEN c_custkey || '/BXD-QLN' END AS so_cong_van FROM (SELECT *, c_custkey % 4 = 0 AS ok FROM customer) x",
    "job_in_sql": "SELECT c_custkey AS petition_id, CASE WHEN ok THEN 'FILE_' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS file_id, CASE WHEN ok THEN 'Bộ đã xem xét việc ' || c_custkey || ' và trả lời như sau.' END AS content, CASE WHEN ok THEN c_custkey || '/BXD-QLN' END AS so_cong_van FROM (SELECT *, c_custkey % 4 = 0 AS ok FROM customer) x",
    "similarity_in_sql": f"""WITH w AS (SELECT doc_id, {_TOKENS} AS a, {_TOKENS.replace("lower(text)", "lower('The ' || lang || ' of and in ' || source)")} AS b FROM documents)
        SELECT doc_id, CAST(len(a) AS INTEGER) AS n_words, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) END, 9) AS similarity FROM w""",
    "job_totals": "SELECT count(*) FILTER (c_custkey % 4 = 0) AS matched_count, count(*) FILTER (c_custkey % 4 <> 0) AS unmatched_count FROM customer",
    "footnote_clean": "SELECT c_custkey, 'Bộ đã trả lời việc ' || c_custkey || ' và nêu rõ.' || chr(10) || 'Hết ' || c_mktsegment AS text FROM customer",
    "file_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "cache_key": """SELECT doc_id, sha256('{"data_list": [{"KN_KIENNGHI.DONVI_TIEPNHAN": ' || doc_id % 7 || ', "KN_KIENNGHI.ID": ' || doc_id || ', "KN_KIENNGHI.NOI_DUNG": ' || to_json(text) || '}], "file_hashes": ["' || sha256(text) || '"], "file_ids": ["' || source || '", "a,b"]}') AS cache_key FROM documents""",
    "cache_upsert_latest": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k = 1",
    "cache_probe": "SELECT d.doc_id, l.doc_id IS NOT NULL AND source <> 'src1' AS hit, CASE WHEN source <> 'src1' THEN CAST(quality AS VARCHAR) END AS result FROM documents d LEFT JOIN labels l USING (doc_id)",
    "job_status_map": "SELECT CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'P' THEN 'FAILED' ELSE 'PROCESSING' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "jobs_newest_first": "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC",
    "pending_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "parse_requests": """SELECT c_custkey AS request_id, CASE WHEN c_custkey % 8 NOT IN (2, 3) THEN c_name END AS noi_dung,
        CASE c_custkey % 8 WHEN 1 THEN 'F' || c_custkey || '|F2' WHEN 4 THEN NULL WHEN 6 THEN 'F"1|F,2' WHEN 7 THEN NULL ELSE 'F1' END AS ids, CASE c_custkey % 8 WHEN 2 THEN 'data_list' WHEN 3 THEN 'data_list' WHEN 4 THEN 'file_ids' WHEN 5 THEN '400' WHEN 7 THEN 'file_ids' END AS reject FROM customer""",
    "log_job_stats": """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'ERROR' ELSE 'INFO' END AS level, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, CAST(max(o_orderkey) AS INTEGER) AS last FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY 1, 2""",
    "fmt_rollup": r"SELECT lang, CASE WHEN contains(text, '**') OR regexp_matches(text, '(?m)^\s*#') THEN 'md' ELSE 'plain' END AS fmt, count(*) AS n FROM documents GROUP BY ROLLUP (lang, 2)".replace("ROLLUP (lang, 2)", "ROLLUP (lang, CASE WHEN contains(text, '**') OR regexp_matches(text, '(?m)^\\s*#') THEN 'md' ELSE 'plain' END)"),
    "event_window": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "cached_keys": "SELECT o_orderkey AS cache_key FROM orders WHERE o_orderpriority = '1-URGENT'",
    "unit_prompts": f"""
        WITH p AS (SELECT doc_id, flatten(list_transform(string_split(regexp_replace(coalesce(text, ''), '^{_WS}+|{_WS}+$', '', 'g'), chr(10)), lambda r: {_PIECES})) AS p FROM documents),
        u AS (SELECT doc_id, unnest(p) AS text, unnest(generate_series(0, len(p) - 1)) AS idx FROM p),
        n AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS unit_no FROM u WHERE text <> '')
        SELECT doc_id, md5(string_agg('[U' || unit_no || '] ' || text, chr(10) || chr(10) ORDER BY unit_no)) AS prompt FROM n GROUP BY doc_id""",
    "ocr_forms": "SELECT page_id, page_id % 7 = 0 AS failed, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 'read' || chr(10) || page_id || ' ' || url ELSE '# ' || page_id || chr(10) || 'read' END AS text FROM pages",
    "petitions_kept": "SELECT c_custkey AS petition_id, CASE WHEN c_custkey % 4 = 0 AND c_nationkey + 1 > 5 THEN 'FILE_' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS file_id FROM customer",
    "corpus_sketches": f"""
        WITH p AS (SELECT doc_id, lang, source, flatten(list_transform(string_split(regexp_replace(coalesce(text, ''), '^{_WS}+|{_WS}+$', '', 'g'), chr(10)), lambda r: {_PIECES})) AS p FROM documents),
        u AS (SELECT lang, source, unnest(p) AS text FROM p)
        SELECT CAST(grouping(lang) + grouping(source) AS INTEGER) AS level, lang, source, count(*) AS n, count(DISTINCT text) AS kinds, true AS distinct_close, true AS median_close FROM u WHERE text <> '' GROUP BY GROUPING SETS ((lang, source), (lang), ())""",
    "event_sliding": """WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS begin FROM events)
        SELECT strftime(begin, '%Y-%m-%d %H:%M') AS begin, event_type, count(*) AS n FROM w GROUP BY 1, 2""",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begin, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS end, count(*) AS n FROM s GROUP BY user_id, nr""",
    "job_machine": """SELECT l_orderkey AS job_id, CASE WHEN l_linestatus = 'F' THEN 'FINISHED' WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'PROCESSING' END AS api_status,
        CASE WHEN l_linestatus = 'F' THEN CAST(l_linenumber AS VARCHAR) END AS result, seq
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, seq DESC) AS k
              FROM (SELECT *, CAST(l_linenumber * 8 + CASE WHEN l_linestatus = 'F' THEN 4 ELSE 0 END + instr('ANR', l_returnflag) AS BIGINT) AS seq FROM lineitem) y) x WHERE k = 1""",
    "upload_status": """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 1 THEN 415 WHEN n > 52428800 THEN 413 WHEN n = 0 THEN 400 ELSE 200 END AS INTEGER) AS status, o_orderkey % 5 <> 0 AS known, CAST(CASE WHEN o_orderkey % 100 > 80 THEN 81 ELSE o_orderkey % 100 END AS INTEGER) AS shown
        FROM (SELECT *, CAST(trunc(o_totalprice * 1000) AS BIGINT) * (o_orderkey % 10) AS n FROM orders) x""",
    "outcome_counts": "SELECT count(*) FILTER (o_orderstatus <> 'P') AS n_ok, count(*) FILTER (o_orderstatus = 'P') AS n_failed FROM orders",
    "job_count": "SELECT count(*) AS n_jobs FROM orders",
    "job_dump": """SELECT 'job_id: ' || o_orderkey || chr(10) || 'status: ' || o_orderstatus || chr(10) || 'created_at: ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || chr(10) || 'updated_at: NULL' || chr(10) || 'INPUT:' || chr(10) || '[]' || chr(10) || 'RESULT:' || chr(10) || o_orderpriority || chr(10) || 'ERROR:' || chr(10) || 'NULL' || chr(10) AS value FROM orders""",
    "misread_and_lines": "SELECT c_custkey, '- (1) ế ố ' || c_name || chr(10) || '## 2. Ế Ố ' || c_mktsegment AS fixed, '(1) ế ố ' || c_name || chr(10) || 'Ế Ố ' || c_mktsegment AS plain FROM customer",
    "files_by_name": "SELECT source || '/' || doc_id AS path FROM documents ORDER BY path",
}
