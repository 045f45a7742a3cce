"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import exact_topk, filter_audit, fingerprints, language_id, licenses, merkle, near_dedup, nbest_pieces, packing, suffix_dedup, token_counts, token_store, warc
from lettermill.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest_pieces.encode_digest(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents")).drop("positions")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "class_links", "is_first")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.learn(docs))
    return found.select("doc_id", F.coalesce(language_id.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 0
    found = merkle.sealed(table(spark, sf_dir, "documents"), tampered)
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_nbest_pieces, op2_license_scan, op3_packing, op4_fingerprints, op5_near_duplicates, op6_exact_topk, op7_suffix_dedup, op8_token_counts, op9_language_id, op10_warc, op11_merkle_manifest, op12_filter_audit, op13_token_store)
}

ORACLE_SQL: dict[str, str] = {
    "op6_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM m""",
    "op11_merkle_manifest": """
        WITH RECURSIVE d AS (SELECT *, '{' || coalesce('+' || lang, '') AS part, row_number() OVER () AS row FROM documents),
        f AS (SELECT row, part, doc_id, text, coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
                     || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, coalesce(octet_length(encode(text)) || ':', '-') AS size,
                     list_reduce(list_concat([4294967295], list_transform(generate_series(1, length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
                                 lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT) FOR i IN generate_series(1, 8)]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM d),
        l AS (SELECT row, part, doc_id, sha256(head || size || coalesce(text, '')) AS leaf,
                     sha256(head || size || coalesce(CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '')) AS claimed FROM f),
        i AS (SELECT *, CAST(row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS idx, count(*) OVER (PARTITION BY part) AS n FROM l),
        t AS (SELECT part, 0 AS level, idx, n, leaf AS digest FROM i
              UNION ALL SELECT part, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY part, level, idx // 8, n),
        s AS (SELECT part AS name, '' AS part, digest, CAST(row_number() OVER (ORDER BY part) - 1 AS BIGINT) AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
        u AS (SELECT part, 0 AS level, idx, n, digest FROM s
              UNION ALL SELECT part, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY part, level, idx // 8, n),
        r AS (SELECT part, level, idx // 8 AS parent, list(digest ORDER BY idx) AS ds FROM (SELECT * FROM t UNION ALL SELECT * FROM u) x WHERE n > 1 GROUP BY part, level, idx // 8),
        w AS (SELECT row, part, 0 AS level, idx, '' AS proof, claimed AS fold FROM i
              UNION ALL SELECT row, w.part, w.level + 1, parent, proof || array_to_string(list_concat(ds[1:idx % 8], ds[idx % 8 + 2:8]), ''), sha256(array_to_string(list_concat(ds[1:idx % 8], [fold], ds[idx % 8 + 2:8]), ''))
              FROM w JOIN r ON r.part = w.part AND r.level = w.level AND r.parent = w.idx // 8),
        a AS (SELECT row, arg_max(part, level) AS part, arg_max(proof, level) AS proof, arg_max(fold, level) AS fold FROM w GROUP BY row),
        v AS (SELECT row, '' AS part, 0 AS level, s.idx, proof, fold FROM a JOIN s ON s.name = a.part
              UNION ALL SELECT row, v.part, v.level + 1, parent, proof || array_to_string(list_concat(ds[1:idx % 8], ds[idx % 8 + 2:8]), ''), sha256(array_to_string(list_concat(ds[1:idx % 8], [fold], ds[idx % 8 + 2:8]), ''))
              FROM v JOIN r ON r.part = v.part AND r.level = v.level AND r.parent = v.idx // 8),
        e AS (SELECT row, arg_max(proof, level) AS proof, arg_max(fold, level) AS fold FROM v GROUP BY row)
        SELECT doc_id, leaf, s.digest AS subroot, u.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = u.digest AS verified
        FROM i JOIN e USING (row) JOIN s ON s.name = i.part JOIN u ON u.n = 1""",
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
        l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, CAST(len(ws) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS INT)
                 + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS INT) AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
              FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
        x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
        o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) z),
        r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
              FROM c, s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""",
}
