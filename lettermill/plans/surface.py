"""The stages of a job as temporary views, and functions for SQL, so that a job can be written in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lettermill.functions import patterns as P
from lettermill.functions import text as X
from lettermill.operators import answering, letters, matching, modelled, units
from lettermill.sources.tables import written

FUNCTIONS = {
    "fold_text(t STRING) RETURNS STRING": r"regexp_replace(lower(translate(lower(t), '{src}', '{dst}')), '\\p{{M}}+', '')",
    "word_set(t STRING) RETURNS ARRAY<STRING>": "array_distinct(regexp_extract_all(fold_text(t), '[a-z0-9]+', 0))",
    "set_similarity(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0.0D ELSE size(array_intersect(a, b)) / (size(a) + size(b) - size(array_intersect(a, b))) END",
    "api_status(s STRING) RETURNS STRING": "CASE s WHEN 'succeeded' THEN 'FINISHED' WHEN 'failed' THEN 'FAILED' ELSE 'PROCESSING' END",
}

#: answering.answer() over the views.
JOB = """
    SELECT k.petition_id AS `KN_KIENNGHI.ID`,
           CASE WHEN m.pair_ord IS NULL THEN array() ELSE array(named_struct('content', p.tra_loi, 'file_id', f.file_id, 'metadata', named_struct('so_cong_van', d.so_cong_van, 'ngay_ban_hanh', d.ngay_ban_hanh, 'nguoi_ky', d.nguoi_ky))) END AS answers
    FROM kept_petitions k LEFT JOIN best_matches m ON m.petition_id = k.petition_id LEFT JOIN letter_pairs p ON p.pair_ord = m.pair_ord
    LEFT JOIN prepared_letters f ON f.doc_id = p.doc_id LEFT JOIN letter_metadata d ON d.doc_id = p.doc_id"""


def register(spark: SparkSession) -> None:
    """The functions for SQL: fold_text, word_set, set_similarity and api_status."""
    src, dst = X.fold_tables()
    quoted = lambda x: x.replace("\\", "\\\\").replace("'", "\\'")
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body.format(src=quoted(src), dst=quoted(dst)) if 'src' in body else body}")


def views(docs: DataFrame, petitions: DataFrame, names: dict[str, int], model: modelled.Model | None = None, threshold: float = P.THRESHOLD) -> list[str]:
    """Temporary views of the stages of a job over docs (doc_id, file_id, text) and petitions (petition_id, donvi_id, noi_dung); their names."""
    ready = written(letters.prepared(docs))
    pairs = written(answering.numbered_pairs(ready, model))
    ids = letters.delegation_ids(ready, names)
    kept = matching.keep_units(petitions, ids)
    made = {
        "prepared_letters": ready, "letter_labels": letters.classify(ready), "letter_pairs": pairs, "letter_metadata": letters.letter_metadata(ready), "letter_entities": letters.entities(ready), "letter_units": units.segment_units(ready),
        "delegations": ids, "petitions": petitions, "kept_petitions": kept, "best_matches": matching.best_matches(kept, pairs, threshold),
    }
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return list(made)


def job_in_sql(docs: DataFrame, petitions: DataFrame, names: dict[str, int], **options) -> DataFrame:
    """A whole job, written in SQL over the views: the rows of answering.answer()."""
    register(docs.sparkSession)
    views(docs, petitions, names, **options)
    return docs.sparkSession.sql(JOB)
