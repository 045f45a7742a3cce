"""Names by automaton and best pairs by rising bounds, against plain versions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lettermill.functions import names as N
from lettermill.functions import text as X
from lettermill.operators import letters, matching

PHRASE = "Đoàn đại biểu Quốc hội"


def plain_delegation(lines, ordered):
    for line in lines:
        if "doan dai bieu quoc hoi" in line:
            for key, unit in ordered:
                if key in line:
                    return unit
    joined = " ".join(lines)
    return next((unit for key, unit in ordered if f"doan dai bieu quoc hoi {key}" in joined or f"doan dbqh {key}" in joined), None)


def test_ten_thousand_names_in_fifty_lines(spark):
    rng = random.Random(1)
    syllables = ["an", "ba", "cao", "dong", "ha", "lam", "nam", "son", "thanh", "vinh", "yen"]
    names = {f"{rng.choice(['Tỉnh', 'Thành phố', 'Đặc khu'])} {' '.join(rng.choices(syllables, k=rng.randrange(1, 5)))}{rng.choice(['', ' ' + str(i)])}": i for i in range(10_000)}
    ordered = N.unit_names(names)
    assert len(ordered) > 10_000 and [len(k) for k, _ in ordered] == sorted((len(k) for k, _ in ordered), reverse=True)
    texts = []
    for _ in range(300):
        lines = [" ".join(rng.choices(syllables + ["12", "Kính gửi:", PHRASE, "Đoàn ĐBQH", "tỉnh"], k=rng.randrange(1, 9))) for _ in range(60)]
        texts.append("\n".join(lines if rng.random() < 0.8 else [x.replace(PHRASE, "x") for x in lines]))
    rows = spark.createDataFrame(list(enumerate([*texts, None, "", PHRASE])), "doc_id long, text string")
    folded = {r.doc_id: r.x for r in rows.select("doc_id", F.transform(F.slice(X.lines(F.coalesce("text", F.lit(""))), 1, 50), X.folded_name).alias("x")).collect()}
    start = time.time()
    got = {r.doc_id: r.donvi_id for r in letters.delegation_ids(rows, names).collect()}
    assert time.time() - start < 30 and got == {i: plain_delegation(x, ordered) for i, x in folded.items()}
    assert len(set(got.values())) > 20


def test_longest_name_then_the_first_given(spark):
    names = {"Tỉnh Ba": 1, "Tỉnh Ba Vì": 2, "Tỉnh Xa Vì": 3, "Thành phố Xa Vì": 4, "Huyện Cao Vì": 5}
    rows = [(1, f"{PHRASE} tỉnh Ba Vì"), (2, f"{PHRASE} Ba"), (3, f"{PHRASE} tỉnh Ba và tỉnh Xa Vì"), (4, f"{PHRASE}\ntỉnh Ba Vì"), (5, "Đoàn ĐBQH tỉnh Ba"), (6, "tỉnh Ba"), (7, f"{PHRASE} thành phố Xa Vì, huyện Cao Vì")]
    got = dict(letters.delegation_ids(spark.createDataFrame(rows, "doc_id long, text string"), names).collect())
    assert got == {1: 2, 2: 1, 3: 3, 4: 2, 5: 1, 6: None, 7: 4}
    assert dict(letters.delegation_ids(spark.createDataFrame(rows[:1], "doc_id long, text string"), {}).collect()) == {1: None}


def plain_best(asked, given, floor):
    out = {}
    for i, a in asked.items():
        scores = [(len(a & b) / len(a | b) if a and b else 0.0, -j) for j, b in given.items()]
        score, j = max(scores)
        out[i] = (-j, score) if score >= floor else (None, None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_best_pairs_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    some = lambda: {w for w in words if rng.random() < 1 / (1 + int(w[1:]) / 4)} | set(rng.sample(words, rng.randrange(3)))  # noqa: E731  frequent ones and rare ones
    given = {j: some() for j in range(150)} | {150: set(), 151: {"only"}}
    asked = {i: some() for i in range(60)} | {60: set(), 61: {"absent"}, 62: set(given[7]), 63: set(words), 64: {"w0"}, 65: given[9] | {"absent"}}
    table = lambda rows, key: spark.createDataFrame([(i, " ".join(sorted(x))) for i, x in rows.items()], f"{key} long, noi_dung string").repartition(3)
    p, q = table(asked, "petition_id"), table(given, "pair_ord")
    near = lambda rows: {r.petition_id: (r.pair_ord, r.score and round(r.score, 9)) for r in rows.collect()}
    rounded = lambda rows: {i: (j, x and round(x, 9)) for i, (j, x) in rows.items()}
    assert near(matching.best_of_all(p, q)) == rounded(plain_best(asked, given, 0.0))
    for threshold in (0.1, 0.5, 1.0):
        assert near(matching.best_matches(p, q, threshold)) == rounded(plain_best(asked, given, threshold))
    assert matching.best_of_all(p.limit(0), q).count() == 0
    assert near(matching.best_matches(p, q.limit(0), 0.5)) == {i: (None, None) for i in asked}


def test_frequent_words_are_not_met_where_rare_ones_decide(spark, monkeypatch):
    """A petition's words are two rare ones, which its pair has, and frequent ones, which all pairs have: the pairs met don't grow with these."""
    counted, real = [], matching.met

    def counting(*args):
        out = real(*args)
        counted.append(out.count())
        return out

    monkeypatch.setattr(matching, "met", counting)
    for frequent in (5, 80):
        rows = [(i, " ".join([f"r{i}", f"s{i}", *(f"c{j}" for j in range(frequent))])) for i in range(200)]
        p, q = spark.createDataFrame(rows, "petition_id long, noi_dung string"), spark.createDataFrame(rows, "pair_ord long, noi_dung string")
        assert all(r.petition_id == r.pair_ord and r.score == 1.0 for r in matching.best_of_all(p, q).collect())
    assert counted == [200, 200]


def test_words_that_cannot_reach_the_threshold_meet_no_pairs(spark):
    """Petitions whose only shared words are two frequent ones of seven: all pairs of petitions and pairs, 3.2 billion here, were met and dropped before."""
    n = 40_000
    k = F.col("id").cast("string")
    p = spark.range(0, n, 1, 4).select(F.col("id").alias("petition_id"), F.concat_ws(" ", F.lit("viec tai"), *[F.concat(k, F.lit(x)) for x in "abcde"]).alias("noi_dung"))
    q = spark.range(n, 2 * n, 1, 4).select(F.col("id").alias("pair_ord"), F.concat_ws(" ", F.lit("viec tai"), k).alias("noi_dung"))
    q = q.unionByName(p.filter("petition_id = 7").select(F.lit(7).cast("long").alias("pair_ord"), "noi_dung"))
    start = time.time()
    found = matching.best_matches(p, q, 0.5).filter("pair_ord IS NOT NULL").collect()
    assert [tuple(r) for r in found] == [(7, 7, 1.0)] and time.time() - start < 40
