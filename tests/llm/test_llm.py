"""The training-data operators against libraries and brute force, with nulls, empty texts, ties, repeated rows and empty tables."""

import gzip
import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lettermill.llm import exact_topk, fingerprints, language_id, licenses, near_dedup, nbest_pieces, packing, suffix_dedup, token_counts, warc

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
#: Not held out.
IDS = [i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1]
ODD = ["", None, " ", "a", "a" * 3000, "naïve 日本 \n\t  x", "same text here for all", "same text here for all", "<s> <|endoftext|> İ, Σ."]


def odd(spark, more=()):
    rows = [(i, t, "en", "clash") for i, t in enumerate([*ODD, *more])] + [(None, "no id at all", None, None), (3, "a", "en", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, h string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, h string")


def sample(n):
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()[:n]


def test_op1_scores_equal_the_library():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(PIECES, "rb").read())
    m.trainer_spec.model_type = 1
    lib, s = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString()), nbest_pieces.Segmenter(PIECES)
    score = lambda ids: sum(m.pieces[i].score for i in ids)
    for t in sample(60):
        t = " ".join(t.split())[:50].strip()
        if all(p in s.lattice.score for p in t.replace(" ", "")):
            mine = s.segment(t, 4)
            if mine[0][0] > -1e8:  # the library adds in single precision
                assert sorted(score(i) for i in lib.nbest_encode_as_ids(t, 4)) == pytest.approx(sorted(x for x, _ in mine))
            assert [score(np.frombuffer(i, "<u4").tolist()) for _, i in mine] == pytest.approx([x for x, _ in mine])


def test_op1_brute_force_and_round_trip(spark):
    lat = nbest_pieces.Lattice(PIECES)

    def paths(t):
        return [(0.0, ())] if not t else [(lat.score[t[:i]] + x, (i, *c)) for i in range(1, len(t) + 1) if t[:i] in lat.score for x, c in paths(t[i:])]

    for w in ("▁thehere", "▁nation", "▁aaaa"):
        assert [x for x, _ in lat.nbest(w, 6)] == pytest.approx(sorted((x for x, _ in paths(w)), reverse=True)[:6])
    got = nbest_pieces.encode_digest(odd(spark), PIECES).collect()
    assert len(got) == len(ODD) + 2 and all(r.decoded_equal for r in got)
    assert nbest_pieces.encode_digest(empty(spark), PIECES).count() == 0
    best = nbest_pieces.encode_nbest(odd(spark), PIECES).select("doc_id", F.get("n_best", 0)["ids"].alias("ids"))
    assert nbest_pieces.decode(best, PIECES).filter("doc_id = 5").first().text == ODD[5]


def test_op1_decoding_equals_the_library(spark):
    lib, lat, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), nbest_pieces.Lattice(PIECES), random.Random(9)
    some = [0, 1, 2, 259, 300, 400, *range(3 + 0xE0, 3 + 0xEA), *range(3 + 0x90, 3 + 0xA6), *lat.ids.values()]
    for _ in range(3000):
        ids = rng.choices(some[: rng.choice([6, 38, len(some)])], k=rng.randrange(8))
        assert lat.decode(ids) == lib.decode(ids), ids
    rows = spark.createDataFrame([(1, [300, None]), (2, [-1]), (3, [40_000]), (4, []), (5, None), (5, None), (None, [400])], "doc_id long, ids array<int>")
    got = nbest_pieces.decode(rows.withColumn("text", F.lit("clash")), PIECES).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got if r.text is not None) == [(0, lib.decode([400])), (4, "")] and len(got) == 7


def test_op1_no_piece_goes_from_a_word_into_the_space_behind_it():
    assert not any(nbest_pieces.SPACE in p.lstrip(nbest_pieces.SPACE) for p in nbest_pieces.Lattice(PIECES).ids)


def test_op2_licenses(spark):
    text = "Intro words. " + licenses.TEMPLATES["MIT"].replace("free of charge", "for free").replace("substantial portions", "parts") + " the end"
    got = {r.doc_id: r for r in licenses.scan_licenses(odd(spark, [text, "x " * 50 + licenses.TEMPLATES["GPL-3.0"]])).collect()}
    assert got[len(ODD)].license == "MIT" and 0.85 <= got[len(ODD)].coverage < 1
    assert (got[len(ODD) + 1].license, got[len(ODD) + 1].coverage) == ("GPL-3.0", 1.0)
    assert got[1].license is None and got[1].n_chars == 0
    a, b = list("xaybzc"), list("abc")
    assert licenses.align(a, b) == [(1, 0), (3, 1), (5, 2)]
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_op2_telling_words(spark):
    cc = "Intro. This work is licensed under a Creative Commons {} International License. More words"
    texts = {
        cc.format("Attribution-NonCommercial 4.0"): "CC-BY-NC-4.0-line",
        cc.format("Attribution-ShareAlike 4.0"): "CC-BY-SA-4.0-line",
        cc.format("Attribution-NoDerivatives 4.0"): "CC-BY-ND-4.0-line",
        cc.format("Attribution-NonCommercial-ShareAlike 4.0"): "CC-BY-NC-SA-4.0-line",
        cc.format("Attribution Non Commercial 4.0"): "CC-BY-NC-4.0-line",
        cc.format("Attribution 3.0"): None,
        cc.format("Attribution 4.0"): "CC-BY-4.0",
        "This work is licensed under the GNU General Public License, version 2. See section 3.": "GPL-2.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": None,
        "This work is licensed under the GNU General Public License, version 3.0": "GPL-3.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under the Apache License, Version 1.1.": "Apache-1.1",
        "Licensed under the Apache License 2.0": "Apache-2.0",
        licenses.TEMPLATES["MIT-permission"] + " More of something else": "MIT-permission",
        **{v: k for k, v in licenses.TEMPLATES.items()},
    }
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.license for r in sorted(got, key=lambda r: r.doc_id)] == list(texts.values())
    assert all(r.n_licenses == (r.license is not None) for r in got)


def test_op2_siblings_identifiers_and_headings(spark):
    changed = licenses.TEMPLATES["MIT"].replace("substantial portions", "big parts")
    texts = {
        " Next copy: ".join([changed] * 4): "MIT",
        "// SPDX-License-Identifier: Apache-2.0\nint main() {}": "SPDX-Apache-2.0",
        "SPDX-License-Identifier: MIT-0": "SPDX-MIT-0",
        "MIT License\n\nCopyright (c) 2020 A": "MIT-heading",
        "This is licensed under the GPL v3, see below": "GPL-3.0-short",
        "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": "GPL-2.0-only-notice",
        "Apache License Version 2.0, January 2004 http://x": "Apache-2.0-heading",
        "not all rights reserved.": None,
        "All rights reserved.": "ARR",
        "Intro: " + licenses.BSD_FORMS + licenses.BSD_TWO + " The end": "BSD-2-Clause-conditions",
        "Intro: " + licenses.BSD_FORMS + licenses.BSD_TWO + licenses.BSD_NAME + " The end": "BSD-3-Clause-conditions",
    }
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.all_licenses for r in sorted(got, key=lambda r: r.doc_id)] == list(texts.values())


def test_op2_equals_brute_force(spark):
    """Windows from every word of a template on, aligned by a plain recursion with a quadratic longest increasing subsequence."""
    templates = {"a": "one two three two four five six one seven", "b": "eight nine two ten", "c": "one one two two three three"}

    longest = lambda c: (len(c), -c[-1][1])  # noqa: E731  of equally long ones that which ends first

    def plain(a, b):
        if a and b and a[0] == b[0]:
            return 1 + plain(a[1:], b[1:])
        if a and b and a[-1] == b[-1]:
            return 1 + plain(a[:-1], b[:-1])
        both = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 == b.count(w)]
        best = [[]] * len(both)
        for k, p in enumerate(both):
            best[k] = max((best[j] for j in range(k) if both[j][1] < p[1]), key=longest, default=[]) + [p]
        chain = max(best, key=longest, default=[])
        if not chain:
            return 0
        ends = [(-1, -1), *chain, (len(a), len(b))]
        return len(chain) + sum(plain(a[i + 1 : k], b[j + 1 : m]) for (i, j), (k, m) in zip(ends, ends[1:], strict=False))

    rng = random.Random(8)
    texts = []
    for _ in range(150):
        words = rng.choice(list(templates.values())).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(["x", "one", "two", "y"])
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["x", "ten", "three"]))
        texts.append(" ".join([*rng.choices(["p", "q", "two", "nine"], k=rng.randrange(8)), *words, *rng.choices(["p", "q", "one"], k=rng.randrange(8))]))
    rows, found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), 0
    for name, template in templates.items():  # each alone: of all, a longer one would take in what is a part of it
        t = template.split()
        for row in licenses.scan_licenses(rows, {name: template}, 0.7).collect():
            own = [(i, w) for i, w in enumerate(texts[row.doc_id].split()) if w in t]
            want = max((plain([w for i, w in own if s <= i < s + licenses.STRETCH * len(t)], t) / len(t) for s, _ in own), default=0.0)
            assert (row.coverage or 0.0) == pytest.approx(want if want >= 0.7 else 0.0), (name, texts[row.doc_id])
            found += row.license is not None
    assert 30 < found < 450


def test_op3_packing(spark):
    got = packing.pack(odd(spark, sample(80)), WORDS).toPandas()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        n = int(s.length.sum())
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and n <= 4096 and (n == 4096 or n & (n - 1) == 0)
    ids = packing.Ids(WORDS)
    texts = dict(enumerate([*ODD, *sample(80)]))
    want = {i: [*ids.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    for doc, p in got[got.doc_id.notna() & (got.doc_id != 3)].groupby("doc_id"):
        at = 0
        for r in p.sort_values("start").itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(want[doc][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want[doc]) == r.doc_tokens
    sizes = [random.Random(1).randrange(1, 900) for _ in range(100)]
    w = packing.windows(sizes, 1000)
    assert sorted(i for x in w for i in x) == list(range(100)) and max(sum(sizes[i] for i in x) for x in w) <= 1000
    for some in ([], [5], [4096], [1000] * 5, [999] * 3, sizes, [5000, 1, 2, 3]):  # each id once, full sequences or powers of two
        made = packing.cut_windows(some, 1024)
        assert sorted((i, p) for w in made for i, s, n in w for p in range(s, s + n)) == [(i, p) for i, n in enumerate(some) for p in range(n)]
        assert all((n := sum(x[2] for x in w)) == 1024 or n & (n - 1) == 0 for w in made)
    assert len(packing.windows([600, 600, 600], 1000)) == 3  # two would hold the sum, but none of them two of the items
    assert packing.pack(empty(spark), WORDS).count() == 0


def test_op4_fingerprints(spark):
    texts = [*ODD, *sample(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in fingerprints.fingerprints(rows).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        e = t[: len(t) - len(t) // 4] + plain[(i + 1) % len(plain)][: len(t) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and 0 <= got[i].near_edited <= 1
    assert got[6].fingerprint == got[7].fingerprint and got[6].near_next == 1.0
    codes = fingerprints.codes_of(plain[20])
    h = fingerprints.rolling(codes, 5) >> np.uint64(32)
    want = sorted({max(range(i, i + 7), key=lambda j: (-int(h[j]), j)) for i in range(len(h) - 6)})
    assert fingerprints.winnow(codes, 5, 7)[1].tolist() == want
    assert fingerprints.fingerprints(odd(spark)).count() == len(ODD) + 2 and fingerprints.fingerprints(empty(spark)).count() == 0


def test_op4_likenesses_and_hot_ids(spark):
    """Ids that repeat over many ranges, against plain sets of the hashes of all windows."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices("alpha beta gamma delta epsilon zeta".split(), k=rng.randrange(0, 60))) for _ in range(160)]
    rows = [(7 if i % 2 else i % 50 if i % 5 else None, t) for i, t in enumerate(texts)] + [(7, texts[1])] * 5
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashed = d.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r.h, r.text) for r in hashed))

    def plain(t):
        codes = fingerprints.codes_of(t)
        if not len(codes):
            return frozenset()
        h = [int(x) for x in fingerprints.rolling(codes, min(fingerprints.K, len(codes))) >> np.uint64(32)]
        w = min(fingerprints.WINDOW, len(h))
        return frozenset(min(h[i : i + w]) for i in range(len(h) - w + 1))

    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = []
    for (has, i, _, t), (_, _, _, after) in zip(order, order[1:] + order[:1], strict=True):
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        want.append((i if has else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(plain(t), plain(edited)), 9), round(like(plain(t), plain(after)), 9)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.fingerprints(d).collect()]
    key = lambda x: (x[0] is not None, x)
    assert sorted(got, key=lambda x: str(key(x))) == sorted(want, key=lambda x: str(key(x)))
    keyed = d.select(F.coalesce("doc_id", F.lit(-1)).alias("key"), F.xxhash64("text").alias("h"))
    dealt = {(r.key, r.h): r.bucket for r in fingerprints.ranges(keyed, 8).collect()}
    buckets = [dealt[k] for k in sorted(dealt)]
    assert buckets == sorted(buckets) and len({b for (k, _), b in dealt.items() if k == 7}) >= 3


def test_op5_near_duplicates(spark):
    rng, base = random.Random(2), [" ".join(random.Random(i).choices("one two three four five six seven eight nine ten".split(), k=120)) for i in range(12)]
    texts = list(base)
    for t in base[:6]:
        w = t.split()
        for _ in range(3):
            x = list(w)
            x[rng.randrange(len(x))] = "new"
            texts.append(" ".join(x))
    got = near_dedup.near_duplicates(odd(spark, texts)).collect()
    assert len(got) == len(ODD) + len(texts) + 2
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    mine = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert [mine[len(ODD) + i] - len(ODD) for i in range(len(texts))] == label
    assert mine[6] == mine[7] == 6 and mine[0] == mine[1] == 0
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_op5_finds_every_link_of_a_chain(spark):
    words = [f"w{i}" for i in range(1000)]
    texts = [" ".join(words[11 * i : 11 * i + 104]) for i in range(80)]  # neighbours have a similarity of 89 / 111, others less than 0.8
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.class_size for r in near_dedup.near_duplicates(rows).collect()} == {80}


def test_op5_near_copies_that_repeat_lines_differently(spark):
    texts = []
    for i in range(40):
        w = [f"d{i}w{j}" for j in range(200)]
        texts += [" ".join(w[:50] * 60 + w[50:]), " ".join([*w[:190], "new", *w[191:]])]
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    assert all(len(sets[i] & sets[i + 1]) >= 0.9 * len(sets[i] | sets[i + 1]) for i in range(0, 80, 2))
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i - i % 2 for i in range(80)}


def test_op5_one_row_for_each_document_where_rows_repeat(spark):
    words = [f"w{i}" for i in range(200)]
    t, near, u = " ".join(words), " ".join([*words[:-1], "new"]), " ".join(words[::-1])
    rows = [(1, t), (1, t), (2, near), *[(None, u)] * 7, (9, u[:-2] + "new")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == {(1, 1, 3): 2, (2, 1, 3): 1, (None, 9, 8): 7, (9, 9, 8): 1}


def test_op5_left_links(spark):
    """What no star has shown: texts of a bucket in classes of their own, though some are similar."""
    sets = [np.arange(a, a + 100, dtype=np.uint32) for a in (0, 5, 60, 300)]
    kept = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "h long, shingles binary")
    met = spark.createDataFrame([(0, 1, i, 4) for i in range(4)], "i int, band long, h long, n long")
    labels = kept.select("h", F.col("h").alias("comp"))
    pairs = near_dedup._left(met, labels, kept, 0.8)
    assert {(r.a, r.b) for r in near_dedup._verified(pairs, kept, 0.8).collect()} == {(0, 1)}
    joined = near_dedup._joined(labels, spark.createDataFrame([(0, 1)], "a long, b long"))
    assert near_dedup._left(met, joined, kept, 0.8).filter("a = 0 AND b = 1").count() == 0


@pytest.mark.parametrize("links", [[], [(3, 3)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(i, 99) for i in range(50, 60)], [((7 * i) % 50, (11 * i + 3) % 50) for i in range(25)]])
def test_components(spark, links):
    from lettermill.llm.components import connected_components

    label = {x: x for p in links for x in p}
    for a, b in links:
        low, high = sorted((label[a], label[b]))
        label = {k: low if v == high else v for k, v in label.items()}
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.comp for r in got} == label and len(got) == len(label)


def test_op5_probability_jaccard():
    a, b = np.arange(0, 80, dtype=np.uint64), np.arange(20, 100, dtype=np.uint64)
    doc = np.repeat([0, 1], 80)
    sig = near_dedup.prob_min_hash(2, doc, near_dedup.mixed(np.concatenate([a, b])), np.ones(160), 4000)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.03


def test_op6_topk(spark):
    rng = np.random.default_rng(3)
    v = [[float(x) for x in rng.normal(0, 0.3, 40)] for _ in range(300)] + [[0.1, None], [float("nan")] * 40, None, [], [1e20] * 40]
    v[7] = v[8]
    rows = spark.createDataFrame([(i, x, 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, ids int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk.top_k(rows).collect() if r.query_id < 300)
    q = np.floor(np.array(v[:300]) * 256).astype(int)
    want = []
    for i in range(0, 300, 50):
        big = int(q[i].sum()) * (256 * 10**20)
        s = sorted([(-int(q[i] @ q[j]), j) for j in range(300) if j != i] + [(-max(-(2**63) + 1, min(2**63 - 1, big)), 304)])[:5]
        want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s)]
    assert got == want
    assert exact_topk.top_k(rows.filter("false")).count() == 0


def test_op6_grid_of_several_columns(spark):
    rng, n = np.random.default_rng(3), spark.conf.get("spark.sql.shuffle.partitions")
    x = rng.normal(size=(9000, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "230")
    try:
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_topk.top_k(rows).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    q = np.floor(256 * x).astype(np.int64)
    want = {}
    for i in range(0, 9000, 50):
        scores = q @ q[i]
        order = [j for j in np.lexsort((np.arange(9000), -scores)) if j != i][:5]
        want |= {(i, k + 1): (int(j), int(scores[j])) for k, j in enumerate(order)}
    assert got == want


def test_op6_repeated_query_with_an_invalid_row(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (0, [nan, 0.5]), (50, [0.5, 0.25]), (50, [inf, 0.5]), (100, [0.25, 0.5]), (100, [0.25, None]), (100, None), (1, [1.0, 1.0])]
    got = exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(r.query_id for r in got) == {0: 3, 50: 3, 100: 3}


def test_op7_suffix_dedup(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choices("abc é", k=rng.randrange(20, 300))) for _ in range(12)]
    texts = ["".join(rng.choice([rng.choice(parts), "".join(rng.choices("abc é", k=rng.randrange(0, 90)))]) for _ in range(rng.randrange(0, 7))) for _ in range(80)] + [*ODD, "ab" * 300]
    for length, k, heavy in ((200, 64, 2000), (50, 20, 4)):
        raw = [(t or "").encode() for t in texts]
        c = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
        got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), length, k, heavy).collect()}
        for i, b in enumerate(raw):
            gone = np.zeros(len(b), bool)
            for j in range(len(b) - length + 1):
                if c[b[j : j + length]] > 1:
                    gone[j : j + length] = True
            assert bytes(got[i].kept) == bytes(np.frombuffer(b, np.uint8)[~gone]) and got[i].n_removed == gone.sum()
            assert got[i].n_spans == np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(odd(spark), 300)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0 and suffix_dedup.remove_repeats(odd(spark)).count() == len(ODD) + 2


def test_op7_a_line_that_is_everywhere(spark):
    """One anchor in many surroundings, few of which are equal: the second merge has the same results."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    line = word(150)
    texts = [word(rng.randrange(5, 200)) + line + word(rng.randrange(5, 200)) for _ in range(60)]
    texts += [word(9) + texts[i][max(0, texts[i].index(line) - i) :] for i in range(0, 60, 3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    raw = [t.encode() for t in texts]
    c = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    for heavy in (10, 10_000):
        got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(rows, heavy=heavy).collect()}
        for i, b in enumerate(raw):
            gone = np.zeros(len(b), bool)
            for j in range(len(b) - 199):
                if c[b[j : j + 200]] > 1:
                    gone[j : j + 200] = True
            assert got[i] == (gone.sum(), bytes(np.frombuffer(b, np.uint8)[~gone]))


def test_op7_rows_that_repeat_many_times(spark):
    text = "".join(random.Random(7).choices("abcdefgh ", k=690))
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(8)
    got = suffix_dedup.remove_repeats(rows).groupBy("n_removed", "n_spans").count().collect()
    assert [(r.n_removed, r.n_spans, r["count"]) for r in got] == [(690, 1, 20_000)]


def test_op8_counts_equal_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(1)
    texts = [*ODD, *sample(60), *("".join(rng.choices(list("  \n\t\r▁aabcé日😀.,<s>0"), k=30)) for _ in range(300))]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PIECES).collect()}
    assert [got[i] for i in range(len(texts))] == [len(lib.encode(t or "")) for t in texts]
    assert token_counts.token_counts(empty(spark), PIECES).count() == 0


def test_op8_long_runs_without_a_space():
    lib, counter, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.Counter(PIECES), random.Random(3)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "aabbab", "theinrstionan", "ab=\t日", "".join(map(chr, range(0x4E00, 0x4F00)))]
    texts = ["".join(rng.choices(kind, k=rng.randrange(1, 400))) for kind in kinds for _ in range(60)]
    texts += ["".join(rng.choices(kinds[0], k=1 << 20)), "a" * (1 << 20)]  # 1 MB in seconds
    assert counter.count(texts) == [len(lib.encode(x)) for x in texts]
    for least in (2, 1 << 40):
        token_counts.LONG, before = least, token_counts.LONG
        try:
            assert token_counts.Counter(PIECES).count(texts[:-2]) == [len(lib.encode(x)) for x in texts[:-2]]
        finally:
            token_counts.LONG = before


def test_op8_runs_of_one_character():
    lib, c, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.Counter(PIECES), random.Random(1)
    signs = sorted({" " if p[0] == token_counts.SPACE else p[0] for p in c.table.ids if len(p) > 1 and len(set(p)) == 1})
    texts = [" " * 1_000_000, *(x * 20_000 for x in signs), "".join(rng.choice(signs) * rng.randrange(1, 400) for _ in range(2000))]
    for _ in range(300):
        some = rng.choices(signs, k=rng.randrange(1, 5))
        texts.append("".join(rng.choice(some) * rng.choice([1, 2, 3, 5, 17, 40, 100, 333]) for _ in range(rng.randrange(1, 9))))
    start = time.time()
    assert c.count(texts) == [len(x) for x in lib.encode(texts)] and time.time() - start < 60
    assert max(map(len, c.known)) <= token_counts.LONGEST


def test_op9_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn(docs)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(language_id.held_out())
    assert got.filter("lang_pred = lang").count() >= 0.97 * got.count()
    mine = {r.doc_id: r for r in language_id.identify(odd(spark, ["½ ² 10", "x²"]), model).collect()}
    assert mine[0].lang_pred == mine[1].lang_pred == mine[2].lang_pred == mine[len(ODD)].lang_pred == "und" and all(0 <= r.score <= 1 for r in mine.values())
    assert mine[len(ODD) + 1].lang_pred != "und"
    assert (2 ** -model.bits(np.array([int.from_bytes(b"  a" + bytes([c]), "big") for c in range(256)], np.uint64))).sum(0).max() <= 1.0001
    assert language_id.identify(empty(spark), language_id.learn(empty(spark))).count() == 0


def plain_counts(texts, order=4):
    after = {}
    for t in texts:
        x = b" " * order + language_id.normal(t)
        for i in range(order, len(x)):
            for o in range(order + 1):
                after.setdefault(x[i - o : i], Counter())[x[i]] += 1
    return after


def plain_bits(after, text, order=4):
    """Escape method C in dictionaries, byte by byte."""
    bits, x = 0.0, b" " * order + language_id.normal(text)
    for i in range(order, len(x)):
        for o in range(order, -1, -1):
            if (seen := after.get(x[i - o : i])) is None:
                continue
            total = sum(seen.values()) + len(seen)
            if x[i] in seen:
                bits -= np.log2(seen[x[i]] / total)
                break
            bits -= np.log2(len(seen) / total)
        else:
            bits += 8
    return bits


def test_op9_code_lengths_equal_a_plain_model():
    texts = {"a": ["The cat sat  on the mat", "a  hat é"], "b": ["chien et chat", "été là là"]}
    model = language_id.Model(texts, 4)
    some = ["the hat", "", "là chat zz", "日本 A"]
    got, sizes = model.totals(some)
    assert got.ravel().tolist() == pytest.approx([plain_bits(plain_counts(texts[k]), t) for t in some for k in "ab"])
    assert sizes.tolist() == [len(language_id.normal(t)) for t in some]


def test_op9_repeated_and_long_rows_are_learned_within_bounds(spark):
    rows = [(IDS[0], "ein kurzer Text", "de")] * 3000 + [(IDS[1], "un texte long " * 3000, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.learn(docs, sample_docs=50).langs == ["de", "fr"]
    assert language_id.learn(docs, most_langs=1).langs == ["de"]


def test_op9_rejects_what_is_no_language(spark):
    rng = random.Random(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = ["".join(rng.choices("bcdfghjklmnpqrstvwxz0123456789", k=300)), "漢字" * 100, "12 34", None, "".join(chr(rng.randrange(0x400, 0x460)) for _ in range(200))]
    rows = spark.createDataFrame([(10**6 + i, t, None, None, 0) for i, t in enumerate(junk)], docs.schema)
    kept = {r.doc_id for r in language_id.keep_identified(docs.unionByName(rows), language_id.learn(docs)).collect()}
    assert not any(i >= 10**6 for i in kept) and len(kept) >= 0.99 * docs.count()


def test_op10_warc(spark):
    rows = [(1, "u1", "x" * 2000), (2, "u2", "x" * 2000), (3, None, "é\r\n\r\nWARC/1.1\r\n" * 100), (4, "u", None), (5, "u", "x"), (6, "u", "x"), (None, "u", "z" * 1500), (2, "u2", "x" * 2000)]
    got = warc.round_trip(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string"), content=True).collect()
    assert len(got) == len(rows) and sum(r.record_type == "revisit" for r in got) == 2
    for r in got:
        html = {a: c for a, _, c in rows}[r.page_id] or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        assert r.refers_to == (2 if r.record_type == "revisit" else None) and r.request and r.metadata
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_op10_assembly_of_incomplete_transactions(spark, tmp_path):
    def record(kind, i, body, **more):
        head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, "WARC-Record-ID": f"<{i}>", **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": len(body)}.items())
        return f"WARC/1.1\r\n{head}\r\n".encode() + body + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    whole = b"".join([record("warcinfo", "w", b"x"), record("request", "q2", b"GET b", WARC_Concurrent_To="<a>"), record("request", "q1", b"GET a", WARC_Concurrent_To="<a>"), record("response", "a", http), record("response", "b", http), record("metadata", "m", b"k: v", WARC_Concurrent_To="<gone>")])
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(whole))
    got = {r.capture_id: r for r in warc.transactions(spark, str(tmp_path)).collect()}
    assert set(got) == {"<a>", "<b>"} and got["<a>"].request.content == "GET a" and got["<b>"].request is None and got["<a>"].metadata is None
    assert bytes(got["<b>"].response.content) == b"body" and got["<b>"].response.payload_digest == hashlib.sha1(b"body").hexdigest()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.by_language(spark, docs, SF)
    assert kept.count() >= 0.99 * docs.count() and kept.columns == docs.columns
    once = corpus_pipeline.without_near_duplicates(spark, docs, SF).cache()
    assert once.count() == near_dedup.near_duplicates(docs).select("class_id").distinct().count() and once.columns == docs.columns
    cut = {r.doc_id: r for r in corpus_pipeline.without_repeats(spark, once, SF).collect()}
    for r in suffix_dedup.remove_repeats(once).collect():
        assert cut[r.doc_id].text == bytes(r.kept).decode("utf-8", "ignore") and cut[r.doc_id].n_chars == len(cut[r.doc_id].text)
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == len(cut)


def plain_pipeline(rows):
    """The stages by brute force, over (doc_id, text, lang): doc_id and text of what is packed."""
    learned = {}
    for i, t, lang in rows:
        if t is not None and lang is not None and (i is None or zlib.crc32(str(i).encode()) % 3 != 1):
            learned.setdefault(lang, set()).add((i, t))
    learned = {k: [t for _, t in v] for k, v in learned.items()}
    counts = {k: plain_counts(v) for k, v in sorted(learned.items())}
    usual = {k: np.median([plain_bits(counts[k], t) / len(language_id.normal(t)) for t in v if t.split()]) for k, v in learned.items()}
    kept = []
    for i, t, _ in rows:
        if t is not None and any(map(str.isalpha, t)):
            size = len(language_id.normal(t))
            bits, lang = min((plain_bits(c, t), k) for k, c in counts.items())
            if bits / size < language_id.REJECTED * usual[lang] or bits - usual[lang] * size < language_id.EVIDENCE:
                kept.append((i, t))
    # near duplicates: all pairs
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.lower().split() for _, t in kept)]
    label = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if label[i] != label[j] and (kept[i][1] == kept[j][1] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                label = [label[j] if x == label[i] else x for x in label]
    best = {}
    for k, row in zip(label, kept, strict=True):
        if k not in best or (row[0] is not None and (best[k][0] is None or row[0] < best[k][0])):
            best[k] = row
    # repeats of 200 bytes
    raw = [(i, t.encode()) for i, t in best.values()]
    seen = Counter(b[i : i + 200] for _, b in raw for i in range(len(b) - 199))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                gone[j : j + 200] = True
        left, at = "", 0
        for c in b.decode():  # a character that is cut goes
            size = len(c.encode())
            left += c if not gone[at : at + size].any() else ""
            at += size
        out.append((i, left))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    words = {"en": "the of and reading water house under stone river light".split(), "fr": "été où le des maison rivière pierre lumière forêt noël".split()}
    prose = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    passage = prose("fr", 60)
    rows = [(i, prose(lang, rng.randrange(5, 150)) + (" " + passage + " " if i % 5 == 0 else " ") + prose(lang, 30), lang if i % 4 else None) for i, lang in ((i, rng.choice(["en", "fr"])) for i in range(40))]
    for i in range(0, 12, 3):  # near and exact copies
        w = rows[i][1].split()
        rows += [(50 + i, " ".join([*w[:3], "other", *w[4:]]), None), (60 + i, rows[i][1], "en")]
    rows += [(80, "".join(rng.choices("bcdfghjklmnpqrstvwxz0123456789", k=300)), None), (81, "漢字" * 60, None), (82, None, "en"), (83, "", None), (84, "12 !", None), (85, "a", None)]
    rows += [rows[4], rows[4], (None, prose("en", 50), None), (None, rows[7][1], None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "clash", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, h string, comp int")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    want = plain_pipeline(rows)
    library = packing.Ids(WORDS).tokenizer
    ids = lambda t: [*library.encode(t, add_special_tokens=False).ids, 2]
    assert 30 < len(want) < len(rows) - 10
    assert sorted(got[got.start == 0].doc_id.fillna(-1)) == sorted(-1 if i is None else i for i, _ in want)
    pieces = {(-1 if r.doc_id != r.doc_id else int(r.doc_id), r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples()}
    for i, t in want:
        at, mine = 0, ids(t)
        while at < len(mine):
            n, crc, size = pieces[-1 if i is None else i, at]
            assert size == len(mine) and crc == zlib.crc32(np.array(mine[at : at + n], "<u4").tobytes())
            at += n
    for _, s in got.groupby("sequence_id"):
        assert (n := int(s.length.sum())) == 4096 or n & (n - 1) == 0


def test_pipeline_stages_on_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, h string")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, SF)
        assert got.count() == 0 and (name == "packing" or got.columns == none.columns[:-1])
