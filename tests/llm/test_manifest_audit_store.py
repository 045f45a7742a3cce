"""Merkle manifest, filter audit and token store against brute force, with nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lettermill.llm import filter_audit, merkle, token_store

BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, index string, digest int"


def table(spark, rows):
    """Documents (doc_id, text, lang, source, n_chars) with columns whose names the operators use."""
    return spark.createDataFrame([(*r, "clash", "clash", 7) for r in rows], DOCS).repartition(3)


def some(n, seed=1):
    rng = random.Random(seed)
    words = "Alpha beta gamma Delta epsilon zeta eta Theta iota kappa".split()
    rows = [(i * 3 - 20, " ".join(rng.choices(words, k=rng.randrange(90))) + rng.choice(["", "", " #", " $1", "É ß"]), rng.choice(["en", "en", "en", "de", "日", "", None]), rng.choice(["a", "a", "b", "", None]), rng.randrange(9)) for i in range(n)]
    copies = [(1000 + i, rows[i % 7][1], "fr", "b", None) for i in range(20)]
    return [*rows, *copies, rows[3], rows[3], (None, "no id", "en", "a", 1), (None, rows[2][1], None, "a", 1), (None, None, None, None, None), (2000, None, "x", "a", 0), (2001, "", "x", "a", 0), (2002, "w " * 60_000, "en", "a", 1)]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """The root, and for each leaf its (place, siblings) by level."""
    nodes, trails = [(x, [i]) for i, x in enumerate(leaves)], [[] for _ in leaves]
    while len(nodes) > 1:
        above = []
        for start in range(0, len(nodes), 8):
            run = nodes[start : start + 8]
            for k, (_, below) in enumerate(run):
                for i in below:
                    trails[i].append((k, [x for j, (x, _) in enumerate(run) if j != k]))
            above.append((sha("".join(x for x, _ in run)), [i for _, below in run for i in below]))
        nodes = above
    return nodes[0][0], trails


def plain_manifest(rows):
    parts = {}
    for r in rows:
        parts.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    trees, out = [], []
    for key in sorted(parts):
        own = sorted(((r[0] is not None, r[0] or 0, plain_leaf(r, r[1]), r) for r in parts[key]), key=lambda x: x[:3])
        trees.append((own, *plain_tree([x[2] for x in own])))
    root, over = plain_tree([t[1] for t in trees])
    for (own, subroot, trails), top in zip(trees, over, strict=True):
        for (_, _, leaf, r), trail in zip(own, trails, strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            fold = plain_leaf(r, re.sub("[A-Z]", lambda m: m.group().lower(), r[1])) if changed else leaf
            for place, siblings in trail + top:
                fold = sha("".join([*siblings[:place], fold, *siblings[place:]]))
            out.append((r[0], leaf, subroot, root, sha("".join(x for _, s in trail + top for x in s)), fold, fold == root))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def tampered():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 0


@pytest.mark.parametrize("n", [0, 600])
def test_op11_equals_brute_force(spark, n):
    rows = some(n) if n else [(5, "only A", None, None, None)]
    got = merkle.sealed(table(spark, rows), tampered()).select("doc_id", "digest", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    want = plain_manifest(rows)
    assert order(map(tuple, got)) == order(want)
    assert n == 0 or {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("size", [1, 2, 8, 9, 64, 65, 513, 600])
def test_op11_sizes_and_leaves_in_any_order(spark, size):
    """Trees whose leaves are dealt without any order, so that next to nothing closes in the first pass."""
    leaves = [sha(str(i)) for i in range(size)]
    shuffled = random.Random(size).sample(range(size), size)
    rows = spark.createDataFrame([("p", size, i, leaves[i], i, leaves[i]) for i in shuffled], "part string, size long, index long, digest string, doc_id long, claimed string").repartition(5)
    closed, roots = merkle.manifest(rows)
    got = merkle.prove(rows, closed, merkle.trails_above(closed, roots), with_trails=True).collect()
    root, trails = plain_tree(leaves)
    assert len(got) == size and all(r.verified and r.root == r.subroot == root for r in got)
    assert all(r.trail == [f"{k}{''.join(s)}" for k, s in trails[r["index"]]] for r in got)
    assert closed.filter("kind = 'run'").count() == sum(len({i // 8 ** (level + 1) for i in range(size)}) for level in range(merkle.height(size)))


def test_op11_partial_parents_merge():
    leaves = [sha(str(i)) for i in range(100)]
    tasks = [merkle.Assembly() for _ in range(3)]
    for i, x in enumerate(leaves):
        tasks[i % 3].add("p", 100, 0, i, x)
    assert not any(t.runs or t.roots for t in tasks)
    whole = merkle.Assembly()
    for t in tasks:
        for _, part, size, level, parent, places, digests in t.rows(True):
            whole.merge(part, size, level, parent, places, digests)
    assert whole.roots == [("p", 100, plain_tree(leaves)[0])] and not whole.open


def test_op11_empty(spark):
    assert merkle.sealed(table(spark, []), tampered()).count() == 0


def plain_failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), re.search("[#$%&*|]", text) is not None]


def plain_audit(rows, labels):
    """Every order applied document by document."""
    docs = []
    for r in rows:
        text = r[1] or ""
        copy = r[0] is not None and any(o[0] is not None and o[0] < r[0] and (o[1] or "") == text for o in rows)
        notes = [x for x in labels if r[0] is not None and x[0] == r[0]]
        docs.append((r[3] or "", [*plain_failures(text), copy], any(x[1] == 1 for x in notes), any(x[2] == 1 for x in notes)))
    out = {}
    for part in {d[0] for d in docs}:
        own, total = [d for d in docs if d[0] == part], [0] * 5
        for perm in itertools.permutations(range(5)):
            left = own
            for step, f in enumerate(perm, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                total[f] += len(gone)
                name = "".join("ABCDE"[i] for i in perm)
                out[part, name, step] = [len(left), len(gone), sum(d[1][f] for d in own) - len(gone), sum(d[1] == [i == f for i in range(5)] for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), f]
        for key, x in out.items():
            if key[0] == part:
                x[-1] = total[x[-1]]
    return {k: tuple(x) for k, x in out.items()}


def test_op12_equals_brute_force(spark):
    rows = some(200)
    labels = [(r[0], i % 2, i % 3 == 0) for i, r in enumerate(rows[:150])] + [(rows[0][0], 1, 1), (None, 1, 1), (9999, 1, 1)]
    marked = spark.createDataFrame([(a, b, int(c), "clash") for a, b, c in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(table(spark, rows), marked).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == plain_audit(rows, labels) and len(got) == 600 * len({r[3] or "" for r in rows})
    assert filter_audit.audit(table(spark, []), marked).count() == 0
    assert filter_audit.audit(table(spark, rows), marked.limit(0)).filter("good_lost > 0 OR toxic_lost > 0").count() == 0


def test_op12_word_and_character_rules(spark):
    texts = ["a b " * 30, "x y " * 60, "A" * 6 + "b" * 94, "A" * 5 + "b" * 95, "\x1c".join(f"w{i}" for i in range(60)), "\x0b".join(f"w{i}" for i in range(60)), "😀A" * 10, "^~@!", "a|b", "\t", "İ" * 99 + "A"]
    got = filter_audit.text_masks(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    assert [r["mask"] for r in got] == [sum(1 << i for i, f in enumerate(plain_failures(t)) if f) for t in texts]


def test_op12_polynomial():
    rng = random.Random(3)
    for _ in range(20):
        counts = {rng.randrange(32): rng.randrange(50) for _ in range(12)}
        p = filter_audit.removal_polynomial(counts, 5)
        assert all(filter_audit.at_corner(p, c) == sum(n for mask, n in counts.items() if mask & c) for c in range(32))
        assert sum(filter_audit.shapley(p, i) for i in range(5)) == sum(n for mask, n in counts.items() if mask)


def test_op13_equals_the_library(spark):
    rows = [*some(120), (3000, "a <|endoftext|> b\n\n c​ \t", "x", "a", 1), (3001, " lead\r\n\r\ntail  ", "x", "a", 1), (3002, "x" * 5000 + " " * 3000, "x", "a", 1)]
    got = token_store.round_trip(table(spark, rows), BYTES).collect()
    lib = token_store.WordIds(BYTES).tokenizer
    ids = lambda t: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    want = sorted((r[0] is not None, r[0] or 0, len(x := ids(r[1])), zlib.crc32(x.tobytes())) for r in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [x[1] if x[0] else None for x in sorted(want, key=lambda x: x[:2])]
    assert token_store.round_trip(table(spark, []), BYTES).count() == 0


def test_op13_files_and_segments(spark, tmp_path):
    rows = some(80)
    token_store.write_tokens(table(spark, rows), BYTES, str(tmp_path / "ids"), segment_ids=500)
    files = [p.read_bytes() for p in sorted((tmp_path / "ids").glob("part-*")) if p.stat().st_size]
    parts = [s for f in files for s in token_store.segments(memoryview(f))]
    assert len(parts) > len(files) > 1 and all(s.n_ids >= 500 or s is parts[i] for i, s in enumerate(parts))
    for s in parts:
        whole = s.tokens().tolist()
        assert [s.token(i) for i in range(0, s.n_ids, 7)] == whole[::7] and len(whole) == s.n_ids == s.starts[-1]
        with pytest.raises(IndexError):
            s.token(s.n_ids)
    again = token_store.read_tokens(spark, str(tmp_path / "ids"), ids=True).collect()
    lib = token_store.WordIds(BYTES).tokenizer
    assert sorted(r.ids for r in again) == sorted([*lib.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows)


def test_op13_codes():
    rng = random.Random(5)
    for n in (0, 1, 8, 511, 512, 513, 9000):
        ids = [rng.choice([rng.randrange(256), rng.randrange(50257), rng.randrange(1 << 32), 0, 255, 256, 65535, 65536]) for _ in range(n)]
        s, t = token_store.segments(memoryview(2 * (token_store.encode_segment(3, 7, [(None, np.array(ids[:10], "<u4").tobytes()), (-5, np.array(ids[10:], "<u4").tobytes())]) + b"\n")))
        assert s.tokens().tolist() == ids == [t.token(i) for i in range(n)] and s.doc_ids == [None, -5] and (s.shard, s.first) == (3, 7)
    with pytest.raises(ValueError, match="no segment"):
        token_store.Segment(memoryview(b"x" * 100))


def test_op13_words_equal_the_library():
    w, rng = token_store.WordIds(BYTES), random.Random(6)
    bits = [" ", "  ", "\n", "\n\n", "\t", " ", " ", "\x1c", "\x85", "a", "bc", "it's", "'re", "don't", "1", "23", "!", "...", "é", "日本", "<|", "<|endoftext|>", " ", "​", "\r\n", "The", "end", "\x00"]
    for _ in range(5000):
        text = "".join(rng.choices(bits, k=rng.randrange(9)))
        for some in ([text], [text, text + " Straße, x.y! co-op;; (a)... 12,5 ʼn. \nnext: day\nŒuvre!?"]):
            assert w.encode(some) == [np.array(w.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some], some
    assert all(len(x) <= token_store.LONGEST for x in (*w.known, *w.parts))
