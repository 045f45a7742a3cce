"""Near duplicates by ProbMinHash, banding and verification.

A document is the set of its shingles (words in a row), weighted by 1 + ln of how often each occurs
(so that a line that is repeated many times doesn't stand for the whole document). Every shingle is a Poisson process at the rate of its weight: its arrivals, drawn from its hash, fall into
registers at random, and a register keeps the shingle that came first. Two documents agree in a
register with the probability Jaccard similarity of their weights. The arrivals of all shingles come
round by round, and a shingle ends as soon as its next arrival is behind the last register's first.
Links are of the plain sets, which can be far more similar than the weights where a line is repeated in
one document alone. So all registers are also drawn with weights of 1, which makes it the Jaccard similarity
of the sets, and documents are candidates that meet by the ones or the others (the same ones where nothing is repeated).

Documents that agree in all registers of a band meet there. Each bucket is two stars, not a clique:
its documents are compared, exactly, by their shingle sets, with the one that meets most others and with its least member.
What links are left in buckets of several classes a prefix filter finds exactly: under any order of
shingles, two similar sets share one of the first few of either, and an order by a count sketch puts
rare ones first. So the number of jobs doesn't depend on the data, but for the components' few turns.
Exact copies have one class from the start, so that only different texts are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import slices, worker_state, written
from lettermill.llm.components import connected_components

WORDS = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 (of the plain sets) two documents meet in a band with 1 - (1 - 0.8**5)**24, all but 7 in 100,000, at 0.85 all but 1 in a million.
BANDS, ROWS = 24, 5
#: Words whose hashes a Python worker remembers; beyond, it starts afresh.
REMEMBERED = 400_000
#: Cells of the count sketch of shingles, which is broadcast (8 MB whatever the input).
CELLS = 1 << 20
#: Pairs (of 16 bytes) that are broadcast at most.
FEW_PAIRS = 250_000

def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every shingle; a text with fewer words is one shingle, one without words none."""
    known: dict[str, int] = worker_state("near_dedup", dict)
    if len(known) > REMEMBERED:
        known.clear()
    split = [t.lower().split() for t in texts]
    for w in set().union(*split).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    flat = np.fromiter(map(known.__getitem__, (w for x in split for w in x)), np.uint64)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    doc = np.repeat(np.arange(len(split)), sizes)
    place = np.arange(len(flat)) - starts[doc]
    first = np.flatnonzero((place + words <= sizes[doc]) | ((place == 0) & (sizes[doc] < words)))
    out = np.zeros(len(first), np.uint64)
    for i in range(words):
        at = first + i
        inside = at < ends[doc[first]]
        out = np.where(inside, mixed(out + flat[np.minimum(at, max(0, len(flat) - 1))]) if len(flat) else out, out)
    return doc[first], out


def weighted(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document with their counts, ascending."""
    order = np.lexsort((shingle, doc))
    d, s = doc[order], shingle[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1])])) if len(d) else np.zeros(0, np.int64)
    return d[new], s[new], np.diff(np.append(new, len(d)))


def prob_min_hash(n: int, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, registers: int) -> np.ndarray:
    """For each of n documents (each with a shingle at least) the first shingle of every register; weight is a count, whose rate is 1 + ln."""
    least = np.full(n * registers, np.inf)
    out = np.zeros(n * registers, np.uint64)
    time, rate, count = np.zeros(len(doc)), 1.0 + np.log(weight), 0
    last = np.full(n, np.inf)
    while len(doc):
        count += 1
        draw = mixed(shingle + np.uint64((0x9E3779B97F4A7C15 * count) & (2**64 - 1)))
        time = time - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) / 2.0**53) / rate
        soon = time < last[doc]
        doc, shingle, time, rate, draw = doc[soon], shingle[soon], time[soon], rate[soon], draw[soon]
        at = doc * registers + (mixed(draw + np.uint64(0xA0761D6478BD642F)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(least, at, time)
        first = time == least[at]
        out[at[first]] = shingle[first]
        touched = np.unique(doc)
        last[touched] = least.reshape(n, registers)[touched].max(1)
        soon = time < last[doc]
        doc, shingle, time, rate = doc[soon], shingle[soon], time[soon], rate[soon]
    return out.reshape(n, registers)


def band_hashes(signatures: np.ndarray, bands: int) -> np.ndarray:
    n = len(signatures)
    parts = signatures.reshape(n, bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands))
    for i in range(parts.shape[2]):
        h = mixed(h + parts[:, :, i])
    return h.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(h, bands) of the texts that have words; copies in the same batch once.

    The first half has the bands by plain sets, the second those by weights (null where they are the same).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            once = dict(zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True))
            doc, shingle, weight = weighted(*shingles(list(once.values()), words))
            some, doc = np.unique(doc, return_inverse=True)
            if not len(some):
                continue
            made = np.zeros((len(some), 2 * bands), np.int64)
            made[:, :bands] = band_hashes(prob_min_hash(len(some), doc, shingle, np.ones(len(doc)), bands * rows), bands)
            made[:, bands:] = made[:, :bands]
            uneven = np.unique(doc[weight > 1])
            if len(uneven):
                of = np.isin(doc, uneven)
                made[uneven, bands:] = band_hashes(prob_min_hash(len(uneven), np.searchsorted(uneven, doc[of]), shingle[of], weight[of], bands * rows), bands)
            none = np.zeros(made.shape, bool)
            none[:, bands:] = made[:, bands:] == made[:, :bands]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(made.ravel(), mask=none.ravel()), 2 * bands).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(once), np.int64)[some]), lists], names=["h", "bands"])

    return docs.select("h", "text").mapInArrow(run, "h long, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            doc, shingle, _ = weighted(*shingles(batch.column("text").to_pylist(), words))
            parts = [np.unique(x) for x in np.split((shingle >> np.uint64(32)).astype(np.uint32), np.searchsorted(doc, np.arange(1, batch.num_rows)))]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array([x.tobytes() for x in parts], pa.binary())], names=["h", "shingles"])

    return docs.select("h", "text").mapInArrow(run, "h long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of that similarity. Few pairs go to the sets, else the sets come to the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                keep.append(min(len(p), len(q)) >= least * max(len(p), len(q)) and similarity(p, q) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sent = F.broadcast(pairs) if pairs.count() <= FEW_PAIRS else pairs
    with_a = sets.select(F.col("h").alias("a"), F.col("shingles").alias("x")).join(sent, "a")
    both = with_a.join(sets.select(F.col("h").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (h, comp) when links (a, b) join their components."""
    ends = links.join(labels.select(F.col("h").alias("a"), F.col("comp").alias("x")), "a").join(labels.select(F.col("h").alias("b"), F.col("comp").alias("y")), "b")
    merged = connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return written(labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("h", F.coalesce("to", "comp").alias("comp")))


def _stars(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of each text with two centres of each of its buckets: the one that meets most others in all buckets, and the one of least hash."""
    weight = met.groupBy("h").agg(F.sum("n").alias("weight"))
    heads = met.join(weight, "h").groupBy("i", "band").agg(F.max(F.struct("weight", "h"))["h"].alias("hub"), F.min("h").alias("least"))
    to = F.explode(F.array("hub", "least"))
    return met.join(heads, ["i", "band"]).select(to.alias("a"), F.col("h").alias("b")).filter("a <> b").distinct()


def _left(met: DataFrame, labels: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different classes that can be similar, of which one is in an open bucket outside its largest class.

    Sets of n and at least least * n shingles in common share one of their first n - ceil(least * n) + 1; behind
    the first that they share, enough must be left in both.
    """
    sizes = labels.groupBy("comp").agg((-F.count(F.lit(1))).alias("less"))
    rest = met.select("i", "band", "h").join(labels.join(sizes, "comp"), "h")
    heads = rest.groupBy("i", "band").agg(F.min("comp").alias("c"), F.max("comp").alias("d"), F.min(F.struct("less", "comp"))["comp"].alias("largest"))
    sides = rest.join(heads.filter("c < d").select("i", "band", "largest"), ["i", "band"]).groupBy("h").agg(F.first("comp").alias("comp"), F.bool_or(F.col("comp") != F.col("largest")).alias("out"))
    mine = written(sets.join(sides, "h"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in slices(batches, "shingles"):
            cells += np.bincount(np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.uint32) % CELLS, minlength=CELLS)
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], names=["cell", "n"])

    counted = mine.select("shingles").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows of two numbers
    cells = np.zeros(CELLS, np.int64)
    cells[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    sent = mine.sparkSession.sparkContext.broadcast(cells)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles"):
            parts, sizes, kept, places = [], [], [], []
            for raw in batch.column("shingles").to_pylist():
                x = np.frombuffer(raw, np.uint32)
                keep = len(x) - int(np.ceil(least * len(x) - 1e-9)) + 1
                parts.append(x[np.lexsort((x, sent.value[x % CELLS]))[:keep]])
                sizes.append(len(x)), kept.append(len(parts[-1])), places.append(np.arange(len(parts[-1])))
            row = pa.array(np.repeat(np.arange(batch.num_rows), kept))
            made = [batch.column(c).take(row) for c in ("h", "comp", "out")]
            columns = [pa.array(x.astype(np.int64)) for x in (np.repeat(sizes, kept), np.repeat(sizes, kept) - np.concatenate(places), np.concatenate(parts))]
            yield pa.RecordBatch.from_arrays([*made, *columns], names=["h", "comp", "out", "n", "rest", "s"])

    prefixes = mine.mapInArrow(first, "h long, comp long, out boolean, n long, rest long, s long")
    others = prefixes.select("s", F.col("h").alias("g"), F.col("comp").alias("comp_g"), F.col("n").alias("m"), F.col("rest").alias("rest_g"))
    fits = (F.col("comp") != F.col("comp_g")) & (F.col("n") >= least * F.col("m") - 1e-9) & (F.col("m") >= least * F.col("n") - 1e-9)
    enough = F.least("rest", "rest_g") * (1 + least) >= least * (F.col("n") + F.col("m")) - 1e-6
    pairs = written(prefixes.filter("out").join(others, "s").filter(fits & enough).select(F.least("h", "g").alias("a"), F.greatest("h", "g").alias("b")).distinct())
    sent.unpersist()
    return pairs


def near_duplicates(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, class_size, class_links, is_first and text_hash of every document.

    Documents belong to one class if links of a similarity of at least least (Jaccard, sets of
    shingles of lower-case words) join them, or if their texts are equal. class_id is the least
    doc_id of the class (null if it has none); is_first is true of that doc_id's rows (without any, of
    the rows with one of the texts). class_links counts the links between different texts of the class
    that were compared, as many as join it or more. A null text is
    empty; texts without words are in a class with equal texts alone; repeated rows are in one class; an
    empty table gives no rows. Texts are told apart by a 64-bit
    hash, the shingles of a pair by 32 bits. Only doc_id and text are read.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    signed = written(_signed(keyed, words, bands, rows)).select("h", F.posexplode("bands").alias("i", "band")).filter("band IS NOT NULL")
    ends = signed.groupBy("i", "band").agg(F.min("h").alias("first"), F.max("h").alias("last"), F.count(F.lit(1)).alias("n")).filter("first < last")
    met = written(signed.join(ends.select("i", "band", "n"), ["i", "band"]))
    nodes = met.select("h").distinct()
    texts = keyed.groupBy("h").agg(F.first("text").alias("text")).join(nodes, "h", "left_semi")  # each text once, however its rows repeat; copies go before the shuffle
    sets = written(_sets(texts, words))
    links = written(_verified(written(_stars(met)), sets, least))
    labels = _joined(sets.select("h", F.col("h").alias("comp")), links)
    more = written(_verified(_left(met, labels, sets, least), sets, least))
    labels = _joined(labels, more)
    light = keyed.select("doc_id", "h").join(labels, "h", "left").select("doc_id", "h", F.coalesce("comp", "h").alias("comp"))
    found = links.unionByName(more).select(F.least("a", "b").alias("h"), F.greatest("a", "b").alias("b")).distinct()
    counted = found.join(labels, "h").groupBy("comp").agg(F.count(F.lit(1)).alias("class_links"))
    classes = light.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    classes = written(classes.join(counted, "comp", "left").withColumn("class_links", F.coalesce("class_links", F.lit(0).cast("long"))))
    first = F.when(F.col("class_id").isNull(), F.col("h") == F.col("comp")).otherwise(F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))
    return light.join(classes, "comp").select("doc_id", "class_id", "class_size", "class_links", first.alias("is_first"), F.col("h").alias("text_hash"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (documents' columns), of each class of near duplicates one: that of the least doc_id.

    Of rows with equal doc_id and text one is kept. Classes without any doc_id keep one row.
    """
    firsts = near_duplicates(docs, **options).filter("is_first").select(F.coalesce("doc_id", F.lit(-1)).alias("d"), F.col("text_hash").alias("h")).distinct()
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "h": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    return rows.join(firsts, ["d", "h"], "left_semi").dropDuplicates(["d", "h"]).drop("d", "h")
