"""Language ID by prediction by partial matching (PPM).

For each language a tree of byte contexts of orders 0 to 4 is learned once and then frozen. A byte
costs -log2 of its probability in the longest known context, plus the cost of an escape for each
longer context that doesn't have it (escape method C: a context seen n times with t different bytes
escapes with t / (n + t)); below order 0 all bytes are equally likely. A text is its bytes in lower
case with one space for any white space, behind spaces; contexts run through the whole of it. The
language with the shortest exact code length wins.

The trees lie in sorted arrays, one for each order: a context with its byte is an integer, so the
different ones of a slice of texts are looked up at once, and a text's code length is a sum.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import slices, worker_state

ORDER = 4
#: The model is fitted on a bounded sample of the labelled rows: about so many documents of each language (twice as many at
#: most), of each so many characters, of so many languages (the most frequent ones).
SAMPLE_DOCS = 150
SAMPLE_CHARS = 20_000
MOST_LANGS = 200
UNKNOWN = "und"
#: A text is rejected whose bits a byte are so many times the usual ones (the median) of its language's labelled rows; beyond, bytes cost about as much as at random.
REJECTED = 3.0
#: Bits above the usual ones that a text needs to be rejected: a few bytes tell too little.
EVIDENCE = 64.0


def normal(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of each text behind order bytes, as an integer, and how many each text has."""
    pad = b" " * order
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.zeros(len(data), np.uint64)
    for back in range(order + 1):
        codes[back:] |= data[: len(data) - back].astype(np.uint64) << np.uint64(8 * back)
    ends = np.cumsum(sizes + order)
    real = np.ones(len(data), bool)
    for i in range(order):
        real[ends - sizes - order + i] = False
    return codes[real], sizes


def low_bytes(codes: np.ndarray, n: int) -> np.ndarray:
    return codes & np.uint64((1 << 8 * n) - 1)


def rows_at(keys: np.ndarray, table: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    """The table's rows of the wanted keys."""
    if not len(keys):
        return np.full((len(wanted), table.shape[1]), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], table[at], missing)


class Model:
    """Frozen statistics: for each order the bits of every known context and byte, and of every context's escape, in each language."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.langs, self.order = sorted(texts), order
        counted = [np.unique(grams(list(map(normal, texts[x])), order)[0], return_counts=True) for x in self.langs]
        self.known: list[tuple[np.ndarray, np.ndarray]] = []
        self.escape: list[tuple[np.ndarray, np.ndarray]] = []
        for o in range(order + 1):
            known, escape = [], []
            for codes, n in counted:
                keys, at = np.unique(low_bytes(codes, o + 1), return_inverse=True)
                times = np.bincount(at, n, len(keys))
                contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
                seen, kinds = np.bincount(of, times, len(contexts)), np.bincount(of, minlength=len(contexts))
                known.append((keys, -np.log2(times / (seen + kinds)[of])))
                escape.append((contexts, -np.log2(kinds / (seen + kinds))))
            self.known.append(self._table(known, np.nan))
            self.escape.append(self._table(escape, 0.0))
        self.usual = np.array([np.median(x) if len(x) else 8.0 for x in (self._rates(texts[k], i) for i, k in enumerate(self.langs))])

    def _table(self, parts: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([k for k, _ in parts])) if parts else np.zeros(0, np.uint64)
        out = np.full((len(keys), len(parts)), missing)
        for i, (k, cost) in enumerate(parts):
            out[np.searchsorted(keys, k), i] = cost
        return keys, out

    def _rates(self, texts: list[str], lang: int) -> np.ndarray:
        total, sizes = self.totals(texts)
        return total[sizes > 0, lang] / sizes[sizes > 0]

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Cost in each language of the last byte of each code behind the bytes before it."""
        total = np.zeros((len(codes), len(self.langs)))
        left = np.ones(total.shape, bool)
        for o in range(self.order, -1, -1):
            cost = rows_at(*self.known[o], low_bytes(codes, o + 1), np.nan)
            hit = left & ~np.isnan(cost)
            total[hit] += cost[hit]
            left &= ~hit
            total += np.where(left, rows_at(*self.escape[o], low_bytes(codes >> np.uint64(8), o), 0.0), 0.0)
        return total + 8.0 * left

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each text in each language, and its bytes."""
        codes, sizes = grams(list(map(normal, texts)), self.order)
        out = np.zeros((len(texts), len(self.langs)))
        if len(codes):
            some, at = np.unique(codes, return_inverse=True)
            full = np.flatnonzero(sizes)
            out[full] = np.add.reduceat(self.bits(some)[at], (np.cumsum(sizes) - sizes)[full], axis=0)
        return out, sizes


def model_of(pickled: bytes) -> Model:
    return worker_state(("language_id", hashlib.sha1(pickled).digest()), lambda: pickle.loads(pickled))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, order: int = ORDER, most_langs: int = MOST_LANGS) -> Model:
    """A model from text and lang of the rows that aren't held out, on a bounded sample (see SAMPLE_DOCS).

    The sample is drawn by a hash of doc_id at a rate that follows from the count of each language's ids,
    so it reaches the driver without a shuffle of texts; its size doesn't depend on the input's, even where
    rows repeat. Without labelled rows nothing is learned.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(~F.coalesce(held_out(), F.lit(False)) & F.col("lang").isNotNull())
    ids = F.coalesce("doc_id", F.lit(-1))
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct(ids).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    draw, rate = F.pmod(F.xxhash64(F.lit(9), ids), F.lit(1 << 40)), None
    for lang, n in counts.items():
        hit = (F.col("lang") == lang) & (draw < math.ceil(min(1.0, sample_docs / n) * (1 << 40)))
        rate = hit if rate is None else rate | hit
    texts: dict[str, list[str]] = {lang: [] for lang in counts}
    if rate is not None:
        few = rows.filter(rate & F.col("text").isNotNull()).groupBy("lang", draw.alias("draw")).agg(F.min(F.substring("text", 1, sample_chars)).alias("text"))  # one for each id, however its rows repeat
        nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
        for r in few.withColumn("nth", nth).filter(F.col("nth") <= 2 * sample_docs).select("lang", "text").collect():
            texts[r["lang"]].append(r["text"])
    return Model({k: sorted(v) for k, v in texts.items() if v}, order)


SCHEMA = "doc_id long, lang_pred string, score double, bits_per_byte double, usual double, excess double"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte, usual and excess of every whole text.

    lang_pred is und if the text is null or has no letter, or if no language was learned; score is
    the probability of the language among the learned ones given the code lengths (0 for und), ties
    to the first in alphabetical order; bits_per_byte is the code length in the best language for
    each byte, usual the median of that language's labelled rows, excess the bits above usual ones (all null for und). A null doc_id stays null; repeated rows give repeated rows; an empty
    table gives no rows. Only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _identified(rows, model, [], SCHEMA)


def keep_identified(docs: DataFrame, model: Model, rejected: float = REJECTED) -> DataFrame:
    """The rows of docs (documents' columns) in a learned language: those that are und go, and those that
    cost rejected times the bits that are usual in their language or more, and at least EVIDENCE bits above these."""
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = _identified(rows, model, ["text", "lang", "source", "n_chars"], f"{types}, lang_pred string, score double, bits_per_byte double, usual double, excess double")
    return out.filter((F.col("lang_pred") != UNKNOWN) & ((F.col("bits_per_byte") < rejected * F.col("usual")) | (F.col("excess") < EVIDENCE))).select(*rows.columns)


def _identified(rows: DataFrame, model: Model, more: list[str], schema: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # of bounded size, as the sample is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(sent.value)
        for batch in slices(batches, "text", 1 << 20):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            total, sizes = m.totals(texts)
            pred, score, bits, usual, excess = [], [], [], [], []
            for t, x, n in zip(texts, total, sizes.tolist(), strict=True):
                if not m.langs or not any(map(str.isalpha, t)):
                    pred.append(UNKNOWN), score.append(0.0), bits.append(None), usual.append(None), excess.append(None)
                    continue
                k = int(np.argmin(x))
                pred.append(m.langs[k]), bits.append(float(x[k]) / n), usual.append(float(m.usual[k])), excess.append(float(x[k] - m.usual[k] * n))
                score.append(float(1 / np.exp2(np.maximum(x[k] - x, -1000.0)).sum()))
            made = [pa.array(pred, pa.string()), *(pa.array(c, pa.float64()) for c in (score, bits, usual, excess))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in more), *made], names=["doc_id", *more, "lang_pred", "score", "bits_per_byte", "usual", "excess"])

    return rows.mapInArrow(run, schema)
