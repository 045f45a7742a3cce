"""Removal of long byte strings that occur more than once, by a distributed merge of sorted suffixes.

Not every suffix is sorted. Each string of LENGTH bytes has an anchor: of its K-grams that of least
hash, the rightmost of equals. Equal strings have equal anchors at equal places, so only suffixes
that begin at anchors count, and of those only anchors whose K-gram occurs more than once.

Each task sorts its suffixes into runs, one for each target, and front-codes them: a suffix carries
the length of the prefix that it shares with the one before, and what follows. A target combines the
runs with a loser tree in which suffixes meet with the lengths that they share with the last winner:
the longer one wins unseen, and only equals are compared, from that length on. The merge yields
the shared lengths of neighbours, and so the suffixes that share any given length; together with
equal bytes before the anchor these are the equal strings.

No group grows with the data: within a task, suffixes with equal surroundings become one (their
strings are known to repeat), so a passage common to all documents sends one suffix a task. Anchors
that occur more than HEAVY times would still fill a target where their surroundings differ (a line of
150 bytes that is everywhere, say). Of these only the strings whose 64-bit hash occurs more than once
go on, in a second merge of the same kind, dealt by all but BLOCK - 1 of their bytes instead of by the
K-gram alone: what occurs once is dropped, and what occurs in the same surroundings becomes one suffix
a task, as before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import id_and_text, slices, written
from lettermill.llm.fingerprints import BASE, rolling

LENGTH = 200
K = 64
HEAVY = 2000
#: Strings of a heavy anchor are dealt together whose distances to it differ by less than this.
BLOCK = 17
#: Windows whose anchors are found at once; positions in such a segment have 24 bits.
SEGMENT = 1 << 23
SPANS = "array<struct<start:bigint,end:bigint>>"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
#: Suffixes that a task sorts at once.
RUN = 300_000


def anchors(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text's strings: hash, position, and the least and largest distance from a string's start to it."""
    w, parts = length - k + 1, []
    for start in range(0, max(0, len(data) - length + 1), SEGMENT):
        h = rolling(data[start : start + SEGMENT + length - 1], k)
        keys = (h & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - np.arange(len(h), dtype=np.uint64))
        done = 1
        while done < w:
            step = min(done, w - done)
            keys = np.minimum(keys[:-step], keys[step:])
            done += step
        at = (np.uint64(0xFFFFFF) - (keys & np.uint64(0xFFFFFF))).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        x = at[first]
        parts.append((h[x].view(np.int64), x + start, x - last, x - first))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that are equal in their first known bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def loser_tree(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merges sorted runs of (strings, lengths shared with the one before): yields run, place and the
    length shared with the last string that came out."""
    size = 1
    while size < len(runs):
        size *= 2
    heads = [0] * size
    texts = [r[0] for r in runs] + [[]] * (size - len(runs))

    def meet(r: int, x: int, s: int, y: int) -> tuple[int, int, int, int]:
        """Winner and loser of two heads with the lengths they share with the last winner; -1: the run is over."""
        if x != y:
            return (r, x, s, y) if x > y else (s, y, r, x)
        if x < 0:
            return r, x, s, y
        a, b = texts[r][heads[r]], texts[s][heads[s]]
        n = shared(a, b, x)
        if a[n : n + 1] < b[n : n + 1] or (r < s and len(a) == len(b) == n):
            return r, x, s, n
        return s, x, r, n

    losers: list[tuple[int, int]] = [(-1, -1)] * size
    level = [(r, 0 if texts[r] else -1) for r in range(size)]
    node = size
    while len(level) > 1:
        node //= 2
        up = []
        for i in range(0, len(level), 2):
            r, x, s, y = meet(*level[i], *level[i + 1])
            losers[node + i // 2] = (s, y)
            up.append((r, x))
        level = up
    winner, x = level[0]
    while x >= 0:
        yield winner, heads[winner], x
        heads[winner] += 1
        x = runs[winner][1][heads[winner]] if heads[winner] < len(texts[winner]) else -1
        node = (winner + size) // 2
        while node:
            s, y = losers[node]
            if y > x or (y == x and x >= 0):
                winner, x, s, y = meet(winner, x, s, y)
                losers[node] = (s, y)
            node //= 2


HEADER = 6
NO_ROWS = np.zeros((0, 4), np.int64)


def packed(rights: list[bytes], lefts: list[bytes], places: np.ndarray, strings: np.ndarray, marked: np.ndarray, again: np.ndarray) -> bytes:
    """A front-coded run (rights ascending, their lefts, places), hashes of strings with their places, marked spans, and strings for the second merge."""
    lens = np.fromiter(map(len, rights), np.uint8, len(rights))
    common = [0] + [shared(a, b, 0) for a, b in pairwise(rights)] if rights else []
    tails = b"".join(r[c:] for r, c in zip(rights, common, strict=True))
    lens_left = np.fromiter(map(len, lefts), np.uint8, len(lefts))
    left = b"".join(lefts)
    head = np.array([len(rights), len(tails), len(left), len(strings), len(marked), len(again)], np.int64)
    parts = [head.tobytes(), np.array(common, np.uint8).tobytes(), lens.tobytes(), lens_left.tobytes(), tails, left, places.tobytes(), strings.tobytes(), marked.tobytes(), again.tobytes()]
    return zlib.compress(b"".join(parts), 1)


def unpacked(raw: bytes) -> tuple[list[bytes], list[int], list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    blob = zlib.decompress(raw)
    n, n_tails, n_left, n_strings, n_marked, n_again = np.frombuffer(blob, np.int64, HEADER).tolist()
    at = HEADER * 8

    def take(size: int) -> bytes:
        nonlocal at
        at += size
        return blob[at - size : at]

    common, lens, lens_left = list(take(n)), list(take(n)), list(take(n))
    tails, left = take(n_tails), take(n_left)
    places = np.frombuffer(take(n * 24), np.int64).reshape(n, 3)
    strings, marked, again = (np.frombuffer(take(m * 32), np.int64).reshape(m, 4) for m in (n_strings, n_marked, n_again))
    rights, lefts, i, j, last = [], [], 0, 0, b""
    for c, m, k in zip(common, lens, lens_left, strict=True):
        last = last[:c] + tails[i : i + m - c]
        rights.append(last)
        lefts.append(left[j : j + k])
        i, j = i + m - c, j + k
    return rights, common, lefts, places, strings, marked, again


def repeated(common: np.ndarray, right: np.ndarray, lefts: list[bytes], length: int) -> np.ndarray:
    """Which strings repeat, for merged suffixes: a row each, a column for each distance of a string's start to the anchor.

    common: shared length with the suffix before; right: length of each suffix; lefts: the bytes before the anchors.
    """
    n = len(right)
    hi = np.fromiter(map(len, lefts), np.int64, n)
    most = int(hi.max(initial=0))
    before = np.zeros((n, most), np.uint8)  # backward from the anchor
    flat = np.frombuffer(b"".join(lefts), np.uint8)
    ends = np.cumsum(hi)
    rows = np.repeat(np.arange(n), hi)
    before[rows, ends[rows] - 1 - np.arange(len(flat))] = flat
    lo = length - right
    out = np.zeros((n, most + 1), bool)
    h = np.zeros(n, np.uint64)
    for d in range(most + 1):
        if d:
            h = (h + before[:, d - 1] + np.uint64(1)) * np.uint64(BASE)
            h ^= h >> np.uint64(31)
        here = np.flatnonzero((lo <= d) & (d <= hi))
        if len(here) < 2:
            continue
        group = np.cumsum(common < length - d)[here].astype(np.uint64)
        key = h[here] ^ (group * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        out[here[order], d] = np.append(same, False) | np.insert(same, 0, False)
    return out


def spans_of(flags: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Rows (key, key, start, end) of the bytes that flagged strings cover."""
    edge = np.zeros((len(flags), 1), np.int8)
    change = np.diff(np.concatenate([edge, flags.astype(np.int8), edge], axis=1), axis=1)
    row, first = np.nonzero(change == 1)
    _, last = np.nonzero(change == -1)
    x = places[row, 2]
    return np.stack([places[row, 0], places[row, 1], x - (last - 1), x - first + length], axis=1) if len(row) else NO_ROWS


class Sorter:
    """Suffixes of a task: sorts them into runs for n targets."""

    def __init__(self, n: int, length: int, k: int):
        self.n, self.length, self.k = n, length, k
        self.rows: list[tuple[int, bytes, bytes, tuple[int, int, int]]] = []
        self.strings: list[np.ndarray] = []
        self.marked: list[np.ndarray] = []
        self.docs: dict[tuple[int, int], int] = {}  # the length of those that repeat, else 0
        self.size = 0

    def repeats(self, doc: tuple[int, int], text: bytes) -> bool:
        """Whether the row has been added before: then all of it repeats, and its strings are known."""
        again = doc in self.docs
        self.docs[doc] = len(text) if again else 0
        return again

    def add(self, doc: tuple[int, int], text: bytes, places: list[int]) -> None:
        """places: an anchor's position << 16, the least and the largest distance; negative (and less by one) if heavy."""
        data = np.frombuffer(text, np.uint8)
        p = np.array(places, np.int64)
        heavy = p < 0
        p = np.where(heavy, -p - 1, p)
        x, lo, hi = p >> 16, (p >> 8) & 255, p & 255
        if heavy.any():
            starts = np.concatenate([np.arange(a - c, a - b + 1) for a, b, c in zip(x[heavy].tolist(), lo[heavy].tolist(), hi[heavy].tolist(), strict=True)])
            h = rolling(data, self.length)[starts].view(np.int64)
            code = np.repeat(x[heavy], hi[heavy] - lo[heavy] + 1)
            self.strings.append(np.stack([h, np.full(len(h), doc[0]), np.full(len(h), doc[1]), code << 8 | (code - starts)], axis=1))
            self.size += len(h) // 8
        x, lo, hi = x[~heavy], lo[~heavy], hi[~heavy]
        if len(x):
            target = zlib.crc32
            length, k, n = self.length, self.k, self.n
            self.rows += [(target(text[a : a + k]) % n, text[a : a - b + length], text[a - c : a], (*doc, a)) for a, b, c in zip(x.tolist(), lo.tolist(), hi.tolist(), strict=True)]
        self.size += len(x)

    def add_again(self, doc: tuple[int, int], text: bytes, codes: list[int]) -> None:
        """codes: an anchor's position << 8 and the distance from a string's start to it; one suffix for distances in a row of a block."""
        c = np.unique(np.array(codes, np.int64))
        cut = (np.diff(c) != 1) | (np.diff(c >> 8) != 0) | (np.diff((c & 255) // BLOCK) != 0)
        first = c[np.concatenate([[True], cut])]
        last = c[np.concatenate([cut, [True]])]
        for a, b, d in zip((first >> 8).tolist(), (first & 255).tolist(), (last & 255).tolist(), strict=True):
            low = b - b % BLOCK
            core = text[a - low : a + self.length - low - BLOCK + 1]
            self.rows.append((zlib.crc32(core) % self.n, text[a : a - b + self.length], text[a - d : a], (*doc, a)))
        self.size += len(first)

    def runs(self) -> Iterator[tuple[int, bytes]]:
        """A blob for each target; what is found to repeat within the task is marked and needs no more places."""
        rows, length = sorted(self.rows), self.length
        marked = [*self.marked, np.array([(*doc, 0, n) for doc, n in self.docs.items() if n], np.int64).reshape(-1, 4)]
        kept: dict[int, tuple[list, list, list]] = {}
        i = 0
        while i < len(rows):
            target, right, left, place = rows[i]
            j = i + 1
            while j < len(rows) and rows[j][1] == right and rows[j][2] == left:
                j += 1
            if j > i + 1:
                lo, hi = length - len(right), len(left)
                marked.append(np.array([(r[3][0], r[3][1], r[3][2] - hi, r[3][2] - lo + length) for r in rows[i:j]], np.int64))
                place = (0, 0, -1)
            to = kept.setdefault(target, ([], [], []))
            to[0].append(right), to[1].append(left), to[2].append(place)
            i = j
        strings = np.concatenate(self.strings) if self.strings else NO_ROWS
        again = NO_ROWS
        if len(strings):
            strings = strings[np.argsort(strings[:, 0], kind="stable")]
            new = np.concatenate([[True], strings[1:, 0] != strings[:-1, 0]])
            many = np.diff(np.append(np.flatnonzero(new), len(strings))) > 1
            twice = np.repeat(many, np.diff(np.append(np.flatnonzero(new), len(strings))))
            again = np.roll(strings[twice], -1, axis=1)
            strings = strings[new]
            strings[many, 3] = -1
        found = merged_spans(np.concatenate(marked)) if marked else NO_ROWS
        strings_of = by_target(strings, (strings[:, 0].view(np.uint64) % np.uint64(self.n)).astype(np.int64))
        found_of = by_target(found, found[:, 1] % self.n)  # by a hash of the document
        again_of = by_target(again, again[:, 1] % self.n)
        for target in sorted(kept.keys() | strings_of.keys() | found_of.keys() | again_of.keys()):
            rights, lefts, places = kept.get(target, ([], [], []))
            yield target, packed(rights, lefts, np.array(places, np.int64).reshape(len(rights), 3), *(x.get(target, NO_ROWS) for x in (strings_of, found_of, again_of)))
        self.rows, self.strings, self.marked, self.docs, self.size = [], [], [], {}, 0


def by_target(rows: np.ndarray, target: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(target, kind="stable")
    names, first = np.unique(target[order], return_index=True)
    return dict(zip(names.tolist(), np.split(rows[order], first[1:]), strict=True)) if len(rows) else {}


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """Spans (key, key, start, end) with those of a document that touch joined."""
    if not len(spans):
        return spans
    s = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    doc = np.concatenate([[0], np.cumsum((s[1:, :2] != s[:-1, :2]).any(1))])
    lift = int(s[:, 3].max()) + 1  # documents one after another, so that one running maximum does
    reach = np.maximum.accumulate(s[:, 3] + doc * lift)
    new = np.concatenate([[True], s[1:, 2] + doc[1:] * lift > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    return np.stack([s[first, 0], s[first, 1], s[first, 2], reach[last] - doc[last] * lift], axis=1)


def combine(blobs: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans of what repeats among the runs of one target, and the strings of heavy anchors whose hash does (with the document, a code)."""
    runs, places, lefts, out, strings, again = [], [], [], [], [], []
    for rights, common, left, place, string, marked, once_more in map(unpacked, blobs):
        out.append(marked)
        again.append(once_more)
        strings.append(string)
        if rights:
            runs.append((rights, common))
            lefts.append(left)
            places.append(place)
    if runs:
        order = list(loser_tree(runs))
        common = np.fromiter((x[2] for x in order), np.int64, len(order))
        right = np.fromiter((len(runs[r][0][i]) for r, i, _ in order), np.int64, len(order))
        place = np.array([places[r][i] for r, i, _ in order])
        flags = repeated(common, right, [lefts[r][i] for r, i, _ in order], length)
        some = place[:, 2] >= 0
        out.append(spans_of(flags[some], place[some], length))
    string = np.concatenate(strings) if strings else NO_ROWS
    if len(string):
        string = string[np.argsort(string[:, 0], kind="stable")]
        same = string[1:, 0] == string[:-1, 0]
        twice = (np.append(same, False) | np.insert(same, 0, False)) & (string[:, 3] >= 0)
        again.append(np.roll(string[twice], -1, axis=1))
    more = np.concatenate(again) if again else NO_ROWS
    return merged_spans(np.concatenate(out)) if out else NO_ROWS, more[np.lexsort((more[:, 1], more[:, 0]))]


def lists_by_document(rows: np.ndarray, values: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The documents of sorted rows (key, key, ..), and the values of each as a list."""
    first = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]))
    return pa.array(rows[first, 0]), pa.array(rows[first, 1]), pa.ListArray.from_arrays(pa.array([*first.tolist(), len(rows)], pa.int32()), values)


def _repeats(docs: DataFrame, length: int, k: int, heavy: int) -> DataFrame:
    """(d, h, spans): spans of repeats, which can overlap, in one or more rows a document. docs has d, h and text."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            parts = []
            for d, h, text in zip(batch.column("d").to_pylist(), batch.column("h").to_pylist(), batch.column("text"), strict=True):
                a = anchors(np.frombuffer(text.as_buffer(), np.uint8), length, k)
                if len(a[0]):
                    parts.append((a[0], np.full(len(a[0]), d), np.full(len(a[0]), h), a[1] << 16 | a[2] << 8 | a[3]))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["hash", "d", "h", "place"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sorter(n, length, k)

        def flush() -> Iterator[pa.RecordBatch]:
            for target, blob in s.runs():
                yield pa.RecordBatch.from_arrays([pa.array([target], pa.int32()), pa.array([blob], pa.binary())], names=["target", "run"])

        for batch in slices(batches, "text"):
            for d, h, text, places, again in zip(batch.column("d").to_pylist(), batch.column("h").to_pylist(), batch.column("text"), batch.column("places"), batch.column("again").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                if not s.repeats((d, h), raw):
                    (s.add_again if again else s.add)((d, h), raw, places.as_py())
                if s.size >= RUN:
                    yield from flush()
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, again = combine([x for b in batches for x in b.column("run").to_pylist()], length)
        if len(spans):
            d, h, lists = lists_by_document(spans, pa.StructArray.from_arrays([pa.array(spans[:, 2]), pa.array(spans[:, 3])], names=["start", "end"]))
            yield pa.RecordBatch.from_arrays([d, h, lists, pa.nulls(len(d), pa.list_(pa.int64()))], names=["d", "h", "spans", "codes"])
        if len(again):
            d, h, lists = lists_by_document(again, pa.array(again[:, 2]))
            yield pa.RecordBatch.from_arrays([d, h, pa.nulls(len(d), pa.list_(span)), lists], names=["d", "h", "spans", "codes"])

    def merged(places: DataFrame, again: bool) -> DataFrame:
        runs = docs.join(places.withColumn("again", F.lit(again)), ["d", "h"]).mapInArrow(sort, "target int, run binary")  # all columns, so that with_spans() uses the same exchange of docs
        return runs.repartitionById(n, F.col("target")).mapInArrow(merge, f"d long, h long, spans {SPANS}, codes array<bigint>")

    found = docs.select("d", "h", "text").filter(F.octet_length("text") >= length).mapInArrow(find, "hash long, d long, h long, place long")
    counts = written(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))  # a frequent hash then is a skewed join, which Spark splits
    places = found.join(counts, "hash").select("d", "h", F.when(F.col("n") > heavy, -F.col("place") - 1).otherwise(F.col("place")).alias("place"))
    first = merged(places.groupBy("d", "h").agg(F.collect_set("place").alias("places")), False)  # of one document, once where its rows repeat
    if counts.filter(F.col("n") > heavy).limit(1).count():
        first = written(first)
        codes = first.filter("codes IS NOT NULL").groupBy("d", "h").agg(F.flatten(F.collect_list("codes")).alias("places"))  # of one document
        second = merged(codes, True)
        first = first.unionByName(second)
    return first.filter("spans IS NOT NULL").select("d", "h", "spans")


def with_spans(docs: DataFrame, length: int = LENGTH, k: int = K, heavy: int = HEAVY) -> DataFrame:
    """docs with a column spans: the maximal spans of bytes that strings cover which also start elsewhere; null without any."""
    if not BLOCK <= k <= length <= 255:
        raise ValueError(f"strings have 255 bytes at most, of which {BLOCK} or more make an anchor")
    keyed = docs.withColumns({"d": F.coalesce("doc_id", F.lit(NO_ID)), "h": F.xxhash64("text", "doc_id")}).drop("doc_id")
    found = _repeats(keyed, length, k, heavy)
    spans = found.groupBy("d", "h").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # of one document

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            joined = [[{"start": a, "end": b} for _, _, a, b in merged_spans(np.array([(0, 0, s["start"], s["end"]) for s in x], np.int64)).tolist()] for x in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("h"), pa.array(joined, kind)], names=["d", "h", "spans"])

    maximal = spans.mapInArrow(join, f"d long, h long, spans {SPANS}")
    joined = keyed.join(maximal, ["d", "h"], "left").withColumn("doc_id", F.when(F.col("d") != NO_ID, F.col("d")))
    return joined.select(*docs.columns, "spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (null without any) and kept (bytes) of every document.

    Every byte that a string of length bytes covers which also starts anywhere else (in any document,
    or in the same, overlapping or not) is removed, judged on the input. Texts are UTF-8 bytes; a null
    or short text has nothing to remove. Rows with equal doc_id and text are occurrences of their own;
    a null doc_id stays null; an empty table gives no rows. Strings are compared by the bytes from the
    anchor on and a 64-bit hash of those before it; heavy only says from how often on an anchor takes the
    second merge, and changes no result. length is 255 at most. Only doc_id and text are read.
    """
    rows = with_spans(id_and_text(docs), length, k, heavy)
    size = F.octet_length("text").cast("long")
    gone = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0).cast("long"))
    made = rows.select("doc_id", size.alias("n_bytes"), gone.alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), "spans", F.col("text").cast("binary").alias("kept"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "kept"):
            kept = [b"".join(raw[a:b] for a, b in zip([0, *(s["end"] for s in spans)], [*(s["start"] for s in spans), len(raw)], strict=True)) if spans else raw for raw, spans in zip(batch.column("kept").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kept, pa.binary())], names=batch.schema.names)

    return made.mapInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, spans {SPANS}, kept binary")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (documents' columns) with their texts less the repeated bytes, of characters that
    are cut the whole; n_chars is the new length. A null text stays null, and a text of which nothing
    is left is empty."""

    def whole(text: bytes, spans: list[dict]) -> str:
        ends = [0, *(x for s in spans for x in (s["start"], s["end"])), len(text)]
        for i in range(1, len(ends) - 1, 2):  # a character that is cut goes
            while ends[i] > ends[i - 1] and text[ends[i]] & 0xC0 == 0x80:
                ends[i] -= 1
            while ends[i + 1] < len(text) and text[ends[i + 1]] & 0xC0 == 0x80:
                ends[i + 1] += 1
        return b"".join(text[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2)).decode("utf-8", "ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [None if t is None else whole(t.encode(), s) if s else t for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            made = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([n if t is None else len(t) for t, n in zip(texts, batch.column("n_chars").to_pylist(), strict=True)], pa.int64())}
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in COLUMNS], names=list(COLUMNS))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return with_spans(rows, **options).mapInArrow(run, types)
