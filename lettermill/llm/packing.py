"""Packing of tokenized documents into windows by Karmarkar-Karp multiway differencing.

Each task packs its own documents in blocks of bounded size, so nothing is shuffled and no group
grows with the data. In a block every item (a document, or what is left of it after whole windows
are cut off) starts as a partial partition of k windows that are empty but for one. The two partial
partitions with the largest spread are merged again and again, the fullest windows of one onto the
emptiest of the other, until one near-equal partition is left. While a window exceeds the capacity,
the window count k rises. Where cutting is allowed, the emptiest of the windows found so are cut up
to fill the little room in the others, and what is left takes sequences of powers of two.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lettermill.llm.common import id_and_text, slices, worker_state

#: Whitespace-separated chunks that a Python worker remembers; beyond, it starts afresh.
REMEMBERED = 800_000
MARKS = ".,!?"
#: Tokens of a block of documents that are packed together.
BLOCK_TOKENS = 1 << 18
#: Sequences that one task can number.
PER_TASK = 1 << 31


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The items (by number) of k windows with near-equal sums."""
    if k == 1:
        return [list(range(len(sizes)))]
    heap = []
    for i, x in enumerate(sizes):  # sums in ascending order, with a chain of items for each
        sums = np.zeros(k, np.int64)
        sums[-1] = x
        heap.append((-x, i, sums, [None] * (k - 1) + [(i,)]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums = a + b[::-1]
        joined = [p if q is None else q if p is None else (p, q) for p, q in zip(x, reversed(y), strict=True)]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), i, sums - sums[0], [joined[j] for j in order]))
    out = []
    for chain in heap[0][3]:
        items, todo = [], [chain] if chain is not None else []
        while todo:
            x = todo.pop()
            if len(x) == 1:
                items.append(x[0])
            else:
                todo += [x[1], x[0]]
        out.append(items)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of whole items, none above the capacity; their number rises until that holds."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("an item exceeds the capacity")
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        out = differencing(sizes, k)
        if max(sum(sizes[i] for i in w) for w in out) <= capacity:
            return [w for w in out if w]
        k += max(1, k // 64)


def cut_windows(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length), items cut freely.

    All sequences are full, but for those of the last sum modulo the capacity, which have a power of
    two each. Whole windows are cut off long items first, the rest goes through windows(), and the emptiest
    of these fill the others.
    """
    out: list[list[tuple[int, int, int]]] = []
    rests: list[tuple[int, int, int]] = []
    for i, n in enumerate(sizes):
        full = n - n % capacity
        out += [[(i, s, capacity)] for s in range(0, full, capacity)]
        if n > full:
            rests.append((i, full, n - full))
    made = [[rests[j] for j in w] for w in windows([x[2] for x in rests], capacity)]
    made.sort(key=lambda w: -sum(x[2] for x in w))
    k = sum(x[2] for x in rests) // capacity
    last = [x for w in made[k:] for x in w]
    for pieces in made[:k]:
        room = capacity - sum(x[2] for x in pieces)
        while room:
            i, s, n = last.pop()
            take = min(n, room)
            pieces.append((i, s, take))
            if n > take:
                last.append((i, s + take, n - take))
            room -= take
        out.append(pieces)
    bit = capacity
    while last:
        bit >>= 1
        left = sum(x[2] for x in last)
        if left & bit:
            pieces, room = [], bit
            while room:
                i, s, n = last.pop()
                take = min(n, room)
                pieces.append((i, s, take))
                if n > take:
                    last.append((i, s + take, n - take))
                room -= take
            out.append(pieces)
    return out


class Ids:
    """Token ids of whole texts as little-endian bytes; remembers chunks between spaces, over which no token goes."""

    def __init__(self, tokenizer_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.lowers = '"Lowercase"' in self.tokenizer.to_str()[:20_000]
        special = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items() if x.special and not x.normalized}
        self.mark, self.mark_id = next(iter(special.items()), ("", -1))  # split off before anything else, so it can stand between chunks
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _lower(self, text: str) -> str:
        """The tokenizer lowers case itself; doing so here makes fewer chunks. Left alone where it could change special tokens or the end of a Greek word."""
        return text.lower() if self.lowers and "<|" not in text and "Σ" not in text else text

    def _each(self, some: list[str]) -> list[bytes]:
        if self.mark and not any(self.mark in x for x in some):
            ids = np.array(self.tokenizer.encode(self.mark.join(some), add_special_tokens=False).ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            return [ids[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1] + 1]).tolist(), ends.tolist(), strict=True)]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _plain(self, some: list[str]) -> list[bytes]:
        """_each() of words of letters alone: encoded in one text, each ends where an id ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
        at = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
        if len(at) != len(some) + 1 or at[-1] != 4 * len(ids):
            return self._each(some)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        chunked = [self._lower(x).replace("\n", " ").split(" ") for x in texts]
        known, used = self.known, set().union(*chunked)
        if len(known) > REMEMBERED:
            self.known = known = {x: known[x] for x in used if x in known} | {"": b""}
        new = used.difference(known)
        # Latin letters (İ becomes two characters) with one mark behind them: no token goes from the ones to the other, so the word is looked up alone
        words = {x: x[:-1] for x in new if x[-1] in MARKS and x[:-1].isalpha() and "İ" not in x and max(x) < "\u0250"}
        alone = list({words.get(x, x) for x in new}.union(MARKS).difference(known))
        plain = [x for x in alone if x.isalpha() and x.isascii()]
        for start in range(0, len(plain), 1000):
            some = plain[start : start + 1000]
            known.update(zip(some, self._plain(some), strict=True))
        alone = [x for x in alone if x not in known]
        for start in range(0, len(alone), 50):
            some = alone[start : start + 50]
            known.update(zip(some, self._each(some), strict=True))
        known.update((x, known[w] + known[x[-1]]) for x, w in words.items())
        get = known.__getitem__
        return [b"".join(map(get, x)) for x in chunked]


def ids_of(tokenizer_path: str) -> Ids:
    return worker_state(("packing", tokenizer_path), lambda: Ids(tokenizer_path))


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of documents, packed into sequences of at most capacity tokens.

    A document's ids are those of the tokenizer without special tokens, then end_id; a null or empty
    text has end_id alone. Each id lies in exactly one piece; offsets in a sequence are gapless from
    0. A null doc_id stays null; repeated rows are packed once each; an empty table gives no rows.
    Only doc_id and text are read, so other columns can't clash.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity is a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def block(rows: list[tuple], first: int) -> tuple[pa.RecordBatch, int]:
        out, made = [], cut_windows([len(ids) // 4 for _, ids in rows], capacity)
        for seq, pieces in enumerate(made, first):
            offset = 0
            for i, s, n in pieces:
                doc, ids = rows[i]
                out.append((doc, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), len(ids) // 4, seq, offset))
                offset += n
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names), first + len(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer_path)
        seq, rows, size = TaskContext.get().partitionId() * PER_TASK, [], 0
        for batch in slices(batches, "text"):
            for doc, x in zip(batch.column("doc_id").to_pylist(), ids.encode(batch.column("text").to_pylist()), strict=True):
                rows.append((doc, x + end))
                size += len(x) // 4 + 1
                if size >= block_tokens:
                    made, seq = block(rows, seq)
                    yield made
                    rows, size = [], 0
        if rows:
            yield block(rows, seq)[0]

    return id_and_text(docs).mapInArrow(run, SCHEMA)
