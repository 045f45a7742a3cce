"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens that are not yet known are encoded together: one flat numpy array holds the symbols of
all of them, and each round merges, in every sequence at once, its pair of lowest rank (the leftmost
of equals). Sequences end where no piece goes over two characters in a row. Long ones, which would
take a round for each merge, go rank by rank instead: a round takes, in all of them at once, the
places of the lowest rank, up to the first in a sequence that makes a pair of a rank as low or lower
(which comes first then), and only looks at their neighbours. Sequences that stop so again and again (runs of one
character, whose doubled pieces have lower and lower ranks) are merged pair by pair over a heap. The symbols that survive are the
tokens; a symbol outside the vocabulary counts one token for each of its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import id_and_text, slices, utf8_length, worker_state

SPACE = "▁"
#: Pre-tokens that a Python worker remembers; beyond, it starts afresh.
REMEMBERED = 400_000
#: Symbols of one batch of pre-tokens.
BATCH_SYMBOLS = 400_000
NONE = np.iinfo(np.int64).max
#: Symbols from which on a sequence is a long one.
LONG = 48
#: Rounds between two looks for sequences that have stopped in half of them.
PATIENCE = 32
#: Characters of the longest pre-token that is remembered.
LONGEST = 200
#: Stands for a symbol that has merged into the one before.
GONE = -(1 << 40)


class MergeTable:
    """The pairs of a piece model that merge, their ranks and what they make."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models without text normalization, with a dummy prefix, are counted")
        pieces = [p for p in model.pieces if p.type == 1]
        self.ids = {p.piece: i for i, p in enumerate(pieces)}
        order = np.argsort(np.array([-p.score for p in pieces]), kind="stable")
        scores = np.array([p.score for p in pieces])[order]
        rank = np.empty(len(pieces), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(scores) != 0]))  # equal scores have equal ranks
        pairs = sorted((self.ids[p.piece[:i]] << 32 | self.ids[p.piece[i:]], k) for k, p in enumerate(pieces) for i in range(1, len(p.piece)) if p.piece[:i] in self.ids and p.piece[i:] in self.ids)
        self.keys, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.made, self.ranks = made, rank[made]
        self.pairs = {(k >> 32, k & 0xFFFFFFFF): (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), made.tolist(), strict=True)}
        self.in_pieces = {c for p in pieces if len(p.piece) > 1 for c in p.piece}
        self.neighbours = np.unique(np.array([ord(a) << 32 | ord(b) for p in pieces for a, b in zip(p.piece, p.piece[1:], strict=False)], np.int64))

    def one_by_one(self, sym: list[int]) -> list[int]:
        """The symbols that survive of one sequence, its pairs merged in their order (rank, then place) over a heap."""
        n, pair = len(sym), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, found[1]) for i in range(n - 1) if (found := pair((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i]
            if sym[i] == GONE or j == n or pair((sym[i], sym[j])) != (rank, made):
                continue
            sym[i], sym[j], k = made, GONE, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if found := pair((made, sym[k])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := pair((sym[h], made))):
                heapq.heappush(heap, (found[0], h, found[1]))
        return [x for x in sym if x != GONE]

    def found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and what it makes; NONE where it doesn't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.ranks[at], NONE), self.made[at]

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token (none of them empty)."""
        flat = "".join(tokens)
        get = self.ids.get
        sym = np.fromiter((get(c, -len(c.encode())) for c in flat), np.int64, len(flat))
        token = np.repeat(np.arange(len(tokens)), np.fromiter(map(len, tokens), np.int64, len(tokens)))
        points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        both = points[:-1] << 32 | points[1:]
        at = np.minimum(np.searchsorted(self.neighbours, both), len(self.neighbours) - 1)
        seq = np.concatenate([[0], np.cumsum((token[1:] != token[:-1]) | (self.neighbours[at] != both))])
        long = np.bincount(seq)[seq] >= LONG
        out = np.zeros(len(tokens), np.int64)
        for part, merge in ((~long, self._short), (long, self._long)):
            if part.any():
                left, of = merge(sym[part], seq[part], token[part])
                out += np.bincount(of, np.maximum(1, -left), len(tokens)).astype(np.int64)
        return out

    def _short(self, sym: np.ndarray, seq: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that survive, with their pre-tokens: each round merges one pair of each sequence."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            inside = seq[1:] == seq[:-1]
            rank, made = self.found(sym[:-1], sym[1:])
            rank, made = np.append(np.where(inside, rank, NONE), NONE), np.append(made, 0)
            starts = np.flatnonzero(np.concatenate([[True], ~inside]))
            least = np.minimum.reduceat(rank, starts)
            on = (least != NONE)[np.concatenate([[0], np.cumsum(~inside)])]
            least = np.repeat(least, np.diff(np.append(starts, len(seq))))
            done.append((sym[~on], token[~on]))  # the finished sequences leave
            sym, seq, token, rank, made, least = (x[on] for x in (sym, seq, token, rank, made, least))
            hits = np.flatnonzero(rank == least)
            first = hits[np.concatenate([[True], seq[hits][1:] != seq[hits][:-1]])[: len(hits)]]
            sym[first] = made[first]
            keep = np.ones(len(sym), bool)
            keep[first + 1] = False
            sym, seq, token = sym[keep], seq[keep], token[keep]
        return np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])

    def _long(self, sym: np.ndarray, seq: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _short(), rank by rank over linked symbols; behind the last one, and before the first, is a stop that merges with nothing."""
        n = len(sym)
        sym, seq = np.append(sym, -1), np.append(seq, -1)
        after, before = np.append(np.arange(1, n + 1), n), np.append(np.arange(-1, n - 1), n - 1)
        rank = np.full(n + 1, NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def put(value: int, places: np.ndarray) -> None:
            if value not in waiting:
                waiting[value] = []
                heapq.heappush(ranks, value)
            waiting[value].append(places)

        def wait(places: np.ndarray) -> None:
            """Ranks of the pairs that begin at the places, and a place among those of each rank."""
            then = after[places]
            r, _ = self.found(sym[places], sym[then])
            rank[places] = r = np.where(seq[places] == seq[then], r, NONE)
            some = r != NONE
            places, r = places[some], r[some]
            order = np.argsort(r, kind="stable")
            values, first = np.unique(r[order], return_index=True)
            for i, value in enumerate(values.tolist()):
                put(value, places[order[first[i] : first[i + 1] if i + 1 < len(first) else None]])

        wait(np.arange(n))
        stops, rounds = np.zeros(int(seq.max()) + 2, np.int64), 0
        while ranks:
            rounds += 1
            if not rounds % PATIENCE:
                slow = np.flatnonzero(stops >= PATIENCE // 2)
                stops[:] = 0
                if len(slow):
                    at = np.flatnonzero(np.isin(seq[:n], slow) & (sym[:n] != GONE))
                    rank[at] = NONE
                    for part in np.split(at, np.flatnonzero(np.diff(seq[at])) + 1):
                        left = self.one_by_one(sym[part].tolist())
                        sym[part[: len(left)]], sym[part[len(left) :]] = left, GONE
            now = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(now)))
            at = at[rank[at] == now]  # what has merged since has another rank
            if not len(at):
                continue
            touch = np.concatenate([[False], after[at[:-1]] == at[1:]])  # of overlapping pairs every other one
            place = np.arange(len(at))
            at_once = at[(place - np.maximum.accumulate(np.where(touch, 0, place))) % 2 == 0]
            _, made = self.found(sym[at_once], sym[after[at_once]])
            last = after[at_once]
            left, right = before[at_once], after[last]
            joined = np.concatenate([[False], last[:-1] == left[1:]])  # behind another that has merged by then
            left_sym = np.where(joined, np.concatenate([[0], made[:-1]]), sym[left])
            low = np.where((seq[left] == seq[at_once]), self.found(left_sym, made)[0], NONE)
            low = np.minimum(low, np.where(seq[right] == seq[at_once], self.found(made, sym[right])[0], NONE)) <= now
            late = np.zeros(len(at), bool)
            if low.any():  # in a sequence, all that comes behind the first such place waits
                stop = np.full(len(stops), n)
                np.minimum.at(stop, seq[at_once[low]], at_once[low])
                stops[seq[at_once[low]]] += 1
                late = at > stop[seq[at]]
                go = at_once <= stop[seq[at_once]]
                at_once, made, last = at_once[go], made[go], last[go]
            sym[at_once] = made
            rank[last] = NONE
            sym[last] = GONE
            further = after[last]
            after[at_once] = further
            before[further] = at_once
            if late.any():
                put(now, at[late])
            around = before[at_once]
            wait(np.unique(np.concatenate([at_once, around[around >= 0]])))
        left = np.flatnonzero(sym[:n] != GONE)
        return sym[left], token[left]


class Counter:
    """Counts tokens of whole texts; remembers pre-tokens."""

    def __init__(self, model_path: str):
        self.table = MergeTable(model_path)
        self.known: dict[str, int] = {}
        inner = self.table.in_pieces
        self.breaks = [c for c in "\n\t" if c not in inner]  # no piece goes over these

    def chunks(self, text: str) -> list[str]:
        """Pre-tokens that no piece crosses: spaces, shown as SPACE, with the word behind them."""
        marked = SPACE + text.replace(" ", SPACE)
        if SPACE * 2 in marked or len(self.breaks) < 2:
            return [x for part in self._parts(marked) for x in re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", part)]
        out = []
        for part in self._parts(marked):
            words = part.split(SPACE)
            if words[0]:
                out.append(words[0])
            out += [SPACE + x for x in words[1:]]
        return out

    def _parts(self, marked: str) -> list[str]:
        if "\n" in self.breaks and "\n" in marked:
            lines = marked.split("\n")
            return [x for line in lines[:-1] for x in ((line, "\n") if line else ("\n",))] + ([lines[-1]] if lines[-1] else [])
        return [marked]

    def count(self, texts: list[str]) -> list[int]:
        chunked = [self.chunks(x) if x else [] for x in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*chunked).difference(self.known))
        start = size = 0
        for i, x in enumerate(new):
            size += len(x)
            if size >= BATCH_SYMBOLS or i == len(new) - 1:
                some = new[start : i + 1]
                self.known.update(zip(some, self.table.counts(some).tolist(), strict=True))
                start, size = i + 1, 0
        get = self.known.__getitem__
        out = [sum(map(get, x)) for x in chunked]
        for x in new:
            if len(x) > LONGEST:
                del self.known[x]
        return out


def counter(model_path: str) -> Counter:
    return worker_state(("token_counts", model_path), lambda: Counter(model_path))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    Tokens are those that the library gives for the piece model, without begin, end or added special
    tokens. A null or empty text has 0 tokens; a null doc_id stays null; repeated rows give repeated
    rows; an empty table gives no rows. Only doc_id and text are read, so other columns can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for batch in slices(batches, "text"):
            n = pa.array(c.count(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    rows = id_and_text(docs).withColumn("n_bytes", utf8_length(F.col("text")))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
