"""N-best segmentation into pieces, and decoding.

A piece lattice has a node between any two characters and an edge for every vocabulary piece. The
Viterbi scores of a forward pass are the exact best scores from the start to each node, so they
serve as the heuristic of an A* search backward from the end: its hypotheses leave the queue in the
exact order of their total scores. No piece goes on from a word into the space behind it, so
the lattice of a text is a chain of small ones, each solved once and remembered: the N best of a
text are combinations of the N - 1 smallest losses against the best paths of its parts.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import id_and_text, slices, worker_state

SPACE = "▁"
#: Parts of texts that a Python worker remembers; beyond, it starts afresh.
REMEMBERED = 800_000
#: How far below the least score of a piece a character without a piece is.
UNKNOWN_LOSS = 10.0


class Lattice:
    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models without text normalization, with a dummy prefix, are used")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.pieces = [p.piece for p in model.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.signs = {i: (model.trainer_spec.unk_surface if p.type == 2 else "") for i, p in enumerate(model.pieces) if p.type in (2, 3)}
        #: What an id shows wherever it stands; None where that depends on its neighbours.
        self.shown = [None if i in self.signs or self.byte_of.get(i, 0) > 127 else chr(self.byte_of[i]) if i in self.byte_of else p for i, p in enumerate(self.pieces)]
        self.longest = max(map(len, self.ids))
        self.suffix: dict[str, float | None] = {p[i:]: None for p in self.ids for i in range(1, len(p))} | self.score
        self.packed = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.unknown = min(self.score.values()) - UNKNOWN_LOSS
        self.crossed = {c for p in self.ids if len(p) > 1 for c in p}

    def edges(self, text: str) -> list[list[tuple[int, float]]]:
        """For each node the starts and scores of the edges that end there."""
        get, longest, out = self.score.get, self.longest, [[]]
        for end in range(1, len(text) + 1):
            here = [(s, x) for s in range(max(0, end - longest), end) if (x := get(text[s:end])) is not None]
            if not here or here[-1][0] != end - 1:
                here.append((end - 1, self.unknown))
            out.append(here)
        return out

    @staticmethod
    def forward(edges: list[list[tuple[int, float]]]) -> tuple[list[float], list[int]]:
        """Best score from the start to each node, and where its last edge starts."""
        best, back = [0.0], [0]
        for here in edges[1:]:
            x, s = max((best[s] + x, -s) for s, x in here)
            best.append(x)
            back.append(-s)
        return best, back

    def nbest(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths: score and cuts, best first; equal scores by longer pieces at the end first."""
        edges = self.edges(text)
        best, _ = self.forward(edges)
        queue = [(-best[-1], 0, len(text), 0.0, None)]
        out, made = [], 0
        while queue and len(out) < n:
            _, _, node, behind, path = heapq.heappop(queue)
            if not node:
                cuts = []
                while path:
                    cuts.append(path[0])
                    path = path[1]
                out.append((behind, tuple(cuts)))
                continue
            for s, x in edges[node]:
                made -= 1  # the newest of equals first: the search goes deep, not wide
                heapq.heappush(queue, (-(best[s] + behind + x), made, s, behind + x, (s, path)))
        return out

    def best(self, texts: Iterable[str]) -> Iterator[tuple[str, float, list[int], float]]:
        """Each text (none of them empty) with score and cuts of its best path, and what the second best loses against it.

        Both best scores of a node depend on the text before it alone, so in sorted order the nodes of a common prefix are kept.
        """
        get, low = self.suffix.get, -float("inf")
        one, two, back, last = [0.0], [low], [0], ""
        for text in sorted(texts):
            same = 0
            for a, b in zip(last, text, strict=False):
                if a != b:
                    break
                same += 1
            del one[same + 1 :], two[same + 1 :], back[same + 1 :]
            for end in range(same + 1, len(text) + 1):
                start = end - 1
                x = get(text[start:end], low)
                more = x is not low  # else no piece ends like this
                if x is None or x is low:
                    x = self.unknown
                first, second, at = one[start] + x, two[start] + x, start
                while more and start:
                    start -= 1
                    x = get(text[start:end], low)
                    if x is low:
                        break
                    if x is not None:
                        y = one[start] + x
                        if y >= first:  # of equals the longer piece
                            z = two[start] + x
                            second, first, at = (first if first > z else z), y, start
                        elif y > second:
                            second = y
                one.append(first)
                two.append(second)
                back.append(at)
            last, cuts, node = text, [], len(text)
            while node:
                node = back[node]
                cuts.append(node)
            yield text, one[-1], cuts[::-1], one[-1] - two[-1]

    def encode(self, text: str, cuts: tuple[int, ...]) -> list[int]:
        out = []
        for s, e in zip(cuts, (*cuts[1:], len(text)), strict=True):
            i = self.ids.get(text[s:e])
            out += [i] if i is not None else [self.bytes[b] for b in text[s:e].encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids as the library gives it: bytes are joined (one replacement character for each that is no text), the first
        space is dropped, begin and end marks are nothing, the unknown piece is its sign."""
        try:
            text = "".join(map(self.shown.__getitem__, ids))
            return (text[1:] if text[:1] == SPACE else text).replace(SPACE, " ")
        except TypeError:  # some ids aren't characters by themselves
            pass
        out, raw, begun = [], b"", False

        def flush() -> None:
            nonlocal raw
            while raw:
                try:
                    out.append(raw.decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(raw[: e.start].decode() + "\ufffd")
                    raw = raw[e.start + 1 :]
            raw = b""

        for i in ids:
            if i in self.byte_of:
                raw += bytes([self.byte_of[i]])
                begun = True
                continue
            flush()
            if i in self.signs:
                out.append(self.signs[i])
                begun = begun or bool(self.signs[i])
            else:
                piece = self.pieces[i]
                out.append((piece if begun else piece.removeprefix(SPACE)).replace(SPACE, " "))
                begun = True
        flush()
        return "".join(out)


class Segmenter:
    """N-best segmentation of whole texts; remembers parts that no piece crosses."""

    def __init__(self, model_path: str):
        self.lattice = Lattice(model_path)
        self.known: dict[str, tuple[float, bytes, float]] = {}
        self.more: dict[str, list[tuple[float, list[int]]]] = {}
        self.line_breaks = "\n" not in self.lattice.crossed

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        lines = [x for line in marked.split("\n") for x in (line, "\n")][:-1] if self.line_breaks else [marked]
        if SPACE * 2 in marked:
            return [x for line in lines for x in re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", line)]
        return [x for line in lines for x in line.replace(SPACE, " " + SPACE).split(" ") if x]

    def learn(self, parts: set[str]) -> None:
        """The best path of new parts: score, ids and what the second best loses."""
        packed, raw = self.lattice.packed.get, self.lattice.bytes
        for part, x, cuts, loss in self.lattice.best(parts):
            ids = [packed(part[s:e]) or b"".join(raw[b].to_bytes(4, "little") for b in part[s:e].encode()) for s, e in zip(cuts, (*cuts[1:], len(part)), strict=True)]
            self.known[part] = x, b"".join(ids), loss

    def segment_all(self, texts: list[str], n: int) -> list[list[tuple[float, bytes]]]:
        """segment() of each text; the new parts of all are solved together."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.more) > REMEMBERED // 8:
            self.more.clear()
        cut = [self.parts(t) for t in texts]
        self.learn(set().union(*cut).difference(self.known))
        return [self._joined(parts, n) for parts in cut]

    def segment(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text: score and ids (little-endian, four bytes each)."""
        return self.segment_all([text], n)[0]

    def _joined(self, parts: list[str], n: int) -> list[tuple[float, bytes]]:
        known = self.known
        solved = list(map(known.__getitem__, parts))
        top = sum(x[0] for x in solved)
        ids = [x[1] for x in solved]
        out = [(top, b"".join(ids))]
        if n == 1 or not parts:
            return out
        losses = [x[2] for x in solved]
        near = heapq.nsmallest(n - 1, range(len(parts)), key=losses.__getitem__)  # no other part takes part in the n best
        options = []
        for i in sorted(near):
            if losses[i] < float("inf"):
                key = f"{n} {parts[i]}"
                if key not in self.more:
                    self.more[key] = [(solved[i][0] - x, np.array(self.lattice.encode(parts[i], c), "<u4").tobytes()) for x, c in self.lattice.nbest(parts[i], n)]
                options.append((i, self.more[key]))
        queue, seen = [(0.0, (0,) * len(options))], {(0,) * len(options)}
        while queue and len(out) <= n:  # the first of them is the best path itself
            loss, state = heapq.heappop(queue)
            if any(state):
                new = list(ids)
                for (i, ways), k in zip(options, state, strict=True):
                    new[i] = ways[k][1]
                out.append((top - loss, b"".join(new)))
                if len(out) == n:
                    break
            for j, (_, ways) in enumerate(options):
                if state[j] + 1 < len(ways):
                    step = (*state[:j], state[j] + 1, *state[j + 1 :])
                    if step not in seen:
                        seen.add(step)
                        heapq.heappush(queue, (loss - ways[state[j]][0] + ways[state[j] + 1][0], step))
        return out


def segmenter(model_path: str) -> Segmenter:
    return worker_state(("nbest_pieces", model_path), lambda: Segmenter(model_path))


SCHEMA = "doc_id long, n_best array<struct<score:double,ids:array<int>>>"
DIGEST = "doc_id long, n_paths int, n_pieces long, score double, ids_crc32 long, n_best string, decoded_equal boolean"


def _over(docs: DataFrame, schema: str, model_path: str, n: int, row) -> DataFrame:
    """row of each text and its n best segmentations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = re.findall(r"(?:^|, )(\w+)", re.sub("<.*>", "", schema))
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            rows = [row(t, found) for t, found in zip(texts, segmenter(model_path).segment_all(texts, n), strict=True)]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, TYPES[schema], strict=True))], names=names)

    return id_and_text(docs).mapInArrow(run, schema)


TYPES = {
    SCHEMA: [pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))],
    DIGEST: [pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.bool_()],
}


def encode_nbest(docs: DataFrame, model_path: str, n: int = 4) -> DataFrame:
    """doc_id and the n best segmentations of every whole text, best first, with scores and ids.

    Scores are sums of the scores that the model stores for its pieces. A null or empty text has the
    empty segmentation with score 0 alone; a text with fewer segmentations has fewer; repeated rows
    give repeated rows; an empty table gives no rows. Only doc_id and text are read.
    """
    return _over(docs, SCHEMA, model_path, n, lambda _, found: ([{"score": x, "ids": np.frombuffer(ids, "<u4").tolist()} for x, ids in found],))


def encode_digest(docs: DataFrame, model_path: str, n: int = 4) -> DataFrame:
    """encode_nbest() in short: for the best path its pieces, score and CRC-32 of its ids; for all n
    "score:CRC-32" joined by commas; and whether decoding the best gives the text back (true of every
    text in which the space symbol itself doesn't occur)."""

    def row(text: str, found: list[tuple[float, bytes]]) -> tuple:
        score, ids = found[0]
        same = segmenter(model_path).lattice.decode(np.frombuffer(ids, "<u4").tolist()) == text
        return len(found), len(ids) // 4, score, zlib.crc32(ids), ",".join(f"{x:.1f}:{zlib.crc32(y)}" for x, y in found), same

    return _over(docs, DIGEST, model_path, n, row)


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (array<int>).

    Null ids, a null among them or an id that the model doesn't have give a null text, no ids the empty
    text; repeated rows give repeated rows, and an empty table none. Only doc_id and ids are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = segmenter(model_path).lattice
        known = range(len(lattice.pieces))
        for batch in batches:
            text = [lattice.decode(x) if x is not None and all(i in known for i in x) else None for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
