"""Token ids in binary files of directly addressable codes.

An id is cut into chunks of one byte, the lowest first. Level k has the k-th chunks of all ids
that have one, in order, and a bitmap that says which of these ids go on in the next level. A directory
holds how many go on before each stretch of the bitmap; so the place of a token in the next level is a directory entry plus the bits of
one stretch, and any token is read without its neighbours.

A file is a row of segments, each with the ids of some whole documents: header, table of documents, levels. Documents are
dealt by ranges of doc_id, so that files and segments are in ascending order, and Spark's text writer commits the
files (a segment is a value, SEPARATOR stands behind each), so any file system that Spark knows will do and a task that fails leaves nothing.

    header     MAGIC, then 64-bit little-endian numbers: bytes of the segment, shard, ids of the shard before the segment, documents, ids, levels
    documents  doc_id (64 bits each), whether it is null (a byte each), place of its first id in the segment (64 bits each, and the end)
    level      number of chunks (64 bits), chunks, bitmap (bits from the lowest; in all but the last level), directory (32 bits for each stretch)
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm.common import id_and_text, shared_dir, slices, worker_state, written

MAGIC = b"LMTOKID1"
HEADER = struct.Struct("<8s6q")
SEPARATOR = "\n"
#: Bytes of a bitmap between two entries of its directory.
STRETCH = 64
#: Ids after which a segment ends (with the document), and segments in a file.
SEGMENT_IDS = 1 << 19
FILE_SEGMENTS = 8
#: Words that a Python worker remembers, beyond which those of the next batch stay, and characters of the longest of them.
REMEMBERED, LONGEST = 1_000_000, 64
#: Marks that are looked up apart from the letters before them.
MARKS = ".,!?;:"
#: New words that are encoded in one text.
TOGETHER = 2000


def bitmap_directory(bits: np.ndarray) -> np.ndarray:
    """How many bits are set before each stretch of a bitmap (bytes)."""
    ones = np.bitwise_count(np.pad(bits, (0, -len(bits) % STRETCH))).reshape(-1, STRETCH).sum(1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")


def encode_levels(ids: np.ndarray) -> list[bytes]:
    """The levels of ids (unsigned, up to 32 bits)."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        chunks, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
        more = rest > 0
        out.append(struct.pack("<q", len(chunks)) + chunks.tobytes())
        if not more.any():
            return out
        bits = np.packbits(more, bitorder="little")
        out[-1] += bits.tobytes() + bitmap_directory(bits).tobytes()
        rest = rest[more]


def encode_segment(shard: int, first: int, docs: list[tuple[int | None, bytes]]) -> bytes:
    """A segment of documents (doc_id, ids as little-endian 32-bit numbers)."""
    starts = np.cumsum([0, *(len(x) // 4 for _, x in docs)]).astype("<i8")
    levels = encode_levels(np.frombuffer(b"".join(x for _, x in docs), "<u4"))
    named = np.array([d or 0 for d, _ in docs], "<i8").tobytes() + bytes(d is None for d, _ in docs)
    body = named + starts.tobytes() + b"".join(levels)
    return HEADER.pack(MAGIC, HEADER.size + len(body), shard, first, len(docs), int(starts[-1]), len(levels)) + body


class Segment:
    """A segment as it lies in a buffer: nothing is decoded before it is asked for."""

    def __init__(self, buffer: memoryview, at: int = 0):
        magic, self.size, self.shard, self.first, n, self.n_ids, n_levels = HEADER.unpack_from(buffer, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        self.buffer, self.at = buffer, at + HEADER.size
        ids, none = self._take("<i8", n), self._take("u1", n)
        self.doc_ids = [None if x else d for d, x in zip(ids.tolist(), none.tolist(), strict=True)]
        self.starts = self._take("<i8", n + 1)
        self.levels = []
        for k in range(n_levels):
            n_chunks = int(self._take("<i8", 1)[0])
            chunks, last, n_bits = self._take("u1", n_chunks), k == n_levels - 1, -(-n_chunks // 8)
            self.levels.append((chunks, None, None) if last else (chunks, self._take("u1", n_bits), self._take("<u4", -(-n_bits // STRETCH))))
        if self.at != at + self.size:
            raise ValueError(f"the segment at byte {at} doesn't end where it says")

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.buffer, kind, n, self.at)
        self.at += out.nbytes
        return out

    def token(self, place: int) -> int:
        """One id by its place in the segment, through the directories alone."""
        if not 0 <= place < self.n_ids:
            raise IndexError(place)
        out = 0
        for k, (chunks, bits, directory) in enumerate(self.levels):
            out |= int(chunks[place]) << 8 * k
            byte, bit = divmod(place, 8)
            if bits is None or not bits[byte] >> bit & 1:
                break
            stretch = byte // STRETCH
            before = bits[stretch * STRETCH : byte]
            place = int(directory[stretch]) + int(np.bitwise_count(before).sum()) + (int(bits[byte]) & ((1 << bit) - 1)).bit_count()
        return out

    def tokens(self) -> np.ndarray:
        """All ids."""
        out = np.zeros(self.n_ids, "<u4")
        where = np.arange(self.n_ids)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[where] |= chunks.astype("<u4") << np.uint32(8 * k)
            if bits is not None:
                where = where[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)]
        return out


def segments(buffer: memoryview) -> Iterator[Segment]:
    """The segments of a file."""
    at = 0
    while at < len(buffer):
        found = Segment(buffer, at)
        yield found
        at += found.size + len(SEPARATOR.encode())


class WordIds:
    """Ids of whole texts as little-endian bytes; remembers words.

    A byte-level tokenizer splits a text before a space between two characters that are no white space,
    so words are looked up one by one, with the space (or line end) before them; of Latin letters with marks behind them
    the letters and the marks. New words are encoded in one text, in which the ids that begin with a space tell
    them apart. What holds other white space is encoded in longer parts.
    """

    def __init__(self, tokenizer_path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        said = json.loads(self.tokenizer.to_str())
        pre = said.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or said.get("normalizer") or said.get("post_processor"):
            raise ValueError("only byte-level tokenizers without normalization and prefix are supported")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in said["added_tokens"]):
            raise ValueError("special tokens that take in what is around them aren't supported")
        self.special = [x["content"] for x in said["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for x, i in vocabulary.items() if x.startswith("Ġ")]] = True  # a space, as byte-level tokenizers show it
        #: By word: its ids behind a space, or behind a line end where it begins with one; None where it can't be looked up.
        self.known: dict[str, bytes | None] = {}
        self.parts: dict[str, bytes] = {}
        self.between = re.compile(r"(?<=\S) (?=\S)")

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        known, core = self.known, {}
        for x in new:
            if x[-1:] in MARKS and (c := x.rstrip(MARKS)).isalpha() and c.isascii():
                core[x] = c
        plain = [x for x in new.difference(core).union(core.values()).difference(known) if x and x.isprintable()]
        for start in range(0, len(plain), TOGETHER):
            some = plain[start : start + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            raw, at = ids.tobytes(), (4 * np.flatnonzero(self.begins[ids])).tolist()
            at.append(len(raw))
            known.update(zip(some, [raw[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))
        marks = {m: self._alone(m) for m in {x[len(c) :] for x, c in core.items()}}
        for x, c in core.items():
            known[x] = known[c] + marks[x[len(c) :]]
        for x in new.difference(known):  # line ends before words, and what has white space in it
            known[x] = self._alone(x) if x[:1] == "\n" and x[1:] and x[1:].isprintable() else None

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [t.replace("\n", " \n").split(" ") for t in texts]
        firsts = [x.pop(0) for x in cut]
        used = set().union(*cut)
        if len(self.known) > REMEMBERED:
            self.known = {x: self.known[x] for x in used if x in self.known}
        new = used.difference(self.known)
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        self._learn(new)
        get, out = self.known.__getitem__, []
        for t, first, words in zip(texts, firsts, cut, strict=True):
            if any(x in t for x in self.special):
                out.append(self._alone(t))
                continue
            try:
                out.append(self._first(first) + b"".join(map(get, words)))
            except TypeError:  # some words can't be looked up
                out.append(b"".join(map(self._part, self._apart(t))))
        for x in new:
            if len(x) > LONGEST:
                del self.known[x]
        return out

    def _first(self, word: str) -> bytes | None:
        return self._part(word) if word and word.isprintable() else None

    def _apart(self, text: str) -> list[str]:
        first, *others = self.between.split(text)
        return [first, *(" " + x for x in others)] if text else []

    def _part(self, text: str) -> bytes:
        found = self.parts.get(text)
        if found is None:
            found = self._alone(text)
            if len(text) <= LONGEST:
                self.parts[text] = found
        return found


def word_ids(tokenizer_path: str) -> WordIds:
    return worker_state(("token_store", tokenizer_path), lambda: WordIds(tokenizer_path))


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> None:
    """Files of the ids of every whole text, in ascending doc_id order, in a new folder.

    A document's ids are those of the tokenizer without special tokens added (special strings in a text as the library takes
    them), then end_id; a null or empty text has end_id alone. A null doc_id comes first; rows of one doc_id come in the order
    of their texts' hashes; an empty table gives a folder without segments. Only doc_id and text are read.
    """
    rows = id_and_text(docs).withColumns({"h": F.xxhash64("text"), "nr": F.monotonically_increasing_id()})  # nr: rows that are the same can be dealt apart
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("doc_id", "h", "nr")
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, shard = word_ids(tokenizer_path), TaskContext.get().partitionId()
        done, size, open_docs = 0, 0, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([encode_segment(shard, done, open_docs)], pa.binary())], names=["segment"])

        for batch in slices(batches, "text"):
            for doc, x in zip(batch.column("doc_id").to_pylist(), ids.encode(batch.column("text").to_pylist()), strict=True):
                open_docs.append((doc, x + end))
                size += len(x) // 4 + 1
                if size >= segment_ids:
                    yield flush()
                    done, size, open_docs = done + size, 0, []
        if open_docs:
            yield flush()

    made = dealt.mapInArrow(run, "segment binary").select(F.col("segment").cast("string").alias("value"))  # the bytes stay as they are
    made.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


FIELDS = "doc_id long, shard long, at long, n_tokens long, ids_crc32 long"


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """A row for each document in the files of a folder: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32 (of its ids as little-endian 32-bit numbers); with ids, also these.

    Each file is read once; a task holds a file at a time, of FILE_SEGMENTS segments. Only the number of ids of each shard,
    of which there are as many as shuffle partitions, goes through the driver.
    """
    schema = FIELDS + (", ids array<long>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                for s in segments(memoryview(raw.as_buffer())):
                    tokens, starts = s.tokens(), s.starts
                    sizes = np.diff(starts)
                    flat = memoryview(tokens.tobytes())
                    crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                    columns = [pa.array(s.doc_ids, pa.int64()), pa.array(np.full(len(sizes), s.shard)), pa.array(starts[:-1] + s.first), pa.array(sizes), pa.array(crc, pa.int64())]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(tokens.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    rows = written(files.select("content").mapInArrow(run, schema))
    before, starts = 0, []
    for r in sorted(rows.groupBy("shard").agg(F.max(F.col("at") + F.col("n_tokens")).alias("n")).collect()):
        starts.append((r["shard"], before))
        before += r["n"]
    first = spark.createDataFrame(starts, "shard long, before long")
    out = rows.join(F.broadcast(first), "shard").withColumn("start", F.col("before") + F.col("at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Ids of documents written to files in the shared folder, and what read_tokens() reads there."""
    path = shared_dir(docs.sparkSession)
    write_tokens(docs, tokenizer_path, path, end_id)
    return read_tokens(docs.sparkSession, path)
