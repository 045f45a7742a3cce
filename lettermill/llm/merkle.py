"""A Merkle manifest of a dataset: a tree for each part, and one over their roots.

Every leaf knows its place and the size of its tree, so the number of a parent's children follows. Trees are assembled
by events, as combineByKey does it: a child's digest with its place starts a partial parent or goes into one (creating
and merging values), and as soon as a parent has all its children it is closed and is a child itself, one level up. A task
that has seen its range of leaves is left with the few parents whose other children lie elsewhere. This frontier is
shuffled by an ancestor some levels up, where partial parents merge (merging combiners) and more of them close; each round takes
that ancestor further up, so that the number of rounds grows with the logarithm of the largest tree and a task holds one subtree of bounded size.

The closed parents are the manifest. Links back from parent to children make the proofs, from the root down: a node's trail is its
siblings, then its parent's trail.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lettermill.llm.common import written

#: Children of a parent, but for the last one of a level.
ARITY = 8
#: Levels that a round climbs: a task holds a subtree of ARITY**STEP nodes at a time.
STEP = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Partial parents after which a task hands them on.
MOST_OPEN = 200_000
#: Rows of a batch that leaves a task.
BATCH = 4096


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of fields, each `-` if null, else its length in bytes, a colon and its text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]), 256)


def nodes_of(size: int, level: int) -> int:
    """Nodes of a level (0: leaves) of a tree of size leaves."""
    return -(-size // ARITY**level)


def height(size: int) -> int:
    """The level of the root."""
    level = 0
    while nodes_of(size, level) > 1:
        level += 1
    return level


@dataclass
class Assembly:
    """Partial parents; runs are the children of closed ones, roots those without a parent."""

    open: dict[tuple[str, int, int], tuple[int, dict[int, str]]] = field(default_factory=dict)
    runs: list[tuple[str, int, int, list[str]]] = field(default_factory=list)
    roots: list[tuple[str, int, str]] = field(default_factory=list)

    def add(self, part: str, size: int, level: int, index: int, child: str) -> None:
        """A child of a level comes in; parents that it completes are closed, and go on as children."""
        while (count := nodes_of(size, level)) > 1:
            parent, place = divmod(index, ARITY)
            key = (part, level, parent)
            known = self.open.setdefault(key, (size, {}))[1]
            known[place] = child
            arity = min(ARITY, count - ARITY * parent)
            if len(known) < arity:
                return
            del self.open[key]
            children = [known[i] for i in range(arity)]
            self.runs.append((part, level, parent, children))
            level, index, child = level + 1, parent, digest("".join(children))
        self.roots.append((part, size, child))

    def merge(self, part: str, size: int, level: int, parent: int, places: list[int], children: list[str]) -> None:
        """A partial parent from elsewhere."""
        for place, child in zip(places, children, strict=True):
            self.add(part, size, level, ARITY * parent + place, child)

    def rows(self, with_open: bool) -> Iterator[tuple]:
        """(kind, part, size, level, index, places, digests) of what is closed, and of what is open."""
        yield from (("run", part, None, level, parent, None, children) for part, level, parent, children in self.runs)
        yield from (("root", part, size, height(size), 0, None, [root]) for part, size, root in self.roots)
        self.runs, self.roots = [], []
        if with_open:
            yield from (("open", part, size, level, parent, list(known), list(known.values())) for (part, level, parent), (size, known) in self.open.items())
            self.open = {}


NODES = "kind string, part string, size long, level int, index long, places array<int>, digests array<string>"


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    for start in range(0, len(rows), BATCH):
        columns = zip(*rows[start : start + BATCH], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _assembled(rows: DataFrame) -> DataFrame:
    """NODES rows of children (part, size, level, index, places, digests; without places the row is one child), closed as far as a task sees them."""
    schema = to_arrow_schema(StructType.fromDDL(NODES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Assembly()
        for batch in batches:
            for part, size, level, index, places, digests in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if places is None:
                    made.add(part, size, level, index, digests[0])
                else:
                    made.merge(part, size, level, index, places, digests)
            yield from _batches(made.rows(len(made.open) > MOST_OPEN), schema)
        yield from _batches(made.rows(True), schema)

    return rows.select("part", "size", "level", "index", "places", "digests").mapInArrow(run, NODES)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ancestor(level: Column, index: Column, top: int) -> Column:
    """The number, on level top, of the ancestor of a node (or of the node, if it is higher up)."""
    return F.floor(index / F.pow(F.lit(float(ARITY)), F.greatest(F.lit(top) - level, F.lit(0)))).cast("long")


def indexed(leaves: DataFrame, *order: str) -> DataFrame:
    """leaves (part, digest and more) with index (from 0) by the order's columns in their part, and size of the part.

    Rows are dealt by ranges of part and order, so that a large part is many ranges; what lies before a range in
    its part is the sum of the rows of the ranges before.
    """
    keys = ("part", *order, "nr")
    dealt = leaves.withColumn("nr", F.monotonically_increasing_id()).repartitionByRange(_partitions(leaves), *keys).sortWithinPartitions(*keys).drop("nr")
    ordered = written(dealt.withColumn("at", F.monotonically_increasing_id())).withColumn("range", F.shiftright("at", 33))
    ranges = ordered.groupBy("part", "range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    one = Window.partitionBy("part")
    before = F.coalesce(F.sum("n").over(one.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = written(ranges.select("part", "range", (before - F.col("first")).alias("shift"), F.sum("n").over(one).alias("size")))
    return ordered.join(placed, ["part", "range"]).withColumn("index", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def assemble(leaves: DataFrame) -> DataFrame:
    """The manifest of leaves (part, size, index, digest): rows of kind run (level and parent's index, digests of its children in order) and root (of a part)."""
    tallest = height(leaves.agg(F.max("size")).first()[0] or 1)
    none = F.lit(None).cast("array<int>")
    made = written(_assembled(leaves.select("part", "size", F.lit(0).alias("level"), "index", none.alias("places"), F.array("digest").alias("digests"))))
    closed = made.filter("kind <> 'open'")
    for top in range(STEP, tallest + STEP, STEP):
        above = _ancestor(F.col("level") + 1, F.col("index"), top)
        frontier = made.filter("kind = 'open'").repartition(_partitions(leaves), "part", F.greatest(F.col("level") + 1, F.lit(top)), above)
        made = written(_assembled(frontier))
        closed = closed.unionByName(made.filter("kind <> 'open'"))
    return closed


TRAILS = "part string, level int, index long, trail array<string>, subroot string, root string"


class Subtree:
    """Trails of the nodes below one ancestor, made when they are asked for.

    A trail has a string for each level up to the root: the node's place among its parent's children (one digit), and its siblings' digests.
    """

    def __init__(self):
        self.runs: dict[tuple[int, int], list[str]] = {}
        self.trails: dict[tuple[int, int], list[str]] = {}
        self.subroot = self.root = ""

    def trail(self, level: int, index: int) -> list[str]:
        found = self.trails.get((level, index))
        if found is None:
            parent, place = divmod(index, ARITY)
            children = self.runs[level, parent]
            found = self.trails[level, index] = [f"{place}{''.join(children[:place])}{''.join(children[place + 1 :])}", *self.trail(level + 1, parent)]
        return found


def folded(child: str, trail: list[str]) -> str:
    """The root that follows from a node's digest and its trail."""
    for step in trail:
        at = 1 + 64 * int(step[0])
        child = digest(step[1:at] + child + step[at:])
    return child


def _subtrees(rows: DataFrame, top: int, out: str, make) -> DataFrame:
    """make(subtree, leaves) for each ancestor on level top: rows are its nodes' known trails, the runs below it and leaves (level null)."""
    schema = to_arrow_schema(StructType.fromDDL(out))
    near = rows.withColumn("above", _ancestor(F.coalesce("level", F.lit(0)) + F.when(F.col("digests").isNotNull(), 1).otherwise(0), F.col("index"), top))
    met = near.repartition(_partitions(rows), "part", "above").sortWithinPartitions("part", "above")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, leaves, done = None, Subtree(), [], []
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["part"], row["above"])
                if key != now:
                    done += make(now[0], tree, leaves) if now else []
                    now, tree, leaves = key, Subtree(), []
                    if len(done) > BATCH:
                        yield from _batches(done, schema)
                        done = []
                if row["trail"] is not None:
                    tree.trails[row["level"], row["index"]] = row["trail"]
                    tree.subroot, tree.root = row["subroot"], row["root"]
                elif row["digests"] is not None:
                    tree.runs[row["level"], row["index"]] = row["digests"]
                else:
                    leaves.append(row)
        done += make(now[0], tree, leaves) if now else []
        yield from _batches(done, schema)

    return met.mapInArrow(run, out)


def _lower_trails(part: str, tree: Subtree, low: int) -> list[tuple]:
    """Trails of the nodes on a level of a subtree."""
    return [(part, low, ARITY * parent + i, tree.trail(low, ARITY * parent + i), tree.subroot, tree.root) for level, parent in list(tree.runs) if level == low for i in range(len(tree.runs[level, parent]))]


def _rows(trails: DataFrame, runs: DataFrame) -> DataFrame:
    return trails.unionByName(runs.select("part", "level", "index", "digests"), allowMissingColumns=True)


def trails_above(manifest: DataFrame, roots: DataFrame) -> DataFrame:
    """TRAILS rows of nodes up to level STEP, of which one is above (or at) each leaf, from those of the parts' roots."""
    tallest, trails = roots.agg(F.max("level")).first()[0] or 0, None
    runs = manifest.filter("kind = 'run'")
    for top in range(-(-tallest // STEP) * STEP, STEP, -STEP):
        begun = roots.filter((F.col("level") > top - STEP) & (F.col("level") <= top))
        begun = begun if trails is None else begun.unionByName(trails)
        low = top - STEP
        below = runs.filter((F.col("level") >= low) & (F.col("level") < top))
        trails = written(_subtrees(_rows(begun, below), top, TRAILS, lambda part, tree, _, low=low: _lower_trails(part, tree, low)))
    short = roots.filter(F.col("level") <= STEP)
    return short if trails is None else short.unionByName(trails)


PROOFS = "part string, index long, doc_id long, digest string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(leaves: DataFrame, manifest: DataFrame, trails: DataFrame, with_trails: bool = False) -> DataFrame:
    """PROOFS rows of leaves (part, index, doc_id, digest, claimed): claimed is folded with the siblings of the manifest, and verified says
    whether that gives the root. proof_sha256 is that of all siblings, level by level to the root; with_trails adds them."""
    out = PROOFS + (", trail array<string>" if with_trails else "")

    def make(part: str, tree: Subtree, rows: list[dict]) -> list[tuple]:
        done, upper = [], {}
        for r in rows:
            trail, parent = tree.trail(0, r["index"]), r["index"] // ARITY
            if parent not in upper:
                upper[parent] = "".join(x[1:] for x in trail[1:])
            found = folded(r["claimed"], trail)
            siblings = trail[0][1:] + upper[parent] if trail else ""
            done.append((part, r["index"], r["doc_id"], r["digest"], tree.subroot, tree.root, digest(siblings), found, found == tree.root) + ((trail,) if with_trails else ()))
        return done

    low = manifest.filter(f"kind = 'run' AND level < {STEP}")
    rows = _rows(trails, low).unionByName(leaves.select("part", "index", "doc_id", "digest", "claimed"), allowMissingColumns=True)
    return _subtrees(rows, STEP, out, make)


def manifest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifest of leaves (part, size, index, digest), and the roots of its parts with their trails (in the tree over these roots)."""
    closed = assemble(leaves)
    roots = closed.filter("kind = 'root'").select("part", "level", F.get("digests", 0).alias("subroot"))
    one = written(indexed(roots.select(F.lit("").alias("part"), F.col("part").alias("name"), F.col("subroot").alias("digest")), "name"))
    over = assemble(one)
    root = over.filter("kind = 'root'").select("part", "level", F.lit(0).cast("long").alias("index"), F.array().cast("array<string>").alias("trail"), F.lit("").alias("subroot"), F.get("digests", 0).alias("root"))
    named = one.select("part", "index", F.lit(None).cast("long").alias("doc_id"), "digest", F.col("digest").alias("claimed"))
    proved = prove(named, over, trails_above(over, root), with_trails=True).join(one.select("index", "name"), "index")
    top = proved.select(F.col("name").alias("part"), "trail", "root")
    return closed, roots.join(top, "part").select("part", "level", F.lit(0).cast("long").alias("index"), "trail", "subroot", "root")


def leaves_of(docs: DataFrame, fields: tuple[str, ...] = FIELDS, part: str = "lang", tampered: Column | None = None) -> DataFrame:
    """part, doc_id, digest and claimed of documents; the text of those that tampered says is claimed with its capitals A to Z in lower case."""
    kinds = dict.fromkeys(fields, "string") | {k: "long" for k in ("doc_id", "n_chars") if k in fields}
    rows = docs.select(*[F.col(c).cast(kinds[c]).alias(c) for c in fields], F.coalesce(F.concat(F.lit("+"), F.col(part).cast("string")), F.lit("")).alias("part"))
    own = leaf_digest(*[F.col(c) for c in fields])
    changed = leaf_digest(*[F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in fields])
    return rows.select("part", "doc_id", own.alias("digest"), (F.when(tampered, changed) if tampered is not None else F.lit(None).cast("string")).alias("claimed"))


def sealed(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """PROOFS rows: each document's leaf in the tree of its lang, the tree's root, the root over all and its proof.

    Leaves of a lang (null first, then by bytes) ascend by doc_id (null first, equal ones by digest); rows that repeat are leaves each. Every
    ARITY nodes in a row become one until one is left. A null field is `-`. tampered marks rows that are claimed with another text
    (none, where it is null); their folded_root differs from root if that changes their leaf. An empty table gives no rows. Only FIELDS are read.
    """
    ready = written(leaves_of(docs, tampered=tampered))
    leaves = written(indexed(ready, "doc_id", "digest").withColumn("claimed", F.coalesce("claimed", "digest")))
    closed, roots = manifest(leaves)
    return prove(leaves, closed, trails_above(closed, written(roots)))
