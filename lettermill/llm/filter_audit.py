"""Filter interaction audit by the multilinear extension.

Every document becomes a mask of the filters that it fails, and documents are counted by part and
mask (2**filters rows a part at most, whatever the input). The counts of a part form its removal polynomial:
sum of n(mask) * (1 - product of (1 - x_i) over the mask's filters). Its value in a corner of
the unit cube is what those filters remove together, from which the survivors of every order and step follow; the integral
of its i-th partial derivative along the diagonal, in exact rationals, is filter i's Shapley value.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: What stands between words.
BETWEEN = "[\\x20\\x09-\\x0D]+"
LEAST_WORDS = 50
#: Hundredths: distinct words among all, capitals among characters.
DISTINCT_WORDS, CAPITALS = 65, 5
SPECIAL = "[#$%&*|]"
#: Filters by their letters; the last is that of copies, the others look at a text alone.
FILTERS = "ABCDE"

Polynomial = dict[int, int]


def text_masks(rows: DataFrame) -> DataFrame:
    """rows with mask: the filters A to D that their text fails, A as the lowest bit."""
    words = F.filter(F.split("text", BETWEEN), lambda w: w != "")
    seen = rows.withColumns({"words": words, "capitals": F.length(F.regexp_replace("text", "[^A-Z]+", ""))})
    seen = seen.withColumns({"n_words": F.size("words"), "n_distinct": F.size(F.array_distinct("words"))})
    fails = [
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct").cast("long") < DISTINCT_WORDS * F.col("n_words").cast("long"),
        100 * F.col("capitals").cast("long") > CAPITALS * F.length("text").cast("long"),
        F.col("text").rlike(SPECIAL),
    ]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return seen.withColumn("mask", mask).drop("words", "capitals", "n_words", "n_distinct")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: documents by source and failed filters, those labelled good and toxic among them.

    Equal texts fail the same of the filters A to D, so copies are counted by text, part and label before the owner of a text (its
    least doc_id) is sought: no group of copies comes into one task row by row. Texts are told apart by SHA-256.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    light = text_masks(rows).select("doc_id", "part", "mask", F.unhex(F.sha2("text", 256)).alias("digest"))
    # nulls have no label, and so get keys of their own that no label has
    light = light.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.monotonically_increasing_id().cast("string"))))
    noted = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").cast("string").alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).filter("good OR toxic")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    labelled = light.join(noted, "key", "left").select("doc_id", "part", "mask", "digest", flag("good"), flag("toxic"))
    kind = ["digest", "part", "mask", "good", "toxic"]
    by_id = labelled.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))  # equal ids aren't smaller than each other
    named = F.col("doc_id").isNotNull()
    by_text = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(named, F.col("n")).otherwise(0)).alias("named"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("least"))
    owner = F.min("least.doc_id").over(Window.partitionBy("digest"))
    copies = F.col("named") - F.when(F.col("least.doc_id") == F.col("owner"), F.col("least.n")).otherwise(0)
    split = by_text.withColumn("owner", owner).withColumn("copies", copies)
    copied = 1 << FILTERS.index("E")
    each = F.explode(F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + copied).alias("mask"), F.col("copies").alias("n")))).alias("x")
    found = split.select("part", "good", "toxic", each).select("part", "good", "toxic", "x.*").filter("n > 0")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return found.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def removal_polynomial(counts: dict[int, int], filters: int) -> Polynomial:
    """Coefficients, by the set of variables, of the number removed: a mask's term 1 - product(1 - x_i), multiplied out."""
    out: Polynomial = {}
    for term in range(1, 1 << filters):
        n = sum(c for mask, c in counts.items() if mask & term == term)
        if n:
            out[term] = n if term.bit_count() % 2 else -n
    return out


def at_corner(polynomial: Polynomial, corner: int) -> int:
    """The polynomial where the variables of a set are 1 and the others 0."""
    return sum(c for term, c in polynomial.items() if term & corner == term)


def shapley(polynomial: Polynomial, variable: int) -> Fraction:
    """The integral of the partial derivative along the diagonal from 0 to 1: a term of k variables, one of which goes, is t**(k - 1)."""
    return sum((Fraction(c, term.bit_count()) for term, c in polynomial.items() if term >> variable & 1), Fraction(0))


Counts = dict[str, dict[int, int]]


def audited(counts: Counts, letters: str = FILTERS) -> list[tuple]:
    """All orders and steps of one part; counts has those of n, good and toxic by mask."""
    gone = {}
    for label, of in counts.items():
        polynomial = removal_polynomial(of, len(letters))
        gone[label] = [at_corner(polynomial, corner) for corner in range(1 << len(letters))]
        if label == "n":
            scaled = [shapley(polynomial, i) * factorial(len(letters)) for i in range(len(letters))]
    if any(x.denominator != 1 for x in scaled):
        raise ArithmeticError("a sum over all orders is a whole number")
    total, every, out = sum(counts["n"].values()), (1 << len(letters)) - 1, []
    for order in permutations(range(len(letters))):
        before, name = 0, "".join(letters[j] for j in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, good, toxic = (x[after] - x[before] for x in (gone["n"], gone["good"], gone["toxic"]))
            unique = gone["n"][every] - gone["n"][every & ~(1 << i)]
            out.append((name, step, total - gone["n"][after], removed, gone["n"][1 << i] - removed, unique, good, toxic, int(scaled[i])))
            before = after
    return out


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def by_part(counts: DataFrame) -> DataFrame:
    """Each part's audit from its counts (part, mask, n, good, toxic), of which a part has 32 rows at most."""
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                made = audited({c: {x["mask"]: x[c] for x in rows} for c in ("n", "good", "toxic")})
                columns = [[part] * len(made), *(list(c) for c in zip(*made, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts")).mapInArrow(run, SCHEMA)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (source; null: empty string), each of the 120 orders of the filters and each step.

    A document fails A with fewer than 50 words, B with less than 65 % distinct words, C with more than 5 % capitals, D
    with one of the signs #$%&*|, and E if a smaller doc_id has the same text anywhere. kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley (times 120, a whole number) are numbers of documents of the part. A null text is empty (and fails A alone, and E
    as a copy); a null doc_id is neither smaller nor larger than others and has no label; rows that repeat are counted
    each, and don't precede each other; of several labels of a document any that says so counts; an
    empty table gives no rows. Only doc_id, source and text, and of labels doc_id, quality and toxic are read.
    """
    return by_part(mask_counts(docs, labels))
