"""Names in texts by an Aho-Corasick automaton: all names of a dictionary in one pass over a text, however many there are."""

from __future__ import annotations

import functools
import pickle
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lettermill.functions import patterns as P

#: Bytes of names and ids that are sent to every executor at most.
MOST_BYTES = 32 << 20


def unit_names(names: dict[str, int]) -> list[tuple[str, int]]:
    """Folded names of units with their ids, short forms included, longest first (of equally long ones the first given); a later name replaces an earlier one."""
    found: dict[str, int] = {}
    for name, unit in names.items():
        base = "".join(c for c in unicodedata.normalize("NFKD", name.lower().replace("đ", "d")) if not unicodedata.combining(c))
        full = " ".join(base.split())
        for key in (full, re.sub(P.UNIT_PREFIX, "", full)):
            if key:
                found[key] = unit
    return sorted(found.items(), key=lambda x: -len(x[0]))


@functools.lru_cache(4)
def automaton(packed: bytes):
    """The automaton of packed (key, id) pairs in order of preference; kept by a Python worker from task to task."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for rank, (key, unit) in enumerate(pickle.loads(packed)):
        found.add_word(key, (rank, len(key), unit))
    found.make_automaton()
    return found


def _least(hits) -> int | None:
    return min(hits, default=(0, None))[1]


def in_line(names, line: str) -> int | None:
    """The id of the first key, in order of preference, that a line holds."""
    return _least((rank, unit) for _, (rank, _, unit) in names.iter(line))


def behind(names, text: str, phrases: tuple[str, ...]) -> int | None:
    """The id of the first key, in order of preference, that stands right behind one of the phrases."""
    return _least((rank, unit) for end, (rank, n, unit) in names.iter(text) if text.endswith(phrases, 0, end + 1 - n))


def delegation(spark: SparkSession, header: Column, names: dict[str, int]) -> Column:
    """The unit of folded header lines: of the first line with the phrase and a known name, else of a name right behind the phrase in the joined lines.

    The longest name wins, of equally long ones the first given. The names are sent to each executor once; more than MOST_BYTES are refused.
    """
    packed = pickle.dumps(unit_names(names))
    if len(packed) > MOST_BYTES:
        raise ValueError(f"names of {len(packed)} bytes are no dictionary: {MOST_BYTES} are sent at most")
    sent, phrase = spark.sparkContext.broadcast(packed), P.DELEGATION_KEYS[0].strip()

    def one(lines) -> int | None:
        if lines is None or not names:
            return None
        found = automaton(sent.value)
        for line in lines:
            if phrase in line and (unit := in_line(found, line)) is not None:
                return unit
        return behind(found, " ".join(" ".join(lines).split()), P.DELEGATION_KEYS)

    @F.pandas_udf("bigint")
    def looked_up(x: pd.Series) -> pd.Series:
        return pd.Series([one(lines) for lines in x], dtype="Int64")

    return looked_up(header)
