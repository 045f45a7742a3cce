"""Petitions and their best pairs by token-set Jaccard similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions import patterns as P
from lettermill.functions import text as X
from lettermill.sources.tables import written

#: Up to which of a petition's tokens, rarest first, each round of a match probes.
PROBES = (2,)


def keep_units(petitions: DataFrame, units: DataFrame) -> DataFrame:
    """Petitions whose donvi_id is among the units found in letters (donvi_id); all, if none was found."""
    found = units.select(F.expr("try_cast(donvi_id AS BIGINT)").alias("donvi_id")).filter("donvi_id IS NOT NULL").distinct()
    none = F.broadcast(found.agg((F.count(F.lit(1)) == 0).alias("none")))  # one row
    named = petitions.join(found.withColumn("named", F.lit(True)).withColumnRenamed("donvi_id", "unit"), F.expr("try_cast(donvi_id AS BIGINT) = unit"), "left")
    return named.join(none).filter("none OR named").select(*petitions.columns)


def _reach(shared: Column, n: Column, m: Column) -> Column:
    """The similarity of sets of n and m words that share so many."""
    return shared / F.greatest(n + m - shared, F.lit(1))


def _wanted(floor: float) -> Column:
    """What a pair must reach (a bit less, for rounding)."""
    return F.greatest("score", F.lit(floor)) - 1e-9


def met(open_: DataFrame, index: DataFrame, low: int, high: int, floor: float) -> DataFrame:
    """petition_id and pair_ord that share one of the words from place low to before high, if what is left from there on is enough for the best score so far.

    Words from which on too little is left for pairs of any size don't go into the join: frequent ones would meet all pairs there.
    """
    probes = open_.select("petition_id", "size", "score", F.size("words").alias("c"), F.posexplode(F.slice("words", low + 1, high - low)).alias("p", "token")).withColumn("p", F.col("p") + low)
    left = F.col("c") - F.col("p")
    probes = probes.filter(left / F.greatest(F.col("size"), F.lit(1)) >= _wanted(floor))
    shared = F.least(left, F.col("m"))
    return probes.join(index, "token").filter(_reach(shared, F.col("size"), F.col("m")) >= _wanted(floor)).select("petition_id", "pair_ord").distinct()


def _best(petitions: DataFrame, pairs: DataFrame, floor: float) -> DataFrame:
    """petition_id, pair_ord and score of each petition's best pair, the first of equals, if its score is above 0 and at least floor.

    A petition's tokens are probed in rounds, rarest first. Pairs that share none of the first k of its n tokens (of which c occur in
    pairs at all) reach (c - k) / n at most; so a petition is done as soon as its best score so far, or the floor, is
    above that. In a round a pair is met only if what is left from the shared token on, and the pair's size, allow the best score so far;
    it is verified by the whole sets. So frequent tokens are met only by petitions that nothing resembles: for these all
    shared tokens are counted, with the pairs whose size allows the best score so far.
    """
    tokens = lambda c: X.tokens(F.coalesce(c, F.lit(""))).alias("tokens")
    asked = petitions.select("petition_id", tokens("noi_dung")).groupBy("petition_id").agg(F.max("tokens").alias("tokens"))  # ids are unique; of repeated ones one counts
    asked = written(asked)
    given = written(pairs.select("pair_ord", tokens("noi_dung")).filter(F.size("tokens") > 0))
    index = given.select("pair_ord", F.size("tokens").alias("m"), F.explode("tokens").alias("token"))
    probed = asked.select(F.explode("tokens").alias("token")).distinct()
    seen = index.groupBy("token").agg(F.count(F.lit(1)).alias("n")).join(probed, "token")
    each = asked.select("petition_id", F.size("tokens").alias("size"), F.explode_outer("tokens").alias("token")).join(seen, "token", "left")
    words = F.transform(F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "token")))), lambda s: s["token"])
    open_ = written(each.groupBy("petition_id", "size").agg(words.alias("words")).withColumns({"score": F.lit(0.0), "o": F.lit(None).cast("long")}))
    done = []
    newer = lambda found: F.greatest(F.struct("score", "o"), found)
    for low, high in zip((0, *PROBES), PROBES, strict=False):
        scored = met(open_, index, low, high, floor).join(open_.select("petition_id", "size", "words"), "petition_id").join(given, "pair_ord")
        score = _reach(F.size(F.array_intersect("words", "tokens")), F.col("size"), F.size("tokens"))
        found = scored.groupBy("petition_id").agg(F.max(F.struct(score.alias("score"), (-F.col("pair_ord")).alias("o"))).alias("now"))
        open_ = written(open_.join(found, "petition_id", "left").withColumn("best", newer(F.col("now"))).select("petition_id", "size", "words", F.col("best.score").alias("score"), F.col("best.o").alias("o")))
        beyond = (F.size("words") - high) / F.greatest(F.col("size"), F.lit(1))
        ended = (F.size("words") <= high) | (beyond < _wanted(floor))
        done.append(open_.filter(ended).select("petition_id", "score", "o"))
        open_ = open_.filter(~ended)
    rest = open_.select("petition_id", "size", "score", F.explode("words").alias("token")).join(index, "token")
    fits = rest.filter(_reach(F.least("size", "m"), F.col("size"), F.col("m")) >= _wanted(floor))
    counted = fits.groupBy("petition_id", "pair_ord", "size", "m").agg(F.count(F.lit(1)).alias("both"))
    found = counted.groupBy("petition_id").agg(F.max(F.struct(_reach(F.col("both"), F.col("size"), F.col("m")).alias("score"), (-F.col("pair_ord")).alias("o"))).alias("now"))
    done.append(open_.join(found, "petition_id", "left").select("petition_id", newer(F.col("now")).alias("best")).select("petition_id", "best.*"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.filter((F.col("score") > 0) & (F.col("score") >= floor)).select("petition_id", (-F.col("o")).alias("pair_ord"), "score")


def best_matches(petitions: DataFrame, pairs: DataFrame, threshold: float = P.THRESHOLD) -> DataFrame:
    """petition_id, pair_ord and score of each petition's best pair, the first of equals; null below the threshold. See _best()."""
    if threshold <= 0:
        raise ValueError("the threshold is above 0")
    return petitions.select("petition_id").join(_best(petitions, pairs, threshold), "petition_id", "left").select("petition_id", "pair_ord", "score")


def best_of_all(petitions: DataFrame, pairs: DataFrame) -> DataFrame:
    """The best pair of each petition without a threshold (the first pair at 0 if nothing is shared). See _best()."""
    first = F.broadcast(pairs.agg(F.min("pair_ord").alias("first")))  # one row
    out = petitions.select("petition_id").join(_best(petitions, pairs, 0.0), "petition_id", "left").join(first)
    return out.select("petition_id", F.coalesce("pair_ord", "first").alias("pair_ord"), F.coalesce("score", F.lit(0.0)).alias("score"))


def summary(matches: DataFrame) -> DataFrame:
    hit = F.count_if(F.col("pair_ord").isNotNull())
    return matches.agg(hit.alias("matched_count"), (F.count(F.lit(1)) - hit).alias("unmatched_count"))


def answers(matches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nested output: each petition with no or one answer."""
    found = matches.join(pairs.select("pair_ord", F.struct(F.col("tra_loi").alias("content"), "file_id", "metadata").alias("answer")), "pair_ord", "left")
    return found.select(F.col("petition_id").alias("KN_KIENNGHI.ID"), F.array_compact(F.array("answer")).alias("answers"))
