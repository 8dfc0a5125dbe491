"""The sets that overlap most with each set asked for (Jaccard), exactly and without comparing all that share a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitweave.session import stored

#: Pairs that a word makes (askers times holders) from which it is frequent; frequent words at most (further ones
#: are joined as rare words are); the most frequent of them, whose subsets are taken last.
PAIRS, FREQUENT, TOP = 20_000, 20_000, 24
#: Frequent words of a set up to which its subsets are listed, and words of a set in all; sets with more are joined word by word.
LISTED, LONG = 8, 10_000


def _subsets(words: Column) -> Column:
    """All subsets of an array of up to ``LISTED`` words, the empty one first."""
    return F.transform(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size(words)) - 1), lambda m: F.filter(words, lambda _, i: F.getbit(m, i) == 1))


def _score(c: Column, a: Column, b: Column) -> Column:
    return F.round(c / (a + b - c), 9)


def _first(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def _met(asked: DataFrame, held: DataFrame, by: str, k: int) -> DataFrame:
    """(q, id, score) of the best ``k`` that share one of the words in ``by``; each pair is met at the first word that it shares."""
    left = asked.select("q", F.col("rare").alias("rare_q"), F.col("often").alias("often_q"), F.explode(by).alias("w"))
    right = held.select("id", "rare", "often", F.explode(by).alias("w"))
    pairs = left.join(right, "w").where(F.get(F.array_intersect(f"{by}_q", by), F.lit(0)) == F.col("w"))
    both = F.size(F.array_intersect("rare_q", "rare")) + F.size(F.array_intersect("often_q", "often"))
    scored = pairs.select("q", "id", _score(both, F.size("rare_q") + F.size("often_q"), F.size("rare") + F.size("often")).alias("score"))
    return _first(scored, ["q"], [F.desc("score"), "id"], k).select("q", "id", "score")


def top_overlaps(held: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(q, id, rank): for each set asked for the ``k`` held sets with the largest Jaccard similarity, rounded to 9
    digits, ties by id; sets without a common word do not count.

    ``held``: (id, ws), ``asked``: (q, qs), keys and the words of a set distinct.

    Pairs that share a rare word are joined on it. For the rest the score depends only on the frequent words S that
    both have and on the size of the held set, so for every S that is part of a set asked for the k smallest sets
    (ties by id) that contain S are enough: whichever set is beaten by k others there is beaten by them everywhere,
    as they share S or more. A set found under a part of what it shares is found again, with its full score, under
    all of it or by its rare words; the larger score counts. The subsets of the less frequent words are taken first, of which
    few are parts of a set asked for, then those of the ``TOP`` words."""
    counts = held.select(F.explode("ws").alias("w"), F.lit(1).alias("f"), F.lit(0).alias("a")).unionByName(asked.select(F.explode("qs").alias("w"), F.lit(0).alias("f"), F.lit(1).alias("a")))
    cost = counts.groupBy("w").agg(F.sum("f").alias("f"), F.sum("a").alias("a")).where(F.col("f") * F.col("a") > PAIRS)
    # Numbers stand for frequent words, as they are shorter; a word whose number another one has counts as rare.
    numbers: dict[int, str] = {}
    for r in cost.orderBy(F.desc(F.col("f") * F.col("a")), "w").limit(FREQUENT).select("w", F.hash("w").alias("n")).collect():
        numbers.setdefault(r["n"], r["w"])
    frequent = list(numbers.values())
    top, rest = frequent[:TOP], frequent[TOP:]

    def split(df: DataFrame, c: str) -> DataFrame:
        of = lambda ws: F.array_sort(F.transform(F.filter(c, lambda x: x.isin(ws)), lambda x: F.hash(x))) if ws else F.array().cast("array<int>")
        rare = F.filter(c, lambda x: ~x.isin(frequent)) if frequent else F.col(c)
        parted = df.select(df.columns[0], rare.alias("rare"), of(top).alias("top"), of(rest).alias("mid"), F.size(c).alias("size"))
        return parted.withColumn("often", F.concat("top", "mid")).withColumn("long", (F.size("top") > LISTED) | (F.size("mid") > LISTED) | (F.col("size") > LONG))

    h, q = split(held, "ws"), split(asked, "qs")
    if not frequent:
        return _first(_met(q, h, "rare", k), ["q"], [F.desc("score"), "id"], k).select("q", "id", "rank")
    h, q = stored(h, "held"), stored(q, "asked")
    found = [_met(q, h, "rare", k)]
    if not q.where("long").isEmpty():
        found.append(_met(q.where("long"), h, "often", k))
    if not h.where("long").isEmpty():
        found.append(_met(q, h.where("long"), "often", k))

    kinds = q.where("not long and size(top) + size(mid) > 0").select("top", "mid", F.col("size").alias("a")).distinct()
    parts = kinds.select("top", "mid", "a", F.explode(_subsets(F.col("mid"))).alias("m"))
    wanted = stored(parts.select("m").distinct(), "parts")
    small = ["b", "id"]
    of_mid = h.where("not long and size(top) + size(mid) > 0").select("id", F.col("size").alias("b"), "top", F.explode(_subsets(F.col("mid"))).alias("m")).join(wanted, "m", "left_semi")
    of_mid = _first(of_mid, ["m", "top"], small, k)
    of_both = of_mid.select("m", "b", "id", F.explode(_subsets(F.col("top"))).alias("t")).where("size(m) + size(t) > 0")
    of_both = _first(of_both, ["m", "t"], small, k).select("m", "t", "b", "id")
    asks = parts.select("top", "mid", "a", "m", F.explode(_subsets(F.col("top"))).alias("t"))
    shared = asks.join(of_both, ["m", "t"]).groupBy("top", "mid", "a", "id", "b").agg(F.max(F.size("m") + F.size("t")).alias("c"))
    best = _first(shared.select("top", "mid", "a", "id", _score(F.col("c"), F.col("a"), F.col("b")).alias("score")), ["top", "mid", "a"], [F.desc("score"), "id"], k)
    found.append(q.where("not long").select("q", "top", "mid", F.col("size").alias("a")).join(best, ["top", "mid", "a"]).select("q", "id", "score"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return _first(out.groupBy("q", "id").agg(F.max("score").alias("score")), ["q"], [F.desc("score"), "id"], k).select("q", "id", "rank")
