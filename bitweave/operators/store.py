"""Exact and bucketed Hamming search over stored states, and the store's upkeep.

Entries are rows with an id, a state (words) and whatever else they carry. Every search takes a
stated set of queries against all entries. ``now`` is always a parameter.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitweave.functions import words as w

#: Queries that are sent to all executors at once; more are searched block by block.
BLOCK = 20_000


def binarise(values: Column, words: int) -> Column:
    """Bit j is set where value j is positive."""
    return w.let(F.transform(values, lambda x: (x > 0).cast("int")), lambda b: w.pack(b, words))


def blocks(queries: DataFrame, ident: str) -> list[DataFrame]:
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    if blocks == 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64(ident), F.lit(blocks)) == b) for b in range(blocks)]


def knn(entries: DataFrame, queries: DataFrame, ident: str, state: str, k: int, words: int, extra: list[str] | None = None, others: bool = True) -> DataFrame:
    """The ``k`` nearest entries of every query: (q, ident, dist, rank, *extra).

    Exact; ties by the smaller id. ``others``: an entry is no neighbour of itself. The queries of a
    block are broadcast, their number is counted first; entries stay where they are and each task
    keeps k rows per query before anything is shuffled (the rank limit is pushed below the exchange).
    """
    order = Window.partitionBy("q").orderBy("dist", ident)
    found = []
    for block in blocks(queries, ident):
        q = F.broadcast(block.select(F.col(ident).alias("q"), F.col(state).alias("_q")))
        pairs = entries.join(q, F.col("q") != F.col(ident)) if others else entries.join(q)
        near = pairs.select("q", ident, w.hamming(F.col("_q"), F.col(state), words).alias("dist"), *(extra or []))
        found.append(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return reduce(DataFrame.unionByName, found)


def vote(neighbours: DataFrame, payload: str) -> DataFrame:
    """(q, predicted, votes): the payload most neighbours have; of equally frequent ones that of the nearest."""
    counted = neighbours.groupBy("q", payload).agg(F.count("*").alias("votes"), F.min("rank").alias("first"))
    best = counted.groupBy("q").agg(F.max(F.struct("votes", -F.col("first"), payload)).alias("b"))
    return best.select("q", F.col(f"b.{payload}").alias("predicted"), F.col("b.votes").alias("votes"))


def weighted_vote(neighbours: DataFrame, payload: str, dim: int) -> DataFrame:
    """As ``vote`` with weights 1 / (1 + dist / 2 dim)."""
    weight = 1 / (1 + F.col("dist") / (2 * dim))
    counted = neighbours.groupBy("q", payload).agg(F.round(F.sum(weight), 9).alias("weight"), F.min("rank").alias("first"))
    best = counted.groupBy("q").agg(F.max(F.struct("weight", -F.col("first"), payload)).alias("b"))
    return best.select("q", F.col(f"b.{payload}").alias("predicted"), F.round("b.weight", 6).alias("weight"))


def vacuum_by_age(entries: DataFrame, ts: str, now: Column, seconds: float) -> DataFrame:
    """Entries younger than ``seconds``."""
    return entries.where(F.unix_micros(now) - F.unix_micros(ts) < int(seconds * 1e6))


def vacuum_by_count(entries: DataFrame, ts: str, ident: str, n: int) -> DataFrame:
    """The n newest entries; of equal times the larger id counts as newer. Each task keeps n rows."""
    return entries.orderBy(F.desc(ts), F.desc(ident)).limit(n)


def sleep(entries: DataFrame, ts: str, value: str, now: Column, seconds: float, least: float, policy: str = "both") -> DataFrame:
    """Entries that survive maintenance. "both": young and valuable enough; "either": young or
    valuable enough; "drop_old_worthless": all but those that are old and worthless together."""
    young = F.unix_micros(now) - F.unix_micros(ts) < int(seconds * 1e6)
    worth = F.col(value) >= least
    return entries.where(young & worth if policy == "both" else young | worth)


# Bucketed search.


def lsh_bucket(state: Column, bits: int, words: int) -> Column:
    """Bit i is set where the state's dot product with direction i is positive."""
    def one(s: Column) -> Column:
        row = lambda i: w.item(F.lit(f"lsh{i}"), words)
        parts = [F.when(32 * words - 2 * w.ones(w.bind(s, row(i))) > 0, 1 << i).otherwise(0) for i in range(bits)]
        return reduce(lambda a, b: a + b, parts)

    return w.let(state, one).cast("int")


def lsh_candidates(entries: DataFrame, queries: DataFrame, ident: str, state: str, bits: int, words: int, flips: int = 1) -> DataFrame:
    """(q, ident, probe, dist): entries in the query's bucket (probe 0) or in one that differs in up to
    ``flips`` bits (the probes that follow, by number of bits and then from the lowest). The probes are
    exploded, so the search is an equi-join on the bucket; no bucket and no query is capped."""
    masks = [sum(1 << i for i in c) for n in range(flips + 1) for c in combinations(range(bits), n)]
    probes = F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("bucket").bitwiseXOR(m))
    asked = queries.select(F.col(ident).alias("q"), F.col(state).alias("_q"), lsh_bucket(F.col(state), bits, words).alias("bucket"))
    asked = asked.select("q", "_q", F.posexplode(probes).alias("probe", "bucket"))
    held = entries.withColumn("bucket", lsh_bucket(F.col(state), bits, words))
    return held.join(asked, "bucket").where(F.col("q") != F.col(ident)).withColumn("dist", w.hamming(F.col("_q"), F.col(state), words)).drop("_q", "bucket")
