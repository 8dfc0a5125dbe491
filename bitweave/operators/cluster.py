"""Routes, prototypes and leader clusters of states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitweave.functions import words as w
from bitweave.operators.bundle import bundle
from bitweave.operators.store import blocks
from bitweave.session import cut


def prototypes(entries: DataFrame, route: str, state: str, words: int) -> DataFrame:
    """(route, proto) by majority, ties to +1 (bit set, as states have bit 1 for positive values)."""
    return bundle(entries, [route], state, words, tie="minus", name="proto").drop("n")


def route(entries: DataFrame, routes: DataFrame, name: str, ident: str, state: str, words: int) -> DataFrame:
    """(ident, route, dist): the nearest prototype of every entry, ties by name; without any
    prototype ("_none_", -1). Routes are counted and sent to all executors block by block."""
    best = _nearest(entries, routes.select(F.col(name).alias("_name"), "proto"), "_name", ident, state, words)
    found = best.select(ident, F.col("b._name").cast("string").alias("route"), "b.dist")
    return entries.select(ident).join(found, ident, "left").na.fill({"route": "_none_", "dist": -1})


def _nearest(entries: DataFrame, prototypes: DataFrame, name: str, ident: str, state: str, words: int) -> DataFrame:
    """(ident, b): distance and name of the nearest of ``prototypes`` (name, proto), ties by name. Prototypes are
    broadcast in blocks of a counted size; each task keeps one row per entry and block."""
    parts = None
    for block in blocks(prototypes, name):
        near = entries.join(F.broadcast(block), how="cross")
        best = near.groupBy(ident).agg(F.min(F.struct(w.hamming(F.col(state), F.col("proto"), words).alias("dist"), name)).alias("b"))
        parts = best if parts is None else parts.unionByName(best)
    return parts.groupBy(ident).agg(F.min("b").alias("b"))


def leaders(entries: DataFrame, ident: str, state: str, radius: float, words: int) -> DataFrame:
    """(ident, leader): each entry joins the first earlier leader within ``radius``, else leads."""
    later, earlier = entries.select(F.col(ident).alias("j"), F.col(state).alias("y")), entries.select(F.col(ident).alias("i"), F.col(state).alias("x"))
    near = None
    for block in blocks(earlier, "i"):  # all against all, a block of the earlier ones at a time; near pairs only leave
        found = later.join(F.broadcast(block), F.col("i") < F.col("j")).where(w.hamming(F.col("x"), F.col("y"), words) <= radius).select("i", "j")
        near = found if near is None else near.unionByName(found)
    return first_leaders(entries.select(F.col(ident).alias("id")), near).select(F.col("id").alias(ident), "leader")


def first_leaders(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """(id, leader) of ``nodes`` (id) with near pairs (i, j), i before j: going through the nodes in
    order, each joins its first earlier neighbour that leads, else leads itself.

    What that pass decides one by one is the lexicographically first independent set of the graph.
    It is found in rounds: a node leads when all earlier neighbours are known not to, and follows as
    soon as an earlier neighbour leads. Rounds are cut by checkpoints.
    """
    near = cut(near)
    state_of = cut(nodes.select("id", F.lit(None).cast("boolean").alias("leads")))
    while True:
        seen = near.join(state_of.select(F.col("id").alias("i"), F.col("leads").alias("before")), "i")
        about = seen.groupBy(F.col("j").alias("id")).agg(F.bool_or(F.coalesce("before", F.lit(False))).alias("led"), F.bool_and(F.coalesce(~F.col("before"), F.lit(False))).alias("free"))
        judged = state_of.join(about, "id", "left").select("id", F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("led", F.lit(False)), False).when(F.coalesce("free", F.lit(True)), True).alias("leads"))
        state_of = cut(judged)
        if state_of.where("leads is null").isEmpty():
            break
    first = near.join(state_of.where("leads").select(F.col("id").alias("i")), "i", "left_semi").groupBy(F.col("j").alias("id")).agg(F.min("i").alias("first"))
    return state_of.join(first, "id", "left").select("id", F.when(F.col("leads"), F.col("id")).otherwise(F.col("first")).alias("leader"))


def refine(entries: DataFrame, members: DataFrame, ident: str, state: str, words: int) -> tuple[DataFrame, DataFrame]:
    """One pass: majority centroids, reassignment to the nearest (ties by the smaller leader), empty
    clusters dropped, final centroids. Returns (members, centroids)."""
    joined = entries.join(members, ident)
    centroids = bundle(joined, ["leader"], state, words, tie="minus", name="proto").drop("n")
    best = _nearest(entries, centroids, "leader", ident, state, words).select(ident, F.col("b.leader").alias("leader"))
    return best, bundle(entries.join(best, ident), ["leader"], state, words, tie="minus", name="proto").drop("n")


def two_stage(entries: DataFrame, members: DataFrame, centroids: DataFrame, queries: DataFrame, ident: str, state: str, k: int, probe: int, words: int) -> DataFrame:
    """(q, ident, dist, rank): k nearest among the members of the ``probe`` nearest clusters, and of the next
    nearest as long as those chosen have too few members for k others than the query itself."""
    asked = queries.select(F.col(ident).alias("q"), F.col(state).alias("_q"))
    sized = centroids.join(members.groupBy("leader").agg(F.count("*").alias("members")), "leader")
    order = Window.partitionBy("q").orderBy("pd", "leader")
    before = F.coalesce(F.sum("members").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    enough = lambda d: d.withColumn("pr", F.row_number().over(order)).withColumn("before", before).where((F.col("pr") <= probe) | (F.col("before") <= k))
    near = None
    for block in blocks(sized, "leader"):
        found = enough(asked.join(F.broadcast(block), how="cross").withColumn("pd", w.hamming(F.col("_q"), F.col("proto"), words)))
        near = found if near is None else near.unionByName(found)
    chosen = enough(near.drop("pr", "before")).select("q", "_q", "leader")
    held = entries.join(members, ident).join(chosen, "leader")
    dist = held.select("q", ident, w.hamming(F.col("_q"), F.col(state), words).alias("dist"))
    return dist.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("dist", ident))).where(F.col("rank") <= k)
