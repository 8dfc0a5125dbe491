"""Rank fusion of several spaces, and compilation of what was retrieved into a context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitweave.functions import text as tx
from bitweave.session import cut


def fuse(ranked: DataFrame, doc: str, k: int, dim: int, weight: str = "weight", k0: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion of (q, encoder, doc, rank, weight): (q, doc, score, dist, rank).
    The distance is (1 - score / best possible) * dim; ties by doc."""
    total = ranked.select("encoder", weight).distinct().agg(F.sum(weight).alias("total"))
    scored = ranked.groupBy("q", doc).agg(F.sum(F.col(weight) / (k0 + F.col("rank"))).alias("score")).withColumn("score", F.round("score", 12))
    order = Window.partitionBy("q").orderBy(F.desc("score"), doc)
    cutoff = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return cutoff.join(F.broadcast(total)).select("q", doc, "score", ((1 - F.col("score") / (F.col("total") / (k0 + 1))) * dim).alias("dist"), "rank")


def reward(ranked: DataFrame, answers: DataFrame, doc: str, weight: str = "weight", rate: float = 0.15, floor: float = 0.1) -> DataFrame:
    """(encoder, weight) after feedback (q, doc, correct), credited by 1 / rank and scaled to mean 1.
    Feedback given together is summed before the floor applies."""
    hits = ranked.join(answers, ["q", doc])
    credit = hits.groupBy("encoder").agg(F.sum(F.when(F.col("correct"), 1.0).otherwise(-1.0) / F.col("rank")).alias("credit"))
    weights = ranked.select("encoder", weight).distinct().join(credit, "encoder", "left")
    moved = weights.select("encoder", F.greatest(F.lit(floor), F.col(weight) + rate * F.coalesce("credit", F.lit(0.0))).alias("w"))
    mean = moved.agg(F.avg("w").alias("mean"))
    return moved.join(F.broadcast(mean)).select("encoder", (F.col("w") / F.col("mean")).alias(weight))


def rerank(chunks: DataFrame, text: str, query: str, dist: str, pull: float = 40.0) -> DataFrame:
    """Adds ``score``: the distance less ``pull`` times the word overlap with the query."""
    return chunks.withColumn("score", F.round(F.col(dist) - pull * tx.word_overlap(F.col(text), F.col(query)), 9))


def clusters(chunks: DataFrame, ident: str, text: str, least: float = 0.35, rounds: int = 50) -> DataFrame:
    """(q, ident, cluster): connected components, within a query, of chunks whose word sets overlap
    by ``least`` or more; the component's smallest id names it. A query's chunks are few (what one
    retrieval returns), so its pairs are compared; minimum labels spread until none changes."""
    words = chunks.select("q", F.col(ident).alias("i"), F.array_distinct(tx.low_words(F.col(text))).alias("ws"))
    other = words.select("q", F.col("i").alias("j"), F.col("ws").alias("vs"))
    links = cut(words.join(other, "q").where((F.col("i") != F.col("j")) & (tx.jaccard(F.col("ws"), F.col("vs")) >= least)).select("q", "i", "j"))
    label = cut(words.select("q", "i", F.col("i").alias("c")))
    for _ in range(rounds):
        heard = links.join(label.select("q", F.col("i").alias("j"), F.col("c").alias("d")), ["q", "j"]).groupBy("q", "i").agg(F.min("d").alias("d"))
        new = cut(label.join(heard, ["q", "i"], "left").select("q", "i", F.least("c", F.coalesce("d", "c")).alias("c"), F.col("c").alias("old")))
        label = new.select("q", "i", "c")
        if new.where("c <> old").isEmpty():
            break
    return label.select("q", F.col("i").alias(ident), F.col("c").alias("cluster"))


def merge(chunks: DataFrame, ident: str, text: str) -> DataFrame:
    """Of every (q, cluster) the chunk of lowest score, then the shortest, then the smallest id."""
    order = Window.partitionBy("q", "cluster").orderBy("score", F.length(text), ident)
    return chunks.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def prune(chunks: DataFrame, ident: str, tokens: str, most_chunks: int = 5, most_tokens: int = 768) -> DataFrame:
    """The chunks of a query, by score, before the first that would exceed either budget."""
    order = Window.partitionBy("q").orderBy("score", ident)
    n, used = F.row_number().over(order), F.sum(tokens).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = chunks.withColumn("place", n).withColumn("used", used)
    over = (F.col("place") > most_chunks) | (F.col("used") > most_tokens)
    broken = F.max(over.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_b", broken).where("_b = 0").drop("_b")
