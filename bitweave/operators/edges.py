"""Learned edges: confidence from counts, and maintenance (decay, merge, forget)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitweave.functions import text as tx
from bitweave.operators.cluster import first_leaders

# Fixed values of the cache's life cycle.
DECAY, HOT_SUPPORT, HOT_CONFIDENCE, FORGET_CONFIDENCE, FORGET_DAYS, FORGET_SUPPORT, MERGE_OVERLAP = 0.01, 10, 0.90, 0.15, 30.0, 3, 0.5
LOW, HIGH = 0.01, 0.99


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), x))


def beta_mean(success: Column, support: Column) -> Column:
    """Expected success rate after ``support`` trials, 0.5 without any."""
    return F.when(support == 0, 0.5).otherwise(clamp((1.0 + success) / (2.0 + support)))


def is_hot(support: Column, confidence: Column) -> Column:
    return (support > HOT_SUPPORT) & (confidence > HOT_CONFIDENCE)


def age_days(last_seen: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(last_seen)) / 86_400_000_000.0


def from_paths(events: DataFrame, source: str, target: str, order: str, score: str, payload: str, seen: str) -> DataFrame:
    """Edges from recorded paths: the first one starts the edge with its own score, every later one
    is another success. One aggregation, however often a path was recorded. ``order`` is unique."""
    grouped = events.groupBy(source, target).agg(
        F.count("*").alias("support"), F.min_by(score, order).alias("score"), F.max_by(payload, order).alias("payload"),
        F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.min(order).alias("first"),
    )
    success = F.col("support") - 1 + (F.col("score") > 0.5).cast("int")
    confidence = F.when(F.col("support") == 1, F.least(F.col("score"), F.lit(HIGH))).otherwise(beta_mean(success, F.col("support")))
    return grouped.select(source, target, "support", success.alias("success"), (F.col("support") - success).alias("failure"), confidence.alias("confidence"), "payload", "first_seen", "last_seen", "first")


def decay(edges: DataFrame, now: Column) -> DataFrame:
    """Confidence fades by DECAY a day since the edge was last seen, not below LOW. Not idempotent."""
    days = age_days(F.col("last_seen"), now)
    return edges.withColumn("confidence", F.when(days > 0, F.greatest(F.lit(LOW), F.col("confidence") * F.exp(-DECAY * days))).otherwise(F.col("confidence")))


def forget(edges: DataFrame, now: Column) -> DataFrame:
    """Edges that survive: confident enough, and either supported or seen lately."""
    old = (F.col("support") < FORGET_SUPPORT) & (age_days(F.col("last_seen"), now) > FORGET_DAYS)
    return edges.where((F.col("confidence") >= FORGET_CONFIDENCE) & ~old)


def similar_targets(edges: DataFrame, least: float = MERGE_OVERLAP) -> DataFrame:
    """(i, j) for edges of a source, i first, whose targets' word sets overlap by ``least`` or more.

    By prefix filter: a set's words are put in order of rarity, and two sets that overlap enough
    share one of their first size - ceil(least * size) + 1 words. The join is on (source, word).
    """
    clean = F.array_distinct(F.transform(F.filter(tx.split_words(F.regexp_replace("target", r"\.", " ")), lambda t: F.length(t) > 1), lambda t: tx.strip_signs(F.lower(t))))
    sets = edges.select("source", F.col("first").alias("id"), clean.alias("ws")).where("size(ws) > 0")
    words = sets.select("source", "id", "ws", F.explode("ws").alias("t"))
    counts = words.groupBy("t").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("source", "id").orderBy("n", "t"))
    size = F.size("ws")
    prefix = words.join(counts, "t").withColumn("rank", rank).where(F.col("rank") <= size - F.ceil(least * size) + 1)
    a, b = prefix.select("source", "t", F.col("id").alias("i"), F.col("ws").alias("x")), prefix.select("source", "t", F.col("id").alias("j"), F.col("ws").alias("y"))
    met = a.join(b, ["source", "t"]).where("i < j").dropDuplicates(["i", "j"])
    return met.where(tx.jaccard(F.col("x"), F.col("y")) >= least).select("i", "j")


def merge(edges: DataFrame) -> DataFrame:
    """Edges of a source with similar targets become one: each joins the first earlier edge that
    leads and resembles it. The most confident edge of a group (then the first) stays, with the
    counts of all pooled and its confidence rebuilt."""
    led = first_leaders(edges.select(F.col("first").alias("id")), similar_targets(edges)).withColumnRenamed("id", "first")
    grouped = edges.join(led, "first")
    best = grouped.groupBy("source", "leader").agg(
        F.count("*").alias("merged"), F.max_by("target", F.struct("confidence", -F.col("first"))).alias("target"), F.max("confidence").alias("top"),
        F.max_by("first", F.struct("confidence", -F.col("first"))).alias("first"), F.sum("support").alias("support"), F.sum("success").alias("success"),
        F.sum("failure").alias("failure"), F.max("last_seen").alias("last_seen"),
    )
    confidence = F.when(F.col("merged") == 1, F.col("top")).otherwise(beta_mean(F.col("success"), F.col("support")))
    return best.withColumn("confidence", confidence).drop("top", "leader")
