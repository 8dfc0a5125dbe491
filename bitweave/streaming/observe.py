"""Entries and edge hits that arrive as streams.

Both work on batch DataFrames too, which is how they are tested against the batch operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitweave.operators.edges import beta_mean


def edge_confidence(hits: DataFrame, keys: list[str], verified: str, seen: str, late: str | None = None) -> DataFrame:
    """Counts and confidence of every edge from its hits so far. On a stream this is a stateful
    aggregation in update mode: state per edge is three counters. With ``late``, hits older than the
    watermark are dropped."""
    rows = hits.withWatermark(seen, late) if late and hits.isStreaming else hits
    ok = F.coalesce(F.col(verified), F.lit(False)).cast("bigint")
    counted = rows.groupBy(*keys).agg(F.count("*").alias("support"), F.sum(ok).alias("success"), F.max(seen).alias("last_seen"))
    return counted.withColumn("failure", F.col("support") - F.col("success")).withColumn("confidence", beta_mean(F.col("success"), F.col("support")))


def windowed_hits(hits: DataFrame, keys: list[str], verified: str, seen: str, window: str, late: str) -> DataFrame:
    """Hits and successes per edge and time window; windows close once the watermark passes them."""
    ok = F.coalesce(F.col(verified), F.lit(False)).cast("bigint")
    return hits.withWatermark(seen, late).groupBy(F.window(seen, window).alias("span"), *keys).agg(F.count("*").alias("support"), F.sum(ok).alias("success"))


def observe(entries: DataFrame, state: Column, ident: str) -> DataFrame:
    """A stream of entries with their states, ready to append to a store."""
    return entries.select(F.col(ident), state.alias("words"), *[c for c in entries.columns if c not in (ident, "words")])
