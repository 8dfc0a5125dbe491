"""Weighted majority vote over states, grouped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitweave.functions import words as w

TIE_NAME = "__tie__"


def bundle(df: DataFrame, keys: list[str], state: str, words: int, weight: Column | None = None, tie: str = "item", name: str = "trace") -> DataFrame:
    """One state per group: bit by bit the sign of the weighted sum, with the group's weight ``n``.

    Ties (possible where the weights' sum is even) follow ``tie``: "item" takes the bit of the tie
    item's state, "plus" takes +1, "minus" takes -1. Rows with a null state or weight do not count;
    a group without any other row is absent.

    The states are exploded into words, not bits: every word is one row whose 32 counters live in
    one hash aggregate and are combined before the shuffle. The shuffled volume is one row per group,
    word and map task, however many rows a group has.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    # Exploding the word numbers, which are constants, and leaving out null states in the sums instead
    # of by a filter keeps the optimizer from computing the state again in filters on the scan.
    numbered = df.select(*keys, weight.alias("_n"), F.col(state).alias("_s"), F.explode(F.array(*[F.lit(i) for i in range(words)])).alias("_w"))
    rows = numbered.select(*keys, "_n", "_w", F.get("_s", F.col("_w")).alias("_v"))
    counters = [F.sum(F.shiftright("_v", b).bitwiseAND(F.lit(1)) * F.col("_n")).alias(f"_{b}") for b in range(32)]
    counted = rows.groupBy(*keys, "_w").agg(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))).alias("_all"), *counters).where("_all is not null")
    if tie == "item":
        tied = F.element_at(w.item(F.lit(TIE_NAME), words), F.col("_w") + 1)
    else:
        tied = F.lit(w.MASK if tie == "minus" else 0).cast("bigint")

    def one(b: int) -> Column:
        twice = F.col(f"_{b}") * 2
        up = (twice > F.col("_all")) | ((twice == F.col("_all")) & (F.shiftright("_t", b).bitwiseAND(F.lit(1)) == 1))
        return F.when(up, F.lit(1 << b).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    made = counted.withColumn("_t", tied).select(*keys, "_w", F.col("_all"), reduce(lambda a, b: a + b, [one(b) for b in range(32)]).alias("_v"))
    packed = made.groupBy(*keys).agg(F.max("_all").alias("n"), F.array_sort(F.collect_list(F.struct("_w", "_v"))).alias("_p"))
    return packed.select(*keys, "n", F.transform("_p", lambda p: p["_v"]).alias(name))
