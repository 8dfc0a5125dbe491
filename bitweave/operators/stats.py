"""Statistics over states and vectors: information, dimension, inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """(i, j, n, si, sj, sij) for i <= j: sums over all rows of dimension i, j and of their product.

    Every task adds up its own outer products with one matrix product per batch and passes on one
    row per pair of dimensions; null vectors and vectors of another length do not count.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = np.array([v for v in batch.column(0).to_pylist() if v is not None and len(v) == dim], dtype=np.float64).reshape(-1, dim)
            n, total, gram = n + len(x), total + x.sum(axis=0), gram + x.T @ x
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), n), pa.int64()), pa.array(total[i]), pa.array(total[j]), pa.array(gram[i, j])], names=["i", "j", "n", "si", "sj", "sij"])

    parts = df.select(vector).mapInArrow(run, "i int, j int, n bigint, si double, sj double, sij double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])


def participation_ratio(m: DataFrame) -> DataFrame:
    """(trace)**2 / squared Frobenius norm of the covariance: the sum of eigenvalues squared over the
    sum of their squares, without an eigenvalue."""
    cov = (F.col("sij") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)
    c = m.select("i", "j", cov.alias("c"))
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("c")).otherwise(0))
    norm = F.sum(F.when(F.col("i") == F.col("j"), 1).otherwise(2) * F.col("c") * F.col("c"))
    return c.agg((trace * trace / norm).alias("ratio"))


def gini(df: DataFrame, value: str) -> DataFrame:
    """Both forms of the coefficient, and the number of values: they differ by 1 / n. Values are
    counted first, so ranks come from as many rows as there are different values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    order = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("n", F.sum("c").over(order)).withColumn("s", F.sum(F.col("v") * F.col("c")).over(order))
    # Cumulative sums within a run of c equal values rise by v each: their total over the run.
    lifted = F.col("c") * (F.col("s") - F.col("v") * F.col("c")) + F.col("v") * F.col("c") * (F.col("c") + 1) / 2
    t = run.agg(F.sum(lifted).alias("cum"), F.max("n").alias("n"), F.sum(F.col("v") * F.col("c")).alias("total"))
    return t.select("n", F.when(F.col("total") == 0, 0.0).otherwise(1 - 2 * F.col("cum") / (F.col("n") * F.col("total"))).alias("metric"), ((F.col("n") + 1 - 2 * F.col("cum") / F.col("total")) / F.col("n")).alias("standard"))


def mutual_information(n11: Column, n1: Column, m1: Column, n: Column) -> Column:
    """Bits of information between two binary variables, of their counts: both set, first set,
    second set, all."""
    def part(c: Column, a: Column, b: Column) -> Column:
        return F.when((c > 0) & (a > 0) & (b > 0), c / n * F.log2(c * n / (a * b))).otherwise(0.0)

    total = part(n11, n1, m1) + part(n1 - n11, n1, n - m1) + part(m1 - n11, n - n1, m1) + part(n - n1 - m1 + n11, n - n1, n - m1)
    return F.greatest(total, F.lit(0.0))
