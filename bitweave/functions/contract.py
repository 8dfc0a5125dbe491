"""Closed-form predictions of what a memory can hold, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
#: Measured constant of the collapse law.
COLLAPSE = 0.92


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def confidence(dist: Column, dim: Column | int, temperature: float = 8.0) -> Column:
    """Logistic of the z-score under the null; 0.5 is chance."""
    dim = F.lit(float(dim)) if isinstance(dim, int) else dim
    z = (dim / 2 - dist) / (F.sqrt(dim) / 2)
    return 1 / (1 + F.exp(-z / temperature))


def z_gumbel(m: Column) -> Column:
    """Where the nearest of m unrelated states lies, in standard deviations; m is at least 2."""
    zm = F.sqrt(2 * F.log(m))
    return zm - (F.log(F.log(m)) + math.log(4 * math.pi)) / (2 * zm)


def predicted_accuracy(n: Column, dim: Column, m: Column) -> Column:
    """Share of single queries expected to be right, of n facts, dim bits and m names."""
    margin = F.sqrt(2 * dim / (math.pi * n)) - z_gumbel(m)
    return 0.5 * (1 + erf(margin / math.sqrt(2)))


def capacity(dim: Column, m: Column, k: float = COLLAPSE) -> Column:
    """Number of facts at which half of the queries fail."""
    return k * 2 * dim / (math.pi * z_gumbel(m) * z_gumbel(m))


def recommended_dim(n: Column, m: Column, start: int, most: int = 1 << 20) -> Column:
    """Smallest start * 2**k with n at most half the capacity, ``most`` if none is."""
    steps = int(math.log2(most // start))
    out = F.lit(start << steps)
    for k in reversed(range(steps)):
        out = F.when(n <= 0.5 * capacity(F.lit(float(start << k)), m), F.lit(start << k)).otherwise(out)
    return out
