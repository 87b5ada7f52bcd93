"""Probabilities that Spark lacks, as pandas UDFs over whole Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_tail(z: Column) -> Column:
    """1 - Phi(z)."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2)), na_action="ignore")

    return tail(z)


def ks_probability(d: float, n: int) -> float:
    """Chance of a Kolmogorov distance of at least d among n uniform values: the matrix recursion of Marsaglia, Tsang and
    Wang (2003) for n < 100, the series with Stephens' correction from there."""
    if n <= 0 or d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    if n >= 100:
        x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
        return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    a = np.array([[1.0 if i - j + 1 >= 0 else 0.0 for j in range(m)] for i in range(m)])
    power = h ** np.arange(1, m + 1)
    a[:, 0] -= power
    a[-1, :] -= power[::-1]
    a[-1, 0] += (2 * h - 1) ** m if 2 * h > 1 else 0
    for i in range(m):
        for j in range(m):
            if i - j + 1 > 0:
                a[i, j] /= math.factorial(i - j + 1)
    q = np.linalg.matrix_power(a, n)[k - 1, k - 1] * math.factorial(n) / float(n) ** n
    return min(1.0, max(0.0, 1 - q))


def ks_p_value(d: Column, n: Column) -> Column:
    @F.pandas_udf("double")
    def p(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([ks_probability(float(a), int(b)) if a == a and b == b else None for a, b in zip(x, k, strict=True)], dtype="float64")

    return p(d, n)


def share_at_least(value: Column, null_sorted, n: int) -> Column:
    """How many of a broadcast sorted array are at least the value, by binary search."""

    @F.pandas_udf("long")
    def count(x: pd.Series) -> pd.Series:
        return pd.Series(n - np.searchsorted(null_sorted.value, x.to_numpy(np.float64), side="left"))

    return count(value)
