"""Exact tests and intervals. Counts are columns; the tests run on aggregated rows, a few for each group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """(low, high) of the Wilson interval, rounded to 4 digits; null if n is 0."""
    p = k / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bound = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / (1 + z * z / n))), 4)
    return F.when(n > 0, F.struct(bound(middle - half).alias("low"), bound(middle + half).alias("high")))


def _weights(mode: int, low: int, high: int, up: Callable[[np.ndarray], np.ndarray], step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Values between low and high, ascending, and their weights relative to the mode's, as products of up(x), which is weight(x + 1)
    / weight(x). Values at both ends whose weights are below 1e-300 are left out: a few dozen deviations hold all others."""

    def outward(at: int, end: int, sign: int) -> list[np.ndarray]:
        parts, last = [np.empty(0)], 1.0
        while at != end and last >= 1e-300:
            n = min(step, abs(end - at))
            x = at + sign * np.arange(n, dtype=float)
            parts.append(last * np.cumprod(up(x) if sign > 0 else 1 / up(x - 1)))
            at, last = at + sign * n, parts[-1][-1]
        return parts

    above, below = np.concatenate(outward(mode, high, 1)), np.concatenate(outward(mode, low, -1))
    return np.arange(mode - len(below), mode + len(above) + 1), np.concatenate([below[::-1], [1.0], above])


@pandas_udf(DoubleType())
def mcnemar(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact two-sided binomial test of discordant pairs, which is also the sign test; 1 without any. A missing count gives none."""

    def p(x: int, y: int) -> float:
        n = x + y
        values, weights = _weights(n // 2, 0, n, lambda i: (n - i) / (i + 1))
        return min(1.0, 2 * float(weights[values <= min(x, y)].sum() / weights.sum()))

    return pd.Series([None if any(map(pd.isna, t)) else p(*map(int, t)) for t in zip(b, c, strict=True)], dtype=float)


@pandas_udf(DoubleType())
def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Fisher's exact two-sided test: all tables no likelier than the observed one. A missing count gives none."""

    def p(a: int, b: int, c: int, d: int) -> float:
        rows, column, total = a + b, a + c, a + b + c + d
        low, high = max(0, column - (total - rows)), min(rows, column)
        mode = min(high, max(low, (rows + 1) * (column + 1) // (total + 2)))
        values, weights = _weights(mode, low, high, lambda x: (rows - x) * (column - x) / ((x + 1) * (total - rows - column + x + 1)))
        seen = weights[values == a]
        return min(1.0, float(weights[weights <= seen[0] * (1 + 1e-9)].sum() / weights.sum())) if len(seen) else 0.0

    return pd.Series([None if any(map(pd.isna, t)) else p(*map(int, t)) for t in zip(a, b, c, d, strict=True)], dtype=float)
