"""Tails of distributions, as plain functions of numbers: normal, Student's t, F, hypergeometric, Fisher's exact test.

They are applied to the few numbers an aggregation leaves (on the driver), or to columns through the UDFs below.
"""

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float | None, df: float | None) -> float | None:
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return None
    return 0.0 if math.isinf(t) else beta_inc(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float | None, d1: float, d2: float) -> float | None:
    if f is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return None
    return 0.0 if math.isinf(f) else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * max(f, 0.0)))


@lru_cache(1 << 16)
def log_choose(n: int, k: int) -> float:
    return -math.inf if k < 0 or k > n else math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric_sf(k: int, population: int, marked: int, drawn: int) -> float:
    """P(at least k marked among the drawn)."""
    low, high = max(0, marked + drawn - population), min(marked, drawn)
    if k <= low:
        return 1.0
    if k > high:
        return 0.0
    total = log_choose(population, drawn)
    logs = [log_choose(marked, i) + log_choose(population - marked, drawn - i) - total for i in range(k, high + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def fisher_exact(a: int, b: int, c: int, d: int, alternative: str = "two-sided") -> tuple[float, float]:
    """Odds ratio and p of a 2 x 2 table."""
    if min(a, b, c, d) < 0:
        raise ValueError("a count is negative")
    odds = math.nan if (a + b) * (c + d) * (a + c) * (b + d) == 0 else (math.inf if b * c == 0 else a * d / (b * c))
    n, row, col = a + b + c + d, a + b, a + c
    low, high = max(0, row + col - n), min(row, col)
    total = log_choose(n, col)
    p = np.exp([log_choose(row, i) + log_choose(n - row, col - i) - total for i in range(low, high + 1)])
    here = a - low
    match alternative:
        case "greater":
            out = p[here:].sum()
        case "less":
            out = p[: here + 1].sum()
        case _:
            out = p[p <= p[here] * (1 + 1e-7)].sum()
    return odds, float(min(1.0, out))


def chi2_sf_1(x: float) -> float:
    """The upper tail of chi-squared with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t, by column."""
    return pd.Series([t_two_sided(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([normal_two_sided(a) if pd.notna(a) else None for a in z], dtype=float)


@F.pandas_udf(DoubleType())
def hypergeometric_p(k: pd.Series, population: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    return pd.Series([hypergeometric_sf(*map(int, x)) for x in zip(k, population, marked, drawn, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided p of Fisher's exact test of the table ((a, b), (c, d)), by column."""
    return pd.Series([fisher_exact(*map(int, x))[1] for x in zip(a, b, c, d, strict=True)], dtype=float)
