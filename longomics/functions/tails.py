"""Distribution tails: closed forms as Column expressions, the rest as Arrow-batched pandas UDFs.

Each UDF maps a column of statistics to a column of probabilities; no state, no grouping.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

EPS = 2.220446049250313e-16


def chi2_even_upper(stat: Column, k: Column) -> Column:
    """Upper tail of chi-square with 2k degrees of freedom: the Erlang sum over the row's own k terms.

    Terms are kept as logarithms, so neither a large statistic nor a large k leaves the range of a double.
    """
    half = stat / 2.0
    later = F.when(k > 1, F.sequence(F.lit(1), (k - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct((-half).alias("log"), F.exp(-half).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = F.when(half > 0, acc["log"] + F.ln(half) - F.ln(i.cast("double"))).otherwise(F.lit(float("-inf")))
        return F.struct(term.alias("log"), (acc["sum"] + F.exp(term)).alias("sum"))

    return F.when(k > 0, F.least(F.aggregate(later, start, add, lambda acc: acc["sum"]), F.lit(1.0)))


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def lgamma(x) -> np.ndarray:
    return np.asarray(_lgamma(np.asarray(x, dtype=float)), dtype=float)


def log_betainc(a, b, x) -> np.ndarray:
    """log of the regularised incomplete beta I_x(a, b), by continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    swap = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    tiny = 1e-300
    c = np.ones_like(xx)
    d = 1.0 - (aa + bb) * xx / (aa + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (bb - m) * xx / ((aa + 2 * m - 1.0) * (aa + 2 * m)),
                    -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1.0))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / np.where(np.abs(c) < tiny, tiny, c)
            delta = c * d
            h = h * delta
        if np.all(np.abs(delta - 1.0) < 1e-15):
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        log_front = (lgamma(aa + bb) - lgamma(aa) - lgamma(bb) + aa * np.log(xx)
                     + bb * np.log1p(-xx) - np.log(aa))
        direct = log_front + np.log(h)
        direct = np.where(xx <= 0.0, -np.inf, direct)
        flipped = np.log1p(-np.exp(np.minimum(direct, 0.0)))
    return np.where(swap, flipped, direct)


def student_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    with np.errstate(invalid="ignore", divide="ignore"):
        x = df / (df + t * t)
        return np.exp(log_betainc(df / 2.0, 0.5, x))


def gamma_upper(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    with np.errstate(divide="ignore", invalid="ignore"):
        log_front = a * np.log(x) - x - lgamma(a)
    term = 1.0 / a
    total, k = term.copy(), a.copy()
    for _ in range(2000):
        k = k + 1.0
        term = term * x / k
        total = total + term
        if np.all(np.abs(term) < np.abs(total) * 1e-17) or not np.isfinite(term).all():
            break
    with np.errstate(over="ignore", invalid="ignore"):
        lower = 1.0 - np.exp(log_front) * total
    tiny = 1e-300
    b = x + 1.0 - a
    c = np.full_like(b, 1.0 / tiny)
    d = 1.0 / np.where(np.abs(b) < tiny, tiny, b)
    h = d.copy()
    for i in range(1, 2000):
        an = -i * (i - a)
        b = b + 2.0
        d = an * d + b
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        delta = d * c
        h = h * delta
        if np.all(np.abs(delta - 1.0) < 1e-15):
            break
    upper = np.exp(log_front) * h
    out = np.where(x < a + 1.0, lower, upper)
    return np.where(x <= 0.0, 1.0, out)


def normal_upper(z) -> np.ndarray:
    return np.array([0.5 * math.erfc(v / math.sqrt(2.0)) for v in np.asarray(z, dtype=float)])


def normal_isf(p) -> np.ndarray:
    """z with upper tail p: start from a log-tail approximation, then Newton/Halley on erfc."""
    p = np.asarray(p, dtype=float)
    q = np.minimum(p, 1.0 - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.sqrt(-2.0 * np.log(q))
        z = w - (np.log(w * w + 1.0) + 1.0) / (2.0 * np.maximum(w, 1e-3))
        z = np.where(q > 0.3, (0.5 - q) * math.sqrt(2.0 * math.pi), z)
        for _ in range(60):
            tail = np.array([0.5 * math.erfc(v / math.sqrt(2.0)) if np.isfinite(v) else np.nan
                             for v in np.ravel(z)]).reshape(z.shape)
            pdf = np.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi)
            step = (tail - q) / pdf
            z = z + step / (1.0 - 0.5 * z * step)
            if np.nanmax(np.abs(step), initial=0.0) < 1e-14:
                break
    z = np.where(q == 0.0, np.inf, z)
    return np.where(p > 0.5, -z, z)


def log_choose(n, k) -> np.ndarray:
    return lgamma(np.asarray(n) + 1.0) - lgamma(np.asarray(k) + 1.0) - lgamma(np.asarray(n) - k + 1.0)


def hypergeom_upper(a: int, universe: int, marked: int, drawn: int) -> float:
    """P(X >= a) for X ~ hypergeometric(universe, marked, drawn)."""
    hi = min(marked, drawn)
    if a <= max(0, drawn + marked - universe):
        return 1.0
    k = np.arange(a, hi + 1)
    logs = log_choose(marked, k) + log_choose(universe - marked, drawn - k) - log_choose(universe, drawn)
    top = logs.max()
    return float(min(1.0, np.exp(top) * np.exp(logs - top).sum()))


def binomial_two_sided_half(k: int, n: int) -> float:
    """Exact two-sided binomial test against one half."""
    if 2 * k == n:
        return 1.0
    far = max(k, n - k)
    i = np.arange(far, n + 1)
    logs = log_choose(n, i) - n * math.log(2.0)
    return float(min(1.0, 2.0 * np.exp(logs).sum()))


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_two_sided(t.to_numpy(), df.to_numpy()))


@F.pandas_udf(DoubleType())
def chi2_upper(stat: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(gamma_upper(df.to_numpy(dtype=float) / 2.0, stat.to_numpy(dtype=float) / 2.0))


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series(2.0 * normal_upper(z.abs().to_numpy()))


@F.pandas_udf(DoubleType())
def normal_quantile_upper(p: pd.Series) -> pd.Series:
    return pd.Series(normal_isf(p.to_numpy(dtype=float)))


@F.pandas_udf(DoubleType())
def fisher_greater(overlap: pd.Series, universe: pd.Series, marked: pd.Series,
                   drawn: pd.Series) -> pd.Series:
    return pd.Series([hypergeom_upper(int(a), int(u), int(m), int(d))
                      for a, u, m, d in zip(overlap, universe, marked, drawn)])


@F.pandas_udf(DoubleType())
def binomial_half(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([binomial_two_sided_half(int(a), int(b)) for a, b in zip(k, n)])
