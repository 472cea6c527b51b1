"""Tail areas and quantiles that Spark SQL has no functions for, as vectorised helpers for short result tables."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of each value, worked out once for equal ones."""
    own, at = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in own])[at].reshape(x.shape)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz), until no value moves by 1e-13."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    c, h = np.ones_like(z), d.copy()
    for m in range(1, 300):
        for k in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if not np.any(np.abs(c * d - 1) >= 1e-13):  # NaN does not hold it up
            break
    out = np.where(z <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def t_sf2(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return np.where(np.isfinite(t), incomplete_beta(df / 2, 0.5, df / (df + t * t)), np.nan)


@lru_cache(maxsize=4096)
def _t_quantile(p: float, df: float) -> float:
    """Newton steps from the normal quantile: the tail falls and is convex, so they come from below and never overshoot."""
    if not df > 0 or not 0.5 < p < 1:
        return math.nan if p != 0.5 else 0.0
    t, front = normal_quantile(p), math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    for _ in range(200):
        step = (float(t_sf2(t, df)) - 2 * (1 - p)) / (2 * front * (1 + t * t / df) ** (-(df + 1) / 2))
        t += step
        if abs(step) <= 1e-13 * t:
            break
    return t


def t_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """Upper quantile of Student's t, once for each different number of degrees of freedom."""
    df = np.asarray(df, float)
    own, at = np.unique(df, return_inverse=True)
    return np.array([_t_quantile(float(p), float(d)) for d in own])[at].reshape(df.shape)


def f_sf(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def normal_sf2(z: np.ndarray) -> np.ndarray:
    """Two-sided tail of the normal: a series of positive terms near 0, a continued fraction from its far end beyond."""
    x = np.abs(np.asarray(z, float)) / math.sqrt(2)
    near, far = np.minimum(x, 2.5), np.maximum(x, 2.5)
    term = near.copy()
    total = term.copy()
    for j in range(1, 60):
        term = term * (2 * near * near / (2 * j + 1))
        total += term
    tail = far.copy()
    for k in range(60, 0, -1):
        tail = far + k / 2 / tail
    with np.errstate(under="ignore"):
        out = np.where(x < 2.5, 1 - 2 / math.sqrt(math.pi) * np.exp(-near * near) * total, np.exp(-far * far) / math.sqrt(math.pi) / tail)
    return np.where(np.isnan(x), np.nan, out)


@lru_cache(maxsize=64)
def normal_quantile(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (low, mid)
    return (low + high) / 2


def sign_test(k: int, n: int) -> float:
    """Exact two-sided binomial test of k out of n at one half."""
    if n <= 0:
        return math.nan
    tail = sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n
    return min(1.0, 2 * tail)


@pandas_udf(DoubleType())
def t_critical(df: pd.Series) -> pd.Series:
    return pd.Series(t_quantile(0.975, df.to_numpy()))


@pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_sf2(t.astype(float).to_numpy(), df.astype(float).to_numpy()))


@pandas_udf(DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return pd.Series(normal_sf2(z.astype(float).to_numpy()))


@pandas_udf(DoubleType())
def sign_p_value(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([sign_test(int(a), int(b)) for a, b in zip(k, n, strict=True)])
