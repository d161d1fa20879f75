"""Scalar functions that Spark SQL lacks, as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Acklam's published coefficients for the inverse normal distribution.
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
LOW = 0.02425

# Numerical Recipes' coefficients for the complementary error function (error below 1.2e-7).
E = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


#: Scores are told apart by so many digits, and from zero by this: beyond that lies the noise of linear algebra.
DIGITS, NOISE = 9, 1e-14


def significant(x: Column, digits: int = DIGITS) -> Column:
    """x to so many significant digits, so that what is equal in exact arithmetic is equal wherever it was computed."""
    x = x.cast("double")
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(F.abs(x) <= NOISE, 0.0).when(finite, F.rint(x * scale) / scale).otherwise(x)


def significant_array(x: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """The same for an array."""
    x = np.asarray(x, float)
    plain = np.isfinite(x) & (np.abs(x) > NOISE)
    scale = 10.0 ** (digits - 1 - np.floor(np.log10(np.abs(np.where(plain, x, 1.0)))))
    return np.where(plain, np.rint(np.where(plain, x, 0.0) * scale) / scale, np.where(np.abs(x) <= NOISE, 0.0, x))


def significant_sql(x: str, digits: int = DIGITS) -> str:
    """The same in SQL."""
    scale = f"pow(10.0::DOUBLE, {digits - 1} - floor(log10(abs({x}))))"
    return f"CASE WHEN abs({x}) <= {NOISE!r}::DOUBLE THEN 0.0 WHEN isfinite({x}) THEN round_even({x} * {scale}, 0) / {scale} ELSE {x} END"


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1."""
    r = F.least(p, 1.0 - p)
    q = F.sqrt(-2.0 * F.log(r))
    tail = _poly(C, q) / (_poly(D, q) * q + 1.0)
    m = p - 0.5
    middle = _poly(A, m * m) * m / (_poly(B, m * m) * (m * m) + 1.0)
    return F.when(p < LOW, tail).when(p > 1 - LOW, -tail).otherwise(middle)


def erfc(x: Column) -> Column:
    t = 1.0 / (1.0 + 0.5 * F.abs(x))
    y = t * F.exp(-x * x + _poly(E[::-1], t))
    return F.when(x >= 0, y).otherwise(2.0 - y)
