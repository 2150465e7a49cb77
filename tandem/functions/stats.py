"""Column expressions and functions for correlations and their p-values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(r: Column) -> Column:
    """Into [-1, 1]; null stays null and NaN stays NaN."""
    return F.when(r.isNull() | F.isnan(r), r).otherwise(F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def pearson(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null where a column is constant, without an ANSI error."""
    return clamp(F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)))


def t_statistic(r: Column, n: Column) -> Column:
    """r * sqrt((n - 2) / (1 - r^2)); null if n < 3 or r = +-1."""
    return F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt(F.try_divide(n - 2, 1 - r * r)))


#: Terms of Stirling's series for the logarithm of the gamma function (fixed values), and what its argument is shifted by.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
SHIFT = 10
#: Most terms of the continued fraction; it settles within some multiple of the root of n.
DEPTH = 400


def _log_gamma_step(a: Column) -> Column:
    """log gamma(a + 1/2) - log gamma(a)."""

    def stirling(z: Column) -> Column:
        u, tail = F.lit(1.0) / (z * z), F.lit(0.0)
        for c in reversed(STIRLING):
            tail = c + u * tail
        return (z - 0.5) * F.log(z) - z + tail / z

    shifts = F.lit(0.0)
    for k in range(SHIFT):
        shifts = shifts + F.log((a + (k + 0.5)) / (a + float(k)))
    return stirling(a + (SHIFT + 0.5)) - stirling(a + float(SHIFT)) - shifts


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def beta_tail(a: Column, x: Column, y: Column, depth: Column) -> Column:
    """The regularised incomplete beta function I(x; a, 1/2) for 0 < x < 1 and y = 1 - x, by its continued fraction.

    The fraction is a fold over its terms from the last to the first, in the side of the
    function (x, or 1 - x with a and 1/2 in turn) on which it settles faster.
    """
    half = F.lit(0.5)
    swap = x > (a + 1) / (a + 2.5)
    side = F.struct(swap.alias("swap"), F.when(swap, half).otherwise(a).alias("p"), F.when(swap, a).otherwise(half).alias("q"), F.when(swap, y).otherwise(x).alias("z"), _log_gamma_step(a).alias("g"), depth.cast("int").alias("depth"))

    def term(m: Column, s: Column) -> Column:
        k = F.floor(m / 2).cast("double")
        p, q, z = s["p"], s["q"], s["z"]
        even = k * (q - k) * z / ((p + 2 * k - 1) * (p + 2 * k))
        odd = -(p + k) * (p + q + k) * z / ((p + 2 * k) * (p + 2 * k + 1))
        return F.when(m % 2 == 0, even).otherwise(odd)

    def whole(s: Column) -> Column:
        front = F.exp(s["p"] * F.log(s["z"]) + s["q"] * F.log1p(-s["z"]) + s["g"] - 0.5 * math.log(math.pi)) / s["p"]
        part = front / F.aggregate(F.sequence(s["depth"], F.lit(1)), F.lit(1.0), lambda f, m: 1 + F.try_divide(term(m, s), f))
        return F.least(F.greatest(F.when(s["swap"], 1 - part).otherwise(part), F.lit(0.0)), F.lit(1.0))

    return _bind(side, whole)


def pearson_p_value(r: Column | str, n: Column | str) -> Column:
    """Two-sided p of r from n rows: 1 if n = 2 or r = 0, 0 if r = +-1, null if r is missing or n < 2.

    An expression, so no Python worker; it is meant for aggregated rows, one for each feature.
    """
    r, n = (F.col(c) if isinstance(c, str) else c for c in (r, n))
    depth = F.least(F.lit(DEPTH), F.ceil(60 + 4 * F.sqrt(n)))
    tail = beta_tail((n - 2) / F.lit(2.0), 1 - r * r, r * r, depth)
    return F.when(r.isNull() | F.isnan(r) | n.isNull() | (n < 2), F.lit(None).cast("double")).when((n == 2) | (r * r == 0), F.lit(1.0)).when(F.abs(r) >= 1, F.lit(0.0)).otherwise(tail)
