"""Special functions: Columns of elementary functions where these do, numpy-free Python elsewhere."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# A rational approximation of the error function, absolute error below 1.5e-7.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def q_column(t: Column) -> Column:
    """Upper tail of the standard normal as a Column."""
    z = F.abs(t) / math.sqrt(2)
    u = 1 / (1 + ERF_P * z)
    poly = sum((F.pow(u, F.lit(float(i + 1))) * a for i, a in enumerate(ERF_A)), F.lit(0.0))
    half = poly * F.exp(-z * z) / 2
    return F.when(t >= 0, half).otherwise(1 - half)


def gammaln_column(x: Column) -> Column:
    """Logarithm of the gamma function of positive x: moved up by eight and expanded; absolute error below 1e-11."""
    shift = sum((F.log(x + i) for i in range(1, 8)), F.log(x))
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def entropy_column(p: Column) -> Column:
    """Entropy of an array of probabilities; those below 1e-300 count as that."""
    return F.aggregate(F.transform(p, lambda v: -v * F.log(F.greatest(v, F.lit(1e-300)))), F.lit(0.0), lambda a, b: a + b)


def gap_moments(gap: Column) -> list[Column]:
    """Aggregates of a gap between two laws: its mean, its centred mean square, and the kurtosis-like ratio of its centred fourth moment."""
    m = F.avg(gap)
    second = F.avg(gap * gap) - m * m
    fourth = F.avg(F.pow(gap, F.lit(4.0))) - 4 * m * F.avg(F.pow(gap, F.lit(3.0))) + 6 * m * m * F.avg(gap * gap) - 3 * F.pow(m, F.lit(4.0))
    return [m.alias("mean"), second.alias("centred"), (fourth / (second * second)).alias("peaked")]


def q(t: float) -> float:
    return 0.5 * math.erfc(t / math.sqrt(2))


def q_inverse(p: float) -> float:
    return -NormalDist().inv_cdf(p)


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def chi2_isf(p: float, df: float) -> float:
    lo, hi = 0.0, max(10.0, df)
    while chi2_sf(hi, df) > p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_sf(mid, df) > p else (lo, mid)
    return (lo + hi) / 2


def ncx2_sf(x: float, df: float, nc: float) -> float:
    """Tail of the noncentral chi-square: a Poisson mixture of central ones."""
    half, total, j = nc / 2, 0.0, 0
    weight, seen = math.exp(-half), 0.0
    while seen < 1 - 1e-12 and j < 10_000:
        total += weight * chi2_sf(x, df + 2 * j)
        seen += weight
        j += 1
        weight *= half / j
    return total


def golden(f, lo: float, hi: float, tol: float = 1e-7) -> float:
    """Least point of a unimodal f on [lo, hi]."""
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    while hi - lo > tol:
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2
