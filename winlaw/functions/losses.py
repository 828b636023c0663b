"""Losses of scaled residuals, their influence, robust scales, and losses learned from residuals."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .special import golden

HUBER, CAUCHY, TUKEY, NU = 1.345, 2.3849, 4.685, 4.0


def _sq(x: Column) -> Column:
    return x * x


LOSSES: dict[str, Callable[..., Column]] = {
    "squared": lambda r: 0.5 * _sq(r),
    "absolute": lambda r: F.abs(r),
    "huber": lambda r, d=HUBER: F.when(F.abs(r) <= d, 0.5 * _sq(r)).otherwise(d * (F.abs(r) - 0.5 * d)),
    "cauchy": lambda r, c=CAUCHY: 0.5 * c * c * F.log1p(_sq(r / c)),
    "tukey": lambda r, c=TUKEY: F.when(F.abs(r) <= c, c * c / 6 * (1 - F.pow(1 - _sq(r / c), F.lit(3.0)))).otherwise(c * c / 6),
    "student_t": lambda r, nu=NU: 0.5 * (nu + 1) * F.log1p(_sq(r) / nu),
}
PSI: dict[str, Callable[..., Column]] = {
    "squared": lambda r: r,
    "absolute": lambda r: F.signum(r),
    "huber": lambda r, d=HUBER: F.greatest(F.lit(-d), F.least(F.lit(d), r)),
    "cauchy": lambda r, c=CAUCHY: r / (1 + _sq(r / c)),
    "tukey": lambda r, c=TUKEY: F.when(F.abs(r) <= c, r * _sq(1 - _sq(r / c))).otherwise(0.0),
    "student_t": lambda r, nu=NU: (nu + 1) * r / (nu + _sq(r)),
}
PSI_PRIME: dict[str, Callable[..., Column]] = {
    "squared": lambda r: F.lit(1.0),
    "absolute": lambda r: F.lit(0.0),
    "huber": lambda r, d=HUBER: F.when(F.abs(r) <= d, 1.0).otherwise(0.0),
    "cauchy": lambda r, c=CAUCHY: (1 - _sq(r / c)) / _sq(1 + _sq(r / c)),
    "tukey": lambda r, c=TUKEY: F.when(F.abs(r) <= c, (1 - _sq(r / c)) * (1 - 5 * _sq(r / c))).otherwise(0.0),
    "student_t": lambda r, nu=NU: (nu + 1) * (nu - _sq(r)) / _sq(nu + _sq(r)),
}


def robust_scale(df: DataFrame, value: str, by: list[str] | None = None, factor: float = 1.4826, eps: float = 1e-9) -> DataFrame:
    """factor * MAD of each group; where that is none, IQR / 1.349, then the standard deviation; eps at least."""
    by = by or []
    centre = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"), F.stddev_pop(value).alias("_sd"))
    joined = df.join(centre, by) if by else df.join(F.broadcast(centre))
    mad = joined.groupBy(*by).agg(F.percentile(F.abs(F.col(value) - F.col("_q")[1]), F.lit(0.5)).alias("_mad"), F.first("_q").alias("_q"), F.first("_sd").alias("_sd"))
    iqr = (F.col("_q")[2] - F.col("_q")[0]) / 1.349
    scale = F.when(F.col("_mad") > eps, F.col("_mad") * factor).when(iqr > eps, iqr).when(F.col("_sd") > eps, F.col("_sd")).otherwise(eps)
    return mad.select(*by, scale.alias("scale"))


def fit_student_t(residuals: np.ndarray, bounds: tuple[float, float] = (0.8, 200.0)) -> tuple[float, float, float]:
    """nu, scale and mean log-likelihood by profile maximum likelihood, the scale by EM for each nu."""
    r2 = np.square(np.asarray(residuals, float))

    def profile(nu: float) -> tuple[float, float]:
        s2 = max(float(np.median(r2)), 1e-12)
        for _ in range(100):
            new = max(float(np.mean((nu + 1) * r2 / (nu + r2 / s2))), 1e-12)
            if abs(new - s2) < 1e-10 * s2:
                break
            s2 = new
        c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi * s2)
        return float(c - np.mean((nu + 1) / 2 * np.log1p(r2 / (nu * s2)))), math.sqrt(s2)

    nu = math.exp(golden(lambda v: -profile(math.exp(v))[0], math.log(bounds[0]), math.log(bounds[1]), 1e-4))
    loglik, scale = profile(nu)
    return nu, scale, loglik


def candidate_losses(df: DataFrame, residual: str, candidates: tuple = ("squared", "absolute", "student_t"), max_samples: int = 20_000, key: list[str] | None = None) -> list[dict]:
    """Each candidate with its scale and mean log-likelihood over all rows: Gaussian, Laplace, Student t. The last one's nu and scale are
    fitted on a bounded sample: by a hash of a row's key, or without one at random, so that rows of equal residuals are drawn one by one."""
    r = F.col(residual)
    m = df.agg(F.avg(r * r).alias("v"), F.avg(F.abs(r)).alias("b")).first()
    sigma, b, out = max(math.sqrt(m["v"]), 1e-12), max(m["b"], 1e-12), []
    if "squared" in candidates:
        out.append({"loss": "squared", "scale": sigma, "loglik": -math.log(sigma) - 0.5 * math.log(2 * math.pi) - 0.5})
    if "absolute" in candidates:
        out.append({"loss": "absolute", "scale": b, "loglik": -math.log(2 * b) - 1})
    if "student_t" in candidates:
        order = F.xxhash64(*key) if key else F.rand(0)
        some = [x[0] for x in df.select(r.cast("double").alias("_r"), order.alias("_o")).orderBy("_o").limit(max_samples).collect()]
        nu, scale, _ = fit_student_t(np.array(some))
        tail = df.agg(F.avg(F.log1p(_sq(r / scale) / nu))).first()[0]
        loglik = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(scale) - (nu + 1) / 2 * tail
        out.append({"loss": "student_t", "scale": scale, "loglik": loglik, "nu": nu})
    return out


def learn_loss(df: DataFrame, residual: str, max_samples: int = 20_000, key: list[str] | None = None) -> dict:
    """The likeliest of the candidates."""
    return max(candidate_losses(df, residual, max_samples=max_samples, key=key), key=lambda x: x["loglik"])
