"""Costs of giving a window to a law: of its equation, its place among the windows, physics and complexity; and their sum."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.losses import LOSSES
from .stats import quantile, rss


def equation_cost(coef: np.ndarray, scale: float) -> Column:
    """Array of the mean squared loss of a window under each law, from its statistics."""
    return F.array(*[rss(list(v)) * 0.5 / (F.col("n") * scale * scale) for v in np.atleast_2d(coef)])


def sample_costs(samples: DataFrame, predictions: list[Column], loss: str = "squared", scale: float | None = 1.0, y: str = "y", key: str = "window_id", **params) -> DataFrame:
    """(key, costs): mean loss of the window's scaled residuals under each prediction. scale None: each window and law has its
    own, 1.4826 times the median absolute residual, so that costs compare shapes only."""
    rows = samples.select(key, F.array(*[F.col(y) - p for p in predictions]).alias("_r"))
    k = len(predictions)
    if scale is None:
        own = rows.groupBy(key).agg(F.array(*[F.greatest(F.percentile(F.abs(F.col("_r")[i]), F.lit(0.5)) * 1.4826, F.lit(1e-9)) for i in range(k)]).alias("_s"))
        rows = rows.join(own, key)
        scaled = [F.col("_r")[i] / F.col("_s")[i] for i in range(k)]
    else:
        scaled = [F.col("_r")[i] / scale for i in range(k)]
    return rows.groupBy(key).agg(F.array(*[F.avg(LOSSES[loss](r, **params)) for r in scaled]).alias("costs"))


def residual_scale(samples: DataFrame, residual: Column) -> float:
    """1.4826 times the median absolute deviation of all assigned residuals; 1e-9 at least. Residuals are kept while they are read."""
    r = samples.select(residual.cast("double").alias("_r")).persist()
    try:
        mid = quantile(r, F.col("_r"), 0.5) or 0.0
        mad = quantile(r, F.abs(F.col("_r") - mid), 0.5) or 0.0
    finally:
        r.unpersist()
    return max(1.4826 * mad, 1e-9)


def euclidean_cost(z: Column, centres: np.ndarray) -> Column:
    """Array of the distances of z to the centres."""
    return F.array(*[F.sqrt(sum((F.pow(z[i] - float(c), F.lit(2.0)) for i, c in enumerate(row)), F.lit(0.0))) for row in centres])


def covariances(moments: dict, d: int) -> list[np.ndarray]:
    """Of (members, mean, covariance) of each cluster: the covariance and 1e-6 on its diagonal where there are more than d + 1 members,
    variances and 1e-3 where there are some, else one."""
    out = []
    for m, _, cov in (moments[k] for k in sorted(moments)):
        out.append(cov + 1e-6 * np.eye(d) if m > d + 1 else np.diag(np.diag(cov)) + 1e-3 * np.eye(d) if m > 1 else np.eye(d))
    return out


def density_cost(z: Column, centres: np.ndarray, covs: list[np.ndarray]) -> Column:
    """Array of the negative log-densities of z under a normal of each cluster, without the constant all share."""
    def one(c: np.ndarray, cov: np.ndarray) -> Column:
        inv, d = np.linalg.inv(cov), [z[i] - float(x) for i, x in enumerate(c)]
        q = sum((d[i] * d[j] * float(inv[i, j]) for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
        return 0.5 * q + 0.5 * float(np.linalg.slogdet(cov)[1])

    return F.array(*[one(c, s) for c, s in zip(centres, covs, strict=True)])


def moments(windows: DataFrame, label: str, z: str, d: int) -> dict:
    """{label: (members, mean, covariance)} of the features z, an array of d, of windows with a label."""
    x = [F.col(z)[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    agg = windows.groupBy(label).agg(F.count("*").alias("m"), *[F.avg(v).alias(f"c{i}") for i, v in enumerate(x)], *[F.covar_samp(x[i], x[j]).alias(f"s{i}_{j}") for i, j in pairs])
    out = {}
    for r in agg.collect():
        cov = np.zeros((d, d))
        for i, j in pairs:
            v = r[f"s{i}_{j}"]
            cov[i, j] = cov[j, i] = 0.0 if v is None or math.isnan(v) else v
        out[r[label]] = (r["m"], np.array([r[f"c{i}"] for i in range(d)]), cov)
    return out


def matrix_scale(df: DataFrame, column: str) -> float:
    """What a cost matrix (an array column) is divided by: its median, or where that is none, 1.4826 times the median deviation from it; else 1."""
    flat = df.select(F.explode(column).alias("_v"))
    mid = flat.agg(F.percentile(F.abs("_v"), F.lit(0.5))).first()[0] or 0.0
    if mid > 1e-12:
        return float(mid)
    spread = flat.agg(F.percentile(F.abs(F.col("_v") - mid), F.lit(0.75))).first()[0] or 0.0
    return 1.4826 * float(spread) if spread > 1e-12 else 1.0


def normalise(df: DataFrame, column: str, shift: bool = False) -> DataFrame:
    """An array column of costs divided by its matrix_scale, after its least value was taken off if asked; costs of 0 stay 0."""
    if shift:
        low = df.agg(F.min(F.array_min(column))).first()[0] or 0.0
        df = df.withColumn(column, F.transform(column, lambda v: v - float(low)))
    s = matrix_scale(df, column)
    return df.withColumn(column, F.transform(column, lambda v: v / s))


def joint_cost(equation: Column, geometry: Column | None = None, physics: Column | None = None, complexity: list[float] | None = None, alpha: float = 0.25, lam: float = 0.0, beta: float = 0.0) -> Column:
    """alpha geometry + (1 - alpha) equation + lam physics + beta complexity over its median, by law; arrays of normalised costs.

    Without geometry alpha is 0. A hook's physics costs count only where lam is above 0."""
    a = alpha if geometry is not None else 0.0
    mid = float(np.median(complexity)) if complexity else 1.0
    extra = F.array(*[F.lit(beta * c / (mid or 1.0)) for c in complexity]) if complexity and beta else None

    def at(i: Column) -> Column:
        v = (1 - a) * equation[i]
        if geometry is not None and a:
            v = v + a * geometry[i]
        if physics is not None and lam > 0:
            v = v + lam * physics[i]
        return v + extra[i] if extra is not None else v

    return F.transform(F.sequence(F.lit(0), F.size(equation) - 1), at)


def least(cost: Column) -> Column:
    """The place of the least cost, the first of equal ones."""
    return (F.array_position(cost, F.array_min(cost)) - 1).cast("int")
