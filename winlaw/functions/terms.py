"""Term libraries and bases: named Columns of the inputs of a law."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Basis = list[tuple[str, Column]]


def intercept() -> Basis:
    return [("1", F.lit(1.0))]


def library(inputs: list[str], *, trig: bool = True, log: bool = True, interactions: bool = True, constant: bool = True) -> Basis:
    """Per input: x, x^2, x^3, log1p|x|, sin x, cos x, sin 2x; then products of two inputs. The order decides ties."""
    out: Basis = intercept() if constant else []
    for name in inputs:
        x = F.col(name)
        out += [(name, x), (f"{name}^2", x * x), (f"{name}^3", x * x * x)]
        if log:
            out.append((f"log1p|{name}|", F.log1p(F.abs(x))))
        if trig:
            out += [(f"sin({name})", F.sin(x)), (f"cos({name})", F.cos(x)), (f"sin(2*{name})", F.sin(2 * x))]
    if interactions:
        out += [(f"{a}*{b}", F.col(a) * F.col(b)) for i, a in enumerate(inputs) for b in inputs[i + 1 :]]
    return out


def fourier(column: str, harmonics: int, period: float = 2 * math.pi) -> Basis:
    w, out = 2 * math.pi / period, intercept()
    for h in range(1, harmonics + 1):
        out += [(f"sin({h}w{column})", F.sin(F.col(column) * (h * w))), (f"cos({h}w{column})", F.cos(F.col(column) * (h * w)))]
    return out


def fit_range(df: DataFrame, column: str) -> tuple[float, float]:
    r = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo = 0.0 if r["lo"] is None else float(r["lo"])
    hi = lo + 1.0 if r["hi"] is None or r["hi"] <= lo else float(r["hi"])
    return lo, hi


def cosine(column: str, terms: int, lo: float, hi: float) -> Basis:
    u = (F.col(column) - lo) / (hi - lo)
    return [(f"cos({k}pi {column})", F.cos(u * (k * math.pi)) if k else F.lit(1.0)) for k in range(terms)]


def legendre(column: str, terms: int, lo: float, hi: float) -> Basis:
    """Legendre polynomials on [lo, hi], by their recurrence."""
    u = (F.col(column) - lo) * (2.0 / (hi - lo)) - 1.0
    cols = [F.lit(1.0), u]
    for k in range(1, terms - 1):
        cols.append(((2 * k + 1) * u * cols[k] - k * cols[k - 1]) / (k + 1))
    return [(f"P{k}({column})", c) for k, c in enumerate(cols[:terms])]


def nystrom(df: DataFrame, column: str, centers: int, scale: float = 2.0, tol: float = 1e-8) -> Basis:
    """[1, k(x, C) U L^(-1/2)]: a radial kernel at quantile centres; directions of eigenvalue below tol times the largest go."""
    probes = [(i + 0.5) / centers for i in range(centers)]
    r = df.agg(F.percentile(column, F.array(*[F.lit(p) for p in probes])).alias("q"), F.stddev_pop(column).alias("s")).first()
    sd = float(r["s"] or 0.0) + 1e-12
    c = np.array(r["q"], float) / sd
    gaps = np.sort(np.abs(c[:, None] - c[None, :]) + np.diag([np.inf] * len(c)), 1)[:, 0] if len(c) > 1 else np.ones(1)
    width = max(scale * float(np.median(gaps)), 1e-9)
    lam, u = np.linalg.eigh(np.exp(-((c[:, None] - c[None, :]) ** 2) / (2 * width**2)))
    keep = lam > tol * lam.max()
    m = u[:, keep] / np.sqrt(lam[keep])
    k = [F.exp(-F.pow(F.col(column) / sd - float(v), F.lit(2.0)) / (2 * width**2)) for v in c]
    return intercept() + [(f"rbf{j}", sum((k[i] * float(m[i, j]) for i in range(1, len(c))), k[0] * float(m[0, j]))) for j in range(m.shape[1])]


def random_fourier(column: str, features: int, bandwidth: float, seed: int = 0) -> Basis:
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 1 / bandwidth, features), rng.uniform(0, 2 * math.pi, features)
    return [(f"rff{j}", F.cos(F.col(column) * float(w[j]) + float(b[j])) * math.sqrt(2 / features)) for j in range(features)]


def cubic(column: str) -> Basis:
    x = F.col(column)
    return [("1", F.lit(1.0)), (column, x), (f"{column}^2", x * x), (f"{column}^3", x * x * x)]


def shifted(samples: DataFrame, column: str, tau: float) -> DataFrame:
    """samples with the first input moved by tau."""
    return samples.withColumn(column, F.col(column) + float(tau))


def nystrom_columns(df: DataFrame, columns: list[str], centers: int, scale: float = 2.0, tol: float = 1e-8, spacing: str = "kmeans", seed: int = 0, sample: int = 20_000) -> Basis:
    """As nystrom() over several inputs, each divided by its spread: centres by K-means of a bounded sample of rows, or evenly spaced
    (of one column)."""
    r = df.agg(*[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)], *[F.min(c).alias(f"lo{i}") for i, c in enumerate(columns)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(columns)]).first()
    sd = [float(r[f"s{i}"] or 0.0) + 1e-12 for i in range(len(columns))]
    if spacing == "uniform":
        if len(columns) > 1:
            raise ValueError("even spacing is for one column")
        c = np.linspace(float(r["lo0"]), float(r["hi0"]), centers)[:, None] / sd[0]
    else:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        some = df.select(*columns).orderBy(F.xxhash64(*columns, F.lit(seed))).limit(sample)
        vec = some.select(array_to_vector(F.array(*[F.col(n).cast("double") / v for n, v in zip(columns, sd, strict=True)])).alias("features"))
        c = np.array(KMeans(k=centers, seed=seed).fit(vec).clusterCenters())
    d = np.sqrt(((c[:, None] - c) ** 2).sum(-1))
    near = np.where(np.eye(len(c), dtype=bool), np.inf, d).min(1) if len(c) > 1 else np.ones(1)
    width = max(scale * float(np.median(near)), 1e-9)
    lam, u = np.linalg.eigh(np.exp(-(d**2) / (2 * width**2)))
    keep = lam > tol * lam.max()
    m = u[:, keep] / np.sqrt(lam[keep])
    k = [F.exp(-sum((F.pow(F.col(n) / v - float(x), F.lit(2.0)) for n, v, x in zip(columns, sd, row, strict=True)), F.lit(0.0)) / (2 * width**2)) for row in c]
    return intercept() + [(f"rbf{j}", sum((k[i] * float(m[i, j]) for i in range(1, len(c))), k[0] * float(m[0, j]))) for j in range(m.shape[1])]


def make_basis(kind: str, column: str, size: int, df: DataFrame | None = None, **kw) -> Basis:
    """A basis by name; an unknown one raises KeyError."""
    kinds: dict[str, Callable[[], Basis]] = {
        "fourier": lambda: fourier(column, size, **kw),
        "cosine": lambda: cosine(column, size, *fit_range(df, column)),
        "legendre": lambda: legendre(column, size, *fit_range(df, column)),
        "nystrom": lambda: nystrom(df, column, size, **kw),
        "rff": lambda: random_fourier(column, size, **kw),
        "cubic": lambda: cubic(column),
    }
    return kinds[kind]()


def expression(coef, names: list[str], drop: float = 0.0) -> str:
    """"a +b*term" with 5 significant digits; terms under `drop` times the largest coefficient are left out."""
    top = max((abs(c) for c in coef), default=0.0)
    parts = [f"{c:+.5g}" if n == "1" else f"{c:+.5g}*{n}" for c, n in zip(coef, names, strict=True) if c and abs(c) >= drop * top]
    return " ".join(parts).lstrip("+") or "0"


def predict(basis: Basis, coef) -> Column:
    return sum((c * float(b) for (_, c), b in zip(basis, coef, strict=True)), F.lit(0.0))
