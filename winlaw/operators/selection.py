"""Choices without labels: leave-one-out errors, ranks of bases, numbers of laws; and checks of fitted laws."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import Basis
from .cluster import LawFit, hard_loop, mechanism_start, soft_em
from .stats import pooled, rss, solve, window_stats


def loo_error(samples: DataFrame, basis: Basis, y: str = "y", key: str = "window_id") -> DataFrame:
    """(key, n, loo): mean squared error of each sample under the fit of its window's others.

    Two shuffles at most: statistics by window give each window's law and the inverse of its Gram matrix; samples meet these, and a
    residual divided by one less its leverage is that without the sample. Windows of no more samples than p + 1 are left out.
    """
    p = len(basis)
    rows = samples.select(key, F.col(y).cast("double").alias("_y"), F.array(*[c.cast("double") for _, c in basis]).alias("_b")).dropna()
    own = window_stats(rows, [(n, F.col("_b")[i]) for i, (n, _) in enumerate(basis)], "_y", [key]).filter(F.col("n") > p + 1)

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            inv, law = [], []
            for g, a in zip(pdf["g"], pdf["a"], strict=True):
                a = np.asarray(a)
                g = np.asarray(g).reshape(len(a), -1)
                d = np.sqrt(np.maximum(np.diag(g), 1e-300))
                lam, vec = np.linalg.eigh(g / np.outer(d, d))
                keep = lam > 1e-8 * lam.max()
                m = (vec[:, keep] / lam[keep]) @ vec[:, keep].T / np.outer(d, d)
                inv.append(m.ravel())
                law.append(m @ a)
            yield pd.DataFrame({key: pdf[key], "n": pdf["n"], "_i": inv, "_v": law})

    laws = own.select(key, "n", "g", "a").mapInPandas(invert, f"{key} {dict(samples.dtypes)[key]}, n long, _i array<double>, _v array<double>")
    b = [F.col("_b")[i] for i in range(p)]
    residual = F.col("_y") - sum((b[i] * F.col("_v")[i] for i in range(p)), F.lit(0.0))
    leverage = sum((b[i] * b[j] * F.col("_i")[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))
    out = rows.join(laws, key).select(key, "n", (residual / F.greatest(1 - leverage, F.lit(1e-6))).alias("_r"))
    return out.groupBy(key).agg(F.first("n").alias("n"), F.avg(F.col("_r") * F.col("_r")).alias("loo"))


def select_rank(samples: DataFrame, make: Callable[[int], Basis], sizes: list[int], y: str = "y", rule: str = "1se") -> tuple[int, list[dict]]:
    """The size of least mean leave-one-out error over windows, or the smallest within one standard error of it."""
    rows = []
    for size in sizes:
        r = loo_error(samples, make(size), y).agg(F.avg("loo").alias("m"), F.stddev_samp("loo").alias("s"), F.count("*").alias("n")).first()
        if r["n"]:
            rows.append({"size": size, "error": r["m"], "se": (r["s"] or 0.0) / math.sqrt(r["n"])})
    best = min(rows, key=lambda r: r["error"])
    if rule == "min":
        return best["size"], rows
    return next(r["size"] for r in rows if r["error"] <= best["error"] + best["se"]), rows


def select_count(stats: DataFrame, counts: list[int], **kw) -> tuple[int, list[dict]]:
    """The number of laws of least BIC of the mixture's likelihood."""
    n = stats.agg(F.sum("n")).first()[0]
    p, rows = len(stats.select("a").first()[0]), []
    for k in counts:
        fit = soft_em(stats, mechanism_start(stats, k), **kw)
        rows.append({"k": k, "loglik": fit.history[-1]["loglik"], "bic": -2 * fit.history[-1]["loglik"] + (k * (p + 1) + k - 1) * math.log(n)})
    return min(rows, key=lambda r: r["bic"])["k"], rows


def crossfit_rss(stats: DataFrame, labels: DataFrame, folds: int = 3, ridge: float = 1e-8, fold: Column | None = None) -> DataFrame:
    """(window_id, k, rss): a window's own law is fitted without its fold, from the cluster's sums less the fold's; others as they are.

    One pass: every law is a constant, and a window picks its own by cluster and fold."""
    fold = F.pmod(F.xxhash64("window_id"), F.lit(folds)).cast("int") if fold is None else fold.cast("int")
    rows = stats.select("window_id", "n", "g", "a", "yy").join(labels.select("window_id", F.col("label").alias("own")), "window_id").withColumn("fold", fold).withColumn("cell", F.col("own") * folds + F.col("fold"))
    sums = pooled(rows, "cell")
    ks = sorted({c // folds for c in sums})
    each = []
    for k in ks:
        cells = {c % folds: sums[c] for c in sums if c // folds == k}
        g, a = sum(c[1] for c in cells.values()), sum(c[2] for c in cells.values())
        value = rss(list(solve(g, a, ridge)))
        for f, c in cells.items():
            if len(cells) > 1:
                value = F.when((F.col("own") == k) & (F.col("fold") == f), rss(list(solve(g - c[1], a - c[2], ridge)))).otherwise(value)
        each.append(F.struct(F.lit(k).alias("k"), value.alias("rss")))
    return rows.select("window_id", F.inline(F.array(*each)))


def snr_rank(errors: list[dict], rule: str = "snr", reps: int = 200, seed: int = 0) -> int:
    """The size of best signal to noise. errors: for each size {size, signal, noise} with arrays by window of what its features
    separate and of its noise. "snr": greatest ratio of means; "snr_1se": the least size within a bootstrap standard error of
    it; "snr_smooth": greatest after a running mean of three."""
    rows = sorted(errors, key=lambda r: r["size"])
    ratio = np.array([np.mean(r["signal"]) / max(np.mean(r["noise"]), 1e-300) for r in rows])
    best = int(ratio.argmax())
    if rule == "snr":
        return rows[best]["size"]
    if rule == "snr_smooth":
        wide = np.concatenate([ratio[:1], ratio, ratio[-1:]])
        return rows[int(((wide[:-2] + wide[1:-1] + wide[2:]) / 3).argmax())]["size"]
    if rule == "snr_1se":
        rng = np.random.default_rng(seed)
        s, n = np.asarray(rows[best]["signal"]), np.asarray(rows[best]["noise"])
        draws = [(lambda i: s[i].mean() / max(n[i].mean(), 1e-300))(rng.integers(0, len(s), len(s))) for _ in range(reps)]
        return next(r["size"] for r, v in zip(rows, ratio, strict=True) if v >= ratio[best] - np.std(draws))
    raise ValueError(f"no rule {rule!r}")


def corrupt_labels(labels: DataFrame, share: float, k: int, seed: int = 0) -> DataFrame:
    """labels with a share of them, by hash, moved to another of k."""
    u = F.pmod(F.xxhash64("window_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    step = 1 + F.pmod(F.xxhash64("window_id", F.lit(seed + 1)), F.lit(max(k - 1, 1)))
    return labels.withColumn("label", F.when(u < share, F.pmod(F.col("label") + step, F.lit(k))).otherwise(F.col("label")).cast("int"))


def refine(stats: DataFrame, fit: LawFit, engine: Callable[[float, np.ndarray, np.ndarray, float], np.ndarray], labels: DataFrame) -> tuple[LawFit, list[dict]]:
    """Each cluster's law searched anew by a heavier engine on half of its windows; kept where it costs less on the other half."""
    half = F.pmod(F.xxhash64("window_id", F.lit(1)), F.lit(2)).cast("int")
    rows = stats.select("window_id", "n", "g", "a", "yy").join(labels.select("window_id", "label"), "window_id").withColumn("cell", F.col("label") * 2 + half)
    sums, coef, log = pooled(rows, "cell"), fit.coef.copy(), []
    for k in range(len(coef)):
        if 2 * k not in sums or 2 * k + 1 not in sums:
            continue
        n, g, a, yy, _ = sums[2 * k]
        new = engine(n, g, a, yy)
        _, h, b, zz, _ = sums[2 * k + 1]
        before, after = (zz - 2 * b @ v + v @ h @ v for v in (coef[k], new))
        log.append({"k": k, "before": float(before), "found": float(after), "replaced": bool(after < before)})
        if after < before:
            coef[k] = new
    return LawFit(coef, fit.sigma, fit.weights, fit.history), log


def loop_gain(stats: DataFrame, labels: DataFrame, k: int, truth: DataFrame) -> tuple[float, float]:
    """Error of a partition, and of what the hard loop makes of it."""
    from .cluster import assign, laws_of_labels
    from .evaluate import aligned_accuracy

    own = truth.select("window_id", F.col("label").alias("truth"))
    after = assign(stats, hard_loop(stats, laws_of_labels(stats, labels, k)))
    return tuple(1 - aligned_accuracy(d.select("window_id", "label").join(own, "window_id"), "truth", "label") for d in (labels, after))
