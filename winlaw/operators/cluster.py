"""Clustering of windows by the law that made them.

An assignment is a function of the laws, so a round is one pass over the window statistics:
every batch scores its windows under the present laws and sums the statistics of each law's
windows; the driver gets K sums and solves for the next laws. No plan grows with the rounds,
and no label of a window is held between them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import golden
from .stats import NATIVE_COLUMNS, inliers, mechanism_features, rss, solve


@dataclass(frozen=True)
class LawFit:
    """K laws by rows, their noise, weights (and degrees of freedom if heavy-tailed), and a row for each round."""

    coef: np.ndarray
    sigma: np.ndarray
    weights: np.ndarray
    history: list[dict]


def _rss(pdf: pd.DataFrame, coef: np.ndarray) -> np.ndarray:
    a = np.stack(pdf["a"].to_numpy())
    g = np.stack(pdf["g"].to_numpy()).reshape(len(a), a.shape[1], -1)
    return np.maximum(pdf["yy"].to_numpy()[:, None] - 2 * a @ coef.T + np.einsum("ki,wij,kj->wk", coef, g, coef), 0)


def _loglik(pdf: pd.DataFrame, fit: LawFit) -> np.ndarray:
    n = pdf["n"].to_numpy(float)[:, None]
    return -_rss(pdf, fit.coef) / (2 * fit.sigma**2) - n * np.log(fit.sigma) - n / 2 * math.log(2 * math.pi)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def responsibilities(pdf: pd.DataFrame, fit: LawFit, temperature: float = 1.0) -> np.ndarray:
    return _softmax((np.log(fit.weights) + _loglik(pdf, fit)) / temperature)


def _sums(stats: DataFrame, weigh, k: int) -> list[dict]:
    """For each law the sums of weighted statistics; weigh(batch) -> (weights (W, K), rss (W, K), log-likelihood (W,))."""
    names = ["k", "r", "n", "g", "a", "yy", "rss", "ll", "w"]
    schema = "k int, r double, n double, g array<double>, a array<double>, yy double, rss double, ll double, w long"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            r, rss, ll = weigh(pdf)
            g, a = np.stack(pdf["g"].to_numpy()), np.stack(pdf["a"].to_numpy())
            n, yy = pdf["n"].to_numpy(float), pdf["yy"].to_numpy()
            rows = [(j, r[:, j].sum(), r[:, j] @ n, r[:, j] @ g, r[:, j] @ a, r[:, j] @ yy, float(r[:, j] @ rss[:, j]), float(ll.sum()), len(pdf)) for j in range(k)]
            yield pd.DataFrame(rows, columns=names)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        s = lambda c: pdf[c].sum()
        return pd.DataFrame([(pdf["k"][0], s("r"), s("n"), np.sum(list(pdf["g"]), 0), np.sum(list(pdf["a"]), 0), s("yy"), s("rss"), s("ll"), int(s("w")))], columns=names)

    rows = stats.select("n", "g", "a", "yy").mapInPandas(partial, schema).groupBy("k").applyInPandas(total, schema).collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["k"])


def _native_sums(stats: DataFrame, coef: np.ndarray, before: np.ndarray | None) -> list[dict]:
    """As _sums() for windows given whole to the law of least rss, summed in the JVM; ll counts windows whose law changed."""
    k, p = coef.shape
    nearest = lambda laws: F.array_min(F.array(*[F.struct(rss(list(v)).alias("rss"), F.lit(j).alias("k")) for j, v in enumerate(laws)]))
    rows = stats.select("n", "g", "a", "yy", nearest(coef).alias("_m"), (nearest(before)["k"] if before is not None else F.lit(-1)).alias("_was"))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = rows.groupBy(F.col("_m.k").alias("k")).agg(
        F.count("*").alias("w"), F.sum("n").alias("n"), F.sum("yy").alias("yy"), F.sum("_m.rss").alias("rss"), F.sum((F.col("_was") != F.col("_m.k")).cast("double")).alias("ll"),
        *[F.sum(F.col("g")[i * p + j]).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(F.col("a")[i]).alias(f"a{i}") for i in range(p)],
    ).collect()
    out = [{"k": j, "r": 0.0, "n": 0.0, "g": np.zeros((p, p)), "a": np.zeros(p), "yy": 0.0, "rss": 0.0} for j in range(k)]
    for r in got:
        g = np.zeros((p, p))
        for i, j in pairs:
            g[i, j] = g[j, i] = r[f"g{i}_{j}"]
        out[r["k"]] |= {"r": float(r["w"]), "n": float(r["n"]), "g": g.ravel(), "a": np.array([r[f"a{i}"] for i in range(p)]), "yy": r["yy"], "rss": r["rss"]}
    return [o | {"w": sum(r["w"] for r in got), "ll": sum(r["ll"] for r in got)} for o in out]


def _refit(sums: list[dict], ridge: float, floor: float) -> LawFit:
    coef, sigma, weights = [], [], []
    for s in sums:
        a = np.array(s["a"])
        g = np.array(s["g"]).reshape(len(a), -1)
        v = solve(g, a, ridge) if s["n"] > 0 else np.zeros(len(a))
        coef.append(v)
        sigma.append(math.sqrt(max((s["yy"] - 2 * a @ v + v @ g @ v) / max(s["n"], 1), 1e-12)))
        weights.append(s["r"])
    w = np.maximum(np.array(weights) / max(sum(weights), 1e-300), floor)
    return LawFit(np.array(coef), np.array(sigma), w / w.sum(), [])


def laws_of_labels(stats: DataFrame, labels: DataFrame, k: int, ridge: float = 1e-8) -> LawFit:
    """Laws of a given partition (window_id, label)."""
    rows = stats.select("window_id", "n", "g", "a", "yy").join(labels.select("window_id", "label"), "window_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [(j, float(len(o)), o["n"].sum(), np.sum(list(o["g"]), 0), np.sum(list(o["a"]), 0), o["yy"].sum()) for j, o in pdf.groupby("label")]
            yield pd.DataFrame(own, columns=["k", "r", "n", "g", "a", "yy"])

    schema = "k int, r double, n double, g array<double>, a array<double>, yy double"

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["k"][0], pdf["r"].sum(), pdf["n"].sum(), np.sum(list(pdf["g"]), 0), np.sum(list(pdf["a"]), 0), pdf["yy"].sum())], columns=["k", "r", "n", "g", "a", "yy"])

    got = {r["k"]: r.asDict() for r in rows.mapInPandas(run, schema).groupBy("k").applyInPandas(total, schema).collect()}
    p = len(next(iter(got.values()))["a"])
    empty = {"r": 0.0, "n": 0.0, "g": [0.0] * p * p, "a": [0.0] * p, "yy": 0.0}
    return _refit([got.get(j, empty) for j in range(k)], ridge, 1e-3)


def hard_loop(stats: DataFrame, start: LawFit, max_iter: int = 20, tol: float = 0.0, ridge: float = 1e-8) -> LawFit:
    """Assign each window to the law of least rss, refit, until no more than tol of the windows change."""
    fit, before, history = start, None, []
    k = len(start.coef)

    for it in range(max_iter):
        def weigh(pdf: pd.DataFrame, now=fit, old=before):
            cost = _rss(pdf, now.coef)
            label = cost.argmin(1)
            r = np.zeros_like(cost)
            r[np.arange(len(cost)), label] = 1
            changed = (_rss(pdf, old.coef).argmin(1) != label) if old is not None else np.ones(len(cost))
            return r, cost, changed.astype(float)

        native = fit.coef.shape[1] <= NATIVE_COLUMNS
        sums = _native_sums(stats, fit.coef, before.coef if before is not None else None) if native else _sums(stats, weigh, k)
        changed = sums[0]["ll"] / max(sums[0]["w"], 1)
        history.append({"iteration": it, "changed": changed, "cost": sum(s["rss"] for s in sums), "sizes": [int(s["r"]) for s in sums]})
        if before is not None and changed <= tol:
            break
        before, new = fit, _refit(sums, ridge, 1e-3)
        alive = np.array([s["r"] > 0 for s in sums])
        fit = LawFit(np.where(alive[:, None], new.coef, fit.coef), new.sigma, new.weights, [])
    return LawFit(fit.coef, fit.sigma, fit.weights, history)


def soft_em(stats: DataFrame, start: LawFit, max_iter: int = 50, tol: float = 1e-6, temperature: float = 1.0, anneal: int = 0, ridge: float = 1e-8) -> LawFit:
    """Mixture of laws by EM; the temperature falls to 1 over `anneal` rounds, and only then may it stop."""
    fit, last, history = start, None, []
    k = len(start.coef)
    for it in range(max_iter):
        heat = temperature ** max(0.0, 1 - it / anneal) if anneal else 1.0

        def weigh(pdf: pd.DataFrame, now=fit, t=heat):
            z = np.log(now.weights) + _loglik(pdf, now)
            m = z.max(1)
            return _softmax(z / t), _rss(pdf, now.coef), m + np.log(np.exp(z - m[:, None]).sum(1))

        sums = _sums(stats, weigh, k)
        ll = sums[0]["ll"]
        history.append({"iteration": it, "loglik": ll, "temperature": heat})
        fit = _refit(sums, ridge, 1e-3)
        if last is not None and heat == 1.0 and abs(ll - last) <= tol * abs(last):
            break
        last = ll
    return LawFit(fit.coef, fit.sigma, fit.weights, history)


def assign(stats: DataFrame, fit: LawFit) -> DataFrame:
    """(window_id, label, posterior, rss)."""
    kind = dict(stats.dtypes)["window_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            r, rss = responsibilities(pdf, fit), _rss(pdf, fit.coef)
            label = r.argmax(1)
            yield pd.DataFrame({"window_id": pdf["window_id"], "label": label.astype("int32"), "posterior": list(r), "rss": rss[np.arange(len(rss)), label] if len(rss) else []})

    return stats.select("window_id", "n", "g", "a", "yy").mapInPandas(run, f"window_id {kind}, label int, posterior array<double>, rss double")


def kmeans(features: DataFrame, k: int, seeds: int = 5, column: str = "s") -> DataFrame:
    """(window_id, label) of the K-means of least cost over several seeds."""
    rows = features.select("window_id", array_to_vector(column).alias("features")).cache()
    best = min((KMeans(k=k, seed=s).fit(rows) for s in range(seeds)), key=lambda m: m.summary.trainingCost)
    out = best.transform(rows).select("window_id", F.col("prediction").alias("label"))
    return out


def mechanism_start(stats: DataFrame, k: int, trim: float = 0.01, seeds: int = 5) -> LawFit:
    """Laws of the K-means of mechanism features, its centres found without the farthest windows."""
    if k == 1:
        return laws_of_labels(stats, stats.select("window_id").withColumn("label", F.lit(0)), 1)
    feats, m = mechanism_features(stats)
    feats = feats.cache()
    own = inliers(feats, m.shape[1], trim).select("window_id", array_to_vector("s").alias("features")).cache()
    best = min((KMeans(k=k, seed=s).fit(own) for s in range(seeds)), key=lambda x: x.summary.trainingCost)
    labels = best.transform(feats.select("window_id", array_to_vector("s").alias("features"))).select("window_id", F.col("prediction").alias("label"))
    return laws_of_labels(stats, labels, k)


def gmm(features: DataFrame, k: int, seeds: int = 8, column: str = "s") -> DataFrame:
    """Gaussian mixture, the likeliest of several starts."""
    rows = features.select("window_id", array_to_vector(column).alias("features")).cache()
    best = max((GaussianMixture(k=k, seed=s, maxIter=200).fit(rows) for s in range(seeds)), key=lambda m: m.summary.logLikelihood)
    return best.transform(rows).select("window_id", F.col("prediction").alias("label"))


def bisecting(features: DataFrame, k: int, seeds: int = 3, column: str = "s") -> DataFrame:
    """Divisive partition: the largest cluster is split in two by K-means until there are k. Stands for the agglomerative and
    tree-based ones, which need all distances or one task."""
    now = features.select("window_id", array_to_vector(column).alias("features")).withColumn("label", F.lit(0)).cache()
    for new in range(1, k):
        big = now.groupBy("label").count().orderBy(F.desc("count"), "label").first()["label"]
        own = now.filter(F.col("label") == big)
        best = min((KMeans(k=2, seed=s).fit(own) for s in range(seeds)), key=lambda m: m.summary.trainingCost)
        split = best.transform(now).withColumn("label", F.when((F.col("label") == big) & (F.col("prediction") == 1), new).otherwise(F.col("label")))
        now = split.select("window_id", "features", "label").cache()
    return now.select("window_id", "label")


def fuzzy_cmeans(features: DataFrame, k: int, m: float = 2.0, max_iter: int = 100, tol: float = 1e-5, seed: int = 0, column: str = "s") -> tuple[np.ndarray, DataFrame]:
    """Centres, and (window_id, label, membership)."""
    def memberships(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        d = np.maximum(((x[:, None] - c) ** 2).sum(-1), 1e-18) ** (-1 / (m - 1))
        return d / d.sum(1, keepdims=True)

    rows = features.select("window_id", F.col(column).alias("s")).cache()
    some = np.array([r["s"] for r in rows.orderBy(F.xxhash64("window_id", F.lit(seed))).limit(50 * k).collect()])
    picked = [0]
    while len(picked) < k:  # each next start is the farthest from those before
        picked.append(int(((some[:, None] - some[picked]) ** 2).sum(-1).min(1).argmax()))
    c = some[picked]
    for _ in range(max_iter):
        def run(batches: Iterator[pd.DataFrame], now=c) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["s"].to_numpy())
                    u = memberships(x, now) ** m
                    yield pd.DataFrame({"k": range(k), "w": u.sum(0), "x": list(u.T @ x)})

        parts = rows.mapInPandas(run, "k int, w double, x array<double>")
        got = parts.groupBy("k").agg(F.sum("w").alias("w"), *[F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(some.shape[1])]).orderBy("k").collect()
        new = np.array([[r[f"x{i}"] / r["w"] for i in range(some.shape[1])] for r in got])
        moved, c = float(np.abs(new - c).max()), new
        if moved < tol:
            break

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            u = memberships(np.stack(pdf["s"].to_numpy()), c) if len(pdf) else np.zeros((0, k))
            yield pd.DataFrame({"window_id": pdf["window_id"], "label": u.argmax(1).astype("int32"), "membership": list(u)})

    return c, rows.mapInPandas(label, f"window_id {dict(features.dtypes)['window_id']}, label int, membership array<double>")


def student_t_em(samples: DataFrame, columns: list, y: str, start: LawFit, max_iter: int = 30, nu: float = 30.0) -> tuple[LawFit, np.ndarray]:
    """Mixture of laws with Student-t noise; each round reads the samples once. columns: the basis. Windows are by window_id."""
    k, p = len(start.coef), len(columns)
    rows = samples.select("window_id", F.col(y).cast("double").alias("_y"), F.array(*[c.cast("double") for _, c in columns]).alias("_b"))
    rows = rows.repartition("window_id").cache()  # partitioned once; a round's groups need no shuffle
    fit, nus, last, history = start, np.full(k, nu), None, []
    for it in range(max_iter):
        held = (fit, nus.copy())

        def run(pdf: pd.DataFrame) -> pd.DataFrame:  # collected within this round
            now, deg = held
            b, v = np.stack(pdf["_b"].to_numpy()), pdf["_y"].to_numpy()
            r2 = ((v[:, None] - b @ now.coef.T) / now.sigma) ** 2
            c = np.array([math.lgamma((d + 1) / 2) - math.lgamma(d / 2) - 0.5 * math.log(d * math.pi) for d in deg]) - np.log(now.sigma)
            ll = (c - (deg + 1) / 2 * np.log1p(r2 / deg)).sum(0) + np.log(now.weights)
            top = ll.max()
            r = np.exp(ll - top)
            total, r = top + math.log(r.sum()), r / r.sum()
            u = (deg + 1) / (deg + r2)
            out = []
            for j in range(k):
                w = u[:, j]
                out.append((j, r[j], r[j] * len(v), (r[j] * (b.T * w) @ b).ravel(), r[j] * b.T @ (w * v), r[j] * float(w @ (v * v)), r[j] * float((np.log(w) - w).sum()), total if j == 0 else 0.0))
            return pd.DataFrame(out, columns=["k", "r", "n", "g", "a", "yy", "lw", "ll"])

        schema = "k int, r double, n double, g array<double>, a array<double>, yy double, lw double, ll double"
        got = rows.groupBy("window_id").applyInPandas(run, schema)

        def total(pdf: pd.DataFrame) -> pd.DataFrame:
            s = lambda c: pdf[c].sum()
            return pd.DataFrame([(pdf["k"][0], s("r"), s("n"), np.sum(list(pdf["g"]), 0), np.sum(list(pdf["a"]), 0), s("yy"), s("lw"), s("ll"))], columns=["k", "r", "n", "g", "a", "yy", "lw", "ll"])

        sums = sorted((r.asDict() for r in got.groupBy("k").applyInPandas(total, schema).collect()), key=lambda r: r["k"])
        ll = sums[0]["ll"]
        fit = _refit(sums, 1e-8, 1e-3)
        for j, s in enumerate(sums):  # the EM equation for the degrees of freedom, by its root
            const = s["lw"] / max(s["n"], 1e-12) + 1
            old = nus[j]

            def gap(v: float, c=const, o=old) -> float:
                psi = lambda z: (math.lgamma(z + 1e-4) - math.lgamma(z - 1e-4)) / 2e-4
                return abs(math.log(v / 2) - psi(v / 2) + c + psi((o + 1) / 2) - math.log((o + 1) / 2))

            nus[j] = math.exp(golden(lambda t: gap(math.exp(t)), math.log(0.8), math.log(200), 1e-4))
        history.append({"iteration": it, "loglik": ll})
        if last is not None and abs(ll - last) <= 1e-6 * abs(last):
            break
        last = ll
    assert fit.coef.shape[1] == p
    return LawFit(fit.coef, fit.sigma, fit.weights, history), nus


def standardise(features: DataFrame, dims: int, column: str = "s") -> DataFrame:
    """Features less their mean, over their population standard deviation (1 where there is none)."""
    m = features.agg(*[F.avg(F.col(column)[i]).alias(f"m{i}") for i in range(dims)], *[F.stddev_pop(F.col(column)[i]).alias(f"s{i}") for i in range(dims)]).first()
    return features.withColumn(column, F.array(*[(F.col(column)[i] - float(m[f"m{i}"])) / (float(m[f"s{i}"]) or 1.0) for i in range(dims)]))


def _summary(features: DataFrame, column: str, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of features in at most `most` cells: (weights, means). Cells are those of K-means centres, so all rows count."""
    rows = features.select("window_id", array_to_vector(column).alias("features")).cache()
    n = rows.count()
    if n <= most:
        x = np.array([r["features"].toArray() for r in rows.orderBy("window_id").collect()])  # at most `most` rows
        return np.ones(len(x)), x
    model = KMeans(k=most, seed=seed, maxIter=5).fit(rows)
    size = {r["prediction"]: r["count"] for r in model.transform(rows).groupBy("prediction").count().collect()}
    centres = np.array(model.clusterCenters())
    return np.array([size.get(i, 0) for i in range(len(centres))], float), centres


def _by_nearest(features: DataFrame, column: str, centres: np.ndarray, group: np.ndarray) -> DataFrame:
    """(window_id, label): the group of the nearest of a bounded number of centres."""
    kind = dict(features.dtypes)["window_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf[column].to_numpy()) if len(pdf) else np.zeros((0, centres.shape[1]))
            near = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
            yield pd.DataFrame({"window_id": pdf["window_id"], "label": group[near].astype("int32")})

    return features.select("window_id", column).mapInPandas(run, f"window_id {kind}, label int")


def ward(features: DataFrame, k: int, column: str = "s", most: int = 1000, seed: int = 0) -> DataFrame:
    """Agglomeration by least growth of the sum of squares. Up to `most` windows join one by one; of more, the cells of K-means centres,
    with their weights, and a window follows its centre."""
    w, x = _summary(features, column, most, seed)
    alive, group = list(range(len(x))), np.arange(len(x))
    w, mean = w.copy(), x.copy()
    d = ((mean[:, None] - mean) ** 2).sum(-1) * (w[:, None] * w / np.maximum(w[:, None] + w, 1e-300))
    np.fill_diagonal(d, np.inf)
    for _ in range(len(x) - k):
        i, j = np.unravel_index(int(d.argmin()), d.shape)
        mean[i] = (w[i] * mean[i] + w[j] * mean[j]) / max(w[i] + w[j], 1e-300)
        w[i] += w[j]
        group[group == j] = i
        alive.remove(j)
        d[j], d[:, j] = np.inf, np.inf
        row = ((mean - mean[i]) ** 2).sum(-1) * (w * w[i] / np.maximum(w + w[i], 1e-300))
        row[[a for a in range(len(x)) if a not in set(alive)]] = np.inf
        row[i] = np.inf
        d[i], d[:, i] = row, row
    order = {a: n for n, a in enumerate(sorted(alive))}
    return _by_nearest(features, column, x, np.array([order[g] for g in group]))


def spectral(features: DataFrame, k: int, gamma: float | None = None, column: str = "s", most: int = 1000, seed: int = 0) -> DataFrame:
    """K-means of the leading eigenvectors of the normalised radial affinity, of up to `most` windows or weighted cells of all."""
    w, x = _summary(features, column, most, seed)
    d2 = ((x[:, None] - x) ** 2).sum(-1)
    gamma = 1 / max(float(np.median(d2[d2 > 0])), 1e-300) if gamma is None and (d2 > 0).any() else gamma or 1.0
    a = np.exp(-gamma * d2) * np.sqrt(w[:, None] * w)
    deg = np.sqrt(np.maximum(a.sum(1), 1e-300))
    vec = np.linalg.eigh(a / deg[:, None] / deg)[1][:, -k:]
    rows = vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-300)
    rng, best = np.random.default_rng(seed), None
    for _ in range(10):
        c = rows[rng.choice(len(rows), k, replace=False)]
        for _ in range(100):
            near = ((rows[:, None] - c) ** 2).sum(-1).argmin(1)
            new = np.array([np.average(rows[near == j], axis=0, weights=w[near == j] + 1e-300) if (near == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = float((((rows - c[near]) ** 2).sum(-1) * w).sum())
        if best is None or cost < best[0]:
            best = (cost, near)
    return _by_nearest(features, column, x, best[1])


def birch(features: DataFrame, k: int, threshold: float = 0.5, branching: int = 200, column: str = "s") -> DataFrame:
    """Clustering features: each batch gathers its windows in balls of a radius of at most `threshold` (doubled where there would be more
    than `branching`), given by weight, sum and sum of squares; balls of all batches are gathered the same way and their means agglomerated."""
    kind_sum = "w double, m array<double>, q double"

    def gather(w: np.ndarray, m: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        radius = threshold
        while True:
            cw, cm, cq, full = [], [], [], False
            for a, b, c in zip(w, m, q, strict=True):
                if cw:
                    tw, tm, tq = np.array(cw) + a, np.array(cm) + b, np.array(cq) + c
                    r2 = np.maximum(tq / tw - ((tm / tw[:, None]) ** 2).sum(1), 0)
                    i = int(((np.array(cm) / np.array(cw)[:, None] - b / a) ** 2).sum(1).argmin())
                    if r2[i] <= radius**2:
                        cw[i], cm[i], cq[i] = cw[i] + a, cm[i] + b, cq[i] + c
                        continue
                cw.append(a)
                cm.append(b)
                cq.append(c)
                full = len(cw) > branching
                if full:
                    break
            if not full:
                return np.array(cw), np.array(cm), np.array(cq)
            radius *= 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[column].to_numpy())
                w, m, q = gather(np.ones(len(x)), x, (x**2).sum(1))
                yield pd.DataFrame({"w": w, "m": list(m), "q": q})

    got = features.select(column).mapInPandas(run, kind_sum).orderBy("w", F.col("m").cast("string")).collect()  # at most `branching` for each batch
    w, m, q = gather(np.array([r["w"] for r in got]), np.array([r["m"] for r in got]), np.array([r["q"] for r in got]))
    x, group, weight = m / w[:, None], np.arange(len(w)), w.copy()
    mean = x.copy()
    while len(set(group.tolist())) > k:
        live = sorted(set(group.tolist()))
        d = ((mean[live][:, None] - mean[live]) ** 2).sum(-1) * (weight[live][:, None] * weight[live] / (weight[live][:, None] + weight[live]))
        np.fill_diagonal(d, np.inf)
        i, j = (live[z] for z in np.unravel_index(int(d.argmin()), d.shape))
        mean[i] = (weight[i] * mean[i] + weight[j] * mean[j]) / (weight[i] + weight[j])
        weight[i] += weight[j]
        group[group == j] = i
    order = {g: n for n, g in enumerate(sorted(set(group.tolist())))}
    return _by_nearest(features, column, x, np.array([order[g] for g in group]))


def bayesian_gmm(features: DataFrame, k: int, dims: int, column: str = "s", max_iter: int = 60, tol: float = 1e-4, prior: float | None = None, seed: int = 0) -> DataFrame:
    """Variational mixture of normals of full covariance: a Dirichlet prior on weights and normal-Wishart ones on components, so that
    needless components lose their weight. Each round is one pass that sums responsibilities, first and second moments."""
    rows = features.select("window_id", F.col(column).alias("s")).cache()
    x = [F.col("s")[i] for i in range(dims)]
    r = rows.agg(F.count("*").alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(dims) for j in range(i, dims)]).first()
    m0 = np.array([r[f"m{i}"] for i in range(dims)])
    w0 = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(dims)] for i in range(dims)]) + 1e-6 * np.eye(dims)
    a0, b0, nu0 = prior or 1 / k, 1.0, float(dims)
    start = np.array(KMeans(k=k, seed=seed).fit(rows.select(array_to_vector("s").alias("features"))).clusterCenters())
    start = np.concatenate([start, np.tile(m0, (k - len(start), 1))]) if len(start) < k else start
    state = None

    def digamma(v: float) -> float:
        out = 0.0
        while v < 6:
            out -= 1 / v
            v += 1
        return out + math.log(v) - 1 / (2 * v) - 1 / (12 * v**2) + 1 / (120 * v**4)

    def log_resp(z: np.ndarray, state: tuple) -> np.ndarray:
        alpha, beta, nu, mean, scale = state
        out = np.empty((len(z), k))
        for j in range(k):
            inv = np.linalg.inv(scale[j])
            det = sum(digamma((nu[j] - i) / 2) for i in range(dims)) + dims * math.log(2) - np.linalg.slogdet(scale[j])[1]
            d = z - mean[j]
            out[:, j] = digamma(alpha[j]) - digamma(alpha.sum()) + 0.5 * det - 0.5 * (dims / beta[j] + nu[j] * np.einsum("wi,ij,wj->w", d, inv, d))
        return out

    last = None
    for _ in range(max_iter):
        def run(batches: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    z = np.stack(pdf["s"].to_numpy())
                    near = ((z[:, None] - start) ** 2).sum(-1).argmin(1)
                    p = _softmax(log_resp(z, state)) if state is not None else np.eye(k)[near]  # at first each to its nearest centre
                    yield pd.DataFrame({"k": range(k), "w": p.sum(0), "x": list(p.T @ z), "xx": [((z.T * p[:, j]) @ z).ravel() for j in range(k)]})

        def total(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(pdf["k"].iloc[0], pdf["w"].sum(), np.sum(list(pdf["x"]), 0), np.sum(list(pdf["xx"]), 0))], columns=["k", "w", "x", "xx"])

        kinds = "k int, w double, x array<double>, xx array<double>"
        got = sorted(rows.mapInPandas(run, kinds).groupBy("k").applyInPandas(total, kinds).collect(), key=lambda z: z["k"])
        n = np.maximum(np.array([g["w"] for g in got]), 1e-10)
        centre = np.array([g["x"] for g in got]) / n[:, None]
        alpha, beta, nu = a0 + n, b0 + n, nu0 + n
        mean = (b0 * m0 + n[:, None] * centre) / beta[:, None]
        scale = np.array([w0 + np.array(g["xx"]).reshape(dims, dims) - n[j] * np.outer(centre[j], centre[j]) + b0 * n[j] / (b0 + n[j]) * np.outer(centre[j] - m0, centre[j] - m0) for j, g in enumerate(got)])
        state = (alpha, beta, nu, mean, scale)
        if last is not None and np.abs(n - last).max() <= tol * r["n"]:
            break
        last = n

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = np.stack(pdf["s"].to_numpy()) if len(pdf) else np.zeros((0, dims))
            yield pd.DataFrame({"window_id": pdf["window_id"], "label": log_resp(z, state).argmax(1).astype("int32")})

    return rows.mapInPandas(label, f"window_id {dict(features.dtypes)['window_id']}, label int")


def geometry_baselines(features: DataFrame, k: int, dims: int, column: str = "s") -> dict[str, DataFrame]:
    """(window_id, label) by each of seven ways on standardised features."""
    z = standardise(features, dims, column).cache()
    return {
        "kmeans": kmeans(z, k, column=column), "fuzzy": fuzzy_cmeans(z, k, column=column)[1].select("window_id", "label"), "gmm": gmm(z, k, column=column),
        "bayesian_gmm": bayesian_gmm(z, k, dims, column), "birch": birch(z, k, column=column), "spectral": spectral(z, k, column=column), "ward": ward(z, k, column),
    }


def periodogram(samples: DataFrame, frequencies: list[float], x: str = "x", y: str = "y", key: str = "window_id") -> DataFrame:
    """(key, power): of each window at each frequency, the share of its centred sum of squares that a sine and cosine with a phase that
    makes them orthogonal explain; sums of all frequencies in one pass."""
    centred = samples.select(key, F.col(x).alias("_x"), (F.col(y) - F.avg(y).over(Window.partitionBy(key))).alias("_y"))
    sums = [F.sum(F.col("_y") * F.col("_y")).alias("yy")]
    for i, f in enumerate(frequencies):
        c, s = F.cos(F.col("_x") * f), F.sin(F.col("_x") * f)
        sums += [F.sum(F.col("_y") * c).alias(f"c{i}"), F.sum(F.col("_y") * s).alias(f"s{i}"), F.sum(c * c).alias(f"cc{i}"), F.sum(s * s).alias(f"ss{i}"), F.sum(c * s).alias(f"cs{i}")]
    agg, each = centred.groupBy(key).agg(*sums), []
    for i in range(len(frequencies)):
        c, s, cc, ss, cs = (F.col(f"{n}{i}") for n in ("c", "s", "cc", "ss", "cs"))
        tau = F.atan2(2 * cs, cc - ss) / 2
        a, b = c * F.cos(tau) + s * F.sin(tau), s * F.cos(tau) - c * F.sin(tau)
        aa = cc * F.pow(F.cos(tau), F.lit(2.0)) + 2 * cs * F.cos(tau) * F.sin(tau) + ss * F.pow(F.sin(tau), F.lit(2.0))
        bb = cc + ss - aa
        each.append((F.when(aa > 1e-12, a * a / aa).otherwise(0.0) + F.when(bb > 1e-12, b * b / bb).otherwise(0.0)) / F.greatest(F.col("yy"), F.lit(1e-300)))
    return agg.select(key, F.array(*each).alias("power"))


def periodogram_kmeans(samples: DataFrame, k: int, frequencies: list[float], peaks: bool = False, **kw) -> DataFrame:
    """K-means of periodograms, or of the frequency of their highest peak."""
    p = periodogram(samples, frequencies, **kw)
    if peaks:
        at = F.array_position("power", F.array_max("power")).cast("int")
        p = p.select("window_id", F.array(F.element_at(F.array(*[F.lit(float(f)) for f in frequencies]), at)).alias("power"))
    return kmeans(p, k, column="power")
