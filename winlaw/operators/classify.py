"""Classification of windows by laws, and plain classifiers on vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import LawFit, _rss, hard_loop, mechanism_start
from .stats import NATIVE_COLUMNS, pooled, rss, solve


def _sum_exp(z: Column, top: Column) -> Column:
    return F.aggregate(F.transform(z, lambda x: F.exp(x - top)), F.lit(0.0), lambda u, v: u + v)


@dataclass(frozen=True)
class LawClassifier:
    """For each class laws with weights; a noise and a prior for each class."""

    classes: list
    laws: list[LawFit]
    sigma: np.ndarray
    prior: np.ndarray

    @classmethod
    def fit(cls, stats: DataFrame, label: str, laws_per_class: int | str = 1, priors: str = "empirical", shared_sigma: bool = True, ridge: float = 1e-8) -> LawClassifier:
        """stats: window statistics with a column of classes (a few). laws_per_class "all": a law for each training window, which come to the driver."""
        groups = pooled(stats, label)
        classes = sorted(groups)
        fits, total, count = [], [], []
        for c in classes:
            n, g, a, yy, w = groups[c]
            if laws_per_class == "all":  # each training window's own law, of equal weight
                own = [(r["n"], np.array(r["g"]), np.array(r["a"]), r["yy"]) for r in stats.filter(F.col(label) == c).select("n", "g", "a", "yy").collect()]
                coef = np.array([solve(g.reshape(len(a_), -1), a_, max(ridge, 1e-6)) for _, g, a_, _ in own])
                fits.append(LawFit(coef, np.ones(len(coef)), np.full(len(coef), 1 / len(coef)), []))
                rss_ = sum(max(y2 - 2 * a_ @ v + v @ g.reshape(len(a_), -1) @ v, 0.0) for (_, g, a_, y2), v in zip(own, coef, strict=True))
                total.append(rss_)
                count.append(max(n - coef.size, 1.0))
                continue
            if laws_per_class == 1:
                v = solve(g, a, ridge)
                fits.append(LawFit(v[None], np.ones(1), np.ones(1), []))
                wrong = max(yy - 2 * a @ v + v @ g @ v, 0.0)
            else:
                own = stats.filter(F.col(label) == c)
                fit = hard_loop(own, mechanism_start(own, laws_per_class))
                fits.append(LawFit(fit.coef, fit.sigma, fit.weights, []))
                wrong = fit.history[-1]["cost"]
            total.append(wrong)
            count.append(n)
        sigma = np.sqrt(np.array(total) / np.array(count))
        if shared_sigma:
            sigma[:] = math.sqrt(sum(total) / sum(count))
        w = np.array([groups[c][4] for c in classes], float) if priors == "empirical" else np.ones(len(classes))
        return cls(classes, fits, np.maximum(sigma, 1e-9), w / w.sum())

    def loglik(self, pdf: pd.DataFrame) -> np.ndarray:
        """(W, classes): log-likelihood of each window under the mixture of each class."""
        n, out = pdf["n"].to_numpy(float), []
        for fit, s in zip(self.laws, self.sigma, strict=True):
            z = np.log(fit.weights) - _rss(pdf, fit.coef) / (2 * s * s) - (n * math.log(s) + n / 2 * math.log(2 * math.pi))[:, None]
            top = z.max(1, keepdims=True)
            out.append((top + np.log(np.exp(z - top).sum(1, keepdims=True)))[:, 0])
        return np.stack(out, 1)

    def scores(self) -> Column:
        """Array of the log-likelihoods and log-priors of the classes, as an expression of a window's statistics."""
        out = []
        for fit, s, prior in zip(self.laws, self.sigma, self.prior, strict=True):
            s = float(s)
            z = F.array(*[math.log(w) - rss(list(v)) / (2 * s * s) for v, w in zip(fit.coef, fit.weights, strict=True)])
            top = F.array_max(z)
            total = top + F.log(_sum_exp(z, top))
            out.append(total - F.col("n") * (math.log(s) + 0.5 * math.log(2 * math.pi)) + math.log(float(prior)))
        return F.array(*out)

    def predict_native(self, stats: DataFrame) -> DataFrame:
        """As predict(), in the JVM: laws are constants. For bases of up to NATIVE_COLUMNS."""
        rows = stats.withColumn("_z", self.scores())
        e = F.transform("_z", lambda v: F.exp(v - F.array_max("_z")))
        total = F.aggregate(e, F.lit(0.0), lambda u, v: u + v)
        names = F.array(*[F.lit(c) for c in self.classes])
        return rows.select("window_id", F.element_at(names, F.array_position("_z", F.array_max("_z")).cast("int")).alias("prediction"), F.transform(e, lambda v: v / total).alias("proba"))

    def predict(self, stats: DataFrame) -> DataFrame:
        """(window_id, prediction, proba)."""
        if self.laws[0].coef.shape[1] <= NATIVE_COLUMNS:
            return self.predict_native(stats)
        kinds = dict(stats.dtypes)
        classes, kind = self.classes, {int: "long", str: "string", float: "double"}[type(self.classes[0])]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                z = self.loglik(pdf) + np.log(self.prior) if len(pdf) else np.zeros((0, len(classes)))
                e = np.exp(z - z.max(1, keepdims=True)) if len(pdf) else z
                yield pd.DataFrame({"window_id": pdf["window_id"], "prediction": [classes[i] for i in z.argmax(1)], "proba": list(e / e.sum(1, keepdims=True)) if len(pdf) else []})

        return stats.select("window_id", "n", "g", "a", "yy").mapInPandas(run, f"window_id {kinds['window_id']}, prediction {kind}, proba array<double>")


def rss_over_shifts(stats_by_shift: DataFrame, laws: list[list[float]]) -> DataFrame:
    """(window_id, k, rss, tau): least rss over a grid of shifts; stats_by_shift has a row for each window and tau."""
    from .stats import law_rss

    each = law_rss(stats_by_shift, laws, ["window_id", "tau"])
    best = each.groupBy("window_id", "k").agg(F.min(F.struct("rss", "tau")).alias("m"))
    return best.select("window_id", "k", F.col("m.rss").alias("rss"), F.col("m.tau").alias("tau"))


def nearest_centroid(train: DataFrame, test: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """(key, prediction): the class of the nearest centroid, the least of equal ones. Centroids, one for each class, travel to the test rows."""
    size = train.select(F.max(F.size(vector))).first()[0]
    mean = train.groupBy(label).agg(F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(size)]).alias("m")).orderBy(label).collect()
    names, m = [r[0] for r in mean], np.array([r["m"] for r in mean])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf[vector].to_numpy()).astype(float) if len(pdf) else np.zeros((0, m.shape[1]))
            yield pd.DataFrame({key: pdf[key], "prediction": [names[i] for i in ((x[:, None] - m) ** 2).sum(-1).argmin(1)]})

    return test.select(key, vector).mapInPandas(run, f"{key} {dict(test.dtypes)[key]}, prediction {dict(train.dtypes)[label]}")


def one_nn(train: DataFrame, test: DataFrame, vector: str, label: str, key: str, block: int = 4096) -> DataFrame:
    """(key, prediction, distance) of the nearest training row (the least key of equal ones).

    Test rows are sent in blocks to every partition of the training rows, which answer with
    their nearest; so neither side is held whole in one task.
    """
    kinds = dict(train.dtypes)
    schema = f"{key} {dict(test.dtypes)[key]}, _d double, _k {kinds[key]}, _l {kinds[label]}"
    queries = [r for r in test.select(key, vector).collect()]  # a stated, bounded query set
    out = None
    for lo in range(0, max(len(queries), 1), block):
        some = queries[lo : lo + block]
        if not some:
            break
        ids, q = [r[0] for r in some], np.array([r[1] for r in some], float)

        def run(batches: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            best: list = [None] * len(ids)
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf[vector].to_numpy()).astype(float)
                d = np.maximum((q**2).sum(1)[:, None] - 2 * q @ x.T + (x**2).sum(1), 0)
                own = np.lexsort((np.broadcast_to(pdf[key].to_numpy(), d.shape), d))[:, 0] if len(pdf) else None
                for i, j in enumerate(own):
                    t = (float(d[i, j]), pdf[key].iloc[j], pdf[label].iloc[j])
                    best[i] = t if best[i] is None or t < best[i] else best[i]
            rows = [(i, *b) for i, b in zip(ids, best, strict=True) if b is not None]
            yield pd.DataFrame(rows, columns=[key, "_d", "_k", "_l"])

        part = train.select(key, vector, label).mapInPandas(run, schema)
        part = part.groupBy(key).agg(F.min(F.struct("_d", "_k", "_l")).alias("_m")).select(key, F.col("_m._l").alias("prediction"), F.sqrt("_m._d").alias("distance"))
        out = part if out is None else out.unionByName(part)
    return out


def standard_classifier(kind: str, train: DataFrame, vector: str, label: str, seed: int = 0):
    """logistic or forest, from Spark ML, on an array column."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    kinds = {"logistic": lambda: LogisticRegression(regParam=1e-3), "forest": lambda: RandomForestClassifier(seed=seed)}
    rows = train.select(array_to_vector(vector).alias("features"), F.col(label).cast("double").alias("label"))
    return kinds[kind]().fit(rows)


def few_shot(df: DataFrame, label: str, key: str, m: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """m rows of each class, the first by a hash of their keys, or by `order` and key."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(F.col(key), F.lit(seed)) if order is None else order, key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= m).drop("_r")


def balanced_error(df: DataFrame, truth: str, label: str) -> float:
    recall = df.groupBy(truth).agg(F.avg((F.col(truth) == F.col(label)).cast("double")).alias("r"))
    return 1 - float(recall.agg(F.avg("r")).first()[0])


def shifted_stats(samples: DataFrame, basis_at, shifts: list[float], y: str = "y", keys: list[str] | None = None) -> DataFrame:
    """Window statistics of every window under every shift of its first input, with the column tau. basis_at(tau) is the basis."""
    from .stats import window_stats

    out = None
    for tau in shifts:  # a scan each: the basis differs, the partitioning doesn't
        own = window_stats(samples, basis_at(tau), y, keys).withColumn("tau", F.lit(float(tau)))
        out = own if out is None else out.unionByName(own)
    return out


def align(stats_by_shift: DataFrame, label: str, rounds: int = 3, ridge: float = 1e-8) -> dict:
    """Laws of classes whose windows are shifted: each window takes the shift of least rss under its class's law, and laws are refitted."""
    ident = sorted(r[0] for r in stats_by_shift.select("tau").distinct().collect())
    middle = min(ident, key=abs)
    laws = {c: solve(v[1], v[2], ridge) for c, v in pooled(stats_by_shift.filter(F.col("tau") == middle), label).items()}
    for _ in range(rounds):
        names = list(laws)
        own = F.lit(None).cast("double")
        for c in names:
            own = F.when(F.col(label) == c, rss(list(laws[c]))).otherwise(own)
        w = Window.partitionBy("window_id").orderBy("_r", F.abs(F.col("tau")), "tau")
        best = stats_by_shift.withColumn("_r", own).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_r", "_k")
        laws = {c: solve(v[1], v[2], ridge) for c, v in pooled(best, label).items()}
    return laws


class LawStack:
    """Law classifiers' log-posteriors and log least rss, cross-fitted, into a logistic regression on scaled features."""

    def __init__(self, make=None, folds: int = 3, reg: tuple = (1e-3, 1e-2, 1e-1)):
        self.make, self.folds, self.reg = make or (lambda s, label: LawClassifier.fit(s, label)), folds, reg

    def _features(self, model: LawClassifier, stats: DataFrame) -> Column:
        laws = [list(v) for f in model.laws for v in f.coef]
        low = F.array_min(F.array(*[rss(v) for v in laws]))
        return F.concat(model.scores(), F.array(F.log(F.greatest(low / F.col("n"), F.lit(1e-300)))))

    def fit(self, stats: DataFrame, label: str, fold: Column | None = None) -> LawStack:
        from pyspark.ml.classification import LogisticRegression

        fold = F.pmod(F.xxhash64("window_id"), F.lit(self.folds)) if fold is None else fold
        rows, out = stats.withColumn("_f", fold), None
        for f in range(self.folds):
            model = self.make(rows.filter(F.col("_f") != f), label)
            own = rows.filter(F.col("_f") == f).select("window_id", F.col(label).alias("_label"), "_f", self._features(model, rows).alias("_x"))
            out = own if out is None else out.unionByName(own)
        out = out.cache()
        self.model = self.make(stats, label)
        self.classes = sorted(r[0] for r in out.select("_label").distinct().collect())
        d = len(out.first()["_x"])
        m = out.agg(*[F.avg(F.col("_x")[i]).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col("_x")[i]).alias(f"s{i}") for i in range(d)]).first()
        self.mean, self.sd = [float(m[f"m{i}"]) for i in range(d)], [max(float(m[f"s{i}"]), 1e-9) for i in range(d)]
        code = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col("_label")) - 1
        ready = out.select("_f", code.cast("double").alias("label"), self._scaled(F.col("_x")).alias("features")).cache()
        errors = {}
        for reg in self.reg:  # the folds choose the penalty
            wrong = 0
            for f in range(self.folds):
                got = LogisticRegression(regParam=reg).fit(ready.filter(F.col("_f") != f)).transform(ready.filter(F.col("_f") == f))
                wrong += got.filter("prediction <> label").count()
            errors[reg] = wrong
        self.chosen = min(errors, key=lambda r: (errors[r], -r))
        self.head = LogisticRegression(regParam=self.chosen).fit(ready)
        return self

    def _scaled(self, x: Column) -> Column:
        return array_to_vector(F.array(*[(x[i] - a) / s for i, (a, s) in enumerate(zip(self.mean, self.sd, strict=True))]))

    def predict(self, stats: DataFrame) -> DataFrame:
        got = self.head.transform(stats.select("window_id", self._scaled(self._features(self.model, stats)).alias("features")))
        return got.select("window_id", F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.col("prediction").cast("int") + 1).alias("prediction"))


def cross_validate(stats_of, sizes: list, laws: list, label: str, folds: int = 3, fold: Column | None = None) -> tuple[tuple, list[dict]]:
    """The (size, laws per class) of least error over folds, the simplest of equal ones. stats_of(size): statistics with classes."""
    fold = F.pmod(F.xxhash64("window_id"), F.lit(folds)) if fold is None else fold
    rows = []
    for size in sizes:
        stats = stats_of(size).withColumn("_f", fold).cache()
        for k in laws:
            wrong = total = 0
            for f in range(folds):
                test = stats.filter(F.col("_f") == f)
                got = LawClassifier.fit(stats.filter(F.col("_f") != f), label, k).predict(test).join(test.select("window_id", label), "window_id")
                r = got.agg(F.sum((F.col("prediction") != F.col(label)).cast("int")), F.count("*")).first()
                wrong, total = wrong + (r[0] or 0), total + r[1]
            rows.append({"size": size, "laws": k, "error": wrong / max(total, 1)})
    order = lambda r: (r["error"], r["size"], (r["laws"] == "all", 0 if r["laws"] == "all" else r["laws"]))
    best = min(rows, key=order)
    return (best["size"], best["laws"]), rows


def kernel_svm(train: DataFrame, vector: str, label: str, features: int = 200, seed: int = 0):
    """A radial support-vector classifier: random Fourier features of median bandwidth and linear machines, one against the rest.

    Returns a function of (test, key) that gives (key, prediction)."""
    from pyspark.ml.classification import LinearSVC, OneVsRest

    some = np.array([r[0] for r in train.select(vector).orderBy(F.xxhash64(F.col(vector).cast("string"))).limit(500).collect()], float)
    d = np.sqrt(((some[:, None] - some) ** 2).sum(-1))
    width = float(np.median(d[d > 0])) if (d > 0).any() else 1.0
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 1 / width, (some.shape[1], features)), rng.uniform(0, 2 * math.pi, features)

    def mapped(df: DataFrame, *keep: Column) -> DataFrame:
        names = df.select(*keep, F.col(vector).alias("_v"))
        kinds = ", ".join(f"{n} {k}" for n, k in names.dtypes if n != "_v")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = np.stack(pdf["_v"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, len(w)))
                yield pdf.drop(columns="_v").assign(_x=list(math.sqrt(2 / features) * np.cos(x @ w + b)))

        out = names.mapInPandas(run, f"{kinds}, _x array<double>")
        return out.withColumn("features", array_to_vector("_x")).drop("_x")

    model = OneVsRest(classifier=LinearSVC(regParam=1e-3, maxIter=50)).fit(mapped(train, F.col(label).cast("double").alias("label")))
    return lambda test, key: model.transform(mapped(test, F.col(key))).select(key, F.col("prediction").cast(dict(train.dtypes)[label]).alias("prediction"))


def transfer(features: DataFrame, groups: str, train_groups: list, label: str, vector: str, key: str, kind: str = "logistic") -> dict:
    """Balanced error on the groups that weren't trained on, whole and by terciles of a column `coverage` if there is one."""
    known = F.col(groups).isin(train_groups)
    model = standard_classifier(kind, features.filter(known), vector, label)
    test = features.filter(~known)
    got = model.transform(test.withColumn("features", array_to_vector(vector)).withColumnRenamed(label, "_truth")).withColumn("_p", F.col("prediction").cast(dict(test.dtypes)[label]))
    out = {"all": balanced_error(got, "_truth", "_p")}
    if "coverage" in test.columns:
        a, b = got.agg(F.percentile("coverage", F.array(F.lit(1 / 3), F.lit(2 / 3)))).first()[0]
        for i, part in enumerate((F.col("coverage") <= a, (F.col("coverage") > a) & (F.col("coverage") <= b), F.col("coverage") > b)):
            if (own := got.filter(part)).take(1):
                out[f"tercile_{i}"] = balanced_error(own, "_truth", "_p")
    return out
