"""Window statistics: one shuffle from samples to G = B'B, a = B'y, yy, n of each window, and what follows from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import Basis

#: Up to so many basis columns the sums are native; beyond, blocks of rows are multiplied in Arrow batches.
NATIVE_COLUMNS = 10
#: Among so many rows a quantile is looked up on the driver; more are narrowed down by histograms of so many bins.
FEW_ROWS, BINS = 50_000, 4096
#: Bits of a value that are summed as one integer; a group can have 2^33 rows.
LIMB = 30


def window_stats(samples: DataFrame, basis: Basis, y: str = "y", keys: list[str] | None = None) -> DataFrame:
    """keys, n, g (p * p, by rows), a (p), yy. Rows with a null in y or the basis are left out."""
    keys = keys or ["window_id"]
    p = len(basis)
    phi = samples.select(*keys, F.col(y).cast("double").alias("_y"), *(c.cast("double").alias(f"_b{i}") for i, (_, c) in enumerate(basis))).dropna()
    if p <= NATIVE_COLUMNS:
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        sums = [F.sum(F.col(f"_b{i}") * F.col(f"_b{j}")).alias(f"g{i}_{j}") for i, j in pairs]
        sums += [F.sum(F.col(f"_b{i}") * F.col("_y")).alias(f"a{i}") for i in range(p)]
        agg = phi.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("_y") * F.col("_y")).alias("yy"), *sums)
        g = F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])
        return agg.select(*keys, "n", g.alias("g"), F.array(*[F.col(f"a{i}") for i in range(p)]).alias("a"), "yy")
    kinds = {c: t for c, t in phi.dtypes}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, g array<double>, a array<double>, yy double"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, own in pdf.groupby(keys, sort=False):
                b, v = own[[f"_b{i}" for i in range(p)]].to_numpy(), own["_y"].to_numpy()
                rows.append((*key, len(own), (b.T @ b).ravel(), b.T @ v, float(v @ v)))
            yield pd.DataFrame(rows, columns=[*keys, "n", "g", "a", "yy"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*pdf.loc[0, keys], int(pdf["n"].sum()), np.sum(list(pdf["g"]), 0), np.sum(list(pdf["a"]), 0), pdf["yy"].sum())], columns=[*keys, "n", "g", "a", "yy"])

    return phi.mapInPandas(partial, schema).groupBy(*keys).applyInPandas(total, schema)


def exact_means(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, n and the mean of each column, which depends on the group's values alone, not on the order of rows or partitions: a
    double is cut into integers of LIMB bits, as many as the column's range needs, and their sums are exact. Nulls, NaN and infinities as in avg."""
    kinds = dict(df.dtypes)
    floats = [c for c in columns if kinds[c] in ("double", "float")]
    x = {c: F.col(c).cast("double") for c in floats}
    finite = {c: F.abs(x[c]) < math.inf for c in floats}
    ends = df.agg(*[v.alias(f"{name}{c}") for c in floats for name, v in (("lo", F.min(F.when(finite[c] & (x[c] != 0), F.abs(x[c])))), ("hi", F.max(F.when(finite[c], F.abs(x[c])))), ("odd", F.count_if(~finite[c])))]).first() if floats else None
    rows = df.select(*by, *[F.col(c) for c in columns if c not in floats], *[x[c].alias(c) for c in floats])
    aggs, means = [F.count("*").alias("n")], {c: F.col(f"_{c}") for c in columns}
    for i, c in enumerate(columns):
        if c not in floats:
            aggs.append(F.avg(c).alias(f"_{c}"))
            continue
        lo, hi, odd = (ends[f"{name}{c}"] for name in ("lo", "hi", "odd"))
        v = F.when(finite[c], F.col(c)) if odd else F.col(c)
        low = 0 if lo is None else max(math.frexp(lo)[1] - 53, -1074)  # the place of the last bit
        count = 0 if lo is None else -(-(math.frexp(hi)[1] - low) // LIMB)
        for k in range(count):
            rest, unit = v, low + LIMB * (k + 1)
            if k < count - 1:  # what the higher limbs leave; a value of 53 bits above the unit is a multiple of it
                rest = v - F.rint(v / math.ldexp(1.0, unit)) * math.ldexp(1.0, unit)
                rest = F.when(F.abs(v) < math.ldexp(1.0, unit + 53), rest).otherwise(v * 0.0) if unit + 53 < math.frexp(hi)[1] else rest
            aggs.append(F.coalesce(F.sum(F.rint(rest / math.ldexp(1.0, low + LIMB * k)).cast("long")), F.lit(0)).alias(f"_s{i}_{k}"))
        aggs += [F.count(c).alias(f"_n{i}"), (F.sum(F.when(~finite[c], F.col(c))) if odd else F.lit(None).cast("double")).alias(f"_x{i}")]
        total, carry = F.lit(0.0), F.lit(0)
        parts = []
        for k in range(count):  # every limb but the highest from 0 to 2^LIMB - 1
            own = F.col(f"_s{i}_{k}") + carry
            parts.append(own if k == count - 1 else own.bitwiseAND(F.lit(2**LIMB - 1)))
            carry = F.shiftright(own, LIMB)
        for k in reversed(range(count)):
            total = total + parts[k].cast("double") * math.ldexp(1.0, low + LIMB * k)
        means[c] = F.when(F.col(f"_n{i}") > 0, F.coalesce(F.col(f"_x{i}"), total) / F.col(f"_n{i}"))
    return rows.groupBy(*by).agg(*aggs).select(*by, "n", *[means[c].alias(c) for c in columns])


def _bin(x: Column, lo: float, hi: float) -> Column:
    """0 to BINS from lo to hi, in the order of x; infinities and NaN have bins of their own."""
    c = 1.0 if math.isfinite(hi - lo) else 0.25  # so that differences are finite
    inside = F.floor((x * c - lo * c) / (hi * c - lo * c) * BINS).cast("int") if hi > lo else F.lit(0)
    return F.when(F.isnan(x), BINS + 2).when(x == math.inf, BINS + 1).when(x == -math.inf, -1).otherwise(inside)


def quantile(df: DataFrame, value: Column, p: float) -> float | None:
    """The exact quantile of all rows, as `percentile` has it (nulls left out, NaN greatest), without a table of all distinct values
    in one task: rows are counted by bins, and again in the bin of the wanted rank, until it has few. None without rows."""
    x = F.col("_v")
    part = df.select(value.cast("double").alias("_v")).filter("_v IS NOT NULL")
    finite = F.when(F.abs(x) < math.inf, x)
    n, lo, hi = part.agg(F.count("*"), F.min(finite), F.max(finite)).first()
    if not n:
        return None
    at = (n - 1) * p
    first, last, before = math.floor(at), math.ceil(at), 0
    lo, hi = (0.0, 0.0) if lo is None else (lo, hi)
    while True:
        bins = part.groupBy(_bin(x, lo, hi).alias("k")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect()  # BINS and a few
        for b in sorted(bins, key=lambda b: b["k"]):
            if first < before + b["n"]:
                break
            before += b["n"]
        if last >= before + b["n"]:  # the ranks are side by side, in two bins
            low, high = b["hi"], min((c for c in bins if c["k"] > b["k"]), key=lambda c: c["k"])["lo"]
        elif b["lo"] == b["hi"] or math.isnan(b["lo"]):
            low = high = b["lo"]
        else:
            part, lo, hi = part.filter((x >= b["lo"]) & (x <= b["hi"])), b["lo"], b["hi"]
            if b["n"] > FEW_ROWS:
                continue
            own = sorted(r["_v"] for r in part.collect())
            low, high = own[first - before], own[last - before]
        return low if low == high or first == last else (last - at) * low + (at - first) * high


def profile_level(stats: DataFrame, p: int) -> DataFrame:
    """Statistics with a free level of each window taken out; column 0 of the basis is the constant."""
    g = lambda i, j: F.col("g")[i * p + j]
    n = F.col("n").cast("double")
    new_g = F.array(*[g(i, j) - g(0, i) * g(0, j) / n for i in range(1, p) for j in range(1, p)])
    new_a = F.array(*[F.col("a")[i] - g(0, i) * F.col("a")[0] / n for i in range(1, p)])
    rest = [c for c in stats.columns if c not in ("n", "g", "a", "yy")]
    return stats.select(*rest, (F.col("n") - 1).alias("n"), new_g.alias("g"), new_a.alias("a"), (F.col("yy") - F.col("a")[0] * F.col("a")[0] / n).alias("yy"))


def quadratic_form(g: Column, v: list[float]) -> Column:
    p = len(v)
    return sum((g[i * p + j] * float(v[i] * v[j] * (1 if i == j else 2)) for i in range(p) for j in range(i, p)), F.lit(0.0))


def rss(v: list[float]) -> Column:
    """yy - 2 a.v + v'Gv of the statistics at hand, not below zero."""
    dot = sum((F.col("a")[i] * float(x) for i, x in enumerate(v)), F.lit(0.0))
    return F.greatest(F.col("yy") - 2 * dot + quadratic_form(F.col("g"), v), F.lit(0.0))


def law_rss(stats: DataFrame, laws: list[list[float]], keep: list[str] | None = None) -> DataFrame:
    """(window, k, rss, n) of every window under every law; laws are literals, so nothing is shuffled."""
    keep = keep or ["window_id"]
    each = F.array(*[F.struct(F.lit(k).alias("k"), rss(v).alias("rss")) for k, v in enumerate(laws)])
    return stats.select(*keep, "n", F.inline(each))


def nearest_law(stats: DataFrame, laws: list[list[float]], keep: list[str] | None = None) -> DataFrame:
    """(window, label, rss): the law of least rss, the lowest of equal ones."""
    each = F.array_min(F.array(*[F.struct(rss(v).alias("rss"), F.lit(k).alias("k")) for k, v in enumerate(laws)]))
    best = stats.select(*(keep or ["window_id"]), each.alias("_m"))
    return best.select("*", F.col("_m.k").alias("label"), F.col("_m.rss").alias("rss")).drop("_m")


def pooled(stats: DataFrame, by: str | None = None) -> dict:
    """Sums of the statistics by a column (a few values): {value: (n, G, a, yy, windows)}. Partials are summed per batch first."""
    key = F.lit(0).alias("_k") if by is None else F.col(by).alias("_k")
    kind = "int" if by is None else dict(stats.dtypes)[by]
    rows = stats.select(key, "n", "g", "a", "yy")
    schema = f"_k {kind}, n double, g array<double>, a array<double>, yy double, w long"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, float(o["n"].sum()), np.sum(list(o["g"]), 0), np.sum(list(o["a"]), 0), float(o["yy"].sum()), len(o)) for k, o in pdf.groupby("_k", sort=False)], columns=["_k", "n", "g", "a", "yy", "w"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["_k"][0], pdf["n"].sum(), np.sum(list(pdf["g"]), 0), np.sum(list(pdf["a"]), 0), pdf["yy"].sum(), int(pdf["w"].sum()))], columns=["_k", "n", "g", "a", "yy", "w"])

    out = {}
    for r in rows.mapInPandas(partial, schema).groupBy("_k").applyInPandas(total, schema).collect():
        a = np.array(r["a"])
        out[r["_k"]] = (r["n"], np.array(r["g"]).reshape(len(a), -1), a, r["yy"], r["w"])
    return out


def solve(g: np.ndarray, a: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Least squares from statistics: of least norm, on columns scaled to one; a ridge is a share of the mean diagonal."""
    if ridge:
        return np.linalg.solve(g + ridge * np.trace(g) / len(g) * np.eye(len(g)), a)
    d = np.sqrt(np.maximum(np.diag(g), 1e-300))
    return np.linalg.pinv(g / np.outer(d, d), rcond=1e-10, hermitian=True) @ (a / d) / d


def mechanism_features(stats: DataFrame, ridge: float = 1e-6, group: str | None = None, center: bool = True) -> tuple[DataFrame, np.ndarray]:
    """(window_id, s array): s = M'(a - G b), b the pooled law (of the window's group), M whitening the mean G; and M."""
    groups = pooled(stats, group)
    windows = sum(v[4] for v in groups.values())
    mean_g = sum(v[1] for v in groups.values()) / windows
    lam, vec = np.linalg.eigh(mean_g)
    keep = lam > ridge * lam.max()
    m = vec[:, keep] / np.sqrt(lam[keep])
    laws = {k: solve(v[1], v[2]) for k, v in groups.items()}
    means = {k: m.T @ (v[2] - v[1] @ laws[k]) / v[4] if center else np.zeros(m.shape[1]) for k, v in groups.items()}
    first = next(iter(laws))
    cols = ["window_id", *([group] if group else []), "g", "a"]
    p = len(m)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = [m.T @ (np.asarray(a) - np.asarray(g).reshape(p, p) @ laws[k]) - means[k] for a, g, k in zip(pdf["a"], pdf["g"], pdf[group] if group else [first] * len(pdf), strict=True)]
            yield pd.DataFrame({"window_id": pdf["window_id"], "s": s})

    return stats.select(*cols).mapInPandas(run, f"window_id {dict(stats.dtypes)['window_id']}, s array<double>"), m


def mechanism_noise(stats: DataFrame) -> float:
    """sigma from each window's own full fit, with max(n - p, 1) degrees of freedom."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total = dof = 0.0
            for n, g, a, yy in zip(pdf["n"], pdf["g"], pdf["a"], pdf["yy"], strict=True):
                a = np.asarray(a)
                v = solve(np.asarray(g).reshape(len(a), -1), a)
                total += max(yy - a @ v, 0.0)
                dof += max(n - len(a), 1)
            yield pd.DataFrame({"t": [total], "d": [dof]})

    r = stats.select("n", "g", "a", "yy").mapInPandas(run, "t double, d double").agg(F.sum("t").alias("t"), F.sum("d").alias("d")).first()
    return float(np.sqrt(r["t"] / r["d"]))


def inliers(features: DataFrame, dims: int, trim: float = 0.01) -> DataFrame:
    """Windows within the (1 - trim) quantile of distance from the coordinatewise median."""
    mid = features.agg(*[F.percentile(F.col("s")[i], F.lit(0.5)).alias(f"m{i}") for i in range(dims)]).first()
    r = F.sqrt(sum((F.pow(F.col("s")[i] - float(mid[i]), F.lit(2.0)) for i in range(dims)), F.lit(0.0)))
    far = features.withColumn("_r", r)
    edge = far.agg(F.percentile("_r", F.lit(1 - trim))).first()[0]
    return far.filter(F.col("_r") <= edge).drop("_r")


def separation_matrix(features: DataFrame, labels: DataFrame, dims: int, sigma: float) -> DataFrame:
    """(j, k, distance): between class centres in units of sigma, less what the centres' own noise adds."""
    rows = features.join(labels, "window_id")
    moments = rows.groupBy("label").agg(F.count("*").alias("w"), *[F.avg(F.col("s")[i]).alias(f"c{i}") for i in range(dims)], *[F.var_samp(F.col("s")[i]).alias(f"v{i}") for i in range(dims)])
    moments = moments.withColumn("t", sum((F.coalesce(f"v{i}", F.lit(0.0)) for i in range(dims)), F.lit(0.0)) / F.col("w"))
    x, y = moments.alias("x"), moments.alias("y")
    d2 = sum((F.pow(F.col(f"x.c{i}") - F.col(f"y.c{i}"), F.lit(2.0)) for i in range(dims)), F.lit(0.0)) - F.col("x.t") - F.col("y.t")
    return x.join(F.broadcast(y), F.col("x.label") < F.col("y.label")).select(F.col("x.label").alias("j"), F.col("y.label").alias("k"), (F.sqrt(F.greatest(d2, F.lit(0.0))) / sigma).alias("distance"))


def profile(stats: DataFrame, p: int, nuisance: list[int]) -> DataFrame:
    """Statistics with free coefficients of the `nuisance` columns of the basis taken out of each window, by the Schur complement.

    Windows with too few samples for them, or whose nuisance columns are dependent, lose what these can explain."""
    q = list(nuisance)
    rest = [i for i in range(p) if i not in q]
    if q == [0]:
        return profile_level(stats, p)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.copy()
            gs, as_, ys, ns = [], [], [], []
            for n, g, a, yy in zip(pdf["n"], pdf["g"], pdf["a"], pdf["yy"], strict=True):
                g, a = np.asarray(g).reshape(p, p), np.asarray(a)
                inv = np.linalg.pinv(g[np.ix_(q, q)], rcond=1e-10, hermitian=True)
                cross = g[np.ix_(rest, q)]
                gs.append((g[np.ix_(rest, rest)] - cross @ inv @ cross.T).ravel())
                as_.append(a[rest] - cross @ inv @ a[q])
                ys.append(max(yy - a[q] @ inv @ a[q], 0.0))
                ns.append(max(int(n) - len(q), 0))
            out["g"], out["a"], out["yy"], out["n"] = gs, as_, ys, ns
            yield out

    return stats.mapInPandas(run, ", ".join(kinds))


class FeatureMap:
    """Mechanism features learned on training windows and applied to others: "project" scales by sqrt(mean n / n), "solve" by the
    window's own Gram matrix with a ridge of its trace; less the training mean."""

    def __init__(self, mode: str = "project", tol: float = 1e-6, solve_ridge: float = 1e-3, subtract_pooled: bool = True):
        if mode not in ("project", "solve"):
            raise ValueError(f"the mode is project or solve, not {mode!r}")
        self.mode, self.tol, self.solve_ridge, self.subtract_pooled = mode, tol, solve_ridge, subtract_pooled
        self.mean = None

    def fit(self, stats: DataFrame) -> FeatureMap:
        n, g, a, _, w = pooled(stats)[0]
        lam, vec = np.linalg.eigh(g / w)
        keep = lam > self.tol * lam.max()
        self.m, self.length = vec[:, keep] / np.sqrt(lam[keep]), n / w
        self.law = solve(g, a) if self.subtract_pooled else np.zeros(len(a))
        self.mean = np.zeros(self.m.shape[1])
        rows = self.transform(stats)
        self.mean = np.array(rows.agg(*[F.avg(F.col("s")[i]) for i in range(self.m.shape[1])]).first())
        return self

    def transform(self, stats: DataFrame) -> DataFrame:
        """(window_id, s)"""
        m, law, mean, length, mode, ridge = self.m, self.law, self.mean, self.length, self.mode, self.solve_ridge

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for n, g, a in zip(pdf["n"], pdf["g"], pdf["a"], strict=True):
                    a = np.asarray(a)
                    g = np.asarray(g).reshape(len(a), -1)
                    r = m.T @ (a - g @ law)
                    if mode == "project":
                        v = r * np.sqrt(length / max(n, 1))
                    else:
                        c = m.T @ g @ m
                        v = np.linalg.solve(c + ridge * np.trace(c) / len(c) * np.eye(len(c)) + 1e-300, r) * np.sqrt(length)
                    out.append(v - mean)
                yield pd.DataFrame({"window_id": pdf["window_id"], "s": out})

        return stats.select("window_id", "n", "g", "a").mapInPandas(run, f"window_id {dict(stats.dtypes)['window_id']}, s array<double>")


def separation_unlabelled(features: DataFrame, dims: int, sigma: float, n: float, share: float | None = None, trim: float = 0.01) -> dict:
    """rho without labels: max(trace of the covariance - dims sigma^2, 0) / (share (1 - share) n sigma^2), on the inner windows. A share
    that isn't known is that of windows above the mean along the first principal direction."""
    inner = inliers(features, dims, trim) if trim else features
    x = [F.col("s")[i] for i in range(dims)]
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    r = inner.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(dims)] for i in range(dims)])
    first = np.linalg.eigh(cov)[1][:, -1]
    if share is None:
        along = sum(((x[i] - float(r[f"m{i}"])) * float(first[i]) for i in range(dims)), F.lit(0.0))
        share = min(max(inner.agg(F.avg((along > 0).cast("double"))).first()[0], 0.05), 0.95)
    signal = max(float(np.trace(cov)) - dims * sigma**2, 0.0)
    return {"rho": signal / (share * (1 - share) * n * sigma**2), "share": share, "trace": float(np.trace(cov)), "direction": first}


def rho_of_partition(features: DataFrame, labels: DataFrame, dims: int, sigma: float, n: float) -> float:
    """Least squared distance of the centres of a partition, in units of sigma, by window length."""
    d = separation_matrix(features, labels, dims, sigma).agg(F.min("distance")).first()[0]
    return float(d) ** 2 / n


def window_kernel(features: DataFrame, kind: str = "linear", gamma: float | None = None, key: str = "window_id") -> DataFrame:
    """(i, j, value) for i <= j: inner products of features, or exp(-gamma d^2); gamma is one over the median squared distance
    unless given. All pairs: for a stated, small set of windows."""
    a, b = features.select(F.col(key).alias("i"), F.col("s").alias("x")), features.select(F.col(key).alias("j"), F.col("s").alias("y"))
    pairs = a.join(b, F.col("i") <= F.col("j"))
    if kind == "linear":
        return pairs.select("i", "j", F.aggregate(F.zip_with("x", "y", lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v).alias("value"))
    d2 = F.aggregate(F.zip_with("x", "y", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda t, v: t + v)
    far = pairs.select("i", "j", d2.alias("d2"))
    if gamma is None:
        gamma = 1 / max(far.filter("i < j").agg(F.percentile("d2", F.lit(0.5))).first()[0] or 1.0, 1e-300)
    return far.select("i", "j", F.exp(-gamma * F.col("d2")).alias("value"))
