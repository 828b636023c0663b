"""Agreement of partitions, regression errors, rank correlation and calibration."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(df: DataFrame, truth: str, label: str) -> DataFrame:
    return df.groupBy(truth, label).agg(F.count("*").alias("n"))


def _table(df: DataFrame, truth: str, label: str) -> np.ndarray:
    rows = contingency(df, truth, label).collect()  # classes x clusters
    t, p = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    out = np.zeros((len(t), len(p)))
    for r in rows:
        out[t.index(r[0]), p.index(r[1])] = r["n"]
    return out


def mapping(table: np.ndarray) -> list[int]:
    """For each row the column of an assignment of greatest sum, by dynamic programming over subsets of columns."""
    n, m = table.shape
    size = max(n, m)
    wide = np.zeros((size, size))
    wide[:n, :m] = table
    if size <= 6:
        return list(max(permutations(range(size)), key=lambda p: sum(wide[i, j] for i, j in enumerate(p))))[:n]
    best = {0: (0.0, ())}
    for i in range(size):
        new: dict = {}
        for mask, (v, path) in best.items():
            for j in range(size):
                if not mask >> j & 1:
                    x = v + wide[i, j]
                    key = mask | 1 << j
                    if key not in new or x > new[key][0]:
                        new[key] = (x, (*path, j))
        best = new
    return list(best[(1 << size) - 1][1])[:n]


def aligned_accuracy(df: DataFrame, truth: str, label: str) -> float:
    t = _table(df, truth, label)
    return float(sum(t[i, j] for i, j in enumerate(mapping(t)) if j < t.shape[1]) / t.sum())


def clustering_metrics(df: DataFrame, truth: str, label: str) -> dict:
    """ari, nmi (arithmetic mean) and aligned accuracy."""
    t = _table(df, truth, label)
    n, a, b = t.sum(), t.sum(1), t.sum(0)
    pairs = lambda x: float((x * (x - 1) / 2).sum())
    expected = pairs(a) * pairs(b) / max(n * (n - 1) / 2, 1)
    most = (pairs(a) + pairs(b)) / 2
    p = t[t > 0] / n
    h = lambda x: float(-(x[x > 0] / n * np.log(x[x > 0] / n)).sum())
    mutual = float((p * np.log(p)).sum()) + h(a) + h(b)
    mean = (h(a) + h(b)) / 2
    return {"ari": (pairs(t) - expected) / (most - expected) if most != expected else 1.0, "nmi": mutual / mean if mean > 0 else 1.0, "aligned_accuracy": float(sum(t[i, j] for i, j in enumerate(mapping(t)) if j < t.shape[1]) / n)}


def regression_metrics(df: DataFrame, y: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    r = F.col(y) - F.col(prediction)
    return df.groupBy(*(by or [])).agg(F.avg(r * r).alias("mse"), F.avg(F.abs(r)).alias("mae"), (F.avg(r * r) / F.var_pop(y)).alias("nmse"))


def majority_map(df: DataFrame, label: str, reference: str) -> DataFrame:
    """(label, reference): the most frequent reference of each label; the least of equal ones."""
    n = contingency(df, label, reference)
    w = Window.partitionBy(label).orderBy(F.desc("n"), F.asc(reference))
    return n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(label, reference)


def binary_metrics(df: DataFrame, truth: str, label: str) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(label) == 1
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    s = df.agg(one(t & p).alias("tp"), one(~t & p).alias("fp"), one(t & ~p).alias("fn"), one(~t & ~p).alias("tn"))
    root = F.sqrt((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    mcc = F.when(root > 0, (F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn")) / root).otherwise(0.0)
    return s.select("*", ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"), mcc.alias("mcc"))


def spearman(df: DataFrame, x: str, y: str) -> float:
    """Correlation of ranks, ties at their mean. Ranks are running sums of value counts: within ranges of values, and of the ranges."""
    ranked = df.select(x, y)
    for c in (x, y):
        counts = ranked.groupBy(c).agg(F.count("*").alias("_n"))
        parts = counts.repartitionByRange(c).withColumn("_p", F.spark_partition_id()).cache()  # one range partitioning, read twice
        sizes = {r["_p"]: r["s"] for r in parts.groupBy("_p").agg(F.sum("_n").alias("s")).collect()}
        before, total = [], 0
        for p in sorted(sizes):
            before.append((p, total))
            total += sizes[p]
        start = df.sparkSession.createDataFrame(before or [(0, 0)], "_p int, _s long")
        running = parts.join(F.broadcast(start), "_p").withColumn("_c", F.col("_s") + F.sum("_n").over(Window.partitionBy("_p").orderBy(c)))
        ranked = ranked.join(running.select(c, (F.col("_c") - (F.col("_n") - 1) / 2).alias(f"_r_{c}")), c)
    return float(ranked.agg(F.corr(f"_r_{x}", f"_r_{y}")).first()[0])


def calibration(df: DataFrame, predicted: str, observed: str, edges: list[float]) -> DataFrame:
    """Mean prediction and outcome in right-closed bins."""
    b = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        b = F.when((F.col(predicted) > edges[i]) & (F.col(predicted) <= edges[i + 1]), i).otherwise(b)
    return df.withColumn("bin", b).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.avg(predicted).alias("predicted"), F.avg(observed).alias("observed"))


def bootstrap_ci(values: np.ndarray, stat=np.mean, reps: int = 2000, level: float = 0.95, seed: int = 0) -> tuple[float, float]:
    """Percentile interval over resampled units, which are few."""
    rng, v = np.random.default_rng(seed), np.asarray(values)
    got = [stat(v[rng.integers(0, len(v), len(v))]) for _ in range(reps)]
    return float(np.quantile(got, (1 - level) / 2)), float(np.quantile(got, (1 + level) / 2))


def matched_error(df: DataFrame, truth: str, label: str) -> float:
    """Share of rows whose label isn't the one matched with their truth; a label of -1 is always an error."""
    known = df.filter(F.col(label) >= 0)
    total = df.count()
    if not total or not known.take(1):
        return 1.0 if total else 0.0
    t = _table(known, truth, label)
    return 1 - float(sum(t[i, j] for i, j in enumerate(mapping(t)) if j < t.shape[1])) / total


def law_errors(grid: DataFrame, found: list, true: list) -> list[dict]:
    """For each pair of a found law and its truth (Columns of a grid of inputs): root mean square error, and as a share of the least gap
    between truths."""
    gaps = [F.sqrt(F.avg(F.pow(a - b, F.lit(2.0)))) for i, a in enumerate(true) for b in true[i + 1 :]]
    errors = [F.sqrt(F.avg(F.pow(f - t, F.lit(2.0)))) for f, t in zip(found, true, strict=True)]
    r = list(grid.agg(*errors, *gaps).first())
    gap = min(r[len(errors) :], default=1.0) or 1.0
    return [{"law": i, "rms": float(e), "relative": float(e / gap)} for i, e in enumerate(r[: len(errors)])]


def rolling_accuracy(df: DataFrame, truth: str, label: str, order: str, rows: int = 30, least: int = 10, by: list[str] | None = None) -> DataFrame:
    """df with `accuracy`: the share that agrees among the last rows, null while there are fewer than `least`. Without `by`, a
    series is one task's."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumn("accuracy", F.when(F.count("*").over(w) >= least, F.avg((F.col(truth) == F.col(label)).cast("double")).over(w)))


def ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """df with min_rank (ties take the first place) and share_rank, the mean place of equal values over the number of rows."""
    w = Window.partitionBy(*by)
    first = F.rank().over(w.orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return df.withColumn("min_rank", first).withColumn("share_rank", (first + (ties - 1) / 2) / F.count("*").over(w))


def top_k(df: DataFrame, value: str, k: int, by: list[str] | None = None, key: str | None = None) -> DataFrame:
    """The k rows of greatest value, of each group if asked; the least key of equal ones."""
    tie = [F.asc(key)] if key else []
    if not by:
        return df.orderBy(F.desc(value), *tie).limit(k)
    w = Window.partitionBy(*by).orderBy(F.desc(value), *tie)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def quantile_buckets(df: DataFrame, value: str, buckets: int = 3) -> DataFrame:
    """df with `bucket`: by exact quantiles of all rows, right-closed."""
    probes = [i / buckets for i in range(1, buckets)]
    edges = df.agg(F.percentile(value, F.array(*[F.lit(p) for p in probes]))).first()[0]
    b = F.lit(buckets - 1)
    for i, e in reversed(list(enumerate(edges))):
        b = F.when(F.col(value) <= float(e), i).otherwise(b)
    return df.withColumn("bucket", b)


def oriented(df: DataFrame, truth: str, label: str) -> DataFrame:
    """df with 0/1 labels turned round where that agrees with the truth more often."""
    r = df.agg(F.avg((F.col(truth) == F.col(label)).cast("double"))).first()[0]
    return df if r is None or r >= 0.5 else df.withColumn(label, 1 - F.col(label))
