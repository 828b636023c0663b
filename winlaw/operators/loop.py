"""The alternating loop with all its costs: give each window to a law, refit, repeat.

A window is one row: its statistics, its geometry features z and a hook's physics costs. A round's
labels are an expression of that row with the round's laws, centres and scales as constants; sums by
law are native. Labels are kept between rounds, for changes, folds and repair.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import Basis, predict
from . import costs
from .stats import rss, solve


@dataclass(frozen=True)
class Slot:
    """What is known of a law: nothing, its coefficients ("known"), or a part of it, to which the given columns are fitted ("partial")."""

    kind: str = "free"
    coef: tuple = ()
    columns: tuple = ()

    def __post_init__(self):
        if self.kind not in ("free", "known", "partial"):
            raise ValueError(f"a slot is free, known or partial, not {self.kind!r}")
        if self.kind != "free" and not len(self.coef):
            raise ValueError("a known or partial slot needs coefficients")

    def fit(self, g: np.ndarray, a: np.ndarray, ridge: float) -> np.ndarray:
        if self.kind == "free":
            return solve(g, a, ridge)
        v = np.array(self.coef, float)
        if self.kind == "partial":
            c = list(self.columns)
            v[c] += solve(g[np.ix_(c, c)], (a - g @ v)[c], ridge)
        return v


@dataclass(frozen=True)
class LoopSpec:
    """k laws. alpha: weight of geometry; beta: of complexity; lam: of physics. loss: of scaled residuals; all but "squared" read the
    samples. geometry: "euclidean" or "density". folds: of a law for its own windows' scores, 0 for none. min_windows: of a
    law; fewer are filled up with the windows that lose least. order: a column by whose mean laws are numbered.
    superpose: composites of two other laws that may replace a law, and margin, the relative gain in cost they need."""

    k: int
    alpha: float = 0.25
    beta: float = 0.0
    lam: float = 0.0
    loss: str = "squared"
    geometry: str = "euclidean"
    folds: int = 0
    min_windows: int = 3
    max_iter: int = 10
    tol: float = 0.01
    ridge: float = 1e-8
    order: str | None = None
    superpose: int = 0
    margin: float = 0.0
    slots: tuple = ()

    def slot(self, k: int) -> Slot:
        return self.slots[k] if k < len(self.slots) else Slot()


@dataclass(frozen=True)
class State:
    """Laws (K, p), their fits without each fold (K, folds, p), centres, covariances, residual scale."""

    coef: np.ndarray
    without: np.ndarray | None
    centres: np.ndarray | None
    covs: list | None
    scale: float
    history: list = field(default_factory=list)


def _sums(windows: DataFrame, by: list[str], p: int) -> dict:
    """{key: (windows, n, G, a, yy)}, summed natively."""
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    agg = windows.groupBy(*by).agg(F.count("*").alias("w"), F.sum("n").alias("n"), F.sum("yy").alias("yy"), *[F.sum(F.col("g")[i * p + j]).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(F.col("a")[i]).alias(f"a{i}") for i in range(p)])
    out = {}
    for r in agg.collect():  # a row for each law and fold
        g = np.zeros((p, p))
        for i, j in pairs:
            g[i, j] = g[j, i] = r[f"g{i}_{j}"]
        out[tuple(r[b] for b in by) if len(by) > 1 else r[by[0]]] = (r["w"], float(r["n"]), g, np.array([r[f"a{i}"] for i in range(p)]), r["yy"])
    return out


def _fold(spec: LoopSpec) -> Column:
    return F.pmod(F.xxhash64("window_id"), F.lit(spec.folds)).cast("int")


def refit(windows: DataFrame, spec: LoopSpec, p: int, d: int, before: State | None = None, samples: DataFrame | None = None, basis: Basis | None = None, y: str = "y", fold: Column | None = None) -> State:
    """State of windows with a column `label`: laws, their folds, centres and covariances, and the shared scale.

    A law without windows keeps what it was. The scale is the median absolute deviation of the assigned residuals where there are
    samples, else their root mean square. With samples the windows are kept while they are read: their size is then known to the join."""
    level = windows.storageLevel
    if samples is None or level.useMemory or level.useDisk:
        return _refit(windows, spec, p, d, before, samples, basis, y, fold)
    try:
        return _refit(windows.persist(), spec, p, d, before, samples, basis, y, fold)
    finally:
        windows.unpersist()


def _refit(windows: DataFrame, spec: LoopSpec, p: int, d: int, before: State | None, samples: DataFrame | None, basis: Basis | None, y: str, fold: Column | None) -> State:
    folded = windows.withColumn("_f", (fold if fold is not None else _fold(spec)) if spec.folds else F.lit(0))
    parts = _sums(folded, ["label", "_f"], p)
    zero = (0, 0.0, np.zeros((p, p)), np.zeros(p), 0.0)
    add = lambda x, z: tuple(a + b for a, b in zip(x, z, strict=True))
    coef, without, count, wrong, n = [], [], [], 0.0, 0.0
    for k in range(spec.k):
        own = [parts.get((k, f), zero) for f in range(max(spec.folds, 1))]
        total = zero
        for x in own:
            total = add(total, x)
        w, m, g, a, yy = total
        old = before.coef[k] if before is not None else np.zeros(p)
        v = spec.slot(k).fit(g, a, spec.ridge) if w else old
        coef.append(v)
        count.append(w)
        wrong, n = wrong + max(yy - 2 * a @ v + v @ g @ v, 0.0), n + m
        apart = spec.folds and w >= 2 * spec.folds and spec.slot(k).kind != "known"  # too few windows, or nothing fitted: no folds
        without.append([spec.slot(k).fit(g - x[2], a - x[3], spec.ridge) if apart and x[0] else v for x in own])
    scale = max((wrong / max(n, 1)) ** 0.5, 1e-9)
    if samples is not None:
        labelled = samples.join(windows.select("window_id", "label"), "window_id")
        f = F.element_at(F.array(*[predict(basis, v) for v in coef]), F.col("label") + 1)
        scale = costs.residual_scale(labelled, F.col(y) - f)
    centres = covs = None
    if d:
        m = costs.moments(windows, "label", "z", d)
        whole = costs.moments(windows.withColumn("_all", F.lit(0)), "_all", "z", d)[0]
        m = {k: m.get(k, (0, before.centres[k] if before is not None and before.centres is not None else whole[1], np.eye(d))) for k in range(spec.k)}
        centres, covs = np.array([m[k][1] for k in range(spec.k)]), costs.covariances(m, d)
    return State(np.array(coef), np.array(without) if spec.folds else None, centres, covs, scale)


def score(windows: DataFrame, state: State, spec: LoopSpec, samples: DataFrame | None = None, basis: Basis | None = None, y: str = "y", physics: Column | None = None, fold: Column | None = None) -> DataFrame:
    """windows with `cost`, an array by law, and `best`, the place of the least; each kind of cost is divided by its own median.

    With folds and a column `label`, a window's cost under its own law is that of the law fitted without its fold."""
    if spec.loss == "squared":
        eq = costs.equation_cost(state.coef, state.scale)
        if spec.folds and state.without is not None and "label" in windows.columns:
            f = fold if fold is not None else _fold(spec)
            own = F.element_at(F.element_at(F.array(*[F.array(*[rss(list(v)) * 0.5 / (F.col("n") * state.scale**2) for v in by]) for by in state.without]), F.col("label") + 1), f + 1)
            eq = F.transform(eq, lambda v, i: F.when(i == F.col("label"), own).otherwise(v))
        df = windows.withColumn("_eq", eq)
    else:
        each = costs.sample_costs(samples, [predict(basis, v) for v in state.coef], spec.loss, state.scale, y)
        df = windows.join(each.withColumnRenamed("costs", "_eq"), "window_id")
    df = costs.normalise(df, "_eq")
    geometry = None
    if state.centres is not None and spec.alpha:
        z = F.col("z")
        df = df.withColumn("_geo", costs.euclidean_cost(z, state.centres) if spec.geometry == "euclidean" else costs.density_cost(z, state.centres, state.covs))
        df = costs.normalise(df, "_geo", shift=spec.geometry != "euclidean")
        geometry = F.col("_geo")
    hook = None
    if physics is not None and spec.lam > 0:
        df = costs.normalise(df.withColumn("_phys", physics), "_phys")
        hook = F.col("_phys")
    sizes = [float(np.count_nonzero(v)) for v in state.coef]
    df = df.withColumn("cost", costs.joint_cost(F.col("_eq"), geometry, hook, sizes, spec.alpha, spec.lam, spec.beta))
    return df.drop("_eq", "_geo", "_phys").withColumn("best", costs.least(F.col("cost")))


def repair(scored: DataFrame, spec: LoopSpec) -> dict:
    """{window: law} of the windows that lose least by moving to laws of too few; laws that give keep enough."""
    have = {r["best"]: r["count"] for r in scored.groupBy("best").count().collect()}
    have = {k: have.get(k, 0) for k in range(spec.k)}
    moved: dict = {}
    for k in sorted(have, key=lambda k: have[k]):
        short = spec.min_windows - have[k]
        if short <= 0:
            continue
        givers = [j for j in have if have[j] > spec.min_windows]
        if not givers:
            break
        loss = F.col("cost")[k] - F.element_at("cost", F.col("best") + 1)
        free = ~F.col("window_id").isin(list(moved)) if moved else F.lit(True)
        rows = scored.filter(F.col("best").isin(givers) & free).orderBy(loss, "window_id").select("window_id", "best").limit(spec.min_windows * spec.k).collect()
        for r in rows:  # a few windows
            if short > 0 and have[r["best"]] > spec.min_windows:
                moved[r["window_id"]] = k
                have[r["best"]] -= 1
                have[k] += 1
                short -= 1
    return moved


def _labelled(scored: DataFrame, moved: dict) -> DataFrame:
    label = F.col("best")
    for w, k in moved.items():
        label = F.when(F.col("window_id") == w, k).otherwise(label)
    return scored.withColumn("label", label.cast("int")).drop("cost", "best")


def composites(sums: dict, coef: np.ndarray, spec: LoopSpec) -> list[tuple[int, tuple[int, int], np.ndarray, float]]:
    """(law, pair, coefficients, gain): laws that a weighted sum of two others and a level fits, each weight in [0, 5] and no share
    below 0.15; at most spec.superpose, the largest gains in cost first."""
    found = []
    for k, (_, _, g, a, yy) in sums.items():
        best = None
        old = max(yy - 2 * a @ coef[k] + coef[k] @ g @ coef[k], 0.0)
        for i, j in combinations([x for x in range(len(coef)) if x != k], 2):
            v = np.stack([np.eye(len(a))[0], coef[i], coef[j]], 1)
            w = solve(v.T @ g @ v, v.T @ a)
            if not (0 <= w[1:]).all() or (w[1:] > 5).any() or (w[1:] / max(w[1:].sum(), 1e-300) < 0.15).any():
                continue
            new = v @ w
            cost = max(yy - 2 * a @ new + new @ g @ new, 0.0)
            if best is None or cost < best[0]:
                best = (cost, (i, j), new)
        if best is not None and (old - best[0]) / max(old, 1e-300) >= -spec.margin:
            found.append((k, best[1], best[2], (old - best[0]) / max(old, 1e-300)))
    return sorted(found, key=lambda x: -x[3])[: spec.superpose]


def fit(windows: DataFrame, labels: DataFrame, spec: LoopSpec, samples: DataFrame | None = None, basis: Basis | None = None, y: str = "y", physics: Callable[[State], Column] | None = None) -> tuple[State, DataFrame]:
    """Laws and (window_id, label) from a first partition `labels`. windows: window_id, n, g, a, yy, and z for geometry, an array.

    physics: a hook that gives a window's costs under each law as an array Column."""
    first = windows.limit(1).select(F.size("a").alias("p"), (F.size("z") if "z" in windows.columns else F.lit(0)).alias("d")).first()
    p, d = first["p"], first["d"] if spec.alpha else 0
    plain = windows.drop("label")
    now = plain.join(labels.select("window_id", "label"), "window_id")
    state, history, robust = None, [], spec.loss != "squared"
    own = samples if robust else None
    for it in range(spec.max_iter):
        state = refit(now, spec, p, d, state, own, basis, y)
        hook = physics(state) if physics is not None and spec.lam > 0 else None
        scored = score(now.withColumnRenamed("label", "_was").withColumn("label", F.col("_was")), state, spec, own, basis, y, hook)
        moved = repair(scored, spec) if spec.min_windows else {}
        scored = _labelled(scored, moved)
        changed = scored.agg(F.avg((F.col("label") != F.col("_was")).cast("double"))).first()[0] or 0.0
        history.append({"iteration": it, "changed": changed, "moved": len(moved), "scale": state.scale})
        now = _kept(scored.select(*plain.columns, "label"))
        if changed <= spec.tol:
            break
    state = refit(now, spec, p, d, state, own, basis, y)
    coef = state.coef
    if spec.superpose:
        for k, _, v, _ in composites(_sums(now, ["label"], p), coef, spec):
            coef = np.where(np.arange(len(coef))[:, None] == k, v, coef)
    if spec.order:
        rank = [r["label"] for r in now.groupBy("label").agg(F.avg(spec.order).alias("m")).orderBy("m").collect()]
        rank += [k for k in range(spec.k) if k not in rank]
        now = now.withColumn("label", F.element_at(F.array(*[F.lit(rank.index(k)) for k in range(spec.k)]), F.col("label") + 1))
        coef = coef[rank]
        state = State(coef, None, None if state.centres is None else state.centres[rank], None if state.covs is None else [state.covs[k] for k in rank], state.scale, history=history)
    return State(coef, state.without, state.centres, state.covs, state.scale, history), now.select("window_id", "label")


def _kept(rows: DataFrame) -> DataFrame:
    """rows with their lineage cut where a checkpoint folder is set, else cached: a label is a byte or two, and rounds are few."""
    sc = rows.sparkSession.sparkContext
    return rows.checkpoint() if sc.getCheckpointDir() else rows.cache()
