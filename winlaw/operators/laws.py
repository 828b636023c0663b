"""Fitting of closed-form laws from pooled statistics, and engines that users can plug in."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import Basis, expression, library, predict
from .stats import pooled, solve, window_stats


@dataclass(frozen=True)
class Law:
    """Coefficients over a basis; column() is the law's prediction."""

    names: list[str]
    coef: np.ndarray
    complexity: float
    basis: Basis = field(repr=False, compare=False, default_factory=list)

    @property
    def expression(self) -> str:
        return expression(self.coef, self.names)

    def column(self) -> Column:
        return predict(self.basis, self.coef)


class Engine(Protocol):
    """Searches a law for samples (columns of the inputs and y)."""

    def fit(self, samples: DataFrame) -> Law: ...


def bic(rss: float, n: float, p: int) -> float:
    return n * math.log((max(rss, 0.0) + 1e-12) / n) + p * math.log(max(n, 2))


def greedy_path(n: float, g: np.ndarray, a: np.ndarray, yy: float, max_terms: int = 5, least: float = 1e-6) -> list[tuple[list[int], float]]:
    """Selections of columns, growing from the constant (column 0) by the one of least BIC, and each one's BIC."""

    def cost(cols: list[int]) -> float:
        v = solve(g[np.ix_(cols, cols)], a[cols])
        return bic(yy - 2 * a[cols] @ v + v @ g[np.ix_(cols, cols)] @ v, n, len(cols))

    path = [([0], cost([0]))]
    while len(path) <= max_terms:
        cols, best = path[-1]
        tried = [(cost([*cols, j]), j) for j in range(len(a)) if j not in cols]
        if not tried:
            break
        low = min(tried)
        if low[0] >= best - least:
            break
        path.append(([*cols, low[1]], low[0]))
    return path


def greedy_law(n: float, g: np.ndarray, a: np.ndarray, yy: float, basis: Basis, max_terms: int = 5) -> Law:
    cols = greedy_path(n, g, a, yy, max_terms)[-1][0]
    v = np.zeros(len(a))
    v[cols] = solve(g[np.ix_(cols, cols)], a[cols])
    return Law([b for b, _ in basis], v, len(cols), basis)


def fit_law(samples: DataFrame, inputs: list[str], y: str = "y", max_terms: int = 5, **kw) -> Law:
    """One law for all samples, by greedy selection from the term library."""
    basis = library(inputs, **kw)
    n, g, a, yy, _ = pooled(window_stats(samples.withColumn("_all", F.lit(0)), basis, y, ["_all"]))[0]
    return greedy_law(n, g, a, yy, basis, max_terms)


def fit_laws_by(samples: DataFrame, label: str, inputs: list[str], y: str = "y", max_terms: int = 5, **kw) -> dict:
    """A law for each value of a column (a few)."""
    basis = library(inputs, **kw)
    stats = window_stats(samples, basis, y, [label])
    return {k: greedy_law(n, g, a, yy, basis, max_terms) for k, (n, g, a, yy, _) in pooled(stats, label).items()}


def fitted_frequency(samples: DataFrame, column: str, y: str = "y", grid: np.ndarray | None = None, **kw) -> Law:
    """The greedy law, or one with a sine and cosine of a frequency of the grid beside a constant or its terms, if BIC, charged for the frequency too, is less.

    All frequencies of the grid are summed in one pass; one of less than a period over the range is passed over.
    """
    grid = np.arange(0.5, 8.0001, 0.05) if grid is None else grid
    base, one = library([column], **kw), samples.withColumn("_all", F.lit(0))
    x, v = F.col(column), F.col(y)
    r = samples.agg((F.max(x) - F.min(x)).alias("r"), F.avg(v).alias("m")).first()
    n, g, a, yy, _ = pooled(window_stats(one, base, y, ["_all"]))[0]
    path = greedy_path(n, g, a, yy)
    plain, best = greedy_law(n, g, a, yy, base), (path[-1][1], None)
    freqs = [float(f) for f in grid if f >= 2 * math.pi / (r["r"] or 1.0)]
    if not freqs:
        return plain
    rests = [v - float(r["m"]), v - plain.column()]
    sums = samples.agg(*[s for rest in rests for f in freqs for s in (F.sum(rest * F.sin(x * f)), F.sum(rest * F.cos(x * f)))]).first()
    for i, terms in enumerate(([0], sorted({0, *path[-1][0]}))):
        power = [sums[2 * (i * len(freqs) + j)] ** 2 + sums[2 * (i * len(freqs) + j) + 1] ** 2 for j in range(len(freqs))]
        f = freqs[int(np.argmax(power))]
        wide = [base[j] for j in terms] + [(f"sin({f:.4g}*{column})", F.sin(x * f)), (f"cos({f:.4g}*{column})", F.cos(x * f))]
        m, gw, aw, yw, _ = pooled(window_stats(one, wide, y, ["_all"]))[0]
        coef = solve(gw, aw)
        cost = bic(yw - 2 * aw @ coef + coef @ gw @ coef, m, len(coef) + 1)
        if cost < best[0]:
            best = (cost, Law([b for b, _ in wide], coef, len(coef) + 1, wide))
    return best[1] or plain


def refined_frequency(samples: DataFrame, column: str, y: str = "y", grid: np.ndarray | None = None, most: float = 0.8, rounds: int = 3, **kw) -> Law:
    """fitted_frequency() with its frequency narrowed down by ever finer grids around the best, each one pass, and its terms pruned one by
    one while BIC falls. Where the plain library explains more than `most` of the centred sum of squares, no frequency is tried."""
    base, one = library([column], **kw), samples.withColumn("_all", F.lit(0))
    n, g, a, yy, _ = pooled(window_stats(one, base, y, ["_all"]))[0]
    plain = greedy_law(n, g, a, yy, base)
    left = yy - 2 * a @ plain.coef + plain.coef @ g @ plain.coef
    if 1 - left / max(yy - a[0] ** 2 / n, 1e-300) > most:
        return plain
    law = fitted_frequency(samples, column, y, grid, **kw)
    found = [i for i, (name, _) in enumerate(law.basis) if name.startswith("sin(") and "*" in name and name != f"sin(2*{column})"]
    if not found or len(law.basis) == len(base):
        return law
    freq, step, x = float(law.basis[-2][0][4:].split("*")[0]), 0.05, F.col(column)
    rest = law.basis[:-2]
    for _ in range(rounds):
        tries = [freq + step * (i - 5) / 5 for i in range(11) if freq + step * (i - 5) / 5 > 0]
        wide = [*rest, *[w for f in tries for w in ((f"s{f}", F.sin(x * f)), (f"c{f}", F.cos(x * f)))]]
        _, gw, aw, yw, _ = pooled(window_stats(one, wide, y, ["_all"]))[0]
        costs = []
        for i in range(len(tries)):
            c = [*range(len(rest)), len(rest) + 2 * i, len(rest) + 2 * i + 1]
            v = solve(gw[np.ix_(c, c)], aw[c])
            costs.append(yw - 2 * aw[c] @ v + v @ gw[np.ix_(c, c)] @ v)
        freq, step = tries[int(np.argmin(costs))], step / 5
    basis = [*rest, (f"sin({freq:.6g}*{column})", F.sin(x * freq)), (f"cos({freq:.6g}*{column})", F.cos(x * freq))]
    m, gw, aw, yw, _ = pooled(window_stats(one, basis, y, ["_all"]))[0]

    def cost(c: list[int]) -> tuple[float, np.ndarray]:
        v = solve(gw[np.ix_(c, c)], aw[c])
        return bic(yw - 2 * aw[c] @ v + v @ gw[np.ix_(c, c)] @ v, m, len(c) + 1), v

    keep = list(range(len(basis)))
    while len(keep) > 1:
        least, drop = min((cost([k for k in keep if k != d])[0], d) for d in keep if d)
        if least >= cost(keep)[0]:
            break
        keep.remove(drop)
    total, v = cost(keep)
    if total >= greedy_path(n, g, a, yy)[-1][1]:
        return plain
    return Law([basis[k][0] for k in keep], v, len(keep) + 1, [basis[k] for k in keep])


class External:
    """Adapter to a searching package: it is imported when it is used, and fitted to a bounded sample on the driver.

    fitted(model) -> (expression as SQL of the inputs, complexity)."""

    def __init__(self, package: str, make, fitted, inputs: list[str], rows: int = 5000):
        self.package, self.make, self.fitted, self.inputs, self.rows = package, make, fitted, inputs, rows

    def fit(self, samples: DataFrame, y: str = "y") -> Law:
        import importlib

        module = importlib.import_module(self.package)
        some = samples.select(*self.inputs, y).orderBy(F.xxhash64(*self.inputs, y)).limit(self.rows).toPandas()
        model = self.make(module)
        model.fit(some[self.inputs].to_numpy(), some[y].to_numpy())
        text, size = self.fitted(model)
        return known_law(text, F.expr(text), size)


class Greedy:
    """The built-in engine: greedy selection, with a fitted frequency if asked."""

    def __init__(self, inputs: list[str], frequency: bool = False, max_terms: int = 5, **kw):
        self.inputs, self.frequency, self.max_terms, self.kw = inputs, frequency, max_terms, kw

    def fit(self, samples: DataFrame, y: str = "y") -> Law:
        if self.frequency and len(self.inputs) == 1:
            return refined_frequency(samples, self.inputs[0], y, **self.kw)
        return fit_law(samples, self.inputs, y, self.max_terms, **self.kw)


def make_engine(name: str, inputs: list[str], **kw):
    """fast, fast_sin, or an adapter by the name of its package (pysr, dso); an unknown name raises ValueError."""
    if name in ("fast", "fast_sin"):
        return Greedy(inputs, name == "fast_sin", **kw)
    if name == "pysr":
        return External("pysr", lambda m: m.PySRRegressor(**({"niterations": 40, "deterministic": True, "parallelism": "serial", "random_state": 0} | kw)), lambda model: (str(model.sympy()), float(model.get_best()["complexity"])), inputs)
    if name == "dso":
        return External("dso", lambda m: m.DeepSymbolicRegressor(**kw), lambda model: (str(model.program_.sympy_expr), float(len(model.program_.traversal))), inputs)
    raise ValueError(f"no engine {name!r}")


def parametric_laws(samples: DataFrame, by: str, inputs: list[str], form: Callable, start: np.ndarray, bounds: tuple | None = None, y: str = "y", rows: int = 100_000) -> DataFrame:
    """(by, coef, rss, n, fell_back): a known form fitted to each group by parametric_law(), from at most `rows` of its samples by a hash;
    where it finds no finite cost the start is kept."""
    from pyspark.sql import Window

    kind, t0 = dict(samples.dtypes)[by], np.asarray(start, float)
    few = samples.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(*inputs, y)))).filter(F.col("_r") <= rows).drop("_r")

    def run(pdf):
        import pandas as pd

        x, v = pdf[inputs].to_numpy(float), pdf[y].to_numpy(float)
        try:
            t = parametric_law(x, v, form, t0, bounds)
            rss_ = float(((v - form(x, t)) ** 2).sum())
        except (np.linalg.LinAlgError, FloatingPointError, ValueError):
            rss_ = float("nan")
        back = not np.isfinite(rss_)
        if back:
            t, rss_ = t0, float(((v - form(x, t0)) ** 2).sum())
        return pd.DataFrame({by: [pdf[by].iloc[0]], "coef": [t], "rss": [rss_], "n": [len(v)], "fell_back": [back]})

    return few.select(by, *inputs, y).groupBy(by).applyInPandas(run, f"{by} {kind}, coef array<double>, rss double, n long, fell_back boolean")


def laws_by_window(stats: DataFrame, basis: Basis, max_terms: int = 5, key: str = "window_id") -> DataFrame:
    """(key, coef, complexity, expression): greedy selection within each window, from its statistics."""
    import pandas as pd

    names = [n for n, _ in basis]

    def run(batches):
        for pdf in batches:
            out = []
            for n, g, a, yy in zip(pdf["n"], pdf["g"], pdf["a"], pdf["yy"], strict=True):
                a = np.asarray(a)
                cols = greedy_path(n, np.asarray(g).reshape(len(a), -1), a, yy, max_terms)[-1][0]
                v = np.zeros(len(a))
                g = np.asarray(g).reshape(len(a), -1)
                v[cols] = solve(g[np.ix_(cols, cols)], a[cols])
                out.append((v, float(len(cols)), expression(v, names)))
            yield pd.DataFrame({key: pdf[key], "coef": [o[0] for o in out], "complexity": [o[1] for o in out], "expression": [o[2] for o in out]})

    return stats.select(key, "n", "g", "a", "yy").mapInPandas(run, f"{key} {dict(stats.dtypes)[key]}, coef array<double>, complexity double, expression string")


def cubic_mixture(samples: DataFrame, column: str, k: int, y: str = "y", max_iter: int = 30):
    """The hard loop on cubic polynomials, from K-means of mechanism features."""
    from ..functions.terms import cubic
    from .cluster import hard_loop, mechanism_start

    stats = window_stats(samples, cubic(column), y).cache()
    return hard_loop(stats, mechanism_start(stats, k), max_iter), stats


def known_law(name: str, column: Column, complexity: float = 1.0) -> Law:
    return Law([name], np.ones(1), complexity, [(name, column)])


def residual_law(samples: DataFrame, prior: Column, inputs: list[str], y: str = "y", **kw) -> Law:
    """A known part and a searched rest."""
    rest = fit_law(samples.withColumn("_rest", F.col(y) - prior), inputs, "_rest", **kw)
    return Law(["prior", *rest.names], np.append(1.0, rest.coef), rest.complexity + 1, [("prior", prior), *rest.basis])


def superposition(samples: DataFrame, laws: list[Law], y: str = "y", top: float = 5.0, share: float = 0.15) -> Law | None:
    """y as a sum of other laws with weights in [0, top] and a free level; None if one's share is below `share`."""
    basis = [("1", F.lit(1.0)), *((f"law{i}", law.column()) for i, law in enumerate(laws))]
    n, g, a, yy, _ = pooled(window_stats(samples.withColumn("_all", F.lit(0)), basis, y, ["_all"]))[0]
    best = None
    m = len(laws)
    for fixed in np.ndindex(*[3] * m):  # each weight free, at 0 or at the top
        v = np.array([0.0, *[(None, 0.0, top)[f] or 0.0 for f in fixed]])
        free = [0, *[i + 1 for i in range(m) if not fixed[i]]]
        held = [i for i in range(m + 1) if i not in free]
        v[free] = solve(g[np.ix_(free, free)], a[free] - g[np.ix_(free, held)] @ v[held])
        if all(0 <= v[i] <= top for i in range(1, m + 1)):
            cost = yy - 2 * a @ v + v @ g @ v
            if best is None or cost < best[0]:
                best = (cost, v)
    if best is None or best[1][1:].sum() <= 0 or (best[1][1:] / best[1][1:].sum() < share).any():
        return None
    return Law([b for b, _ in basis], best[1], 0.5 * sum(x.complexity for x in laws) + m + 1, basis)


def superpositions(samples: DataFrame, laws: list[Law], y: str = "y") -> list[tuple[tuple[int, int], Law]]:
    """Those pairs of laws whose sum fits."""
    out = [((i, j), superposition(samples, [laws[i], laws[j]], y)) for i, j in combinations(range(len(laws)), 2)]
    return [(ij, law) for ij, law in out if law]


def parametric_law(x: np.ndarray, y: np.ndarray, form: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, bounds: tuple[np.ndarray, np.ndarray] | None = None, steps: int = 200) -> np.ndarray:
    """Coefficients of a known form by damped least squares within bounds; for one group's samples, in applyInPandas."""
    t, lam = np.asarray(start, float), 1e-3
    lo, hi = bounds or (np.full(len(t), -np.inf), np.full(len(t), np.inf))
    cost = float(np.sum((y - form(x, t)) ** 2))
    for _ in range(steps):
        f = form(x, t)
        jac = np.stack([(form(x, t + h * e) - f) / h for e, h in zip(np.eye(len(t)), 1e-6 * np.maximum(1, np.abs(t)), strict=True)], 1)
        g = jac.T @ jac
        step = np.linalg.lstsq(g + lam * np.diag(np.maximum(np.diag(g), 1e-12)), jac.T @ (y - f), rcond=None)[0]
        new = np.clip(t + step, lo, hi)
        c = float(np.sum((y - form(x, new)) ** 2))
        if c < cost:
            done = cost - c < 1e-12 * max(cost, 1e-300)
            t, cost, lam = new, c, lam / 3
            if done:
                break
        else:
            lam *= 4
            if lam > 1e12:
                break
    return t


def outside_share(samples: DataFrame, basis: Basis, y: str = "y") -> tuple[np.ndarray, float]:
    """Least-squares coefficients of y over a basis, and the share of y'y that its span leaves."""
    _, g, a, yy, _ = pooled(window_stats(samples.withColumn("_all", F.lit(0)), basis, y, ["_all"]))[0]
    v = solve(g, a)
    return v, float(max(yy - 2 * a @ v + v @ g @ v, 0.0) / max(yy, 1e-300))
