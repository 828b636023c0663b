"""Composite queries: whole comparisons over generated windows, and a registry by which they are run and written.

`python -m winlaw.plans.blocks NAME... --out DIR` writes a block's rows as CSV; without a name it lists the blocks.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms, theory
from ..operators import classify, cluster, evaluate, laws, loop, selection, stats, windowing
from ..sources import files, generators
from ..streaming import online
from .catalog import query

BLOCKS: dict[str, Callable[[SparkSession], DataFrame]] = {}


def block(name: str):
    """Registers a block as a query too; it reads no table."""

    def put(f):
        BLOCKS[name] = f
        query(f"block_{name}")(lambda spark, sf_dir: f(spark))
        return f

    return put


def _truth(s: DataFrame) -> DataFrame:
    return s.select("window_id", F.col("label").alias("truth"))


def _error(labels: DataFrame, truth: DataFrame) -> float:
    return 1 - float(evaluate.aligned_accuracy(labels.select("window_id", "label").join(truth, "window_id"), "truth", "label"))


def _stats(w: DataFrame, dims: int = 1, **kw) -> DataFrame:
    return stats.window_stats(w, terms.library([f"x{d + 1}" for d in range(dims)], log=False, **kw), "y", ["window_id", "label"]).cache()


def _frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(float(x) if isinstance(x, np.floating) else x for x in r) for r in rows], schema)


@block("pair_battery")
def pair_battery(spark: SparkSession) -> DataFrame:
    """Matched error of the oracle, the hard loop, K-means of mechanism features and of window summaries, and of a weak planted geometry."""
    out = []
    for name, p in generators.BATTERY.items():
        for rho in (0.25,):
            w = generators.windows(spark, p, 150, 64, generators.sigma_for_rho(spark, p, rho)).cache()
            s = _stats(w)
            truth = _truth(s)
            start = cluster.mechanism_start(s, 2)
            own = {k: stats.solve(v[1], v[2]) for k, v in stats.pooled(s, "label").items()}
            z = generators.with_geometry(w.filter("t = 0")).select("window_id", F.array("z1", "z2").alias("s"))
            f = windowing.window_features(w, "window_id", "t", "x1", "y")
            f = cluster.standardise(f.select("window_id", F.array(*[c for c in f.columns if c != "window_id"]).alias("s")), 7)
            ways = {"oracle": stats.nearest_law(s, [list(own[k]) for k in sorted(own)]), "hard_loop": cluster.assign(s, cluster.hard_loop(s, start)), "mechanism_kmeans": cluster.assign(s, start), "summaries": cluster.kmeans(f, 2), "geometry": cluster.kmeans(z, 2)}
            out += [(name, rho, way, _error(d, truth)) for way, d in ways.items()]
    return _frame(spark, out, "pair string, rho double, method string, error double")


@block("shared_component")
def shared_component(spark: SparkSession) -> DataFrame:
    """Error as a component that both laws share grows: mechanism K-means and K-means of summaries."""
    out = []
    for strength in (0.0, 5.0, 50.0):
        w = generators.shared_component(spark, 150, 64, 4.0, strength).cache()
        s = _stats(w)
        f = windowing.window_features(w, "window_id", "t", "x1", "y")
        f = cluster.standardise(f.select("window_id", F.array(*[c for c in f.columns if c != "window_id"]).alias("s")), 7)
        out += [(strength, "mechanism_kmeans", _error(cluster.assign(s, cluster.mechanism_start(s, 2)), _truth(s))), (strength, "summaries", _error(cluster.kmeans(f, 2), _truth(s)))]
    return _frame(spark, out, "strength double, method string, error double")


@block("loop_value")
def loop_value(spark: SparkSession) -> DataFrame:
    """Error of a start and of what the loop makes of it, with a bootstrap interval over pairs."""
    out = []
    for name, share in (("perfect", 0.0), ("some", 0.2), ("chance", 0.5)):
        before, after = [], []
        for p in generators.BATTERY.values():
            s = _stats(generators.windows(spark, p, 150, 64, generators.sigma_for_rho(spark, p, 1.0)))
            a, b = selection.loop_gain(s, selection.corrupt_labels(s.select("window_id", "label"), share, 2), 2, s.select("window_id", "label"))
            before.append(a)
            after.append(b)
        lo, hi = evaluate.bootstrap_ci(np.array(after))
        out.append((name, float(np.mean(before)), float(np.mean(after)), lo, hi))
    return _frame(spark, out, "start string, before double, after double, lo double, hi double")


@block("recovered_laws")
def recovered_laws(spark: SparkSession) -> DataFrame:
    """The laws that the loop found, searched again as formulas, and their errors on a grid."""
    p = generators.PROBLEMS["quadratic_pair"]
    w = generators.windows(spark, p, 150, 48, generators.sigma_for_rho(spark, p, 1.0)).cache()
    s = _stats(w)
    got = cluster.assign(s, cluster.hard_loop(s, cluster.mechanism_start(s, 2))).select("window_id", "label")
    found = laws.fit_laws_by(w.drop("label").join(got, "window_id"), "label", ["x1"])
    grid = spark.range(200).select((F.col("id") / 199 * 4 - 2).alias("x1"))
    true = [F.expr(e) for e in p.laws]
    out = []
    for k, law in sorted(found.items()):
        errors = [evaluate.law_errors(grid, [law.column(), law.column()], [t, true[1 - i]])[0]["rms"] for i, t in enumerate(true)]
        i = int(np.argmin(errors))
        out.append((int(k), law.expression, p.laws[i], float(errors[i])))
    return _frame(spark, out, "label int, found string, true string, rms double")


@block("greedy_path")
def greedy_path(spark: SparkSession) -> DataFrame:
    """Terms in the order they enter, BIC, and the mean squared error on windows held out."""
    w = generators.windows(spark, generators.PROBLEMS["three_shapes"], 120, 48, 0.5).filter("label = 1")
    basis = terms.library(["x1"])
    sums = stats.pooled(stats.window_stats(w.withColumn("part", (F.col("window_id") % 2).cast("int")), basis, "y", ["window_id", "part"]), "part")
    n, g, a, yy, _ = sums[0]
    m, h, b, zz, _ = sums[1]
    out = []
    for cols, cost in laws.greedy_path(n, g, a, yy):
        v = stats.solve(g[np.ix_(cols, cols)], a[cols])
        out.append((len(cols), basis[cols[-1]][0], float(cost), float((zz - 2 * b[cols] @ v + v @ h[np.ix_(cols, cols)] @ v) / m)))
    return _frame(spark, out, "size int, term string, bic double, held_out double")


@block("knowledge")
def knowledge(spark: SparkSession) -> DataFrame:
    """What is known of the laws: nothing, their form, their coefficients."""
    p = generators.PROBLEMS["quadratic_pair"]
    w = generators.windows(spark, p, 150, 32, generators.sigma_for_rho(spark, p, 0.25)).cache()
    basis = [("1", F.lit(1.0)), ("x1", F.col("x1")), ("x1^2", F.col("x1") * F.col("x1"))]
    s = stats.window_stats(w, basis, "y", ["window_id", "label"]).cache()
    start = selection.corrupt_labels(s.select("window_id", "label"), 0.4, 2)
    known = [(0.0, 1.0, 1.0), (0.0, -1.0, 1.0)]
    slots = {"unknown": (), "form": tuple(loop.Slot("partial", (0.0, 0.0, 1.0), (1,)) for _ in known), "known": tuple(loop.Slot("known", v) for v in known)}
    out = [(name, _error(loop.fit(s, start, loop.LoopSpec(2, alpha=0.0, slots=v))[1], _truth(s))) for name, v in slots.items()]
    return _frame(spark, out, "knows string, error double")


@block("nested_families")
def nested_families(spark: SparkSession) -> DataFrame:
    """A bend of varying strength against none: the loop, and the best threshold on the strength."""
    out = []
    for by in ("per_window", "per_group"):
        w = generators.nested_families(spark, 150, 48, 1.0, by).cache()
        s = _stats(w)
        own = w.groupBy("window_id").agg(F.first("s").alias("s"), F.first("label").alias("label")).toPandas()  # a row for each of 150 windows
        cut = min(float(np.mean((own["s"] > t).astype(int) != own["label"])) for t in np.linspace(0, 1, 51))
        out.append((by, _error(cluster.assign(s, cluster.hard_loop(s, cluster.mechanism_start(s, 2))), _truth(s)), min(cut, 1 - cut)))
    return _frame(spark, out, "design string, loop double, threshold double")


@block("null_or_signal")
def null_or_signal(spark: SparkSession) -> DataFrame:
    """Noise against a law under disturbances: four laws merged by majority, as a binary score."""
    out = []
    for kind in ("none", "offset", "slope", "wave"):
        s = _stats(generators.null_or_signal(spark, 150, 48, 1.0, kind))
        got = cluster.assign(s, cluster.hard_loop(s, cluster.mechanism_start(s, 4))).select("window_id", "label").join(_truth(s), "window_id")
        mapped = evaluate.majority_map(got, "label", "truth").withColumnRenamed("truth", "binary")
        m = evaluate.binary_metrics(got.join(mapped, "label"), "truth", "binary").first()
        out.append((kind, float(m["accuracy"]), float(m["mcc"])))
    return _frame(spark, out, "disturbance string, accuracy double, mcc double")


@block("confusions")
def confusions(spark: SparkSession) -> DataFrame:
    """Base, scaled, other and lagged laws: the contingency table of what the loop found."""
    s = _stats(generators.rescaled(spark, 200, 48, 0.5))
    got = cluster.assign(s, cluster.hard_loop(s, cluster.mechanism_start(s, 4))).select("window_id", "label").join(_truth(s), "window_id")
    return evaluate.contingency(got, "truth", "label").select(F.col("truth").cast("int").alias("truth"), F.col("label").cast("int").alias("label"), "n")


@block("frequencies")
def frequencies(spark: SparkSession) -> DataFrame:
    """Fast waves: the loop in the library, K-means of periodograms and of their peaks."""
    p = generators.PROBLEMS["high_frequency"]
    w = generators.windows(spark, p, 150, 48, generators.sigma_for_rho(spark, p, 1.0)).cache()
    s = _stats(w)
    grid = [round(1 + 0.25 * i, 2) for i in range(29)]
    ways = {"hard_loop": cluster.assign(s, cluster.hard_loop(s, cluster.mechanism_start(s, 2))), "periodogram": cluster.periodogram_kmeans(w, 2, grid, x="x1"), "peaks": cluster.periodogram_kmeans(w, 2, grid, True, x="x1")}
    return _frame(spark, [(n, _error(d, _truth(s))) for n, d in ways.items()], "method string, error double")


@block("losses")
def losses_block(spark: SparkSession) -> DataFrame:
    """Noises against losses: error of one assignment by the true laws under each."""
    from ..functions.losses import LOSSES, candidate_losses
    from ..operators.costs import least, sample_costs

    p, out = generators.BATTERY["sign"], []
    sigma = generators.sigma_for_rho(spark, p, 0.1)
    for noise in ("gaussian", "laplace", "t3", "contaminated_20"):
        w = generators.windows(spark, p, 300, 32, sigma, kind=noise).cache()
        truth = w.select("window_id", F.col("label").alias("truth")).distinct()
        fits = [F.expr(e) for e in p.laws]
        residual = w.select("window_id", "t", (F.col("y") - F.element_at(F.array(*fits), F.col("label") + 1)).alias("r"))
        learned = max(candidate_losses(residual, "r", key=["window_id", "t"]), key=lambda c: c["loglik"])["loss"]
        for loss in ("squared", "absolute", "huber", "student_t"):
            got = sample_costs(w, fits, loss, sigma).select("window_id", least(F.col("costs")).alias("label"))
            out.append((noise, loss, loss == learned, _error(got, truth)))
    assert set(LOSSES) >= {r[1] for r in out}
    return _frame(spark, out, "noise string, loss string, learned boolean, error double")


@block("streams")
def streams(spark: SparkSession) -> DataFrame:
    """Online laws: a steady stream, a newcomer, and drift with and without forgetting."""
    out = []
    cases = {"steady": ({}, 1.0, True), "newcomer": ({"newcomer_at": 200}, 1.0, True), "drift_frozen": ({"drift": 0.01}, 1.0, False), "drift": ({"drift": 0.01}, 0.95, True)}
    for name, (kw, keep, learn) in cases.items():
        w = generators.stream(spark, 400, 32, 2.0, **kw)
        s = stats.window_stats(w, terms.library(["x1"], log=False), "y", ["window_id", "label"]).cache()
        model = online.OnlineLaws(forgetting=keep).start(stats.pooled(s.filter("window_id < 60 AND label < 2"), "label"))
        got = online.replay(s.withColumn("stream_id", F.lit(0)), model, update=learn)
        joined = got.join(s.select(F.col("window_id").alias("t"), F.col("label").alias("truth")), "t").filter("t >= 60")
        out.append((name, float(evaluate.matched_error(joined, "truth", "regime")), int(got.agg(F.max("regimes")).first()[0])))
    return _frame(spark, out, "stream string, error double, regimes int")


@block("classification")
def classification(spark: SparkSession) -> DataFrame:
    """Law classifiers of one and two laws a class, a stack on them, and neighbours by summaries, from few windows a class."""
    p = generators.PROBLEMS["three_shapes"]
    w = generators.windows(spark, p, 460, 48, generators.sigma_for_rho(spark, p, 0.25)).cache()
    s = _stats(w)
    f = windowing.window_features(w, "window_id", "t", "x1", "y")
    f = f.select("window_id", F.array(*[c for c in f.columns if c != "window_id"]).alias("s")).join(s.select("window_id", "label"), "window_id")
    train, test = F.col("window_id") < 60, F.col("window_id") >= 60
    truth = s.filter(test).select("window_id", F.col("label").alias("truth"))
    ways = {
        "law_1": classify.LawClassifier.fit(s.filter(train), "label").predict(s.filter(test)),
        "law_2": classify.LawClassifier.fit(s.filter(train), "label", 2).predict(s.filter(test)),
        "stack": classify.LawStack(reg=(1e-2,)).fit(s.filter(train), "label").predict(s.filter(test)),
        "nearest": classify.one_nn(f.filter(train), f.filter(test), "s", "label", "window_id"),
        "centroid": classify.nearest_centroid(f.filter(train), f.filter(test), "s", "label", "window_id"),
    }
    out = [(n, float(d.join(truth, "window_id").agg(F.avg((F.col("prediction") != F.col("truth")).cast("double"))).first()[0])) for n, d in ways.items()]
    return _frame(spark, out, "method string, error double")


@block("robustness")
def robustness(spark: SparkSession) -> DataFrame:
    """AR(1) noise: error of the true laws found and as the theory of least squares predicts it."""
    p, out = generators.BATTERY["sign"], []
    sigma = generators.sigma_for_rho(spark, p, 0.1)
    x = np.linspace(-2, 2, 32)
    for phi in (0.0, 0.6, 0.9):
        w = generators.windows(spark, p, 300, 32, 0.0).withColumn("x1", F.col("t") * (4 / 31) - 2)
        w = generators.ar1(w, "window_id", "t", phi, 5).withColumn("y", F.when(F.col("label") == 0, -F.col("x1")).otherwise(F.col("x1")) + sigma * F.col("e"))
        s = stats.window_stats(w, [("x", F.col("x1"))], "y", ["window_id", "label"])
        ols, gls = theory.ar1_errors(2 * x, sigma, phi)
        found = _error(stats.nearest_law(s, [[-1.0], [1.0]]), _truth(s))
        out.append((phi, found, ols, gls, theory.verdict(ols, found, 0.3)))
    return _frame(spark, out, "phi double, found double, least_squares double, generalised double, verdict string")


@block("open_laws")
def open_laws(spark: SparkSession) -> DataFrame:
    """Laws outside the library: what the loop errs, and the share of their gap that the library leaves."""
    out = []
    for name, p in generators.OPEN_LAWS.items():
        w = generators.windows(spark, p, 150, 48, generators.sigma_for_rho(spark, p, 1.0)).cache()
        s = _stats(w)
        gap = w.select("x1", (F.expr(p.laws[0]) - F.expr(p.laws[1])).alias("y"))
        _, share = laws.outside_share(gap, terms.library(["x1"], log=False))
        out.append((name, _error(cluster.assign(s, cluster.hard_loop(s, cluster.mechanism_start(s, 2))), _truth(s)), share))
    return _frame(spark, out, "problem string, error double, outside double")


@block("theory")
def theory_block(spark: SparkSession) -> DataFrame:
    """Closed forms beside their simulations, with where they stand."""
    rng = np.random.default_rng(0)
    draws = (2 * rng.uniform(-2, 2, (2000, 400))) ** 2
    rho = float(draws.mean()) / 36
    sim = theory.simulated_error(spark, 4000, 32, 2 * F.col("x"), 6.0).first()
    same = theory.shared_component_error(spark, 4000, 32, 2 * F.col("x"), F.col("x") * F.col("x"), 50.0, 6.0).first()
    n = theory.windows_needed_exact(draws, 6.0, 0.1)
    s = _stats(generators.shared_component(spark, 400, 64, 6.0, 3.0))
    f, m = stats.mechanism_features(s)
    sep = stats.separation_matrix(f, s.select("window_id", "label"), m.shape[1], stats.mechanism_noise(s)).first()["distance"]
    t3 = rng.standard_t(3, 200_000) / np.sqrt(3)
    rows = [
        ("two_laws", float(sim["exact"]), float(sim["error"])), ("shared_component", float(same["error"]), float(same["shifted"])),
        ("windows_needed", theory.windows_needed(rho, 0.1) + theory.curvature_excess(rho, 0.8, 0.1) * theory.windows_needed(rho, 0.1), float(n)),
        ("four_laws", theory.k_law_error(4, 1.0), theory.k_law_simulated(4, 1.0)),
        ("mechanism_separation", float(np.sqrt(64 * 4 * (16 / 12) / 36)), float(sep)),
        ("absolute_loss_t3", theory.loss_error(32, 0.25, 1.0), theory.loss_error_simulated(np.abs, t3, 32, 0.5)),
        ("plug_in", theory.plug_in_error(32, 0.25, 3, 20), theory.plug_in_error_simulated(32, 0.25, 3, 20)),
        ("plug_in_random", theory.plug_in_error_random(32, 0.25, 3, 20), theory.plug_in_error_simulated(32, 0.25, 3, 19.875)),
    ]
    return _frame(spark, [(a, b, c, theory.verdict(b, c)) for a, b, c in rows], "form string, predicted double, found double, verdict string")


def main() -> None:
    from ..session import local_session

    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("names", nargs="*")
    parser.add_argument("--out", default="results")
    args = parser.parse_args()
    if not args.names:
        print("\n".join(BLOCKS))
        return
    spark = local_session()
    for name in args.names:
        files.write_results(BLOCKS[name](spark).coalesce(1), files.result_path(args.out, name, "rows", f"python -m winlaw.plans.blocks {name}"))


if __name__ == "__main__":
    main()
