import gzip
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from winlaw.functions import special, terms, theory
from winlaw.operators import classify, cluster, costs, evaluate, laws, loop, selection, stats, windowing
from winlaw.sources import files, generators
from winlaw.streaming import online


@pytest.fixture(scope="module")
def pair(spark):
    p = generators.PROBLEMS["quadratic_pair"]
    w = generators.windows(spark, p, 90, 32, 1.0).cache()
    basis = [("1", F.lit(1.0)), ("x1", F.col("x1")), ("x1^2", F.col("x1") * F.col("x1"))]
    return w, basis, stats.window_stats(w, basis, "y", ["window_id", "label"]).cache()


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=2) * 0.4 + [4 * (i % 3), 3 * (i % 2)]], i % 3 * 2 + i % 2) for i in range(180)]
    return spark.createDataFrame(rows, "window_id long, s array<double>, label int").cache()


def accuracy(got, truth, name="label"):
    own = truth.select("window_id", F.col(name).alias("_truth"))
    return evaluate.aligned_accuracy(got.select("window_id", "label").join(own, "window_id"), "_truth", "label")


@pytest.mark.parametrize("way", ["ward", "spectral", "birch", "bayesian"])
def test_partitions_of_blobs(blobs, way):
    f = blobs.drop("label")
    got = {"ward": lambda: cluster.ward(f, 6), "spectral": lambda: cluster.spectral(f, 6, gamma=1.0), "birch": lambda: cluster.birch(f, 6), "bayesian": lambda: cluster.bayesian_gmm(f, 6, 2)}[way]()
    assert accuracy(got, blobs) > 0.95


def test_agglomeration_of_cells(blobs):
    assert accuracy(cluster.ward(blobs.drop("label"), 6, most=40), blobs) > 0.95


def test_a_bayesian_mixture_drops_needless_components(blobs):
    two = blobs.filter("label IN (0, 4)").drop("label")
    assert cluster.bayesian_gmm(two, 5, 2, prior=1e-3).select("label").distinct().count() <= 3


def test_feature_maps_agree_on_equal_windows(pair):
    _, _, s = pair
    a = stats.FeatureMap("project").fit(s)
    rows = a.transform(s).join(s.select("window_id", "label"), "window_id").groupBy("label").agg(F.avg(F.abs(F.col("s")[1])).alias("m")).collect()
    assert all(r["m"] > 1 for r in rows)
    assert abs(np.mean([r["s"][0] for r in stats.FeatureMap("solve").fit(s).transform(s).collect()])) < 1e-6
    with pytest.raises(ValueError):
        stats.FeatureMap("other")


def test_any_nuisance_is_profiled_out(pair):
    w, _, s = pair
    own = stats.profile(s.drop("label"), 3, [0, 2])
    got = {r["window_id"]: r["a"][0] / r["g"][0] for r in own.collect()}
    pdf = w.toPandas()
    for k, d in list(pdf.groupby("window_id"))[:5]:
        b = np.stack([np.ones(len(d)), d["x1"], d["x1"] ** 2], 1)
        assert abs(got[k] - np.linalg.lstsq(b, d["y"], rcond=None)[0][1]) < 1e-8


def test_separations_agree(pair):
    _, _, s = pair
    f, m = stats.mechanism_features(s)
    sigma, n = stats.mechanism_noise(s), 32
    free = stats.separation_unlabelled(f, m.shape[1], sigma, n)
    assert abs(free["rho"] - stats.rho_of_partition(f, s.select("window_id", "label"), m.shape[1], sigma, n)) < 0.35 * free["rho"]


# ---- the loop


def test_loop_from_bad_labels(pair):
    _, _, s = pair
    start = selection.corrupt_labels(s.select("window_id", "label"), 0.4, 2)
    state, got = loop.fit(s, start, loop.LoopSpec(2, alpha=0.0, folds=3))
    assert accuracy(got, s) > 0.95 and state.history[-1]["changed"] <= 0.01


def test_loop_reads_samples_for_robust_losses(pair):
    w, basis, s = pair
    start = selection.corrupt_labels(s.select("window_id", "label"), 0.3, 2)
    _, got = loop.fit(s, start, loop.LoopSpec(2, alpha=0.0, loss="huber", max_iter=4), w.drop("label"), basis)
    assert accuracy(got, s) > 0.95


def test_slots(pair):
    _, _, s = pair
    slots = (loop.Slot("known", (0.0, 1.0, 1.0)), loop.Slot("partial", (0.0, 0.0, 1.0), (1,)))
    state, got = loop.fit(s, s.select("window_id", "label"), loop.LoopSpec(2, alpha=0.0, slots=slots))
    assert state.coef[0].tolist() == [0.0, 1.0, 1.0] and state.coef[1][2] == 1.0 and abs(state.coef[1][1] + 1) < 0.2
    for bad in ({"kind": "other"}, {"kind": "known"}):
        with pytest.raises(ValueError):
            loop.Slot(**bad)


def test_repair_fills_laws_from_those_that_can_give(spark):
    rows = [(i, [0.1 * i, 1.0 + 0.01 * i, 5.0], 0) for i in range(10)]
    scored = spark.createDataFrame(rows, "window_id long, cost array<double>, best int")
    moved = loop.repair(scored, loop.LoopSpec(3, min_windows=3))
    assert sorted(moved.values()) == [1, 1, 1, 2, 2, 2]
    assert {w for w, k in moved.items() if k == 1} == {7, 8, 9}  # those that lose least
    assert loop.repair(scored, loop.LoopSpec(3, min_windows=0)) == {}


def test_laws_are_numbered_by_a_key(pair):
    _, _, s = pair
    keyed = s.withColumn("z", F.array(F.when(F.col("label") == 0, 5.0).otherwise(1.0))).withColumn("key", F.col("z")[0])
    state, got = loop.fit(keyed, s.select("window_id", "label"), loop.LoopSpec(2, order="key"))
    assert state.coef[0][1] < 0 < state.coef[1][1]
    assert got.join(s.select("window_id", F.col("label").alias("t")), "window_id").filter("label = t").count() <= 2


def test_composites(pair):
    g = np.diag([32.0, 40.0, 60.0])
    coef = np.array([[0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.3, 2.0, 1.5]])
    sums = {2: (10, 320.0, g, g @ coef[2], float(coef[2] @ g @ coef[2]) + 1)}
    (k, of, v, gain), = loop.composites(sums, coef, loop.LoopSpec(3, superpose=1, margin=0.1))
    assert k == 2 and of == (0, 1) and np.allclose(v, coef[2]) and abs(gain) < 1e-9
    assert loop.composites(sums, -coef, loop.LoopSpec(3, superpose=1)) == []


def test_physics_hook_decides_where_equations_tie(pair):
    _, _, s = pair
    state = loop.State(np.array([[0.0, 1.0, 1.0]] * 2), None, None, None, 1.0)
    hook = F.array(F.lit(1.0), F.when(F.col("window_id") % 2 == 0, 0.5).otherwise(2.0))
    got = loop.score(s.drop("label"), state, loop.LoopSpec(2, alpha=0.0, lam=0.5), physics=hook)
    assert got.filter((F.col("best") == 1) != (F.col("window_id") % 2 == 0)).count() == 0
    off = loop.score(s.drop("label"), state, loop.LoopSpec(2, alpha=0.0, lam=0.0), physics=hook)
    assert off.filter("best = 1").count() == 0


def test_cost_scales(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 0.0, 0.0, 8.0])], "window_id long, c array<double>")
    assert costs.matrix_scale(df, "c") == 1.0
    assert costs.normalise(df.withColumn("c", F.array(F.lit(0.0), F.lit(2.0), F.lit(4.0))), "c").first()["c"] == [0.0, 1.0, 2.0]


# ---- laws and classification


def test_frequencies_are_narrowed_down(spark):
    rows = spark.range(3000).select((F.col("id") / 3000 * 4 - 2).alias("x"))
    samples = rows.withColumn("y", 2 * F.sin(F.col("x") * 6.137) + 0.3 * F.col("x"))
    law = laws.refined_frequency(samples, "x")
    freq = [float(n[4:].split("*")[0]) for n, c in zip(law.names, law.coef, strict=True) if n.startswith("sin(") and "*" in n and abs(c) > 1]
    assert freq and abs(freq[-1] - 6.137) < 0.01
    plain = laws.refined_frequency(rows.withColumn("y", F.col("x") * 3), "x")
    assert not any(c for n, c in zip(plain.names, plain.coef, strict=True) if "sin" in n and abs(c) > 1e-6)


def test_engines(spark, pair):
    w, _, _ = pair
    assert isinstance(laws.make_engine("fast", ["x1"]).fit(w.filter("label = 0")).expression, str)
    with pytest.raises(ValueError):
        laws.make_engine("none", ["x1"])
    with pytest.raises(ModuleNotFoundError):
        laws.make_engine("dso", ["x1"]).fit(w)


def test_parametric_laws_by_group(spark):
    rows = spark.range(400).select((F.col("id") % 2).cast("int").alias("k"), (F.col("id") / 100).alias("x"))
    samples = rows.withColumn("y", F.when(F.col("k") == 0, 2 * F.exp(-0.5 * F.col("x"))).otherwise(3 * F.exp(-F.col("x"))))
    got = {r["k"]: r for r in laws.parametric_laws(samples, "k", ["x"], lambda x, t: t[0] * np.exp(-t[1] * x[:, 0]), np.array([1.0, 0.1])).collect()}
    assert np.allclose(got[0]["coef"], [2, 0.5], atol=1e-4) and np.allclose(got[1]["coef"], [3, 1], atol=1e-4) and not got[0]["fell_back"]


def test_laws_by_window_and_cubic_mixture(pair):
    w, basis, s = pair
    got = laws.laws_by_window(s, basis).join(s.select("window_id", "label"), "window_id").collect()
    assert np.mean([(r["coef"][1] > 0) == (r["label"] == 0) for r in got]) > 0.95 and all(r["complexity"] <= 3 for r in got)
    fit, own = laws.cubic_mixture(w, "x1", 2)
    assert accuracy(cluster.assign(own, fit), s) > 0.95


def test_classifiers(pair):
    _, _, s = pair
    train, test = s.filter("window_id < 45"), s.filter("window_id >= 45")
    truth = test.select("window_id", F.col("label").alias("t"))
    right = lambda d: d.join(truth, "window_id").agg(F.avg((F.col("prediction") == F.col("t")).cast("double"))).first()[0]
    model = classify.LawClassifier.fit(train, "label")
    assert right(model.predict(test)) > 0.95
    assert right(classify.LawClassifier.fit(train, "label", "all").predict(test)) > 0.9
    native = {r["window_id"]: r["proba"] for r in model.predict_native(test).collect()}
    old, classify.NATIVE_COLUMNS = classify.NATIVE_COLUMNS, 0
    try:
        slow = {r["window_id"]: r["proba"] for r in model.predict(test).collect()}
    finally:
        classify.NATIVE_COLUMNS = old
    assert all(np.allclose(native[k], slow[k]) for k in slow)
    assert right(classify.LawStack(folds=2, reg=(1e-2,)).fit(train, "label").predict(test)) > 0.9


def test_cross_validation_prefers_the_simple(pair):
    w, basis, s = pair
    (size, k), rows = classify.cross_validate(lambda n: stats.window_stats(w, basis[:n], "y", ["window_id", "label"]), [2, 3], [1], "label", 2)
    assert k == 1 and size in (2, 3) and len(rows) == 2


def test_shifts_are_aligned(spark):
    p = generators.Problem(("sin(2*x1)", "cos(x1)"))
    w = generators.windows(spark, p, 40, 32, 0.1).withColumn("tau", F.when(F.col("window_id") % 2 == 0, 0.0).otherwise(0.4))
    w = w.withColumn("x1", F.col("x1") - F.col("tau")).drop("tau")
    by = classify.shifted_stats(w, lambda t: [("s", F.sin(2 * (F.col("x1") + t))), ("c", F.cos(F.col("x1") + t))], [0.0, 0.4], "y", ["window_id", "label"])
    got = classify.align(by, "label")
    assert abs(got[0][0] - 1) < 0.1 and abs(got[1][1] - 1) < 0.1


def test_machines_and_transfer(blobs):
    two = blobs.withColumn("label", (F.col("label") % 2).cast("int")).withColumn("site", (F.col("window_id") % 4).cast("int")).withColumn("coverage", F.col("window_id").cast("double"))
    predict = classify.kernel_svm(two.filter("site < 2"), "s", "label", 60)
    got = predict(two.filter("site >= 2"), "window_id").join(two.select("window_id", "label"), "window_id")
    assert got.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.9
    out = classify.transfer(two, "site", [0, 1], "label", "s", "window_id")
    assert set(out) == {"all", "tercile_0", "tercile_1", "tercile_2"} and out["all"] < 0.1


def test_rank_rules():
    rng = np.random.default_rng(0)
    rows = [{"size": k, "signal": rng.normal(m, 0.1, 200), "noise": rng.normal(1, 0.05, 200)} for k, m in ((2, 1.0), (4, 2.0), (8, 2.001), (16, 1.0))]
    assert selection.snr_rank(rows) in (4, 8) and selection.snr_rank(rows, "snr_1se") == 4 and selection.snr_rank(rows, "snr_smooth") in (4, 8)
    with pytest.raises(ValueError):
        selection.snr_rank(rows, "none")


# ---- theory, generators, sources, streams


def test_closed_forms_and_simulations():
    assert abs(theory.k_law_error(3, 1.2) - theory.k_law_simulated(3, 1.2)) < 0.02
    assert abs(theory.plug_in_error(40, 0.2, 4, 30) - theory.plug_in_error_simulated(40, 0.2, 4, 30)) < 0.02
    gauss = lambda x: np.exp(-x * x / 2)
    assert abs(theory.likelihood_efficiency(lambda x: -x * x / 2, gauss) - 1) < 1e-3
    gap, cov = np.linspace(-1, 1, 9), np.eye(9)
    assert theory.centred_masked_error(gap, cov, np.arange(9)) == pytest.approx(theory.masked_error(gap, cov))
    assert theory.decided_share(gap, cov, 1.0, 0.5) == pytest.approx(1.0) and 0 < theory.decided_share(gap, cov, 1.0, 0.9) < 1
    m = theory.labelled_windows_needed(32, 0.25, 3, 0.01)
    assert theory.plug_in_error(32, 0.25, 3, m) - special.q(0.5 * math.sqrt(8)) == pytest.approx(0.01, abs=1e-6)
    curve = theory.error_curve(0.1, [1, 10], np.full((5, 20), 0.1), 1.0)
    assert curve[1]["population"] == pytest.approx(curve[1]["exact"])


def test_generators_share_their_random_numbers(spark):
    p = generators.BATTERY["sign"]
    a, b = (generators.windows(spark, p, 5, 8, s).select("window_id", "t", "x1", "label").collect() for s in (0.5, 5.0))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    for problems in (generators.BATTERY, generators.FAMILIES, generators.OPEN_LAWS):
        for q in problems.values():
            assert generators.windows(spark, q, 2, 4, 0.1).filter("y IS NULL OR isnan(y)").count() == 0
    sigma = generators.sigma_for_rho(spark, p, 0.25)
    assert generators.realised_rho(spark, p, sigma) == pytest.approx(0.25)


def test_more_generators(spark):
    m = generators.mixture(spark, ["quadratic", "0.5*sine + cubic"], 300, 2, shares=[0.8, 0.2], extra=1)
    assert m.columns.count("x2") == 1 and 0.1 < m.agg(F.avg("label")).first()[0] < 0.3
    assert generators.nested_families(spark, 10, 4, 0.1, "per_group").groupBy("group_id").agg(F.countDistinct("s").alias("n")).filter("n > 1").count() == 0
    lagged = generators.rescaled(spark, 40, 6, 0.0).filter("label = 3 AND t = 0").select("x1", "y").collect()
    assert all(r["y"] == pytest.approx(r["x1"] ** 2) for r in lagged)
    assert generators.stream(spark, 40, 4, 0.1, newcomer_at=20).filter("label = 2 AND window_id < 20").count() == 0
    assert generators.high_frequency_stream(spark, 40, 4, 0.1, 20).filter("label = 1 AND window_id < 20").count() == 0
    fixed = generators.training_and_test(spark, 5, 10, 4, 0.1, design="fixed")
    assert fixed.select("t", "x1").distinct().count() == 4 and fixed.filter("training").select("window_id").distinct().count() == 10
    states = generators.markov_states(spark, 200_000, 100.0).orderBy("t").collect()
    switches = sum(a["state"] != b["state"] for a, b in zip(states, states[1:], strict=False))
    assert 1600 < switches < 2400


def test_members_of_archives(spark, tmp_path):
    head = "".join(f"# {i}\n" for i in range(9))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("Turbine_3.csv", head + "2020-01-01 00:00:00,5.5,x,100\n2020-01-01 00:10:00,NaN?,1,200\n")
        z.writestr("Turbine_7.csv.gz", gzip.compress((head + "2020-01-01 00:00:00,6.5,y,300\n").encode()))
        z.writestr("notes.txt", "no table")
    got = sorted([tuple(r) for r in files.scada(spark, str(tmp_path / "a.zip"), {"0": "time", "1": "ws", "3": "power"}).select("turbine", "ws", "power").collect()], key=str)
    assert [g[0] for g in got] == [3, 3, 7] and sorted(g[2] for g in got) == [100.0, 200.0, 300.0] and sum(g[1] is None for g in got) == 1
    (tmp_path / "p.csv").write_text("Latitude,Longitude\n1.5,2.5\n3.5,4.5\n")
    assert sorted(map(tuple, files.positions(spark, str(tmp_path / "p.csv")).collect())) == [(1, 1.5, 2.5), (2, 3.5, 4.5)]
    (tmp_path / "r.csv").write_text(" Dataset ,Best\nWafer (a),0.1\nCoffee,n/a\n")
    assert sorted(map(tuple, files.published(spark, str(tmp_path / "r.csv")).collect()), key=str) == [("Coffee", None), ("Wafer", 0.1)]


def test_both_splits_share_their_labels(spark, tmp_path):
    (tmp_path / "a.ts").write_text("@data\n1,2:b\n3,4:a\n")
    (tmp_path / "b.ts").write_text("@data\n1,?:c\n")
    got = {(r["label"], r["code"]) for r in files.both_splits(spark, str(tmp_path / "a.ts"), str(tmp_path / "b.ts")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


def test_registered_sources(tmp_path):
    (tmp_path / "x.csv").write_text("a")
    files.register("here", str(tmp_path / "x.csv"))
    files.register("gone", str(tmp_path / "y.csv"), rebuild="run it")
    files.register("other", str(tmp_path / "x.csv"), digest="0")
    assert files.available() == {"here": True, "gone": False, "other": False} and files.source("here").endswith("x.csv")
    with pytest.raises(FileNotFoundError, match="run it"):
        files.source("gone")
    assert files.result_path(str(tmp_path), "b", "t", "again").endswith("b/t.csv") and (tmp_path / "b" / "REBUILD").exists()


def test_nystrom_of_two_inputs(spark):
    w = generators.windows(spark, generators.PROBLEMS["saddle"], 30, 16, 0.1)
    basis = terms.nystrom_columns(w, ["x1", "x2"], 12)
    _, share = laws.outside_share(w.filter("label = 0"), basis)
    assert 2 < len(basis) <= 13 and share < 0.5
    with pytest.raises(KeyError):
        terms.make_basis("none", "x1", 3)


def test_online_laws_without_labels(pair):
    _, _, s = pair
    model = online.OnlineLaws().warm(s.filter("window_id < 45").drop("label"), 2, "mechanism")
    got = online.replay(s.filter("window_id >= 45").withColumn("stream_id", F.lit(1)), model).select("t", F.col("regime").alias("label"))
    truth = s.filter("window_id >= 45").select((F.col("window_id") - 45).alias("t"), F.col("label").alias("truth"))
    assert evaluate.aligned_accuracy(got.join(truth, "t"), "truth", "label") > 0.95


def test_cusum_in_blocks_is_the_plain_recursion():
    rng = np.random.default_rng(3)
    ll = rng.normal(size=(5000, 3))
    at, to, tops = online._next_switch(ll, 1, 30.0, block=64)
    s, plain = np.zeros(3), []
    for i, v in enumerate(ll):
        s = np.maximum(0, s + v - v[1])
        s[1] = 0
        if s.max() > 30:
            assert (i, int(s.argmax())) == (at, to)
            break
        plain.append(s.max())
    assert np.allclose(plain, tops)


@pytest.mark.parametrize("p", [0.0, 0.25, 1 / 3, 0.5, 1.0])
@pytest.mark.parametrize("kind", ["even", "odd", "ties", "wide", "infinite", "nan", "tiny"])
def test_quantile_is_exact_when_narrowed(spark, monkeypatch, kind, p):
    """Against percentile, with more rows than are looked up on the driver."""
    monkeypatch.setattr(stats, "FEW_ROWS", 5)
    monkeypatch.setattr(stats, "BINS", 7)
    rng = np.random.default_rng(3)
    v = {
        "even": rng.normal(size=200),
        "odd": rng.normal(size=201),
        "ties": np.round(rng.normal(size=200), 1),
        "wide": np.concatenate([rng.normal(size=99), [1e308, -1e308]]),
        "infinite": np.concatenate([rng.normal(size=98), [np.inf, -np.inf]]),
        "nan": np.concatenate([rng.normal(size=60), [np.nan] * 60]),
        "tiny": rng.normal(size=50) * 1e-310,
    }[kind]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(3)
    want = df.agg(F.percentile("v", F.lit(p))).first()[0]
    got = stats.quantile(df, F.col("v"), p)
    assert got == want or math.isnan(got) and math.isnan(want)
    assert stats.quantile(df.filter("v IS NULL"), F.col("v"), p) is None


def test_residual_scale_holds_no_table_of_all_values(spark, monkeypatch):
    """The residuals of a refit were merged value by value in one task."""
    rows = [(i % 20, float(i % 7) - 3.0, 0.1 * ((i * 37) % 101)) for i in range(400)]
    s = spark.createDataFrame(rows, "window_id long, x double, y double")
    w = stats.window_stats(s, [("x", F.col("x"))]).withColumn("label", (F.col("window_id") % 2).cast("int"))
    monkeypatch.setattr(stats, "FEW_ROWS", 10)
    monkeypatch.setattr(F, "percentile", lambda *a: pytest.fail("percentile of all rows"))
    before = w.storageLevel
    st = loop.refit(w, loop.LoopSpec(2), 1, 0, None, s, [("x", F.col("x"))])
    r = np.array([y - st.coef[k % 2][0] * x for k, x, y in rows])
    assert st.scale == pytest.approx(1.4826 * np.median(np.abs(r - np.median(r))), rel=1e-12)
    assert w.storageLevel == before


def test_block_meta_does_not_depend_on_the_order_of_rows(spark):
    """Blocks of the same rows, in other orders and partitions, are on the same side of every quantile."""
    rng = np.random.default_rng(1)
    base = [[(float(q), float(a), float(b)) for q, a, b in zip(rng.integers(1, 51, 80), rng.integers(0, 9, 80) / 100, rng.integers(0, 11, 80) / 100, strict=True)] for _ in range(7)]
    rows = [(10 * k + copy, *base[k][i]) for copy in range(6) for k in range(7) for i in rng.permutation(80)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(b), *map(float, v)) for b, *v in rows], "block long, ws double, temp double, ws_sd double").repartition(5)
    got = windowing.block_meta(df, ["block"]).withColumn("k", F.floor(F.col("block") / 10))
    same = got.groupBy("k").agg(*[F.count_distinct(c).alias(c) for c in ("ws", "temp", "unsteady", "warm", "step")]).collect()
    assert len(same) == 7 and all(v == 1 for r in same for v in list(r)[1:])


def test_exact_means_of_odd_values(spark):
    """Exact where sums of doubles are not; nulls, infinities, NaN, tiny values and other types as in avg."""
    a = {1: [1e300, 1.0, -1e300], 2: [0.1] * 10, 3: [None, -5e-324, 5e-324], 4: [math.inf, 1.0], 5: [math.nan, 1.0], 6: [None], 7: [-0.1, 0.3, -1e-9, 1e17], 8: [math.inf, -math.inf], 9: [-1e-17, 0.0]}
    rows = [(k, v, None if v is None else i) for k, own in a.items() for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "k int, v double, i int").repartition(3)
    got = {r["k"]: r for r in stats.exact_means(df, ["k"], ["v", "i"]).collect()}
    for k, own in a.items():
        seen = [v for v in own if v is not None]
        want = None if not seen else math.fsum(seen) / len(seen) if all(map(math.isfinite, seen)) else sum(seen) / len(seen)
        v = got[k]["v"]
        assert got[k]["n"] == len(own)
        assert v == want or math.isnan(v) and math.isnan(want) or v == pytest.approx(want, rel=1e-15), (k, v, want)
    assert got[2]["i"] == 4.5 and got[6]["i"] is None
    empty = stats.exact_means(df.filter("k = 6"), ["k"], ["v"]).first()
    assert empty["v"] is None and empty["n"] == 1
