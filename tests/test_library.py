import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from winlaw.functions import losses, special, terms, theory
from winlaw.operators import classify, cluster, evaluate, laws, stats, windowing
from winlaw.sources import files, generators
from winlaw.streaming import online


@pytest.fixture(scope="module")
def two_laws(spark):
    p = generators.PROBLEMS["quadratic_pair"]
    return generators.windows(spark, p, 120, 40, 0.8).cache()


@pytest.fixture(scope="module")
def two_stats(two_laws):
    return stats.window_stats(two_laws, terms.library(["x1"], log=False, trig=False), "y", ["window_id", "label"]).cache()


def test_native_and_block_statistics_agree(two_laws, monkeypatch):
    basis = terms.library(["x1"])[:4]
    a = {r["window_id"]: r for r in stats.window_stats(two_laws, basis).collect()}
    monkeypatch.setattr(stats, "NATIVE_COLUMNS", 1)
    b = {r["window_id"]: r for r in stats.window_stats(two_laws, basis).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k]["n"] == b[k]["n"] and np.allclose(a[k]["g"], b[k]["g"]) and np.allclose(a[k]["a"], b[k]["a"]) and math.isclose(a[k]["yy"], b[k]["yy"])


def test_statistics_leave_out_nulls_and_take_empty_tables(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0), (1, None, 3.0), (1, 2.0, None)], "window_id long, x double, y double")
    got = stats.window_stats(rows, [("1", F.lit(1.0)), ("x", F.col("x"))]).collect()
    assert len(got) == 1 and got[0]["n"] == 1 and got[0]["g"] == [1.0, 1.0, 1.0, 1.0]
    assert stats.window_stats(rows.limit(0), [("x", F.col("x"))]).count() == 0


def test_profiled_rss_is_the_rss_with_a_free_level(two_laws):
    basis = [("1", F.lit(1.0)), ("x", F.col("x1")), ("x2", F.col("x1") * F.col("x1"))]
    s = stats.profile_level(stats.window_stats(two_laws, basis), 3)
    got = {r["window_id"]: r["rss"] for r in stats.law_rss(s, [[1.0, 1.0]]).collect()}
    pdf = two_laws.toPandas()
    for w, own in list(pdf.groupby("window_id"))[:10]:
        r = own["y"] - own["x1"] - own["x1"] ** 2
        assert math.isclose(got[w], float(((r - r.mean()) ** 2).sum()), rel_tol=1e-6)


@pytest.mark.parametrize("loop", [cluster.hard_loop, cluster.soft_em])
def test_laws_are_recovered(two_stats, loop):
    fit = loop(two_stats, cluster.mechanism_start(two_stats, 2))
    got = cluster.assign(two_stats, fit).join(two_stats.select("window_id", F.col("label").alias("truth")), "window_id")
    m = evaluate.clustering_metrics(got, "truth", "label")
    assert m["aligned_accuracy"] > 0.97 and m["ari"] > 0.9
    slopes = sorted(fit.coef[:, 1])
    assert abs(slopes[0] + 1) < 0.3 and abs(slopes[1] - 1) < 0.3


def test_student_t_em(spark):
    p = generators.PROBLEMS["sign"]
    w = generators.windows(spark, p, 60, 30, 0.7, kind="t3")
    s = stats.window_stats(w, [("1", F.lit(1.0)), ("x", F.col("x1"))], "y", ["window_id", "label"])
    start = cluster.mechanism_start(s, 2)
    fit, nu = cluster.student_t_em(w, [("1", F.lit(1.0)), ("x", F.col("x1"))], "y", start, max_iter=8)
    assert sorted(np.round(fit.coef[:, 1])) == [-1, 1] and (nu < 30).all()


def test_feature_clusterings(two_stats):
    f, m = stats.mechanism_features(two_stats)
    truth = two_stats.select("window_id", F.col("label").alias("truth"))
    ways = {"kmeans": cluster.kmeans(f, 2), "bisecting": cluster.bisecting(f, 2), "gmm": cluster.gmm(f, 2), "fuzzy": cluster.fuzzy_cmeans(f, 2)[1].select("window_id", "label")}
    got = {n: evaluate.aligned_accuracy(d.join(truth, "window_id"), "truth", "label") for n, d in ways.items()}
    assert min(got.values()) > 0.95, got
    assert 0.6 < stats.mechanism_noise(two_stats) < 1.0
    d = stats.separation_matrix(f, two_stats.select("window_id", "label"), m.shape[1], 0.8).first()["distance"]
    assert d > 5


def test_greedy_law(two_laws):
    got = laws.fit_laws_by(two_laws, "label", ["x1"])
    for k, slope in ((0, 1.0), (1, -1.0)):
        law = got[k]
        x = np.linspace(-2, 2, 9)
        names = dict(zip(law.names, law.coef, strict=True))
        assert names["x1^2"] == pytest.approx(1.0, abs=0.15) and names["x1"] == pytest.approx(slope, abs=0.3), (law.expression, x)


def test_fitted_frequency_and_superposition(spark):
    rows = spark.range(2000).select((generators.uniform(1, 1, "id") * 4 - 2).alias("x")).withColumn("y", F.sin(F.col("x") * 5.35) * 2 + 1 + 0.05 * F.randn(1))
    law = laws.fitted_frequency(rows, "x")
    assert any(n.startswith(("sin(5.3", "sin(5.4")) for n in law.names) and 1.9 < max(abs(law.coef)) < 2.1, law.expression
    parts = [laws.known_law("x^2", F.col("x") * F.col("x")), laws.known_law("sin", F.sin("x"))]
    both = rows.withColumn("y", 1.5 * F.col("x") * F.col("x") + 0.5 * F.sin("x") + 2)
    assert laws.superposition(both, parts).coef == pytest.approx([2, 1.5, 0.5])
    assert laws.superposition(rows.withColumn("y", F.col("x") * F.col("x")), parts) is None
    rest = laws.residual_law(both, 0.5 * F.sin("x"), ["x"], trig=False)
    assert dict(zip(rest.names, rest.coef, strict=True))["x^2"] == pytest.approx(1.5, abs=0.01)


def test_parametric_law():
    x = np.linspace(0, 4, 200)
    form = lambda x, t: t[0] * np.exp(-t[1] * x)
    got = laws.parametric_law(x, form(x, np.array([2.0, 0.7])), form, np.array([1.0, 1.0]))
    assert got == pytest.approx([2.0, 0.7], abs=1e-4)


def test_classifier_and_neighbours(two_stats, spark):
    model = classify.LawClassifier.fit(two_stats.filter("window_id % 2 = 0"), "label")
    got = model.predict(two_stats).join(two_stats.select("window_id", "label"), "window_id")
    assert classify.balanced_error(got, "label", "prediction") < 0.05
    more = classify.LawClassifier.fit(two_stats.withColumn("label", F.lit(0)).unionByName(two_stats.withColumn("label", F.lit(1))), "label", laws_per_class=2, priors="uniform")
    assert [len(f.coef) for f in more.laws] == [2, 2]
    v = spark.createDataFrame([(i, [float(i % 2), float(i)], i % 2) for i in range(20)], "k long, v array<double>, label int")
    near = classify.one_nn(v.filter("k < 10"), v.filter("k >= 10"), "v", "label", "k").collect()
    assert all(r["prediction"] == 1 for r in near)
    assert classify.few_shot(v, "label", "k", 3).count() == 6


def test_losses_and_scales(spark):
    r = spark.createDataFrame([(float(x),) for x in np.linspace(-6, 6, 41)], "r double")
    h = 1e-5
    for name in losses.LOSSES:
        f, psi, slope = losses.LOSSES[name], losses.PSI[name], losses.PSI_PRIME[name]
        got = r.filter("abs(abs(r) - 1.345) > 0.01 AND abs(abs(r) - 4.685) > 0.01 AND abs(r) > 0.01").select(psi(F.col("r")).alias("a"), ((f(F.col("r") + h) - f(F.col("r") - h)) / (2 * h)).alias("b"), slope(F.col("r")).alias("c"), ((psi(F.col("r") + h) - psi(F.col("r") - h)) / (2 * h)).alias("d")).toPandas()
        assert np.allclose(got["a"], got["b"], atol=1e-4) and np.allclose(got["c"], got["d"], atol=1e-4), name
    assert losses.robust_scale(r, "r").first()["scale"] == pytest.approx(1.4826 * 3.0, rel=0.02)
    flat = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "r double")
    assert losses.robust_scale(flat, "r").first()["scale"] == 1e-9
    t = spark.range(4000).select(generators.noise("t3", 1, 1, "id").alias("r"))
    assert losses.learn_loss(t, "r")["loss"] == "student_t"
    assert losses.learn_loss(spark.range(4000).select(generators.noise("laplace", 1, 1, "id").alias("r")), "r")["loss"] == "absolute"


def test_learned_loss_of_equal_residuals(spark):
    """A third of the rows share a value whose hash is least of all, so ordered by that they would fill the sample of the t."""
    c = spark.range(50_000).select((F.col("id") / 500_000.0 + 0.25).alias("c")).orderBy(F.xxhash64("c")).first()["c"]
    r = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(c)).otherwise(3 * generators.uniform(1, 1, "id") - 1.5).alias("r"))
    for key in (["id"], None):
        got = losses.learn_loss(r, "r", key=key)
        assert got["loss"] == "squared" and got["loglik"] == pytest.approx(-1.105, abs=0.001)


def test_bases(spark):
    df = spark.createDataFrame([(float(x),) for x in np.linspace(-1, 1, 50)], "x double")
    got = df.select(*[c.alias(f"c{i}") for i, (_, c) in enumerate(terms.legendre("x", 4, -1.0, 1.0))], "x").toPandas()
    assert np.allclose(got["c3"], (5 * got["x"] ** 3 - 3 * got["x"]) / 2)
    assert len(terms.library(["a", "b"])) == 1 + 14 + 1 and len(terms.fourier("x", 3)) == 7
    assert len(terms.make_basis("nystrom", "x", 6, df)) <= 7
    with pytest.raises(KeyError):
        terms.make_basis("none", "x", 3)
    assert terms.expression([1.0, -2.5, 0.0], ["1", "x", "x^2"]) == "1 -2.5*x"


def test_special_functions(spark):
    assert special.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert special.chi2_sf(special.chi2_isf(0.01, 32), 32) == pytest.approx(0.01, abs=1e-9)
    assert special.ncx2_sf(10.0, 4, 0.0) == pytest.approx(special.chi2_sf(10.0, 4))
    t = [-3.0, -0.5, 0.0, 1.0, 4.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in t], "t double").select(special.q_column(F.col("t"))).collect()]
    assert got == pytest.approx([special.q(x) for x in t], abs=2e-7)


def test_evaluation(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0), (1, 1)], "truth int, label int")
    m = evaluate.clustering_metrics(df, "truth", "label")
    assert m["aligned_accuracy"] == 0.8 and -1 <= m["ari"] <= 1 and 0 <= m["nmi"] <= 1
    same = evaluate.clustering_metrics(df.withColumn("label", 5 - F.col("truth")), "truth", "label")
    assert same["ari"] == pytest.approx(1) and same["nmi"] == pytest.approx(1)
    table = np.random.default_rng(0).integers(0, 50, (8, 8))
    from itertools import permutations

    assert sum(table[i, j] for i, j in enumerate(evaluate.mapping(table))) == max(sum(table[i, j] for i, j in enumerate(p)) for p in permutations(range(8)))


def test_gaps(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 3.0), ("a", 3, 0.0)], "k string, p int, v double")
    got = {r["p"]: r["v"] for r in windowing.impute_linear(rows, "k", "p", "v", 6).collect()}
    assert got == pytest.approx({0: 1.0, 1: 2.0, 2: 3.0, 3: 0.0, 4: 1 / 3, 5: 2 / 3})
    bins = spark.createDataFrame([(5.2, 0.1), (5.3, 0.2), (8.1, 0.5)], "x double, y double")
    b = {r["center"]: r["y"] for r in windowing.method_of_bins(bins, "x", "y").collect()}
    assert b[5.25] == pytest.approx(0.15) and 0.15 < b[6.75] < 0.5 and b[3.25] == pytest.approx(0.15) and b[14.75] == 0.5


def test_day_windows(spark):
    rows = [(f"2020-01-0{d}", h, 10 * h + d) for d in range(1, 6) for h in range(24) if (d, h) not in {(2, 3), (3, 3), (3, 4)}] + [("2020-01-01", 5, 51)]
    df = spark.createDataFrame(rows, "date string, hour int, count long")
    assert windowing.day_windows(df).select("date").distinct().count() == 3
    one = windowing.day_windows(df, max_missing=1)
    assert one.select("date").distinct().count() == 4
    assert one.groupBy("date").agg(F.sum("y").alias("s")).filter("abs(s) > 1e-9").count() == 0


def test_online_births_and_replay(spark):
    p = generators.Problem(("x1*x1 + x1", "x1*x1 - x1", "x1*x1 + 6*sin(2*x1)"))
    w = generators.windows(spark, p, 200, 32, 1.0).withColumn("label", F.col("label"))
    s = stats.window_stats(w, terms.library(["x1"], log=False), "y", ["window_id", "label"]).cache()
    known = stats.pooled(s.filter("label < 2 AND window_id < 60"), "label")
    got = online.replay(s.withColumn("stream_id", F.lit(1)), online.OnlineLaws().start(known)).toPandas()
    assert got["regimes"].max() == 3 and got["born"].sum() == 1
    truth = s.select("window_id", "label").orderBy("window_id").toPandas()["label"].to_numpy()
    after = got["t"].to_numpy() > int(got.loc[got["born"], "t"].iloc[0])
    assert (got["regime"].to_numpy()[after] == truth[after]).mean() > 0.95


def test_online_streaming_matches_replay(spark, two_stats, tmp_path):
    s = two_stats.withColumn("stream_id", F.col("window_id") % 2).drop("label")
    model = online.OnlineLaws().start(stats.pooled(two_stats.filter("window_id < 40"), "label"))
    src = str(tmp_path / "in")
    s.coalesce(1).write.parquet(src)
    q = online.stream_laws(spark.readStream.schema(s.schema).parquet(src), model).writeStream.format("memory").queryName("laws").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r["stream_id"], r["t"], r["regime"]) for r in df.collect())
    assert key(spark.table("laws")) == key(online.replay(s, model))


def test_windows_close_by_watermark(spark, tmp_path):
    rows = spark.range(240).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit(1).alias("stream_id"), (F.col("id") % 7).cast("double").alias("x"), F.lit(2.0).alias("y"))
    src = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(src)
    w = online.windows_by_time(spark.readStream.schema(rows.schema).parquet(src), [("1", F.lit(1.0)), ("x", F.col("x"))], "y", "stream_id", "ts", "1 hour", "0 seconds")
    q = w.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("closed").collect()
    assert len(got) == 3 and all(r["n"] == 60 and r["yy"] == 240.0 for r in got)


def test_cusum(spark):
    rows = spark.range(600).select(F.lit(0).alias("stream_id"), F.col("id").alias("t"), F.when(F.col("id") < 300, 0.0).otherwise(2.0).alias("m")).withColumn("y", F.col("m") + 0.8 * generators.normal(3, 1, "t"))
    got = online.cusum(rows, [F.lit(0.0), F.lit(2.0)], [1.0, 1.0], 6.0).toPandas().sort_values("t")
    assert (got["regime"].to_numpy() == (got["t"] >= 300)).mean() > 0.97 and got["switched"].sum() == 1
    first = online.first_alarm(rows, 2 * (F.col("y") - 1), 6.0, "stream_id", "t").first()
    assert first["alarm_at"] == int(got.loc[got["switched"], "t"].iloc[0])
    trace = rows.withColumn("truth", (F.col("t") >= 300).cast("int")).join(spark.createDataFrame(got[["t", "regime"]]), "t")
    assert online.detection_delays(trace, "truth", "regime", "stream_id", "t").first()["delay"] == int(got.loc[got["switched"], "t"].iloc[0]) - 300


def test_theory(spark):
    r = theory.simulated_error(spark, 4000, 24, 2 * F.col("x"), 6.0).first()
    assert r["error"] == pytest.approx(r["exact"], abs=0.02)
    lo, hi = theory.k_law_bounds(4, 1.0)
    assert lo <= theory.k_law_error(4, 1.0) <= hi and theory.k_law_error(2, 1.0) == pytest.approx(special.q(1.0), abs=1e-6)
    assert special.q(math.sqrt(theory.windows_needed(0.25, 0.05) * 0.25) / 2) == pytest.approx(0.05, abs=1e-9)
    gauss = lambda x: np.exp(-x * x / 2)
    assert theory.efficiency(lambda x: x, gauss, -12, 12) == pytest.approx(1.0, abs=1e-3)
    gap = np.sin(np.arange(24) / 4)
    ols, gls = theory.ar1_errors(gap, 1.0, 0.5)
    assert gls <= ols and theory.ar1_errors(gap, 1.0, 0.0)[0] == pytest.approx(theory.ar1_errors(gap, 1.0, 0.0)[1])
    assert theory.novelty_power(32, 1.0, 1e-3) > theory.novelty_power(32, 0.1, 1e-3) > 1e-3


def test_generators(spark):
    p = generators.PROBLEMS["quadratic_pair"]
    a, b = (generators.windows(spark, p, 10, 20, s).select("window_id", "t", "x1", "label").collect() for s in (0.1, 5.0))
    assert a == b
    for kind in ("gaussian", "laplace", "contaminated_10"):
        v = spark.range(20000).select(generators.noise(kind, 1, 1, "id").alias("e")).agg(F.var_pop("e")).first()[0]
        assert v == pytest.approx(1.0, abs=0.1)
    assert generators.parse_mixture("0.5*q - s", {"q": "x*x", "s": "sin(x)"}) == "0.5*(x*x) + -1*(sin(x))"
    rows = spark.range(600).select((F.col("id") / 200).cast("int").alias("w"), (F.col("id") % 200).alias("t"))
    e = generators.ar1(rows, "w", "t", 0.8, 1)
    acf = windowing.residual_acf(e, "w", "t", "e", 1).agg(F.avg("acf")).first()[0]
    assert e.count() == 600 and 0.55 < acf < 0.95


def test_series_and_verified_files(spark, tmp_path):
    f = tmp_path / "a.ts"
    f.write_text("@problem x\n# note\n@data\n1,2,?,4:up\n5,6,7,8:down\n")
    s = files.encode_labels(files.series(spark, str(f), "train"))
    assert s.filter("value IS NULL").count() == 1 and {r["code"] for r in s.collect()} == {0, 1}
    w = windowing.to_windows(s)
    assert w.count() == 7 and w.agg(F.max("x")).first()[0] == 1.0
    reg = str(tmp_path / "reg.json")
    files.verified(str(f), reg)
    f.write_text("other")
    with pytest.raises(ValueError):
        files.verified(str(f), reg)


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
