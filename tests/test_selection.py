import numpy as np
import pytest
from pyspark.sql import functions as F

from winlaw.functions import terms
from winlaw.operators import cluster, laws, selection, stats
from winlaw.sources import generators


@pytest.fixture(scope="module")
def rows(spark):
    return generators.windows(spark, generators.PROBLEMS["quadratic_pair"], 90, 30, 0.6).cache()


@pytest.fixture(scope="module")
def own(rows):
    basis = [("1", F.lit(1.0)), ("x", F.col("x1")), ("x2", F.col("x1") * F.col("x1"))]
    return stats.window_stats(rows, basis, "y", ["window_id", "label"]).cache()


def test_leave_one_out_matches_refits(rows):
    basis = [("1", F.lit(1.0)), ("x", F.col("x1"))]
    got = {r["window_id"]: r["loo"] for r in selection.loo_error(rows, basis).collect()}
    pdf = rows.filter("window_id = 3").toPandas()
    b, y = np.stack([np.ones(len(pdf)), pdf["x1"]], 1), pdf["y"].to_numpy()
    e = [y[i] - b[i] @ np.linalg.lstsq(np.delete(b, i, 0), np.delete(y, i), rcond=None)[0] for i in range(len(y))]
    assert got[3] == pytest.approx(np.mean(np.square(e)))
    assert selection.loo_error(rows.filter("t < 3"), basis).count() == 0


def test_rank_and_count(rows, own):
    size, log = selection.select_rank(rows, lambda k: terms.legendre("x1", k, -2.0, 2.0), [2, 3, 6])
    assert size == 3 and len(log) == 3
    assert selection.select_count(own.drop("label"), [1, 2, 3])[0] == 2


def test_crossfit(own):
    got = selection.crossfit_rss(own, own.select("window_id", "label")).toPandas().merge(own.select("window_id", "label").toPandas(), on="window_id")
    assert len(got) == 180
    plain = cluster.laws_of_labels(own, own.select("window_id", "label"), 2)
    same = stats.law_rss(own, [list(v) for v in plain.coef]).toPandas().merge(got, on=["window_id", "k"])
    mine = same["k"] == same["label"]
    assert np.allclose(same.loc[~mine, "rss_x"], same.loc[~mine, "rss_y"]) and same.loc[mine, "rss_y"].sum() > same.loc[mine, "rss_x"].sum()


def test_corruption_loop_and_refinement(own):
    truth = own.select("window_id", "label")
    bad = selection.corrupt_labels(truth, 0.3, 2)
    before, after = selection.loop_gain(own, bad, 2, truth)
    assert 0.15 < before < 0.45 and after < 0.05
    fit = cluster.laws_of_labels(own, bad, 2)
    basis = [("1", F.lit(1.0)), ("x", F.col("x1")), ("x2", F.col("x1") * F.col("x1"))]
    better, log = selection.refine(own, fit, lambda n, g, a, yy: laws.greedy_law(n, g, a, yy, basis).coef, truth)
    assert all(r["replaced"] for r in log) and sorted(np.round(better.coef[:, 1])) == [-1, 1]
