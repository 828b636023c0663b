"""Queries over the driver's tables; each SQL gives the same rows in DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import losses, terms, theory
from ..operators import classify, cluster, evaluate, laws, selection, stats, windowing
from ..session import table
from ..sources import generators
from ..streaming import online
from .catalog import query
from .views import DAYS, PLANTED, event_days, planted

LAWS = [[0.0, 1.0, 1.0], [0.0, -1.0, 1.0]]


def _quadratic(column: str = "x") -> terms.Basis:
    x = F.col(column)
    return [("1", F.lit(1.0)), (column, x), (f"{column}^2", x * x)]


def _r(c, d: int = 6):
    return F.round(c, d)


STATS_SQL = "SELECT window_id, label, count(*) AS n, sum(1) AS g00, sum(x) AS g01, sum(x*x) AS g02, sum(x*x*x) AS g12, sum(x*x*x*x) AS g22, sum(y) AS a0, sum(x*y) AS a1, sum(x*x*y) AS a2, sum(y*y) AS yy FROM w GROUP BY window_id, label"


def _stats(spark: SparkSession, sf_dir: str, sigma: float = 1.0, by_line: bool = False) -> DataFrame:
    return stats.window_stats(planted(spark, sf_dir, sigma, by_line), _quadratic(), "y", ["window_id", "label"])


# ---- statistics


@query("window_stats", f"WITH {PLANTED.format(sigma=1)} SELECT window_id, count(*) AS n, round(sum(x), 4) AS gx, round(sum(x*x), 4) AS gxx, round(sum(x*x*x*x), 4) AS gx4, round(sum(y), 4) AS ay, round(sum(x*y), 4) AS axy, round(sum(y*y), 4) AS yy FROM w GROUP BY window_id")
def q_stats(spark, sf_dir):
    s = _stats(spark, sf_dir)
    return s.select("window_id", "n", _r(F.col("g")[1], 4).alias("gx"), _r(F.col("g")[2], 4).alias("gxx"), _r(F.col("g")[8], 4).alias("gx4"), _r(F.col("a")[0], 4).alias("ay"), _r(F.col("a")[1], 4).alias("axy"), _r("yy", 4).alias("yy"))


@query("window_stats_cosine", f"WITH {PLANTED.format(sigma=1)}, c AS (SELECT window_id, y, (x + 2) / 4.0 AS u FROM w) SELECT window_id, count(*) AS n, round(sum(cos(pi()*u)), 4) AS g1, round(sum(cos(pi()*u)*cos(2*pi()*u)), 4) AS g12, round(sum(cos(2*pi()*u)*y), 4) AS a2 FROM c GROUP BY window_id")
def q_cosine(spark, sf_dir):
    s = stats.window_stats(planted(spark, sf_dir), terms.cosine("x", 3, -2.0, 2.0), "y", ["window_id"])
    return s.select("window_id", "n", _r(F.col("g")[1], 4).alias("g1"), _r(F.col("g")[5], 4).alias("g12"), _r(F.col("a")[2], 4).alias("a2"))


@query("level_profile", f"WITH {PLANTED.format(sigma=1)}, t AS ({STATS_SQL}) SELECT window_id, n - 1 AS n, round((g02 - g01*g01/n), 4) AS g11, round(g12 - g01*g02/n, 4) AS g12, round(g22 - g02*g02/n, 4) AS g22, round(a1 - g01*a0/n, 4) AS a1, round(yy - a0*a0/n, 4) AS yy FROM t")
def q_level(spark, sf_dir):
    s = stats.profile_level(_stats(spark, sf_dir), 3)
    return s.select("window_id", "n", _r(F.col("g")[0], 4).alias("g11"), _r(F.col("g")[1], 4).alias("g12"), _r(F.col("g")[3], 4).alias("g22"), _r(F.col("a")[0], 4).alias("a1"), _r("yy", 4).alias("yy"))


@query("law_rss", f"WITH {PLANTED.format(sigma=1)} SELECT window_id, k, round(sum(CASE WHEN k = 0 THEN (y - x*x - x)*(y - x*x - x) ELSE (y - x*x + x)*(y - x*x + x) END), 4) AS rss, count(*) AS n FROM w, (SELECT unnest([0, 1]) AS k) GROUP BY window_id, k")
def q_rss(spark, sf_dir):
    return stats.law_rss(_stats(spark, sf_dir), LAWS).withColumn("rss", _r("rss", 4))


@query("nearest_law_assign", f"WITH {PLANTED.format(sigma=6)}, c AS (SELECT window_id, label, sum((y - x*x - x)*(y - x*x - x)) AS r0, sum((y - x*x + x)*(y - x*x + x)) AS r1 FROM w GROUP BY window_id, label) SELECT window_id, label AS truth, CASE WHEN r0 <= r1 THEN 0 ELSE 1 END AS label FROM c")
def q_nearest(spark, sf_dir):
    return stats.nearest_law(_stats(spark, sf_dir, 6.0), LAWS, ["window_id", F.col("label").alias("truth")]).select("window_id", "truth", "label")


@query("window_features", f"WITH {PLANTED.format(sigma=1)}, l AS (SELECT *, abs(y - lag(y) OVER (PARTITION BY window_id ORDER BY t)) AS d FROM w) SELECT window_id, round(avg(y), 6) AS y_mean, round(stddev_pop(y), 6) AS y_std, round(min(y), 6) AS y_min, round(max(y), 6) AS y_max, round(coalesce(avg(d), 0), 6) AS mean_step, round(avg(x*y), 6) AS mean_xy, round(quantile_cont(y, 0.9) - quantile_cont(y, 0.1), 6) AS spread FROM l GROUP BY window_id")
def q_features(spark, sf_dir):
    f = windowing.window_features(planted(spark, sf_dir), "window_id", "t", "x", "y")
    return f.select("window_id", *[_r(c).alias(c) for c in f.columns if c != "window_id"])


@query("robust_scale", f"WITH {PLANTED.format(sigma=1)}, m AS (SELECT window_id, median(y) AS m FROM w GROUP BY window_id) SELECT window_id, round(1.4826 * median(abs(y - m)), 6) AS scale FROM w JOIN m USING (window_id) GROUP BY window_id")
def q_scale(spark, sf_dir):
    return losses.robust_scale(planted(spark, sf_dir), "y", ["window_id"]).withColumn("scale", _r("scale"))


LOSS_SQL = {
    "squared": "0.5*r*r", "absolute": "abs(r)", "huber": "CASE WHEN abs(r) <= 1.345 THEN 0.5*r*r ELSE 1.345*(abs(r) - 0.6725) END",
    "cauchy": "0.5*2.3849*2.3849*ln(1 + (r/2.3849)*(r/2.3849))", "student_t": "2.5*ln(1 + r*r/4)",
    "tukey": "CASE WHEN abs(r) <= 4.685 THEN 4.685*4.685/6*(1 - power(1 - (r/4.685)*(r/4.685), 3)) ELSE 4.685*4.685/6 END",
}


@query("loss_influence", "WITH r AS (SELECT DISTINCT round((l_quantity - 25.5) / 4, 3) AS r FROM lineitem) SELECT r, round(greatest(-1.345, least(1.345, r)), 6) AS huber, round(r / (1 + (r/2.3849)*(r/2.3849)), 6) AS cauchy, round(CASE WHEN abs(r) <= 4.685 THEN r*power(1 - (r/4.685)*(r/4.685), 2) ELSE 0 END, 6) AS tukey, round(5*r/(4 + r*r), 6) AS student_t FROM r")
def q_influence(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.round((F.col("l_quantity") - 25.5) / 4, 3).alias("r")).distinct()
    return r.select("r", *[_r(losses.PSI[n](F.col("r"))).alias(n) for n in ("huber", "cauchy", "tukey", "student_t")])


@query("learned_loss")
def q_learned(spark, sf_dir):
    r = planted(spark, sf_dir).select("window_id", "t", (F.col("y") - F.col("x") * F.col("x") - F.when(F.col("label") == 0, F.col("x")).otherwise(-F.col("x"))).alias("r"))
    got = losses.learn_loss(r, "r", key=["window_id", "t"])
    return spark.createDataFrame([(got["loss"], float(got["scale"]), float(got["loglik"]))], "loss string, scale double, loglik double")


# ---- laws and clustering


@query("supplier_laws", f"WITH {PLANTED.format(sigma=1)} SELECT window_id, round(regr_slope(y - x*x, x), 5) AS slope, round(regr_intercept(y - x*x, x), 5) AS level, round(regr_r2(y - x*x, x), 5) AS r2 FROM w GROUP BY window_id")
def q_supplier_laws(spark, sf_dir):
    s = planted(spark, sf_dir).withColumn("z", F.col("y") - F.col("x") * F.col("x"))
    return s.groupBy("window_id").agg(_r(F.regr_slope("z", "x"), 5).alias("slope"), _r(F.regr_intercept("z", "x"), 5).alias("level"), _r(F.regr_r2("z", "x"), 5).alias("r2"))


@query("greedy_laws")
def q_greedy(spark, sf_dir):
    got = laws.fit_laws_by(planted(spark, sf_dir, 0.2), "label", ["x"])
    return spark.createDataFrame([(int(k), v.expression, float(v.complexity)) for k, v in sorted(got.items())], "label int, expression string, complexity double")


@query("fitted_frequency")
def q_frequency(spark, sf_dir):
    s = planted(spark, sf_dir).select("x", (F.sin(3.7 * F.col("x")) * 2 + 0.1 * F.col("y")).alias("y"))
    law = laws.fitted_frequency(s, "x")
    return spark.createDataFrame([(law.expression, float(law.complexity))], "expression string, complexity double")


@query("superposed_law")
def q_superposed(spark, sf_dir):
    s = planted(spark, sf_dir).select("x", (F.col("x") * F.col("x") * 1.5 + 0.5 * F.sin("x") + 2).alias("y"))
    parts = [laws.known_law("x^2", F.col("x") * F.col("x")), laws.known_law("sin", F.sin("x"))]
    law = laws.superposition(s, parts)
    return spark.createDataFrame([(law.expression if law else None,)], "expression string")


def _scored(spark, df: DataFrame) -> DataFrame:
    m = evaluate.clustering_metrics(df, "truth", "label")
    return spark.createDataFrame([(float(m["ari"]), float(m["nmi"]), float(m["aligned_accuracy"]))], "ari double, nmi double, aligned_accuracy double")


@query("hard_law_clusters")
def q_hard(spark, sf_dir):
    s = _stats(spark, sf_dir, 3.0, True).cache()
    fit = cluster.hard_loop(s, cluster.mechanism_start(s, 2))
    return _scored(spark, cluster.assign(s, fit).join(s.select("window_id", F.col("label").alias("truth")), "window_id"))


@query("soft_law_clusters")
def q_soft(spark, sf_dir):
    s = _stats(spark, sf_dir, 3.0, True).cache()
    fit = cluster.soft_em(s, cluster.mechanism_start(s, 2), temperature=4.0, anneal=5)
    return _scored(spark, cluster.assign(s, fit).join(s.select("window_id", F.col("label").alias("truth")), "window_id"))


@query("feature_clusters")
def q_feature_clusters(spark, sf_dir):
    s = _stats(spark, sf_dir, 3.0, True).cache()
    f, _ = stats.mechanism_features(s)
    f, truth = f.cache(), s.select("window_id", F.col("label").alias("truth"))
    ways = {"kmeans": cluster.kmeans(f, 2), "gmm": cluster.gmm(f, 2), "bisecting": cluster.bisecting(f, 2), "fuzzy": cluster.fuzzy_cmeans(f, 2)[1].select("window_id", "label")}
    rows = [(n, float(evaluate.aligned_accuracy(d.join(truth, "window_id"), "truth", "label"))) for n, d in ways.items()]
    return spark.createDataFrame(rows, "method string, aligned_accuracy double")


@query("soft_em_step", f"WITH {PLANTED.format(sigma=6)}, c AS (SELECT window_id, count(*) AS n, sum((y - x*x - x)*(y - x*x - x)) AS r0, sum((y - x*x + x)*(y - x*x + x)) AS r1 FROM w GROUP BY window_id) SELECT window_id, round(1 / (1 + exp((r0 - r1) / (2*3.5*3.5))), 4) AS p0 FROM c")
def q_em_step(spark, sf_dir):
    import numpy as np

    s = _stats(spark, sf_dir, 6.0)
    fit = cluster.LawFit(np.array(LAWS), np.array([3.5, 3.5]), np.array([0.5, 0.5]), [])
    return cluster.assign(s, fit).select("window_id", _r(F.col("posterior")[0], 4).alias("p0"))


@query("law_count")
def q_count(spark, sf_dir):
    k, log = selection.select_count(_stats(spark, sf_dir, 3.0, True).drop("label").cache(), [1, 2, 3])
    return spark.createDataFrame([(r["k"], float(r["loglik"]), float(r["bic"]), r["k"] == k) for r in log], "k int, loglik double, bic double, chosen boolean")


@query("loop_gain")
def q_gain(spark, sf_dir):
    s = _stats(spark, sf_dir, 3.0, True).cache()
    truth = s.select("window_id", "label")
    before, after = selection.loop_gain(s, selection.corrupt_labels(truth, 0.3, 2), 2, truth)
    return spark.createDataFrame([(float(before), float(after))], "before double, after double")


# ---- classification


@query("nearest_centroid", "WITH e AS (SELECT vec_id, label, embedding FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM e WHERE vec_id % 100 <> 0) GROUP BY label, i), q AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM e WHERE vec_id % 100 = 0), d AS (SELECT vec_id, label, sum((v - m)*(v - m)) AS d FROM q JOIN m USING (i) GROUP BY vec_id, label) SELECT vec_id, arg_min(label, d) AS prediction FROM d GROUP BY vec_id")
def q_centroid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return classify.nearest_centroid(e.filter("vec_id % 100 <> 0"), e.filter("vec_id % 100 = 0"), "embedding", "label", "vec_id")


@query("one_nn", "WITH q AS (SELECT vec_id AS q, embedding AS a FROM embeddings WHERE vec_id % 100 = 0), t AS (SELECT vec_id, label, embedding AS b FROM embeddings WHERE vec_id % 100 <> 0), d AS (SELECT q, vec_id, label, list_sum(list_transform(list_zip(a, b), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM q, t) SELECT q AS vec_id, arg_min(label, (d, vec_id)) AS prediction, round(sqrt(min(d)), 4) AS distance FROM d GROUP BY q")
def q_one_nn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return classify.one_nn(e.filter("vec_id % 100 <> 0"), e.filter("vec_id % 100 = 0"), "embedding", "label", "vec_id").withColumn("distance", _r("distance", 4))


# ---- evaluation


@query("contingency", f"WITH {PLANTED.format(sigma=6)}, c AS (SELECT window_id, label AS truth, sum((y - x*x - x)*(y - x*x - x)) AS r0, sum((y - x*x + x)*(y - x*x + x)) AS r1 FROM w GROUP BY window_id, label) SELECT truth, CASE WHEN r0 <= r1 THEN 0 ELSE 1 END AS label, count(*) AS n FROM c GROUP BY ALL")
def q_contingency(spark, sf_dir):
    return evaluate.contingency(q_nearest(spark, sf_dir), "truth", "label")


@query("regression_metrics", f"WITH {PLANTED.format(sigma=1)} SELECT label, round(avg((y - x*x)*(y - x*x)), 6) AS mse, round(avg(abs(y - x*x)), 6) AS mae, round(avg((y - x*x)*(y - x*x)) / var_pop(y), 6) AS nmse FROM w GROUP BY label")
def q_regression(spark, sf_dir):
    s = planted(spark, sf_dir).withColumn("f", F.col("x") * F.col("x"))
    m = evaluate.regression_metrics(s, "y", "f", ["label"])
    return m.select("label", *[_r(c).alias(c) for c in ("mse", "mae", "nmse")])


@query("spearman", "WITH r AS (SELECT l_quantity, l_extendedprice, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 5) AS rho FROM r")
def q_spearman(spark, sf_dir):
    rho = evaluate.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return spark.range(1).select(F.round(F.lit(rho), 5).alias("rho"))


@query("calibration", "SELECT CASE WHEN l_discount <= 0.025 THEN 0 WHEN l_discount <= 0.055 THEN 1 ELSE 2 END AS bin, count(*) AS n, round(avg(l_discount), 6) AS predicted, round(avg(l_tax), 6) AS observed FROM lineitem WHERE l_discount > -1 AND l_discount <= 1 GROUP BY 1")
def q_calibration(spark, sf_dir):
    c = evaluate.calibration(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", [-1.0, 0.025, 0.055, 1.0])
    return c.select("bin", "n", _r("predicted").alias("predicted"), _r("observed").alias("observed"))


@query("majority_map", "WITH n AS (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_linestatus, l_returnflag FROM n QUALIFY row_number() OVER (PARTITION BY l_linestatus ORDER BY n DESC, l_returnflag) = 1")
def q_majority(spark, sf_dir):
    return evaluate.majority_map(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag")


@query("binary_metrics", "WITH b AS (SELECT (l_discount > 0.05)::INT AS t, (l_tax > 0.04)::INT AS p FROM lineitem), s AS (SELECT count(*) FILTER (t = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (t = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (t = 1 AND p = 0)::DOUBLE AS fn, count(*) FILTER (t = 0 AND p = 0)::DOUBLE AS tn FROM b) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((tp*tn - fp*fn) / sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)), 6) AS mcc FROM s")
def q_binary(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").select((F.col("l_discount") > 0.05).cast("int").alias("t"), (F.col("l_tax") > 0.04).cast("int").alias("p"))
    m = evaluate.binary_metrics(b, "t", "p")
    return m.select("tp", "fp", "fn", "tn", _r("accuracy").alias("accuracy"), _r("mcc").alias("mcc"))


# ---- windowing and gaps


@query("day_windows", f"WITH {DAYS}, h AS (SELECT event_type, day, hour, count(*) AS c FROM d GROUP BY ALL), k AS (SELECT event_type, day FROM h GROUP BY ALL HAVING count(*) >= 4), g AS (SELECT event_type, day, unnest(range(24)) AS hour FROM k), f AS (SELECT g.event_type, g.day, g.hour, ln(1 + coalesce(c, 0)) AS y FROM g LEFT JOIN h ON g.event_type = h.event_type AND g.day = h.day AND g.hour = h.hour) SELECT event_type || ' ' || day AS day, hour::INT AS hour, round(hour * (2*pi()/24), 6) AS x, round(y - avg(y) OVER (PARTITION BY event_type, day), 6) AS y FROM f")
def q_days(spark, sf_dir):
    e = event_days(spark, sf_dir).groupBy("event_type", "day", "hour").agg(F.count("*").alias("count"))
    rows = e.select(F.concat_ws(" ", "event_type", F.col("day").cast("string")).alias("day"), "hour", "count")
    w = windowing.day_windows(rows, "day", "hour", "count", max_missing=20)
    return w.select("day", F.col("hour").cast("int").alias("hour"), _r("x").alias("x"), _r("y").alias("y"))


@query("event_window_stats", f"WITH {DAYS} SELECT event_type, day::VARCHAR AS day, count(*) AS n, round(sum(sin(x)), 4) AS gs, round(sum(sin(x)*cos(x)), 4) AS gsc, round(sum(cos(x)*y), 4) AS ac, round(sum(y*y), 4) AS yy FROM d GROUP BY event_type, day")
def q_event_stats(spark, sf_dir):
    s = stats.window_stats(event_days(spark, sf_dir), terms.fourier("x", 1), "y", ["event_type", "day"])
    return s.select("event_type", F.col("day").cast("string").alias("day"), "n", _r(F.col("g")[1], 4).alias("gs"), _r(F.col("g")[5], 4).alias("gsc"), _r(F.col("a")[2], 4).alias("ac"), _r("yy", 4).alias("yy"))


@query("hour_mean_impute", f"WITH {DAYS}, h AS (SELECT event_type AS k, hour::INT AS hour, avg(y) AS y FROM d WHERE hour % 3 <> 0 OR event_type < 'm' GROUP BY ALL), m AS (SELECT hour, avg(y) AS m FROM h GROUP BY hour), l AS (SELECT k, avg(y - m) AS d FROM h JOIN m USING (hour) GROUP BY k), g AS (SELECT k, d, unnest(range(24))::INT AS hour FROM l) SELECT g.k AS event_type, g.hour, round(coalesce(h.y, m + d), 6) AS y FROM g LEFT JOIN h ON h.k = g.k AND h.hour = g.hour LEFT JOIN m ON m.hour = g.hour")
def q_impute_mean(spark, sf_dir):
    e = event_days(spark, sf_dir).filter("hour % 3 <> 0 OR event_type < 'm'").groupBy("event_type", "hour").agg(F.avg("y").alias("y"))
    return windowing.impute_mean(e, "event_type", "hour", "y", 24).withColumn("y", _r("y"))


@query("linear_impute", f"WITH {DAYS}, h AS (SELECT event_type AS k, hour::INT AS hour, avg(y) AS y FROM d WHERE hour % 4 = 1 GROUP BY ALL), t AS (SELECT k, hour + o * 24 AS p, y FROM h, (SELECT unnest([-1, 0, 1]) AS o)), g AS (SELECT DISTINCT k, unnest(range(24))::INT AS hour FROM h), n AS (SELECT g.k, g.hour, max(a.p) AS pa, arg_max(a.y, a.p) AS ya FROM g JOIN t a ON a.k = g.k AND a.p <= g.hour GROUP BY ALL), m AS (SELECT g.k, g.hour, min(b.p) AS pb, arg_min(b.y, b.p) AS yb FROM g JOIN t b ON b.k = g.k AND b.p >= g.hour GROUP BY ALL) SELECT n.k AS event_type, n.hour, round(CASE WHEN pa = pb THEN ya ELSE ya + (yb - ya) * (n.hour - pa) / (pb - pa) END, 6) AS y FROM n JOIN m ON n.k = m.k AND n.hour = m.hour")
def q_impute_linear(spark, sf_dir):
    e = event_days(spark, sf_dir).filter("hour % 4 = 1").groupBy("event_type", "hour").agg(F.avg("y").alias("y"))
    return windowing.impute_linear(e, "event_type", "hour", "y", 24).withColumn("y", _r("y"))


@query("method_of_bins", "WITH b AS (SELECT l_linenumber, floor((l_quantity / 4 - 3) / 0.5)::INT AS bin, avg(l_extendedprice) AS m FROM lineitem WHERE l_quantity / 4 >= 3 AND l_quantity / 4 < 15 AND l_quantity % 5 <> 0 GROUP BY ALL), g AS (SELECT DISTINCT l_linenumber, unnest(range(24))::INT AS bin FROM b), p AS (SELECT g.l_linenumber, g.bin, max(b.bin) FILTER (b.bin <= g.bin) AS ba, arg_max(m, b.bin) FILTER (b.bin <= g.bin) AS ma, min(b.bin) FILTER (b.bin >= g.bin) AS bb, arg_min(m, b.bin) FILTER (b.bin >= g.bin) AS mb FROM g JOIN b ON b.l_linenumber = g.l_linenumber GROUP BY ALL) SELECT l_linenumber, bin, round(bin * 0.5 + 3.25, 4) AS center, round(CASE WHEN ba IS NULL THEN mb WHEN bb IS NULL OR bb = ba THEN ma ELSE ma + (mb - ma) * (bin - ba) / (bb - ba) END, 3) AS y FROM p")
def q_bins(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").filter("l_quantity % 5 <> 0").withColumn("ws", F.col("l_quantity") / 4)
    b = windowing.method_of_bins(r, "ws", "l_extendedprice", by=["l_linenumber"])
    return b.select("l_linenumber", "bin", _r("center", 4).alias("center"), _r("y", 3).alias("y"))


@query("residual_acf", f"WITH {PLANTED.format(sigma=1)}, r AS (SELECT window_id, t, y - x*x AS r FROM w), l AS (SELECT *, lag(r, 1) OVER o AS l1, lag(r, 2) OVER o AS l2 FROM r WINDOW o AS (PARTITION BY window_id ORDER BY t)) SELECT window_id, k AS lag, round(CASE WHEN k = 1 THEN sum(r*l1) ELSE sum(r*l2) END / sum(r*r), 5) AS acf FROM l, (SELECT unnest([1, 2]) AS k) GROUP BY window_id, k")
def q_acf(spark, sf_dir):
    r = planted(spark, sf_dir).withColumn("r", F.col("y") - F.col("x") * F.col("x"))
    return windowing.residual_acf(r, "window_id", "t", "r", 2).withColumn("acf", _r("acf", 5))


@query("whitened", f"WITH {PLANTED.format(sigma=1)}, l AS (SELECT window_id, t, y, lag(y) OVER (PARTITION BY window_id ORDER BY t) AS b FROM w) SELECT window_id, t, round(CASE WHEN b IS NULL THEN y * sqrt(1 - 0.36) ELSE y - 0.6 * b END, 5) AS y FROM l")
def q_whiten(spark, sf_dir):
    return windowing.whiten(planted(spark, sf_dir).select("window_id", "t", "y"), "window_id", "t", "y", 0.6).withColumn("y", _r("y", 5))


@query("near_pairs", "WITH p AS (SELECT s_suppkey AS k, s_nationkey AS n, (s_suppkey * 37 % 100)::DOUBLE AS x, (s_suppkey * 59 % 100)::DOUBLE AS y FROM supplier), b AS (SELECT a.k, ((degrees(atan2(b.x - a.x, b.y - a.y)) + 360) % 360 + 360) % 360 AS v FROM p a JOIN p b ON a.k <> b.k AND a.n = b.n), r AS (SELECT l_suppkey AS k, l_orderkey, l_linenumber, (l_partkey * 7 % 360)::DOUBLE AS dir FROM lineitem) SELECT k, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM b WHERE b.k = r.k AND abs((dir - v + 540) % 360 - 180) < 15)) AS waked FROM r GROUP BY k")
def q_waked(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), (F.col("s_suppkey") * 37 % 100).cast("double").alias("x"), (F.col("s_suppkey") * 59 % 100).cast("double").alias("y"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") * 7 % 360).cast("double").alias("dir"))
    w = windowing.waked(p, r, F.col("a.n") == F.col("b.n"), "x", "y", "k", "dir")
    return w.groupBy("k").agg(F.count("*").alias("n"), F.count(F.when(F.col("waked"), 1)).alias("waked"))


# ---- relational shapes


@query("mask_semi_join", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def q_semi(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").filter("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("mask_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def q_anti(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").filter("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("set_operations", "SELECT 'both' AS what, count(*) AS n FROM (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09) UNION ALL SELECT 'only', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 30 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09) UNION ALL SELECT 'any', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 UNION SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def q_sets(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    low = t.filter("l_discount > 0.09")
    parts = {"both": t.filter("l_quantity > 49").select("l_suppkey").intersect(low.select("l_suppkey")), "only": t.filter("l_quantity > 30").select("l_partkey").subtract(low.select("l_partkey")), "any": t.filter("l_quantity > 49").select("l_partkey").union(low.select("l_partkey")).distinct()}
    out = None
    for n, d in parts.items():
        own = d.agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), "n")
        out = own if out is None else out.unionByName(own)
    return out


@query("summary_rollup", "SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, round(avg(l_quantity), 5) AS mean, round(stddev_samp(l_quantity), 5) AS sd, min(l_quantity) AS lo, max(l_quantity) AS hi, median(l_quantity) AS mid FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def q_rollup(spark, sf_dir):
    q = F.col("l_quantity")
    g = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), _r(F.avg(q), 5).alias("mean"), _r(F.stddev_samp(q), 5).alias("sd"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.percentile(q, F.lit(0.5)).alias("mid"))
    return g.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "mean", "sd", "lo", "hi", "mid")


@query("summary_pivot", "SELECT l_linenumber, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 2) AS \"A\", round(sum(l_quantity) FILTER (l_returnflag = 'N'), 2) AS \"N\", round(sum(l_quantity) FILTER (l_returnflag = 'R'), 2) AS \"R\" FROM lineitem GROUP BY l_linenumber")
def q_pivot(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.sum("l_quantity"), 2))


@query("latest_per_group", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q_latest(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).filter("r = 1").select("user_id", "event_id", "event_type")


@query("rolling_mean", "WITH d AS (SELECT event_type, ts::DATE AS day, avg(value) AS v FROM events GROUP BY ALL), r AS (SELECT event_type, day, avg(v) OVER o AS m, count(*) OVER o AS c FROM d WINDOW o AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) SELECT event_type, day::VARCHAR AS day, round(CASE WHEN c >= 3 THEN m END, 5) AS m FROM r")
def q_rolling(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-6, 0)
    return d.select("event_type", F.col("day").cast("string").alias("day"), F.when(F.count("*").over(w) >= 3, _r(F.avg("v").over(w), 5)).alias("m"))


# ---- sequences


@query("cusum_first_alarm", f"WITH e AS (SELECT user_id, event_id, ts, ln(1 + value) - 3.6 AS z FROM events), c AS (SELECT *, sum(z) OVER o AS c, row_number() OVER o AS i FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), s AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)) AS s FROM c) SELECT user_id, min(i) FILTER (s > 3) AS alarm_at, round(max(s), 5) AS top FROM s GROUP BY user_id")
def q_alarm(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    return online.first_alarm(e, F.log1p("value") - 3.6, 3.0, "user_id", "i").withColumn("top", _r("top", 5))


@query("online_timeline")
def q_online(spark, sf_dir):
    s = _stats(spark, sf_dir, 1.0, True).cache()
    model = online.OnlineLaws(forgetting=0.98).start(stats.pooled(s.filter("window_id % 10 = 1"), "label"))
    return online.replay(s.withColumn("stream_id", F.floor(F.col("window_id") / 10)), model)


@query("prefix_law", f"WITH {PLANTED.format(sigma=1)}, p AS (SELECT window_id, t, sum((y - x*x)*x) OVER o AS a, sum(x*x) OVER o AS g, row_number() OVER o AS i FROM w WINDOW o AS (PARTITION BY window_id ORDER BY t ROWS UNBOUNDED PRECEDING)) SELECT window_id, i, round(a / g, 5) AS slope FROM p WHERE i IN (8, 16, 32, 64)")
def q_prefix(spark, sf_dir):
    s = planted(spark, sf_dir)
    o = Window.partitionBy("window_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    z = (F.col("y") - F.col("x") * F.col("x")) * F.col("x")
    p = s.select("window_id", F.sum(z).over(o).alias("a"), F.sum(F.col("x") * F.col("x")).over(o).alias("g"), F.row_number().over(Window.partitionBy("window_id").orderBy("t")).alias("i"))
    return p.filter("i IN (8, 16, 32, 64)").select("window_id", F.col("i").cast("long").alias("i"), _r(F.col("a") / F.col("g"), 5).alias("slope"))


# ---- theory


@query("cusum_formulas", "WITH r AS (SELECT DISTINCT l_discount * 10 + 0.1 AS rho, (l_linenumber + 2)::DOUBLE AS h FROM lineitem), b AS (SELECT rho, h, h + 2*0.5826*sqrt(rho) AS b FROM r) SELECT round(rho, 4) AS rho, h, round((b + exp(-b) - 1) / (rho / 2), 4) AS delay, round((exp(b) - b - 1) / (rho / 2), 2) AS arl FROM b")
def q_formulas(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10 + 0.1).alias("rho"), (F.col("l_linenumber") + 2).cast("double").alias("h")).distinct()
    return r.select(_r("rho", 4).alias("rho"), "h", _r(theory.cusum_delay(F.col("rho"), F.col("h")), 4).alias("delay"), _r(theory.cusum_arl(F.col("rho"), F.col("h")), 2).alias("arl"))


Q_SQL = "0.5 * ((0.254829592*u - 0.284496736*u*u + 1.421413741*u*u*u - 1.453152027*u*u*u*u + 1.061405429*u*u*u*u*u) * exp(-z*z))"


@query("two_law_error", f"WITH r AS (SELECT DISTINCT l_quantity AS n, l_discount + 0.01 AS rho FROM lineitem), s AS (SELECT n, rho, sqrt(n*rho)/2/sqrt(2) AS z, 1/(1 + 0.3275911*sqrt(n*rho)/2/sqrt(2)) AS u FROM r) SELECT n, round(rho, 4) AS rho, round({Q_SQL}, 7) AS error FROM s")
def q_error(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("n"), (F.col("l_discount") + 0.01).alias("rho")).distinct()
    return r.select("n", _r("rho", 4).alias("rho"), _r(theory.two_law_error(F.col("rho"), F.col("n")), 7).alias("error"))


@query("simulated_error")
def q_simulated(spark, sf_dir):
    return theory.simulated_error(spark, 2000, 32, 2 * F.col("x"), 6.0)


@query("closed_forms")
def q_closed(spark, sf_dir):
    import numpy as np

    gap = np.sin(np.arange(24) / 4)
    ols, gls = theory.ar1_errors(gap, 1.5, 0.6)
    rows = [("k_law", theory.k_law_error(4, 1.0)), ("windows_needed", theory.windows_needed(0.25, 0.05)), ("plug_in", theory.plug_in_error(32, 0.25, 3, 20)), ("ols", ols), ("gls", gls), ("novelty_power", theory.novelty_power(32, 0.5, 1e-3))]
    return spark.createDataFrame([(n, float(v)) for n, v in rows], "form string, value double")


@query("problem_zoo")
def q_zoo(spark, sf_dir):
    """Hard loop on generated windows of every problem: aligned accuracy of the laws found."""
    out = []
    for name, p in generators.PROBLEMS.items():
        w = generators.windows(spark, p, 150, 48, generators.sigma_for_rho(spark, p, 1.0))
        s = stats.window_stats(w, terms.library([f"x{d + 1}" for d in range(p.dims)], log=False), "y", ["window_id", "label"]).cache()
        fit = cluster.hard_loop(s, cluster.mechanism_start(s, len(p.laws)))
        got = cluster.assign(s, fit).join(s.select("window_id", F.col("label").alias("truth")), "window_id")
        out.append((name, float(evaluate.aligned_accuracy(got, "truth", "label"))))
    return spark.createDataFrame(out, "problem string, aligned_accuracy double")
