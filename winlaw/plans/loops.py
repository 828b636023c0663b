"""Queries of costs, the alternating loop, one-column mechanism space, selection and classification, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import losses, terms
from ..operators import classify, cluster, costs, evaluate, laws, loop, selection, stats
from ..session import table
from .catalog import query
from .queries import LAWS, LOSS_SQL, _quadratic, _r, _stats
from .views import PLANTED as _PLANTED
from .views import planted

PLANTED = _PLANTED.replace("s AS (", "p0 AS (").replace("FROM s\n", "FROM p0\n")

# ---- costs and one round of the loop on the quadratic laws

CENTRES = np.array([[1.0, 2.0], [2.0, 1.0]])
COVS = [np.array([[1.0, 0.2], [0.2, 0.5]]), np.array([[0.8, 0.0], [0.0, 0.6]])]


def _windows(spark, sf_dir, sigma: float = 3.0) -> DataFrame:
    """Statistics with the geometry features (mean and spread of y)."""
    s = planted(spark, sf_dir, sigma)
    z = s.groupBy("window_id").agg(F.array(F.avg("y"), F.stddev_pop("y")).alias("z"))
    return stats.window_stats(s, _quadratic(), "y", ["window_id", "label"]).join(z, "window_id")


def _state(coef=None, scale: float = 2.0) -> loop.State:
    return loop.State(np.array(LAWS if coef is None else coef), None, CENTRES, COVS, scale)


def _out(df: DataFrame) -> DataFrame:
    return df.select("window_id", F.posexplode("cost").alias("k", "c"), "best").select("window_id", "k", _r("c", 5).alias("cost"), (F.col("k") == F.col("best")).alias("chosen"))


def _loop_sql(geo: str = "sqrt(power(zm - cx, 2) + power(zs - cy, 2))", eq: str = "0.5 * avg(r * r) / 4", extra: str = "0", alpha: str = "0.25", shift: bool = False, second: str = "-x", other: str = "x*x", phys: str = "0") -> str:
    g = "geo - min(geo) OVER ()" if shift else "geo"
    return f"""WITH {PLANTED.format(sigma=3)}, z AS (SELECT window_id, avg(y) AS zm, stddev_pop(y) AS zs FROM w GROUP BY window_id),
 k AS (SELECT * FROM (VALUES (0, 1.0, 2.0, 1.0, 0.2, 0.5, {extra.split('|')[0]}), (1, 2.0, 1.0, 0.8, 0.0, 0.6, {extra.split('|')[-1]})) AS t(k, cx, cy, sxx, sxy, syy, extra)),
 r AS (SELECT window_id, k, CASE WHEN k = 0 THEN y - x*x - x ELSE y - ({other}) - ({second}) END AS r FROM w, k),
 e AS (SELECT window_id, k, {eq} AS eq FROM r GROUP BY window_id, k),
 c0 AS (SELECT window_id, k, eq, {geo} AS geo, {phys} AS ph, extra FROM e JOIN z USING (window_id) JOIN k USING (k)),
 c AS (SELECT window_id, k, eq, {g} AS geo, ph, extra FROM c0),
 m AS (SELECT median(eq) AS me, median(geo) AS mg, median(ph) AS mp FROM c),
 f AS (SELECT window_id, k, (1 - {alpha}) * eq / me + {alpha} * geo / mg + {'0' if phys == '0' else '0.5 * ph / mp'} + extra AS cost FROM c, m)
 SELECT window_id, k, round(cost, 5) AS cost, row_number() OVER (PARTITION BY window_id ORDER BY cost, k) = 1 AS chosen FROM f"""


@query("loop_step_euclidean", _loop_sql())
def q_step(spark, sf_dir):
    return _out(loop.score(_windows(spark, sf_dir).drop("label"), _state(), loop.LoopSpec(2)))


@query("loop_step_density", _loop_sql("0.5 * (syy*power(zm - cx, 2) - 2*sxy*(zm - cx)*(zs - cy) + sxx*power(zs - cy, 2)) / (sxx*syy - sxy*sxy) + 0.5*ln(sxx*syy - sxy*sxy)", shift=True))
def q_step_density(spark, sf_dir):
    return _out(loop.score(_windows(spark, sf_dir).drop("label"), _state(), loop.LoopSpec(2, geometry="density")))


@query("loop_step_huber", _loop_sql(eq="avg(CASE WHEN abs(r / 0.8) <= 1.345 THEN 0.5 * (r / 0.8) * (r / 0.8) ELSE 1.345 * (abs(r / 0.8) - 0.6725) END)"))
def q_step_huber(spark, sf_dir):
    return _out(loop.score(_windows(spark, sf_dir).drop("label"), _state(scale=0.8), loop.LoopSpec(2, loss="huber"), planted(spark, sf_dir, 3.0), _quadratic()))


@query("loop_step_physics", _loop_sql(extra="0.1 * 2 / 1.5|0.1 * 1 / 1.5", second="-x", other="0", phys="abs(zm - k)"))
def q_step_physics(spark, sf_dir):
    """A hook's costs and the complexity of laws of two terms and of one."""
    hook = F.array(*[F.abs(F.col("z")[0] - k) for k in (0, 1)])
    return _out(loop.score(_windows(spark, sf_dir).drop("label"), _state([[0.0, 1.0, 1.0], [0.0, -1.0, 0.0]]), loop.LoopSpec(2, lam=0.5, beta=0.1), physics=hook))


@query("window_loss_costs", f"WITH {PLANTED.format(sigma=3)}, q AS (SELECT window_id, k, (y - x*x - CASE WHEN k = 0 THEN x ELSE -x END) / 0.8 AS r FROM w, (SELECT unnest([0, 1]) AS k)) SELECT window_id, k, " + ", ".join(f"round(avg({v}), 6) AS {n}" for n, v in LOSS_SQL.items()) + " FROM q GROUP BY window_id, k")
def q_losses(spark, sf_dir):
    s, out = planted(spark, sf_dir, 3.0), None
    for name in losses.LOSSES:
        own = costs.sample_costs(s, [terms.predict(_quadratic(), v) for v in LAWS], name, 0.8).select("window_id", F.posexplode("costs").alias("k", name)).withColumn(name, _r(name))
        out = own if out is None else out.join(own, ["window_id", "k"])
    return out


@query("window_loss_own_scale", f"WITH {PLANTED.format(sigma=3)}, q AS (SELECT window_id, k, y - x*x - CASE WHEN k = 0 THEN x ELSE -x END AS r FROM w, (SELECT unnest([0, 1]) AS k)), s AS (SELECT window_id, k, 1.4826 * median(abs(r)) AS s FROM q GROUP BY window_id, k) SELECT window_id, k, round(avg(abs(r / s)), 6) AS cost FROM q JOIN s USING (window_id, k) GROUP BY window_id, k")
def q_own_scale(spark, sf_dir):
    c = costs.sample_costs(planted(spark, sf_dir, 3.0), [terms.predict(_quadratic(), v) for v in LAWS], "absolute", None)
    return c.select("window_id", F.posexplode("costs").alias("k", "cost")).withColumn("cost", _r("cost"))


@query("residual_scale", f"WITH {PLANTED.format(sigma=3)}, r AS (SELECT y - x*x - CASE WHEN label = 0 THEN x ELSE -x END AS r FROM w), m AS (SELECT median(r) AS m FROM r) SELECT round(1.4826 * median(abs(r - m)), 6) AS scale FROM r, m")
def q_residual_scale(spark, sf_dir):
    s = planted(spark, sf_dir, 3.0)
    return spark.range(1).select(_r(F.lit(costs.residual_scale(s, F.col("y") - F.col("x") * F.col("x") - F.when(F.col("label") == 0, F.col("x")).otherwise(-F.col("x"))))).alias("scale"))


@query("geometry_moments", f"WITH {PLANTED.format(sigma=3)}, z AS (SELECT window_id, label, avg(y) AS a, stddev_pop(y) AS b FROM w GROUP BY window_id, label) SELECT label, count(*) AS m, round(avg(a), 6) AS ca, round(avg(b), 6) AS cb, round(covar_samp(a, a), 6) AS saa, round(covar_samp(a, b), 6) AS sab, round(covar_samp(b, b), 6) AS sbb FROM z GROUP BY label")
def q_moments(spark, sf_dir):
    m = costs.moments(_windows(spark, sf_dir), "label", "z", 2)
    rows = [(int(k), int(n), *(round(float(x), 6) for x in (c[0], c[1], s[0, 0], s[0, 1], s[1, 1]))) for k, (n, c, s) in sorted(m.items())]
    return spark.createDataFrame(rows, "label int, m long, ca double, cb double, saa double, sab double, sbb double")


# ---- one-column laws: z = y - x^2 on x

ONE = f"WITH {PLANTED.format(sigma=3)}, s AS (SELECT window_id, label, count(*) AS n, sum(x*x) AS g, sum(x*(y - x*x)) AS a, sum((y - x*x)*(y - x*x)) AS yy FROM w GROUP BY window_id, label)"
FEATURES = f"{ONE}, t AS (SELECT sum(a) / sum(g) AS b, avg(g) AS mg FROM s), f AS (SELECT window_id, label, n, g, a, yy, (a - g * b) / sqrt(mg) AS s FROM s, t)"


def _slopes(spark, sf_dir, sigma: float = 3.0) -> DataFrame:
    s = planted(spark, sf_dir, sigma).withColumn("z", F.col("y") - F.col("x") * F.col("x"))
    return stats.window_stats(s, [("x", F.col("x"))], "z", ["window_id", "label"])


@query("loop_refit", f"{ONE}, l AS (SELECT label, count(*) AS windows, sum(a) / sum(g) AS slope FROM s GROUP BY label), r AS (SELECT y - x*x - slope * x AS r FROM w JOIN l USING (label)), m AS (SELECT median(r) AS m FROM r), q AS (SELECT 1.4826 * median(abs(r - m)) AS scale FROM r, m) SELECT label, round(slope, 6) AS slope, round(scale, 6) AS scale FROM l, q")
def q_refit(spark, sf_dir):
    s = planted(spark, sf_dir, 3.0).withColumn("z", F.col("y") - F.col("x") * F.col("x")).drop("label")
    st = loop.refit(_slopes(spark, sf_dir), loop.LoopSpec(2), 1, 0, None, s, [("x", F.col("x"))], "z")
    return spark.createDataFrame([(k, round(float(v[0]), 6), round(st.scale, 6)) for k, v in enumerate(st.coef)], "label int, slope double, scale double")


@query("loop_crossfit_step", f"{ONE}, c AS (SELECT label AS own, window_id // 2 % 2 AS f, sum(a) AS a, sum(g) AS g FROM s GROUP BY ALL), k AS (SELECT own AS k, sum(a) / sum(g) AS v FROM c GROUP BY own), o AS (SELECT c.own, c.f, (t.a - c.a) / (t.g - c.g) AS v FROM c JOIN (SELECT own, sum(a) AS a, sum(g) AS g FROM c GROUP BY own) t USING (own)), q AS (SELECT sum(yy - 2 * a * v + v * v * g) AS wrong, sum(n) AS n FROM s JOIN k ON k.k = s.label), e AS (SELECT window_id, k.k, 0.5 * greatest(yy - 2 * a * w + w * w * g, 0) / (s.n * q.wrong / q.n) AS eq FROM (SELECT s.*, k.k AS kk, CASE WHEN k.k = s.label THEN o.v ELSE k.v END AS w FROM s, k, o WHERE o.own = s.label AND o.f = s.window_id // 2 % 2) s JOIN k ON k.k = s.kk, q), m AS (SELECT median(eq) AS m FROM e) SELECT window_id, k, round(eq / m, 5) AS cost, row_number() OVER (PARTITION BY window_id ORDER BY eq, k) = 1 AS chosen FROM e, m")
def q_crossfit_step(spark, sf_dir):
    s, spec, fold = _slopes(spark, sf_dir), loop.LoopSpec(2, alpha=0.0, folds=2), (F.floor(F.col("window_id") / 2) % 2).cast("int")
    return _out(loop.score(s, loop.refit(s, spec, 1, 0, fold=fold), spec, fold=fold))


@query("mechanism_features", f"{FEATURES} SELECT window_id, round(s, 4) AS s FROM f")
def q_features(spark, sf_dir):
    f, _ = stats.mechanism_features(_slopes(spark, sf_dir).drop("label"))
    return f.select("window_id", _r(F.col("s")[0], 4).alias("s"))


@query("mechanism_separation", f"{FEATURES}, q AS (SELECT sqrt(sum(greatest(yy - a*a/g, 0)) / sum(greatest(n - 1, 1))) AS sigma FROM f), c AS (SELECT label, count(*) AS w, avg(s) AS m, var_samp(s) AS v FROM f GROUP BY label) SELECT a.label AS j, b.label AS k, round(sqrt(greatest(power(a.m - b.m, 2) - a.v/a.w - b.v/b.w, 0)) / sigma, 5) AS distance FROM c a JOIN c b ON a.label < b.label, q")
def q_separation(spark, sf_dir):
    s = _slopes(spark, sf_dir)
    f, m = stats.mechanism_features(s)
    return stats.separation_matrix(f, s.select("window_id", "label"), m.shape[1], stats.mechanism_noise(s)).withColumn("distance", _r("distance", 5))


@query("separation_unlabelled", f"{FEATURES}, q AS (SELECT sqrt(sum(greatest(yy - a*a/g, 0)) / sum(greatest(n - 1, 1))) AS sigma, avg(n) AS n FROM f), d AS (SELECT median(s) AS m FROM f), r AS (SELECT s, abs(s - m) AS r FROM f, d), e AS (SELECT quantile_cont(r, 0.99) AS e FROM r), i AS (SELECT s FROM r, e WHERE r <= e) SELECT round(greatest(var_samp(s) - any_value(sigma)*any_value(sigma), 0) / (0.25 * any_value(n) * any_value(sigma)*any_value(sigma)), 5) AS rho FROM i, q")
def q_unlabelled(spark, sf_dir):
    s = _slopes(spark, sf_dir)
    f, m = stats.mechanism_features(s)
    n = s.agg(F.avg("n")).first()[0]
    rho = stats.separation_unlabelled(f, m.shape[1], stats.mechanism_noise(s), n, 0.5)["rho"]
    return spark.range(1).select(_r(F.lit(rho), 5).alias("rho"))


@query("feature_inliers", f"{FEATURES}, d AS (SELECT median(s) AS m FROM f), r AS (SELECT window_id, abs(s - m) AS r FROM f, d), e AS (SELECT quantile_cont(r, 0.9) AS e FROM r) SELECT window_id FROM r, e WHERE r <= e")
def q_inliers(spark, sf_dir):
    f, _ = stats.mechanism_features(_slopes(spark, sf_dir).drop("label"))
    return stats.inliers(f, 1, 0.1).select("window_id")


@query("feature_map", f"{ONE}, t AS (SELECT sum(a) / sum(g) AS b, avg(g) AS mg, avg(n) AS mn FROM s WHERE window_id % 3 <> 0), f AS (SELECT window_id, (a - g * b) / sqrt(mg) * sqrt(mn / n) AS s FROM s, t), m AS (SELECT avg(s) AS m FROM f WHERE window_id % 3 <> 0) SELECT window_id, round(s - m, 4) AS s FROM f, m WHERE window_id % 3 = 0")
def q_map(spark, sf_dir):
    s = _slopes(spark, sf_dir)
    f = stats.FeatureMap().fit(s.filter("window_id % 3 <> 0")).transform(s.filter("window_id % 3 = 0"))
    return f.select("window_id", _r(F.col("s")[0], 4).alias("s"))


@query("feature_map_solve", f"{ONE}, t AS (SELECT sum(a) / sum(g) AS b, avg(g) AS mg, avg(n) AS mn FROM s WHERE window_id % 3 <> 0), f AS (SELECT window_id, (a - g * b) / sqrt(mg) / (g / mg * 1.001) * sqrt(mn) AS s FROM s, t), m AS (SELECT avg(s) AS m FROM f WHERE window_id % 3 <> 0) SELECT window_id, round(s - m, 4) AS s FROM f, m WHERE window_id % 3 = 0")
def q_map_solve(spark, sf_dir):
    s = _slopes(spark, sf_dir)
    f = stats.FeatureMap("solve").fit(s.filter("window_id % 3 <> 0")).transform(s.filter("window_id % 3 = 0"))
    return f.select("window_id", _r(F.col("s")[0], 4).alias("s"))


@query("window_kernel", f"{FEATURES}, q AS (SELECT window_id, s FROM f WHERE window_id <= 40), p AS (SELECT a.window_id AS i, b.window_id AS j, power(a.s - b.s, 2) AS d2 FROM q a JOIN q b ON a.window_id <= b.window_id), m AS (SELECT median(d2) AS m FROM p WHERE i < j) SELECT i, j, round(exp(-d2 / m), 5) AS value FROM p, m")
def q_kernel(spark, sf_dir):
    f, _ = stats.mechanism_features(_slopes(spark, sf_dir).drop("label"))
    return stats.window_kernel(f.filter("window_id <= 40"), "rbf").withColumn("value", _r("value", 5))


@query("profile_two_columns", f"WITH {PLANTED.format(sigma=3)}, m AS (SELECT window_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(x*x) AS mq FROM w GROUP BY window_id), c AS (SELECT window_id, any_value(m.n) AS n, sum((x - mx)*(x - mx)) AS xx, sum((x*x - mq)*(x - mx)) AS qx, sum((x*x - mq)*(x*x - mq)) AS qq, sum((x - mx)*(y - my)) AS xy, sum((x*x - mq)*(y - my)) AS qy, sum((y - my)*(y - my)) AS yy FROM w JOIN m USING (window_id) GROUP BY window_id) SELECT window_id, n - 2 AS n, round(qq - qx*qx/xx, 3) AS g, round(qy - qx*xy/xx, 3) AS a, round(yy - xy*xy/xx, 3) AS yy FROM c")
def q_profile(spark, sf_dir):
    s = stats.profile(_stats(spark, sf_dir, 3.0).drop("label"), 3, [0, 1])
    return s.select("window_id", "n", _r(F.col("g")[0], 3).alias("g"), _r(F.col("a")[0], 3).alias("a"), _r("yy", 3).alias("yy"))


# ---- selection


@query("crossfit_scores", f"{ONE}, c AS (SELECT label AS own, window_id % 3 AS f, sum(a) AS a, sum(g) AS g FROM s GROUP BY ALL), t AS (SELECT own, sum(a) AS a, sum(g) AS g FROM c GROUP BY own), o AS (SELECT c.own, c.f, (t.a - c.a) / (t.g - c.g) AS v FROM c JOIN t USING (own)), k AS (SELECT own AS k, a / g AS v FROM t), e AS (SELECT s.window_id, k.k, s.a, s.g, s.yy, CASE WHEN k.k = s.label THEN o.v ELSE k.v END AS v FROM s JOIN o ON o.own = s.label AND o.f = s.window_id % 3, k) SELECT window_id, k, round(greatest(yy - 2*a*v + v*v*g, 0), 3) AS rss FROM e")
def q_crossfit(spark, sf_dir):
    s = _slopes(spark, sf_dir)
    return selection.crossfit_rss(s, s.select("window_id", "label"), ridge=0.0, fold=F.col("window_id") % 3).withColumn("rss", _r("rss", 3))


LINE = f"WITH {PLANTED.format(sigma=1)}, m AS (SELECT window_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum((x)*(x)) - count(*)*avg(x)*avg(x) AS sxx, regr_slope(y, x) AS b FROM w GROUP BY window_id), r AS (SELECT w.window_id, n, y - my - b*(x - mx) AS r, 1.0/n + (x - mx)*(x - mx)/sxx AS h, y - my AS r0 FROM w JOIN m USING (window_id)), l AS (SELECT window_id, any_value(n) AS n, avg(power(r / (1 - h), 2)) AS l2, avg(power(r0 * n / (n - 1), 2)) AS l1 FROM r GROUP BY window_id)"


@query("leave_one_out", f"{LINE} SELECT window_id, n, round(l2, 5) AS loo FROM l")
def q_loo(spark, sf_dir):
    return selection.loo_error(planted(spark, sf_dir), _quadratic()[:2]).select("window_id", "n", _r("loo", 5).alias("loo"))


@query("rank_choice", f"{LINE}, e AS (SELECT 1 AS size, avg(l1) AS error, stddev_samp(l1) / sqrt(count(*)) AS se FROM l UNION ALL SELECT 2, avg(l2), stddev_samp(l2) / sqrt(count(*)) FROM l), b AS (SELECT error + se AS most FROM e ORDER BY error LIMIT 1) SELECT size, round(error, 5) AS error, round(se, 5) AS se, size = (SELECT min(size) FROM e, b WHERE error <= most) AS chosen FROM e")
def q_rank(spark, sf_dir):
    size, log = selection.select_rank(planted(spark, sf_dir), lambda k: terms.legendre("x", k, -2.0, 2.0), [1, 2])
    return spark.createDataFrame([(r["size"], round(float(r["error"]), 5), round(float(r["se"]), 5), r["size"] == size) for r in log], "size int, error double, se double, chosen boolean")


@query("learn_loss_moments", f"WITH {PLANTED.format(sigma=1)}, r AS (SELECT y - x*x - CASE WHEN label = 0 THEN x ELSE -x END AS r FROM w) SELECT 'squared' AS loss, round(sqrt(avg(r*r)), 6) AS scale, round(-ln(sqrt(avg(r*r))) - 0.5*ln(2*pi()) - 0.5, 5) AS loglik FROM r UNION ALL SELECT 'absolute', round(avg(abs(r)), 6), round(-ln(2*avg(abs(r))) - 1, 5) FROM r")
def q_moment_losses(spark, sf_dir):
    r = planted(spark, sf_dir).select((F.col("y") - F.col("x") * F.col("x") - F.when(F.col("label") == 0, F.col("x")).otherwise(-F.col("x"))).alias("r"))
    rows = [(c["loss"], round(float(c["scale"]), 6), round(float(c["loglik"]), 5)) for c in losses.candidate_losses(r, "r", ("squared", "absolute"))]
    return spark.createDataFrame(rows, "loss string, scale double, loglik double")


# ---- classification


@query("law_classifier", f"{ONE}, c AS (SELECT label AS k, sum(a) / sum(g) AS v, sum(yy) - sum(a)*sum(a)/sum(g) AS wrong, sum(n) AS n, count(*) AS w FROM s WHERE window_id % 3 <> 0 GROUP BY label), t AS (SELECT sum(wrong) / sum(n) AS s2, sum(w) AS w FROM c), z AS (SELECT s.window_id, s.label, c.k, -greatest(yy - 2*a*v + v*v*g, 0) / (2*s2) - s.n*(0.5*ln(s2) + 0.5*ln(2*pi())) + ln(c.w / t.w) AS z FROM s, c, t WHERE s.window_id % 3 = 0) SELECT window_id, label, arg_max(k, (z, -k)) AS prediction, round(max(z), 3) AS score FROM z GROUP BY window_id, label")
def q_classifier(spark, sf_dir):
    s = _slopes(spark, sf_dir)
    model = classify.LawClassifier.fit(s.filter("window_id % 3 <> 0"), "label")
    test = s.filter("window_id % 3 = 0")
    got = model.predict(test).join(test.select("window_id", "label", F.array_max(model.scores()).alias("z")), "window_id")
    return got.select("window_id", "label", "prediction", _r("z", 3).alias("score"))


@query("shifted_rss", f"WITH {PLANTED.format(sigma=3)}, t AS (SELECT unnest([-0.5, 0.0, 0.5])::DOUBLE AS tau), r AS (SELECT window_id, tau, k, sum(power(y - x*x - CASE WHEN k = 0 THEN x + tau ELSE -(x + tau) END, 2)) AS rss FROM w, t, (SELECT unnest([0, 1]) AS k) GROUP BY ALL) SELECT window_id, k, round(min(rss), 3) AS rss, arg_min(tau, (rss, tau)) AS tau FROM r GROUP BY window_id, k")
def q_shifted(spark, sf_dir):
    s = planted(spark, sf_dir, 3.0).withColumn("z", F.col("y") - F.col("x") * F.col("x"))
    by = classify.shifted_stats(s, lambda tau: [("x", F.col("x") + tau)], [-0.5, 0.0, 0.5], "z")
    return classify.rss_over_shifts(by, [[1.0], [-1.0]]).select("window_id", "k", _r("rss", 3).alias("rss"), "tau")


@query("few_shot_draw", "SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id * 7919 % 10007, vec_id) <= 5")
def q_few(spark, sf_dir):
    return classify.few_shot(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 5, order=F.col("vec_id") * 7919 % 10007)


@query("balanced_error", "WITH r AS (SELECT l_returnflag, avg((l_returnflag = CASE WHEN l_discount > 0.05 THEN 'R' WHEN l_tax > 0.04 THEN 'A' ELSE 'N' END)::INT) AS r FROM lineitem GROUP BY l_returnflag) SELECT round(1 - avg(r), 6) AS error FROM r")
def q_balanced(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").withColumn("p", F.when(F.col("l_discount") > 0.05, "R").when(F.col("l_tax") > 0.04, "A").otherwise("N"))
    return spark.range(1).select(_r(F.lit(classify.balanced_error(t, "l_returnflag", "p"))).alias("error"))


# ---- evaluation


@query("clustering_metrics", f"WITH {PLANTED.format(sigma=6)}, c AS (SELECT window_id, label AS t, sum(x*(y - x*x)) / sum(x*x) AS v FROM w GROUP BY window_id, label), d AS (SELECT t, CASE WHEN v > 0.4 THEN 0 ELSE 1 END AS p FROM c), n AS (SELECT t, p, count(*)::DOUBLE AS n FROM d GROUP BY ALL), s AS (SELECT sum(n) AS n, sum(n*(n - 1)/2) AS ij FROM n), a AS (SELECT sum(x*(x - 1)/2) AS a FROM (SELECT sum(n) AS x FROM n GROUP BY t)), b AS (SELECT sum(x*(x - 1)/2) AS b FROM (SELECT sum(n) AS x FROM n GROUP BY p)), m AS (SELECT greatest(coalesce(sum(n) FILTER (t = p), 0), coalesce(sum(n) FILTER (t <> p), 0)) / sum(n) AS acc FROM n) SELECT round((ij - a*b/(n*(n - 1)/2)) / ((a + b)/2 - a*b/(n*(n - 1)/2)), 5) AS ari, round(acc, 5) AS aligned_accuracy FROM s, a, b, m")
def q_metrics(spark, sf_dir):
    s = _slopes(spark, sf_dir, 6.0).select(F.col("label").alias("t"), F.when(F.col("a")[0] / F.col("g")[0] > 0.4, 0).otherwise(1).alias("p"))
    m = evaluate.clustering_metrics(s, "t", "p")
    return spark.createDataFrame([(round(float(m["ari"]), 5), round(float(m["aligned_accuracy"]), 5))], "ari double, aligned_accuracy double")


@query("matched_error", "WITH d AS (SELECT l_linestatus AS t, CASE WHEN l_discount < 0.02 THEN -1 WHEN l_tax > 0.03 THEN 0 ELSE 1 END AS p FROM lineitem), n AS (SELECT t, p, count(*) AS n FROM d WHERE p >= 0 GROUP BY ALL), h AS (SELECT greatest(sum(n) FILTER ((t = 'F') = (p = 0)), sum(n) FILTER ((t = 'F') <> (p = 0))) AS hit FROM n) SELECT round(1 - hit / (SELECT count(*) FROM d), 6) AS error FROM h")
def q_matched(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_linestatus", F.when(F.col("l_discount") < 0.02, -1).when(F.col("l_tax") > 0.03, 0).otherwise(1).alias("p"))
    return spark.range(1).select(_r(F.lit(evaluate.matched_error(t, "l_linestatus", "p"))).alias("error"))


@query("law_errors", "WITH g AS (SELECT (l_quantity - 25.5) / 12.25 AS x FROM lineitem), e AS (SELECT sqrt(avg(power(x*x + 0.9*x + 0.1 - x*x - x, 2))) AS e0, sqrt(avg(power(x*x - 1.2*x - x*x + x, 2))) AS e1, sqrt(avg(power(2*x, 2))) AS gap FROM g) SELECT 0 AS law, round(e0, 6) AS rms, round(e0 / gap, 6) AS relative FROM e UNION ALL SELECT 1, round(e1, 6), round(e1 / gap, 6) FROM e")
def q_law_errors(spark, sf_dir):
    x = F.col("x")
    g = table(spark, sf_dir, "lineitem").select(((F.col("l_quantity") - 25.5) / 12.25).alias("x"))
    rows = evaluate.law_errors(g, [x * x + 0.9 * x + 0.1, x * x - 1.2 * x], [x * x + x, x * x - x])
    return spark.createDataFrame([(r["law"], round(r["rms"], 6), round(r["relative"], 6)) for r in rows], "law int, rms double, relative double")


@query("rolling_accuracy", "WITH e AS (SELECT event_type, event_id, ts, (value > 40)::INT AS t, (user_id % 2)::INT AS p FROM events), r AS (SELECT event_type, event_id, count(*) OVER o AS c, avg((t = p)::INT) OVER o AS a FROM e WINDOW o AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) SELECT event_type, event_id, round(CASE WHEN c >= 10 THEN a END, 6) AS accuracy FROM r")
def q_rolling_accuracy(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", (F.col("value") > 40).cast("int").alias("t"), (F.col("user_id") % 2).cast("int").alias("p"))
    return evaluate.rolling_accuracy(e, "t", "p", "event_id", by=["event_type"]).select("event_type", "event_id", _r("accuracy").alias("accuracy"))


@query("ranks", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS min_rank, round((rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0) / count(*) OVER (PARTITION BY l_suppkey), 6) AS share_rank FROM lineitem")
def q_ranks(spark, sf_dir):
    r = evaluate.ranks(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_suppkey"])
    return r.select("l_orderkey", "l_linenumber", F.col("min_rank").cast("long").alias("min_rank"), _r("share_rank").alias("share_rank"))


@query("top_k", "SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS line, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) <= 3")
def q_top(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_extendedprice")
    return evaluate.top_k(t, "l_extendedprice", 3, ["l_suppkey"], "line")


@query("quantile_buckets", "WITH q AS (SELECT quantile_cont(l_extendedprice, 1/3.0) AS a, quantile_cont(l_extendedprice, 2/3.0) AS b FROM lineitem) SELECT CASE WHEN l_extendedprice <= a THEN 0 WHEN l_extendedprice <= b THEN 1 ELSE 2 END AS bucket, count(*) AS n FROM lineitem, q GROUP BY 1")
def q_buckets(spark, sf_dir):
    return evaluate.quantile_buckets(table(spark, sf_dir, "lineitem"), "l_extendedprice").groupBy("bucket").agg(F.count("*").alias("n"))


@query("superposition_share", f"{ONE}, t AS (SELECT sum(a) AS a, sum(g) AS g, sum(yy) AS yy FROM s WHERE label = 0) SELECT round(a / g, 5) AS weight, round((yy - a*a/g) / yy, 5) AS unexplained FROM t")
def q_outside(spark, sf_dir):
    """How much of a law's samples lies outside the span of a basis."""
    s = planted(spark, sf_dir, 3.0).filter("label = 0").withColumn("z", F.col("y") - F.col("x") * F.col("x"))
    v, share = laws.outside_share(s, [("x", F.col("x"))], "z")
    return spark.createDataFrame([(round(float(v[0]), 5), round(share, 5))], "weight double, unexplained double")


@query("loop_whole")
def q_loop(spark, sf_dir):
    """The loop with geometry, folds and an order of laws by a key, from corrupted labels: accuracy before and after."""
    w = _windows(spark, sf_dir, 3.0).cache()
    truth = w.select("window_id", F.col("label").alias("truth"))
    start = selection.corrupt_labels(w.select("window_id", "label"), 0.3, 2)
    state, got = loop.fit(w, start, loop.LoopSpec(2, alpha=0.05, folds=3))
    accuracy = lambda d: float(evaluate.aligned_accuracy(d.join(truth, "window_id"), "truth", "label"))
    return spark.createDataFrame([(accuracy(start), accuracy(got), len(state.history))], "before double, after double, rounds int")


@query("soft_em_round", f"{ONE}, r AS (SELECT window_id, n, g, a, yy, (yy - 2*a*1.5 + 2.25*g) AS r0, (yy + 2*a*0.5 + 0.25*g) AS r1 FROM s), p AS (SELECT *, 1 / (1 + exp((r0 - r1) / (2*9.0))) AS p FROM r) SELECT round(sum(p*a) / sum(p*g), 5) AS slope0, round(sum((1 - p)*a) / sum((1 - p)*g), 5) AS slope1, round(avg(p), 5) AS weight0 FROM p")
def q_em_round(spark, sf_dir):
    """Laws and weights after one E and M step."""
    start = cluster.LawFit(np.array([[1.5], [-0.5]]), np.array([3.0, 3.0]), np.array([0.5, 0.5]), [])
    fit = cluster.soft_em(_slopes(spark, sf_dir).drop("label"), start, max_iter=1, ridge=0.0)
    return spark.createDataFrame([(round(float(fit.coef[0, 0]), 5), round(float(fit.coef[1, 0]), 5), round(float(fit.weights[0]), 5))], "slope0 double, slope1 double, weight0 double")


@query("hard_loop_round", f"{ONE}, r AS (SELECT window_id, n, g, a, yy, CASE WHEN yy - 2*a*0.9 + 0.81*g <= yy + 2*a*0.2 + 0.04*g THEN 0 ELSE 1 END AS k FROM s) SELECT k, count(*) AS windows, round(sum(a) / sum(g), 5) AS slope FROM r GROUP BY k")
def q_hard_round(spark, sf_dir):
    """Laws and sizes after one round of the hard loop."""
    start = cluster.LawFit(np.array([[0.9], [-0.2]]), np.ones(2), np.ones(2) / 2, [])
    fit = cluster.hard_loop(_slopes(spark, sf_dir).drop("label"), start, max_iter=1, ridge=0.0)
    return spark.createDataFrame([(k, int(fit.history[0]["sizes"][k]), round(float(v[0]), 5)) for k, v in enumerate(fit.coef)], "k int, windows long, slope double")


@query("cusum_trace", """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, -0.5*power(ln(1 + value) - 3.0, 2) AS l0, -0.5*power(ln(1 + value) - 4.5, 2) AS l1 FROM events),
 c AS (SELECT user_id, t, CASE WHEN l1 - l0 > 5 THEN 1 ELSE 0 END AS regime, l1 - l0 > 5 AS switched, CASE WHEN l1 - l0 > 5 THEN 0.0 ELSE greatest(l1 - l0, 0.0) END AS s FROM e WHERE t = 1
 UNION ALL SELECT user_id, t, CASE WHEN s > 5 THEN 1 - regime ELSE regime END, s > 5, CASE WHEN s > 5 THEN 0.0 ELSE s END FROM (SELECT e.user_id, e.t, c.regime, greatest(0.0, c.s + CASE WHEN c.regime = 0 THEN l1 - l0 ELSE l0 - l1 END) AS s FROM c JOIN e ON e.user_id = c.user_id AND e.t = c.t + 1))
 SELECT user_id, t::INT AS t, regime, switched, round(s, 5) AS evidence FROM c""")
def q_cusum(spark, sf_dir):
    from pyspark.sql import Window

    from ..streaming import online

    e = table(spark, sf_dir, "events").withColumn("t", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).withColumn("y", F.log1p("value"))
    return online.cusum(e, [F.lit(3.0), F.lit(4.5)], [1.0, 1.0], 5.0, "y", "user_id", "t").withColumn("evidence", _r("evidence", 5))
