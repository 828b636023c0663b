"""Queries of series, gaps, masks, special functions and closed forms, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import losses, special, theory
from ..operators import cluster, evaluate, windowing
from ..session import table
from ..streaming import online
from .catalog import query
from .loops import ONE, PLANTED, _slopes
from .queries import _r
from .views import DAYS, event_days, planted

#: Series of the users' values: a place is missing where the value's second decimal is below 2.
SERIES = "e AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value, event_type, floor(value * 100) % 10 < 2 AS gone FROM events), v AS (SELECT k, t, CASE WHEN gone THEN NULL ELSE value END AS v, event_type FROM e)"


def _series(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("t", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int"))
    v = F.when(F.floor(F.col("value") * 100) % 10 >= 2, F.col("value"))
    return e.select(F.col("user_id").alias("series_id"), "t", v.alias("value"), F.col("event_type").alias("label"))


@query("series_grid", f"WITH {SERIES}, n AS (SELECT k, max(t) AS n, avg(v) AS m, count(v) AS c FROM v GROUP BY k), g AS (SELECT k, n, m, c, i, i * n / 7.0 AS p FROM n, (SELECT unnest(range(8)) AS i)), a AS (SELECT g.k, g.i, any_value(m) AS m, any_value(c) AS c, any_value(p) AS p, max(t) FILTER (t <= p) AS ta, arg_max(v, t) FILTER (t <= p) AS va, min(t) FILTER (t >= p) AS tb, arg_min(v, t) FILTER (t >= p) AS vb FROM g LEFT JOIN v ON v.k = g.k AND v.v IS NOT NULL GROUP BY g.k, g.i) SELECT k AS series_id, i::INT AS i, round(CASE WHEN c < 2 THEN coalesce(m, 0) WHEN ta IS NULL THEN vb WHEN tb IS NULL OR tb = ta THEN va ELSE va + (vb - va) * (p - ta) / (tb - ta) END, 4) AS value FROM a")
def q_grid(spark, sf_dir):
    return windowing.to_grid(_series(spark, sf_dir), 8).withColumn("value", _r("value", 4))


@query("series_windows", f"WITH {SERIES}, n AS (SELECT k, max(t) + 1 AS n FROM v GROUP BY k) SELECT k AS series_id, round(t / greatest(n - 1, 1), 6) AS x, v AS y FROM v JOIN n USING (k) WHERE v IS NOT NULL")
def q_windows(spark, sf_dir):
    return windowing.to_windows(_series(spark, sf_dir)).withColumn("x", _r("x"))


@query("series_description", f"WITH {SERIES}, n AS (SELECT k, max(t) + 1 AS n, count(*) AS rows, count(*) FILTER (v IS NULL) AS gone FROM v GROUP BY k) SELECT count(*) AS series, min(n) AS shortest, max(n) AS longest, round(sum(gone) / sum(rows), 6) AS missing, min(n) < max(n) AS ragged FROM n")
def q_description(spark, sf_dir):
    d = windowing.describe_series(_series(spark, sf_dir))
    return d.select("series", F.col("shortest").cast("long").alias("shortest"), F.col("longest").cast("long").alias("longest"), _r("missing").alias("missing"), "ragged")


@query("sorted_profile", "SELECT l_suppkey, sha256(string_agg(l_quantity::INT::VARCHAR, ',' ORDER BY l_extendedprice, l_quantity)) AS profile FROM lineitem GROUP BY l_suppkey")
def q_profile(spark, sf_dir):
    p = windowing.sorted_profile(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", "l_quantity")
    return p.select("l_suppkey", F.sha2(F.array_join(F.transform("profile", lambda v: v.cast("int").cast("string")), ","), 256).alias("profile"))


@query("block_masks", f"WITH {DAYS}, k AS (SELECT 'block' || n || '_' || s AS mask, h AS hour FROM (SELECT unnest([6, 12]) AS n), (SELECT unnest(range(24)) AS s), (SELECT unnest(range(24)) AS h) WHERE (h - s + 24) % 24 >= n) SELECT mask, event_type, count(*) AS n, round(avg(y), 6) AS m FROM d JOIN k USING (hour) GROUP BY mask, event_type")
def q_masks(spark, sf_dir):
    m = windowing.masked(event_days(spark, sf_dir), windowing.block_masks(spark))
    return m.groupBy("mask", "event_type").agg(F.count("*").alias("n"), _r(F.avg("y")).alias("m"))


@query("prefix_masks", f"WITH {DAYS}, k AS (SELECT 'prefix' || n AS mask, h AS hour FROM (SELECT unnest([6, 12, 18]) AS n), (SELECT unnest(range(24)) AS h) WHERE h < n) SELECT mask, event_type, count(*) AS n, round(avg(y), 6) AS m FROM d JOIN k USING (hour) GROUP BY mask, event_type")
def q_prefixes(spark, sf_dir):
    m = windowing.masked(event_days(spark, sf_dir), windowing.prefix_masks(spark, (6, 12, 18)))
    return m.groupBy("mask", "event_type").agg(F.count("*").alias("n"), _r(F.avg("y")).alias("m"))


@query("bins_covered", "SELECT l_linenumber, count(DISTINCT greatest(0, least(25, floor((l_quantity / 4 - 3) / 0.5)::INT + 1))) AS covered FROM lineitem WHERE l_partkey % 7 = 0 GROUP BY l_linenumber")
def q_covered(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").filter("l_partkey % 7 = 0").withColumn("ws", F.col("l_quantity") / 4)
    return windowing.bins_covered(r, "ws", ["l_linenumber"])


@query("block_meta", "WITH b AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS ws, avg(l_tax) AS temp, avg(l_discount) / avg(l_quantity) AS u FROM lineitem GROUP BY l_suppkey), q AS (SELECT median(temp) AS m, quantile_cont(u, 1/3.0) AS a, quantile_cont(u, 2/3.0) AS b FROM b) SELECT l_suppkey, n, round(ws, 5) AS ws, temp > m AS warm, CASE WHEN u <= a THEN 0 WHEN u <= q.b THEN 1 ELSE 2 END AS step FROM b, q")
def q_meta(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("ws"), F.col("l_tax").alias("temp"), F.col("l_discount").alias("ws_sd"))
    return windowing.block_meta(r, ["l_suppkey"]).select("l_suppkey", "n", _r("ws", 5).alias("ws"), "warm", "step")


@query("missing_shares", "SELECT l_returnflag, round(avg((CASE WHEN l_quantity > 40 THEN NULL ELSE 1 END IS NULL)::INT), 6) AS a, round(avg((CASE WHEN l_tax > 0.05 THEN NULL ELSE 1 END IS NULL)::INT), 6) AS b FROM lineitem GROUP BY l_returnflag")
def q_missing(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_quantity") <= 40, 1).alias("a"), F.when(F.col("l_tax") <= 0.05, 1).alias("b"))
    m = windowing.missing_shares(t, ["a", "b"], ["l_returnflag"])
    return m.select("l_returnflag", _r("a").alias("a"), _r("b").alias("b"))


@query("ratio_table", "SELECT l_suppkey, round(avg(l_extendedprice) FILTER (l_linestatus = 'O') / avg(l_extendedprice) FILTER (l_linestatus = 'F'), 6) AS ratio FROM lineitem GROUP BY l_suppkey")
def q_ratio(spark, sf_dir):
    return windowing.ratio_table(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_linestatus", "l_extendedprice", ("F", "O")).withColumn("ratio", _r("ratio"))


@query("partial_days", "WITH h AS (SELECT event_type || ' ' || ts::DATE AS day, hour(ts) AS hour, arg_min(value, event_id) AS v FROM events GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY day) AS c FROM h) SELECT day, hour::INT AS hour, round(hour * (2*pi()/24), 6) AS x, round(ln(1 + v), 6) AS y FROM n WHERE c >= 6")
def q_partial(spark, sf_dir):
    """Days of six hours or more; of an hour's events the first."""
    e = table(spark, sf_dir, "events").select(F.concat_ws(" ", "event_type", F.to_date("ts").cast("string")).alias("day"), F.hour("ts").alias("hour"), "value", "event_id")
    p = windowing.partial_days(e, 6, "day", "hour", "value", order="event_id")
    return p.select("day", "hour", _r("x").alias("x"), _r("y").alias("y"))


@query("day_meta", "SELECT ts::DATE::VARCHAR AS date, bool_or(user_id % 2 = 0) AS working, max(event_id % 4) FILTER (hour(ts) BETWEEN 7 AND 20) AS weather, round(sum(value) FILTER (hour(ts) BETWEEN 7 AND 20), 4) AS precip, CASE WHEN month(any_value(ts)) IN (12, 1, 2) THEN 'winter' WHEN month(any_value(ts)) IN (3, 4, 5) THEN 'spring' WHEN month(any_value(ts)) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season FROM events GROUP BY ts::DATE")
def q_day_meta(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), (F.col("user_id") % 2 == 0).alias("working"), F.lit("").alias("holiday"), (F.col("event_id") % 4).alias("weather"), F.col("value").alias("precip"), F.col("value").alias("temp"))
    return windowing.day_meta(e).select(F.col("date").cast("string").alias("date"), "working", "weather", _r("precip", 4).alias("precip"), "season")


@query("time_blocks", "WITH b AS (SELECT user_id, floor(epoch(ts) / 21600)::BIGINT AS block, value FROM events), n AS (SELECT *, count(*) OVER (PARTITION BY user_id, block) AS c FROM b WHERE NOT (value > 4.5 AND value < 10)) SELECT user_id AS turbine, block, count(*) AS n, round(avg(value / 2050), 7) AS y FROM n WHERE c >= 2 GROUP BY user_id, block")
def q_blocks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("turbine"), F.col("ts").alias("time"), F.col("value").alias("ws"), F.col("value").alias("power"))
    b = windowing.time_blocks(e, least=2)
    return b.groupBy("turbine", "block").agg(F.count("*").alias("n"), _r(F.avg("y"), 7).alias("y"))


@query("loss_slopes", "WITH r AS (SELECT DISTINCT round((l_quantity - 25.5) / 4, 3) AS r FROM lineitem) SELECT r, (CASE WHEN abs(r) <= 1.345 THEN 1 ELSE 0 END)::DOUBLE AS huber, round((1 - power(r/2.3849, 2)) / power(1 + power(r/2.3849, 2), 2), 6) AS cauchy, round(CASE WHEN abs(r) <= 4.685 THEN (1 - power(r/4.685, 2)) * (1 - 5*power(r/4.685, 2)) ELSE 0 END, 6) AS tukey, round(5 * (4 - r*r) / power(4 + r*r, 2), 6) AS student_t FROM r")
def q_slopes(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.round((F.col("l_quantity") - 25.5) / 4, 3).alias("r")).distinct()
    return r.select("r", *[_r(losses.PSI_PRIME[n](F.col("r"))).alias(n) for n in ("huber", "cauchy", "tukey", "student_t")])


@query("special_functions", "WITH r AS (SELECT DISTINCT l_quantity / 4 AS x FROM lineitem) SELECT x, round(lgamma(x), 7) AS gammaln, round(-(x/(1+x))*ln(x/(1+x)) - (1/(1+x))*ln(1/(1+x)), 7) AS entropy FROM r")
def q_special(spark, sf_dir):
    x = F.col("x")
    r = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 4).alias("x")).distinct()
    return r.select("x", _r(special.gammaln_column(x), 7).alias("gammaln"), _r(special.entropy_column(F.array(x / (1 + x), 1 / (1 + x))), 7).alias("entropy"))


@query("gap_moments", "WITH g AS (SELECT l_linenumber, (l_quantity - 25.5) / 12.25 + l_discount AS g FROM lineitem), m AS (SELECT l_linenumber, avg(g) AS m FROM g GROUP BY l_linenumber) SELECT l_linenumber, round(any_value(m), 6) AS mean, round(avg(power(g - m, 2)), 6) AS centred, round(avg(power(g - m, 4)) / power(avg(power(g - m, 2)), 2), 5) AS peaked FROM g JOIN m USING (l_linenumber) GROUP BY l_linenumber")
def q_gap(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(*special.gap_moments((F.col("l_quantity") - 25.5) / 12.25 + F.col("l_discount")))
    return g.select("l_linenumber", _r("mean").alias("mean"), _r("centred").alias("centred"), _r("peaked", 5).alias("peaked"))


@query("cusum_other_formulas", "WITH r AS (SELECT DISTINCT l_discount * 10 + 0.1 AS rho, (l_linenumber + 2)::DOUBLE AS h FROM lineitem) SELECT round(rho, 4) AS rho, h, round(2*h/rho, 4) AS first, round((h + exp(-h) - 1) / (rho/2), 4) AS delay, round((exp(h) - h - 1) / (rho/2), 2) AS arl FROM r")
def q_formulas(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10 + 0.1).alias("rho"), (F.col("l_linenumber") + 2).cast("double").alias("h")).distinct()
    rho, h = F.col("rho"), F.col("h")
    return r.select(_r("rho", 4).alias("rho"), "h", _r(theory.cusum_delay_first(rho, h), 4).alias("first"), _r(theory.cusum_delay_brownian(rho, h), 4).alias("delay"), _r(theory.cusum_arl_brownian(rho, h), 2).alias("arl"))


@query("standardised_features", f"{ONE}, f AS (SELECT window_id, a / g AS s FROM s) SELECT window_id, round((s - avg(s) OVER ()) / stddev_pop(s) OVER (), 5) AS s FROM f")
def q_standard(spark, sf_dir):
    f = _slopes(spark, sf_dir).select("window_id", F.array(F.col("a")[0] / F.col("g")[0]).alias("s"))
    return cluster.standardise(f, 1).select("window_id", _r(F.col("s")[0], 5).alias("s"))


@query("periodogram", f"WITH {PLANTED.format(sigma=1)}, m AS (SELECT window_id, avg(y) AS m FROM w GROUP BY window_id), s AS (SELECT window_id, sum((y - m)*(y - m)) AS yy, sum((y - m)*cos(1.5*x)) AS c, sum((y - m)*sin(1.5*x)) AS s, sum(cos(1.5*x)*cos(1.5*x)) AS cc, sum(sin(1.5*x)*sin(1.5*x)) AS ss, sum(cos(1.5*x)*sin(1.5*x)) AS cs FROM w JOIN m USING (window_id) GROUP BY window_id), t AS (SELECT *, atan2(2*cs, cc - ss)/2 AS u FROM s), k AS (SELECT *, c*cos(u) + s*sin(u) AS a, s*cos(u) - c*sin(u) AS b, cc*cos(u)*cos(u) + 2*cs*cos(u)*sin(u) + ss*sin(u)*sin(u) AS aa FROM t) SELECT window_id, round((a*a/aa + b*b/(cc + ss - aa)) / yy, 6) AS power FROM k")
def q_periodogram(spark, sf_dir):
    return cluster.periodogram(planted(spark, sf_dir), [1.5]).select("window_id", _r(F.col("power")[0]).alias("power"))


@query("detection_delays", "WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, (event_id // 40) % 2 AS truth, (value > 30)::INT AS state FROM events), s AS (SELECT *, coalesce((truth <> lag(truth) OVER (PARTITION BY user_id ORDER BY t))::INT, 0) AS sw FROM e), g AS (SELECT *, sum(sw) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, g::BIGINT AS switch, min(t) AS at, min(t) FILTER (state = truth) - min(t) AS delay FROM g WHERE g > 0 GROUP BY user_id, g")
def q_delays(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).cast("long").alias("t"), (F.floor(F.col("event_id") / 40) % 2).alias("truth"), (F.col("value") > 30).cast("int").alias("state"))
    d = online.detection_delays(e, "truth", "state", "user_id", "t")
    return d.select("user_id", F.col("switch").cast("long").alias("switch"), "at", F.col("delay").cast("long").alias("delay"))


@query("oriented_labels", "WITH d AS (SELECT l_orderkey, l_linenumber, (l_linestatus = 'F')::INT AS t, (l_shipdate > TIMESTAMP '1995-06-17')::INT AS p FROM lineitem), r AS (SELECT avg((t = p)::INT) AS r FROM d) SELECT l_orderkey, l_linenumber, CASE WHEN r >= 0.5 THEN p ELSE 1 - p END AS p FROM d, r")
def q_oriented(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linestatus") == "F").cast("int").alias("t"), (F.col("l_shipdate") > F.lit("1995-06-17").cast("timestamp")).cast("int").alias("p"))
    return evaluate.oriented(t, "t", "p").select("l_orderkey", "l_linenumber", "p")
