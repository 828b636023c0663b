"""Samples to windows: calendar days and blocks, gaps and how they are filled, bins and summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import exact_means


def one_per_hour(hourly: DataFrame, date: str, hour: str, value: str, order: str | None) -> DataFrame:
    """A row for each date and hour: the first by `order` of those that repeat, or without it the least value."""
    return hourly.groupBy(date, hour).agg((F.min_by(value, order) if order else F.min(value)).alias(value))


def day_windows(hourly: DataFrame, date: str = "date", hour: str = "hour", value: str = "count", max_missing: int = 0, order: str | None = None) -> DataFrame:
    """(date, hour, x, y): days with at most max_missing hours missing, these as 0; y = log1p less the day's mean, x = 2 pi hour / 24."""
    rows = one_per_hour(hourly, date, hour, value, order)
    days = rows.groupBy(date).agg(F.count("*").alias("_n")).filter(F.col("_n") >= 24 - max_missing)
    grid = days.select(date, F.explode(F.sequence(F.lit(0), F.lit(23))).alias(hour))
    full = grid.join(rows, [date, hour], "left").withColumn("y", F.log1p(F.coalesce(F.col(value), F.lit(0)).cast("double")))
    mean = F.avg("y").over(Window.partitionBy(date))
    return full.select(date, hour, (F.col(hour) * (2 * math.pi / 24)).alias("x"), (F.col("y") - mean).alias("y"))


def day_meta(hourly: DataFrame, date: str = "date", hour: str = "hour") -> DataFrame:
    """Per day: work flag, holiday, season, and rain, weather and mean temperature from 7 to 20 o'clock."""
    day = F.col(hour).between(7, 20)
    season = F.element_at(F.array(*[F.lit(s) for s in ("winter", "spring", "summer", "autumn")]), ((F.month(date) % 12) / 3).cast("int") + 1)
    return hourly.groupBy(date).agg(
        F.max("working").alias("working"), F.max("holiday").alias("holiday"), F.max(F.when(day, F.col("weather"))).alias("weather"),
        F.sum(F.when(day, F.col("precip"))).alias("precip"), F.avg(F.when(day, F.col("temp"))).alias("temp"),
    ).withColumn("season", season).withColumn("day_type", F.when(F.col("holiday") != "", "holiday").when(F.col("working"), "working").otherwise("off"))


def normalise_traffic(raw: DataFrame) -> DataFrame:
    """Hourly rows of a volume table whose holiday names stand on midnight rows only."""
    rows = raw.withColumn("date", F.to_date("date_time")).withColumn("hour", F.hour("date_time"))
    name = F.first(F.when(F.col("holiday") != "None", F.col("holiday")), ignorenulls=True).over(Window.partitionBy("date"))
    rows = rows.withColumn("holiday", F.coalesce(name, F.lit("")))
    work = (F.weekday("date") < 5) & (F.col("holiday") == "")
    return rows.select("date", "hour", F.col("traffic_volume").alias("count"), work.alias("working"), "holiday", (F.least("rain_1h", F.lit(100.0)) + F.col("snow_1h")).alias("precip"), "temp")


def partial_days(hourly: DataFrame, least: int = 6, date: str = "date", hour: str = "hour", value: str = "count", order: str | None = None) -> DataFrame:
    """Ragged days of at least so many hours; the level is left in, to be profiled out."""
    rows = one_per_hour(hourly, date, hour, value, order)
    n = F.count("*").over(Window.partitionBy(date))
    return rows.withColumn("_n", n).filter(F.col("_n") >= least).select(date, hour, (F.col(hour) * (2 * math.pi / 24)).alias("x"), F.log1p(F.col(value).cast("double")).alias("y"))


def impute_linear(rows: DataFrame, key: str, position: str, value: str, size: int) -> DataFrame:
    """Every position 0..size-1 of each key: missing ones on the line between their neighbours around the circle."""
    grid = rows.select(key).distinct().select(key, F.explode(F.sequence(F.lit(-size), F.lit(2 * size - 1))).alias("_p"))
    grid = grid.withColumn(position, F.pmod("_p", F.lit(size)).cast("int"))
    full = grid.join(rows.select(key, F.col(position).cast("int").alias(position), value), [key, position], "left")
    back = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy("_p").rowsBetween(0, Window.unboundedFollowing)
    at = F.struct(F.col("_p").alias("p"), F.col(value).cast("double").alias("v"))
    seen = F.when(F.col(value).isNotNull(), at)
    a, b = F.last(seen, ignorenulls=True).over(back), F.first(seen, ignorenulls=True).over(ahead)
    full = full.withColumn("_a", a).withColumn("_b", b).filter(F.col("_p").between(0, size - 1))
    span = F.col("_b.p") - F.col("_a.p")
    line = F.when(span == 0, F.col("_a.v")).otherwise(F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_p") - F.col("_a.p")) / span)
    return full.select(key, position, line.alias(value))


def impute_mean(rows: DataFrame, key: str, position: str, value: str, size: int) -> DataFrame:
    """Missing positions take the mean of their position, moved to the level of their key."""
    mean = rows.groupBy(position).agg(F.avg(value).alias("_m"))
    level = rows.join(F.broadcast(mean), position).groupBy(key).agg(F.avg(F.col(value) - F.col("_m")).alias("_d"))
    grid = level.select(key, "_d", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(position))
    full = grid.join(rows.select(key, position, value), [key, position], "left").join(F.broadcast(mean), position, "left")
    return full.select(key, position, F.coalesce(F.col(value), F.col("_m") + F.col("_d")).alias(value))


def time_blocks(scada: DataFrame, hours: int = 6, least: int = 24) -> DataFrame:
    """(turbine, block, x, y, ...): blocks of so many hours with at least so many rows; standing turbines in wind are left out."""
    up = scada.dropna().filter(~((F.col("ws") > 4.5) & (F.col("power") < 10)))
    block = F.floor(F.unix_timestamp("time") / (3600 * hours)).alias("block")
    n = F.count("*").over(Window.partitionBy("turbine", "block"))
    return up.select("*", block).withColumn("_n", n).filter(F.col("_n") >= least).drop("_n").withColumn("x", F.col("ws")).withColumn("y", F.col("power") / 2050)


def waked(positions: DataFrame, readings: DataFrame, near: Column, x: str, y: str, key: str, direction: str, width: float = 15.0) -> DataFrame:
    """readings with `waked`: whether a near position stands within `width` degrees of the direction. near: a condition on columns a.* and b.*."""
    a, b = positions.alias("a"), positions.alias("b")
    bearing = F.pmod(F.degrees(F.atan2(F.col(f"b.{x}") - F.col(f"a.{x}"), F.col(f"b.{y}") - F.col(f"a.{y}"))) + 360, F.lit(360.0))
    pairs = a.join(b, (F.col(f"a.{key}") != F.col(f"b.{key}")) & near).select(F.col(f"a.{key}").alias(key), bearing.alias("bearing"))
    lists = pairs.groupBy(key).agg(F.collect_list("bearing").alias("_b"))  # positions are a small, fixed table
    gap = lambda v: F.abs(F.pmod(F.col(direction) - v + 540, F.lit(360.0)) - 180)
    joined = readings.join(lists, key, "left")
    return joined.withColumn("waked", F.exists(F.coalesce("_b", F.array().cast("array<double>")), lambda v: gap(v) < width)).drop("_b")


def method_of_bins(df: DataFrame, x: str, y: str, lo: float = 3.0, hi: float = 15.0, width: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Mean y in each bin; empty bins on the line between their neighbours, flat beyond the first and last."""
    by = by or []
    bins = round((hi - lo) / width)
    got = df.filter((F.col(x) >= lo) & (F.col(x) < hi)).groupBy(*by, F.floor((F.col(x) - lo) / width).cast("int").alias("bin")).agg(F.avg(y).alias("m"))
    keys = got.select(*by).distinct() if by else got.select(F.lit(1).alias("_one")).distinct()
    grid = keys.select(*keys.columns, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(got, [*by, "bin"], "left")
    part = Window.partitionBy(*keys.columns).orderBy("bin")
    seen = F.when(F.col("m").isNotNull(), F.struct(F.col("bin").alias("p"), F.col("m").alias("v")))
    full = full.withColumn("_a", F.last(seen, True).over(part.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(seen, True).over(part.rowsBetween(0, Window.unboundedFollowing)))
    span = F.col("_b.p") - F.col("_a.p")
    line = F.coalesce(F.when(span > 0, F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("bin") - F.col("_a.p")) / span), F.col("_a.v"), F.col("_b.v"))
    return full.select(*by, "bin", (F.col("bin") * width + lo + width / 2).alias("center"), line.alias("y"))


def window_features(samples: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """y_mean, y_std (population), y_min, y_max, mean |step|, mean x*y, p90 - p10; 0 for what is undefined."""
    step = F.abs(F.col(y) - F.lag(y).over(Window.partitionBy(key).orderBy(order)))
    agg = samples.withColumn("_d", step).groupBy(key).agg(
        F.avg(y).alias("y_mean"), F.stddev_pop(y).alias("y_std"), F.min(y).alias("y_min"), F.max(y).alias("y_max"), F.avg("_d").alias("mean_step"),
        F.avg(F.col(x) * F.col(y)).alias("mean_xy"), (F.percentile(y, F.lit(0.9)) - F.percentile(y, F.lit(0.1))).alias("spread"),
    )
    return agg.fillna(0.0)


def to_windows(series: DataFrame, key: str = "series_id", angle: bool = False) -> DataFrame:
    """(key, x, y) of series(key, t, value): gaps are left out; x = t / (n - 1), or 2 pi t / n."""
    n = F.max("t").over(Window.partitionBy(key)) + 1
    x = F.col("t") * (2 * math.pi) / n if angle else F.col("t") / F.greatest(n - 1, F.lit(1))
    return series.withColumn("x", x).filter("value IS NOT NULL AND NOT isnan(value)").select(key, "x", F.col("value").alias("y"))


def subsample(series: DataFrame, keep: float, key: str = "series_id", seed: int = 0) -> DataFrame:
    """max(3, round(keep * observed)) observed samples of each series, by hash."""
    seen = series.filter("value IS NOT NULL AND NOT isnan(value)")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(key, "t", F.lit(seed))))
    return seen.withColumn("_r", rank).withColumn("_n", F.count("*").over(Window.partitionBy(key))).filter(F.col("_r") <= F.greatest(F.lit(3), F.round(F.col("_n") * keep))).drop("_r", "_n")


def whiten(df: DataFrame, key: str, order: str, value: str, phi: float) -> DataFrame:
    """Prais-Winsten: r - phi * previous; the first times sqrt(1 - phi^2)."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn(value, F.when(before.isNull(), F.col(value) * math.sqrt(1 - phi * phi)).otherwise(F.col(value) - phi * before))


def residual_acf(df: DataFrame, key: str, order: str, value: str, lags: int) -> DataFrame:
    """(key, lag, acf): autocorrelation of each window's residuals."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.select(key, value, *[F.lag(value, k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    agg = rows.groupBy(key).agg(*[(F.sum(F.col(value) * F.col(f"_l{k}")) / F.sum(F.col(value) * F.col(value))).alias(f"l{k}") for k in range(1, lags + 1)])
    return agg.select(key, F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"l{k}").alias("acf")) for k in range(1, lags + 1)])))


def normalise_bike(raw: DataFrame) -> DataFrame:
    """Hourly rows of a table with dteday, hr, cnt, workingday, weathersit, temp and holiday 0 or 1."""
    name = F.when(F.col("holiday") == 1, "holiday").otherwise("")
    return raw.select(F.to_date("dteday").alias("date"), F.col("hr").cast("int").alias("hour"), F.col("cnt").cast("double").alias("count"), (F.col("workingday") == 1).alias("working"), name.alias("holiday"), F.col("weathersit").cast("int").alias("weather"), F.col("temp").cast("double").alias("temp"))


def block_meta(blocks: DataFrame, by: list[str], middle: str = "temp", spread: str = "ws_sd", level: str = "ws", edges: tuple[float, float] = (1 / 3, 2 / 3)) -> DataFrame:
    """Per block: rows, means, whether it is warmer than the median block, and its unsteadiness (spread over level) in three steps by exact quantiles
    of all blocks. Means are exact sums over rows, so that blocks of equal rows are on one side of a quantile."""
    means = exact_means(blocks, by, list(dict.fromkeys([level, middle, spread])))
    out = means.select(*by, "n", level, middle, (F.col(spread) / F.col(level)).alias("unsteady"))
    q = out.agg(F.percentile(middle, F.lit(0.5)).alias("m"), F.percentile("unsteady", F.array(*[F.lit(e) for e in edges])).alias("u")).first()
    if q["m"] is None:
        return out.withColumn("warm", F.lit(None).cast("boolean")).withColumn("step", F.lit(None).cast("int"))
    return out.withColumn("warm", F.col(middle) > float(q["m"])).withColumn("step", F.when(F.col("unsteady") <= float(q["u"][0]), 0).when(F.col("unsteady") <= float(q["u"][1]), 1).otherwise(2))


def bins_covered(df: DataFrame, x: str, by: list[str], lo: float = 3.0, hi: float = 15.0, width: float = 0.5) -> DataFrame:
    """by, covered: how many bins have a row; those below lo and from hi on count as one each."""
    bins = round((hi - lo) / width)
    b = F.greatest(F.lit(0), F.least(F.lit(bins + 1), F.floor((F.col(x) - lo) / width).cast("int") + 1))
    return df.groupBy(*by).agg(F.countDistinct(b).alias("covered"))


def to_grid(series: DataFrame, length: int, key: str = "series_id") -> DataFrame:
    """(key, i, value): each series on `length` even places between its first and last, on the line between the observed ones beside a
    place, flat beyond them; a series with fewer than two observed takes its mean, or 0 without any."""
    last = series.groupBy(key).agg(F.max("t").alias("_n"), F.avg(F.when(~F.isnan("value"), F.col("value"))).alias("_mean"))
    seen = series.filter("value IS NOT NULL AND NOT isnan(value)").select(key, F.col("t").cast("double").alias("p"), F.col("value").alias("v"))
    place = (F.col("_i") * F.col("_n") / max(length - 1, 1)).cast("double")
    grid = last.select(key, "_mean", "_n", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("_i")).select(key, "_mean", "_i", place.alias("p"))
    both = grid.select(key, "p", "_i", "_mean", F.lit(None).cast("double").alias("v")).unionByName(seen.select(key, "p", F.lit(None).cast("int").alias("_i"), F.lit(None).cast("double").alias("_mean"), "v"))
    w = Window.partitionBy(key).orderBy("p", F.col("v").isNull())
    at = F.when(F.col("v").isNotNull(), F.struct("p", "v"))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    n = F.count("v").over(Window.partitionBy(key))
    full = both.withColumn("_a", F.last(at, True).over(back)).withColumn("_b", F.first(at, True).over(ahead)).withColumn("_c", n).filter("_i IS NOT NULL")
    span = F.col("_b.p") - F.col("_a.p")
    line = F.coalesce(F.when(span > 0, F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("p") - F.col("_a.p")) / span), F.col("_a.v"), F.col("_b.v"))
    return full.select(key, F.col("_i").alias("i"), F.when(F.col("_c") >= 2, line).otherwise(F.coalesce("_mean", F.lit(0.0))).alias("value"))


def describe_series(series: DataFrame, key: str = "series_id") -> DataFrame:
    """One row: series, classes, least and greatest length, share of values that are missing, and whether lengths differ."""
    miss = F.col("value").isNull() | F.isnan("value")
    each = series.groupBy(key).agg((F.max("t") + 1).alias("n"), F.count("*").alias("rows"), F.sum(miss.cast("int")).alias("gone"), F.first("label").alias("label"))
    return each.agg(F.count("*").alias("series"), F.countDistinct("label").alias("classes"), F.min("n").alias("shortest"), F.max("n").alias("longest"), (F.sum("gone") / F.sum("rows")).alias("missing"), (F.min("n") < F.max("n")).alias("ragged"))


def sorted_profile(samples: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, profile): y of each window in the order of x."""
    own = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    return samples.groupBy(key).agg(F.transform(own, lambda s: s["y"]).alias("profile"))


def block_masks(spark, sizes: tuple[int, ...] = (6, 12), hours: int = 24) -> DataFrame:
    """(mask, hour): the hours that are seen when a run of so many, around the clock from each hour, is missing."""
    rows = [(f"block{n}_{s}", h) for n in sizes for s in range(hours) for h in range(hours) if (h - s) % hours >= n]
    return spark.createDataFrame(rows, "mask string, hour int")


def prefix_masks(spark, lengths: tuple[int, ...], hours: int = 24) -> DataFrame:
    """(mask, hour): the first hours of a day."""
    return spark.createDataFrame([(f"prefix{n}", h) for n in lengths for h in range(min(n, hours))], "mask string, hour int")


def masked(samples: DataFrame, masks: DataFrame, hour: str = "hour") -> DataFrame:
    """samples under every mask, without the hours that it hides; masks are few."""
    return samples.join(F.broadcast(masks.withColumnRenamed("hour", hour)), hour)


def missing_shares(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Share of null values of each column."""
    return df.groupBy(*(by or [])).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])


def ratio_table(df: DataFrame, row: str, column: str, value: str, levels: tuple) -> DataFrame:
    """Mean value by row, of the second of two levels of a column over that of the first."""
    first, second = (F.avg(F.when(F.col(column) == v, F.col(value))) for v in levels)
    return df.groupBy(row).agg((second / first).alias("ratio"))
