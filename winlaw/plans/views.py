"""Views of the driver's tables as windows of samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def planted(spark: SparkSession, sf_dir: str, sigma: float = 1.0, by_line: bool = False) -> DataFrame:
    """(window_id, t, x, y, label): a window for each supplier (and line number), of two laws x^2 + x and x^2 - x with bounded noise."""
    rows = table(spark, sf_dir, "lineitem")
    x = (F.col("l_quantity") - 25.5) / 12.25
    label = (F.col("l_suppkey") % 2).cast("int")
    e = F.col("l_extendedprice") / 52500.0 - 1.0
    y = x * x + F.when(label == 0, x).otherwise(-x) + sigma * e
    window = F.col("l_suppkey") * 10 + F.col("l_linenumber") if by_line else F.col("l_suppkey")
    return rows.select(window.alias("window_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("t"), x.alias("x"), y.alias("y"), label.alias("label"))


PLANTED = """s AS (
  SELECT l_suppkey AS window_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS t, (l_quantity - 25.5) / 12.25 AS x, (l_suppkey % 2)::INT AS label,
         l_extendedprice / 52500.0 - 1.0 AS e FROM lineitem
), w AS (
  SELECT window_id, t, x, label, x * x + CASE WHEN label = 0 THEN x ELSE -x END + {sigma} * e AS y FROM s
)"""


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, day, hour, x, y) of the events."""
    e = table(spark, sf_dir, "events")
    return e.select("event_type", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), (F.hour("ts") * (2 * math.pi / 24)).alias("x"), F.log1p("value").alias("y"))


DAYS = """d AS (
  SELECT event_type, ts::DATE AS day, hour(ts) AS hour, hour(ts) * (2 * pi() / 24) AS x, ln(1 + value) AS y FROM events
)"""
