"""Synthetic windows as DataFrames: every value is a hash of its place, so a seed gives the same rows on any cluster."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, salt: int, *keys: str) -> Column:
    return (F.pmod(F.xxhash64(*keys, F.lit(seed), F.lit(salt)), F.lit(1 << 53)) + 0.5) / float(1 << 53)


def normal(seed: int, salt: int, *keys: str) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, salt, *keys))) * F.cos(uniform(seed, salt + 1, *keys) * (2 * math.pi))


def noise(kind: str, seed: int, salt: int, *keys: str) -> Column:
    """Unit-variance noise: gaussian, laplace, t3, contaminated_10, contaminated_20."""
    z = normal(seed, salt, *keys)
    if kind == "gaussian":
        return z
    if kind == "laplace":
        u = uniform(seed, salt + 2, *keys) - 0.5
        return -F.signum(u) * F.log(1 - 2 * F.abs(u)) / math.sqrt(2)
    if kind == "t3":
        chi = sum((F.pow(normal(seed, salt + 10 + 2 * i, *keys), F.lit(2.0)) for i in range(3)), F.lit(0.0))
        return z / F.sqrt(chi / 3) / math.sqrt(3)
    if kind.startswith("contaminated_"):
        e = int(kind.rsplit("_", 1)[1]) / 100
        wide = F.when(uniform(seed, salt + 3, *keys) < e, 10.0).otherwise(1.0)
        return z * wide / math.sqrt(1 - e + 100 * e)
    raise KeyError(kind)


@dataclass(frozen=True)
class Problem:
    """Laws as SQL expressions of x1 (and x2)."""

    laws: tuple[str, ...]
    dims: int = 1
    lo: float = -2.0
    hi: float = 2.0


PROBLEMS: dict[str, Problem] = {
    "sign": Problem(("-x1", "x1")),
    "quadratic_pair": Problem(("x1*x1 + x1", "x1*x1 - x1")),
    "damping": Problem(("exp(-0.5*x1)*cos(2*x1)", "exp(-0.2*x1)*cos(2*x1)"), lo=0.0, hi=4.0),
    "growth": Problem(("0.5*x1", "0.1*x1*x1*x1")),
    "three_shapes": Problem(("x1*x1", "2*sin(x1)", "0.5*x1*x1*x1 - x1")),
    "four_phases": Problem(("sin(2*x1)", "cos(2*x1)", "-sin(2*x1)", "-cos(2*x1)")),
    "log_or_linear": Problem(("log1p(abs(x1))", "0.5*x1")),
    "high_frequency": Problem(("sin(5*x1)", "sin(6*x1)")),
    "interaction": Problem(("x1*x2", "x1 + x2"), dims=2),
    "saddle": Problem(("x1*x1 - x2*x2", "x2*x2 - x1*x1"), dims=2),
    "chirp": Problem(("sin(x1*x1)", "sin(1.3*x1*x1)"), lo=0.0, hi=3.0),
    "lorentzian": Problem(("1/(1 + x1*x1)", "1/(1 + 4*x1*x1)")),
}


#: Pairs of laws for the estimator battery, families beyond the library, and open laws.
BATTERY: dict[str, Problem] = {
    "sign": Problem(("-x1", "x1")),
    "bend": Problem(("x1*x1 + x1", "x1*x1 - x1")),
    "cubic": Problem(("0.5*x1*x1*x1 - x1", "0.25*x1*x1*x1")),
    "wave": Problem(("sin(2*x1)", "sin(2*x1 + 0.8)")),
}
FAMILIES: dict[str, Problem] = {
    "steps": Problem(("IF(x1 > 0, 1, 0)", "IF(x1 > 0.7, 1, 0)")),
    "hinges": Problem(("greatest(x1, 0)", "greatest(x1 - 0.5, 0)")),
    "decays": Problem(("exp(-x1)", "exp(-1.6*x1)"), lo=0.0, hi=3.0),
    "saturations": Problem(("x1/(1 + x1)", "x1/(2 + x1)"), lo=0.0, hi=5.0),
    "powers": Problem(("pow(x1, 1.5)", "pow(x1, 1.8)"), lo=0.0, hi=2.0),
    "logistics": Problem(("1/(1 + exp(-2*x1))", "1/(1 + exp(-4*x1))")),
}
OPEN_LAWS: dict[str, Problem] = {
    "chirp": PROBLEMS["chirp"],
    "damped": PROBLEMS["damping"],
    "am_sine": Problem(("(1 + 0.5*sin(x1))*sin(4*x1)", "(1 + 0.9*sin(x1))*sin(4*x1)"), lo=0.0, hi=6.0),
    "lorentzian": PROBLEMS["lorentzian"],
}
MIXTURE = {"quadratic": "0.8*x1*x1", "sine": "2*sin(2*x1)", "cubic": "0.5*x1*x1*x1 - x1"}


def windows(spark: SparkSession, problem: Problem, count: int, n: int, sigma: float, seed: int = 11, kind: str = "gaussian") -> DataFrame:
    """(window_id, t, x1[, x2], label, y). Inputs and labels do not depend on sigma or the noise."""
    rows = spark.range(count * n).select(F.floor(F.col("id") / n).alias("window_id"), (F.col("id") % n).cast("int").alias("t"))
    for d in range(problem.dims):
        rows = rows.withColumn(f"x{d + 1}", uniform(seed, 100 + d, "window_id", "t") * (problem.hi - problem.lo) + problem.lo)
    rows = rows.withColumn("label", F.floor(uniform(seed, 7, "window_id") * len(problem.laws)).cast("int"))
    mean = F.element_at(F.array(*[F.expr(e).cast("double") for e in problem.laws]), F.col("label") + 1)
    return rows.withColumn("y", mean + sigma * noise(kind, seed, 200, "window_id", "t"))


def closest_gap(spark: SparkSession, problem: Problem, samples: int = 20_000, seed: int = 5) -> float:
    """Mean squared difference of the two closest laws."""
    rows = spark.range(samples).withColumnRenamed("id", "t")
    for d in range(problem.dims):
        rows = rows.withColumn(f"x{d + 1}", uniform(seed, 100 + d, "t") * (problem.hi - problem.lo) + problem.lo)
    pairs = [(a, b) for i, a in enumerate(problem.laws) for b in problem.laws[i + 1 :]]
    r = rows.agg(*[F.avg(F.pow(F.expr(f"({a}) - ({b})"), F.lit(2.0))) for a, b in pairs]).first()
    return float(min(r))


def sigma_for_rho(spark: SparkSession, problem: Problem, rho: float) -> float:
    return math.sqrt(closest_gap(spark, problem) / rho)


def parse_mixture(text: str, known: dict[str, str]) -> str:
    """"0.5*quadratic + 2*sine" as one SQL expression of known laws."""
    out = []
    for part in text.replace("-", "+-").split("+"):
        part = part.strip()
        if not part:
            continue
        m = re.fullmatch(r"(-?)\s*(?:(\d*\.?\d+)\s*\*)?\s*(\w+)", part)
        if not m or m[3] not in known:
            raise ValueError(f"can't read {part!r}")
        out.append(f"{m[1]}{m[2] or 1}*({known[m[3]]})")
    return " + ".join(out)


def ar1(rows: DataFrame, key: str, order: str, phi: float, seed: int) -> DataFrame:
    """rows with `e`: e_t = phi e_(t-1) + sqrt(1 - phi^2) u_t along the order of each window, folded over its own samples."""
    u = rows.withColumn("_u", normal(seed, 300, key, order)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_u").alias("u")))).alias("_s"))
    step = lambda acc, s: F.concat(acc, F.array(F.struct(s["o"].alias("o"), (F.coalesce(F.element_at(acc, -1)["e"] * phi + s["u"] * math.sqrt(1 - phi * phi), s["u"])).alias("e"))))
    kind = dict(rows.dtypes)[order]
    first = F.array(F.struct(F.col("_s")[0]["o"].alias("o"), F.col("_s")[0]["u"].alias("e"))).cast(f"array<struct<o:{kind},e:double>>")
    folded = u.select(key, F.inline(F.aggregate(F.slice("_s", F.lit(2), F.greatest(F.size("_s") - 1, F.lit(0))), first, step)))
    return rows.join(folded.withColumnRenamed("o", order), [key, order])


def markov_states(spark: SparkSession, length: int, mean: float, seed: int = 3) -> DataFrame:
    """(t, state): two states that switch with chance 1 / mean. Switches are counted within stretches, and stretches before them by their sums."""
    from pyspark.sql import Window

    stretch = 1 << 16
    rows = spark.range(length).withColumnRenamed("id", "t").withColumn("_s", (uniform(seed, 9, "t") < 1 / mean).cast("int")).withColumn("_p", F.floor(F.col("t") / stretch))
    sums = rows.groupBy("_p").agg(F.sum("_s").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each stretch
    own = F.sum("_s").over(Window.partitionBy("_p").orderBy("t"))
    return rows.join(F.broadcast(sums.select("_p", "_b")), "_p").select("t", ((own + F.col("_b")) % 2).cast("int").alias("state"))


def realised_rho(spark: SparkSession, problem: Problem, sigma: float) -> float:
    """The separation of the closest pair at a noise."""
    return closest_gap(spark, problem) / sigma**2


def with_geometry(rows: DataFrame, error: float = 0.41, seed: int = 13) -> DataFrame:
    """rows with z1, z2: a point for each window that says little of its label: two normals so far apart that guessing by them errs by `error`."""
    from ..functions.special import q_inverse

    far = q_inverse(error)
    z1 = normal(seed, 400, "window_id") + (2 * F.col("label") - 1) * far
    return rows.withColumn("z1", z1).withColumn("z2", normal(seed, 410, "window_id"))


def mixture(spark: SparkSession, regimes: list[str], rows: int, per_window: int = 1, sigma: float = 0.6, shares: list[float] | None = None, extra: int = 0, seed: int = 11) -> DataFrame:
    """(window_id, t, x1.., z1, z2, label, y): a mixture of laws written as "0.5*quadratic + 2*sine". shares: of regimes, even if
    not given; extra: inputs that no law uses; z: a point near the regime's centre."""
    laws = [parse_mixture(r, MIXTURE) for r in regimes]
    shares = shares or [1 / len(laws)] * len(laws)
    out = spark.range(rows * per_window).select(F.floor(F.col("id") / per_window).alias("window_id"), (F.col("id") % per_window).cast("int").alias("t"))
    u, label, edge = uniform(seed, 7, "window_id"), F.lit(len(laws) - 1), sum(shares[:-1])
    for k in range(len(laws) - 2, -1, -1):
        label = F.when(u < edge, k).otherwise(label)
        edge -= shares[k]
    out = out.withColumn("label", label.cast("int"))
    for d in range(1 + extra):
        out = out.withColumn(f"x{d + 1}", uniform(seed, 100 + d, "window_id", "t") * 4.4 - 2.2)
    out = out.withColumn("z1", F.cos(F.col("label") * (2 * math.pi / len(laws))) * 1.2 + 0.6 * normal(seed, 420, "window_id"))
    out = out.withColumn("z2", F.sin(F.col("label") * (2 * math.pi / len(laws))) * 1.2 + 0.6 * normal(seed, 430, "window_id"))
    mean = F.element_at(F.array(*[F.expr(e).cast("double") for e in laws]), F.col("label") + 1)
    return out.withColumn("y", mean + sigma * normal(seed, 200, "window_id", "t"))


def nested_families(spark: SparkSession, count: int, n: int, sigma: float, by: str = "per_window", groups: int = 8, seed: int = 11) -> DataFrame:
    """x1, or x1 and a bend s * x1^2; the covariate s is uniform for each window, or each group of windows."""
    p = Problem(("x1", "x1"))
    rows = windows(spark, p, count, n, 0.0, seed).withColumn("group_id", F.col("window_id") % groups)
    s = uniform(seed, 21, "window_id") if by == "per_window" else uniform(seed, 21, "group_id")
    rows = rows.withColumn("s", s)
    return rows.withColumn("y", F.col("x1") + F.when(F.col("label") == 1, F.col("s") * F.col("x1") * F.col("x1")).otherwise(0.0) + sigma * normal(seed, 200, "window_id", "t"))


def null_or_signal(spark: SparkSession, count: int, n: int, sigma: float, disturbance: str = "none", seed: int = 11) -> DataFrame:
    """Noise alone (label 0) or a law 2 sin 2x (label 1), under a disturbance of both: none, offset, slope or wave."""
    extra = {"none": F.lit(0.0), "offset": F.lit(1.5), "slope": F.col("x1"), "wave": F.sin(5 * F.col("x1"))}[disturbance]
    rows = windows(spark, Problem(("0", "2*sin(2*x1)")), count, n, sigma, seed)
    return rows.withColumn("y", F.col("y") + extra * (uniform(seed, 23, "window_id") - 0.5))


def rescaled(spark: SparkSession, count: int, n: int, sigma: float, scale: float = 1.5, memory: float = 0.6, seed: int = 11) -> DataFrame:
    """A base law, the same scaled, another law, and the base with memory: an exponential mean of it over the window's order."""
    rows = windows(spark, Problem(("x1*x1", f"{scale}*x1*x1", "2*sin(x1)", "x1*x1")), count, n, 0.0, seed).withColumnRenamed("y", "_m")
    lists = rows.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("t", "_m"))).alias("_s"))
    start = F.array(F.struct(F.col("_s")[0]["t"].alias("t"), F.col("_s")[0]["_m"].alias("e"))).cast("array<struct<t:int,e:double>>")
    step = lambda acc, s: F.concat(acc, F.array(F.struct(s["t"].alias("t"), (memory * F.element_at(acc, -1)["e"] + (1 - memory) * s["_m"]).alias("e"))))
    slow = lists.select("window_id", F.inline(F.aggregate(F.slice("_s", F.lit(2), F.greatest(F.size("_s") - 1, F.lit(0))), start, step)))
    out = rows.join(slow, ["window_id", "t"])
    return out.withColumn("y", F.when(F.col("label") == 3, F.col("e")).otherwise(F.col("_m")) + sigma * normal(seed, 200, "window_id", "t")).drop("_m", "e")


def stream(spark: SparkSession, count: int, n: int, sigma: float, newcomer_at: int | None = None, drift: float = 0.0, seed: int = 11) -> DataFrame:
    """Windows of x^2 + x and x^2 - x in the order of window_id; from newcomer_at on also of x^2 + 6 sin 2x, and both slopes turn by `drift` a window."""
    laws = ("x1*x1 + x1", "x1*x1 - x1", "x1*x1 + 6*sin(2*x1)")
    rows = windows(spark, Problem(laws), count, n, 0.0, seed)
    u = uniform(seed, 31, "window_id")
    late = F.lit(False) if newcomer_at is None else F.col("window_id") >= newcomer_at
    rows = rows.withColumn("label", F.when(late & (u < 1 / 3), 2).otherwise((uniform(seed, 32, "window_id") < 0.5).cast("int")))
    slope = F.when(F.col("label") == 0, 1.0).otherwise(-1.0) * (1 + drift * F.col("window_id"))
    mean = F.col("x1") * F.col("x1") + F.when(F.col("label") == 2, 6 * F.sin(2 * F.col("x1"))).otherwise(slope * F.col("x1"))
    return rows.withColumn("y", mean + sigma * normal(seed, 200, "window_id", "t"))


def high_frequency_stream(spark: SparkSession, count: int, n: int, sigma: float, onset: int, seed: int = 11) -> DataFrame:
    """Windows of sin 5x until the onset, of sin 6x for half of those after it."""
    rows = windows(spark, PROBLEMS["high_frequency"], count, n, 0.0, seed)
    rows = rows.withColumn("label", F.when(F.col("window_id") < onset, 0).otherwise(F.col("label")))
    return rows.withColumn("y", F.sin(F.when(F.col("label") == 0, 5).otherwise(6) * F.col("x1")) + sigma * normal(seed, 200, "window_id", "t"))


def shared_component(spark: SparkSession, count: int, n: int, sigma: float, strength: float, shared: str = "x1*x1", gap: str = "2*x1", seed: int = 11) -> DataFrame:
    """y = strength * shared + (label - 1/2) * gap + noise."""
    rows = windows(spark, Problem(("0", "0")), count, n, 0.0, seed)
    return rows.withColumn("y", strength * F.expr(shared) + (F.col("label") - 0.5) * F.expr(gap) + sigma * normal(seed, 200, "window_id", "t"))


def training_and_test(spark: SparkSession, m: int, test: int, n: int, sigma: float, p: int = 3, design: str = "random", seed: int = 11) -> DataFrame:
    """m training windows a class and `test` others (column training), of laws that differ in the first of p powers of x; inputs are
    drawn anew for each window ("random"), or the same in all ("fixed")."""
    rows = windows(spark, Problem(("0", "0")), 2 * m + test, n, 0.0, seed)
    if design == "fixed":
        rows = rows.withColumn("x1", uniform(seed, 100, "t") * 4 - 2)
    rows = rows.withColumn("training", F.col("window_id") < 2 * m).withColumn("label", F.when(F.col("training"), (F.col("window_id") % 2).cast("int")).otherwise(F.col("label")))
    shared = sum((F.pow(F.col("x1"), F.lit(float(k))) for k in range(2, p + 1)), F.lit(0.0))
    return rows.withColumn("y", shared + (F.col("label") * 2 - 1) * F.col("x1") + sigma * normal(seed, 200, "window_id", "t"))
