"""Closed forms for the error of telling laws apart, with Monte-Carlo counterparts as DataFrames."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .special import chi2_isf, ncx2_sf, q, q_column, q_inverse

OVERSHOOT = 0.5826  # fixed value: mean overshoot of a Gaussian walk over a barrier, in standard deviations


def two_law_error(rho: Column | float, n: Column | int) -> Column:
    """Population error Q(sqrt(n rho) / 2) of the better of two known laws."""
    return q_column(F.sqrt(F.lit(n) * F.lit(rho)) / 2)


def exact_error(windows: DataFrame, gap2: str, sigma: float) -> Column:
    """Mean over windows of Q(sqrt(sum gap^2) / 2 sigma)."""
    return F.avg(q_column(F.sqrt(F.col(gap2)) / (2 * sigma)))


def simulated_error(spark: SparkSession, windows: int, n: int, gap: Column, sigma: float, seed: int = 11) -> DataFrame:
    """error: share of windows whose noise e has sum(e g) < -sum(g^2) / 2. gap: a Column of x in [-2, 2]."""
    u = lambda i: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    rows = spark.range(windows * n).withColumn("w", F.floor(F.col("id") / n)).withColumn("x", u(1) * 4 - 2)
    e = F.sqrt(-2 * F.log(u(2))) * F.cos(u(3) * (2 * math.pi)) * sigma
    per = rows.select("w", gap.alias("g"), e.alias("e")).groupBy("w").agg(F.sum(F.col("g") * F.col("g")).alias("d"), F.sum(F.col("e") * F.col("g")).alias("eg"))
    return per.agg(F.avg((F.col("eg") < -F.col("d") / 2).cast("double")).alias("error"), exact_error(per, "d", sigma).alias("exact"))


def k_law_error(k: int, t: float, nodes: int = 80) -> float:
    """1 - E[Phi(t sqrt 2 + W)^(K-1)] for K laws at equal distances."""
    x, w = np.polynomial.hermite_e.hermegauss(nodes)
    phi = np.array([1 - q(t * math.sqrt(2) + v) for v in x])
    return float(1 - (w * phi ** (k - 1)).sum() / w.sum())


def k_law_bounds(k: int, t: float) -> tuple[float, float]:
    return 2 / k * q(t), (k - 1) * q(t)


def windows_needed(rho: float, error: float) -> float:
    """n at which the two-law error is `error`."""
    lo, hi = 0.0, 1.0
    while q(math.sqrt(hi * rho) / 2) > error:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if q(math.sqrt(mid * rho) / 2) > error else (lo, mid)
    return hi


def efficiency(psi, score_pdf, lo: float = -60.0, hi: float = 60.0, points: int = 200_001) -> float:
    """Var(e) (E psi')^2 / E psi^2 by quadrature. psi: influence; score_pdf: density of the noise."""
    x = np.linspace(lo, hi, points)
    p = score_pdf(x)
    p = p / np.trapezoid(p, x)
    slope = np.gradient(psi(x), x)
    return float(np.trapezoid(x * x * p, x) * np.trapezoid(slope * p, x) ** 2 / np.trapezoid(psi(x) ** 2 * p, x))


def loss_error(n: float, rho: float, eta: float) -> float:
    return q(0.5 * math.sqrt(n * rho * eta))


def cusum_delay(rho: Column, h: Column, kappa: float = 0.0) -> Column:
    """Expected samples to an alarm after a change, with the overshoot correction."""
    b = h + 2 * OVERSHOOT * F.sqrt(rho + kappa * rho * rho / 4)
    return (b + F.exp(-b) - 1) / (rho / 2)


def cusum_arl(rho: Column, h: Column, kappa: float = 0.0) -> Column:
    """Expected samples to a false alarm."""
    b = h + 2 * OVERSHOOT * F.sqrt(rho + kappa * rho * rho / 4)
    return (F.exp(b) - b - 1) / (rho / 2)


def plug_in_error(n: float, rho: float, p: int, m: float) -> float:
    """Error of a law classifier with laws of p terms learned from m windows a class."""
    d2 = n * rho
    return q(d2 / (2 * math.sqrt(d2 + 2 * p / m)))


def masked_error(gap: np.ndarray, cov: np.ndarray, s2: float = 1.0, prior: float = 0.5) -> float:
    """Error with some samples missing and correlated noise: gap over the samples seen, its noise covariance."""
    norm, spread = float(gap @ gap), math.sqrt(float(gap @ cov @ gap))
    shift = s2 * math.log(prior / (1 - prior))
    return (1 - prior) * q((norm / 2 - shift) / spread) + prior * q((norm / 2 + shift) / spread)


def ar1_errors(gap: np.ndarray, sigma: float, phi: float) -> tuple[float, float]:
    """Errors of least squares and of generalised least squares under AR(1) noise."""
    i = np.arange(len(gap))
    cov = sigma**2 * phi ** np.abs(i[:, None] - i[None, :])
    return q(float(gap @ gap) / (2 * math.sqrt(float(gap @ cov @ gap)))), q(0.5 * math.sqrt(float(gap @ np.linalg.solve(cov, gap))))


def novelty_power(n: int, rho: float, alpha: float) -> float:
    """Chance that a window of a new law is seen as novel."""
    return ncx2_sf(chi2_isf(alpha, n), n, n * rho)


def curvature_excess(rho: float, kappa: float, error: float) -> float:
    """How much longer windows must be, in first order, since the gap's square varies over inputs: kappa (1 + 1/z^2) rho / 16, z the
    normal deviate of the error."""
    z = q_inverse(error)
    return kappa * (1 + 1 / (z * z)) * rho / 16


def windows_needed_exact(draws: np.ndarray, sigma: float, error: float, most: int = 100_000) -> int:
    """Least n with a mean error below `error` over inputs: draws (replicates, places) of squared gaps; the first n places of each count."""
    total = np.cumsum(draws, 1)
    lo, hi = 1, min(total.shape[1], most)
    mean = lambda n: float(np.mean([q(math.sqrt(v) / (2 * sigma)) for v in total[:, n - 1]]))
    if mean(hi) > error:
        raise ValueError("the draws are too short")
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if mean(mid) <= error else (mid + 1, hi)
    return lo


def shared_component_error(spark: SparkSession, windows: int, n: int, gap: Column, shared: Column, strength: float, sigma: float, seed: int = 11) -> DataFrame:
    """error, shifted: share of windows told wrongly without, and with, a component of both laws; they are equal window by window."""
    u = lambda i: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    rows = spark.range(windows * n).withColumn("w", F.floor(F.col("id") / n)).withColumn("x", u(1) * 4 - 2)
    e = F.sqrt(-2 * F.log(u(2))) * F.cos(u(3) * (2 * math.pi)) * sigma
    rows = rows.select("w", gap.alias("g"), e.alias("e"), (shared * strength).alias("c"))
    cost = lambda y, f: F.sum(F.pow(y - f, F.lit(2.0)))
    y0, y1 = F.col("g") / 2 + F.col("e"), F.col("c") + F.col("g") / 2 + F.col("e")
    per = rows.groupBy("w").agg(
        (cost(y0, F.col("g") / 2) > cost(y0, -F.col("g") / 2)).alias("a"), (cost(y1, F.col("c") + F.col("g") / 2) > cost(y1, F.col("c") - F.col("g") / 2)).alias("b"))
    return per.agg(F.avg(F.col("a").cast("double")).alias("error"), F.avg(F.col("b").cast("double")).alias("shifted"))


def k_law_simulated(k: int, t: float, draws: int = 20_000, seed: int = 0) -> float:
    """Monte-Carlo counterpart of k_law_error(): K laws at equal distances, one of them true."""
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(draws, k))
    z[:, 0] += t * math.sqrt(2)
    return float((z.argmax(1) != 0).mean())


def likelihood_efficiency(log_density, density, lo: float = -60.0, hi: float = 60.0, points: int = 200_001) -> float:
    """Efficiency of the likelihood-ratio rule: variance times Fisher information of the noise."""
    x = np.linspace(lo, hi, points)
    p = density(x)
    p = p / np.trapezoid(p, x)
    slope = np.gradient(log_density(x), x)
    return float(np.trapezoid(x * x * p, x) * np.trapezoid(slope * slope * p, x))


def loss_error_simulated(loss, noise: np.ndarray, n: int, gap: float) -> float:
    """Share of windows of n residuals `noise` (W * n of them) that cost less under a law `gap` away than under their own."""
    e = noise[: len(noise) // n * n].reshape(-1, n)
    return float((loss(e + gap).sum(1) < loss(e).sum(1)).mean())


def verdict(predicted: float, found: float, within: float = 0.1) -> str:
    """Where a prediction stands: "holds", "high" or "low" by more than a share `within`."""
    gap = (predicted - found) / max(abs(found), 1e-12)
    return "holds" if abs(gap) <= within else "high" if gap > 0 else "low"


def cusum_delay_first(rho: Column, h: Column) -> Column:
    """Expected delay in first order: the threshold over the drift."""
    return 2 * h / rho


def cusum_delay_brownian(rho: Column, h: Column) -> Column:
    """Expected delay of the continuous process, without overshoot."""
    return (h + F.exp(-h) - 1) / (rho / 2)


def cusum_arl_brownian(rho: Column, h: Column) -> Column:
    return (F.exp(h) - h - 1) / (rho / 2)


def plug_in_error_random(n: float, rho: float, p: int, m: float) -> float:
    """As plug_in_error() with inputs drawn anew: m windows count as m - (p + 1) / n."""
    return plug_in_error(n, rho, p, max(m - (p + 1) / n, 1e-9))


def plug_in_error_simulated(n: int, rho: float, p: int, m: float, draws: int = 20_000, seed: int = 0) -> float:
    """Monte-Carlo counterpart in mechanism space: two centres sqrt(n rho) apart in p dimensions, each known from m windows."""
    rng, d = np.random.default_rng(seed), math.sqrt(n * rho)
    centre = np.zeros((2, p))
    centre[1, 0] = d
    found = centre + rng.normal(size=(draws, 2, p)) / math.sqrt(m)
    own = rng.normal(size=(draws, p))
    far = ((own[:, None] - found) ** 2).sum(-1)
    return float((far[:, 1] < far[:, 0]).mean())


def labelled_windows_needed(n: float, rho: float, p: int, excess: float, most: float = 1e9) -> float:
    """m at which plug_in_error() exceeds the error of known laws by no more than `excess`."""
    floor = q(0.5 * math.sqrt(n * rho))
    lo, hi = 1e-6, 1.0
    while plug_in_error(n, rho, p, hi) - floor > excess and hi < most:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if plug_in_error(n, rho, p, mid) - floor > excess else (lo, mid)
    return hi


def centred_masked_error(gap: np.ndarray, cov: np.ndarray, seen: np.ndarray, s2: float = 1.0, prior: float = 0.5) -> float:
    """As masked_error() of the samples seen, their level taken out."""
    g = gap[seen] - gap[seen].mean()
    m = np.eye(len(g)) - 1 / len(g)
    return masked_error(g, m @ cov[np.ix_(seen, seen)] @ m, s2, prior)


def decided_share(gap: np.ndarray, cov: np.ndarray, s2: float, confidence: float, prior: float = 0.5) -> float:
    """Share of windows whose posterior of either law is at least `confidence`."""
    norm, spread = float(gap @ gap), math.sqrt(float(gap @ cov @ gap))
    edge = s2 * math.log(confidence / (1 - confidence))
    shift = s2 * math.log(prior / (1 - prior))
    up = lambda mean, at: q((at - mean) / spread)
    first = up(norm / 2 + shift, edge) + 1 - up(norm / 2 + shift, -edge)
    second = up(norm / 2 - shift, edge) + 1 - up(norm / 2 - shift, -edge)
    return prior * first + (1 - prior) * second


def newcomer_rho(rows: DataFrame, new: Column, known: list[Column], sigma: float) -> float:
    """Least mean squared gap of a new law to the known ones, over the noise variance."""
    r = rows.agg(*[F.avg(F.pow(new - k, F.lit(2.0))) for k in known]).first()
    return float(min(r)) / sigma**2


def error_curve(rho: float, lengths: list[int], draws: np.ndarray, sigma: float) -> list[dict]:
    """For each window length the population error, and the mean error over inputs: draws (replicates, places) of squared gaps."""
    total = np.cumsum(draws, 1)
    return [{"n": n, "nrho": n * rho, "population": q(0.5 * math.sqrt(n * rho)), "exact": float(np.mean([q(math.sqrt(v) / (2 * sigma)) for v in total[:, n - 1]]))} for n in lengths]
