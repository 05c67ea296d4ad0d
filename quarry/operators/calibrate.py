"""Thresholds: percentiles, conformal quantiles, class-conditional calibration, and what they flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import ranking

ALPHA, CAP, LEAST = 0.05, 200, 100
INF = float("inf")


def zstats(df: DataFrame, scores: list[str]) -> DataFrame:
    """One row: of each score m_<score> and s_<score>, its mean and population standard deviation."""
    return df.agg(*(f(s).alias(f"{a}_{s}") for s in scores for f, a in ((F.avg, "m"), (F.stddev_pop, "s"))))


def conformal(df: DataFrame, by: list[str], score: str = "score", alpha: float = ALPHA) -> DataFrame:
    """by, n, tau: the k-th smallest score, k = ceil((n + 1)(1 - alpha)); infinite where k is over n.

    Counts by distinct score carry the ranks, so equal scores cost one row; see ranking.running for how they are added up.
    """
    counted = df.groupBy(*by, F.col(score).cast("double").alias("__s")).agg(F.count("*").alias("__m"))
    k = F.ceil((F.col("__m_all") + 1) * F.lit(1 - alpha))
    return ranking.running(counted, by, "__s", ["__m"]).groupBy(*by).agg(F.max("__m_all").alias("n"), F.coalesce(F.min(F.when(F.col("__m_upto") >= k, F.col("__s"))), F.lit(INF)).alias("tau"))


def capped_sample(df: DataFrame, frame: str, cls: str, order: list[Column], cap: int = CAP) -> DataFrame:
    """No more than cap rows of each frame and class, the first in the given pseudo-random order."""
    at = F.row_number().over(Window.partitionBy(frame, cls).orderBy(*order))
    return df.withColumn("__at", at).filter(F.col("__at") <= cap).drop("__at")


def class_thresholds(sample: DataFrame, calibration: DataFrame, cls: str, score: str = "score", alpha: float = ALPHA, least: int = LEAST, percentile: bool = False) -> DataFrame:
    """cls, n, tau, is_fallback for the classes of the sample: their own conformal quantile, or with fewer than `least`
    rows that of the whole, uncapped calibration set."""
    if percentile:
        tau = lambda by, d: ranking.quantiles(d, by, score, [1 - alpha]).select(*by, F.col("q").alias("tau"))
        at = lambda by, d: tau(by, d).join(d.groupBy(*by).agg(F.count("*").alias("n")), by) if by else tau(by, d)
    else:
        at = lambda by, d: conformal(d, by, score, alpha)
    own, every = at([cls], sample), at([], calibration).select(F.col("tau").alias("tau_all"))
    out = own.crossJoin(F.broadcast(every)).withColumn("is_fallback", F.col("n") < least)
    return out.select(cls, "n", F.when(F.col("is_fallback"), F.col("tau_all")).otherwise(F.col("tau")).alias("tau"), "is_fallback", "tau_all")


def flag(df: DataFrame, thresholds: DataFrame, fallback: DataFrame, cls: str, score: str = "score") -> DataFrame:
    """df with tau (its class's, else the one row of fallback) and flag: strictly over it."""
    out = df.join(F.broadcast(thresholds.select(cls, F.col("tau").alias("tau_c"))), cls, "left").crossJoin(F.broadcast(fallback.select(F.col("tau").alias("tau_g"))))
    out = out.withColumn("tau", F.coalesce("tau_c", "tau_g"))
    return out.withColumn("flag", F.col(score) > F.col("tau")).drop("tau_c", "tau_g")


def operating_point(flagged: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """by, fpr, recall, n_id, n_ood."""
    n = lambda gt: F.sum(F.when(F.col("gt") == gt, 1).otherwise(0))
    hit = lambda gt: F.sum(F.when((F.col("gt") == gt) & F.col("flag"), 1).otherwise(0))
    rate = lambda gt: F.round(hit(gt) / F.greatest(n(gt), F.lit(1)).cast("double"), digits)
    return flagged.groupBy(*by).agg(rate(0).alias("fpr"), rate(1).alias("recall"), n(0).alias("n_id"), n(1).alias("n_ood"))


def uniformity(flagged: DataFrame, by: list[str], cls: str, alpha: float = ALPHA, least: int = 2000) -> DataFrame:
    """by, worst, frac_over (rate over twice alpha), mad (mean distance from alpha) of the classes' false-positive rates,
    over classes with `least` in-distribution rows."""
    rates = flagged.filter("gt = 0").groupBy(*by, cls).agg(F.count("*").alias("n"), F.avg(F.col("flag").cast("double")).alias("r")).filter(F.col("n") >= least)
    return rates.groupBy(*by).agg(F.round(F.max("r"), 6).alias("worst"), F.round(F.avg((F.col("r") > 2 * alpha).cast("double")), 6).alias("frac_over"), F.round(F.avg(F.abs(F.col("r") - alpha)), 6).alias("mad"), F.count("*").alias("n_classes"))
