"""Sites, splits and audits of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def site_of(scene: Column, sites: list[str]) -> Column:
    """The site whose name the scene holds; of several the first with "?MULTI"; of none "AMBIGUOUS:" and
    the scene without its date, which is what comes before the first underscore."""
    hits = F.filter(F.array(*map(F.lit, sites)), lambda s: F.contains(scene, s))
    return F.when(F.size(hits) == 1, F.element_at(hits, 1)).when(F.size(hits) > 1, F.concat(F.element_at(hits, 1), F.lit("?MULTI"))).otherwise(F.concat(F.lit("AMBIGUOUS:"), F.regexp_replace(scene, "^[^_]*_", "")))


def split_frames(frames: DataFrame, splits: DataFrame, scene: str = "scene") -> DataFrame:
    """frames by split: a frame belongs to each site whose name its scene holds, once for each. splits (split, site) is
    a manifest of some dozens of rows, so the theta join broadcasts it."""
    return frames.join(F.broadcast(splits), F.contains(F.col(scene), F.col("site")))


def location(scene: Column, first: int = 3) -> Column:
    """The tokens from `first` on of a scene's name."""
    parts = F.split(scene, "_")
    return F.array_join(F.slice(parts, first + 1, F.greatest(F.size(parts) - first, F.lit(0))), "_")


def halves(frames: DataFrame, by: str, order: str) -> DataFrame:
    """frames with half: A for every other frame of a scene, from the first; else B."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return frames.withColumn("half", F.when(at % 2 == 1, "A").otherwise("B"))


def audit_frames(pixels: DataFrame, least: int = 10) -> DataFrame:
    """Per frame: n, ignore_frac, ood_frac, is_anomaly (one out-of-distribution class of `least` pixels), is_pure (no
    such pixel)."""
    by_class = pixels.groupBy("split", "site", "frame_id", "label_key", "gt").agg(F.count("*").alias("n"))
    total = F.sum("n")
    of = lambda gt: F.sum(F.when(F.col("gt") == gt, F.col("n")).otherwise(0))
    return by_class.groupBy("split", "site", "frame_id").agg(
        total.alias("n"), F.round(of(255) / total, 6).alias("ignore_frac"), F.round(of(1) / total, 6).alias("ood_frac"),
        F.coalesce(F.max(F.when(F.col("gt") == 1, F.col("n"))) >= least, F.lit(False)).alias("is_anomaly"), (of(1) == 0).alias("is_pure"),
    )
