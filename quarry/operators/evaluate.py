"""End-to-end evaluation of one score on scored frames: pixel, component and bootstrap results in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import registry
from quarry.operators import bootstrap, components, ranking


def first_frames(frames: DataFrame, n: int | None, frame: str = "frame_id") -> DataFrame:
    """The rows of the first n frames, by name; all if n is None."""
    if n is None:
        return frames
    return frames.join(F.broadcast(frames.select(frame).distinct().orderBy(frame).limit(n)), frame, "left_semi")  # n is a setting


def strided(frames: DataFrame, step: int) -> DataFrame:
    """Every step-th row and column of rasters (y, x), renumbered from 0."""
    if step == 1:
        return frames
    kept = frames.filter((F.col("y") % step == 0) & (F.col("x") % step == 0))
    return kept.withColumn("y", F.floor(F.col("y") / step).cast("int")).withColumn("x", F.floor(F.col("x") / step).cast("int"))


def median_and_deviation(frames: DataFrame, score: str = "score") -> DataFrame:
    """One row (k, thr): the median of all scores plus their standard deviation."""
    mid = ranking.quantiles(frames, [], score, [0.5]).select("q")
    return frames.agg(F.stddev_pop(score).alias("std")).crossJoin(F.broadcast(mid)).select(F.lit(0).alias("k"), (F.col("q") + F.col("std")).alias("thr"))


def evaluate(frames: DataFrame, method: str | None = None, columns: tuple[str, ...] = (), limit: int | None = None, downsample: int = 4, do_component: bool = False, n_boot: int = 0, digits: int = 6, side: int | None = None) -> DataFrame:
    """One row: n_frames, ap, auroc, fpr95, n_pos; with do_component also thr and component_f1 at it; with n_boot draws of
    whole frames also ap_mean, ap_lo, ap_hi.

    side: rows and columns of a frame at most, where they are known (see components.label).

    frames: frame_id, y, x, gt (0, 1, 255) and score, or the columns that the registered score `method` takes.
    """
    rows = strided(first_frames(frames, limit), downsample)
    if method:
        rows = registry.apply_score(rows, method, *columns)
    out = rows.agg(F.count_distinct("frame_id").alias("n_frames")).crossJoin(ranking.metrics(rows, [], digits=digits))
    if do_component:
        thr = median_and_deviation(rows)
        pixels = components.levels(rows, thr).withColumn("level", F.when(F.col("gt") != 255, F.col("level")).otherwise(0)).withColumn("truth", F.col("gt").eqNullSafe(1))
        f1 = components.f1_of_objects(components.objects(pixels, ["frame_id"], "frame_id", side=side), ["k"], digits=digits)
        out = out.crossJoin(thr.join(f1, "k", "left").select(F.round("thr", digits).alias("thr"), F.coalesce("f1", F.lit(0.0)).alias("component_f1")))
    if n_boot:
        drawn = bootstrap.exact_draws(rows.withColumn("__k", F.lit(0)), "__k", draws=n_boot, metrics=("ap",))
        ci = bootstrap.interval(drawn, [], "ap", digits)
        out = out.crossJoin(ci.select(*(F.col(c).alias(f"ap_{c}") for c in ("mean", "lo", "hi"))))
    return out
