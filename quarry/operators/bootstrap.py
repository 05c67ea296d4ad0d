"""Frame bootstrap on histograms: pixels are read once, resamples work on counts by frame and bin."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.operators import ranking

BINS, DRAWS = 4000, 1000
#: Draws whose metrics one task works out together.
DRAWS_AT_ONCE = 50
PRIME = 2147483647
#: Where a uniform number below PRIME begins to stand for one, two, ... takes: sums of exp(-1) / k!.
POISSON = np.array([int(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(11)], np.int64)
#: Parts that the scores of an exact bootstrap are cut into; rows of a part, and frames and draws, that are worked out together.
PARTS, ROWS_AT_ONCE, FRAMES_AT_ONCE, DRAWS_IN_CACHE = 64, 2048, 1 << 20, 64
METRICS = ("ap", "auroc", "fpr95")


def edges(sample: DataFrame, by: list[str], score: str, bins: int = BINS) -> DataFrame:
    """by, edges: an array of the distinct quantiles of a sample in `bins` equal steps, the ends moved out by 1e-6."""
    q = ranking.quantiles(sample, by, score, bins).groupBy(*by).agg(F.array_sort(F.collect_set("q")).alias("q"))
    moved = F.transform("q", lambda x, i: F.when(i == 0, x - 1e-6).when(i == F.size("q") - 1, x + 1e-6).otherwise(x))
    return q.select(*by, moved.alias("edges"))


def bin_of(value: Column, cuts: Column) -> Column:
    """The bin of an ascending array of edges that holds a value between the first and the last; bins are closed below, the
    last also above."""
    return F.least(ranking.place_in(value, cuts), F.size(cuts) - 2)


def histogram(df: DataFrame, by: list[str], cuts: DataFrame, on: list[str], score: str = "score") -> DataFrame:
    """by, bin, n_id, n_ood. cuts: (on, edges), a row per group of on, whose arrays have as many elements as a setting says;
    scores outside are dropped."""
    rows = df.filter(F.col("gt") != 255).groupBy(*dict.fromkeys([*by, *on]), F.col(score).cast("double").alias("__s")).agg(*(F.count_if(F.col("gt") == k).alias(a) for k, a in ((0, "n_id"), (1, "n_ood"))))
    rows = rows.join(F.broadcast(cuts), on) if on else rows.crossJoin(F.broadcast(cuts))
    inside = rows.filter((F.size("edges") > 1) & F.col("__s").between(F.element_at("edges", 1), F.element_at("edges", -1)))
    return inside.withColumn("bin", bin_of(F.col("__s"), F.col("edges"))).groupBy(*by, "bin").agg(F.sum("n_id").alias("n_id"), F.sum("n_ood").alias("n_ood"))


def frame_number(frame: Column, kind: str) -> Column:
    """The whole number that a frame's weights come from: itself, or a hash of a name."""
    return frame.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(frame)


def draw_weights(frames: np.ndarray, draws: int) -> np.ndarray:
    """(draws, frames): how often each draw takes each frame, Poisson numbers of mean 1 made from the draw's and the frame's
    numbers alone. So tasks make the weights that they need, and none are shuffled; other engines can make them too, by
    squares modulo a prime."""
    return _weights(frames, np.arange(draws)).T


def _folded(x: np.ndarray, times: int) -> np.ndarray:
    """A number of the same remainder by PRIME, which is 2 ** 31 - 1, in place and without a division. Numbers below 2 ** 63 get
    below 2 ** 33 at once, and at most PRIME + 1 by the second time."""
    for _ in range(times):
        high = x >> 31
        x &= PRIME
        x += high
    return x


def _weights(frames: np.ndarray, boots: np.ndarray) -> np.ndarray:
    """(frames, boots) as bytes: what draw_weights has for some draws."""
    frame, boot = (frames.astype(np.int64) % PRIME)[:, None], boots.astype(np.int64)[None, :]
    out = np.empty((len(frames), len(boots)), np.uint8)
    step = max(1, (1 << 15) // max(1, len(boots)))  # so that what is worked on stays in the cache
    for at in range(0, len(frames), step):
        f = frame[at : at + step]
        x = _folded(f * 7919 + (boot * 1000003 + 17), 2)
        x *= 48271
        x = _folded(x, 2)
        x *= x
        x += boot * 69621 + f
        x = _folded(x, 2)
        x *= x
        x = _folded(x, 2)
        x -= (x >= PRIME) * PRIME
        x = x.astype(np.int32)
        own = out[at : at + step]
        np.greater_equal(x, np.int32(POISSON[0]), out=own.view(bool))
        for t in POISSON[1:]:
            own += (x >= np.int32(t)).view(np.uint8)
    return out


def resamples(spark: SparkSession, frames: DataFrame, draws: int = DRAWS) -> DataFrame:
    """boot, frame_id, w: draw_weights as a table, without zeros; a row per frame and draw."""
    kind = frames.schema["frame_id"].dataType.simpleString()
    rows = frames.select("frame_id").distinct().withColumn("f", F.pmod(frame_number(F.col("frame_id"), kind), F.lit(PRIME)))
    rows = rows.crossJoin(F.broadcast(spark.range(draws).select(F.col("id").alias("boot"))))
    x = (F.col("boot") * 1000003 + F.col("f") * 7919 + 17) % PRIME * 48271 % PRIME
    rows = rows.withColumn("x", x).withColumn("x", (F.col("x") * F.col("x") + F.col("boot") * 69621 + F.col("f")) % PRIME).withColumn("x", F.col("x") * F.col("x") % PRIME)
    w = sum((F.when(F.col("x") >= int(t), 1).otherwise(0) for t in POISSON), F.lit(0))
    return rows.select("boot", "frame_id", w.alias("w")).filter("w > 0")


def hist_metrics(hist: DataFrame, by: list[str], digits: int | None = 6) -> DataFrame:
    """by, ap, auroc, fpr95 of counts by bin. The trapezoid starts at the first bin, without the point (0, 0)."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    down = group.orderBy(F.col("bin").desc())
    rows = hist.groupBy(*by, "bin").agg(F.sum("n_id").cast("double").alias("n"), F.sum("n_ood").cast("double").alias("p"))
    rows = rows.withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("n").over(down)).withColumn("pos", F.sum("p").over(group)).withColumn("neg", F.sum("n").over(group))
    rows = rows.withColumn("tpr", F.col("tp") / F.col("pos")).withColumn("fpr", F.col("fp") / F.col("neg"))
    rows = rows.withColumn("tpr0", F.lag("tpr").over(down)).withColumn("fpr0", F.lag("fpr").over(down))
    ap = F.sum(F.col("p") / F.col("pos") * F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1.0)))
    auroc = F.sum((F.col("fpr") - F.col("fpr0")) * (F.col("tpr") + F.col("tpr0")) / 2)
    fpr95 = F.min(F.when(F.col("tpr") >= 0.95, F.col("fpr")))
    shown = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return rows.groupBy(*by).agg(shown(ap).alias("ap"), shown(auroc).alias("auroc"), shown(fpr95).alias("fpr95"))


def _curves(n: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
    """ap, auroc and fpr95 of a draw in every row, from its counts by ascending bin; NaN where a draw has but one class."""
    p, n = p[:, ::-1], n[:, ::-1]
    tp, fp, pos, neg = p.cumsum(axis=1), n.cumsum(axis=1), p.sum(axis=1, keepdims=True), n.sum(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        tpr, fpr = tp / pos, fp / neg
        ap = (p / pos * tp / np.maximum(tp + fp, 1.0)).sum(axis=1)
        auroc = (np.diff(fpr, axis=1) * (tpr[:, 1:] + tpr[:, :-1]) / 2).sum(axis=1)
        fpr95 = np.where(tpr >= 0.95, fpr, np.inf).min(axis=1)
    bad = (pos * neg)[:, 0] == 0
    return {k: np.where(bad, np.nan, v) for k, v in (("ap", ap), ("auroc", auroc), ("fpr95", fpr95))}


def draw_sums(hist: DataFrame, by: str, bins: int = BINS, draws: int = DRAWS) -> DataFrame:
    """by, part, product: for DRAWS_AT_ONCE draws in a row, the counts by bin (n_id, then n_ood) that they sum up to, partly
    added up.

    hist (by, frame_id, bin, n_id, n_ood). A task multiplies the matrix of its frames' weights by that of their counts, which
    takes draws times bins numbers of memory, whatever the number of frames.
    """
    frame = frame_number(F.col("frame_id"), hist.schema["frame_id"].dataType.simpleString())
    rows = hist.groupBy(by, frame.alias("f")).agg(F.collect_list(F.struct("bin", "n_id", "n_ood")).alias("h")).select(by, "f", "h.bin", "h.n_id", "h.n_ood")
    kind, pa_kind = hist.schema[by].dataType.simpleString(), to_arrow_type(hist.schema[by].dataType)

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The row of each element, and the elements."""
        sizes = np.diff(column.offsets.to_numpy())
        return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def out() -> Iterator[pa.RecordBatch]:
            for key, total in sums.items():
                for a in range(0, draws, DRAWS_AT_ONCE):
                    own = total[a : a + DRAWS_AT_ONCE]
                    yield pa.RecordBatch.from_pydict({by: pa.array([key], pa_kind), "part": pa.array([a // DRAWS_AT_ONCE], pa.int32()), "product": pa.array([own.astype("<i8").tobytes()], pa.binary())})
            sums.clear()

        for batch in batches:
            names = batch.column(by).to_pylist()
            for key in dict.fromkeys(names):
                if key not in sums and len(sums) == 4:
                    yield from out()
                total = sums.setdefault(key, np.zeros((draws, 2 * bins)))
                mine = batch.filter(pa.array([x == key for x in names]))
                for a in range(0, mine.num_rows, 500):
                    some = mine.slice(a, 500)
                    counts = np.zeros((some.num_rows, 2 * bins))
                    at, place = flat(some.column("bin"))
                    counts[at, place] = flat(some.column("n_id"))[1]
                    counts[at, bins + place] = flat(some.column("n_ood"))[1]
                    total += draw_weights(some.column("f").to_numpy(), draws) @ counts
        yield from out()

    return rows.mapInArrow(multiply, f"`{by}` {kind}, part int, product binary")


def _added(products: pa.ChunkedArray, bins: int) -> np.ndarray:
    """(draws, 2 * bins) of what tasks have summed up."""
    return sum(np.frombuffer(x.as_buffer(), "<i8").reshape(-1, 2 * bins).astype(np.float64) for x in products)


def draws_metrics(hist: DataFrame, by: str, bins: int = BINS, draws: int = DRAWS) -> DataFrame:
    """by, boot, ap, auroc, fpr95 of every draw, null where it has but one class; all `bins` bins count, also empty ones."""
    kind = hist.schema[by].dataType.simpleString()

    def measured(key: tuple, table: pa.Table) -> pa.Table:
        total = _added(table.column("product"), bins)
        first = key[1].as_py() * DRAWS_AT_ONCE
        found = _curves(total[:, :bins], total[:, bins:])
        return pa.table({by: pa.array([key[0].as_py()] * len(total), table.schema.field(by).type), "boot": np.arange(first, first + len(total))} | {k: pa.array(v, from_pandas=True) for k, v in found.items()})

    return draw_sums(hist, by, bins, draws).groupBy(by, "part").applyInArrow(measured, f"`{by}` {kind}, boot long, ap double, auroc double, fpr95 double")


def exact_draws(df: DataFrame, by: str, score: str = "score", draws: int = DRAWS, parts: int = PARTS, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """by, boot, and of ap, auroc, fpr95 those asked for, of every draw of whole frames, by all distinct scores; null where a draw
    has but one class.

    Scores are cut into parts at exact quantiles. What every draw sums up to in the parts above comes from the parts' counts
    by frame, as for histograms; then each part goes down its own scores, some draws and some rows at a time. A part makes the
    weights of a frame once, for all of its rows.
    df: by, frame_id, score, gt.
    """
    frame = frame_number(F.col("frame_id"), df.schema["frame_id"].dataType.simpleString())
    rows = df.filter(F.col("gt").isin(0, 1)).groupBy(by, frame.alias("frame_id"), F.col(score).cast("double").alias("s")).agg(*(F.count_if(F.col("gt") == k).alias(a) for k, a in ((0, "n_id"), (1, "n_ood"))))
    cuts = ranking.quantiles(rows, [by], "s", parts).filter(F.col("k") < parts).groupBy(by).agg(F.array_sort(F.collect_set("q")).alias("cuts"))
    # a row per group of by, of which there may be two: a shuffle by it would bring all of a group's rows to one task
    rows = rows.join(F.broadcast(cuts), by).withColumn("bin", ranking.place_in(F.col("s"), F.col("cuts"))).drop("cuts")
    kind, pa_kind = df.schema[by].dataType.simpleString(), to_arrow_type(df.schema[by].dataType)

    def above(key: tuple, table: pa.Table) -> pa.Table:
        """What some draws sum up to above each part, and in all."""
        total = _added(table.column("product"), parts)
        up = [x[:, ::-1].cumsum(axis=1)[:, ::-1] for x in (total[:, :parts], total[:, parts:])]
        held = np.stack([up[0] - total[:, :parts], up[1] - total[:, parts:], np.broadcast_to(up[0][:, :1], up[0].shape), np.broadcast_to(up[1][:, :1], up[1].shape)], axis=1)
        return pa.table({by: pa.array([key[0].as_py()] * parts, pa_kind), "bin": np.arange(parts, dtype=np.int32), "part": np.full(parts, key[1].as_py(), np.int32), "held": pa.array([held[:, :, k].astype("<f8").tobytes() for k in range(parts)], pa.binary())})

    sums = rows.groupBy(by, "frame_id", "bin").agg(F.sum("n_id").alias("n_id"), F.sum("n_ood").alias("n_ood"))
    held = draw_sums(sums, by, parts, draws).groupBy(by, "part").applyInArrow(above, f"`{by}` {kind}, bin int, part int, held binary")

    def down(key: tuple, own: pa.Table, before: pa.Table) -> pa.Table:
        own, before = own.sort_by([("s", "descending")]), before.sort_by("part")
        fp, tp, neg, pos = np.concatenate([np.frombuffer(x.as_buffer(), "<f8").reshape(-1, 4) for x in before.column("held")]).T if len(before) else np.zeros((4, draws))
        score, frames = own.column("s").to_numpy(), own.column("frame_id").to_numpy()
        counts = [own.column(c).to_numpy() for c in ("n_id", "n_ood")]
        new = np.append(True, score[1:] != score[:-1])[: len(score)]
        if not set(metrics) - {"ap"}:  # it changes at scores out of distribution only, so the rows between two such are added up at once
            new = _before_positives(new, counts[1] > 0)
        group = np.cumsum(new) - 1
        names, index = np.unique(frames, return_inverse=True)
        ap, pairs, fpr95 = np.zeros(draws), np.zeros(draws), np.full(draws, np.inf)
        step = max(1, min(DRAWS_IN_CACHE, FRAMES_AT_ONCE * DRAWS_IN_CACHE // max(1, len(names))))
        for low in range(0, draws, step):
            some = slice(low, min(low + step, draws))
            weights = _weights(names, np.arange(some.start, some.stop))
            f, t = fp[some].copy(), tp[some].copy()
            at = 0
            with np.errstate(invalid="ignore", divide="ignore"):
                while at < len(score):
                    upto = min(at + ROWS_AT_ONCE, len(score))
                    if upto < len(score) and group[upto] == group[upto - 1]:  # whole groups, or else one that is larger
                        first = int(np.searchsorted(group, group[upto]))
                        upto = first if first > at else int(np.searchsorted(group, group[at], side="right"))
                    n, p = (_added_up(weights, index[at:upto], c[at:upto], group[at:upto]) for c in counts)
                    n, held = n.cumsum(axis=0) + f, p.cumsum(axis=0) + t
                    ap[some] += np.nan_to_num(p * held / (n + held)).sum(axis=0)
                    if "auroc" in metrics:
                        pairs[some] += ((np.diff(n, axis=0, prepend=f[None, :])) * (held - p / 2)).sum(axis=0)
                    if "fpr95" in metrics:
                        fpr95[some] = np.minimum(fpr95[some], np.where(held / pos[some] >= 0.95, n / neg[some], np.inf).min(axis=0))
                    f, t, at = n[-1].copy(), held[-1].copy(), upto
        with np.errstate(invalid="ignore", divide="ignore"):
            ap, auroc = ap / pos, pairs / (pos * neg)
        bad = pos * neg == 0
        columns = {k: pa.array(np.where(bad, np.nan, v), from_pandas=True) for k, v in (("ap", ap), ("auroc", auroc), ("fpr95", fpr95)) if k in metrics}
        return pa.table({by: pa.array([key[0].as_py()] * draws, pa_kind), "boot": np.arange(draws)} | columns)

    columns = [k for k in METRICS if k in metrics]
    pieces = rows.groupBy(by, "bin").cogroup(held.groupBy(by, "bin")).applyInArrow(down, f"`{by}` {kind}, boot long, " + ", ".join(f"{k} double" for k in columns))
    return pieces.groupBy(by, "boot").agg(*((F.min if k == "fpr95" else F.sum)(k).alias(k) for k in columns))


def _before_positives(new: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Which of the rows, whose scores begin where new says, begin a group once scores that no positive row has are joined with
    the next one that some has."""
    starts = np.flatnonzero(new)
    out = np.zeros(len(new), bool)
    if len(starts):
        has = np.logical_or.reduceat(positive, starts)
        out[starts[np.append(True, has[:-1])]] = True
    return out


def _added_up(weights: np.ndarray, frame: np.ndarray, count: np.ndarray, group: np.ndarray) -> np.ndarray:
    """(groups, draws): the sums of rows' weights times their counts, of rows in the order of their groups."""
    rows = np.flatnonzero(count)
    out = np.zeros((group[-1] - group[0] + 1, weights.shape[1]))
    if len(rows):
        own, n, at = weights[frame[rows]], count[rows], group[rows] - group[0]
        own = own * n[:, None].astype(np.float64) if n.max() > 1 else own
        if len(rows) == at[-1] - at[0] + 1 == len(np.unique(at)):
            out[at] = own
        else:
            starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            out[at[starts]] = np.add.reduceat(own, starts, axis=0, dtype=np.float64)
    return out


def interval(draws: DataFrame, by: list[str], value: str, digits: int = 6) -> DataFrame:
    """by, mean, lo, hi: the mean and the 2.5 and 97.5 percentiles; nulls are left out. A row per draw comes in."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*by).agg(F.round(F.avg(value), digits).alias("mean"), F.round(q[0], digits).alias("lo"), F.round(q[1], digits).alias("hi"))
