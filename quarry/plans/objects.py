"""Object-level metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import calibrate, components, ranking, rasters
from quarry.operators.evaluate import evaluate, median_and_deviation
from quarry.plans.base import GRID, axis_sql, metrics_sql, points_sql, query
from quarry.sources import fixtures

BY = ["frame_id", "k"]
SIDE = 64  # of the grid's frames


def _label_sql(src: str, name: str) -> str:
    """CTEs that end in `name` (frame_id, k, y, x, comp); src has frame_id, k, y, x. Runs of pixels in a row are joined."""
    return f"""{name}_i AS (SELECT frame_id, k, y, x, x - row_number() OVER (PARTITION BY frame_id, k, y ORDER BY x) AS g FROM {src}),
{name}_u AS (SELECT frame_id, k, y, g, min(x) AS x0, max(x) AS x1, y * 1000000 + min(x) AS id FROM {name}_i GROUP BY frame_id, k, y, g),
{name}_e AS (SELECT a.frame_id, a.k, a.id AS a, b.id AS b FROM {name}_u a JOIN {name}_u b ON a.frame_id = b.frame_id AND a.k = b.k AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
{name}_r AS (SELECT frame_id, k, id AS p, id AS root FROM {name}_u UNION SELECT r.frame_id, r.k, e.b, r.root FROM {name}_r r JOIN {name}_e e ON r.frame_id = e.frame_id AND r.k = e.k AND r.p = e.a),
{name}_c AS (SELECT frame_id, k, p, min(root) AS comp FROM {name}_r GROUP BY frame_id, k, p),
{name} AS (SELECT i.frame_id, i.k, i.y, i.x, c.comp FROM {name}_i i JOIN {name}_u u ON i.frame_id = u.frame_id AND i.k = u.k AND i.y = u.y AND i.g = u.g JOIN {name}_c c ON c.frame_id = u.frame_id AND c.k = u.k AND c.p = u.id)"""


_MASK = GRID + """, thr AS (SELECT * FROM (VALUES (0, {a}e0), (1, {b}e0)) t(k, thr)),
pm AS (SELECT frame_id, k, y, x FROM gridded, thr WHERE gt <> 255 AND score >= thr), gm AS (SELECT frame_id, 0 AS k, y, x FROM gridded WHERE gt = 1)"""
_PRED = _MASK.format(a=0.0, b=0.05)
_OVERLAP_OF = f"""{{mask}}, {_label_sql('pm', 'pl')}, {_label_sql('gm', 'gl')},
pc AS (SELECT frame_id, k, comp AS pcomp, count(*) AS pn FROM pl GROUP BY ALL HAVING count(*) >= 10), gc AS (SELECT frame_id, comp AS gcomp, count(*) AS gn FROM gl GROUP BY ALL HAVING count(*) >= 10),
bo AS (SELECT pl.frame_id, pl.k, pl.comp AS pcomp, pn, gl.comp AS gcomp FROM pl JOIN pc ON pl.frame_id = pc.frame_id AND pl.k = pc.k AND pl.comp = pc.pcomp JOIN gl ON pl.frame_id = gl.frame_id AND pl.y = gl.y AND pl.x = gl.x),
it AS (SELECT bo.frame_id, bo.k, bo.gcomp, gn, pcomp, pn, count(*) AS i FROM bo JOIN gc ON bo.frame_id = gc.frame_id AND bo.gcomp = gc.gcomp GROUP BY ALL),
tu AS (SELECT frame_id, k, gcomp, CAST(sum(i) AS DOUBLE) / (max(gn) + sum(pn) - sum(i)) AS s FROM it GROUP BY frame_id, k, gcomp),
si AS (SELECT gc.frame_id, ks.k, gc.gcomp, gn, coalesce(s, 0) AS siou FROM gc CROSS JOIN (SELECT DISTINCT k FROM pl) ks LEFT JOIN tu ON tu.frame_id = gc.frame_id AND tu.k = ks.k AND tu.gcomp = gc.gcomp),
hi AS (SELECT frame_id, k, pcomp, count(*) AS h FROM bo GROUP BY ALL), pp AS (SELECT pc.*, CAST(coalesce(h, 0) AS DOUBLE) / pn AS ppv FROM pc LEFT JOIN hi USING (frame_id, k, pcomp)),
ta AS (SELECT 0.25e0 + 0.05e0 * unnest(generate_series(0, 10)) AS tau),
gt_c AS (SELECT k, tau, count(*) FILTER (siou > tau) AS tp, count(*) FILTER (siou <= tau) AS fn FROM si, ta GROUP BY k, tau), pr_c AS (SELECT k, tau, count(*) FILTER (ppv <= tau) AS fp FROM pp, ta GROUP BY k, tau),
f AS (SELECT k, round(avg(coalesce(tp, 0) / greatest(coalesce(tp, 0) + 0.5 * (coalesce(fn, 0) + coalesce(fp, 0)), 1e-9)), 6) AS f1 FROM gt_c FULL JOIN pr_c USING (k, tau) GROUP BY k)"""
_OVERLAP = _OVERLAP_OF.format(mask=_PRED)
_MEDSTD = GRID + """, thr AS (SELECT 0 AS k, median(score) + stddev_pop(score) AS thr FROM gridded),
pm AS (SELECT frame_id, k, y, x FROM gridded, thr WHERE gt <> 255 AND score >= thr), gm AS (SELECT frame_id, 0 AS k, y, x FROM gridded WHERE gt = 1)"""


def levelled(spark: SparkSession, sf_dir: str, thresholds: list[float] | DataFrame = (0.0, 0.05), grid: DataFrame | None = None) -> DataFrame:
    """The grid's pixels with how many thresholds they reach, and whether they are ground truth. Ignored pixels are no
    prediction, so they part components. A list's thresholds ascend."""
    g = fixtures.grid(spark, sf_dir) if grid is None else grid
    if not isinstance(thresholds, DataFrame):
        thresholds = spark.createDataFrame(list(enumerate(map(float, thresholds))), "k int, thr double")
    return with_truth(components.levels(g, thresholds))


def with_truth(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("level", F.when(F.col("gt") != 255, F.col("level")).otherwise(0)).withColumn("truth", F.col("gt").eqNullSafe(1))


_COMPONENTS = f"WITH RECURSIVE {_PRED}, {_label_sql('pm', 'pl')}, c AS (SELECT frame_id, k, comp, count(*) AS n FROM pl GROUP BY ALL) SELECT frame_id, k, count(*) FILTER (n >= 10) AS large, count(*) AS comps, max(n) AS largest, CAST(sum(n * n) AS BIGINT) AS square FROM c GROUP BY frame_id, k"


def _component_sizes(c: DataFrame) -> DataFrame:
    return c.groupBy(*BY).agg(F.count_if(F.col("n") >= 10).alias("large"), F.count("*").alias("comps"), F.max("n").alias("largest"), F.sum(F.col("n") * F.col("n")).alias("square"))


@query("components", _COMPONENTS)
def components_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _component_sizes(components.sizes(levelled(spark, sf_dir), ["frame_id"], side=SIDE))


@query("components_tiled", _COMPONENTS)
def components_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames are cut into tiles of 32 pixels, and components joined across their seams."""
    return _component_sizes(components.sizes(levelled(spark, sf_dir), ["frame_id"], 32, SIDE))


def overlaps(spark: SparkSession, sf_dir: str, *of: DataFrame) -> DataFrame:
    return components.objects(levelled(spark, sf_dir, *of), ["frame_id"], "frame_id", side=SIDE)


@query("component_siou", f"WITH RECURSIVE {_OVERLAP} SELECT frame_id, k, CAST(gcomp AS BIGINT) AS gcomp, gn, round(siou, 6) AS siou FROM si")
def component_siou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.of_truth(overlaps(spark, sf_dir), ["k"]).select(*BY, F.col("comp").alias("gcomp"), F.col("n").alias("gn"), F.round("share", 6).alias("siou"))


@query("component_ppv", f"WITH RECURSIVE {_OVERLAP} SELECT frame_id, k, CAST(pcomp AS BIGINT) AS pcomp, pn, round(ppv, 6) AS ppv FROM pp")
def component_ppv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(spark, sf_dir).filter("NOT truth AND comp IS NOT NULL").select(*BY, F.col("comp").alias("pcomp"), F.col("n").alias("pn"), F.round("share", 6).alias("ppv"))


@query("component_f1", f"WITH RECURSIVE {_OVERLAP} SELECT k, f1 FROM f")
def component_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.f1_of_objects(overlaps(spark, sf_dir), ["k"])


def quantile_thresholds(grid: DataFrame, at: list[float]) -> DataFrame:
    """k, thr: distinct quantiles of the out-of-distribution scores, ascending."""
    return ranking.quantiles(grid.filter("gt = 1"), [], "score", at).agg(F.array_sort(F.collect_set("q")).alias("q")).select(F.posexplode("q").alias("k", "thr"))


def _quantiles_of(where: str, at: str) -> str:
    return f"""{GRID}, part AS (SELECT * FROM gridded WHERE {where}), thr AS (SELECT CAST(row_number() OVER (ORDER BY q) - 1 AS INT) AS k, q AS thr FROM (SELECT DISTINCT unnest(quantile_cont(score, {at})) AS q FROM part WHERE gt = 1)),
pm AS (SELECT frame_id, k, y, x FROM part, thr WHERE gt <> 255 AND score >= thr), gm AS (SELECT frame_id, 0 AS k, y, x FROM part WHERE gt = 1)"""


BEST_AT, STAR_AT = [q / 100 for q in range(40, 97, 8)], [(5 + 65 * k / 8) / 100 for k in range(9)]
_BEST = _OVERLAP_OF.format(mask=_quantiles_of("frame_id % 2 = 0", str(BEST_AT)))
_STAR = _OVERLAP_OF.format(mask=_quantiles_of("frame_id % 2 = 1", str(STAR_AT)))


@query("component_bestthr", f"WITH RECURSIVE {_BEST} SELECT round(thr, 6) AS thr, f1 FROM f JOIN thr USING (k) ORDER BY f1 DESC, thr.thr LIMIT 1")
def component_bestthr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation frames' best of the candidate thresholds, and its F1."""
    g = fixtures.grid(spark, sf_dir).filter("frame_id % 2 = 0")
    thr = quantile_thresholds(g, BEST_AT)
    f = components.f1_of_objects(overlaps(spark, sf_dir, thr, g), ["k"])
    return f.join(thr, "k").orderBy(F.desc("f1"), "thr").limit(1).select(F.round("thr", 6).alias("thr"), "f1")


@query("f1_star", f"WITH RECURSIVE {_STAR} SELECT round(avg(f1), 6) AS f1_star, count(*) AS thresholds FROM f")
def f1_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean F1 over nine thresholds at quantiles of the test frames' out-of-distribution scores."""
    g = fixtures.grid(spark, sf_dir).filter("frame_id % 2 = 1")
    thr = quantile_thresholds(g, STAR_AT)
    f = components.f1_of_objects(overlaps(spark, sf_dir, thr, g), ["k"])
    return f.agg(F.round(F.avg("f1"), 6).alias("f1_star"), F.count("*").alias("thresholds"))


def _first(n: int, step: int) -> str:
    return f"base AS (SELECT frame_id, y // {step} AS y, x // {step} AS x, score, gt FROM gridded WHERE y % {step} = 0 AND x % {step} = 0 AND frame_id IN (SELECT DISTINCT frame_id FROM gridded ORDER BY frame_id LIMIT {n}))"


_EVAL = f"""{GRID}, {_first(30, 2)}, thr AS (SELECT 0 AS k, median(score) + stddev_pop(score) AS thr FROM base),
pm AS (SELECT frame_id, k, y, x FROM base, thr WHERE gt <> 255 AND score >= thr), gm AS (SELECT frame_id, 0 AS k, y, x FROM base WHERE gt = 1)"""


_METHODS = f"""{GRID}, part AS (SELECT frame_id, y, x, gt, m.m AS m, CASE m.m WHEN 0 THEN score WHEN 1 THEN -score ELSE abs(score) END AS score FROM gridded, (VALUES (0), (1), (2)) m(m) WHERE frame_id % 2 = 1),
thr AS (SELECT CAST(100 * m + row_number() OVER (PARTITION BY m ORDER BY q) - 1 AS INT) AS k, m, q AS thr FROM (SELECT DISTINCT m, unnest(quantile_cont(score, {STAR_AT})) AS q FROM part WHERE gt = 1 GROUP BY m)),
pm AS (SELECT frame_id, k, y, x FROM part JOIN thr USING (m) WHERE gt <> 255 AND score >= thr), gm AS (SELECT frame_id, 0 AS k, y, x FROM part WHERE gt = 1 AND m = 0)"""


@query("f1_star_methods", f"WITH RECURSIVE {_OVERLAP_OF.format(mask=_METHODS)} SELECT CASE k // 100 WHEN 0 THEN 'plain' WHEN 1 THEN 'reversed' ELSE 'size' END AS method, round(avg(f1), 6) AS f1_star, count(*) AS thresholds FROM f GROUP BY k // 100")
def f1_star_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f1_star of several methods at the grid's own resolution, each with its own thresholds; methods are rows."""
    each = [F.struct(F.lit(n).alias("method"), s.alias("score")) for n, s in (("plain", F.col("score")), ("reversed", -F.col("score")), ("size", F.abs("score")))]
    g = fixtures.grid(spark, sf_dir).filter("frame_id % 2 = 1").select("frame_id", "y", "x", "gt", F.explode(F.array(*each)).alias("m")).select("frame_id", "y", "x", "gt", "m.*")
    return star_by_method(g, g)


# three sources at their own resolutions: the grid, a score of half its rows and columns, and their sum after z-normalising both
_NATIVE = f"""{GRID}, {axis_sql(10, 20, 'ay')}, {axis_sql(32, 64, 'ax')}, half AS (SELECT frame_id, y // 2 AS y, x // 2 AS x, round(avg(score * score), 6) AS score FROM gridded GROUP BY ALL),
up AS (SELECT frame_id, ay.t AS y, ax.t AS x, round(sum(score * ay.w * ax.w), 6) AS score FROM half JOIN ay ON y = ay.s JOIN ax ON x = ax.s GROUP BY ALL),
two AS (SELECT g.frame_id, g.y, g.x, g.gt, round(g.score, 6) AS a, up.score AS b FROM gridded g JOIN up ON g.frame_id = up.frame_id AND g.y = up.y AND g.x = up.x),
z AS (SELECT round(avg(a), 6) AS ma, round(stddev_pop(a), 6) + 1e-6 AS sa, round(avg(b), 6) AS mb, round(stddev_pop(b), 6) + 1e-6 AS sb FROM two WHERE gt = 0 AND frame_id % 2 = 0 AND y % 4 = 0 AND x % 4 = 0),
part AS (SELECT frame_id, y, x, gt, m.m AS m, CASE m.m WHEN 0 THEN a WHEN 1 THEN b ELSE round((a - ma) / sa + (b - mb) / sb, 6) END AS score FROM two, z, (VALUES (0), (1), (2)) m(m) WHERE frame_id % 2 = 1),
thr AS (SELECT CAST(100 * m + row_number() OVER (PARTITION BY m ORDER BY q) - 1 AS INT) AS k, m, q AS thr FROM (SELECT DISTINCT m, unnest(quantile_cont(score, {STAR_AT})) AS q FROM part WHERE gt = 1 AND y % 4 = 0 AND x % 4 = 0 GROUP BY m)),
pm AS (SELECT frame_id, k, y, x FROM part JOIN thr USING (m) WHERE gt <> 255 AND score >= thr), gm AS (SELECT frame_id, 0 AS k, y, x FROM part WHERE gt = 1 AND m = 0)"""


@query("f1_star_native", f"WITH RECURSIVE {_OVERLAP_OF.format(mask=_NATIVE)} SELECT CASE k // 100 WHEN 0 THEN 'grid' WHEN 1 THEN 'half' ELSE 'fused' END AS method, round(avg(f1), 6) AS f1_star, count(*) AS thresholds FROM f GROUP BY k // 100")
def f1_star_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f1_star of several score sources, each stretched from its own resolution to that of the frames: the grid's score, one of
    half the rows and columns, and both added up after z-normalising by the validation frames' in-distribution pixels.
    Statistics and thresholds come from every fourth row and column, components from all pixels."""
    g = fixtures.grid(spark, sf_dir)
    half = g.groupBy("frame_id", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(F.round(F.avg(F.col("score") * F.col("score")), 6).alias("score"))
    up = rasters.bilinear(half, ["frame_id"], (10, 32), (20, SIDE)).select("frame_id", F.col("yy").alias("y"), F.col("xx").alias("x"), F.round("score", 6).alias("b"))
    two = g.select("frame_id", "y", "x", "gt", F.round("score", 6).alias("a")).join(up, ["frame_id", "y", "x"])
    coarse = (F.col("y") % 4 == 0) & (F.col("x") % 4 == 0)
    z = calibrate.zstats(two.filter("gt = 0 AND frame_id % 2 = 0").filter(coarse), ["a", "b"])
    standard = lambda c: (F.col(c) - F.round(f"m_{c}", 6)) / (F.round(f"s_{c}", 6) + 1e-6)
    each = [F.struct(F.lit(n).alias("method"), s.alias("score")) for n, s in (("grid", F.col("a")), ("half", F.col("b")), ("fused", F.round(standard("a") + standard("b"), 6)))]
    part = two.filter("frame_id % 2 = 1").crossJoin(F.broadcast(z)).select("frame_id", "y", "x", "gt", F.explode(F.array(*each)).alias("m")).select("frame_id", "y", "x", "gt", "m.*")
    return star_by_method(part, part.filter(coarse))


def star_by_method(part: DataFrame, sample: DataFrame) -> DataFrame:
    """method, f1_star, thresholds of rows (method, frame_id, y, x, gt, score): the mean F1 over thresholds at quantiles of each
    method's out-of-distribution scores in the sample. The ground truth is the same for all methods."""
    thr = ranking.quantiles(sample.filter("gt = 1"), ["method"], "score", STAR_AT).groupBy("method").agg(F.array_sort(F.collect_set("q")).alias("q")).select("method", F.posexplode("q").alias("k", "thr"))
    pixels = with_truth(components.levels(part, thr, ["method"]))
    f = components.f1_of_objects(components.objects(pixels, ["method", "frame_id"], "frame_id", side=SIDE), ["method", "k"])
    return f.groupBy("method").agg(F.round(F.avg("f1"), 6).alias("f1_star"), F.count("*").alias("thresholds"))


@query("evaluate", f"""WITH RECURSIVE {_OVERLAP_OF.format(mask=_EVAL)}, {points_sql('base', '')}, m AS ({metrics_sql('')})
SELECT (SELECT count(DISTINCT frame_id) FROM base) AS n_frames, ap, auroc, fpr95, n_pos, round(thr, 6) AS thr, coalesce((SELECT f1 FROM f), 0e0) AS component_f1 FROM m, thr""")
def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty frames at half the resolution, end to end."""
    return evaluate(fixtures.grid(spark, sf_dir), limit=30, downsample=2, do_component=True, side=SIDE)


@query("component_medstd", f"WITH RECURSIVE {_OVERLAP_OF.format(mask=_MEDSTD)} SELECT round(thr, 6) AS thr, f1 FROM f, thr")
def component_medstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 at the median plus a standard deviation of all scores."""
    g = fixtures.grid(spark, sf_dir)
    thr = median_and_deviation(g)
    f = components.f1_of_objects(overlaps(spark, sf_dir, thr, g), ["k"])
    return f.crossJoin(thr.drop("k")).select(F.round("thr", 6).alias("thr"), "f1")
