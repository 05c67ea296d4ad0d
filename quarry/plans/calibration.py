"""Calibration and operating points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import calibrate, ranking
from quarry.plans.base import METHODS, PIXELS, conformal_sql, op_sql, order_sql, query
from quarry.plans.pixel_metrics import standardised
from quarry.sources import fixtures

CAP, LEAST_ROWS = calibrate.CAP, 2000
_VAL = f"{METHODS}, val AS (SELECT * FROM methods WHERE split = 'val' AND gt = 0), test AS (SELECT * FROM methods WHERE split = 'test' AND gt <> 255)"


def val_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.methods(fixtures.pixels(spark, sf_dir).filter("split = 'val' AND gt = 0"))


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.methods(fixtures.pixels(spark, sf_dir).filter("split = 'test' AND gt <> 255"))


@query("conformal_global", f"WITH {_VAL}, {conformal_sql('val', 'method', 'q')} SELECT method, n, round(tau, 6) AS tau FROM q")
def conformal_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.conformal(val_id(spark, sf_dir), ["method"]).select("method", "n", F.round("tau", 6).alias("tau"))


@query("conformal_class", f"WITH {_VAL}, {conformal_sql('val', 'method, predclass', 'q')} SELECT method, predclass, n, round(tau, 6) AS tau FROM q")
def conformal_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.conformal(val_id(spark, sf_dir), ["method", "predclass"]).select("method", "predclass", "n", F.round("tau", 6).alias("tau"))


_TIES = "score_a, l_orderkey, l_linenumber, l_partkey"


def _sample_sql(cls: str, src: str = "pixels", cap: int = CAP, seed: int = 0) -> str:
    return f"calib AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, {cls} ORDER BY {order_sql(seed)}, {_TIES}) AS nth FROM {src} WHERE split = 'val' AND gt = 0) WHERE nth <= {cap})"


def calibration_sample(px: DataFrame, cls: str, cap: int = CAP, seed: int = 0) -> DataFrame:
    order = [fixtures.order_hash(seed), *(F.col(c) for c in _TIES.split(", "))]
    return calibrate.capped_sample(px.filter("split = 'val' AND gt = 0"), "frame_id", cls, order, cap)


@query("calib_sample", f"WITH {PIXELS}, {_sample_sql('predclass')} SELECT predclass, count(*) AS n, round(sum(score_a), 2) AS sum_a, max(nth) AS most FROM calib GROUP BY predclass")
def calib_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = calibration_sample(fixtures.pixels(spark, sf_dir), "predclass")
    per = s.groupBy("predclass", "frame_id").count().groupBy("predclass").agg(F.max("count").alias("most"))
    return s.groupBy("predclass").agg(F.count("*").alias("n"), F.round(F.sum("score_a"), 2).alias("sum_a")).join(per, "predclass")


def _tcc_sql(cls: str, src: str = "pixels", score: str = "score_a", cap: int = CAP, quantile: str | None = None) -> str:
    own = conformal_sql("calib", cls, "own", score) if quantile is None else f"own AS (SELECT {cls}, count(*) AS n, quantile_cont({score}, {quantile}) AS tau FROM calib GROUP BY {cls})"
    return f"""{_sample_sql(cls, src, cap)}, vid AS (SELECT * FROM {src} WHERE split = 'val' AND gt = 0), {own}, {conformal_sql('vid', '', 'every', score)},
thr AS (SELECT own.{cls}, own.n, CASE WHEN own.n < 100 THEN every.tau ELSE own.tau END AS tau, own.n < 100 AS is_fallback FROM own, every),
flagged AS (SELECT t.*, t.{score} > coalesce(thr.tau, every.tau) AS flag FROM {src} t LEFT JOIN thr USING ({cls}), every WHERE split = 'test' AND gt <> 255)"""


def tcc(px: DataFrame, cls: str, score: str = "score_a", cap: int = CAP, percentile: bool = False, alpha: float = calibrate.ALPHA) -> tuple[DataFrame, DataFrame]:
    """Terrain-conditional calibration: thresholds by predicted class from a capped validation sample, and the test
    rows flagged by them."""
    sample = calibration_sample(px, cls, cap)
    whole = px.filter("split = 'val' AND gt = 0")
    thresholds = calibrate.class_thresholds(sample, whole, cls, score, alpha, percentile=percentile)
    every = calibrate.conformal(whole, [], score, alpha)
    return thresholds, calibrate.flag(px.filter("split = 'test' AND gt <> 255"), thresholds, every, cls, score)


@query("tcc_thresholds", f"WITH {PIXELS}, {_tcc_sql('predclass_fine')} SELECT predclass_fine, n, round(tau, 6) AS tau, is_fallback FROM thr")
def tcc_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tcc(fixtures.pixels(spark, sf_dir), "predclass_fine")[0].select("predclass_fine", "n", F.round("tau", 6).alias("tau"), "is_fallback")


@query("tcc_flags", f"WITH {PIXELS}, {_tcc_sql('predclass')} SELECT frame_id, predclass, gt, count(*) AS n, count(*) FILTER (flag) AS flagged FROM flagged GROUP BY ALL")
def tcc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tcc(fixtures.pixels(spark, sf_dir), "predclass")[1].groupBy("frame_id", "predclass", "gt").agg(F.count("*").alias("n"), F.count_if("flag").alias("flagged"))


@query("op_tcc", f"WITH {PIXELS}, {_tcc_sql('predclass')} {op_sql('flagged')}")
def op_tcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.operating_point(tcc(fixtures.pixels(spark, sf_dir), "predclass")[1], [])


@query("op_tcc_fine", f"WITH {PIXELS}, {_tcc_sql('predclass_fine')} {op_sql('flagged')}")
def op_tcc_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.operating_point(tcc(fixtures.pixels(spark, sf_dir), "predclass_fine")[1], [])


@query("op_tcc_percentile", f"WITH {PIXELS}, {_tcc_sql('predclass', quantile='0.95')} {op_sql('flagged')}")
def op_tcc_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.operating_point(tcc(fixtures.pixels(spark, sf_dir), "predclass", percentile=True)[1], [])


_ZF = f"""{PIXELS}, st AS (SELECT avg(score_a) AS ma, stddev_pop(score_a) AS sa, avg(score_b) AS mb, stddev_pop(score_b) AS sb FROM pixels WHERE split = 'val' AND gt = 0),
fz AS (SELECT pixels.*, round((score_a - ma) / (sa + 1e-6) + (score_b - mb) / (sb + 1e-6), 9) AS fused FROM pixels, st)"""


@query("op_tcc_fused", f"WITH {_ZF}, {_tcc_sql('predclass', 'fz', 'fused')} {op_sql('flagged')}")
def op_tcc_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = standardised(spark, sf_dir).withColumn("fused", F.round(F.col("za") + F.col("zb"), 9))
    return calibrate.operating_point(tcc(px, "predclass", "fused")[1], [])


@query("op_global", f"WITH {_VAL}, {conformal_sql('val', 'method', 'q')}, flagged AS (SELECT test.method, gt, score > tau AS flag FROM test JOIN q USING (method)) {op_sql('flagged', 'method')}")
def op_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = calibrate.conformal(val_id(spark, sf_dir), ["method"])
    flagged = test_rows(spark, sf_dir).join(F.broadcast(q), "method").withColumn("flag", F.col("score") > F.col("tau"))
    return calibrate.operating_point(flagged, ["method"])


@query("op_naive_tpr95", f"WITH {METHODS}, q AS (SELECT method, quantile_cont(score, 0.05) AS tau FROM methods WHERE split = 'val' AND gt = 1 GROUP BY method), flagged AS (SELECT m.method, gt, score > tau AS flag FROM methods m JOIN q USING (method) WHERE split = 'test' AND gt <> 255) {op_sql('flagged', 'method')}")
def op_naive_tpr95(spark: SparkSession, sf_dir: str) -> DataFrame:
    val = fixtures.methods(fixtures.pixels(spark, sf_dir).filter("split = 'val' AND gt = 1"))
    q = ranking.quantiles(val, ["method"], "score", [0.05]).select("method", F.col("q").alias("tau"))
    return calibrate.operating_point(test_rows(spark, sf_dir).join(F.broadcast(q), "method").withColumn("flag", F.col("score") > F.col("tau")), ["method"])


@query("op_headroom", f"""WITH {_VAL}, g AS (SELECT method, quantile_cont(score, 0.95) AS tau_g FROM val GROUP BY method),
c AS (SELECT method, predclass, CASE WHEN count(*) >= 100 THEN quantile_cont(score, 0.95) END AS tau_c FROM val GROUP BY method, predclass),
r AS (SELECT t.method, gt, score, tau_g, coalesce(tau_c, tau_g) AS tau_c FROM test t JOIN g USING (method) LEFT JOIN c USING (method, predclass)),
flagged AS (SELECT method, 'global' AS rule, gt, score > tau_g AS flag FROM r UNION ALL SELECT method, 'terrain', gt, score > tau_c FROM r) {op_sql('flagged', 'method, rule')}""")
def op_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    val = val_id(spark, sf_dir)
    g = ranking.quantiles(val, ["method"], "score", [0.95]).select("method", F.col("q").alias("tau_g"))
    enough = val.groupBy("method", "predclass").count().filter("count >= 100").drop("count")
    c = ranking.quantiles(val, ["method", "predclass"], "score", [0.95]).join(enough, ["method", "predclass"]).select("method", "predclass", F.col("q").alias("tau_c"))
    rows = test_rows(spark, sf_dir).join(F.broadcast(g), "method").join(F.broadcast(c), ["method", "predclass"], "left").withColumn("tau_c", F.coalesce("tau_c", "tau_g"))
    rule = F.explode(F.array(F.struct(F.lit("global").alias("rule"), F.col("tau_g").alias("tau")), F.struct(F.lit("terrain").alias("rule"), F.col("tau_c").alias("tau"))))
    rows = rows.withColumn("r", rule).select("method", "gt", "score", "r.*").withColumn("flag", F.col("score") > F.col("tau"))
    return calibrate.operating_point(rows, ["method", "rule"])


# three coarse terrains, so that each has the rows that the published gate asks for
_COARSE = "coarse AS (SELECT *, predclass_fine % 3 AS terrain FROM pixels)"


@query("terrain_uniformity", f"""WITH {PIXELS}, {_COARSE}, {_tcc_sql('terrain', 'coarse')}, fg AS (SELECT 'tcc' AS rule, terrain, gt, flag FROM flagged UNION ALL SELECT 'global', terrain, gt, score_a > tau FROM coarse, every WHERE split = 'test' AND gt <> 255),
r AS (SELECT rule, terrain, avg(CASE WHEN flag THEN 1e0 ELSE 0e0 END) AS r FROM fg WHERE gt = 0 GROUP BY rule, terrain HAVING count(*) >= {LEAST_ROWS})
SELECT rule, round(max(r), 6) AS worst, round(avg(CASE WHEN r > 0.1 THEN 1e0 ELSE 0e0 END), 6) AS frac_over, round(avg(abs(r - 0.05)), 6) AS mad, count(*) AS n_classes FROM r GROUP BY rule""")
def terrain_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fixtures.pixels(spark, sf_dir).withColumn("terrain", F.col("predclass_fine") % 3)
    own = tcc(px, "terrain")[1].select(F.lit("tcc").alias("rule"), "terrain", "gt", "flag")
    tau = calibrate.conformal(px.filter("split = 'val' AND gt = 0"), [], "score_a")
    every = px.filter("split = 'test' AND gt <> 255").crossJoin(F.broadcast(tau)).select(F.lit("global").alias("rule"), "terrain", "gt", (F.col("score_a") > F.col("tau")).alias("flag"))
    return calibrate.uniformity(own.unionByName(every), ["rule"], "terrain", least=LEAST_ROWS)


_EV = "ev AS (SELECT user_id AS frame_id, CAST(floor(hour(ts) / 4.0) AS INT) AS predclass, value AS score, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS gt FROM events)"


@query("events_conformal", f"WITH {_EV}, eid AS (SELECT * FROM ev WHERE gt = 0 AND frame_id % 2 = 0), {conformal_sql('eid', 'predclass', 'q')}, flagged AS (SELECT ev.predclass, gt, score > tau AS flag FROM ev JOIN q USING (predclass) WHERE frame_id % 2 = 1) {op_sql('flagged', 'predclass')}")
def events_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = fixtures.events(spark, sf_dir)
    q = calibrate.conformal(ev.filter("gt = 0 AND frame_id % 2 = 0"), ["predclass"])
    return calibrate.operating_point(ev.filter("frame_id % 2 = 1").join(F.broadcast(q), "predclass").withColumn("flag", F.col("score") > F.col("tau")), ["predclass"])
