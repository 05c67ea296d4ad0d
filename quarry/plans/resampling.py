"""Histograms and the frame bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import bootstrap, ranking
from quarry.plans.base import METHODS, metrics_sql, order_sql, points_sql, query
from quarry.plans.pixel_metrics import test_methods
from quarry.sources import fixtures

BINS, DRAWS = bootstrap.BINS, bootstrap.DRAWS
SAMPLE_ORDER = 0  # the 1-in-10 sample is by pseudo-random order instead of by position

_EDGES = f"""{METHODS}, t AS (SELECT * FROM methods WHERE split = 'test' AND gt <> 255),
q AS (SELECT method, unnest(quantile_cont(score, list_transform(generate_series(0, {BINS}), lambda k: k / {BINS}.0))) AS e FROM t WHERE ({order_sql(SAMPLE_ORDER)}) % 10 = 0 GROUP BY method),
u AS (SELECT DISTINCT method, e FROM q), k AS (SELECT method, e, row_number() OVER (PARTITION BY method ORDER BY e) - 1 AS bin, count(*) OVER (PARTITION BY method) AS m FROM u),
edges AS (SELECT method, bin, m, CASE WHEN bin = 0 THEN e - 1e-6 WHEN bin = m - 1 THEN e + 1e-6 ELSE e END AS e FROM k)"""
_HIST = f"""{_EDGES}, bins AS (SELECT a.method, a.bin, a.e AS lo, b.e AS hi, b.bin = b.m - 1 AS last FROM edges a JOIN edges b ON a.method = b.method AND b.bin = a.bin + 1),
hist AS (SELECT t.method, frame_id, CAST(bin AS INTEGER) AS bin, count(*) FILTER (gt = 0) AS n_id, count(*) FILTER (gt = 1) AS n_ood FROM t JOIN bins ON t.method = bins.method AND score >= lo AND (score < hi OR (last AND score <= hi)) GROUP BY ALL)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_methods(spark, sf_dir).filter("gt <> 255")


def cuts(rows: DataFrame, bins: int = BINS) -> DataFrame:
    return bootstrap.edges(rows.filter(fixtures.order_hash(SAMPLE_ORDER) % 10 == 0), ["method"], "score", bins)


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return bootstrap.histogram(rows, ["method", "frame_id"], cuts(rows), ["method"])


@query("hist_edges", f"WITH {_EDGES} SELECT method, CAST(bin AS INTEGER) AS bin, round(e, 5) AS edge FROM edges")
def hist_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts(scored(spark, sf_dir)).select("method", F.posexplode("edges").alias("bin", "e")).select("method", "bin", F.round("e", 5).alias("edge"))


@query("score_hist", f"WITH {_HIST} SELECT * FROM hist")
def score_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms(spark, sf_dir)


def _hist_metrics_sql(src: str, by: str, name: str, digits: int | None) -> str:
    r = (lambda x: f"round({x}, {digits})") if digits is not None else (lambda x: x)
    return f"""{name}_s AS (SELECT {by}, bin, CAST(sum(n_id) AS DOUBLE) AS n, CAST(sum(n_ood) AS DOUBLE) AS p FROM {src} GROUP BY {by}, bin),
{name}_c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY {by}) AS pos, sum(n) OVER (PARTITION BY {by}) AS neg FROM {name}_s WINDOW w AS (PARTITION BY {by} ORDER BY bin DESC)),
{name}_l AS (SELECT *, tp / pos AS tpr, fp / neg AS fpr, lag(tp / pos) OVER (PARTITION BY {by} ORDER BY bin DESC) AS tpr0, lag(fp / neg) OVER (PARTITION BY {by} ORDER BY bin DESC) AS fpr0 FROM {name}_c),
{name} AS (SELECT {by}, {r('sum(p / pos * tp / greatest(tp + fp, 1.0))')} AS ap, {r('sum((fpr - fpr0) * (tpr + tpr0) / 2)')} AS auroc, {r('min(CASE WHEN tpr >= 0.95 THEN fpr END)')} AS fpr95 FROM {name}_l GROUP BY {by})"""


@query("hist_metrics", f"WITH {_HIST}, {_hist_metrics_sql('hist', 'method', 'm', 6)} SELECT * FROM m")
def hist_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.hist_metrics(histograms(spark, sf_dir), ["method"])


#: How far the histogram's figures may be from the exact ones.
TOLERANCE = {"ap": 0.01, "auroc": 0.01, "fpr95": 0.02}


@query("hist_check", f"""WITH {_HIST}, {_hist_metrics_sql('hist', 'method', 'h', None)}, {points_sql('t', 'method')}, e AS ({metrics_sql('method', digits=None)})
SELECT method, abs(e.ap - h.ap) < {TOLERANCE['ap']} AND abs(e.auroc - h.auroc) < {TOLERANCE['auroc']} AND abs(e.fpr95 - h.fpr95) < {TOLERANCE['fpr95']} AS agrees FROM e JOIN h USING (method)""")
def hist_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the point estimates of the histograms agree with the exact metrics."""
    exact = ranking.metrics(scored(spark, sf_dir), ["method"], digits=None)
    near = bootstrap.hist_metrics(histograms(spark, sf_dir), ["method"], None).select("method", *(F.col(c).alias(f"h_{c}") for c in TOLERANCE))
    close = [F.abs(F.col(c) - F.col(f"h_{c}")) < t for c, t in TOLERANCE.items()]
    return exact.join(near, "method").select("method", (close[0] & close[1] & close[2]).alias("agrees"))


_P, _TAKES = bootstrap.PRIME, " + ".join(f"CAST(x >= {t} AS INTEGER)" for t in bootstrap.POISSON)
_WEIGHTS = f"""wf AS (SELECT DISTINCT frame_id, frame_id % {_P} AS f FROM t),
wx AS (SELECT boot, frame_id, f, (boot * 1000003 + f * 7919 + 17) % {_P} * 48271 % {_P} AS x FROM wf, (SELECT unnest(generate_series(0, {DRAWS - 1})) AS boot)),
wy AS (SELECT boot, frame_id, (x * x + boot * 69621 + f) % {_P} AS x FROM wx),
wz AS (SELECT boot, frame_id, x * x % {_P} AS x FROM wy),
weights AS MATERIALIZED (SELECT boot, frame_id, {_TAKES} AS w FROM wz WHERE x >= {bootstrap.POISSON[0]})"""
_DRAWS = f"""{_HIST}, {_WEIGHTS}, sums AS (SELECT method, boot, bin, sum(n_id * w) AS n_id, sum(n_ood * w) AS n_ood FROM hist JOIN weights USING (frame_id) GROUP BY ALL),
drawn AS (SELECT b.method, x.boot, b.bin, coalesce(n_id, 0) AS n_id, coalesce(n_ood, 0) AS n_ood FROM bins b CROSS JOIN (SELECT unnest(generate_series(0, {DRAWS - 1})) AS boot) x LEFT JOIN sums ON sums.method = b.method AND sums.boot = x.boot AND sums.bin = b.bin),
{_hist_metrics_sql('drawn', 'method, boot', 'd', None)}"""


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.draws_metrics(histograms(spark, sf_dir), "method")


def _interval(value: str, src: str = "d") -> str:
    return f"round(avg({value}), 6) AS mean, round(quantile_cont({value}, 0.025), 6) AS lo, round(quantile_cont({value}, 0.975), 6) AS hi"


@query("bootstrap_ci", f"WITH {_DRAWS} SELECT method, {_interval('ap')} FROM d GROUP BY method")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.interval(drawn(spark, sf_dir), ["method"], "ap")


@query("ci_halfwidth", f"WITH {_DRAWS} SELECT method, round((quantile_cont(ap, 0.975) - quantile_cont(ap, 0.025)) / 2, 6) AS ap_half, round((quantile_cont(fpr95, 0.975) - quantile_cont(fpr95, 0.025)) / 2, 6) AS fpr95_half FROM d GROUP BY method")
def ci_halfwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda c: F.round((F.percentile(c, F.lit(0.975)) - F.percentile(c, F.lit(0.025))) / 2, 6).alias(f"{c}_half")
    return drawn(spark, sf_dir).groupBy("method").agg(half("ap"), half("fpr95"))


@query("paired_delta_ci", f"WITH {_DRAWS}, x AS (SELECT a.ap - b.ap AS delta FROM d a JOIN d b USING (boot) WHERE a.method = 'score_a' AND b.method = 'score_b') SELECT {_interval('delta')}, quantile_cont(delta, 0.025) > 0 OR quantile_cont(delta, 0.975) < 0 AS significant FROM x")
def paired_delta_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = drawn(spark, sf_dir).groupBy("boot").pivot("method", ["score_a", "score_b"]).agg(F.first("ap")).select((F.col("score_a") - F.col("score_b")).alias("delta"))
    lo, hi = F.percentile("delta", F.lit(0.025)), F.percentile("delta", F.lit(0.975))
    return d.agg(F.round(F.avg("delta"), 6).alias("mean"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), ((lo > 0) | (hi < 0)).alias("significant"))


_EXACT = f"""{METHODS}, t AS (SELECT * FROM methods WHERE split = 'test' AND gt <> 255), {_WEIGHTS},
own AS (SELECT method, frame_id, score, gt, count(*) AS c FROM t GROUP BY ALL),
drawn AS (SELECT method, boot, score, gt, c * w AS cw FROM own JOIN weights USING (frame_id)), {points_sql('drawn', 'method, boot', weight='cw')}, m AS ({metrics_sql('method, boot', digits=None)})"""


@query("bootstrap_ap_exact", f"WITH {_EXACT} SELECT method, {_interval('ap')} FROM m GROUP BY method")
def bootstrap_ap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct scores, all draws in one pass over them."""
    return bootstrap.interval(bootstrap.exact_draws(scored(spark, sf_dir), "method", metrics=("ap",)), ["method"], "ap")
