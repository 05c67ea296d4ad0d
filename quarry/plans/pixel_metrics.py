"""Pixel metrics, error decompositions and score fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.scores import znorm as z
from quarry.operators import calibrate, ranking
from quarry.plans.base import GRID, METHODS, PIXELS, metrics_sql, points_sql, query
from quarry.sources import fixtures

_TEST = f"{METHODS}, test AS (SELECT * FROM methods WHERE split = 'test')"
_TEST_PTS = f"WITH {_TEST}, {points_sql('test', 'method')}, m AS ({metrics_sql('method')}) "


def test_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.methods(fixtures.pixels(spark, sf_dir).filter("split = 'test'"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.metrics(test_methods(spark, sf_dir), ["method"])


@query("pixel_metrics", _TEST_PTS + "SELECT * FROM m")
def pixel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir)


@query("pixel_ap", _TEST_PTS + "SELECT method, ap FROM m")
def pixel_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("method", "ap")


@query("pixel_auroc", _TEST_PTS + "SELECT method, auroc FROM m")
def pixel_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("method", "auroc")


@query("pixel_fpr95", _TEST_PTS + "SELECT method, fpr95 FROM m")
def pixel_fpr95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("method", "fpr95")


_DOCS = "docs AS (SELECT d.doc_id, lang AS predclass, CAST(n_chars AS DOUBLE) AS score, coalesce(toxic, 255) AS gt FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query("docs_metrics", f"WITH {_DOCS}, {points_sql('docs', 'predclass')} {metrics_sql('predclass')}")
def docs_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.metrics(fixtures.docs(spark, sf_dir), ["predclass"])


_TIERS = f"""{_TEST}, tiers AS (SELECT method, score, gt, t.t AS tier_of FROM test JOIN (VALUES ('T1'), ('T2'), ('T3')) t(t) ON gt = 0 OR (gt = 1 AND tier = t.t))"""


@query("tier_ap", f"WITH {_TIERS}, {points_sql('tiers', 'method, tier_of')}, m AS ({metrics_sql('method, tier_of')}) SELECT method, tier_of, CASE WHEN n_pos >= 100 THEN ap END AS ap, n_pos FROM m")
def tier_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.by_tier(test_methods(spark, sf_dir)).withColumnRenamed("of", "tier_of")
    return ranking.metrics(rows, ["method", "tier_of"]).select("method", "tier_of", F.when(F.col("n_pos") >= 100, F.col("ap")).alias("ap"), "n_pos")


_TAU = f"{_TEST}, tau AS (SELECT method, quantile_cont(score, 0.05) AS tau FROM test WHERE gt = 1 GROUP BY method), flagged AS (SELECT test.*, tau, score > tau AS flag FROM test JOIN tau USING (method) WHERE gt <> 255)"


def flagged_tpr95(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = test_methods(spark, sf_dir).filter("gt <> 255")
    tau = ranking.tau_tpr95(rows, ["method"])
    return rows.join(F.broadcast(tau), "method").withColumn("flag", F.col("score") > F.col("tau"))


@query("tau_tpr95", f"WITH {_TAU} SELECT method, round(tau, 6) AS tau FROM tau")
def tau_tpr95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.tau_tpr95(test_methods(spark, sf_dir), ["method"]).select("method", F.round("tau", 6).alias("tau"))


def _share(hit: Column, of: Column) -> Column:
    return F.round(hit / F.greatest(of, F.lit(1)).cast("double"), 6)


@query("tier_recall", f"""WITH {_TAU}, r AS (SELECT method, tier, CAST(count(*) FILTER (flag) AS DOUBLE) / count(*) AS recall, count(*) AS n FROM flagged WHERE gt = 1 GROUP BY method, tier)
SELECT method, round(max(recall) FILTER (tier = 'T1'), 6) AS recall_t1, round(max(recall) FILTER (tier = 'T2'), 6) AS recall_t2, round(max(recall) FILTER (tier = 'T2') / greatest(max(recall) FILTER (tier = 'T1'), 1e-9), 6) AS ratio FROM r GROUP BY method""")
def tier_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda t: F.avg(F.when(F.col("tier") == t, F.col("flag").cast("double")))
    return flagged_tpr95(spark, sf_dir).filter("gt = 1").groupBy("method").agg(F.round(at("T1"), 6).alias("recall_t1"), F.round(at("T2"), 6).alias("recall_t2"), F.round(at("T2") / F.greatest(at("T1"), F.lit(1e-9)), 6).alias("ratio"))


@query("fp_by_class", f"""WITH {_TAU}, c AS (SELECT method, name, count(*) FILTER (flag) AS fp, count(*) AS n FROM flagged WHERE gt = 0 GROUP BY method, name)
SELECT method, name, fp, n, round(CAST(fp AS DOUBLE) / n, 6) AS fpr, row_number() OVER (PARTITION BY method ORDER BY fp DESC, name) AS rank FROM c QUALIFY rank <= 3""")
def fp_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = flagged_tpr95(spark, sf_dir).filter("gt = 0").groupBy("method", "name").agg(F.count_if("flag").alias("fp"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("method").orderBy(F.desc("fp"), "name"))
    return c.select("method", "name", "fp", "n", F.round(F.col("fp") / F.col("n"), 6).alias("fpr"), rank.cast("long").alias("rank")).filter("rank <= 3")


@query("fp_veg_share", f"""WITH {_TAU} SELECT method, count(*) FILTER (flag) AS fp, round(CAST(count(*) FILTER (flag) AS DOUBLE) / count(*), 6) AS fpr,
round(CAST(count(*) FILTER (flag AND eff_role = 'id_vegetation') AS DOUBLE) / greatest(count(*) FILTER (flag), 1), 6) AS veg_share FROM flagged WHERE gt = 0 GROUP BY method""")
def fp_veg_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    veg = F.col("eff_role") == "id_vegetation"
    return flagged_tpr95(spark, sf_dir).filter("gt = 0").groupBy("method").agg(F.count_if("flag").alias("fp"), _share(F.count_if("flag"), F.count("*")).alias("fpr"), _share(F.count_if(F.col("flag") & veg), F.count_if("flag")).alias("veg_share"))


@query("veg_fprate", f"""WITH {_TAU}, r AS (SELECT method, avg(CASE WHEN flag THEN 1e0 ELSE 0e0 END) FILTER (eff_role = 'id_vegetation') AS veg, avg(CASE WHEN flag THEN 1e0 ELSE 0e0 END) FILTER (eff_role <> 'id_vegetation') AS rest FROM flagged WHERE gt = 0 GROUP BY method)
SELECT method, round(veg, 6) AS veg, round(rest, 6) AS rest, round(veg / greatest(rest, 1e-6), 6) AS ratio FROM r UNION ALL SELECT 'macro', round(avg(veg), 6), round(avg(rest), 6), round(avg(veg / greatest(rest, 1e-6)), 6) FROM r""")
def veg_fprate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("flag").cast("double")
    r = flagged_tpr95(spark, sf_dir).filter("gt = 0").groupBy("method").agg(F.avg(F.when(F.col("eff_role") == "id_vegetation", hit)).alias("veg"), F.avg(F.when(F.col("eff_role") != "id_vegetation", hit)).alias("rest"))
    r = r.withColumn("ratio", F.col("veg") / F.greatest("rest", F.lit(1e-6)))
    macro = r.agg(F.lit("macro").alias("method"), *(F.avg(c).alias(c) for c in ("veg", "rest", "ratio")))
    return r.unionByName(macro).select("method", *(F.round(c, 6).alias(c) for c in ("veg", "rest", "ratio")))


# predictions: the terrain's number, made from the part's size
_PRED = f"{PIXELS}, pred AS (SELECT *, predclass_fine % 14 AS pred, (score_b - 1) / 49.0 AS conf FROM pixels)"


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.pixels(spark, sf_dir).withColumn("pred", F.col("predclass_fine") % 14).withColumn("conf", (F.col("score_b") - 1) / 49.0)


def miou_of(pred: DataFrame, gt: str = "train_id", guess: str = "pred") -> DataFrame:
    """Per class with a union: inter, union, iou; ignored targets are left out."""
    m = pred.filter(F.col(gt) != 255).groupBy(gt, guess).agg(F.count("*").alias("n"))
    side = lambda c: m.groupBy(F.col(c).alias("cls")).agg(F.sum("n").alias(f"n_{c}"))
    inter = m.filter(F.col(gt) == F.col(guess)).select(F.col(gt).alias("cls"), F.col("n").alias("inter"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = side(gt).join(side(guess), "cls", "full_outer").join(inter, "cls", "left").withColumn("inter", zero("inter"))
    return out.select("cls", "inter", (zero(f"n_{gt}") + zero(f"n_{guess}") - F.col("inter")).alias("union"))


@query("miou", f"""WITH {_PRED}, m AS (SELECT train_id AS g, pred AS p, count(*) AS n FROM pred WHERE train_id <> 255 AND split = 'test' GROUP BY ALL),
c AS (SELECT DISTINCT g AS cls FROM m UNION SELECT DISTINCT p FROM m),
i AS (SELECT cls, coalesce((SELECT sum(n) FROM m WHERE g = cls AND p = cls), 0) AS inter, coalesce((SELECT sum(n) FROM m WHERE g = cls), 0) + coalesce((SELECT sum(n) FROM m WHERE p = cls), 0) AS both_n FROM c)
SELECT count(*) AS classes, round(avg(CAST(inter AS DOUBLE) / (both_n - inter)), 6) AS miou FROM i""")
def miou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return miou_of(predicted(spark, sf_dir).filter("split = 'test'")).agg(F.count("*").alias("classes"), F.round(F.avg(F.col("inter") / F.col("union")), 6).alias("miou"))


@query("confusion_matrix", f"WITH {_PRED} SELECT label_key, pred, count(*) AS n, round(sum(conf), 6) AS conf_sum FROM pred WHERE split = 'test' GROUP BY label_key, pred")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir).filter("split = 'test'").groupBy("label_key", "pred").agg(F.count("*").alias("n"), F.round(F.sum("conf"), 6).alias("conf_sum"))


@query("confusion_top3", f"""WITH {_PRED}, c AS (SELECT label_key, name, pred, count(*) AS n, sum(count(*)) OVER (PARTITION BY label_key) AS total FROM pred WHERE split = 'test' GROUP BY label_key, name, pred)
SELECT label_key, name, pred, round(CAST(n AS DOUBLE) / total, 6) AS share, row_number() OVER (PARTITION BY label_key ORDER BY n DESC, pred) AS rank FROM c WHERE total >= 100 QUALIFY rank <= 3""")
def confusion_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("label_key")
    c = predicted(spark, sf_dir).filter("split = 'test'").groupBy("label_key", "name", "pred").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(own)).filter("total >= 100")
    rank = F.row_number().over(own.orderBy(F.desc("n"), "pred"))
    return c.select("label_key", "name", "pred", F.round(F.col("n") / F.col("total"), 6).alias("share"), rank.cast("long").alias("rank")).filter("rank <= 3")


@query("borderline_selfpred", f"WITH {_PRED} SELECT label_key, name, count(*) AS n, round(avg(CASE WHEN pred = train_id THEN 1e0 ELSE 0e0 END), 6) AS self_rate, avg(CASE WHEN pred = train_id THEN 1e0 ELSE 0e0 END) > 0.5 AS keep FROM pred WHERE is_border GROUP BY label_key, name")
def borderline_selfpred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.avg((F.col("pred") == F.col("train_id")).cast("double"))
    return predicted(spark, sf_dir).filter("is_border").groupBy("label_key", "name").agg(F.count("*").alias("n"), F.round(rate, 6).alias("self_rate"), (rate > 0.5).alias("keep"))


@query("pooled_confidence", f"WITH {_PRED} SELECT gt, round(sum(conf) / count(*), 6) AS mean_conf, count(*) AS n FROM pred WHERE gt <> 255 GROUP BY gt")
def pooled_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir).filter("gt <> 255").groupBy("gt").agg(F.round(F.sum("conf") / F.count("*"), 6).alias("mean_conf"), F.count("*").alias("n"))


# --- fusion ---

_Z = f"""{PIXELS}, st AS (SELECT avg(score_a) AS ma, stddev_pop(score_a) AS sa, avg(score_b) AS mb, stddev_pop(score_b) AS sb FROM pixels WHERE split = 'val' AND gt = 0),
zn AS (SELECT pixels.*, (score_a - ma) / (sa + 1e-6) AS za, (score_b - mb) / (sb + 1e-6) AS zb FROM pixels, st)"""
BETAS = [0.0, 0.25, 0.5, 1.0]


def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels with za, zb: scores standardised by the validation set's in-distribution rows."""
    px = fixtures.pixels(spark, sf_dir)
    px = px.crossJoin(F.broadcast(calibrate.zstats(px.filter("split = 'val' AND gt = 0"), ["score_a", "score_b"])))
    return px.withColumn("za", z(F.col("score_a"), F.col("m_score_a"), F.col("s_score_a"))).withColumn("zb", z(F.col("score_b"), F.col("m_score_b"), F.col("s_score_b")))


@query("znorm", f"WITH {_Z} SELECT split, gt, round(avg(za), 5) + 0.0 AS mean_a, round(stddev_pop(za), 5) AS std_a, round(avg(zb), 5) + 0.0 AS mean_b, round(stddev_pop(zb), 5) AS std_b, count(*) AS n FROM zn GROUP BY split, gt")
def znorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardised(spark, sf_dir).groupBy("split", "gt").agg(*((F.round(f(c), 5) + 0.0).alias(n) for f, c, n in ((F.avg, "za", "mean_a"), (F.stddev_pop, "za", "std_a"), (F.avg, "zb", "mean_b"), (F.stddev_pop, "zb", "std_b"))), F.count("*").alias("n"))


_FUSED = f"{_Z}, fused AS (SELECT split, gt, b.beta, round(za + b.beta * zb, 9) AS score FROM zn, (VALUES (0e0), (0.25e0), (0.5e0), (1e0)) b(beta))"


def fused(spark: SparkSession, sf_dir: str, betas: list[float] = BETAS) -> DataFrame:
    """Rows by beta: score = za + beta * zb. The betas are a column, not a loop."""
    rows = standardised(spark, sf_dir).withColumn("beta", F.explode(F.array(*map(F.lit, betas))))
    return rows.withColumn("score", F.round(F.col("za") + F.col("beta") * F.col("zb"), 9))


@query("ours_score", f"WITH {_FUSED}, t AS (SELECT * FROM fused WHERE split = 'test' AND beta = 1), {points_sql('t', '')} {metrics_sql('')}")
def ours_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.metrics(fused(spark, sf_dir, [1.0]).filter("split = 'test'"), [])


@query("align_check", f"""WITH {PIXELS}, a AS (SELECT frame_id, l_orderkey, l_linenumber, l_partkey, label_key, score_a, count(*) AS n FROM pixels GROUP BY ALL),
b AS (SELECT frame_id, l_orderkey, l_linenumber, l_partkey, label_key, score_a, count(*) AS n FROM pixels WHERE l_orderkey % 7 <> 0 OR l_linenumber <> 1 GROUP BY ALL)
SELECT count(*) AS misaligned FROM a FULL JOIN b USING (frame_id, l_orderkey, l_linenumber, l_partkey, score_a) WHERE a.n IS NULL OR b.n IS NULL OR a.label_key <> b.label_key""")
def align_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["frame_id", "l_orderkey", "l_linenumber", "l_partkey", "score_a"]
    px = fixtures.pixels(spark, sf_dir)
    stack = lambda d, s: d.groupBy(*key, "label_key").agg(F.count("*").alias(f"n_{s}")).withColumnRenamed("label_key", f"k_{s}")
    return misaligned(stack(px, "a"), stack(px.filter("l_orderkey % 7 <> 0 OR l_linenumber <> 1"), "b"), key)


def misaligned(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """How many positions of two score stacks (key, n_, k_) lack a partner or differ in class."""
    return a.join(b, key, "full_outer").filter("n_a IS NULL OR n_b IS NULL OR k_a <> k_b").agg(F.count("*").alias("misaligned"))


_BETA = f"{_FUSED}, v AS (SELECT * FROM fused WHERE split = 'val'), {points_sql('v', 'beta')}, m AS ({metrics_sql('beta')})"


@query("beta_select", f"WITH {_BETA} SELECT CAST(beta AS DOUBLE) AS beta, ap FROM m ORDER BY ap DESC, beta LIMIT 1")
def beta_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.metrics(fused(spark, sf_dir).filter("split = 'val'"), ["beta"]).orderBy(F.desc("ap"), "beta").limit(1).select("beta", "ap")


_FINAL = f"""{_FUSED}, t AS (SELECT 'fused_' || CAST(beta AS DECIMAL(4, 2)) AS method, gt, score FROM fused WHERE split = 'test' UNION ALL SELECT 'only_b', gt, score_b FROM pixels WHERE split = 'test'),
{points_sql('t', 'method')}, m AS ({metrics_sql('method')}), base AS (SELECT ap AS base_ap FROM m WHERE method = 'fused_0.00'), single AS (SELECT max(ap) AS single_ap FROM m WHERE method IN ('fused_0.00', 'only_b'))"""


@query("method_final", f"WITH {_FINAL} SELECT method, ap, auroc, fpr95, round(ap - base_ap, 6) AS delta_base, round(ap - single_ap, 6) AS delta_single FROM m, base, single")
def method_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the single score is one more row of each pixel, so that pixels are read once
    each = [F.struct(F.lit(f"fused_{b:.2f}").alias("method"), F.round(F.col("za") + b * F.col("zb"), 9).alias("score")) for b in BETAS]
    each.append(F.struct(F.lit("only_b").alias("method"), F.col("score_b").cast("double").alias("score")))
    rows = standardised(spark, sf_dir).filter("split = 'test'").select("gt", F.explode(F.array(*each)).alias("m")).select("gt", "m.*")
    # a row per method
    m = ranking.metrics(rows, ["method"])
    every = Window.partitionBy(F.lit(0))
    best = lambda *of: F.max(F.when(F.col("method").isin(*of), F.col("ap"))).over(every)
    return m.withColumn("base_ap", best("fused_0.00")).withColumn("single_ap", best("fused_0.00", "only_b")).select("method", "ap", "auroc", "fpr95", F.round(F.col("ap") - F.col("base_ap"), 6).alias("delta_base"), F.round(F.col("ap") - F.col("single_ap"), 6).alias("delta_single"))


_SEEDS = f"{_TEST}, s AS (SELECT method, CAST(l_partkey % 3 AS INTEGER) AS seed, gt, score FROM test), {points_sql('s', 'method, seed')}, m AS ({metrics_sql('method, seed', digits=None)})"


@query("seed_stability", f"WITH {_SEEDS} SELECT method, round(avg(ap), 6) AS mean_ap, round(stddev_pop(ap), 6) AS std_ap, round(stddev_pop(ap) / (avg(ap) + 1e-9), 6) AS cv_ap, round(max(ap) - min(ap), 6) AS spread, count(*) AS seeds FROM m GROUP BY method")
def seed_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = test_methods(spark, sf_dir).withColumn("seed", F.col("l_partkey") % 3)
    m = ranking.metrics(rows, ["method", "seed"], digits=None)
    return m.groupBy("method").agg(F.round(F.avg("ap"), 6).alias("mean_ap"), F.round(F.stddev_pop("ap"), 6).alias("std_ap"), F.round(F.stddev_pop("ap") / (F.avg("ap") + 1e-9), 6).alias("cv_ap"), F.round(F.max("ap") - F.min("ap"), 6).alias("spread"), F.count("*").alias("seeds"))


@query("downsample", f"WITH {GRID} SELECT frame_id, y, CAST(x AS INTEGER) AS x, round(score, 6) AS score, gt FROM gridded WHERE y % 4 = 0 AND x % 4 = 0")
def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.grid(spark, sf_dir).filter("y % 4 = 0 AND x % 4 = 0").select("frame_id", "y", "x", F.round("score", 6).alias("score"), "gt")
