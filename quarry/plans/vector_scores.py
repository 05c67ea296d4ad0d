"""Scores from logits and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scores
from quarry.operators import ranking, rasters, vectors
from quarry.plans.base import axis_sql, FEATURES, GRID, metrics_sql, points_sql, query
from quarry.sources import fixtures
from quarry.sources.fixtures import read

_TOP = "list_max(logits)"
_SUMEXP = f"list_sum(list_transform(logits, lambda x: exp(x - {_TOP})))"


@query("score_msp", f"WITH {FEATURES} SELECT vec_id, round(1 - 1 / {_SUMEXP}, 6) AS score FROM features")
def score_msp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.features(spark, sf_dir).select("vec_id", F.round(scores.msp(F.col("logits")), 6).alias("score"))


@query("score_maxlogit", f"WITH {FEATURES} SELECT vec_id, round(-{_TOP}, 6) AS score FROM features")
def score_maxlogit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.features(spark, sf_dir).select("vec_id", F.round(scores.maxlogit(F.col("logits")), 6).alias("score"))


@query("score_energy", f"WITH {FEATURES} SELECT vec_id, round(-({_TOP} + ln({_SUMEXP})), 6) AS score FROM features")
def score_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.features(spark, sf_dir).select("vec_id", F.round(scores.energy(F.col("logits")), 6).alias("score"))


LEAST = 100
_SML = f"""{FEATURES}, pc AS (SELECT *, CAST(list_position(logits, {_TOP}) - 1 AS INTEGER) AS cls, {_TOP} AS top FROM features),
g AS (SELECT avg(top) AS gm, sqrt(greatest(var_pop(top), 1e-6)) AS gs FROM pc WHERE gt = 0),
s AS (SELECT cls, count(*) AS n, avg(top) AS m, stddev_pop(top) AS sd FROM pc WHERE gt = 0 GROUP BY cls),
sml AS (SELECT cls, n, CASE WHEN n < {LEAST} THEN gm ELSE m END AS mean, greatest(CASE WHEN n < {LEAST} THEN gs ELSE sd END, 0.1 * gs) AS std FROM s, g)"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.features(spark, sf_dir).withColumn("cls", scores.argmax(F.col("logits"))).withColumn("top", F.array_max("logits"))


def class_stats(pred: DataFrame, least: int = 100) -> DataFrame:
    """cls, n, mean, std of the largest logit by predicted class; classes under `least` rows take the global figures, and
    no deviation is under a tenth of the global one."""
    base = pred.filter("gt = 0")
    g = base.agg(F.avg("top").alias("gm"), F.sqrt(F.greatest(F.var_pop("top"), F.lit(1e-6))).alias("gs"))
    few = F.col("n") < least
    s = base.groupBy("cls").agg(F.count("*").alias("n"), F.avg("top").alias("m"), F.stddev_pop("top").alias("sd")).crossJoin(F.broadcast(g))
    return s.select("cls", "n", F.when(few, F.col("gm")).otherwise(F.col("m")).alias("mean"), F.greatest(F.when(few, F.col("gs")).otherwise(F.col("sd")), 0.1 * F.col("gs")).alias("std"))


@query("sml_stats", f"WITH {_SML} SELECT cls, n, round(mean, 6) AS mean, round(std, 6) AS std FROM sml")
def sml_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_stats(predicted(spark, sf_dir), LEAST).select("cls", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("score_sml", f"WITH {_SML} SELECT vec_id, round(-(top - mean) / std, 6) AS score FROM pc JOIN sml USING (cls)")
def score_sml(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = predicted(spark, sf_dir)
    return pred.join(F.broadcast(class_stats(pred, LEAST)), "cls").select("vec_id", F.round(scores.standardised(F.col("top"), F.col("mean"), F.col("std")), 6).alias("score"))


@query("l2norm", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (vec_id + 1)) AS e FROM embeddings) SELECT vec_id, round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS first, round(list_sum(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))), 5) AS total FROM v")
def l2norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1)))
    v = v.withColumn("u", scores.l2norm(F.col("e")))
    return v.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


_RBA = """q AS (SELECT vec_id % 25 AS px, vec_id AS q, 1 / (1 + exp(-10 * CAST(embedding[11] AS DOUBLE))) AS sig, list_transform(embedding[1:10], lambda v: exp(10 * CAST(v AS DOUBLE))) AS ex FROM embeddings),
pq AS (SELECT px, sig, unnest(ex) / list_sum(ex) AS p, unnest(generate_series(0, 9)) AS c FROM q), l AS (SELECT px, c, sum(p * sig) AS lc FROM pq GROUP BY px, c)"""


@query("rba_score", f"WITH {_RBA} SELECT px, round(-sum(lc), 6) AS rba, round(-max(lc), 6) AS msp_m2f, CAST(arg_max(c, lc) AS INTEGER) AS predclass FROM l GROUP BY px")
def rba_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask-query maps: the class evidence of a pixel is the sum over queries of class probability times mask."""
    e = read(spark, sf_dir, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 10), lambda v: F.exp(10 * v.cast("double")))
    q = e.select((F.col("vec_id") % 25).alias("px"), scores.sigmoid(10 * F.element_at("embedding", 11).cast("double")).alias("sig"), logits.alias("ex"))
    q = q.withColumn("total", F.aggregate("ex", F.lit(0.0), lambda a, x: a + x)).select("px", "sig", "total", F.posexplode("ex").alias("c", "x"))
    m = q.groupBy("px", "c").agg(F.sum(F.col("x") / F.col("total") * F.col("sig")).alias("lc"))
    return m.groupBy("px").agg(F.round(-F.sum("lc"), 6).alias("rba"), F.round(-F.max("lc"), 6).alias("msp_m2f"), F.max_by("c", "lc").alias("predclass"))


_BANK = "bank AS (SELECT vec_id, label, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 7919) % 65537, vec_id) AS nth FROM features WHERE NOT is_query AND gt = 0) WHERE nth <= 30 ORDER BY label, nth LIMIT 200)"


BANK_BYTES = 1 << 20  # of the 200 vectors at most


def memory_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.features(spark, sf_dir).filter("NOT is_query AND gt = 0").withColumn("o", F.struct((F.col("vec_id") * 7919 % 65537).alias("h"), "vec_id"))
    return vectors.bank(f, "label", F.col("o"), 30, 200).select("vec_id", "label", "embedding")


@query("bank_build", f"WITH {FEATURES}, {_BANK} SELECT vec_id, label FROM bank")
def bank_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_bank(spark, sf_dir).select("vec_id", "label")


_SIMS = f"{FEATURES}, {_BANK}, sims AS (SELECT q.vec_id, q.gt, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM features q, bank b WHERE q.is_query), rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC) AS r FROM sims)"


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.features(spark, sf_dir).filter("is_query")


@query("knn_score", f"WITH {_SIMS} SELECT vec_id, round(1 - max(s), 6) AS score FROM sims GROUP BY vec_id")
def knn_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.top_cosines(query_vectors(spark, sf_dir), memory_bank(spark, sf_dir), 1, ["vec_id"], bank_bytes=BANK_BYTES)
    return found.select("vec_id", F.round(1 - F.element_at("sims", 1), 6).alias("score"))


@query("cdnp_score", f"WITH {_SIMS} SELECT vec_id, round(1 - avg(s) FILTER (r <= 1), 6) AS cdnp_1, round(1 - avg(s) FILTER (r <= 5), 6) AS cdnp_5, round(1 - avg(s) FILTER (r <= 15), 6) AS cdnp_15 FROM rk GROUP BY vec_id")
def cdnp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.knn_scores(vectors.top_cosines(query_vectors(spark, sf_dir), memory_bank(spark, sf_dir), 15, ["vec_id"], bank_bytes=BANK_BYTES), [1, 5, 15])
    return found.select("vec_id", *(F.round(f"cdnp_{k}", 6).alias(f"cdnp_{k}") for k in (1, 5, 15)))


@query("veg_featdist", f"""WITH {_SIMS}, d AS (SELECT vec_id, gt, 1 - max(s) AS dist FROM sims GROUP BY vec_id, gt), md AS (SELECT median(dist) FILTER (gt = 0) AS med_veg, median(dist) FILTER (gt = 1) AS med_ood FROM d),
{points_sql('d', '', score='round(dist, 9)')}, m AS ({metrics_sql('')})
SELECT round(med_veg, 6) AS med_veg, round(med_ood, 6) AS med_ood, round((SELECT avg(CASE WHEN dist > med_ood THEN 1e0 ELSE 0e0 END) FROM d WHERE gt = 0), 6) AS overlap, auroc FROM md, m""")
def veg_featdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.top_cosines(query_vectors(spark, sf_dir), memory_bank(spark, sf_dir), 1, ["vec_id", "gt"], bank_bytes=BANK_BYTES)
    d = found.select("gt", F.round(1 - F.element_at("sims", 1), 9).alias("score"))
    med = ranking.quantiles(d, ["gt"], "score", [0.5]).agg(*(F.max(F.when(F.col("gt") == k, F.col("q"))).alias(a) for k, a in ((0, "med_veg"), (1, "med_ood"))))
    over = d.filter("gt = 0").crossJoin(F.broadcast(med)).agg(F.round(F.avg((F.col("score") > F.col("med_ood")).cast("double")), 6).alias("overlap"))
    m = ranking.metrics(d, []).select("auroc")
    return med.select(F.round("med_veg", 6).alias("med_veg"), F.round("med_ood", 6).alias("med_ood")).crossJoin(over).crossJoin(m)


_LEAK = f"""{FEATURES}, banks AS (SELECT 'clean' AS bank, embedding FROM features WHERE NOT is_query AND gt = 0 AND vec_id % 2 = 0 UNION ALL
SELECT 'leaky', embedding FROM features WHERE NOT is_query AND gt = 0 AND (vec_id % 4 = 0 OR vec_id % 4 = 1)),
d AS (SELECT bank, q.vec_id, q.gt, round(1 - max(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 9) AS score FROM features q, banks b WHERE q.is_query GROUP BY ALL), {points_sql('d', 'bank')}"""


@query("leakage_ablation", f"WITH {_LEAK} {metrics_sql('bank')}")
def leakage_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries against banks of one half of the frames and of a mix of both."""
    f = fixtures.features(spark, sf_dir).filter("NOT is_query AND gt = 0")
    banks = f.filter("vec_id % 2 = 0").select(F.lit("clean").alias("bank"), "embedding").unionByName(f.filter("vec_id % 4 IN (0, 1)").select(F.lit("leaky").alias("bank"), "embedding"))
    found = vectors.top_cosines(query_vectors(spark, sf_dir), banks, 1, ["vec_id", "gt"], ["bank"])
    return ranking.metrics(found.select("bank", "gt", F.round(1 - F.element_at("sims", 1), 9).alias("score")), ["bank"])


_MAHA = f"""{FEATURES}, v AS (SELECT vec_id, label, unnest(generate_series(0, len(embedding) - 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM features WHERE NOT is_query AND gt = 0),
mu AS (SELECT label, i, count(*) AS n, avg(x) AS m FROM v GROUP BY label, i), tot AS (SELECT count(*) AS total FROM features WHERE NOT is_query AND gt = 0),
s2 AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS s FROM v a JOIN v b USING (vec_id) GROUP BY a.i, b.i), bt AS (SELECT a.i, b.i AS j, sum(a.n * a.m * b.m) AS b FROM mu a JOIN mu b USING (label) GROUP BY a.i, b.i)"""


def fit(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return vectors.class_moments(fixtures.features(spark, sf_dir).filter("NOT is_query AND gt = 0"), "label")


@query("maha_fit", f"WITH {_MAHA} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round((s - b) / total, 8) AS cov FROM s2 JOIN bt USING (i, j), tot")
def maha_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit(spark, sf_dir)[1].select("i", "j", F.round("cov", 8).alias("cov"))


# the inverse by Gauss and Jordan's elimination, a column in each step
_INVERSE = f"""WITH RECURSIVE {_MAHA}, cov AS (SELECT i, j, (s - b) / total AS c FROM s2 JOIN bt USING (i, j), tot), dim AS (SELECT max(i) + 1 AS d, 1e-6 * avg(c) FILTER (i = j) AS ridge FROM cov),
line AS (SELECT i, list(c + CASE WHEN i = j THEN ridge ELSE 0 END ORDER BY j) || list(CASE WHEN i = j THEN 1e0 ELSE 0e0 END ORDER BY j) AS r FROM cov, dim GROUP BY i),
gj AS (SELECT 0 AS k, list(r ORDER BY i) AS m FROM line UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / r[k + 1]) ELSE list_transform(r, lambda x, j: x - r[k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END) FROM gj, dim WHERE k < d),
inv AS (SELECT list_transform(m, lambda r: r[d + 1:]) AS a FROM gj, dim WHERE k = d), mean AS (SELECT label, list(m ORDER BY i) AS m FROM mu GROUP BY label),
dif AS (SELECT vec_id, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) - m[i]) AS d FROM features, mean WHERE is_query)
SELECT vec_id, round(min(list_sum(list_transform(d, lambda x, i: x * list_dot_product(d, a[i])))), 6) AS score FROM dif, inv GROUP BY vec_id"""


@query("maha_score", _INVERSE)
def maha_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    means, cov = fit(spark, sf_dir)
    return vectors.mahalanobis(query_vectors(spark, sf_dir), means, cov, ["vec_id"]).select("vec_id", F.round("score", 6).alias("score"))


@query("pure_patches", f"WITH {GRID} SELECT frame_id, y // 4 AS gy, CAST(x // 4 AS INTEGER) AS gx, max(CASE WHEN gt = 0 THEN 0 ELSE 1 END) = 0 AS pure FROM gridded GROUP BY ALL")
def pure_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixtures.grid(spark, sf_dir).withColumn("gy", F.floor(F.col("y") / 4).cast("int")).withColumn("gx", F.floor(F.col("x") / 4).cast("int"))
    return g.groupBy("frame_id", "gy", "gx").agg(F.bool_and(F.col("gt") == 0).alias("pure"))


# adaptive windows: patch i of 6 covers rows floor(i * 20 / 6) to ceil((i + 1) * 20 / 6); neighbours may overlap
_PATCH = f"""{GRID}, cls AS (SELECT frame_id, y, x, CASE WHEN gt = 0 THEN CAST(abs(floor(score * 20)) AS INTEGER) % 4 ELSE 255 END AS train_id FROM gridded),
py AS (SELECT unnest(generate_series(0, 5)) AS gy), pxs AS (SELECT unnest(generate_series(0, 9)) AS gx),
n AS (SELECT frame_id, gy, gx, train_id, count(*) AS n FROM cls, py, pxs WHERE y >= gy * 20 // 6 AND y < ((gy + 1) * 20 + 5) // 6 AND x >= gx * 64 // 10 AND x < ((gx + 1) * 64 + 9) // 10 GROUP BY ALL)"""


@query("patch_majority", f"""WITH {_PATCH} SELECT frame_id, CAST(gy AS INTEGER) AS gy, CAST(gx AS INTEGER) AS gx, coalesce(arg_max(train_id, n * 1000 - train_id) FILTER (train_id <> 255), 255) AS train_id,
CAST(coalesce(sum(n) FILTER (train_id = 255), 0) AS DOUBLE) / sum(n) > 0.5 AS mostly_outlier FROM n GROUP BY frame_id, gy, gx""")
def patch_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent in-distribution class of each patch (the smallest of equals; 255 without any), and whether over
    half of it is none."""
    g = fixtures.grid(spark, sf_dir)
    g = g.withColumn("train_id", F.when(F.col("gt") == 0, F.abs(F.floor(F.col("score") * 20)) % 4).otherwise(255).cast("int"))

    def cover(c: str, of: int, n: int) -> F.Column:
        """The patches whose window holds the place."""
        at = F.sequence(F.lit(0), F.lit(n - 1))
        return F.explode(F.filter(at, lambda i: (F.col(c) >= F.floor(i * of / n)) & (F.col(c) < F.ceil((i + 1) * of / n))))

    n = g.withColumn("gy", cover("y", 20, 6)).withColumn("gx", cover("x", 64, 10)).groupBy("frame_id", "gy", "gx", "train_id").agg(F.count("*").alias("n"))
    own = F.col("train_id") != 255
    best = F.max_by(F.when(own, F.col("train_id")), F.when(own, F.struct("n", (-F.col("train_id")).alias("t"))))
    share = F.sum(F.when(own, 0).otherwise(F.col("n"))) / F.sum("n")
    return n.groupBy("frame_id", "gy", "gx").agg(F.coalesce(best, F.lit(255)).alias("train_id"), (share > 0.5).alias("mostly_outlier"))


@query("score_nongreen", "SELECT p_partkey, CAST(-(((p_partkey // 3) % 256) - 0.5 * ((p_partkey % 256) + p_size * 5)) AS DOUBLE) + 0e0 AS score FROM part")
def score_nongreen(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = F.col("p_partkey") % 256, F.floor(F.col("p_partkey") / 3) % 256, F.col("p_size") * 5
    return read(spark, sf_dir, "part").select("p_partkey", (scores.nongreen(r.cast("double"), g.cast("double"), b.cast("double")) + 0.0).alias("score"))


def _uniform_sql(name: str) -> str:
    return f"(CAST('0x' || substr(md5(p_partkey || ':{name}'), 1, 12) AS BIGINT) + 0.5e0) / 281474976710656e0"


@query("score_random", f"SELECT p_partkey, round(sqrt(-2 * ln({_uniform_sql('a')})) * cos(2 * pi() * {_uniform_sql('b')}), 6) AS score FROM part")
def score_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normally distributed, by a hash of the key, so that reruns and other engines get the same."""
    return read(spark, sf_dir, "part").select("p_partkey", F.round(scores.gaussian(F.col("p_partkey")), 6).alias("score"))


@query("upsample_nearest", f"WITH {GRID}, t AS (SELECT unnest(generate_series(0, 49)) AS yy), u AS (SELECT unnest(generate_series(0, 99)) AS xx) SELECT frame_id, CAST(yy AS INTEGER) AS yy, CAST(xx AS INTEGER) AS xx, round(score, 6) AS score FROM t, u, gridded WHERE y = yy * 20 // 50 AND x = xx * 64 // 100")
def upsample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of 20 by 64 stretched to 50 by 100; each place takes the pixel that it falls on."""
    small = fixtures.grid(spark, sf_dir).select("frame_id", "y", "x", F.round("score", 6).alias("score"))
    at = spark.range(50).select(F.col("id").cast("int").alias("yy")).crossJoin(spark.range(100).select(F.col("id").cast("int").alias("xx")))
    at = at.withColumn("y", F.floor(F.col("yy") * 20 / 50).cast("int")).withColumn("x", F.floor(F.col("xx") * 64 / 100).cast("int"))
    return small.join(F.broadcast(at), ["y", "x"]).select("frame_id", "yy", "xx", "score")


@query("upsample_bilinear", f"WITH {GRID}, {axis_sql(20, 30, 'ay')}, {axis_sql(64, 96, 'ax')} SELECT frame_id, ay.t AS yy, ax.t AS xx, round(sum(score * ay.w * ax.w), 6) + 0e0 AS score FROM gridded JOIN ay ON y = ay.s JOIN ax ON x = ax.s GROUP BY ALL")
def upsample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rasters.bilinear(fixtures.grid(spark, sf_dir), ["frame_id"], (20, 64), (30, 96))
    return out.select("frame_id", "yy", "xx", (F.round("score", 6) + 0.0).alias("score"))


@query("patch_size", "SELECT p_partkey, CAST(floor(round((100 + p_size * 7) * (518e0 / least(100 + p_size * 7, 90 + p_partkey % 300))) / 14) * 14 AS INTEGER) AS height, CAST(floor(round((90 + p_partkey % 300) * (518e0 / least(100 + p_size * 7, 90 + p_partkey % 300))) / 14) * 14 AS INTEGER) AS width FROM part")
def patch_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, w = rasters.patch_size(F.lit(100) + F.col("p_size") * 7, F.lit(90) + F.col("p_partkey") % 300)
    return read(spark, sf_dir, "part").select("p_partkey", h.alias("height"), w.alias("width"))
