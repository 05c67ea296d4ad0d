"""Ontology, splits and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import ontology, ranking, splits
from quarry.plans.base import ONTO, PIXELS, query, resolved_sql
from quarry.sources import fixtures
from quarry.sources.fixtures import read

RESOLVED_COLUMNS = ["label_key", "name", "eff_role", "tier", "is_border", "train_id", "gt"]
_COLS = ", ".join(RESOLVED_COLUMNS)


# an ontology of several datasets as a table: a class for each type and size of part
_ROLES = ["ignore", "id_terrain", "id_vegetation", "borderline", "ood_tier1", "ood_tier2", "ood_tier3", "id_water"]
_OOD_NAMES = ["Brand#1", "Brand#3", "Brand#12", "Brand#20"]
_TABLE = f"""own AS (SELECT p_type AS dataset, p_size AS label_key, min(p_brand) AS name, min(p_partkey) AS k FROM part GROUP BY p_type, p_size),
onto AS (SELECT dataset, label_key, name, {_ROLES}[k % 8 + 1] AS role, CASE WHEN k % 8 = 3 AND k % 16 = 3 THEN 'id_vegetation' END AS default_role, k % 16 = 8 AS catch_all FROM own)"""


def class_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ontology that is read from a table: dataset, label_key, name, role, default_role, catch_all."""
    own = read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("dataset"), F.col("p_size").alias("label_key")).agg(F.min("p_brand").alias("name"), F.min("p_partkey").alias("k"))
    role = F.element_at(F.array(*map(F.lit, _ROLES)), (F.col("k") % 8 + 1).cast("int"))
    return own.select("dataset", "label_key", "name", role.alias("role"), F.when(F.col("k") % 16 == 3, "id_vegetation").alias("default_role"), (F.col("k") % 16 == 8).alias("catch_all"))


@query("ontology_resolve", f"WITH {_TABLE}, {resolved_sql('resolved', 'dataset')} SELECT dataset, {_COLS} FROM resolved")
def ontology_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.resolve(class_table(spark, sf_dir)).select("dataset", *RESOLVED_COLUMNS)


@query("ontology_competitor", f"WITH {_TABLE}, {resolved_sql('competitor', 'dataset', _OOD_NAMES)} SELECT dataset, {_COLS} FROM competitor")
def ontology_competitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.resolve_competitor(class_table(spark, sf_dir), _OOD_NAMES).select("dataset", *RESOLVED_COLUMNS)


@query("ontology_validate", f"""WITH {ONTO}, native AS (SELECT DISTINCT p_size AS label_key FROM part)
SELECT label_key, 'unmapped' AS side FROM native WHERE label_key NOT IN (SELECT label_key FROM onto)
UNION ALL SELECT label_key, 'unused' FROM onto WHERE label_key NOT IN (SELECT label_key FROM native)""")
def ontology_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.validate(read(spark, sf_dir, "part").select(F.col("p_size").alias("label_key")), ontology.classes(spark))


@query("pixel_gt", f"WITH {PIXELS} SELECT split, label_key, gt, tier, train_id, count(*) AS n FROM pixels GROUP BY ALL")
def pixel_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.pixels(spark, sf_dir).groupBy("split", "label_key", "gt", "tier", "train_id").agg(F.count("*").alias("n"))


@query("class_pixels", f"WITH {PIXELS} SELECT CAST(k.k AS INTEGER) AS label_key, count(frame_id) AS n FROM (SELECT unnest(generate_series(0, 255)) AS k) k LEFT JOIN pixels ON label_key = k.k GROUP BY k.k")
def class_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fixtures.pixels(spark, sf_dir).groupBy("label_key").agg(F.count("*").alias("m"))
    keys = spark.range(256).select(F.col("id").cast("int").alias("label_key"))
    return keys.join(n, "label_key", "left").select("label_key", F.coalesce("m", F.lit(0)).alias("n"))


@query("class_frames", f"WITH {PIXELS} SELECT label_key, name, count(DISTINCT frame_id) AS frames, count(*) AS n FROM pixels GROUP BY label_key, name HAVING count(DISTINCT frame_id) >= 5")
def class_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.pixels(spark, sf_dir).groupBy("label_key", "name").agg(F.count_distinct("frame_id").alias("frames"), F.count("*").alias("n")).filter("frames >= 5")


@query("rgb_to_id", """WITH cmap AS (SELECT p_size AS id, min(p_partkey % 256) AS r, min((p_partkey // 3) % 256) AS g, min(p_size * 5) AS b FROM part GROUP BY p_size),
px AS (SELECT p_partkey, p_partkey % 256 AS r, (p_partkey // 3) % 256 AS g, p_size * 5 AS b FROM part)
SELECT p_partkey, coalesce(id, 0) AS label_key FROM px LEFT JOIN cmap ON px.r * 65536 + px.g * 256 + px.b = cmap.r * 65536 + cmap.g * 256 + cmap.b""")
def rgb_to_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 256).alias("r"), (F.floor(F.col("p_partkey") / 3) % 256).alias("g"), (F.col("p_size") * 5).alias("b"))
    colormap = px.groupBy(F.col("p_size").alias("id")).agg(F.min("r").alias("r"), F.min("g").alias("g"), F.min("b").alias("b"))
    return ontology.colour_keys(px, colormap).select("p_partkey", "label_key")


MANIFEST = [("train", "EU"), ("train", "AF"), ("val", "ASIA"), ("test", "AMERICA"), ("test", "EAST"), ("val", "MIDDLE")]
_MANIFEST = "splits AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in MANIFEST) + ") t(split, site))"
_FRAMES = "frames AS (SELECT s_suppkey AS frame_id, 'a_b_c_' || replace(n_name, ' ', '_') || '_' || replace(r_name, ' ', '_') AS scene FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame per supplier; its scene is named for nation and region."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    under = lambda c: F.regexp_replace(c, " ", "_")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("frame_id"), F.concat(F.lit("a_b_c_"), under("n_name"), F.lit("_"), under("r_name")).alias("scene"))


def manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MANIFEST, "split string, site string")


@query("split_frames", f"WITH {_FRAMES}, {_MANIFEST} SELECT frame_id, scene, split, site FROM frames JOIN splits ON contains(scene, site)")
def split_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_frames(frames(spark, sf_dir), manifest(spark)).select("frame_id", "scene", "split", "site")


_SITES = "['EU', 'AF', 'ASIA', 'EAST', 'MIDDLE']"


@query("site_of", f"""WITH {_FRAMES}, h AS (SELECT frame_id, scene, list_filter({_SITES}, lambda s: contains(scene, s)) AS hits FROM frames)
SELECT frame_id, CASE WHEN len(hits) = 1 THEN hits[1] WHEN len(hits) > 1 THEN hits[1] || '?MULTI' ELSE 'AMBIGUOUS:' || regexp_replace(scene, '^[^_]*_', '') END AS site FROM h""")
def site_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("frame_id", splits.site_of(F.col("scene"), ["EU", "AF", "ASIA", "EAST", "MIDDLE"]).alias("site"))


_SCENES = f"""{PIXELS}, per_frame AS (SELECT split, site, frame_id, max(CASE WHEN gt = 1 THEN 1 ELSE 0 END) AS ood FROM pixels GROUP BY ALL),
per_site AS (SELECT site, count(*) AS frames, CAST(sum(ood) AS BIGINT) AS ood_frames FROM per_frame GROUP BY site),
site_classes AS (SELECT site, string_agg(name, ',' ORDER BY name) AS ood_classes, count(*) AS n_classes FROM (SELECT DISTINCT site, name FROM pixels WHERE gt = 1) GROUP BY site)"""


@query("site_rollup", f"WITH {_SCENES} SELECT site, frames, ood_frames, ood_classes FROM per_site JOIN site_classes USING (site)")
def site_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fixtures.pixels(spark, sf_dir)
    by_frame = px.groupBy("site", "frame_id").agg(F.max((F.col("gt") == 1).cast("int")).alias("ood"), F.collect_set(F.when(F.col("gt") == 1, F.col("name"))).alias("c"))
    return by_frame.groupBy("site").agg(F.count("*").alias("frames"), F.sum("ood").alias("ood_frames"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("c")))), ",").alias("ood_classes"))


#: Frames with anomalies that the test split needs, and frames without any that each split needs.
LEAST_OOD, LEAST_PURE = 100, 30


@query("plan_split", f"""WITH {PIXELS}, per_frame AS (SELECT split, frame_id, max(CASE WHEN gt = 1 THEN 1 ELSE 0 END) AS ood, count(DISTINCT CASE WHEN gt = 1 AND tier = 'T1' THEN 1 END) AS t1, count(DISTINCT CASE WHEN gt = 1 AND tier = 'T2' THEN 1 END) AS t2, count(DISTINCT CASE WHEN gt = 1 AND tier = 'T3' THEN 1 END) AS t3 FROM pixels GROUP BY ALL),
n_cls AS (SELECT split, count(DISTINCT name) AS n_classes FROM pixels WHERE gt = 1 GROUP BY split),
s AS (SELECT split, count(*) AS frames, CAST(sum(ood) AS BIGINT) AS ood_frames, max(t1) AS t1, max(t2) AS t2, max(t3) AS t3 FROM per_frame GROUP BY split)
SELECT split, frames, round(100.0 * frames / sum(frames) OVER (), 6) AS pct, ood_frames, frames - ood_frames AS pure_frames, n_classes, t1 = 1 AS has_t1, t2 = 1 AS has_t2,
       t1 = 1 AND t2 = 1 AND t3 = 1 AS all_tiers, split <> 'test' OR ood_frames >= {LEAST_OOD} AS enough_ood, frames - ood_frames >= {LEAST_PURE} AS enough_pure FROM s JOIN n_cls USING (split)""")
def plan_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fixtures.pixels(spark, sf_dir)
    out = px.filter("gt = 1")
    by_frame = px.groupBy("split", "frame_id").agg(F.max((F.col("gt") == 1).cast("int")).alias("ood"))
    tiers = out.groupBy("split").agg(F.count_distinct("name").alias("n_classes"), F.bool_or(F.col("tier") == "T1").alias("has_t1"), F.bool_or(F.col("tier") == "T2").alias("has_t2"), F.bool_or(F.col("tier") == "T3").alias("has_t3"))
    s = by_frame.groupBy("split").agg(F.count("*").alias("frames"), F.sum("ood").alias("ood_frames"))
    total = s.agg(F.sum("frames").alias("total"))
    s = s.join(tiers, "split").crossJoin(F.broadcast(total))
    return s.select(
        "split", "frames", F.round(100.0 * F.col("frames") / F.col("total"), 6).alias("pct"), "ood_frames", (F.col("frames") - F.col("ood_frames")).alias("pure_frames"), "n_classes", "has_t1", "has_t2",
        (F.col("has_t1") & F.col("has_t2") & F.col("has_t3")).alias("all_tiers"), ((F.col("split") != "test") | (F.col("ood_frames") >= LEAST_OOD)).alias("enough_ood"),
        (F.col("frames") - F.col("ood_frames") >= LEAST_PURE).alias("enough_pure"),
    )


@query("split_disjoint", f"WITH {PIXELS}, d AS (SELECT DISTINCT split, site FROM pixels) SELECT count(*) AS n, count(DISTINCT site) AS sites, count(*) = count(DISTINCT site) AS disjoint FROM d")
def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.pixels(spark, sf_dir).select("split", "site").distinct().agg(F.count("*").alias("n"), F.count_distinct("site").alias("sites"), (F.count("*") == F.count_distinct("site")).alias("disjoint"))


@query("leakage_overlap", f"""WITH {_FRAMES}, l AS (SELECT CASE WHEN frame_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, array_to_string(string_split(scene, '_')[4:], '_') AS location FROM frames)
SELECT location FROM l WHERE split = 'train' INTERSECT SELECT location FROM l WHERE split = 'test'""")
def leakage_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = frames(spark, sf_dir).select((F.col("frame_id") % 2).alias("half"), splits.location(F.col("scene")).alias("location"))
    return at.filter("half = 0").select("location").intersect(at.filter("half = 1").select("location"))


_AUDIT = f"""{PIXELS}, by_class AS (SELECT split, site, frame_id, label_key, gt, count(*) AS n FROM pixels GROUP BY ALL),
audit AS (SELECT split, site, frame_id, CAST(sum(n) AS BIGINT) AS n, round(CAST(coalesce(sum(n) FILTER (gt = 255), 0) AS DOUBLE) / sum(n), 6) AS ignore_frac, round(CAST(coalesce(sum(n) FILTER (gt = 1), 0) AS DOUBLE) / sum(n), 6) AS ood_frac,
  coalesce(max(n) FILTER (gt = 1) >= 10, false) AS is_anomaly, coalesce(sum(n) FILTER (gt = 1), 0) = 0 AS is_pure FROM by_class GROUP BY split, site, frame_id)"""


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.audit_frames(fixtures.pixels(spark, sf_dir))


@query("audit_frames", f"WITH {_AUDIT} SELECT * FROM audit")
def audit_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir)


@query("audit_scenes", f"""WITH {_AUDIT}, c AS (SELECT site, label_key, count(*) AS f FROM by_class WHERE gt = 1 AND n >= 10 GROUP BY site, label_key)
SELECT a.site, a.frames, a.ood_frames, c.label_key, c.f AS class_frames FROM (SELECT site, count(*) AS frames, count(*) FILTER (is_anomaly) AS ood_frames FROM audit GROUP BY site) a JOIN c USING (site)""")
def audit_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_class = fixtures.pixels(spark, sf_dir).filter("gt = 1").groupBy("site", "frame_id", "label_key").count().filter("count >= 10").groupBy("site", "label_key").agg(F.count("*").alias("class_frames"))
    scenes = audited(spark, sf_dir).groupBy("site").agg(F.count("*").alias("frames"), F.count_if("is_anomaly").alias("ood_frames"))
    return scenes.join(per_class, "site").select("site", "frames", "ood_frames", "label_key", "class_frames")


@query("audit_tiers", f"WITH {PIXELS}, c AS (SELECT split, frame_id, tier, label_key, count(*) AS n FROM pixels WHERE gt = 1 GROUP BY ALL) SELECT split, tier, count(DISTINCT frame_id) AS frames FROM c WHERE n >= 10 GROUP BY split, tier")
def audit_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.pixels(spark, sf_dir).filter("gt = 1").groupBy("split", "frame_id", "tier", "label_key").count().filter("count >= 10")
    return c.groupBy("split", "tier").agg(F.count_distinct("frame_id").alias("frames"))


@query("audit_pct", f"""WITH {_AUDIT}, q AS (SELECT split, unnest([0.5, 0.75, 0.9, 0.95, 0.99]) AS q, unnest(quantile_cont(ood_frac, [0.5, 0.75, 0.9, 0.95, 0.99])) AS v FROM audit GROUP BY split)
SELECT split, CAST(round(q * 100) AS INTEGER) AS pct, round(v, 4) AS ood_frac FROM q""")
def audit_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [0.5, 0.75, 0.9, 0.95, 0.99]
    q = ranking.quantiles(audited(spark, sf_dir), ["split"], "ood_frac", at)
    return q.select("split", F.element_at(F.array(*(F.lit(round(100 * a)) for a in at)), F.col("k") + 1).alias("pct"), F.round("q", 4).alias("ood_frac"))


@query("ab_split", "SELECT s_suppkey AS frame_id, s_nationkey AS scene, CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) % 2 = 1 THEN 'A' ELSE 'B' END AS half FROM supplier")
def ab_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame_id"), F.col("s_nationkey").alias("scene"), "s_name")
    return splits.halves(f, "scene", "s_name").select("frame_id", "scene", "half")
