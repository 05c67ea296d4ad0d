"""Queries that go through files: what Spark derives from the given tables is written by a sink, and read back by a source.

Each run writes to a new folder of the shared one, while its plan is built, and its rows come from the files alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import registry
from quarry.operators import calibrate, ranking, vectors
from quarry.plans import pixel_metrics, vector_scores
from quarry.plans.base import FEATURES, GRID, METHODS, PIXELS, conformal_sql, metrics_sql, points_sql, query
from quarry.session import shared_folder
from quarry.sources import archive, files, fixtures, images
from quarry.streaming import deploy


def written(lines: DataFrame, name: str) -> str:
    """A folder of text files with the lines of a one-column table."""
    path = shared_folder(lines.sparkSession, name)
    lines.write.text(path)
    return path


_KEY = "CAST((frame_id * 7 + y * 3 + x) % 256 AS INTEGER)"


@query("sink_archive", f"WITH {GRID} SELECT frame_id, y, CAST(x AS INTEGER) AS x, {_KEY} AS label_key, CAST(CAST(score AS FLOAT) AS DOUBLE) AS score FROM gridded")
def sink_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters into score archives, eight frames each, and back by ranges of frames."""
    path = shared_folder(spark, "archive")
    archive.write_archive(fixtures.grid(spark, sf_dir).withColumn("label_key", F.expr(_KEY)), path, "score", frames=8, dtype="float32")
    return archive.read_archive(spark, path, "score").withColumn("score", F.col("score").cast("double"))


_FRAMES = f"""{GRID}, px AS (SELECT frame_id, 'scene_' || frame_id % 7 AS scene, 'f' || frame_id AS base, y, x, {_KEY} AS key FROM gridded)"""
_CHECKED = "count(*) AS n, CAST(sum(key * (y + 1) * (x + 2)) AS BIGINT) AS checksum, max(key) AS largest"


def label_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Folders of image and label files by scene; every fifth frame has an image only, odd frames have labels in colour."""
    root = shared_folder(spark, "frames")
    px = fixtures.grid(spark, sf_dir).withColumn("key", F.expr(_KEY)).withColumn("scene", F.concat(F.lit("scene_"), F.col("frame_id") % 7))
    named = lambda kind: F.concat("scene", F.lit("/f"), "frame_id", F.lit(f"_{kind}.png")).alias("file")
    shade = F.least(F.floor(F.abs("score") * 255), F.lit(255)).alias("shade")
    images.write_files(images.encoded(px.select(named("windshield_vis"), "y", "x", shade), "shade"), f"{root}/images")
    labelled = px.filter("frame_id % 5 <> 4")
    grey = labelled.filter("frame_id % 2 = 0").select(named("labelids"), "y", "x", "key")
    colour = labelled.filter("frame_id % 2 = 1").select(named("labelids"), "y", "x", "key", F.lit(7).alias("green"), (255 - F.col("key")).alias("blue"))
    images.write_files(images.encoded(grey, "key").unionByName(images.encoded(colour, "key", "green", "blue")), f"{root}/labels")
    return f"{root}/images", f"{root}/labels"


def _named(tail: str) -> dict:
    return {"image_glob": "*_windshield_vis.png", "label_glob": f"*{tail}", "image_key": lambda c: F.regexp_replace(c, r"_windshield_vis\.png$", ""), "label_key": lambda c: F.regexp_replace(c, rf"{tail}$", "")}


@query("source_frames", f"WITH {_FRAMES} SELECT scene, base, {_CHECKED} FROM px WHERE frame_id % 5 <> 4 GROUP BY scene, base")
def source_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose image and label files both exist, and what their label images hold."""
    pictures, labels = label_files(spark, sf_dir)
    pairs = files.paired_frames(spark, pictures, labels, **_named("_labelids.png"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    rasters = files.label_rasters(spark, labels).select(plain("path").alias("path"), "y", "x", F.col("label_key").alias("key"))
    held = rasters.groupBy("path").agg(*(F.expr(e) for e in ("count(*) AS n", "CAST(sum(key * (y + 1) * (x + 2)) AS BIGINT) AS checksum", "max(key) AS largest")))  # a row per file
    return pairs.select("scene", "base", plain("label_path").alias("path")).join(held, "path").drop("path")


_PATHS = "SELECT 'scene_' || o_custkey % 9 || '/image/' || o_orderkey || '.png' AS image_path, 'labels/' || o_orderkey || '.png' AS label_path FROM orders WHERE o_orderkey % 10 NOT IN (3, 7)"


def _order_lines(spark: SparkSession, sf_dir: str, between: str, broken: str) -> DataFrame:
    """A line an order: two paths; some lines are broken or blank."""
    key = F.col("o_orderkey")
    both = F.concat(F.lit("scene_"), F.col("o_custkey") % 9, F.lit("/image/"), key, F.lit(".png"), F.lit(between), F.lit("labels/"), key, F.lit(".png"))
    line = F.when(key % 10 == 3, broken).when(key % 10 == 7, "").otherwise(both)
    return fixtures.read(spark, sf_dir, "orders").select(line.alias("value"))


@query("source_list", _PATHS)
def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.list_file(spark, written(_order_lines(spark, sf_dir, " \t", "lonely.jpg"), "list"))


@query("source_manifest", f"SELECT '17' AS ts, * FROM ({_PATHS})")
def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _order_lines(spark, sf_dir, " ,\t", "other/1.png,labels/1.png")
    return files.csv_manifest(spark, written(lines.select(F.when(F.col("value") != "", F.concat(F.lit("17,"), "value")).otherwise("").alias("value")), "manifest"))


@query("source_classes", "SELECT CAST(p_partkey AS INTEGER) AS id, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS name, CAST(p_partkey % 256 AS INTEGER) AS r, CAST(p_size % 256 AS INTEGER) AS g, CAST(p_partkey * 7 % 256 AS INTEGER) AS b, p_type AS class_name FROM part WHERE p_partkey % 11 <> 5")
def source_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colour map, of which some lines are broken, and a list of classes, joined by their number."""
    part = fixtures.read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    line = F.when(key % 11 == 5, F.concat_ws(" ", key, F.lit("1 2"))).otherwise(F.concat_ws(" ", key, "p_name", key % 256, F.col("p_size") % 256, key * 7 % 256))
    colours = files.colormap(spark, written(part.select(line.alias("value")), "colours"))
    path = shared_folder(spark, "classes")
    part.select(F.col("p_type").alias("class_name"), key.alias("label_key"), "p_brand").write.option("header", True).csv(path)
    return colours.join(files.class_csv(spark, path), F.col("id") == F.col("label_key")).drop("label_key")


@query("source_splits", f"WITH {PIXELS} SELECT n.n_name AS site, CASE WHEN s_nationkey % 5 = 3 THEN 'val' WHEN s_nationkey % 5 = 4 THEN 'test' ELSE 'train' END AS split, count(*) AS frames FROM supplier JOIN nation n ON s_nationkey = n_nationkey GROUP BY ALL")
def source_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split manifest by site, and the frames that it puts into each."""
    site = F.col("n_nationkey") % 5
    sites = fixtures.read(spark, sf_dir, "nation").select(F.when(site == 3, "val").when(site == 4, "test").otherwise("train").alias("split"), "n_nationkey", F.col("n_name").alias("site"))
    lists = sites.agg(*(F.collect_list(F.when(F.col("split") == s, F.col("site"))).alias(s) for s in ("train", "val", "test")), F.lit("by site").alias("protocol"))
    manifest = files.split_json(spark, written(lists.select(F.to_json(F.struct("*")).alias("value")), "splits"))
    frames = fixtures.read(spark, sf_dir, "supplier").join(sites.select("n_nationkey", "site"), F.col("s_nationkey") == F.col("n_nationkey"))
    return frames.join(F.broadcast(manifest), "site").groupBy("site", "split").agg(F.count("*").alias("frames"))  # a row per site


_DUMPED = f"WITH {METHODS}, test AS (SELECT * FROM methods WHERE split = 'test' AND method = 'score_b'), {points_sql('test', '')}, m AS ({metrics_sql('')}) SELECT * FROM m"


@query("sink_scores", _DUMPED)
def sink_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores into folders by dataset, split and method; one folder is read."""
    path = shared_folder(spark, "scores")
    rows = fixtures.methods(fixtures.pixels(spark, sf_dir)).select(F.lit("stars").alias("dataset"), "split", "method", "frame_id", "gt", "score")
    files.write_scores(rows, path)
    return ranking.metrics(files.read_scores(spark, path, split="test", method="score_b"), [])


@query("sink_document", pixel_metrics._TEST_PTS + "SELECT method, ap, coalesce(auroc, 0e0) AS auroc, fpr95, n_pos FROM m")
def sink_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as JSON documents of two layouts, in one of two folders, looked up by path."""
    path = shared_folder(spark, "documents")
    m = pixel_metrics._metrics(spark, sf_dir)
    new = m.filter("method = 'score_a'").select("method", F.struct("ap", F.col("fpr95").alias("FPR95")).alias("pixel"), "auroc", "n_pos")
    old = m.filter("method <> 'score_a'").select("method", F.struct("ap", F.col("fpr95").alias("fpr")).alias("old"), "auroc", "n_pos")
    files.write_document(new, f"{path}/new")
    files.write_document(old, f"{path}/old")
    docs = spark.read.text(files.existing(spark, [f"{path}/new", f"{path}/old", f"{path}/never"]))
    at = lambda *p: files.stored_metric(docs, "value", *p)
    return docs.select(F.get_json_object("value", "$.method").alias("method"), at("$.pixel.ap", "$.old.ap").alias("ap"), at("$.auroc").alias("auroc"), at("$.pixel.FPR95", "$.old.fpr").alias("fpr95"), at("$.n_pos").cast("long").alias("n_pos"))


@query("sink_bank", f"WITH {vector_scores._SIMS} SELECT vec_id, round(1 - max(s), 6) AS score FROM sims GROUP BY vec_id")
def sink_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank is kept, and a later run's neighbours come from what was kept."""
    path = shared_folder(spark, "bank")
    vectors.write_bank(vector_scores.memory_bank(spark, sf_dir), path)
    found = vectors.top_cosines(vector_scores.query_vectors(spark, sf_dir), spark.read.parquet(path), 1, ["vec_id"])
    return found.select("vec_id", F.round(1 - F.element_at("sims", 1), 6).alias("score"))


_BOXES = f"""{GRID}, boxes AS (SELECT frame_id * 10 + k AS instance, frame_id, (frame_id * 3 + k * 11) % 60 - 4 AS x0, (frame_id + k * 5) % 18 - 3 AS y0, 6 + (frame_id + k) % 30 AS w, 6 + (frame_id * 5 + k) % 13 AS h, (frame_id + k) % 7 = 0 AS crowd FROM (SELECT DISTINCT frame_id FROM gridded), (VALUES (0), (1), (2)) t(k)),
crop AS (SELECT instance, b.frame_id, y - greatest(y0, 0) AS y, x - greatest(x0, 0) AS x, score FROM boxes b JOIN gridded g ON b.frame_id = g.frame_id AND x >= greatest(x0, 0) AND x < greatest(x0, 0) + w AND y >= greatest(y0, 0) AND y < greatest(y0, 0) + h WHERE NOT crowd AND w * h * 40 >= 3000)"""


@query("source_instances", f"WITH {_BOXES} SELECT instance, frame_id AS image_id, CAST(max(y) + 1 AS INTEGER) AS high, CAST(max(x) + 1 AS INTEGER) AS wide, count(*) AS n, round(sum(score * (y + 1)), 5) + 0e0 AS total FROM crop GROUP BY instance, frame_id HAVING max(y) >= 7 AND max(x) >= 7")
def source_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instance files, one a frame, and the crops of instances that are large enough and no crowd."""
    path = shared_folder(spark, "instances")
    g = fixtures.grid(spark, sf_dir)
    f, k = F.col("frame_id"), F.col("k")
    box = F.array(*(c.cast("double") for c in ((f * 3 + k * 11) % 60 - 4 + 0.25, (f + k * 5) % 18 - 3 + 0.0, 6 + (f + k) % 30, 6 + (f * 5 + k) % 13)))
    one = F.struct((f * 10 + k).alias("id"), f.alias("image_id"), box.alias("bbox"), ((6 + (f + k) % 30) * (6 + (f * 5 + k) % 13) * 40).cast("double").alias("area"), ((f + k) % 7 == 0).cast("int").alias("iscrowd"))
    rows = g.select("frame_id").distinct().select("frame_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).select("frame_id", one.alias("a"))
    whole = rows.groupBy("frame_id").agg(F.collect_list("a").alias("annotations"))  # three each
    whole.select("frame_id", F.to_json(F.struct("annotations")).alias("value")).write.partitionBy("frame_id").text(path)
    cut = images.crops(files.instances(spark, path), g.withColumnRenamed("frame_id", "image_id"))
    return cut.groupBy("instance", "image_id").agg((F.max("y") + 1).alias("high"), (F.max("x") + 1).alias("wide"), F.count("*").alias("n"), (F.round(F.sum(F.col("score") * (F.col("y") + 1)), 5) + 0.0).alias("total"))


@query("plugin_score", f"WITH {FEATURES} SELECT vec_id, round(list_sort(logits)[10] - list_sort(logits)[9], 6) AS margin, round(list_max(logits) - list_min(logits), 6) AS span FROM features")
def plugin_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores of a user: a function of columns, and SQL text."""
    registry.score("margin", lambda v: F.element_at(F.array_sort(v), -1) - F.element_at(F.array_sort(v), -2))
    registry.score("span", "array_max(logits) - array_min(logits)")
    rows = registry.apply_score(registry.apply_score(fixtures.features(spark, sf_dir), "margin", "logits", to="margin"), "span", to="span")
    return rows.select("vec_id", F.round("margin", 6).alias("margin"), F.round("span", 6).alias("span"))


_WEIGHTED = f"WITH {PIXELS}, w AS (SELECT px.frame_id, boot, (px.frame_id * 31 + boot * 17) % 4 AS w FROM (SELECT DISTINCT frame_id FROM pixels) px, (SELECT unnest(generate_series(0, 19)) AS boot) b)"


@query("plugin_metric", _WEIGHTED + " SELECT CAST(boot AS INTEGER) AS boot, round(CAST(sum(CASE WHEN gt = 1 THEN w ELSE 0 END) AS DOUBLE) / sum(CASE WHEN gt <> 255 THEN w ELSE 0 END), 6) AS prevalence FROM pixels JOIN w USING (frame_id) GROUP BY boot")
def plugin_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's metric, weighted, for every draw of whole frames."""

    def prevalence(df: DataFrame, by: list[str], weight: str) -> DataFrame:
        total = lambda where: F.sum(F.when(where, F.col(weight)).otherwise(0))
        return df.groupBy(*by).agg(F.round(total(F.col("gt") == 1) / total(F.col("gt") != 255), 6).alias("prevalence"))

    registry.metric("prevalence", prevalence)
    px = fixtures.pixels(spark, sf_dir).select("frame_id", "gt")
    draws = px.select("frame_id").distinct().withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(19))))
    return registry.bootstrap_metric(px, draws.withColumn("w", (F.col("frame_id") * 31 + F.col("boot") * 17) % 4), "prevalence")


@query("plugin_dataset", f"WITH {PIXELS} SELECT frame_id, site, count(*) AS n FROM pixels WHERE split = 'val' GROUP BY ALL")
def plugin_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's dataset, by name."""
    files.register_dataset("stars", lambda session, folder, split: fixtures.pixels(session, folder).filter(F.col("split") == split))
    return files.dataset("stars", spark, sf_dir, "val").groupBy("frame_id", "site").agg(F.count("*").alias("n"))


@query("knn_invariant", f"WITH {FEATURES} SELECT label, count(*) AS n, CAST(0 AS BIGINT) AS differ FROM features WHERE is_query GROUP BY label")
def knn_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over the one nearest neighbour, taken from fifteen, is the distance to the nearest: how many queries differ."""
    q, bank = vector_scores.query_vectors(spark, sf_dir), vector_scores.memory_bank(spark, sf_dir)
    top = lambda k: vectors.top_cosines(q, bank, k, ["vec_id", "label"], bank_bytes=vector_scores.BANK_BYTES)
    one = top(1).select("vec_id", "label", (1 - F.element_at("sims", 1)).alias("nearest"))
    many = vectors.knn_scores(top(15), [1, 5, 15]).select("vec_id", "cdnp_1")
    return one.join(many, "vec_id").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("nearest") - F.col("cdnp_1")) > 1e-9).alias("differ"))


_EVENTS = "e AS (SELECT event_id, ts, value AS score, CAST(hour(ts) // 4 AS INTEGER) AS predclass, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS gt FROM events), cal AS (SELECT * FROM e WHERE gt = 0)"


@query("stream_flags", f"WITH {_EVENTS}, {conformal_sql('cal', 'predclass', 'thr')}, {conformal_sql('cal', '', 'every')} SELECT CAST(date_trunc('day', ts) AS DATE) AS day, e.predclass, count(*) AS n, count(*) FILTER (score > coalesce(thr.tau, every.tau)) AS flagged FROM e LEFT JOIN thr USING (predclass), every GROUP BY ALL")
def stream_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deployment rule on a stream of all events, whose flagged rows go to a file sink, counted by day and class."""
    calm = fixtures.events(spark, sf_dir).filter("gt = 0")
    thresholds, every = calibrate.conformal(calm, ["predclass"]), calibrate.conformal(calm, []).first().tau
    path = shared_folder(spark, "flags")
    flagged = deploy.flag_stream(deploy.event_stream(spark, f"{sf_dir}/events.parquet*"), thresholds, every)
    run = deploy.start(flagged, f"{path}/rows", f"{path}/checkpoint")
    run.awaitTermination()
    return spark.read.parquet(f"{path}/rows").groupBy(F.to_date("ts").alias("day"), "predclass").agg(F.count("*").alias("n"), F.count_if("flag").alias("flagged"))
