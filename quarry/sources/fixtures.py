"""Scored-pixel views of the star-schema tables: the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions import roles
from quarry.functions.scores import mixed_order
from quarry.operators import ontology
from quarry.session import ship_code


#: Schemas of tables by path: Spark reads a file's footer in a job of its own to find one.
_SCHEMAS: dict[str, StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Tables aren't written to, so their schemas are looked up once."""
    ship_code(spark)
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel per lineitem: frame = supplier, site = its nation, class = brand, terrain = part type; with roles."""
    item = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.substring("p_brand", 7, 10).cast("int") - 1).alias("label_key"), F.col("p_type").alias("predclass"), F.col("p_size").alias("predclass_fine"))
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("site"))
    split = F.when(F.col("site") % 5 == 3, "val").when(F.col("site") % 5 == 4, "test").otherwise("train")
    rows = item.join(part, "l_partkey").join(supplier, "l_suppkey").select(
        F.col("l_suppkey").alias("frame_id"), "site", split.alias("split"), "label_key", "predclass", "predclass_fine", F.col("l_extendedprice").alias("score_a"), F.col("l_quantity").alias("score_b"), "l_orderkey", "l_linenumber", "l_partkey",
    )
    return ontology.lookup(rows, ontology.resolve(ontology.classes(spark)))


def order_hash(seed: int) -> F.Column:
    """The pixels' pseudo-random order."""
    return mixed_order((F.col("frame_id"), 7919), (F.col("l_orderkey"), 104729), (F.col("l_linenumber"), 1299709), (F.col("l_partkey"), 15485863), (F.lit(1000 + seed), 1))


def methods(pixels: DataFrame) -> DataFrame:
    """Long form: a row per pixel and method, with score."""
    both = F.array(F.struct(F.lit("score_a").alias("method"), F.col("score_a").alias("score")), F.struct(F.lit("score_b").alias("method"), F.col("score_b").alias("score")))
    return pixels.withColumn("m", F.explode(both)).select("*", "m.method", "m.score").drop("m")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of 20 by 64 from 20 consecutive vectors: frame_id, y, x, score, gt (a fixed rectangle is out of
    distribution, a corner is ignored)."""
    e = read(spark, sf_dir, "embeddings")
    rows = e.select(F.floor(F.col("vec_id") / 20).cast("long").alias("frame_id"), (F.col("vec_id") % 20).cast("int").alias("y"), F.posexplode("embedding").alias("x", "s"))
    y, x = F.col("y"), F.col("x")
    gt = F.when((y < 3) & (x < 5), roles.IGNORE).when((y >= 5) & (y < 12) & (x >= 20) & (x < 40), 1).otherwise(0)
    return rows.select("frame_id", "y", "x", F.col("s").cast("double").alias("score"), gt.alias("gt"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, embedding, logits (ten), is_query, gt (labels 8 and 9 are out of distribution)."""
    e = read(spark, sf_dir, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double") * 10)
    return e.select("vec_id", "label", "embedding", logits.alias("logits"), (F.col("vec_id") % 5 == 0).alias("is_query"), F.when(F.col("label") >= 8, 1).otherwise(0).alias("gt"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, predclass (language), score (length), gt: toxic 1, not toxic 0, unlabelled 255."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    return d.join(labels, "doc_id", "left").select("doc_id", F.col("lang").alias("predclass"), F.col("n_chars").cast("double").alias("score"), F.coalesce("toxic", F.lit(roles.IGNORE)).alias("gt"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame = user, terrain = four-hour block, score = value, gt = error."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("frame_id"), F.floor(F.hour("ts") / 4.0).cast("int").alias("predclass"), F.col("value").alias("score"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("gt"))
