"""Ontologies: from class rows to resolved roles, and lookups of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import roles

SCHEMA = "dataset string, label_key int, name string, role string, default_role string, catch_all boolean"

# The published 25-class map and its competitor split.
RUGD = [
    ("rugd", 0, "void", "ignore", None, False),
    ("rugd", 1, "dirt", "id_terrain", None, False),
    ("rugd", 2, "sand", "id_terrain", None, False),
    ("rugd", 3, "grass", "id_vegetation", None, False),
    ("rugd", 4, "tree", "id_vegetation", None, False),
    ("rugd", 5, "pole", "ood_tier2", None, False),
    ("rugd", 6, "water", "id_water", None, False),
    ("rugd", 7, "sky", "id_sky", None, False),
    ("rugd", 8, "vehicle", "ood_tier1", None, False),
    ("rugd", 9, "object", "ignore", None, True),
    ("rugd", 10, "asphalt", "id_terrain", None, False),
    ("rugd", 11, "gravel", "id_terrain", None, False),
    ("rugd", 12, "building", "ood_tier1", None, False),
    ("rugd", 13, "mulch", "id_terrain", None, False),
    ("rugd", 14, "rock-bed", "id_terrain", None, False),
    ("rugd", 15, "log", "borderline", "id_vegetation", False),
    ("rugd", 16, "bicycle", "ood_tier1", None, False),
    ("rugd", 17, "person", "ood_tier1", None, False),
    ("rugd", 18, "fence", "ood_tier2", None, False),
    ("rugd", 19, "bush", "id_vegetation", None, False),
    ("rugd", 20, "sign", "ood_tier2", None, False),
    ("rugd", 21, "rock", "id_terrain", None, False),
    ("rugd", 22, "bridge", "ood_tier1", None, False),
    ("rugd", 23, "concrete", "id_terrain", None, False),
    ("rugd", 24, "picnic-table", "ood_tier1", None, False),
]
RUGD_COMPETITOR = ["water", "vehicle", "object", "building", "bicycle", "person", "bridge", "picnic-table"]


def classes(spark: SparkSession, rows: list[tuple] = RUGD) -> DataFrame:
    """The classes as a relation that the optimizer knows, without a scan."""
    said = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).upper()  # noqa: E731  names are plain words
    names, kinds = zip(*(c.split() for c in SCHEMA.split(", ")), strict=True)
    values = ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)
    return spark.sql(f"SELECT {', '.join(f'CAST({n} AS {k}) AS {n}' for n, k in zip(names, kinds, strict=True))} FROM VALUES {values} AS t({', '.join(names)})")


def with_targets(resolved: DataFrame) -> DataFrame:
    """Adds tier, gt and train_id (rank of the key among in-distribution classes, from 0; else 255)."""
    gt = roles.ground_truth(F.col("eff_role"))
    inside = F.row_number().over(Window.partitionBy("dataset", "gt").orderBy("label_key")) - 1
    out = resolved.withColumn("tier", roles.tier(F.col("eff_role"))).withColumn("gt", gt)
    return out.withColumn("train_id", F.when(F.col("gt") == 0, inside).otherwise(roles.IGNORE))


def resolve(onto: DataFrame) -> DataFrame:
    return with_targets(onto.withColumn("eff_role", roles.effective(F.col("role"), F.col("default_role"))).withColumn("is_border", F.col("role") == "borderline"))


def resolve_competitor(onto: DataFrame, ood: list[str]) -> DataFrame:
    """The competitor's track: named classes are out of distribution, first of all rules; then what is ignored or a
    catch-all; what else is out of distribution counts as terrain."""
    plain = roles.effective(F.col("role"), F.col("default_role"))
    role = F.when(F.col("name").isin(ood), "ood_tier1").when((F.col("role") == "ignore") | F.col("catch_all"), "ignore").when(plain.startswith("ood"), "id_terrain").otherwise(plain)
    return with_targets(onto.withColumn("eff_role", role).withColumn("is_border", F.col("role") == "borderline"))


def validate(native: DataFrame, onto: DataFrame, key: str = "label_key") -> DataFrame:
    """(key, side) of keys that only one side has; empty if the ontology is complete."""
    a, b = native.select(key).distinct(), onto.select(key).distinct()
    missing = a.join(b, key, "left_anti").withColumn("side", F.lit("unmapped"))
    return missing.unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unused")))


def require_valid(native: DataFrame, onto: DataFrame, key: str = "label_key") -> None:
    bad = validate(native, onto, key).filter("side = 'unmapped'").limit(10).collect()
    if bad:
        raise ValueError(f"classes that the ontology lacks: {[r[0] for r in bad]}")


def lookup(pixels: DataFrame, resolved: DataFrame) -> DataFrame:
    """pixels with the resolved columns of their label_key; keys without an entry are ignored (255). An ontology has at
    most 256 keys, so it is broadcast."""
    own = F.broadcast(resolved.drop("dataset", "role", "default_role", "catch_all"))
    out = pixels.join(own, "label_key", "left")
    return out.withColumn("gt", F.coalesce("gt", F.lit(roles.IGNORE))).withColumn("train_id", F.coalesce("train_id", F.lit(roles.IGNORE)))


def colour_keys(pixels: DataFrame, colormap: DataFrame) -> DataFrame:
    """pixels (r, g, b) with label_key from a colormap (id, name, r, g, b); a colour that it lacks is key 0."""
    packed = lambda p: F.col(f"{p}r") * 65536 + F.col(f"{p}g") * 256 + F.col(f"{p}b")
    known = colormap.select(F.col("id").alias("__id"), packed("").alias("rgb"))
    return pixels.withColumn("rgb", packed("")).join(F.broadcast(known), "rgb", "left").withColumn("label_key", F.coalesce("__id", F.lit(0))).drop("__id", "rgb")
