"""Readers of the evaluation's file formats, and its sinks."""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import archive

ONTOLOGY = "dataset string, label_key int, name string, role string, default_role string, catch_all boolean"


def _listing(spark: SparkSession, root: str, pattern: str, scene_at: int) -> DataFrame:
    # length only: the file's content isn't read
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.element_at(F.split("path", "/"), scene_at).alias("scene"), F.element_at(F.split("path", "/"), -1).alias("file"))


def paired_frames(spark: SparkSession, images: str, labels: str, image_glob: str = "*.png", label_glob: str = "*.png", image_key: Callable[[Column], Column] | None = None, label_key: Callable[[Column], Column] | None = None, scene_at: int = -2) -> DataFrame:
    """scene, base, image_path, label_path of frames whose image and label both exist, by scene and file name.

    image_key and label_key turn a file's name into the name that both share; without them the name up to its last
    underscore or its ending. scene_at: which part of a path, counted from its end, is the scene.
    """
    plain = lambda c: F.regexp_replace(c, r"(_[A-Za-z0-9]+)?\.[A-Za-z0-9]+$", "")
    i = _listing(spark, images, image_glob, scene_at).select("scene", (image_key or plain)(F.col("file")).alias("base"), F.col("path").alias("image_path"))
    k = _listing(spark, labels, label_glob, scene_at).select("scene", (label_key or plain)(F.col("file")).alias("base"), F.col("path").alias("label_path"))
    return i.join(k, ["scene", "base"])


def csv_manifest(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """ts, image_path, label_path of a split list without a header, by image and label path; rows of fewer fields, blank paths or
    without an image are left out, and paths lose the white space around them. With root, the folder that paths begin from, only
    frames whose two files exist there and aren't empty stay, and paths are whole."""
    rows = spark.read.schema("ts string, image_path string, label_path string").option("mode", "PERMISSIVE").csv(path)
    rows = rows.filter(F.col("label_path").isNotNull() & F.col("image_path").contains("image"))
    rows = rows.select("ts", *(F.trim(F.regexp_replace(c, r"[\x09-\x0D]", " ")).alias(c) for c in ("image_path", "label_path"))).filter("image_path <> '' AND label_path <> ''")
    if root is not None:
        root = root.rstrip("/")
        base = re.sub("^[a-z0-9+.-]+:(//[^/]*)?", "", root)
        # what is behind the folder's name in a listed path; a listing has no contents
        there = _listing(spark, root, "*", -1).select(F.expr(f"substring(path, instr(path, {json.dumps(base + '/')}) + {len(base) + 1})").alias("file"))
        for c in ("image_path", "label_path"):
            rows = rows.join(there.select(F.col("file").alias(c)), c, "left_semi")
        rows = rows.select("ts", *(F.concat(F.lit(f"{root}/"), c).alias(c) for c in ("image_path", "label_path")))
    return rows.orderBy("image_path", "label_path")


def list_file(spark: SparkSession, path: str) -> DataFrame:
    """image_path, label_path of a list with white space between; shorter rows are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(parts) >= 2).select(parts[0].alias("image_path"), parts[1].alias("label_path"))


def class_csv(spark: SparkSession, path: str) -> DataFrame:
    """class_name, label_key of a class list with a header, by the header's names."""
    return spark.read.option("header", True).csv(path).select("class_name", F.col("label_key").cast("int").alias("label_key"))


def colormap(spark: SparkSession, path: str) -> DataFrame:
    """id, name, r, g, b of lines "id name... r g b"; names may hold spaces, lines of fewer than five fields are left
    out."""
    p = F.split(F.trim("value"), r"\s+")
    n = F.size(p)
    rows = spark.read.text(path).filter(n >= 5)
    return rows.select(p[0].cast("int").alias("id"), F.array_join(F.slice(p, 2, n - 4), " ").alias("name"), *(F.element_at(p, k).cast("int").alias(c) for k, c in ((-3, "r"), (-2, "g"), (-1, "b"))))


def ontology_yaml(spark: SparkSession, path: str, dataset: str, keys: dict[str, int] | None = None) -> DataFrame:
    """The classes of one dataset of an ontology file, by index or, with keys (name -> label_key), by name. A native
    class that the file lacks raises. The file is a setting of some hundred lines, read through Spark."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    own = yaml.safe_load(text)[dataset]
    if "classes_by_index" in own:
        rows = [(dataset, int(k), v["name"], v["role"], v.get("default_role"), bool(v.get("catch_all"))) for k, v in own["classes_by_index"].items()]
    else:
        named = own.get("classes", own)
        if missing := sorted(set(keys or {}) - set(named)):
            raise ValueError(f"classes that the ontology lacks: {missing}")
        rows = [(dataset, int(k), n, named[n]["role"], named[n].get("default_role"), bool(named[n].get("catch_all"))) for n, k in (keys or {}).items()]
    return spark.createDataFrame(rows, ONTOLOGY)


def split_json(spark: SparkSession, path: str) -> DataFrame:
    """split, site of a manifest {"train": [...], ...}; other entries are left out."""
    doc = F.from_json("value", "train array<string>, val array<string>, test array<string>")
    rows = spark.read.text(path, wholetext=True).select(doc.alias("d"))
    every = F.array(*(F.struct(F.lit(s).alias("split"), F.col(f"d.{s}").alias("sites")) for s in ("train", "val", "test")))
    return rows.select(F.explode(every).alias("e")).select("e.split", F.explode("e.sites").alias("site"))


def label_rasters(spark: SparkSession, root: str) -> DataFrame:
    """path, y, x, label_key of label images; of colour images the first (red) channel. Joins shuffle these rows: Spark takes
    them to be as small as the compressed files, and would broadcast them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                # the decoder's bytes are row by row, blue first
                channels = r["nChannels"]
                plane = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], channels)[:, :, 2 if channels >= 3 else 0]
                for top in range(0, len(plane), 1024):  # some rows of a large image at a time
                    some = plane[top : top + 1024]
                    y, x = np.indices(some.shape, np.int32)
                    yield pa.RecordBatch.from_pydict({"path": pa.DictionaryArray.from_arrays(np.zeros(some.size, np.int32), [r["origin"]]).cast(pa.string()), "y": (y + top).ravel().astype(np.int32), "x": x.ravel(), "label_key": some.ravel().astype(np.int32)})

    image = spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.*")
    return image.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "path string, y int, x int, label_key int").hint("merge")


def score_archive(spark: SparkSession, path: str, method: str) -> DataFrame:
    """frame_id, y, x, label_key, score from compressed array archives with arrays `keys` and `method` of [frame, y, x], by ranges
    of frames; arrays of different shapes raise."""
    return archive.read_archive(spark, path, method)


def instances(spark: SparkSession, path: str, least_area: float = 3000.0) -> DataFrame:
    """instance (its id), image_id, bbox of the annotations of an instance file, or of a folder of them, that are large enough and
    no crowd; images.crops cuts them out."""
    schema = "annotations array<struct<id: long, image_id: long, bbox: array<double>, area: double, iscrowd: int>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("annotations").alias("a"))
    return rows.filter((F.col("a.area") >= least_area) & (F.coalesce("a.iscrowd", F.lit(0)) == 0)).select(F.col("a.id").alias("instance"), "a.image_id", "a.bbox")


def stored_metric(docs: DataFrame, column: str, *paths: str) -> Column:
    """The first of several JSON paths that a stored result has, as a double; null if none."""
    return F.coalesce(*(F.get_json_object(docs[column], p).cast("double") for p in paths))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that exist, in any file system that Spark reaches: optional sources are left out."""
    out = []
    for p in paths:
        with contextlib.suppress(AnalysisException):
            spark.read.format("binaryFile").load(p)  # looks the path up, reads nothing
            out.append(p)
    return out


def write_scores(scores: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "split", "method")) -> None:
    """The score table, in folders by dataset, split and method, so that readers skip the others."""
    scores.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_scores(spark: SparkSession, path: str, **where: str) -> DataFrame:
    df = spark.read.parquet(path)
    for c, v in where.items():
        df = df.filter(F.col(c) == v)
    return df


def write_document(metrics: DataFrame, path: str) -> None:
    """A result document: one JSON object per row of metrics."""
    metrics.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> list[dict]:
    return [json.loads(r.value) for r in spark.read.text(path).collect()]


def competitor_yaml(spark: SparkSession, path: str, dataset: str) -> list[str]:
    """The names that an ontology file's competitor split of a dataset counts as out of distribution."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return list(yaml.safe_load(text)[dataset].get("competitor_split", {}).get("ood", []))


def _ends_with(tail: str) -> Callable[[Column], Column]:
    return lambda c: F.regexp_replace(c, tail.replace(".", r"\.") + "$", "")


def _dataset(section: str, competitor: bool = False, manifest: bool = False, **layout: object) -> Callable[..., tuple[DataFrame, DataFrame]]:
    """A factory (spark, ontology file, images=, labels= or manifest_path=, root=, keys=) -> (frames with image_path and label_path,
    resolved classes) of a dataset."""

    def make(spark: SparkSession, onto: str, images: str = "", labels: str = "", manifest_path: str = "", root: str | None = None, keys: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
        from quarry.operators import ontology

        classes = ontology_yaml(spark, onto, section, keys)
        resolved = ontology.resolve_competitor(classes, competitor_yaml(spark, onto, section)) if competitor else ontology.resolve(classes)
        return csv_manifest(spark, manifest_path, root) if manifest else paired_frames(spark, images, labels, **layout), resolved

    return make


_GOOSE = {"image_glob": "*_windshield_vis.png", "label_glob": "*_labelids.png", "image_key": _ends_with("_windshield_vis.png"), "label_key": _ends_with("_labelids.png")}
_RELLIS = {"image_glob": "*.jpg", "image_key": _ends_with(".jpg"), "label_key": _ends_with(".png"), "scene_at": -3}
_RUGD = {"image_key": _ends_with(".png"), "label_key": _ends_with(".png")}
#: Factories by dataset name; names, ontology sections and endings of files are fixed values. The versions of one dataset
#: differ in the split manifest that their frames are joined with.
DATASETS: dict[str, Callable[..., object]] = {
    "goose": _dataset("GOOSE", **_GOOSE),
    "goose_v2": _dataset("GOOSE", **_GOOSE),
    "goose_v3": _dataset("GOOSE", **_GOOSE),
    "wildscenes": _dataset("WildScenes", manifest=True),
    "rellis": _dataset("RELLIS-3D", **_RELLIS),
    "rugd": _dataset("RUGD", **_RUGD),
    "rellis_comp": _dataset("RELLIS-3D", competitor=True, **_RELLIS),
    "rugd_comp": _dataset("RUGD", competitor=True, **_RUGD),
}


def register_dataset(name: str, factory: Callable[..., object]) -> None:
    DATASETS[name] = factory


def dataset(name: str, *args: object, **more: object) -> object:
    if name not in DATASETS:
        raise KeyError(f"no dataset {name}; there are {sorted(DATASETS)}")
    return DATASETS[name](*args, **more)
