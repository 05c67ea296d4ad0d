"""Image sink, crops, shared folders, and the queries that go through files against their SQL."""

from __future__ import annotations

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import session
from quarry.operators import components
from quarry.plans import base, storage
from quarry.sources import files, images

SF = "/root/testdata/sf0.001"
THROUGH_FILES = [n for n, f in base.QUERIES.items() if f.__module__ == storage.__name__]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", THROUGH_FILES)
def test_rows_that_went_through_files_equal_the_sql(spark, duck, name):
    got = base.QUERIES[name](spark, SF)
    want = duck.execute(base.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(tuple(map(str, r)) for r in got.select(*names).collect())
    assert rows and rows == sorted(tuple(map(str, r)) for r in want.fetchall())


def test_written_images_are_decoded_to_the_same_values(spark, tmp_path):
    rng = np.random.default_rng(4)
    shapes = {"a/one.png": (1, 1), "a/wide.png": (2, 300), "b/c/high.png": (257, 3)}
    planes = {f: rng.integers(0, 256, (*s, 3)) for f, s in shapes.items()}
    rows = [(f, y, x, *map(int, p[y, x])) for f, p in planes.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    df = spark.createDataFrame(rows, "file string, y int, x int, r int, g int, b int").repartition(5)
    for root, values in (("grey", ["g"]), ("colour", ["r", "g", "b"])):
        for _ in range(2):  # a second run replaces the files
            assert images.write_files(images.encoded(df, *values), str(tmp_path / root)) == 3
        left = sorted(str(p.relative_to(tmp_path / root)) for p in (tmp_path / root).rglob("*") if p.is_file() and p.suffix != ".crc")
        assert left == sorted(shapes), "nothing else is left behind"
        got = {(r.path.split(f"/{root}/")[1], r.y, r.x): r.label_key for r in files.label_rasters(spark, str(tmp_path / root)).collect()}
        assert got == {(f, y, x): (g if root == "grey" else r) for f, y, x, r, g, _ in rows}


def test_pixels_of_images_are_not_broadcast(spark, tmp_path):
    """However small the files are; a frame's pixels are added up where its file is read."""
    flat = spark.range(64 * 64).selectExpr("'a.png' AS file", "int(id div 64) AS y", "int(id % 64) AS x", "7 AS v")
    images.write_files(images.encoded(flat, "v"), str(tmp_path / "flat"))
    px = files.label_rasters(spark, str(tmp_path / "flat"))
    for rows in (px, px.filter("y > 3").select("path", "label_key"), px.groupBy("path").agg(F.count("*").alias("n"))):
        joined = spark.createDataFrame([("a",)], "path string").join(rows, "path")
        assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert px.count() == 64 * 64
    plan = base.QUERIES["source_frames"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    join = next(x for x in plan.split("\n") if "SortMergeJoin [path" in x)
    below = plan.split(join)[1]
    assert "partial_count" in below and below.index("partial_count") < below.index("MapInArrow")


def test_images_that_are_no_raster_raise(spark):
    df = spark.createDataFrame([("f", 0, 0, 1), ("f", 0, 1, 2)], "file string, y int, x int, v int")
    bad = {"whole raster": [df.filter("x = 1"), df.unionByName(df), df.withColumn("y", F.col("y") - 1)], "beyond a byte": [df.withColumn("v", F.col("v") + 254), df.withColumn("v", F.col("v") - 2), df.withColumn("v", F.lit(None).cast("int"))]}
    for what, frames in bad.items():
        for rows in frames:
            with pytest.raises(Exception, match=what):
                images.encoded(rows, "v").collect()
    with pytest.raises(ValueError):
        images.encoded(df, "v", "v")
    assert images.encoded(df.filter("false"), "v").count() == 0


def test_crops_against_slices(spark):
    rng = np.random.default_rng(5)
    pictures = {k: rng.integers(0, 1000, s) for k, s in ((1, (12, 30)), (2, (40, 9)))}
    boxes = [(n, int(rng.integers(1, 4)), [float(rng.uniform(-6, 35)), float(rng.uniform(-6, 35)), float(rng.uniform(-1, 25)), float(rng.uniform(-1, 25))]) for n in range(60)]
    px = spark.createDataFrame([(k, y, x, int(p[y, x])) for k, p in pictures.items() for y in range(p.shape[0]) for x in range(p.shape[1])], "image_id long, y int, x int, v int")
    for least in (1, 8):
        got: dict = {}
        for r in images.crops(spark.createDataFrame(boxes, "instance long, image_id long, bbox array<double>"), px, least).collect():
            got.setdefault(r.instance, {})[r.y, r.x] = r.v
        want = {}
        for n, k, (x, y, w, h) in boxes:
            if k in pictures:
                x, y, w, h = max(0, int(x)), max(0, int(y)), max(1, int(w)), max(1, int(h))
                cut = pictures[k][y : y + h, x : x + w]
                if cut.size and min(cut.shape) >= least:
                    want[n] = {(a, b): int(cut[a, b]) for a in range(cut.shape[0]) for b in range(cut.shape[1])}
        assert got == want


def test_shared_folders(spark, monkeypatch):
    a, b = session.shared_folder(spark, "x"), session.shared_folder(spark, "x")
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))

    class Conf:
        def __init__(self, master):
            self.known = {"spark.master": master}

        def get(self, key, default=None):
            return self.known.get(key, default)

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    assert session.shared_folder(Session("local[2]"), "x").startswith("file:///")
    for master in ("spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.shared_folder(Session(master), "x")


def test_overlaps_against_arrays(spark):
    """Pairs of components on random masks, also frames without ground truth, without predictions, or with small ones only."""
    rng = np.random.default_rng(6)
    truth = {f: rng.random((9, 11)) < p for f, p in enumerate((0.6, 0.5, 0.0, 0.7, 0.2))}
    found = {(f, k): rng.random((9, 11)) < p for f in truth for k, p in ((0, 0.6), (1, 0.45 if f != 3 else 0.0))}

    def comps(mask):
        out, seen = [], set()
        for start in zip(*map(lambda v: v.tolist(), np.nonzero(mask)), strict=True):
            if start in seen:
                continue
            own, todo = set(), [start]
            while todo:
                y, x = todo.pop()
                if (y, x) in own or not (0 <= y < mask.shape[0] and 0 <= x < mask.shape[1]) or not mask[y, x]:
                    continue
                own.add((y, x))
                todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
            seen |= own
            out.append(own)
        return out

    least = 4
    rows = lambda m: [(*k, int(y), int(x)) for k, v in m.items() for y, x in zip(*np.nonzero(v), strict=True)]
    gt = components.label(spark.createDataFrame(rows({(f,): v for f, v in truth.items()}), "frame_id int, y int, x int"), ["frame_id"])
    pred = components.label(spark.createDataFrame(rows(found), "frame_id int, k int, y int, x int"), ["frame_id", "k"])
    siou, ppv = components.overlap(gt, pred, ["frame_id", "k"], "frame_id", least)
    want_s, want_p = [], []
    for (f, k), mask in found.items():
        large = [c for c in comps(mask) if len(c) >= least]
        for g in comps(truth[f]):
            if len(g) >= least:
                touching = [c for c in large if c & g]
                union = g.union(*touching)
                want_s.append((f, k, len(g), round(len(g.intersection(set().union(*touching))) / len(union), 9)))
        everything = set().union(*comps(truth[f]))
        want_p += [(f, k, len(c), round(len(c & everything) / len(c), 9)) for c in large]
    assert sorted((r.frame_id, r.k, r.gn, round(r.siou, 9)) for r in siou.collect()) == sorted(want_s)
    assert sorted((r.frame_id, r.k, r.pn, round(r.ppv, 9)) for r in ppv.collect()) == sorted(want_p)
