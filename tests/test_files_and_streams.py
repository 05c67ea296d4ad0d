"""Readers, sinks, plug-ins, streaming."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import registry
from quarry.operators import bootstrap, calibrate, ranking, vectors
from quarry.sources import archive, files
from quarry.streaming import deploy, fitting


def png(path, rows, colour=False):
    """A minimal image file."""
    raw = b"".join(b"\0" + (b"".join(bytes(p) for p in r) if colour else bytes(r)) for r in rows)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2 if colour else 0, 0, 0, 0)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_text_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,image/a.png,l/a.png\n\nbad\n2,other/b.png,l/b.png\n")
    assert [r.image_path for r in files.csv_manifest(spark, str(tmp_path / "m.csv")).collect()] == ["image/a.png"]
    (tmp_path / "data/image").mkdir(parents=True)
    for name in ("image/b.png", "image/a.png", "lab a.png", "lab b.png", "image/c.png", "other.png"):
        (tmp_path / "data" / name).write_bytes(b"x")
    (tmp_path / "n.csv").write_text("1, image/b.png ,lab b.png\n2,image/a.png,\tlab a.png\n3,image/c.png,lab c.png\n4,image/d.png,lab a.png\n5,  ,lab a.png\n6,other.png,lab a.png\n7,image/a.png,   \n8,image/a.png\n")
    for root in (str(tmp_path / "data"), f"file://{tmp_path}/data/"):
        found = [tuple(r) for r in files.csv_manifest(spark, str(tmp_path / "n.csv"), root).collect()]
        assert found == [(ts, f"{root.rstrip('/')}/image/{k}.png", f"{root.rstrip('/')}/lab {k}.png") for ts, k in (("2", "a"), ("1", "b"))]
    (tmp_path / "x.lst").write_text("a.jpg  a.png\nlonely\n\n b.jpg\tb.png x\n")
    assert [tuple(r) for r in files.list_file(spark, str(tmp_path / "x.lst")).collect()] == [("a.jpg", "a.png"), ("b.jpg", "b.png")]
    (tmp_path / "c.txt").write_text("0 void 0 0 0\n7 picnic table top 1 2 3\n1 2 3\n")
    assert [tuple(r) for r in files.colormap(spark, str(tmp_path / "c.txt")).collect()] == [(0, "void", 0, 0, 0), (7, "picnic table top", 1, 2, 3)]
    (tmp_path / "k.csv").write_text("class_name,label_key,hex\nrock,3,#fff\n")
    assert [tuple(r) for r in files.class_csv(spark, str(tmp_path / "k.csv")).collect()] == [("rock", 3)]
    (tmp_path / "s.json").write_text('{"train": ["a", "b"], "val": ["c"],\n "test": [], "_comment": "x"}')
    assert {tuple(r) for r in files.split_json(spark, str(tmp_path / "s.json")).collect()} == {("train", "a"), ("train", "b"), ("val", "c")}
    (tmp_path / "o.yaml").write_text("D:\n  classes_by_index:\n    0: {name: void, role: ignore}\n    2: {name: log, role: borderline, default_role: id_vegetation, catch_all: true}\nN:\n  rock: {role: id_terrain}\n")
    assert [tuple(r) for r in files.ontology_yaml(spark, str(tmp_path / "o.yaml"), "D").collect()] == [("D", 0, "void", "ignore", None, False), ("D", 2, "log", "borderline", "id_vegetation", True)]
    assert files.ontology_yaml(spark, str(tmp_path / "o.yaml"), "N", {"rock": 5}).first().label_key == 5
    with pytest.raises(ValueError):
        files.ontology_yaml(spark, str(tmp_path / "o.yaml"), "N", {"tree": 5})
    (tmp_path / "i.json").write_text('{"annotations": [{"image_id": 1, "bbox": [0, 0, 9, 9], "area": 5000, "iscrowd": 0},\n {"image_id": 2, "bbox": [], "area": 10, "iscrowd": 0}, {"image_id": 3, "bbox": [], "area": 9000, "iscrowd": 1}]}')
    assert [r.image_id for r in files.instances(spark, str(tmp_path / "i.json")).collect()] == [1]


def test_images_and_archives(spark, tmp_path):
    png(tmp_path / "lab" / "s1" / "f1_label.png", [[1, 2], [3, 200]])
    png(tmp_path / "img" / "s1" / "f1_rgb.png", [[1, 2], [3, 4]])
    png(tmp_path / "img" / "s1" / "f2_rgb.png", [[1, 2], [3, 4]])
    png(tmp_path / "rgb" / "c.png", [[(9, 8, 7), (1, 2, 3)]], colour=True)
    pairs = files.paired_frames(spark, str(tmp_path / "img"), str(tmp_path / "lab")).collect()
    assert [(r.scene, r.base) for r in pairs] == [("s1", "f1")]
    assert {(r.y, r.x, r.label_key) for r in files.label_rasters(spark, str(tmp_path / "lab")).collect()} == {(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 200)}
    assert {(r.x, r.label_key) for r in files.label_rasters(spark, str(tmp_path / "rgb")).collect()} == {(0, 9), (1, 1)}
    np.savez_compressed(tmp_path / "a.npz", keys=np.array([[[1, 2]], [[3, 4]]], np.uint8), rba=np.array([[[0.5, 1]], [[2, 3]]], np.float16))
    got = {tuple(r) for r in files.score_archive(spark, str(tmp_path / "a.npz"), "rba").collect()}
    assert got == {(0, 0, 0, 1, 0.5), (0, 0, 1, 2, 1.0), (1, 0, 0, 3, 2.0), (1, 0, 1, 4, 3.0)}


def test_archives_are_read_by_ranges_of_frames(spark, tmp_path):
    rng = np.random.default_rng(0)
    keys, scores = rng.integers(0, 255, (100, 6, 9)).astype(np.uint8), rng.random((100, 6, 9)).astype(np.float16)
    np.savez_compressed(tmp_path / "a.npz", keys=keys, rba=scores, other=scores[:50])
    got = archive.read_archive(spark, str(tmp_path / "a.npz"), "rba", task_bytes=10 * 6 * 9 * 2)
    assert got.rdd.getNumPartitions() == 10
    rows = got.select("frame_id", "y", "x", "label_key", "score", F.spark_partition_id().alias("p")).collect()
    assert len(rows) == keys.size and len({r.p for r in rows}) == 10
    assert all(r.label_key == keys[r.frame_id, r.y, r.x] and r.score == scores[r.frame_id, r.y, r.x] for r in rows)
    for method, what in (("other", "one shape"), ("none", "no array none")):
        with pytest.raises(Exception, match=what):
            archive.read_archive(spark, str(tmp_path / "a.npz"), method).count()
    np.savez(tmp_path / "plain.npz", keys=keys[:0], rba=scores[:0])
    assert archive.read_archive(spark, str(tmp_path / "plain.npz"), "rba").count() == 0
    with pytest.raises(Exception, match="no archive"):
        archive.read_archive(spark, str(tmp_path / "nothing.npz"), "rba").count()


def test_written_archives_are_read_back_and_failed_jobs_leave_nothing(spark, tmp_path):
    rng = np.random.default_rng(1)
    shapes = {7: (3, 4), 11: (3, 4), 900: (2, 2), 12: (3, 4), 13: (5, 1)}
    rows = [(f, y, x, int(rng.integers(0, 255)), float(np.float16(rng.random()))) for f, (h, w) in shapes.items() for y in range(h) for x in range(w)]
    df = spark.createDataFrame(rows, "frame_id long, y int, x int, label_key int, score float").repartition(5)
    out = tmp_path / "out"
    archive.write_archive(df, str(out), "rba", frames=2)
    assert {p.suffix for p in out.iterdir()} == {".npz"} and len(list(out.iterdir())) >= 4
    assert sorted(map(tuple, archive.read_archive(spark, str(out), "rba").collect())) == sorted(rows)
    archive.write_archive(df.filter("frame_id = 7"), str(out), "rba")  # replaces
    assert sorted(map(tuple, archive.read_archive(spark, str(out), "rba").collect())) == sorted(r for r in rows if r[0] == 7)
    archive.write_archive(df.filter("frame_id = 11"), str(out), "rba", mode="append")
    assert archive.read_archive(spark, str(out), "rba").select("frame_id").distinct().count() == 2
    before = sorted(p.name for p in out.iterdir())
    for bad, what in ((df.filter("NOT (frame_id = 13 AND y = 2)"), "whole raster"), (df.withColumn("label_key", F.col("label_key") + 300), "beyond a byte")):
        with pytest.raises(Exception, match=what):
            archive.write_archive(bad, str(out), "rba")
        assert sorted(p.name for p in out.iterdir()) == before, "a failed job leaves nothing and replaces nothing"


def test_named_datasets(spark, tmp_path):
    """Each name finds its pairs and its classes; the competitor track has the ontology file's own list."""
    assert set(files.DATASETS) >= {"goose", "goose_v2", "goose_v3", "wildscenes", "rellis", "rugd", "rellis_comp", "rugd_comp"}
    part = "  competitor_split: {ood: [vehicle]}\n  classes_by_index:\n    0: {name: void, role: ignore}\n    1: {name: vehicle, role: ood_tier1}\n    2: {name: pole, role: ood_tier2}\n    3: {name: dirt, role: id_terrain}\n"
    onto = tmp_path / "o.yaml"
    onto.write_text(f"RUGD:\n{part}RELLIS-3D:\n{part}WildScenes:\n{part}GOOSE:\n  dirt: {{role: id_terrain}}\n")
    for path in ("rugd/img/s1/a.png", "rugd/ann/s1/a.png", "goose/img/s1/b_windshield_vis.png", "goose/lab/s1/b_labelids.png", "rellis/img/0/cam/c.png"):
        png(tmp_path / path, [[1]])
    (tmp_path / "rellis/x/0/cam").mkdir(parents=True)
    (tmp_path / "rellis/x/0/cam/c.jpg").write_bytes(b"x")
    (tmp_path / "m.csv").write_text("1,image/a.png,l/a.png\n")
    at = lambda *p: str(tmp_path.joinpath(*p))
    for name, more, scene in (("rugd", {"images": at("rugd/img"), "labels": at("rugd/ann")}, "s1"), ("goose", {"images": at("goose/img"), "labels": at("goose/lab"), "keys": {"dirt": 4}}, "s1"), ("rellis", {"images": at("rellis/x"), "labels": at("rellis/img")}, "0")):
        frames, classes = files.dataset(name, spark, str(onto), **more)
        assert [r.scene for r in frames.collect()] == [scene] and classes.filter("gt = 0").count() == 1
    assert files.dataset("wildscenes", spark, str(onto), manifest_path=at("m.csv"))[0].count() == 1
    gt = {r["name"]: r.gt for r in files.dataset("rugd_comp", spark, str(onto), images=at("rugd/img"), labels=at("rugd/ann"))[1].collect()}
    assert gt == {"void": 255, "vehicle": 1, "pole": 0, "dirt": 0}


def test_large_label_image(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 255, (1500, 700))
    png(tmp_path / "l" / "a.png", a.tolist())
    got = files.label_rasters(spark, str(tmp_path / "l"))
    assert got.count() == a.size and got.agg(F.sum(F.col("label_key") * (F.col("y") + 1) * (F.col("x") + 2))).first()[0] == int((a * np.add.outer(np.zeros(1500, np.int64), np.arange(700) + 2) * (np.arange(1500) + 1)[:, None]).sum())


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("d", "test", "a", 1, 0.5), ("d", "val", "a", 2, 0.7)], "dataset string, split string, method string, frame_id int, score double")
    files.write_scores(rows, str(tmp_path / "s"))
    assert files.read_scores(spark, str(tmp_path / "s"), split="val").first().frame_id == 2
    files.write_document(spark.createDataFrame([("m", None)], "method string, ap double"), str(tmp_path / "doc"))
    assert files.read_document(spark, str(tmp_path / "doc")) == [{"method": "m", "ap": None}]
    docs = spark.createDataFrame([('{"pixel": {"FPR95": 0.5}}',), ('{"old": {"fpr": 0.25}}',), ("{}",)], "j string")
    assert [r[0] for r in docs.select(files.stored_metric(docs, "j", "$.pixel.FPR95", "$.old.fpr")).collect()] == [0.5, 0.25, None]
    assert files.existing(spark, [str(tmp_path / "s"), str(tmp_path / "nothing")]) == [str(tmp_path / "s")]
    files.register_dataset("one", lambda s: s.range(1))
    assert files.dataset("one", spark).count() == 1
    with pytest.raises(KeyError):
        files.dataset("two")


def test_plug_ins(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0), (2, 0, 1.0), (2, 1, 0.5)], "frame_id int, gt int, v double")
    registry.score("twice", lambda v: v * 2)
    registry.score("sql", "v + 1")
    assert [r.score for r in registry.apply_score(df, "twice", "v").collect()] == [4, 6, 2, 1]
    assert registry.apply_score(df, "sql").first().score == 3
    with pytest.raises(KeyError):
        registry.apply_score(df, "none")
    registry.metric("rank", lambda d, by, weight, **k: ranking.metrics(d.withColumnRenamed("v", "score"), by, weight=weight, **k))
    assert registry.bootstrap_metric(df, bootstrap.resamples(spark, df, 3), "rank").count() == 3


def test_stream_matches_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(src)
    for k in range(3):
        events.filter(F.col("event_id") % 3 == k).write.mode("append").parquet(str(tmp_path / "in"))
    thr = spark.createDataFrame([(0, 10.0), (1, 50.0)], "predclass int, tau double")
    rows = deploy.event_stream(spark, str(tmp_path / "in"), 100)
    q = deploy.start(deploy.counts(deploy.flag_stream(rows, thr, 90.0), "1 day", "3650 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    q.stop()
    live = deploy.flag_stream(rows, thr, 90.0).writeStream.format("memory").queryName("flags").trigger(availableNow=True).start()
    live.awaitTermination(120)
    batch = events.select("ts", F.floor(F.hour("ts") / 4.0).cast("int").alias("predclass"), F.col("value").alias("score"))
    want = deploy.flag_stream(batch, thr, 90.0).filter("flag").count()
    assert spark.table("flags").filter("flag").count() == want and spark.table("flags").count() == events.count()


def test_moments_of_a_stream_equal_those_of_a_batch_after_each_start(spark, tmp_path):
    rng = np.random.default_rng(2)
    at = lambda *p: str(tmp_path.joinpath(*p))
    schema = "id long, label string, embedding array<double>"
    spark.conf.set(*fitting.STATE_STORE)
    for start in range(3):
        for part in range(2):
            rows = [(k, rng.choice(["a", "b", None, "late"][: 3 + (start > 0)]), rng.normal(size=4).tolist()) for k in range(40)]
            spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(at("in"))
        vectors_in = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(at("in"))
        query = fitting.follow_moments(vectors_in, "label", at("sums"), at("cp"))  # goes on from its checkpoint
        query.awaitTermination(120)
        assert query.exception() is None
        means, cov = fitting.current_moments(spark, at("sums"), "label")
        want_means, want_cov = vectors.class_moments(spark.read.parquet(at("in")), "label")
        key = lambda r: tuple(map(str, r[:2]))
        for got, want in ((means, want_means.select("label", "i", "n", "mean")), (cov, want_cov)):
            a, b = sorted(map(tuple, got.collect()), key=key), sorted(map(tuple, want.collect()), key=key)
            assert [x[:2] for x in a] == [x[:2] for x in b] and [x[-1] for x in a] == pytest.approx([x[-1] for x in b])
        assert {r.n for r in means.filter("label = 'a'").collect()} == {spark.read.parquet(at("in")).filter("label = 'a'").count()}
    spark.conf.unset(fitting.STATE_STORE[0])


def test_thresholds_follow_a_stream_and_replays_flag_alike(spark, tmp_path):
    rng = np.random.default_rng(3)
    at = lambda *p: str(tmp_path.joinpath(*p))
    schema = "id long, predclass string, gt int, score double"
    every = []
    (tmp_path / "in").mkdir()
    live = fitting.LiveThresholds(at("live"), "predclass", lambda: F.col("gt") == 0, width=0.001, least=50)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at("in"))
    for start in range(2):
        for part in range(2):
            own = [(1000 * (2 * start + part) + k, rng.choice(["road", "grass", "rare"], p=[0.6, 0.38, 0.02]).item(), int(rng.random() < 0.1), float(rng.random())) for k in range(400)]
            every.append(own)
            spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(at("in"))
        query = live.follow(stream, at("cp"))
        query.awaitTermination(120)
        assert query.exception() is None
    flags = live.flags(spark)
    assert flags.count() == 1600 and {r.version for r in flags.select("version").distinct().collect()} == {-1, 0, 1, 2}
    assert not flags.filter("version = -1 AND flag").count()
    # thresholds of a version are the conformal quantiles of all batches up to it, within a bin's width
    seen = [r for own in every[:3] for r in own if r[2] == 0]
    want = {r.predclass: r for r in calibrate.conformal(spark.createDataFrame(seen, schema), ["predclass"]).collect()}
    whole = calibrate.conformal(spark.createDataFrame(seen, schema), []).first().tau
    taus = {r.predclass: r.tau for r in flags.filter("version = 2").select("predclass", "tau").distinct().collect()}
    for c, tau in taus.items():
        exact = want[c].tau if want[c].n >= 50 else whole
        assert exact <= tau <= exact + 0.001 + 1e-9, c
    assert want["rare"].n < 50 and taus["rare"] == pytest.approx(whole, abs=0.0011)
    # a batch that is run again, as after a lost driver, writes the same flags and the same version
    old = sorted(map(tuple, flags.collect()))
    hist = sorted(map(tuple, spark.read.parquet(at("live", "histograms", "version=3")).collect()))
    live(spark.createDataFrame(every[3], schema), 3)
    assert sorted(map(tuple, live.flags(spark).collect())) == old
    assert sorted(map(tuple, spark.read.parquet(at("live", "histograms", "version=3")).collect())) == hist
