"""Ranking, calibration, bootstrap and component operators against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import registry
from quarry.functions import scores
from quarry.operators import bootstrap, calibrate, components, ontology, ranking, splits, vectors
from quarry.operators.evaluate import evaluate
from quarry.plans.base import QUERIES


def rows_of(seed=1, n=800, distinct=False):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.choice([0, 0, 1, 255]), (k + rng.random()) if distinct else float(rng.randint(0, 40))) for k in rng.sample(range(n), n)]


def plain_metrics(own):
    own = [(g, s) for g, s in own if g != 255]
    p, n = sum(g for g, _ in own), sum(1 - g for g, _ in own)
    tp = fp = 0
    ap = auroc = 0.0
    fpr95 = None
    for s in sorted({s for _, s in own}, reverse=True):
        dp, dn = sum(1 for g, x in own if x == s and g), sum(1 for g, x in own if x == s and not g)
        auroc += dn * (tp + dp / 2)
        tp, fp = tp + dp, fp + dn
        ap += dp / p * tp / (tp + fp)
        if fpr95 is None and tp / p >= 0.95:
            fpr95 = fp / n
    return ap, auroc / p / n, fpr95


@pytest.mark.parametrize(("buckets", "least"), [(1, 1), (4, 3), (64, 1), (ranking.BUCKETS, ranking.LEAST)])
@pytest.mark.parametrize("distinct", [False, True])
def test_ranking(spark, buckets, least, distinct):
    rows = rows_of(buckets, distinct=distinct)
    df = spark.createDataFrame(rows, "m string, gt int, score double")
    for r in ranking.metrics(df, ["m"], digits=None, buckets=buckets, least=least).collect():
        want = plain_metrics([(g, s) for m, g, s in rows if m == r.m])
        assert (r.ap, r.auroc, r.fpr95) == pytest.approx(want)


def test_quantiles(spark):
    rng = random.Random(6)
    rows = [(g, rng.choice([rng.random() * 10**k for k in range(6)] + [3.0, 3.0])) for g, n in (("a", 1), ("b", 2), ("c", 700)) for _ in range(n)]
    df = spark.createDataFrame([*rows, ("c", None)], "g string, v double")
    at = [0.0, 0.05, 1 / 3, 0.5, 0.95, 1.0]
    own = {g: np.array([v for h, v in rows if h == g]) for g in "abc"}
    got = {(r.g, r.k): r.q for r in ranking.quantiles(df, ["g"], "v", at).collect()}
    assert len(got) == 18 and all(q == pytest.approx(np.quantile(own[g], at[k])) for (g, k), q in got.items())
    even = {(r.g, r.k): r.q for r in ranking.quantiles(df, ["g"], "v", 40).collect()}
    assert len(even) == 3 * 41 and all(q == pytest.approx(np.quantile(own[g], k / 40)) for (g, k), q in even.items())
    assert [r.q for r in ranking.quantiles(df, [], "v", [0.5]).collect()] == pytest.approx([np.quantile(np.concatenate(list(own.values())), 0.5)])


def test_parts_hold_as_many_values_whatever_the_scale(spark):
    """With an outlier, infinite scores and log-normal ones, no part holds over twice its share of the distinct values."""
    n = 200_000
    uniform = spark.range(n).select(F.lit("outlier").alias("g"), F.when(F.col("id") == 7, 1e9).otherwise(F.col("id") * 0.618033988749895 % 1).alias("v"))
    infinite = spark.range(n).select(F.lit("inf").alias("g"), F.when(F.col("id") == 7, float("inf")).when(F.col("id") == 8, float("-inf")).when(F.col("id") == 9, float("nan")).otherwise(F.col("id") * 0.618033988749895 % 1))
    skewed = spark.range(n).select(F.lit("log").alias("g"), F.exp(3 * F.randn(5)))
    far = spark.range(n).select(F.lit("far").alias("g"), F.when(F.col("id") == 7, -1e9).when(F.col("id") == 8, 0.0).otherwise(1e6 + F.col("id") * 0.618033988749895 % 1))
    few = spark.range(10).select(F.lit("few").alias("g"), F.col("id").cast("double"))
    counted = uniform.union(infinite).union(skewed).union(far).union(few).groupBy("g", "v").agg(F.lit(1).alias("m"))
    sizes = {}
    for r in ranking.in_parts(counted, ["g"], "v", ["m"], least=24).groupBy("g", "__octave", "__part").count().collect():
        sizes.setdefault(r.g, []).append(r["count"])
    assert sum(map(sum, sizes.values())) == counted.count()
    assert all(max(sizes[g]) <= 2 * n / 4096 for g in ("outlier", "inf", "log", "far")), {g: max(x) for g, x in sizes.items()}
    usual = ranking.in_parts(counted, ["g"], "v", ["m"]).groupBy("g", "__octave", "__part").count()
    assert usual.agg(F.max("count")).first()[0] <= 2 * ranking.LEAST
    ranks = ranking.running(counted, ["g"], "v", ["m"]).filter("g <> 'few'")
    assert ranks.groupBy("g").agg(F.count_distinct("m_upto").alias("d"), F.max("m_upto").alias("hi"), F.max("m_all").alias("all"), F.count("*").alias("n")).filter("d <> n OR hi <> n OR all <> n").isEmpty()
    wrong = ranks.withColumn("down", F.lead("v").over(__import__("pyspark").sql.Window.partitionBy("g").orderBy("m_upto"))).filter("down <= v")
    assert wrong.isEmpty()


def test_no_task_sorts_all_values(spark):
    """The only single partition is that of the parts' totals; nothing runs while plans are built."""
    df = spark.range(1000).selectExpr("double(id) AS score", "int(id % 2) AS gt")
    plan = calibrate.conformal(df, [])._jdf.queryExecution().executedPlan().toString()
    alone = [x for x in plan.split("\n") if "Exchange SinglePartition" in x]
    assert len(alone) <= 4
    sc = spark.sparkContext
    sc.setJobGroup("planning", "planning")
    ranking.metrics(df, []), calibrate.conformal(df, []), bootstrap.edges(df, [], "score", 10)
    sc.setJobGroup("other", "other")
    assert not sc.statusTracker().getJobIdsForGroup("planning")


def test_one_class_is_null(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 0, 0.5)], "m string, gt int, score double")
    got = {r.m: r for r in ranking.metrics(df, ["m"]).collect()}
    assert got["a"].ap is None and got["a"].n_pos == 1 and got["b"].auroc is None and got["b"].n_pos == 0


def test_synthetic_frames(spark):
    """Separable scores are perfect, random ones are at chance; components follow."""
    rng = np.random.default_rng(0)
    rows = []
    for f in range(3):
        for y in range(32):
            for x in range(32):
                gt = 255 if y < 3 and x < 3 else int(10 <= y < 20 and 10 <= x < 20)
                rows.append((f, y, x, gt, float((10 if gt == 1 else -10) + rng.normal(0, 0.01)), float(rng.normal())))
    g = spark.createDataFrame(rows, "frame_id int, y int, x int, gt int, good double, noise double").cache()
    m = ranking.metrics(g, [], "good").first()
    assert m.ap == pytest.approx(1) and m.fpr95 == 0
    assert abs(ranking.metrics(g, [], "noise").first().auroc - 0.5) < 0.1
    gt, pred = components.label(g.filter("gt = 1"), ["frame_id"]), components.label(g.filter("gt <> 255 AND good >= 0"), ["frame_id"])
    assert components.f1(*components.overlap(gt, pred, ["frame_id"], "frame_id"), []).first().f1 == pytest.approx(1)


def test_evaluation_from_end_to_end(spark):
    """One call gives what the pieces give, on the first frames, at a stride."""
    rng = np.random.default_rng(3)
    rows = [(f, y, x, int(4 <= y < 14 and 4 <= x < 14), float(rng.normal() + 2 * (4 <= y < 14 and 4 <= x < 14))) for f in range(4) for y in range(20) for x in range(20)]
    g = spark.createDataFrame(rows, "frame_id int, y int, x int, gt int, v double").cache()
    registry.score("as_is", "v")
    r = evaluate(g, "as_is", limit=3, downsample=1, do_component=True, n_boot=40).first()
    own = [(q, s) for f, _, _, q, s in rows if f < 3]
    assert r.n_frames == 3 and (r.ap, r.auroc, r.fpr95) == pytest.approx(plain_metrics(own), abs=1e-6)
    assert r.thr == pytest.approx(np.median([s for _, s in own]) + np.std([s for _, s in own]), abs=1e-5)
    assert 0 < r.component_f1 <= 1 and r.ap_lo < r.ap_mean < r.ap_hi and abs(r.ap_mean - r.ap) < 0.1
    assert evaluate(g, "as_is", downsample=4).first().n_pos == 4 * sum(4 <= k < 14 for k in range(0, 20, 4)) ** 2


def test_components_match_flood_fill(spark):
    rng = random.Random(4)
    cells = {(f, y, x) for f in range(4) for y in range(14) for x in range(17) if rng.random() < 0.55}
    got = components.label(spark.createDataFrame([(f, y - 3, x + 2) for f, y, x in cells], "f int, y int, x int"), ["f"]).collect()
    comp = {(r.f, r.y + 3, r.x - 2): r.comp for r in got}
    seen = {}
    for c in sorted(cells):
        todo = [c]
        while todo:
            f, y, x = p = todo.pop()
            if p in cells and p not in seen:
                seen[p] = c
                todo += [(f, y + 1, x), (f, y - 1, x), (f, y, x + 1), (f, y, x - 1)]
    assert len({(p[0], comp[p]) for p in cells}) == len(set(seen.values()))
    assert all(comp[p] == (seen[p][1] - 3) * 1_000_000 + seen[p][2] + 2 for p in cells)


@pytest.mark.parametrize("tile", [3, 5, 512])
def test_components_across_tiles_are_those_of_whole_frames(spark, tile):
    """Rasters cut anywhere: spirals that cross many seams, random ones, and frames in one tile. No task gets a frame."""
    rng = np.random.default_rng(tile)
    spiral = np.zeros((23, 23), int)
    y, x, dy, dx = 0, 0, 0, 1
    for _ in range(23 * 12):
        spiral[y, x] = 1
        ahead = [(y + dy * k, x + dx * k) for k in (1, 2)]
        if not all(0 <= a < 23 and 0 <= b < 23 for a, b in ahead[:1]) or (0 <= ahead[1][0] < 23 and 0 <= ahead[1][1] < 23 and spiral[ahead[1]]):
            dy, dx = dx, -dy
        y, x = y + dy, x + dx
        if not (0 <= y < 23 and 0 <= x < 23) or spiral[y, x]:
            break
    frames = {"spiral": spiral, "dense": rng.random((31, 17)) < 0.62, "thin": rng.random((9, 40)) < 0.5, "small": np.ones((2, 2)), "full": np.ones((11, 13)), None: rng.random((7, 7)) < 0.6}
    cells = [(f, k, int(y) - 4, int(x) - 6) for f, m in frames.items() for k in (0, 1) for y, x in zip(*np.nonzero(m), strict=True) if k == 0 or (y + x) % 7]
    rows = spark.createDataFrame(cells, "f string, k int, y int, x int")
    want = {(r.f, r.k, r.y, r.x): r.comp for r in components.label(rows, ["f", "k"], 10_000_000).collect()}
    got = {(r.f, r.k, r.y, r.x): r.comp for r in components.label(rows, ["f", "k"], tile).collect()}
    # cut frames begin below zero, so tiles of any size have a seam there; flood fill tells the truth
    todo, comps = set(want), {}
    while todo:
        first = min(todo, key=lambda c: (str(c[0]), c[1], c[2], c[3]))
        reach, stack = set(), [first]
        while stack:
            f, k, y, x = p = stack.pop()
            if p in todo:
                todo.discard(p)
                reach.add(p)
                stack += [(f, k, y + 1, x), (f, k, y - 1, x), (f, k, y, x + 1), (f, k, y, x - 1)]
        comps |= {p: first[2] * components.NAME + first[3] for p in reach}
    assert got == comps and want == comps
    held = components.tile_labels(rows, ["f", "k"], tile).groupBy("f", "k", F.floor(F.col("y") / tile), F.floor(F.col("x") / tile)).count()
    assert held.agg(F.max("count")).first()[0] <= tile * tile
    at_zero = rows.select("f", "k", (F.col("y") + 4).alias("y"), (F.col("x") + 6).alias("x"))
    a, b = components.label(at_zero, ["f", "k"], 512, side=40), components.label(at_zero, ["f", "k"], 512)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_objects_by_levels_are_those_of_masks(spark, monkeypatch):
    """Measured in tiles, across tiles, some levels at a time, and from masks of pixels."""
    rng = np.random.default_rng(9)
    rows = []
    for m, f in ((m, f) for m in "ab" for f in (0, 1, None, 3)):
        truth = np.random.default_rng(f or 7).random((14, 19)) < (0.0 if f == 3 else 0.6)
        score = rng.random((14, 19)) * (0.1 if f == 1 else 1) - (m == "b")
        rows += [(m, f, y, x, bool(truth[y, x]), float(score[y, x])) for y in range(14) for x in range(19) if (y, x) != (3, 3)]
    px = spark.createDataFrame(rows, "m string, f int, y int, x int, truth boolean, score double")
    thr = spark.createDataFrame([("a", 0, 0.3), ("a", 1, 0.55), ("a", 2, 0.9), ("a", 3, 7.0), ("b", 0, -0.6), ("b", 1, -0.06)], "m string, k int, thr double")
    levelled = components.levels(px, thr, ["m"]).cache()
    pred = components.label(px.join(thr, "m").filter("score >= thr"), ["m", "f", "k"])
    texts = lambda df: sorted(map(str, df.collect()))
    want = texts(pred.groupBy("m", "f", "k", "comp").agg(F.count("*").alias("n")))
    for tile, at_once in ((512, 1 << 20), (512, 300), (4, 1 << 20)):
        monkeypatch.setattr(components, "AT_ONCE", at_once)
        assert texts(components.sizes(levelled, ["m", "f"], tile, 19).select("m", "f", "k", "comp", "n")) == want
    gt = components.label(px.filter("truth AND m = 'a' AND f IS NOT NULL"), ["f"])
    siou, ppv = components.overlap(gt, pred.filter("f IS NOT NULL"), ["m", "f", "k"], "f", 4)
    found = [components.objects(levelled.filter("f IS NOT NULL"), ["m", "f"], "f", 4, *size).cache() for size in ((512, 19), (5, None))]
    own = ["m", "f", "k", "comp", "n", F.round("share", 9).alias("share")]
    for o in found:
        assert texts(components.of_truth(o, ["m", "k"]).select(*own)) == texts(siou.select("m", "f", "k", "gcomp", "gn", F.round("siou", 9)).toDF("m", "f", "k", "comp", "n", "share"))
        assert texts(o.filter("NOT truth AND comp IS NOT NULL").select(*own)) == texts(ppv.select("m", "f", "k", "pcomp", "pn", F.round("ppv", 9)).toDF("m", "f", "k", "comp", "n", "share"))
        got = components.f1_of_objects(o, ["m", "k"])
        assert texts(got.select("m", "k", "f1")) == texts(components.f1(siou, ppv, ["m", "k"]).select("m", "k", "f1")) and got.count() == 5


def test_components_are_labelled_once_for_all_thresholds(spark):
    """No query labels or joins a pixel once a threshold, or labels tiles once a seam."""
    for name, most in (("components", 1), ("components_tiled", 3), ("component_f1", 1), ("f1_star", 1), ("f1_star_methods", 1), ("f1_star_native", 1)):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("FlatMapGroupsIn") <= most, (name, plan.count("FlatMapGroupsIn"))


def test_conformal(spark):
    rng = random.Random(2)
    rows = [(c, float(rng.randint(0, 30))) for c, n in (("a", 100), ("b", 5), ("c", 19), ("d", 20)) for _ in range(n)]
    got = {r.c: r for r in calibrate.conformal(spark.createDataFrame(rows, "c string, score double"), ["c"]).collect()}
    for c in "abcd":
        own = sorted(s for k, s in rows if k == c)
        k = math.ceil((len(own) + 1) * (1 - 0.05))
        assert got[c].tau == (own[k - 1] if k <= len(own) else float("inf")) and got[c].n == len(own)


def test_all_fallback_is_global(spark):
    """With classes too small, conditional calibration flags what the global threshold flags."""
    rows = [(k % 3, k, float((k * 37) % 101)) for k in range(300)]
    df = spark.createDataFrame(rows, "c int, k int, score double")
    sample = calibrate.capped_sample(df, "c", "c", [F.col("k")], 2)
    thr, every = calibrate.class_thresholds(sample, df, "c"), calibrate.conformal(df, [])
    assert all(r.is_fallback for r in thr.collect())
    tau = every.first().tau
    assert calibrate.flag(df, thr, every, "c").filter(F.col("flag") != (F.col("score") > tau)).count() == 0


def test_histogram_edges_and_bootstrap(spark):
    df = spark.createDataFrame([(f, g, s) for f, g, s in [(1, 0, 0.0), (1, 1, 1.0), (1, 0, 2.0), (2, 1, 3.0), (2, 0, 3.5), (2, 1, -1.0), (2, 255, 1.0)]], "frame_id int, gt int, score double")
    cuts = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0],)], "edges array<double>")
    h = {(r.bin): (r.n_id, r.n_ood) for r in bootstrap.histogram(df, [], cuts, []).collect()}
    assert h == {0: (1, 0), 1: (0, 1), 2: (1, 1)}
    many = bootstrap.resamples(spark, spark.range(40).withColumnRenamed("id", "frame_id"), 200).collect()
    weights = bootstrap.draw_weights(np.arange(40), 200)
    assert {(r.boot, r.frame_id): r.w for r in many} == {(b, f): w for b, row in enumerate(weights.tolist()) for f, w in enumerate(row) if w}


def test_weights_are_like_independent_poisson_numbers():
    """Mean and variance one, frames and draws uncorrelated, so that resampled means vary as they should."""
    w = bootstrap.draw_weights(np.arange(500) * 3, 1000).astype(float)
    share = [(w == k).mean() for k in range(4)]
    assert share == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(4)], abs=0.005)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert w.mean(axis=1).std() == pytest.approx(500**-0.5, rel=0.1) and w.mean(axis=0).std() == pytest.approx(1000**-0.5, rel=0.15)
    between = np.corrcoef(w.T[:100]) - np.eye(100)
    assert np.abs(between).max() < 0.2 and between.mean() == pytest.approx(0, abs=0.002)
    other = bootstrap.draw_weights(np.array([10**18 + 7, -5]), 1000)
    assert abs(other.mean() - 1) < 0.1


def test_exact_draws_equal_metrics_of_weighted_rows(spark, monkeypatch):
    """One pass for all draws gives what each draw's own metrics are, with ties over many frames and a frame of one class."""
    rng = random.Random(11)
    rows = [(rng.choice("ab"), f, float(rng.choice([rng.randint(0, 5), 3, 100 * rng.random(), math.inf])), rng.choice([0, 0, 1, 255])) for f in range(30) for _ in range(40)]
    rows += [("one", 1, float(k), 0) for k in range(5)]
    df = spark.createDataFrame(rows, "m string, frame_id int, score double, gt int")
    weights = bootstrap.draw_weights(np.arange(30), 60)
    for at_once, parts in ((7, 5), (2048, 64)):
        monkeypatch.setattr(bootstrap, "ROWS_AT_ONCE", at_once)
        got = {(r.m, r.boot): r for r in bootstrap.exact_draws(df, "m", draws=60, parts=parts).collect()}
        assert len(got) == 180 and all(got["one", k].ap is None and got["one", k].auroc is None for k in range(60))
        for m in "ab":
            for k in range(0, 60, 7):
                own = [(g, s) for x, f, s, g in rows if x == m for _ in range(int(weights[k, f]))]
                assert (got[m, k].ap, got[m, k].auroc, got[m, k].fpr95) == pytest.approx(plain_metrics(own)), (m, k)
    only = {(r.m, r.boot): r for r in bootstrap.exact_draws(df, "m", draws=60, metrics=("ap",)).collect()}
    assert len(only) == 180 and all(only[k].asDict() == {"m": k[0], "boot": k[1], "ap": None if r.ap is None else pytest.approx(r.ap)} for k, r in got.items())
    joins = [x for x in bootstrap.exact_draws(df, "m")._jdf.queryExecution().optimizedPlan().toString().split("\n") if "cuts" not in x and "Join" in x and "m#" in x]
    assert any("rightHint=(strategy=broadcast)" in x for x in joins), "no task gets all rows of a method"
    assert "Range (" not in bootstrap.exact_draws(df, "m")._jdf.queryExecution().optimizedPlan().toString(), "weights are made in tasks"


def test_draws_of_histograms(spark):
    """The products of matrices against histograms of frames drawn one by one."""
    rng = np.random.default_rng(7)
    hist = [(m, f, b, int(rng.integers(0, 4)), int(rng.integers(0, 3))) for m in "ab" for f in range(9) for b in range(6) if rng.random() < 0.7]
    weights = [(d, f, int(w)) for d, row in enumerate(bootstrap.draw_weights(np.arange(9), 120)) for f, w in enumerate(row) if w]
    got = bootstrap.draws_metrics(spark.createDataFrame(hist, "m string, frame_id int, bin int, n_id int, n_ood int"), "m", 6, 120).collect()
    assert len(got) == 240
    for r in got:
        n, p = np.zeros(6), np.zeros(6)
        for m, f, b, i, o in hist:
            w = sum(x for d, g, x in weights if d == r.boot and g == f) if m == r.m else 0
            n[b], p[b] = n[b] + w * i, p[b] + w * o
        if not p.sum() or not n.sum():
            assert r.ap is None
            continue
        tp, fp = p[::-1].cumsum(), n[::-1].cumsum()
        tpr, fpr = tp / p.sum(), fp / n.sum()
        assert r.ap == pytest.approx(sum(np.diff(tpr, prepend=0) * tp / np.maximum(tp + fp, 1))) and r.auroc == pytest.approx(np.trapezoid(tpr, fpr)) and r.fpr95 == pytest.approx(fpr[np.searchsorted(tpr, 0.95 - 1e-12)])


def test_histogram_is_near_exact(spark):
    rows = [(k % 7, int(k % 3 == 0), float((k * 7919) % 1009)) for k in range(4000)]
    df = spark.createDataFrame(rows, "frame_id int, gt int, score double")
    exact = ranking.metrics(df, [], digits=None).first()
    near = bootstrap.hist_metrics(bootstrap.histogram(df, ["frame_id"], bootstrap.edges(df, [], "score", 500), []), [], None).first()
    assert abs(exact.ap - near.ap) < 0.01 and abs(exact.auroc - near.auroc) < 0.01 and abs(exact.fpr95 - near.fpr95) < 0.02


def test_roles(spark):
    r = ontology.resolve(ontology.classes(spark))
    by = {k: r.filter(f"gt = {k}").count() for k in (0, 1, 255)}
    assert by == {0: 14, 1: 9, 255: 2}
    ids = [x.train_id for x in r.filter("gt = 0").orderBy("label_key").collect()]
    assert ids == list(range(14))
    c = ontology.resolve_competitor(ontology.classes(spark), ontology.RUGD_COMPETITOR)
    assert c.filter("gt = 1").count() == 8 and c.filter("gt = 0").count() == 16
    with pytest.raises(ValueError):
        ontology.require_valid(spark.createDataFrame([(99,)], "label_key int"), ontology.classes(spark))


def test_sites(spark):
    df = spark.createDataFrame([("a_b_c_x",), ("q",), ("a_c",), ("2022-09-21_town_hall",)], "scene string")
    got = [r[0] for r in df.select(splits.site_of(F.col("scene"), ["b_", "c_"])).collect()]
    assert got == ["b_?MULTI", "AMBIGUOUS:q", "AMBIGUOUS:c", "AMBIGUOUS:town_hall"]
    assert [r[0] for r in df.select(splits.location(F.col("scene"))).collect()] == ["x", "", "", ""]


def test_knn_and_mahalanobis(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, k % 2, v[k].tolist()) for k in range(60)], "id long, label int, embedding array<double>")
    q, b = df.filter("id < 10"), df.filter("id >= 10")
    got = {r.id: r.sims for r in vectors.top_cosines(q, b, 4, ["id"]).collect()}
    for k in range(10):
        assert got[k] == pytest.approx(sorted(v[10:] @ v[k], reverse=True)[:4])
    means, cov = vectors.class_moments(b, "label")
    mu = np.stack([v[10:][np.arange(10, 60) % 2 == c].mean(0) for c in (0, 1)])
    cent = np.concatenate([v[10:][np.arange(10, 60) % 2 == c] - mu[c] for c in (0, 1)])
    s = cent.T @ cent / 50
    s += 1e-6 * np.diag(s).mean() * np.eye(5)
    for r in vectors.mahalanobis(q, means, cov, ["id"]).collect():
        want = min((v[r.id] - m) @ np.linalg.inv(s) @ (v[r.id] - m) for m in mu)
        assert r.score == pytest.approx(want)


def test_neighbours_skip_cells_and_large_banks_go_in_parts(spark):
    """Clustered data: far cells aren't looked at, and the result is that of all pairs."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    v = np.repeat(centres, 100, axis=0) + 0.05 * rng.normal(size=(1200, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, "ab"[k % 2], v[k].tolist()) for k in rng.permutation(1200).tolist()], "id long, half string, embedding array<double>")
    q, b = df.filter("id % 10 = 0").drop("half"), df.filter("id % 10 <> 0")
    ids, halves = np.arange(1200), np.array(list("ab" * 600))
    for limit in (1 << 30, 30_000):
        seen, skipped = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        got = {(r.id, r.half): r.sims for r in vectors.top_cosines(q, b, 3, ["id"], ["half"], limit=limit, seen=seen, skipped=skipped).collect()}
        assert len(got) == 240
        for (i, half), sims in got.items():
            assert sims == pytest.approx(np.sort(v[(ids % 10 != 0) & (halves == half)] @ v[i])[::-1][:3])
        share = 0.5 if limit > 1 << 20 else 0.25  # each part of a bank begins without anything to compare with
        assert skipped.value > share * seen.value > 0, (skipped.value, seen.value)
    few = vectors.top_cosines(q, b.limit(2), 3, ["id"], bank_bytes=1000).collect()
    assert len(few) == 120 and all(len(r.sims) == 2 for r in few)
    assert vectors.top_cosines(q.limit(0), b, 3, ["id"]).count() == 0


def test_bank_and_first_neighbour(spark):
    """A bank ends within a frame; the mean of one neighbour is the nearest one."""
    v = spark.range(30).selectExpr("id % 3 AS frame", "id", "array(double(id), 1.0D) AS embedding")
    got = sorted((r.frame, r.id) for r in vectors.bank(v, "frame", F.col("id"), 4, 6).collect())
    assert got == [(0, 0), (0, 3), (0, 6), (0, 9), (1, 1), (1, 4)]
    unit = v.withColumn("embedding", scores.l2norm(F.col("embedding")))
    found = vectors.top_cosines(unit.filter("id < 7"), unit.filter("id >= 7").withColumn("half", F.col("id") % 2), 3, ["id"], ["half"])
    for r in vectors.knn_scores(found, [1, 3]).join(found, ["id", "half"]).collect():
        assert r.cdnp_1 == pytest.approx(1 - r.sims[0]) and r.cdnp_1 <= r.cdnp_3 and len(r.sims) == 3


def test_logit_scores(spark):
    v = [1.0, 3.0, 2.0]
    df = spark.createDataFrame([(v,)], "v array<double>")
    e = np.exp(v)
    r = df.select(scores.msp(F.col("v")).alias("a"), scores.maxlogit(F.col("v")).alias("b"), scores.energy(F.col("v")).alias("c"), scores.argmax(F.col("v")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == pytest.approx((1 - e.max() / e.sum(), -3.0, -math.log(e.sum()), 1))
