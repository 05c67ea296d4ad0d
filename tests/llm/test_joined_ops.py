"""Operators 2, 3, 5 and the pipeline against brute force and planted cases."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import decontamination, jaccard_join, mixing, quality
from quarry.llm.common import read

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, "x", "x") for i, t, lang in rows], SCHEMA)


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ta", "ri", "no", "el", "su", "ki"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


# --- 2 ---


def plain_kn(texts, order=quality.ORDER):
    """Interpolated modified Kneser-Ney by the textbook, in dictionaries."""
    counts = [None] * (order + 1)
    counts[order] = collections.Counter(g for t in texts for g in quality.text_grams(t))
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    disc, ctx = [None] * (order + 1), [None] * (order + 1)
    for n in range(1, order + 1):
        of = collections.Counter(counts[n].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
        d = [k - (k + 1) * y * of[k + 1] / of[k] if of[k] and of[k + 1] else y for k in (1, 2, 3)]
        disc[n] = [0.0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))]
        ctx[n] = collections.defaultdict(lambda: [0, 0.0])
        for g, c in counts[n].items():
            ctx[n][g[:-1]][0] += c
            ctx[n][g[:-1]][1] += disc[n][min(c, 3)]

    def p(g):
        n = len(g)
        below = p(g[1:]) if n > 1 else 1 / (len(counts[1]) + 1)
        if g[:-1] not in ctx[n]:
            return below
        total, rest = ctx[n][g[:-1]]
        c = counts[n][g]
        return (c - disc[n][min(c, 3)]) / total + rest / total * below

    return p


def test_grams_of_long_texts_and_collisions(monkeypatch):
    """Pieces of long texts overlap by what n-grams need, and n-grams that share leading bits are told apart."""
    rng = random.Random(8)
    texts = [sentence(rng, n) for n in (1, 40, 900, 3)] + ["", "a", " \n "]
    want = collections.Counter(g for t in texts for g in quality.text_grams(t))
    for chars, bits in ((1_000_000, 21), (100, 21), (64, 3)):
        monkeypatch.setattr(quality, "STEP_CHARS", chars)
        monkeypatch.setattr(quality.Grams, "BITS", bits)
        found = quality.Grams()
        found.add(texts)
        found.add(texts[:2])
        assert dict(zip(*(c.to_pylist() for c in found.columns()), strict=True)) == want + collections.Counter(g for t in texts[:2] for g in quality.text_grams(t))
        rate = quality.GramScores(list(want), np.array([-1.0 - k for k in range(len(want))]))
        index = {g: 1.0 + k for k, g in enumerate(want)}
        tokens, nll = rate(texts)
        assert tokens.tolist() == [len(quality.text_grams(t)) for t in texts]
        assert nll[:4] == pytest.approx([np.mean([index[g] for g in quality.text_grams(t)]) for t in texts[:4]]) and np.isnan(nll[4])


def test_perplexity_is_that_of_the_textbook(spark):
    rng = random.Random(1)
    train = [sentence(rng, 60) for _ in range(20)]
    other = [sentence(rng, 10), "TA!! RI!! zz9", "", None, "é ñ ta"]
    counts = quality.count_grams(docs_of(spark, [(k, t, "en") for k, t in enumerate(train)]), "text")
    got = {r.doc_id: r for r in quality.score(docs_of(spark, [(k, t, "en") for k, t in enumerate(other)]), counts, ["doc_id"], n_blocks=3).collect()}
    p = plain_kn(train)
    assert abs(sum(p("tari" + c) for c in {g[-1] for t in train for g in quality.text_grams(t)}) - 1) < 0.05
    for k, t in enumerate(other):
        grams = quality.text_grams(t or "")
        assert got[k].tokens == len(grams)
        if grams:
            assert got[k].nll == pytest.approx(-sum(math.log(p(g)) for g in grams) / len(grams), rel=1e-5)
        else:
            assert got[k].nll is None


def test_quality_keeps_clean_and_drops_noise(spark):
    rng = random.Random(2)
    rows = [(k, sentence(rng, 50), ["en", "de", None][k % 3]) for k in range(300)]
    noise = [(1000 + k, " ".join("".join(rng.choice("#$%&XYZ019") for _ in range(7)) for _ in range(40)), "en") for k in range(20)]
    rows += [*noise, (2000, None, "en"), (2001, " ", None), (5, rows[5][1], "de"), (None, rows[6][1], "en")]
    trusted = spark.createDataFrame([(k,) for k in range(0, 300, 1)] + [(None,), (7,)], "doc_id long")
    out = quality.classify(docs_of(spark, rows), trusted).collect()
    assert len(out) == len(rows)
    kept = collections.defaultdict(set)
    for r in out:
        kept[r.doc_id].add(r.kept)
    assert all(kept[k] == {False} for k, *_ in noise) and kept[2000] == kept[2001] == {False}
    assert sum(kept[k] == {True} for k in range(300)) >= 295 and kept[None] == {True}
    assert quality.classify(docs_of(spark, []), trusted).count() == 0
    assert all(r.kept == (r.tokens > 0) for r in quality.classify(docs_of(spark, rows[:5] + [(9999, "", "en")]), trusted.limit(0)).collect())


def test_each_language_has_its_own_threshold(spark):
    """One language's usual text would be noise in the other, and the other way round."""
    rng = random.Random(4)
    word = lambda letters, least, most: "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))
    plain = lambda: " ".join(rng.choice(["tari", "nosu", "elki", "rino"]) for _ in range(40))
    rich = lambda: " ".join(word("abcdefghijklmnopqrstuvwxyz", 2, 9) for _ in range(40))
    rows = [(k, plain(), "aa") for k in range(400)] + [(1000 + k, rich(), "bb") for k in range(400)]
    odd = [(2000 + k, rich(), "aa") for k in range(20)] + [(2100 + k, rich(), "bb") for k in range(20)] + [(2200, rich(), "cc"), (2201, "x y " * 40_000, "bb")]
    trusted = spark.createDataFrame([(k,) for k, *_ in rows], "doc_id long")
    out = {r.doc_id: r for r in quality.classify(docs_of(spark, rows + odd), trusted, n_blocks=4).collect()}
    assert len({r.threshold for r in out.values() if r.lang == "aa"}) == len({r.threshold for r in out.values() if r.lang == "bb"}) == 1
    assert out[0].threshold < 0.5 * out[1000].threshold
    assert not any(out[2000 + k].kept for k in range(20)) and sum(out[2100 + k].kept for k in range(20)) >= 18
    assert sum(out[k].kept for k in range(400)) >= 390 and sum(out[1000 + k].kept for k in range(400)) >= 390
    # a language without trusted documents has the quantile of all of them
    held = sorted(out[k].perplexity for k, *_ in rows)
    assert out[2200].threshold > held[int(0.9 * len(held))]
    assert out[2201].tokens == 2 * 80_000
    # the formula, from the perplexities that all documents got
    names = spark.createDataFrame([(k,) for k, *_ in rows], "k long").filter(F.pmod(F.xxhash64(F.lit(11), "k"), F.lit(10)) < quality.HELD_OUT_TENTHS)
    ids = {r.k for r in names.collect()}
    held = {lang: sorted(math.log(r.perplexity) for r in out.values() if r.lang == lang and r.doc_id in ids) for lang in ("aa", "bb")}
    rank = lambda x, q: sorted(x)[max(math.ceil(q * len(x)) - 1, 0)]
    q, prior = quality.KEEP_QUANTILE, quality.PRIOR_HELD_OUT
    above = rank([x - rank(own, 0.5) for own in held.values() for x in own], q)
    for lang, own in held.items():
        want = (len(own) * rank(own, q) + prior * (rank(own, 0.5) + above)) / (len(own) + prior)
        assert all(r.threshold == pytest.approx(math.exp(want)) for r in out.values() if r.lang == lang)
    assert out[2200].threshold == pytest.approx(math.exp(rank(held["aa"] + held["bb"], q)))
    # and on few documents
    few = spark.createDataFrame([("aa", float(x)) for x in range(1, 10)] + [("bb", float(x)) for x in (100, 110, 180)], "__lang string, nll double")
    own, every = quality.thresholds(few, 1.0, 5)
    assert {r["__l"]: r["own"] for r in own.collect()} == {"aa": pytest.approx((9 * 9 + 5 * (5 + 70)) / 14), "bb": pytest.approx((3 * 180 + 5 * (110 + 70)) / 8)}
    assert every.first()[0] == 180


# --- 3 ---

ITEMS = [
    (1, "A train leaves the station at 5 km per hour and Alice rides it for 30 minutes before she meets Bob at 5 km"),
    (2, "what is the colour of the sky when the sun goes down behind the hills of the west"),
    (3, "red fox jumps high"), (4, "too short"), (5, None), (6, ""), (2, "what is the colour of the sky when the sun goes down behind the hills of the west"),
]


def plain_template(text):
    """Per word of a text: its template and its filler, by the rules, a word at a time."""
    import regex

    units = {u.replace("/", "") for u in decontamination.UNITS.split()}
    raw = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    out = []
    for k, w in enumerate(raw):
        letters = regex.sub(r"[^\p{L}]", "", w).lower()
        if re.search("[0-9]", w):
            kind = "#num"
        elif k and raw[k - 1][-1] not in ".!?:" and (m := regex.fullmatch(r"([^\p{L}]*)(\p{Lu}\p{Ll}+)[^\p{L}\p{Nd}]*", w)) and not m[1]:
            kind = "#name"
        elif letters in units:
            kind = "#unit"
        else:
            kind = letters
        out.append((kind, regex.sub(r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}%]+$", "", w.lower())))
    return out


def plain_holders(texts, items):
    """Ids of the texts that hold an item: all places of all texts against all places of all items."""
    held = set()
    words = {i: plain_template(t) for i, t in texts.items()}
    for text in filter(None, items.values()):
        item = plain_template(text)
        if len(item) < 4:
            continue
        size = 8 if len(item) >= 8 else 4
        places = collections.defaultdict(list)
        for at in range(len(item) - size + 1):
            places[tuple(k for k, _ in item[at : at + size])].append(at)
        for i, own in words.items():
            lines = collections.defaultdict(set)
            for p in range(len(own) - size + 1):
                for at in places.get(tuple(k for k, _ in own[p : p + size]), ()):
                    lines[p - at].add(at)
            good = set()
            for delta, ats in lines.items():
                span = range(min(ats), max(ats) + size)
                pairs = {(item[k][0], item[k][1], own[k + delta][1]) for k in span if item[k][0][:1] == "#" and item[k][0] == own[k + delta][0]}
                if len({p[:2] for p in pairs}) == len(pairs) == len({p[::2] for p in pairs}):
                    good |= ats
            if len(good) >= 0.5 * (len(item) - size + 1):
                held.add(i)
    return held


def test_decontamination_against_brute_force(spark):
    docs, bench = read(spark, "/root/testdata/sf0.001", "documents"), read(spark, "/root/testdata/sf0.001", "benchmark")
    want = plain_holders({r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in bench.collect()})
    assert want and {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()} == want


def test_decontamination(spark):
    pad = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor"
    rows = [
        (1, f"{pad} {ITEMS[0][1]} {pad}", "en"),
        (2, f"{pad} a train leaves the station at 7 km per hour and Carol rides it for 45 minutes before she meets Dave at 7 km {pad}", "en"),
        (3, f"{pad} a train leaves the station at 7 km per hour and Carol rides it for 45 minutes before she meets Carol at 9 km {pad}", "en"),
        (4, f"{pad}\nWhat is the COLOUR of the sky, when the sun goes down\tbehind the hills of the west? {pad}", "en"),
        (5, f"{pad} red fox jumps high {pad}", "en"),
        (6, f"{pad} too short {pad} the sky when the sun {pad}", "en"),
        (7, None, "en"), (8, "", "en"), (9, "x " * 30_000 + ITEMS[1][1], "en"), (2, "clean text of the same id", "en"), (None, f"{pad} red fox jumps high", "en"), (4, rows_4 := f"{pad} nothing", "en"),
    ]
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, kind string, windows int")
    for broadcast in (0, 1 << 20):
        got = {(r.doc_id, r.item_id): r for r in decontamination.decontaminate(docs_of(spark, rows), bench, broadcast_bytes=broadcast).collect()}
        assert set(got) == {(1, 1), (2, 1), (4, 2), (5, 3), (9, 2), (None, 3)}, set(got)
        assert got[1, 1].kind == "exact" and got[2, 1].kind == "reparameterised" and got[4, 2].kind == "exact"
    every = {(r.doc_id, r.item_id) for r in decontamination.decontaminate(docs_of(spark, rows), bench, least_words=1).collect()}
    assert every == {(1, 1), (2, 1), (4, 2), (5, 3), (9, 2), (None, 3), (6, 4)}
    assert decontamination.decontaminate(docs_of(spark, []), bench).count() == 0
    assert decontamination.decontaminate(docs_of(spark, rows), bench.limit(0)).count() == 0


# --- 5 ---


def plain_components(rows, percent=80):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                root[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k), i)) for k, (i, *_) in enumerate(rows)]


def near_copies(seed):
    rng = random.Random(seed)
    shared = sentence(rng, 30)
    rows = []
    for _ in range(25):
        words = sentence(rng, rng.choice([3, 12, 60, 150])).split()
        if rng.random() < 0.5:
            words = shared.split() + words
        for _ in range(rng.choice([1, 1, 3, 12])):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = rng.choice(["qq", "ww", "ee"])
            rows.append((len(rows) * 7 % 1009, " ".join(own), "en"))
    # a chain: each is near to the next only
    chain = sentence(rng, 120).split()
    for k in range(12):
        rows.append((2000 - k, " ".join(chain[k * 4 : k * 4 + 70]), "en"))
    return [*rows, (3000, None, "en"), (3001, " \n", "en"), (3002, "A B c", "en"), (3003, "a b C", "en"), (3004, rows[0][1].upper(), "en"), (None, "lonely without any id at all", "en"), (3005, "y " * 30_000, "en"), (3006, rows[3][1], "en"), (3006, rows[3][1], "en")]


@pytest.mark.parametrize(("seed", "percent", "most"), [(1, 80, 8_000_000), (2, 80, 1), (3, 50, 6_000), (4, 95, 1)])
def test_jaccard_join(spark, seed, percent, most):
    """Against all pairs; small bounds of a cell split nearly all cells."""
    rows = near_copies(seed)
    got = jaccard_join.join(docs_of(spark, rows), percent=percent, cell_shingles=most).collect()
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(plain_components(rows, percent), key=key)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.join(docs_of(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard_join.join(docs_of(spark, [(1, None, "en")])).collect()] == [(1, 0, 1)]


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_regions_lose_no_pair(percent):
    """The recursive cells find what a plain loop finds."""
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(12)]
    sets = []
    for b in base:
        for _ in range(60):
            drop = rng.random(len(b)) > 0.06
            sets.append(np.unique(np.concatenate([b[drop], rng.integers(0, 2**63, rng.integers(0, 15)).astype(np.uint64)])))
    n, node = np.array([len(s) for s in sets]), np.arange(len(sets))
    sketches = [jaccard_join.sketch(s) for s in sets]
    found = {(min(i, j), max(i, j)) for i, rest in jaccard_join.near_pairs(n, sketches, percent, node) for j in rest.tolist()}
    missing = links = 0
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if a // 60 == b // 60:
                i = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                near = 100 * i >= percent * (n[a] + n[b] - i)
                links += near
                missing += near and (a, b) not in found
    assert not missing and links > 100


# --- pipeline ---


def test_pipeline_stages(spark):
    """Every stage on its own input, against the rows that brute force or the operator by itself says should stay."""
    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.table(stage(spark, docs, sf), "test-stage")
        if name == "sharding":
            assert out.columns[-2:] == ["slot", "shard"] and out.count() == docs.count()
            break
        assert out.columns == docs.columns
        before, after = {r.doc_id: r.text for r in docs.collect()}, collections.Counter(r.doc_id for r in out.collect())
        if name == "quality":
            kept = {r.doc_id for r in quality.classify(docs, corpus_pipeline.trusted_ids(spark, sf)).collect() if r.kept}
            assert set(after) == kept and len(kept) >= 0.5 * len(before)
        elif name == "near_duplicates":
            want = {r[2] for r in plain_components([(i, t, "") for i, t in before.items()])}
            assert set(after) == want
        elif name == "decontamination":
            held = plain_holders(before, {r.item_id: r.text for r in read(spark, sf, "benchmark").collect()})
            assert held and set(after) == set(before) - held
        elif name == "mixing":
            words = lambda ids: sum(n * len(before[i].split()) for i, n in ids.items())
            assert abs(words(after) / words(dict.fromkeys(before, 1)) - 1.5) < 0.1 and max(after.values()) <= 2
            taken = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect() if r.taken}
            assert dict(after) == taken
        docs = out


def test_pipeline_names_rows_not_ids(spark, tmp_path):
    """Repeated and null ids: each row goes or stays by its own text."""
    sf = "/root/testdata/sf0.001"
    good = [r.text for r in read(spark, sf, "documents").join(corpus_pipeline.trusted_ids(spark, sf), "doc_id").orderBy("doc_id").limit(3).collect()]
    item = read(spark, sf, "benchmark").orderBy("item_id").first().text
    texts = lambda rows: collections.Counter((r.doc_id, r.text) for r in rows.collect())
    stages = dict(corpus_pipeline.STAGES)
    noise = " ".join("#%&XYZ019"[k % 9 :] for k in range(40))
    cases = {
        "quality": ([(-7, good[0]), (-7, noise), (None, good[1]), (None, None), (None, " "), (-8, good[2]), (-8, good[2])], [(-7, good[0]), (None, good[1]), (-8, good[2]), (-8, good[2])]),
        "near_duplicates": ([(1, good[0]), (5, good[0].upper()), (5, good[1]), (None, good[2]), (None, good[2]), (None, None), (9, "")], [(1, good[0]), (5, good[1]), (None, good[2]), (None, None), (9, "")]),
        "decontamination": ([(1, good[0]), (1, f"{good[1]} {item}"), (None, item), (None, good[2]), (3, None), (3, "")], [(1, good[0]), (None, good[2]), (3, None), (3, "")]),
        "sharding": ([(1, good[0]), (1, good[1]), (None, None), (None, "")], [(1, good[0]), (1, good[1]), (None, None), (None, "")]),
    }
    for name, (rows, want) in cases.items():
        made = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", True, "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept boolean, slot string")
        if name == "quality":  # the model learns from the labelled documents
            made = made.unionByName(read(spark, sf, "documents"), allowMissingColumns=True)
        made.write.parquet(f"{tmp_path}/{name}")
        for docs in (made, spark.read.parquet(f"{tmp_path}/{name}")):
            out = stages[name](spark, docs, sf)
            assert texts(out.filter("doc_id < 0 OR doc_id IS NULL") if name == "quality" else out) == collections.Counter(want), name
            assert name == "sharding" or out.columns == docs.columns


def test_pipeline_of_nothing_and_of_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    odd = docs_of(spark, [(1, None, None), (None, "ta ri no " * 9, None), (None, "ta ri no " * 9, None), (3, "", "en"), (4, "x " * 20_000, "en")]).drop("component_id", "kept")
    for docs in (odd.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.table(stage(spark, docs, sf), "odd")
        assert docs.count() <= 10
