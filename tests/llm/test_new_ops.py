"""Operators 11 to 13 against brute force, with nulls, empty texts, ties, repeats and no rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import simhash, spelling, vector_codes

SCHEMA = "doc_id long, text string, fp string, word string, id string, component_id string"


def docs_of(spark, rows):
    """rows: (doc_id, text); the further columns clash with the operators' own names."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], SCHEMA)


def reach(n, links):
    """The least member that each of n can reach."""
    label = list(range(n))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return [root(k) for k in range(n)]


# --- 11 ---


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def near_texts(seed=5, groups=12):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        words = [rng.choice("alpha Beta gamma delta é eps zeta eta theta iota kappa".split()) for _ in range(rng.choice([1, 2, 3, 40, 400]))]
        for _ in range(rng.randint(1, 6)):
            own = list(words)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = "other"
            out.append(rng.choice([" ", "\n", "\t "]).join(own))
    return out


@pytest.mark.parametrize(("most", "limit"), [(simhash.TREE, simhash.BROADCAST_BYTES), (2, 0)])
def test_simhash_equals_brute_force(spark, most, limit):
    texts = [*near_texts(), None, "", " \t\n", "ONE", "one", "x " * 30_000, "a b c", "a\x0bb\x0cc d"]
    rows = [(3 * k % 101 + 7, t) for k, t in enumerate(texts)] + [(7, "a row of a repeated id"), (None, "one"), (None, "nobody else has this text")]
    got = simhash.join(docs_of(spark, rows), most=most, limit=limit).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    label = reach(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = collections.defaultdict(list)
    for (i, _), c in zip(rows, label, strict=True):
        least[c].append(i)
    want = [(i, f"{f:016x}", min((x for x in least[c] if x is not None), default=None)) for (i, _), f, c in zip(rows, fps, label, strict=True)]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert simhash.join(docs_of(spark, [])).count() == 0


def test_simhash_splits_crowded_shards_and_loses_no_link(spark):
    """Thousands of fingerprints in a ball, so that shards outgrow trees on several levels."""
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 9))) for _ in range(1500)} | {rng.getrandbits(64) for _ in range(500)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    members = simhash.shards(frame, 20)
    assert members.select("path").distinct().count() > 20
    assert members.groupBy("path", "value").count().filter((F.col("count") > 20) & (F.bit_count("path") > simhash.LEAST_BITS)).isEmpty()
    links = [(signed.index(r.a), signed.index(r.b)) for r in simhash.tree_links(members, simhash.build_trees(members)).collect()]
    every = np.array(fps, np.uint64)
    near = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(every ^ every[i]) <= 3)]
    assert reach(len(fps), links) == reach(len(fps), near)
    # a search finds every partner, and looks at part of the tree only
    order = np.argsort(every.view(np.int64))
    parent, edge = simhash.grow(np.zeros(len(every), np.int64), every[order])
    assert all(np.bitwise_count(every[order][k] ^ every[order][parent[k]]) == edge[k] for k in range(len(every)))
    found = [p for q, node in simhash.search(every[order], parent, edge, every[order], np.zeros(len(every), np.int64)) for p in zip(q.tolist(), node.tolist(), strict=True)]
    place = {int(o): k for k, o in enumerate(order)}
    assert sorted(found) == sorted((place[i], place[j]) for i, j in near)


# --- 12 ---


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label), without any that are dropped; in Python's whole numbers."""
    q = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    w = len(q[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in q]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    code = lambda: [[min((dist(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        at = code()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at, strict=True) if a[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at, by_label = code(), collections.Counter()
    for (_, _, lab), a in zip(q, at, strict=True):
        by_label[lab] += sum(d for d, _ in a)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), by_label[lab], digest) for (i, _, lab), a in zip(q, at, strict=True)]


def test_vector_codes_equal_whole_number_arithmetic(spark):
    rng = random.Random(4)
    f32 = lambda x: float(np.float32(x))
    rows = [(k, [f32(rng.choice([rng.gauss(0, 1), rng.randint(-2, 2), 0.0])) for _ in range(32)], rng.choice([1, 2, None])) for k in range(150)]
    rows += [(200, rows[3][1], 1), (200, rows[4][1], 2), (None, rows[5][1], None), (201, [f32(900.5)] * 32, 1)]
    bad = [(-1, None, 1), (-2, [None] * 32, 1), (-3, [float("nan")] + [0.0] * 31, 1), (-4, [float("inf")] * 32, 2), (-5, [float("-inf")] * 32, 2), (7000, [], 1), (7001, [1.0], 1)]
    schema = "vec_id long, embedding array<float>, label int, code string, v string"
    frame = spark.createDataFrame([(*r, "x", "x") for r in rows + bad], schema)
    key = lambda r: tuple(map(str, r))
    want = sorted(plain_codes(rows), key=key)
    for parts in (1, 7):
        assert sorted(map(tuple, vector_codes.encode(frame.repartition(parts)).collect()), key=key) == want
    few = vector_codes.encode(frame.filter("vec_id BETWEEN 0 AND 9")).collect()
    assert sorted(map(tuple, few), key=key) == sorted(plain_codes(rows[:10]), key=key) and {r.error for r in few} == {0}
    for none in (frame.limit(0), frame.filter("vec_id < 0")):
        assert vector_codes.encode(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and vector_codes.encode(none).count() == 0


def test_screening_decides_most_rows_and_is_never_wrong():
    rng = np.random.default_rng(1)
    for scale in (3, 200, 60_000, 3_000_000):
        for d in (2, 6, 33):
            x, book = rng.integers(-scale, scale + 1, (3000, d)), rng.integers(-scale, scale + 1, (64, d))
            book[50] = book[7]
            at, dist, left = vector_codes.nearest(x, book)
            every = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
            assert (at == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()
            assert left < 1200 or scale == 3, (scale, d, left)
    with pytest.raises(ValueError, match="64 bits"):
        vector_codes.whole_numbers(__import__("pyarrow").array([[1e30] * 16]), 16, 16)


# --- 13 ---


def plain_variants(rows, least=5, ratio=5):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = {}
    for w in n:
        own = sorted((-n[v], v) for v in n if near(w, v))
        form = own[0][1] if own and -own[0][0] >= ratio * n[w] else None
        out[w] = (form, len(own), n[form] if form else None)
    rooted = []
    for w in n:
        root = w
        while out[root][0]:
            root = out[root][0]
        rooted.append((w, out[w][0], root, n[w], out[w][1], out[w][2]))
    return sorted(rooted)


@pytest.mark.parametrize("most", [spelling.BUCKET, 2])
def test_spelling_equals_brute_force(spark, most):
    rng = random.Random(8)
    stems = ["colour", "Theatre", "größeren", "analyse", "aaaaaa", "aaaaaab", "abababab", "éclairÿ", "centres"]
    words = list(stems)
    for s in stems * 12:
        k = rng.randrange(len(s) + 1)
        words.append(rng.choice([s[:k] + rng.choice("abéx") + s[k:], s[:k] + s[k + 1 :], s[:k] + rng.choice("abÿz") + s[k + 1 :]]))
    weights = [rng.choice([1, 1, 5, 30, 180]) for _ in words]
    rows = [(k, rng.choice([" ", "-", ", ", "· "]).join(rng.choices(words, weights, k=rng.randint(1, 400)))) for k in range(60)]
    rows += [(1, None), (2, ""), (3, rows[0][1]), (3, rows[0][1]), (None, rows[1][1]), (70, "zu kurz " * 9), (71, "uncommonword"), (72, "repeat " * 40_000)]
    got = [tuple(r) for r in spelling.variants(docs_of(spark, rows), most=most).collect()]
    want = plain_variants(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[2] != r[1] and r[1] for r in want), "no way of two steps"
    assert spelling.variants(docs_of(spark, [])).count() == spelling.variants(docs_of(spark, [(1, "short words")])).count() == 0


def test_spelling_splits_crowded_segments_and_takes_pairs_once(spark):
    """Hundreds of words with a common start and a common end."""
    rng = random.Random(9)
    words = sorted({"prefix" + "".join(rng.choice("abc") for _ in range(n)) + "suffix" for n in (4, 5, 6) for _ in range(150)})
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    rows = spelling.segments(frame, 8)
    assert rows.filter("b - a > 1").groupBy("l", "a", "b", "head", "tail").count().filter("count > 8").isEmpty()
    got = [tuple(sorted(r)) for r in spelling.near_pairs(frame, 8).collect()]
    want = {tuple(sorted((a, b))) for a in words for b in words if a < b and (sum(x != y for x, y in zip(a, b, strict=True)) == 1 if len(a) == len(b) else abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:k] + max(a, b, key=len)[k + 1 :] == min(a, b, key=len) for k in range(20)))}
    assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError, match="circles"):
        spelling.variants(docs_of(spark, []), ratio=1)
