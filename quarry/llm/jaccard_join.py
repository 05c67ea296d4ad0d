"""Exact Jaccard join of word shingles by recursive regions in the metric space.

Texts with equal shingle sets are one node, whose name is a hash. Two sets that reach the similarity share a shingle among
the first few of each in any common order (rare ones first here), so nodes that share none of those are beyond any
window. What follows is linear in rows at every step:

* The nodes around one such shingle elect a pivot document, the one with the least name, and all go to the pivot's cell.
  Neighbouring shingles elect the same pivot, so that a group of copies meets in a few cells and not once a shingle.
* A cell that outgrows a task is split around its pivot: members linked to the pivot are one component and are never
  compared with each other; by the triangle inequality only the others within a window of the pivot's ball can link to
  them, and are copied to the blocks of the ball; the others also meet among themselves, block by block.
* A task splits its cell into Voronoi cells around further pivots, by a distance that never exceeds the size of the
  symmetric difference (the Hamming distance of parity sketches); members within a window of a border are copied; cells
  split again until they are small or no longer shrink. First only members that have a possible partner go on; then
  these come with their full sets, pairs of different components are compared exactly, and the links that join
  components are all that a cell returns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import MIX, drop_table, nullable, ship_code, small_batches, small_or_plain, table, tidy
from quarry.llm.linking import components

WORDS = 5
#: Similarity in hundredths.
PERCENT = 80
#: So many shingles at most go last in the order, the more frequent the later: all that occur a power of two times or
#: more, the least power that the bound allows. Workers hold 16 bytes for each.
HOT_SHINGLES = 1 << 18
#: Shingles, over all members, that a cell may have in one task; each member counts MEMBER more.
CELL_SHINGLES = 8_000_000
MEMBER = 400
#: Members of a cell that a task joins without splitting it.
CELL = 256
#: Members of a cell that are compared one by one, without arrays.
FEW = 16
BROADCAST_ROWS = 200_000

def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    from xxhash import xxh3_64_intdigest

    # bytes.lower and bytes.split know ASCII letters and ASCII white space only, as the definition of words wants
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < WORDS:
        return _scramble((h * MIX[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    n = len(h) - WORDS + 1
    s = h[:n] * MIX[0]
    for k in range(1, WORDS):
        s = s + h[k : k + n] * MIX[k]
    return np.unique(_scramble(s))


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's buckets by leading bits, as many as the next power of two of its size."""
    bits = max(6, int(len(s) - 1).bit_length())
    return np.packbits((np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).astype(np.uint8)).tobytes()


def _folded(x: np.ndarray) -> np.ndarray:
    """The sketch of half the length: neighbouring parities are added."""
    bits = np.unpackbits(x, axis=-1)
    return np.packbits(bits[..., 0::2] ^ bits[..., 1::2], axis=-1)


def _fold_to(x: bytes, size: int) -> bytes:
    y = np.frombuffer(x, np.uint8)
    while len(y) > size:
        y = _folded(y)
    return y.tobytes()


def _near(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    a, b = a if len(a) == size else _fold_to(a, size), b if len(b) == size else _fold_to(b, size)
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def _prefix(s: np.ndarray, hot: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles in the order (how often if hot, hash), of which similar sets share one: those that aren't hot,
    and those that are."""
    n = len(s) - -(-percent * len(s) // 100) + 1
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        rank = np.where(hot[at] == s, often[at], 0)
        if rank.any():
            order = np.argsort(rank, kind="stable")[:n]
            cold = np.searchsorted(rank[order], 0, side="right")
            return s[order[:cold]], s[order[cold:]]
    return s[:n], s[:0]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def hot_shingles(docs: DataFrame, text_col: str, most: int = HOT_SHINGLES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent shingles, `most` at most.

    Counts cover all texts; a task leaves out what it sees once among thousands of texts, which only moves a
    shingle's place in the order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            texts = batch.column(0).to_pylist()
            for k, t in enumerate(texts):
                held.append(shingles(t))
                size += len(held[-1])
                if size > 2_000_000 or k == len(texts) - 1:
                    s, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"s": pa.array(_signed(s[n > 1])), "n": pa.array(n[n > 1])})
                    held, size = [], 0

    counts = table(docs.select(F.col(text_col).alias("t")).mapInArrow(tidy(run), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")), "shingle-counts")
    power, left = 64, most
    for r in counts.groupBy(F.floor(F.log2("n")).alias("power")).count().orderBy(F.desc("power")).collect():  # 63 rows at most
        if r["count"] > left:
            break
        power, left = r.power, left - r["count"]
    rows = counts.filter(F.floor(F.log2("n")) >= power).select("s", "n").toPandas()  # `most` rows at most
    drop_table(counts)
    s, n = rows["s"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def describe(docs: DataFrame, id_col: str, text_col: str, hot: np.ndarray, often: np.ndarray, percent: int) -> DataFrame:
    """(id, node, n, sketch, prefix, hot) of every row; node names the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("t").to_pylist()]
            node = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
            first = [_prefix(s, hot, often, percent) if len(s) else (s, s) for s in sets]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "node": pa.array(node, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "sketch": pa.array([sketch(s) for s in sets], pa.binary()), "prefix": pa.array([_signed(x) for x, _ in first], pa.list_(pa.int64())), "hot": pa.array([_signed(x) for _, x in first], pa.list_(pa.int64()))})

    kind = docs.schema[id_col].dataType.simpleString()
    return table(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(tidy(run), f"id {kind}, node long, n long, sketch binary, prefix array<long>, hot array<long>"), "sets")


def _cuts(names: np.ndarray) -> list[int]:
    """Where runs of equal names begin, and the end."""
    return [*np.flatnonzero(np.append(True, names[1:] != names[:-1])).tolist(), len(names)] if len(names) else [0]


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Whole cells: columns of sorted batches, cut only between cells. A cell that spans batches is held."""
    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        cell = own["cell"]
        if held and held[-1]["cell"][-1] == cell[0] == cell[-1]:
            held.append(own)
            continue
        cut = int(np.searchsorted(cell, cell[-1], side="left"))
        held.append({c: v[:cut] for c, v in own.items()})
        if cut or len(held) > 1:
            yield {c: np.concatenate([h[c] for h in held]) for c in names}
        held = [{c: v[cut:] for c, v in own.items()}]
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in names}


def _dealt(rows: DataFrame, by: str, *order: str) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by).sortWithinPartitions(by, *order)


def first_cells(sets: DataFrame) -> DataFrame:
    """(cell, node), distinct: the pivots that a node's shingles elect, but itself.

    Shingles that aren't hot are dealt out, and pass a task in order, without being held; hot ones, of which there are no
    more than HOT_SHINGLES, are elected by an aggregate that is broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = pivot = None
        out, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            token, node = batch.column("token").to_numpy(), batch.column("node").to_numpy()
            cuts = np.array(_cuts(token))
            first = node[cuts[:-1]]
            if last == token[0]:
                first[0] = pivot
            last, pivot = token[-1], first[-1]
            cell = np.repeat(first, np.diff(cuts))
            out.append(np.stack([cell, node], axis=1)[cell != node])
            size += len(out[-1])
            if size > 500_000:
                rows, out, size = np.unique(np.concatenate(out), axis=0), [], 0
                yield pa.RecordBatch.from_pydict({"cell": pa.array(rows[:, 0]), "node": pa.array(rows[:, 1])})
        if size:
            rows = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(rows[:, 0]), "node": pa.array(rows[:, 1])})

    cold = _dealt(sets.select(F.explode("prefix").alias("token"), "node"), "token", "node").mapInArrow(tidy(run), "cell long, node long")
    hot = sets.select(F.explode("hot").alias("token"), "node")
    pivots = hot.groupBy("token").agg(F.min("node").alias("cell"))
    return table(cold.unionByName(hot.join(F.broadcast(pivots), "token").filter("cell <> node").select("cell", "node")).distinct(), "cells")


def split_cells(cells: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, broadcast_rows: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """cells (cell, node, n, sketch, own) with those of more than `most` shingles split, and the links that are known now.

    own: the node, or for members that are linked to their cell's pivot, the pivot.
    """
    weight = F.col("n") + MEMBER
    cells = cells.withColumn("own", F.col("node"))
    sizes = table(cells.groupBy("cell").agg(F.sum(weight).alias("sum"), F.count("*").alias("m")).filter((F.col("sum") > most) & (F.col("m") > 2)).select("cell"), "large")
    if sizes.isEmpty():
        return cells, None
    own = table(cells.join(sizes, "cell"), "split")
    rest = cells.join(sizes, "cell", "left_anti")
    pivots = nodes.join(sizes, F.col("node") == F.col("cell"), "left_semi").select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    rows = own.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("cell").alias("b")).join(pivots, "b")

    def ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """near: a link with the pivot is possible; close: one with a member that is linked to the pivot."""
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            h = np.array([_near(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)], np.int64)
            low, high = np.minimum(na, nb), np.maximum(na, nb)
            near = (100 * low >= percent * high) & ((100 - percent) * (na + nb) >= (100 + percent) * h)
            # a member between the two has low * 100 / percent shingles at most
            close = (100 - percent) * (percent * (na + nb) + 200 * low) >= percent * (100 + percent) * h
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "near": pa.array(near), "close": pa.array(close)})

    rows = table(rows.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidy(ball), "a long, b long, near boolean, close boolean"), "balls")
    links = verified(rows.filter("near AND a <> b").select("a", "b"), nodes, docs, id_col, text_col, percent, broadcast_rows)
    linked = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("l", F.lit(True))
    linked = rows.select("a", "b", "close").join(linked, ["a", "b"], "left")
    linked = linked.select(F.col("b").alias("cell"), F.col("a").alias("node"), "close", (F.coalesce("l", F.lit(False)) | (F.col("a") == F.col("b"))).alias("linked"))
    own = table(own.join(linked, ["cell", "node"]), "split")
    many = own.groupBy("cell").agg(*(F.ceil(2 * F.sum(F.when(c, weight).otherwise(0)) / most).cast("int").alias(a) for a, c in (("nl", F.col("linked")), ("nu", ~F.col("linked")))))
    own = own.join(many, "cell").filter("nu > 0").withColumn("own", F.when(F.col("linked"), F.col("cell")).otherwise(F.col("node")))
    block = lambda n: F.pmod(F.xxhash64(F.lit(5), "node"), F.greatest(F.col(n), F.lit(1))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    mine, base = block("nu"), ["cell", "node", "n", "sketch", "own"]
    key = lambda kind, a, b: F.xxhash64("cell", F.lit(kind), a, b).alias("cell")
    inner = own.filter("linked").withColumn("i", block("nl")).withColumn("j", F.explode(upto("nu"))).select(key("ball", "i", "j"), *base[1:])
    outer = own.filter("NOT linked")
    rim = outer.filter("close").withColumn("j", mine).withColumn("i", F.explode(upto("nl"))).select(key("ball", "i", "j"), *base[1:])
    outer = outer.withColumn("me", mine).withColumn("k", F.explode(upto("nu"))).select(key("rest", F.least("me", "k").alias("i"), F.greatest("me", "k").alias("j")), *base[1:])
    return table(rest.select(*base).unionByName(inner).unionByName(rim).unionByName(outer), "cells"), links


def _voronoi(sk: np.ndarray, n: np.ndarray, own: np.ndarray, copied: np.ndarray, percent: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Splits a cell (members own, and copied ones from beyond its border) into cells that are joined by themselves."""
    most = 200 * int(n[own].max(initial=0)) * (100 - percent) // (percent * (100 + percent))  # a link's two sets differ by no more
    if len(own) + len(copied) <= CELL or len(own) < 2 or depth > 6:
        yield own, copied
        return
    every = np.concatenate([own, copied])
    pivots = own[np.linspace(0, len(own) - 1, 8).astype(int)]
    d = np.stack([np.bitwise_count(sk[every] ^ sk[p]).sum(axis=1, dtype=np.int64) for p in pivots], axis=1)
    near = d.argmin(axis=1)
    window = d <= d.min(axis=1)[:, None] + 2 * most
    parts = []
    for c in range(len(pivots)):
        core = every[: len(own)][near[: len(own)] == c]
        rim = every[window[:, c] & ~((near == c) & (np.arange(len(every)) < len(own)))]
        if len(core):
            parts.append((core, rim))
    if max(len(a) + len(b) for a, b in parts) > 0.7 * len(every):
        yield own, copied  # the windows hold nearly all: no metric split helps here
        return
    for core, rim in parts:
        yield from _voronoi(sk, n, core, rim, percent, depth + 1)


def near_pairs(n: np.ndarray, sketches: list[bytes], percent: int, group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Members i of a cell with those others that sizes and sketches allow to be linked to i; every such pair of different
    groups comes at least once. group may change between steps."""
    if len(n) <= FEW:
        sizes, kept = n.tolist(), list(sketches)
        for i in range(len(sizes)):
            found = []
            for j in range(i + 1, len(sizes)):
                x, y = sizes[i], sizes[j]
                if group[i] != group[j] and 100 * min(x, y) >= percent * max(x, y) and (100 - percent) * (x + y) >= (100 + percent) * _near(kept[i], kept[j]):
                    found.append(j)
            if found:
                yield i, np.array(found)
        return
    order = np.argsort(n, kind="stable")
    at = 0
    while at < len(order):
        # the members from at on, up to the largest that may link to the first, and then up to the largest that may link to those
        top = n[order[at]] * 100 // percent
        end = int(np.searchsorted(n[order], top, side="right"))
        stop = int(np.searchsorted(n[order], top * 100 // percent, side="right"))
        least = min(len(sketches[k]) for k in order[at:stop])
        sk = np.zeros((len(n), least), np.uint8)
        for k in order[at:stop].tolist():
            sk[k] = np.frombuffer(_fold_to(sketches[k], least), np.uint8)
        for core, rim in _voronoi(sk, n, order[at:end], order[end:stop], percent, 0):
            every = np.concatenate([core, rim])
            for k, i in enumerate(core.tolist()):
                rest = every[k + 1 :]
                low, high = np.minimum(n[i], n[rest]), np.maximum(n[i], n[rest])
                rest = rest[(100 * low >= percent * high) & (group[rest] != group[i])]
                if len(rest):
                    h = np.bitwise_count(sk[rest] ^ sk[i]).sum(axis=1, dtype=np.int64)
                    rest = rest[(100 - percent) * (n[rest] + n[i]) >= (100 + percent) * h]
                    if len(rest):
                        yield i, rest
        at = end


def partners(cells: DataFrame, percent: int) -> DataFrame:
    """Those of cells (cell, node, n, sketch, own) that have a possible partner of another own in their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _runs(batches, ["cell", "node", "n", "sketch", "own"]):
            has, cuts = np.zeros(len(r["node"]), bool), _cuts(r["cell"])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    own = np.unique(r["own"][a:b], return_inverse=True)[1]
                    # members that are known to have a partner are one group, as their pairs tell nothing new
                    group = own.copy()
                    for i, rest in near_pairs(r["n"][a:b], r["sketch"][a:b].tolist(), percent, group):
                        rest = rest[own[rest] != own[i]]
                        if len(rest):
                            group[i], group[rest] = -1, -1
                    has[a:b] = group < 0
            if has.any():
                yield pa.RecordBatch.from_pydict({c: pa.array(v[has], pa.binary() if c == "sketch" else pa.int64()) for c, v in r.items()})

    return table(_dealt(cells, "cell", "node").mapInArrow(tidy(run), "cell long, node long, n long, sketch binary, own long"), "partners")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Of two sorted sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def cell_links(members: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b): exact links, of which no two join the same components of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _runs(batches, ["cell", "node", "n", "sketch", "own", "s"]):
            found, cuts = [], _cuts(r["cell"])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                sets, group = [np.frombuffer(x, np.uint64) for x in r["s"][a:b]], np.unique(r["own"][a:b], return_inverse=True)[1]
                for i, rest in near_pairs(r["n"][a:b], r["sketch"][a:b].tolist(), percent, group):
                    for j in rest.tolist():
                        if group[i] != group[j] and _similar(sets[i], sets[j], percent):
                            group[group == group[j]] = group[i]
                            found.append((a + i, a + j))
            if found:
                at = np.array(found)
                yield pa.RecordBatch.from_pydict({"a": pa.array(r["node"][at[:, 0]]), "b": pa.array(r["node"][at[:, 1]])})

    return table(_dealt(members.join(full, "node"), "cell", "node").select("cell", "node", "n", "sketch", "own", "s").mapInArrow(tidy(run), "a long, b long"), "links")


def full_sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    """(node, s): the sorted sets of the nodes wanted (node, id)."""
    ids = wanted.select(F.col("id").alias("__id")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(small_or_plain(ids, wanted.count(), broadcast_rows), F.col("id").eqNullSafe(F.col("__id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t) for t in batch.column("t").to_pylist()]
            node = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in own]
            yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "s": pa.array([s.tobytes() for s in own], pa.binary())})

    # an id may have several texts, and a text several rows of one id
    return table(texts.select("t").mapInArrow(tidy(run), "node long, s binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "full-sets")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, broadcast_rows: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    pairs = table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wanted = table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "id"), "wanted")
    full = full_sets(wanted, docs, id_col, text_col, broadcast_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sets], pa.bool_()))

    both = pairs.join(full.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(full.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    links = table(both.select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a long, b long"), "links")
    for done in (pairs, wanted, full):
        drop_table(done)
    return links


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, broadcast_rows: int = BROADCAST_ROWS, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """A row per row of docs: <id>, n_shingles, component_id.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text's set is that of its shingles of five
    words, or its whole sequence if it has fewer words. Texts link when their sets' Jaccard similarity is `percent`
    hundredths (1 to 100) or more, and a component is what links reach; its id is the smallest id in it. Null texts
    and texts without words have no shingles and link with nothing. Rows with the same text link; equal ids don't: each
    row of a repeated id goes by its own text. Texts are read whole, however long; a cell with very long ones holds fewer.
    Other columns of docs, whatever their names, are not looked at. No rows give no rows.
    """
    ship_code(docs.sparkSession)
    with small_batches(docs.sparkSession):
        docs = docs.select(nullable(docs, id_col).alias("__i"), F.col(text_col).alias("__t"))
        names = ("__i", "__t")
        hot, often = hot_shingles(docs, "__t")
        sets = describe(docs, *names, hot, often, percent)
        nodes = table(sets.filter("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")

        cells = first_cells(sets)
        whole = cells.unionByName(cells.select("cell", F.col("cell").alias("node")).distinct())
        dealt = table(whole.join(nodes.select("node", "n", "sketch"), "node").select("cell", "node", "n", "sketch"), "dealt")
        drop_table(cells)
        cells, known = split_cells(dealt, nodes, docs, *names, percent, broadcast_rows, cell_shingles)
        members = partners(cells, percent)
        for done in (dealt, cells):
            drop_table(done)
        wanted = table(members.select("node").distinct().join(nodes.select("node", "id"), "node"), "wanted")
        full = full_sets(wanted, docs, *names, broadcast_rows)
        links = cell_links(members, full, percent)
        for done in (members, wanted, full):
            drop_table(done)

        label = components(links if known is None else links.unionByName(known))
    own = label.withColumnRenamed("node", "__n")
    named = nodes.select("node", "id").join(own, F.col("node") == F.col("__n"), "left").select("node", "id", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = table(named.join(least, "comp").select("node", "component_id"), "components")
    out = sets.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
