"""SimHash near duplicates: BK-trees of fingerprints, one for each shard.

Fingerprints that differ in three bits at most agree in one of four quarters of the bits; so every distinct fingerprint
goes to four shards, named by a quarter's place and value, and meets all its partners there. A shard that outgrows a
tree is sharded again by quarters of the bits that are left, until it is small or so few bits are left that their number
bounds it. A shard's tree (children keyed by their Hamming distance to the parent) is built by the task that gets the
shard. Trees are broadcast while their bytes, which are counted, are within a bound, else they are dealt out by shard with
the fingerprints that ask. A search follows only edges within the radius of the distance to the node, and a task returns
links that join what it has found, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_table, nullable, ship_code, small_batches, small_by_bytes, table, tidy
from quarry.llm.linking import components

WORDS, RADIUS, SEED = 3, 3, 42
#: Members that a shard's tree may have before it is sharded again.
TREE = 512
#: With so few bits left a shard isn't split: it has 2 ** LEAST_BITS members at most.
LEAST_BITS = 15
#: Bytes of trees that are broadcast.
BROADCAST_BYTES = 32 << 20
#: Pairs of a node and a fingerprint that a search looks at together.
FRONTIER = 1 << 20


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a text's shingles of three words, repeats included; zero without words."""
    from xxhash import xxh64_intdigest

    # bytes.lower and bytes.split know ASCII letters and ASCII white space only, as the definition of words wants
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= WORDS:
        return xxh64_intdigest(b" ".join(words), SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, n) - 1).tolist()
    ends, joined, ones = (ends - 1).tolist(), b" ".join(words), np.zeros(64, np.int64)
    del words
    total = n - WORDS + 1
    for at in range(0, total, 65_536):
        upto = min(at + 65_536, total)
        h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at:upto], ends[at + WORDS - 1 : upto + WORDS - 1], strict=True)), np.uint64, upto - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column("t")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "fp": pa.array(fp.view(np.int64))})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(nullable(docs, id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(tidy(run), f"id {kind}, fp long")


def _free_parts(bits: int) -> list[int]:
    """Masks that leave out a quarter of the set bits each (the first quarters have one more if they don't come out even)."""
    at = [k for k in range(64) if bits >> k & 1]
    cut = np.array_split(np.array(at), RADIUS + 1)
    return [bits & ~sum(1 << int(k) for k in c) for c in cut]


def shards(fps: DataFrame, most: int = TREE) -> DataFrame:
    """(path, value, fp): members of each shard. path: the bits that are free in the shard; value: the fingerprint's others."""
    long = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")
    level, out, written = [(1 << 64) - 1], [], []
    rows = fps.withColumn("path", F.lit(-1).cast("long"))
    while True:
        below = {b: _free_parts(b) for b in level}
        split = F.create_map(*[x for b, parts in below.items() for x in (long(b), F.array(*map(long, parts)))])
        rows = rows.select("fp", F.explode(split[F.col("path")]).alias("path")).withColumn("value", F.col("fp").bitwiseAND(F.bitwise_not("path")))
        rows = table(rows, "shards")
        written.append(rows)
        level = sorted({p for parts in below.values() for p in parts})
        sizes = rows.groupBy("path", "value").count().filter("count > 1")  # nothing meets in a shard of one
        sizes = table(sizes.withColumn("big", (F.col("count") > most) & (F.bit_count("path") > LEAST_BITS)).select("path", "value", "big"), "sizes")
        written.append(sizes)
        rows = rows.join(sizes, ["path", "value"])
        out.append(rows.filter("NOT big").select("path", "value", "fp"))
        if sizes.filter("big").isEmpty():
            break
        rows = rows.filter("big").select("fp", "path")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    whole = table(whole, "members")
    for done in written:
        drop_table(done)
    return whole


def grow(tree: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees of sorted members: tree[i] is the member's tree. Returns each member's parent (its own place for a root, which is
    the first of its tree) and the distance to it. All trees grow together, a level at a time: what waits at a node with
    the same distance goes to one child, the first of them, and waits there."""
    n = len(fp)
    first = np.flatnonzero(np.append(True, tree[1:] != tree[:-1])) if n else np.zeros(0, np.int64)
    parent, edge = np.arange(n), np.zeros(n, np.int64)
    at = np.repeat(first, np.diff(np.append(first, n)))  # the node where a member waits
    wait = np.flatnonzero(at != np.arange(n))
    while len(wait):
        d = np.bitwise_count(fp[wait] ^ fp[at[wait]]).astype(np.int64)
        group = at[wait] * 65 + d
        order = np.argsort(group, kind="stable")
        new = np.append(True, group[order][1:] != group[order][:-1])
        child = wait[order][new]
        parent[child], edge[child] = at[child], d[order][new]
        at[wait[order]] = np.repeat(child, np.diff(np.append(np.flatnonzero(new), len(order))))
        at[child] = child
        wait = wait[at[wait] != wait]
    return parent, edge


def build_trees(members: DataFrame) -> DataFrame:
    """(path, value, fps, parents, edges, bytes): a tree in a row, its members as 64-bit numbers in ascending order, their parents
    as places in it, their edges' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fps")
            size = own.value_lengths().to_numpy().astype(np.int64)
            fp = own.flatten().to_numpy().view(np.uint64)
            starts = np.append(0, np.cumsum(size))
            parent, edge = grow(np.repeat(np.arange(len(size)), size), fp)
            parent = (parent - np.repeat(starts[:-1], size)).astype(np.int32)
            offsets = pa.array(starts.astype(np.int32))
            lists = {"fps": own, "parents": pa.ListArray.from_arrays(offsets, pa.array(parent)), "edges": pa.ListArray.from_arrays(offsets, pa.array(edge.astype(np.int8)))}
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "value": batch.column("value"), **lists, "bytes": pa.array(64 + 13 * size)})

    rows = members.groupBy("path", "value").agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # a shard's size is bounded
    return table(rows.mapInArrow(run, "path long, value long, fps array<long>, parents array<int>, edges array<tinyint>, bytes long"), "trees")


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least member of each group) after the groups of a[k] and b[k] are joined."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def search(fp: np.ndarray, parent: np.ndarray, edge: np.ndarray, query: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, member) pairs within the radius: each query goes down from the root start[k], and follows only edges whose key is
    within the radius of its distance to the node."""
    kids = np.flatnonzero(parent != np.arange(len(fp)))
    kids = kids[np.lexsort((edge[kids], parent[kids]))]
    key = parent[kids] * 65 + edge[kids]  # a node's children lie together, by key
    frontier = [(np.arange(len(query)), start)]
    while frontier:
        q, node = frontier.pop()
        if len(q) > FRONTIER:
            frontier += [(q[: len(q) // 2], node[: len(q) // 2]), (q[len(q) // 2 :], node[len(q) // 2 :])]
            continue
        d = np.bitwise_count(query[q] ^ fp[node]).astype(np.int64)
        hit = d <= RADIUS
        yield q[hit], node[hit]
        low = np.searchsorted(key, node * 65 + np.maximum(d - RADIUS, 0), side="left")
        many = np.searchsorted(key, node * 65 + np.minimum(d + RADIUS, 64), side="right") - low
        if many.any():
            place = np.repeat(low - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
            frontier.append((np.repeat(q, many), kids[place]))


def tree_links(members: DataFrame, trees: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(a, b): links between members of a tree, of which no two of a task's join the same groups of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("fps").value_lengths().to_numpy().astype(np.int64)
            starts = np.append(0, np.cumsum(size))
            fp = batch.column("fps").flatten().to_numpy().view(np.uint64)
            parent = batch.column("parents").flatten().to_numpy().astype(np.int64) + np.repeat(starts[:-1], size)
            edge = batch.column("edges").flatten().to_numpy().astype(np.int64)
            asks = batch.column("asks").value_lengths().to_numpy().astype(np.int64)
            query = batch.column("asks").flatten().to_numpy().view(np.uint64)
            tree = np.repeat(np.arange(len(size)), asks)
            cut, own, asked = np.append(0, np.cumsum(asks)), fp.view(np.int64), query.view(np.int64)
            # a query's own place among the members, which ascend as signed numbers
            me = np.concatenate([starts[k] + np.searchsorted(own[starts[k] : starts[k + 1]], asked[cut[k] : cut[k + 1]]) for k in range(len(size))] or [starts[:0]])
            label = np.arange(len(fp))
            for q, node in search(fp, parent, edge, query, starts[tree]):
                label = _joined(label, me[q], node)
            far = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_pydict({"a": pa.array(fp[far].view(np.int64)), "b": pa.array(fp[label[far]].view(np.int64))})

    asks = members.groupBy("path", "value").agg(F.collect_list("fp").alias("asks"))
    both = asks.join(small_by_bytes(trees, F.col("bytes"), limit), ["path", "value"]).select("fps", "parents", "edges", "asks")
    return table(both.mapInArrow(tidy(run), "a long, b long").distinct(), "links")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TREE, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A row per row of docs: <id>, fingerprint (16 hexadecimal digits), component_id.

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles are three words joined by spaces, repeats
    included, or the whole sequence of fewer words. A bit of a fingerprint is set if it is in over half of the shingles'
    XXH64 (seed 42). Null texts and texts without words have fingerprint zero, which links like any other. Fingerprints
    link if three bits at most differ; component_id is the smallest id that links reach, null if none of these has one.
    Rows of one id go by their own texts. Texts are read whole, however long. Other columns, whatever their names, are not
    looked at. No rows give no rows.
    """
    ship_code(docs.sparkSession)
    with small_batches(docs.sparkSession):
        own = table(fingerprints(docs, id_col, text_col), "fingerprints")
        distinct = table(own.groupBy("fp").agg(F.min("id").alias("id")), "distinct")
        members = shards(distinct.select("fp"), most)
        trees = build_trees(members)
        links = tree_links(members, trees, limit)
        for done in (members, trees):
            drop_table(done)
        label = components(links)
        drop_table(links)
    named = distinct.join(label, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("comp", "fp").alias("comp"))
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = table(named.join(least, "comp").select("fp", "component_id"), "components")
    for done in (distinct, label):
        drop_table(done)
    return own.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
