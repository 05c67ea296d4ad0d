"""Vector operators: memory banks, nearest neighbours, Mahalanobis distances."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Bytes of vectors in a block of a bank and of queries, and queries whose cosines with a cell are worked out together.
BLOCK_BYTES, QUERY_BYTES, QUERIES_AT_ONCE = 1 << 20, 1 << 22, 1024
#: Bytes of a bank that are broadcast at once.
BANK_BYTES = 256 << 20


def bank(vectors: DataFrame, frame: str, order: Column, per_frame: int = 400, most: int = 1_000_000) -> DataFrame:
    """A memory bank: per_frame vectors of each frame in a pseudo-random order, early frames first, `most` in all. Where the
    bank ends is told from the frames' counts; no vectors are sorted across frames."""
    at = F.row_number().over(Window.partitionBy(frame).orderBy(order))
    kept = vectors.withColumn("at", at).filter(F.col("at") <= per_frame)
    counts = kept.groupBy(F.col(frame).alias("__f")).agg(F.count("*").alias("__n"))
    # a row per frame
    counts = counts.select("__f", (F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__f")) - F.col("__n")).alias("__before"))
    return kept.join(counts, F.col(frame).eqNullSafe(F.col("__f"))).filter(F.col("__before") + F.col("at") <= most).drop("at", "__f", "__before")


def write_bank(vectors: DataFrame, path: str) -> None:
    """Keeps a bank, so that later runs needn't build it; spark.read.parquet reads it."""
    vectors.write.mode("overwrite").parquet(path)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an array column, as a view of its values."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _in_cells(batch: pa.RecordBatch, by: list[str]) -> Iterator[pa.RecordBatch]:
    """A batch's rows by equal `by`, and within these by cells of near vectors: each row goes to the nearest of some of them."""
    names = [tuple(x.values()) for x in batch.select(by).to_pylist()] if by else [()] * batch.num_rows
    for name in dict.fromkeys(names):
        own = batch.filter(pa.array([x == name for x in names])) if by else batch
        v = _matrix(own.column("embedding")).astype(np.float64)
        cell = (v @ v[np.linspace(0, len(v) - 1, max(1, math.isqrt(len(v)))).astype(int)].T).argmax(axis=1)
        order = np.argsort(cell, kind="stable")
        yield own.take(pa.array(order)).append_column("__cell", pa.array(cell[order].astype(np.int32)))


def _packed(rows: DataFrame, name: str, size: int, cells: list[str] | None = None) -> DataFrame:
    """rows in blocks: one binary value for every `size` bytes of vectors, with cells in cells of near vectors. Rows aren't moved
    for that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = max(1, len(batch.column("embedding").flatten()) // batch.num_rows)
            step = max(1, size // (8 * width))
            for part in [batch] if cells is None else _in_cells(batch, cells):
                for a in range(0, part.num_rows, step):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as out:
                        out.write_batch(part.slice(a, step))
                    yield pa.RecordBatch.from_pydict({name: pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return rows.mapInArrow(run, f"{name} binary")


def _cells(block: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """The cells of a block: vectors, their centre of length one, and the largest angle between the centre and one of them."""
    v, cell = _matrix(block.column("embedding")).astype(np.float64), block.column("__cell").to_numpy()
    out = []
    for own in np.split(v, np.flatnonzero(cell[1:] != cell[:-1]) + 1):
        centre = own.mean(axis=0)
        length = np.linalg.norm(centre)
        centre = centre / length if length > 1e-9 else own[0]
        out.append((own, centre, float(np.arccos(np.clip((own @ centre).min(), -1, 1)))))
    return out


class _Best:
    """The k largest cosines so far of a block of queries, for each bank."""

    def __init__(self, block: pa.RecordBatch, k: int) -> None:
        self.block, self.k, self.q, self.top = block, k, _matrix(block.column("embedding")).astype(np.float64), {}

    def meet(self, name: tuple, cells: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[int, int]:
        """Looks at some cells; returns how many pairs of a query and a cell there are, and how many were skipped: by the
        triangle inequality of angles a cell has no vector nearer than its centre's angle less its radius."""
        top = self.top.setdefault(name, np.full((len(self.q), self.k), -np.inf))
        skipped = 0
        for own, centre, radius in cells:
            angle = np.arccos(np.clip(self.q @ centre, -1, 1)) - radius
            open_ = np.flatnonzero(np.cos(np.maximum(angle, 0)) + 1e-9 >= top[:, -1])
            skipped += len(self.q) - len(open_)
            for a in range(0, len(open_), QUERIES_AT_ONCE):
                some = open_[a : a + QUERIES_AT_ONCE]
                both = np.concatenate([top[some], self.q[some] @ own.T], axis=1)
                top[some] = -np.sort(-np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :], axis=1)
        return len(self.q) * len(cells), skipped


def top_cosines(queries: DataFrame, bank: DataFrame, k: int, key: list[str], by: list[str] | None = None, bank_bytes: int | None = None, limit: int = BANK_BYTES, seen: Accumulator | None = None, skipped: Accumulator | None = None) -> DataFrame:
    """key, by, sims (the k largest cosines with the bank's vectors, descending) for unit vectors `embedding`.

    Queries and bank are packed into blocks; the bank's in cells of near vectors. The bank is broadcast: so a block of queries
    meets all of it in one task, skips the cells that can't hold one of its k best, and hands on its k best only. bank_bytes:
    what the bank takes at most, where the caller knows; else it is counted. A bank over `limit` bytes is cut into so many parts,
    each broadcast by itself, and the k best of the parts are merged. by: columns of the bank that keep banks apart. seen and
    skipped count pairs of a query and a cell.
    """
    by = by or []
    bank = bank.select(*by, "embedding")
    if bank_bytes is None:
        bank_bytes = bank.agg(F.sum(8 * F.size("embedding").cast("long") + 64)).first()[0] or 0
    parts = max(1, -(-bank_bytes // limit))
    schema = T.StructType([*(queries.schema[c] for c in key), *(bank.schema[c] for c in by), T.StructField("sims", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)
    load = lambda x: pa.ipc.open_stream(x.as_buffer()).read_all().combine_chunks().to_batches()[0]

    def out(best: _Best | None) -> Iterator[pa.RecordBatch]:
        for name, top in best.top.items() if best else ():
            top = top[:, np.isfinite(top[0])]  # a bank may have fewer than k vectors
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(top) + 1, dtype=np.int32) * top.shape[1]), pa.array(top.ravel()))
            columns = [*(best.block.column(c) for c in key), *(pa.array([x] * len(top), arrow.field(c).type) for c, x in zip(by, name, strict=True)), lists.cast(arrow.field("sims").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        for batch in batches:
            for name, left, right in zip(batch.column("at").to_pylist(), batch.column("q"), batch.column("b"), strict=True):
                if name != at:
                    yield from out(best)
                    at, best = name, _Best(load(left), k)
                block = load(right)
                pairs, left_out = best.meet(tuple(block.slice(0, 1).select(by).to_pylist()[0].values()) if by else (), _cells(block))
                if seen is not None:
                    seen.add(pairs)
                    skipped.add(left_out)
        yield from out(best)

    packed = _packed(queries.select(*key, "embedding"), "q", QUERY_BYTES).withColumn("at", F.monotonically_increasing_id())
    found = None
    for part in range(parts):
        own = bank if parts == 1 else bank.filter(F.pmod(F.xxhash64("embedding"), F.lit(parts)) == part)
        # all blocks of the bank follow a block of queries, which is streamed
        one = packed.crossJoin(F.broadcast(_packed(own, "b", BLOCK_BYTES, by))).mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    if parts == 1:
        return found
    best = F.slice(F.sort_array(F.flatten(F.collect_list("sims")), asc=False), 1, k)  # as many lists as parts
    return found.groupBy(*key, *by).agg(best.alias("sims"))


def knn_scores(found: DataFrame, ks: list[int]) -> DataFrame:
    """found with a column cdnp_<k> for each k: one minus the mean of the k largest cosines."""
    for k in ks:
        top = F.slice("sims", 1, k)
        found = found.withColumn(f"cdnp_{k}", 1 - F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top))
    return found.drop("sims")


def class_moments(vectors: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(label, i, n, mean) and (i, j, cov): class means and the pooled covariance. A task adds up its vectors' products as
    matrices and hands on as many rows as the matrix has places, whatever the number of vectors."""
    schema = T.StructType([T.StructField("label", vectors.schema[label].dataType), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("x", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        second, total = 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v, own = _matrix(batch.column("embedding")).astype(np.float64), batch.column("label").to_pylist()
            second, total = second + v.T @ v, total + len(v)
            for name in dict.fromkeys(own):
                mine = v[[x == name for x in own]]
                n, before = sums.get(name, (0, 0.0))
                sums[name] = n + len(mine), before + mine.sum(axis=0)
        if not total:
            return
        d = len(second)
        i, j = np.indices((d, d), np.int32)
        # rows without j are sums of a class, the others products of all
        for name, (n, value) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * d, arrow.field("label").type), pa.array(np.arange(d, dtype=np.int32)), pa.nulls(d, pa.int32()), pa.array([n] * d, pa.int64()), pa.array(value)], schema=arrow)
        yield pa.RecordBatch.from_arrays([pa.nulls(d * d, arrow.field("label").type), pa.array(i.ravel()), pa.array(j.ravel()), pa.array([total] * (d * d), pa.int64()), pa.array(second.ravel())], schema=arrow)

    parts = vectors.select(F.col(label).alias("label"), "embedding").mapInArrow(run, schema)
    means = parts.filter("j IS NULL").groupBy("label", "i").agg(F.sum("n").alias("n"), (F.sum("x") / F.sum("n")).alias("mean"))
    second = parts.filter("j IS NOT NULL").groupBy("i", "j").agg(F.sum("x").alias("sxy"), F.sum("n").alias("total"))
    a, b = means.select("label", "i", "n", F.col("mean").alias("mi")), means.select("label", F.col("i").alias("j"), F.col("mean").alias("mj"))
    between = a.join(b, a["label"].eqNullSafe(b["label"])).groupBy("i", "j").agg(F.sum(F.col("n") * F.col("mi") * F.col("mj")).alias("b"))
    return means, second.join(between, ["i", "j"]).select("i", "j", ((F.col("sxy") - F.col("b")) / F.col("total")).alias("cov"))


def mahalanobis(queries: DataFrame, means: DataFrame, cov: DataFrame, key: list[str], ridge: float = 1e-6) -> DataFrame:
    """key, score: the least squared Mahalanobis distance to a class mean. The matrix has one row and column per
    dimension, so it goes to the driver to be inverted."""
    c = cov.toPandas()
    d = int(c["i"].max()) + 1
    s = np.zeros((d, d))
    s[c["i"], c["j"]] = c["cov"]
    s += ridge * np.diag(s).mean() * np.eye(d)
    inverse = np.linalg.inv(s)
    m = means.toPandas().pivot(index="label", columns="i", values="mean").to_numpy()
    schema = ", ".join([*(f"{k} {queries.schema[k].dataType.simpleString()}" for k in key), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding")).astype(np.float64)
                diff = x[:, None, :] - m[None]
                score = np.einsum("qcd,de,qce->qc", diff, inverse, diff).min(axis=1)
                yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in key} | {"score": score})

    return queries.select(*key, "embedding").mapInArrow(run, schema)
