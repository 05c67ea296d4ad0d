"""Vectors as 16 codes of a byte: product quantisation in whole numbers, screened in float32.

A part's nearest entry is looked for with a float32 matrix product and an interval around each value that the true
distance can't leave, whatever the order of summation. Where one entry's interval lies below all others, it is the
nearest; else the distances of all entries whose interval overlaps the best are worked out in int64. So codes don't
depend on hardware, batch sizes or partitions.

Every round is one pass: tasks add up their own parts by entry, and an aggregate adds up tasks. Codebooks have a fixed
size (parts x entries x components of a part) and travel inside the function.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import nullable, ship_code, small_by_bytes, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows whose parts are compared at once.
ROWS = 4_096
#: Sums of errors by label are broadcast up to so many bytes, beyond that the vectors are shuffled by label.
BROADCAST_BYTES = 16 << 20
_U = 2.0**-24  # unit roundoff of float32


def usable(vector: Column) -> Column:
    """Whether a vector is there, without null or non-finite components."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_numbers(column: pa.Array, length: int, parts: int) -> np.ndarray:
    """(rows, parts, components) of floor(256 * x) in int64; components are filled up with zeros to a multiple of parts."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    x = np.floor(flat * SCALE)
    most = 2.0 ** ((62 - int(length).bit_length()) / 2 - 1)
    if len(x) and np.abs(x).max(initial=0) > most:
        raise ValueError(f"a component is beyond {most / SCALE:.0f}: squared distances wouldn't fit in 64 bits")
    wide = -(-length // parts) * parts
    out = np.zeros((len(x), wide), np.int64)
    out[:, :length] = x
    return out.reshape(len(x), parts, wide // parts)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of each row of x in book, both int64, ties to the lower index, and how many rows the
    float32 screening left open."""
    d = x.shape[1]
    gamma = (d + 3) * _U / (1 - (d + 3) * _U)  # of a product of d terms with both factors rounded
    cc = (book.astype(np.float64) ** 2).sum(axis=1)
    xn, cn = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12), np.sqrt(cc) * (1 + 1e-12)
    product = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    value = cc - 2 * product  # the squared distance, less the part's own square
    radius = 2 * gamma * np.outer(xn, cn) + 2.0**-48 * (cc + np.outer(xn, cn)) + 1e-30
    open_ = value - radius <= (value + radius).min(axis=1)[:, None]
    at = open_.argmax(axis=1)
    unsure = np.flatnonzero(open_.sum(axis=1) > 1)
    if len(unsure):
        row, entry = np.nonzero(open_[unsure])
        exact = ((x[unsure[row]] - book[entry]) ** 2).sum(axis=1)
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        best = np.repeat(np.minimum.reduceat(exact, starts), np.diff(np.append(starts, len(row))))
        hit = np.flatnonzero(exact == best)  # entries ascend within a row, so the first hit is the lowest index
        at[unsure] = entry[hit[np.unique(row[hit], return_index=True)[1]]]
    return at, ((x - book[at]) ** 2).sum(axis=1), len(unsure)


def _slices(batches: Iterator[pa.RecordBatch], length: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            own = batch.slice(k, ROWS)
            yield own, whole_numbers(own.column("v"), length, parts)


def sums(rows: DataFrame, books: np.ndarray, length: int) -> DataFrame:
    """(part, entry, at, total, n): the components of the parts nearest to each entry, added up."""
    parts, entries, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        most = room = 0  # totals are handed on before they can overflow

        def out() -> pa.RecordBatch:
            p, e = np.nonzero(count)
            return pa.RecordBatch.from_pydict({"part": pa.array(np.repeat(p, wide)), "entry": pa.array(np.repeat(e, wide)), "at": pa.array(np.tile(np.arange(wide), len(p))), "total": pa.array(total[p, e].reshape(-1)), "n": pa.array(np.repeat(count[p, e], wide))})

        for _, x in _slices(batches, length, parts):
            most, room = max(most, int(np.abs(x).max(initial=0))), room + len(x)
            if most * room >= 1 << 62:
                yield out()
                total[:], count[:], room = 0, 0, len(x)
            for p in range(parts):
                at, _, _ = nearest(x[:, p], books[p])
                np.add.at(total[p], at, x[:, p])
                count[p] += np.bincount(at, minlength=entries)
        yield out()

    got = rows.select("v").mapInArrow(run, "part long, entry long, at long, total long, n long")
    return got.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def codebooks(rows: DataFrame, first: np.ndarray, length: int, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, component) after some rounds from the first ones; unused entries stay as they are."""
    books = first
    for _ in range(rounds):
        books = books.copy()
        for r in sums(rows, books, length).collect():  # parts x entries x components at most, whatever the number of rows
            books[r.part, r.entry, r["at"]] = int(r.total) // r.n
    return books


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """A row per usable vector: <id>, code, error, label_error, codebooks_sha256.

    Dropped are vectors that are null, hold null or non-finite components, or have another length than the vector with
    the smallest id (so does nothing at all if that is empty). Components become floor(256 * x); a length that isn't a
    multiple of parts is filled up with zeros. The first codebooks are the vectors of the `entries` smallest ids (nulls
    last, rows of one id by their vectors; with fewer vectors there are fewer entries). Rows of one id are coded each by
    its own vector. code: the entries' indexes in hexadecimal digits, error: the squared distances added up, label_error:
    errors added up over rows of equal label, nulls together. Components so large that distances don't fit in 64 bits
    raise an error. Other columns, whatever their names, are not looked at. No rows give no rows.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    rows = vectors.select(nullable(vectors, id_col).alias("id"), F.col(vector_col).alias("v"), nullable(vectors, label_col).alias("label")).filter(usable(F.col("v")))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    shape = f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").first()
    length = len(first.v) if first else 0
    if not length:
        out = spark.createDataFrame([], f"{shape}, label_error long, codebooks_sha256 string")
        return out.select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")
    rows = rows.filter(F.size("v") == length)
    seeds = [r.v for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()]  # `entries` rows
    books = codebooks(rows, whole_numbers(pa.array(seeds, pa.list_(pa.float64())), length, parts).transpose(1, 0, 2), length, rounds)
    real = [min(max(length - p * books.shape[2], 0), books.shape[2]) for p in range(parts)]  # components that aren't filled up
    digest = hashlib.sha256(",".join(str(int(x)) for p in range(parts) for e in books[p] for x in e[: real[p]]).encode()).hexdigest()
    digits = np.array([f"{k:02x}" for k in range(books.shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _slices(batches, length, parts):
            code, error = [], np.zeros(len(x), np.int64)
            for p in range(parts):
                at, d, _ = nearest(x[:, p], books[p])
                code.append(digits[at])
                error += d
            joined = ["".join(c) for c in zip(*code, strict=True)]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "label": batch.column("label"), "code": pa.array(joined, pa.string()), "error": pa.array(error)})

    coded = table(rows.mapInArrow(run, shape), "codes")
    by_label = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    by_label = small_by_bytes(by_label, F.coalesce(F.length(F.col("l").cast("string")), F.lit(0)) + 32, BROADCAST_BYTES)
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("l")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
