"""A sink of label images: rasters as rows become one PNG file a frame, each in one task; and crops of instances."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.archive import store_of

#: What a PNG file begins with, and its colour types: fixed values.
SIGNATURE, GREY, COLOUR = b"\x89PNG\r\n\x1a\n", 0, 2


def png(plane: np.ndarray) -> bytes:
    """The file of an image of bytes: (rows, columns) in grey, (rows, columns, 3) in colour."""

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    high, wide = plane.shape[:2]
    flat = np.ascontiguousarray(plane, np.uint8).reshape(high, -1)
    lines = np.concatenate([np.zeros((high, 1), np.uint8), flat], axis=1)  # no line is filtered
    head = struct.pack(">IIBBBBB", wide, high, 8, COLOUR if plane.ndim == 3 else GREY, 0, 0, 0)
    return SIGNATURE + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def encoded(pixels: DataFrame, *values: str) -> DataFrame:
    """(file, content) of pixels (file, y, x, and one column of bytes, or three: red, green, blue).

    A file's pixels must be a whole raster from (0, 0), each place once, and bytes; anything else raises. A task holds one
    raster.
    """
    if len(values) not in (1, 3):
        raise ValueError("an image has one value a pixel, or three")

    def run(t: pa.Table) -> pa.Table:
        name, y, x = t.column("file")[0].as_py(), t.column("y").to_numpy(), t.column("x").to_numpy()
        shape = (int(y.max()) + 1, int(x.max()) + 1)
        if y.min() < 0 or x.min() < 0 or shape[0] * shape[1] != len(y) or len(np.unique(y * shape[1] + x)) != len(y):
            raise ValueError(f"{name} isn't a whole raster: {len(y)} pixels for {shape}")
        plane = np.zeros((*shape, len(values)), np.uint8)
        for k, c in enumerate(values):
            v = t.column(c).to_numpy()
            if not (v >= 0).all() or v.max() > 255:
                raise ValueError(f"{name} has values beyond a byte")
            plane[y, x, k] = v
        return pa.table({"file": [name], "content": pa.array([png(plane if len(values) == 3 else plane[:, :, 0])], pa.binary())})

    rows = pixels.select("file", *(F.col(c).cast("long").alias(c) for c in ("y", "x", *values)))
    return rows.groupBy("file").applyInArrow(run, "file string, content binary")


def write_files(files: DataFrame, root: str) -> int:
    """Writes (file, content) under a folder, file being a path in it, and returns how many. A task writes each file under a name
    that readers pass over and renames it, so a file is there as a whole or not at all, and a task that is run again
    replaces what it wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                folder, _, last = f"{base}/{name}".rpartition("/")
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(f"{folder}/.{last}-{attempt}") as out:
                    out.write(content)
                store.move(f"{folder}/.{last}-{attempt}", f"{folder}/{last}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return files.select("file", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def crops(instances: DataFrame, pixels: DataFrame, least_side: int = 8, key: str = "image_id") -> DataFrame:
    """instance, key, y, x and pixels' other columns: the pixels (key, y, x, ...) in each instance's box, numbered from the
    box's corner.

    instances: instance, key, bbox (x, y, width, height). Boxes are cut to whole numbers, begin at 0 or later and are a pixel
    wide and high or more; crops with fewer rows or columns than least_side, as where a box leaves its image, are left out.
    The join is by key, so each image meets its own boxes only.
    """
    at = [F.element_at("bbox", k).cast("int") for k in (1, 2, 3, 4)]
    box = instances.select("instance", key, *(F.greatest(F.lit(low), c).alias(n) for low, c, n in zip((0, 0, 1, 1), at, ("__x", "__y", "__w", "__h"), strict=True)))
    inside = (F.col("x") >= F.col("__x")) & (F.col("x") < F.col("__x") + F.col("__w")) & (F.col("y") >= F.col("__y")) & (F.col("y") < F.col("__y") + F.col("__h"))
    rows = pixels.join(box, key).filter(inside)
    rows = rows.withColumn("y", F.col("y") - F.col("__y")).withColumn("x", F.col("x") - F.col("__x")).drop("__x", "__y", "__w", "__h")
    large = rows.groupBy("instance").agg(F.max("y").alias("h"), F.max("x").alias("w")).filter((F.col("h") + 1 >= least_side) & (F.col("w") + 1 >= least_side))
    return rows.join(large.select("instance"), "instance", "left_semi")
