"""Score archives as a data source: arrays of [frame, y, x] in compressed archives, read by ranges of frames and written with a
commit.

Reading: a partition is a range of frames of one archive, so that a large archive is read by many tasks, each of which goes
through the compressed stream up to its own frames and holds one frame at a time. Archives may be of any size.

Writing: a task writes archives of its own frames under names that readers pass over; the driver's commit gives them their
names, and an abort removes them. An archive that this sink wrote names its frames in a further array.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "score_archive"
SCHEMA = "frame_id long, y int, x int, label_key int, score float"
KEYS, FRAMES = "keys", "frame_ids"
#: Bytes of scores that a reading task takes about, and frames that a written archive has at most.
TASK_BYTES, FRAMES_AT_ONCE = 64 << 20, 256
PENDING = ".pending"


def store_of(path: str) -> tuple:
    """The file system of an address or a local path, and the path in it."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file://"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


def _archives(path: str) -> list[str]:
    """The archives of a folder in order, or the one that path is."""
    from pyarrow import fs

    store, base = store_of(path)
    found = store.get_file_info(base)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no archive at {path}")
    if found.type == fs.FileType.File:
        return [base]
    return sorted(x.path for x in store.get_file_info(fs.FileSelector(base)) if x.path.endswith(".npz"))


def _header(member: io.BufferedIOBase) -> tuple[tuple[int, ...], np.dtype]:
    """Shape and type of an array, whose values come next."""
    version = np.lib.format.read_magic(member)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"array format {version} isn't known")
    shape, by_columns, dtype = read(member)
    if by_columns and len(shape) > 1:
        raise ValueError("arrays by columns can't be read by frames")
    if dtype.hasobject:
        raise ValueError("arrays of objects aren't read")
    return shape, dtype


def _skip(member: io.BufferedIOBase, size: int) -> None:
    while size > 0:
        got = len(member.read(min(size, 1 << 20)))
        if not got:
            raise ValueError("an array ends before its last frame")
        size -= got


def _frame(member: io.BufferedIOBase, shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
    size = dtype.itemsize * int(np.prod(shape))
    data = member.read(size)
    if len(data) < size:
        raise ValueError("an array ends before its last frame")
    return np.frombuffer(data, dtype).reshape(shape)


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.method, self.task_bytes = options["path"], options["method"], int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[Range]:
        """Looks at the arrays' headers only; arrays of different shapes raise."""
        out, store = [], store_of(self.path)[0]
        for path in _archives(self.path):
            with store.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
                shapes = {}
                for name in (KEYS, self.method):
                    if f"{name}.npy" not in z.namelist():
                        raise ValueError(f"{path} has no array {name}")
                    with z.open(f"{name}.npy") as member:
                        shapes[name] = _header(member)
            (keys, _), (scores, dtype) = shapes.values()
            if keys != scores or len(keys) != 3:
                raise ValueError(f"{path}: {KEYS} {keys} and {self.method} {scores} must be of one shape [frame, y, x]")
            step = max(1, self.task_bytes // max(1, dtype.itemsize * keys[1] * keys[2]))
            out += [Range(path, a, min(a + step, keys[0])) for a in range(0, keys[0], step)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:
            return
        store = store_of(self.path)[0]
        with store.open_input_file(partition.archive) as a, store.open_input_file(partition.archive) as b, zipfile.ZipFile(a) as za, zipfile.ZipFile(b) as zb:
            ids = None
            if f"{FRAMES}.npy" in za.namelist():
                with za.open(f"{FRAMES}.npy") as member:
                    (n,), dtype = _header(member)
                    ids = np.frombuffer(member.read(), dtype)
                    if len(ids) != n:
                        raise ValueError("an array ends before its last frame")
            with za.open(f"{KEYS}.npy") as keys, zb.open(f"{self.method}.npy") as scores:
                heads = [_header(m) for m in (keys, scores)]
                for m, (shape, dtype) in zip((keys, scores), heads, strict=True):
                    _skip(m, partition.start * dtype.itemsize * shape[1] * shape[2])
                y, x = (v.ravel() for v in np.indices(heads[0][0][1:], np.int32))
                for f in range(partition.start, partition.stop):
                    k, s = (_frame(m, shape[1:], dtype) for m, (shape, dtype) in zip((keys, scores), heads, strict=True))
                    frame = f if ids is None else int(ids[f])
                    yield pa.RecordBatch.from_pydict({"frame_id": np.full(s.size, frame, np.int64), "y": y, "x": x, "label_key": k.ravel().astype(np.int32), "score": s.ravel().astype(np.float32)})


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    """Rows come by frame, a frame in one task."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.method, self.run, self.overwrite = options["path"].rstrip("/"), options["method"], options.get("run", uuid.uuid4().hex), overwrite
        self.at_once, self.dtype = int(options.get("frames", FRAMES_AT_ONCE)), options.get("dtype", "float16")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, base = store_of(self.path)
        store.create_dir(base, recursive=True)
        ctx, names, held, rows = TaskContext.get(), [], [], []

        def put() -> None:
            """The frames held, which have one shape, as an archive that readers pass over."""
            if not held:
                return
            name = f"{base}/{self.run}-{ctx.partitionId():05d}-{ctx.taskAttemptId():06d}-{len(names):04d}.npz{PENDING}"
            names.append(name)
            with store.open_output_stream(name) as out:
                # the container writes member by member, so only the frames held are in memory
                np.savez_compressed(_Sequential(out), **{KEYS: np.stack([k for _, k, _ in held]), self.method: np.stack([s for _, _, s in held]), FRAMES: np.array([f for f, _, _ in held], np.int64)})
            held.clear()

        def close() -> None:
            """The frame whose rows have all come."""
            if not rows:
                return
            t = pa.Table.from_batches(rows)
            rows.clear()
            frame, y, x = t.column("frame_id")[0].as_py(), t.column("y").to_numpy(), t.column("x").to_numpy()
            shape = (int(y.max()) + 1, int(x.max()) + 1)
            if y.min() < 0 or x.min() < 0 or shape[0] * shape[1] != len(y) or len(np.unique(y.astype(np.int64) * shape[1] + x)) != len(y):
                raise ValueError(f"frame {frame} isn't a whole raster: {len(y)} pixels for {shape}")
            keys, scores = np.zeros(shape, np.uint8), np.zeros(shape, self.dtype)
            label = t.column("label_key").to_numpy()
            if label.min() < 0 or label.max() > 255:
                raise ValueError(f"frame {frame} has label keys beyond a byte")
            keys[y, x], scores[y, x] = label, t.column("score").to_numpy()
            if held and (held[0][1].shape != shape or len(held) >= self.at_once):
                put()
            held.append((frame, keys, scores))

        for batch in batches:
            frame = batch.column("frame_id").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(frame[1:] != frame[:-1]) + 1).tolist(), len(frame)] if len(frame) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if rows and rows[0].column("frame_id")[0].as_py() != frame[a]:
                    close()
                rows.append(batch.slice(a, b - a))
        close()
        put()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = store_of(self.path)
        store.create_dir(base, recursive=True)
        names = [n for m in messages if m for n in m.names]
        old = [x.path for x in store.get_file_info(fs.FileSelector(base)) if x.path.endswith(".npz")] if self.overwrite else []
        for n in names:
            store.move(n, n.removesuffix(PENDING))
        for n in old:
            store.delete_file(n)
        self._sweep(store, base)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = store_of(self.path)
        self._sweep(store, base)

    def _sweep(self, store: object, base: str) -> None:
        """Removes what this run's tasks left behind, also those that failed or were run twice."""
        from pyarrow import fs

        if store.get_file_info(base).type == fs.FileType.Directory:
            for x in store.get_file_info(fs.FileSelector(base)):
                if x.path.endswith(PENDING) and x.base_name.startswith(self.run):
                    store.delete_file(x.path)


class _Sequential(io.RawIOBase):
    """A stream without seeking, for stores that append only."""

    def __init__(self, out: object) -> None:
        super().__init__()
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data: bytes) -> int:
        self.out.write(bytes(data))
        return len(data)


class ScoreArchive(DataSource):
    """Options: path (an archive, or a folder of them), method (the scores' array); reading: taskBytes; writing: frames (of an
    archive at most), dtype."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ScoreArchive)


def read_archive(spark: SparkSession, path: str, method: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """frame_id, y, x, label_key, score from the arrays `keys` and `method` of an archive or a folder of archives; frames are
    numbered by place unless the archive names them. Missing arrays and different shapes raise."""
    register(spark)
    return spark.read.format(NAME).options(path=path, method=method, taskBytes=str(task_bytes)).load()


def write_archive(scores: DataFrame, path: str, method: str, frames: int = FRAMES_AT_ONCE, dtype: str = "float16", mode: str = "overwrite") -> None:
    """frame_id, y, x, label_key, score into archives in a folder. Frames are whole rasters from (0, 0), may differ in shape, and
    go to one task each; what a failed job has written is removed, and readers see all of a run's archives or none of a
    task's half-written ones."""
    register(scores.sparkSession)
    kinds = {"frame_id": "long", "y": "int", "x": "int", "label_key": "int", "score": "float"}
    rows = scores.select(*(scores[c].cast(k).alias(c) for c, k in kinds.items()))
    rows = rows.repartition("frame_id").sortWithinPartitions("frame_id", "y", "x")
    rows.write.format(NAME).mode(mode).options(path=path, method=method, frames=str(frames), dtype=dtype).save()
