"""Fits that follow a stream: class moments as keyed state, and thresholds from versioned histograms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state of this kind needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_SUMS = "n long, sum array<double>, second array<double>"


# --- class moments ---


class _Sums(StatefulProcessor):
    """Of a class: how many vectors there were, their sum and the sum of their products, as a matrix by rows."""

    def __init__(self, label: str) -> None:
        self.label = label

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", _SUMS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n, total, second = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0)
        total, second = np.asarray(total), np.asarray(second)
        for pdf in rows:
            n += int(pdf["n"].sum())
            total, second = total + np.sum(np.stack(pdf["sum"].to_list()), axis=0), second + np.sum(np.stack(pdf["second"].to_list()), axis=0)
        self.sums.update((n, total.tolist(), second.tolist()))
        yield pd.DataFrame({self.label: [key[0]], "n": [n], "sum": [total.tolist()], "second": [second.tolist()]})

    def close(self) -> None:
        pass


def moment_stream(vectors: DataFrame, label: str) -> DataFrame:
    """A stream of label, n, sum, second: after each batch the sums of the classes that it touched, over all batches so far.

    vectors: a stream with the label and `embedding`. Tasks add up their vectors by class first, so that a class's state gets
    a row per task, however many of the vectors are its own.
    """
    kind = vectors.schema[label].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            own = batch.column(label).to_pylist()
            for name in dict.fromkeys(own):
                mine = v[[x == name for x in own]]
                n, total, second = sums.get(name, (0, 0.0, 0.0))
                sums[name] = n + len(mine), total + mine.sum(axis=0), second + mine.T @ mine
        for name, (n, total, second) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name], batch.schema.field(label).type), pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([second.ravel().tolist()], pa.list_(pa.float64()))], [label, "n", "sum", "second"])

    shape = f"`{label}` {kind}, {_SUMS}"
    parts = vectors.select(label, "embedding").mapInArrow(run, shape)
    return parts.groupBy(label).transformWithStateInPandas(_Sums(label), shape, "Update", "None")


def follow_moments(vectors: DataFrame, label: str, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps what moment_stream tells in a folder, by batch; a batch that is run again replaces what it wrote."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    out = moment_stream(vectors, label).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (out.trigger(availableNow=True) if available_now else out).start()


def current_moments(spark: SparkSession, path: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(label, i, n, mean) and (i, j, cov), as class_moments gives them for all vectors that the stream has seen."""
    rows = spark.read.parquet(path).groupBy(label).agg(F.max_by(F.struct("n", "sum", "second"), "batch").alias("s")).select(F.col(label).alias("label"), "s.*")
    means = rows.select("label", "n", F.posexplode("sum").alias("i", "x")).select("label", "i", "n", (F.col("x") / F.col("n")).alias("mean"))
    # of each class its scatter, with as many rows as the matrix has places
    within = F.transform("second", lambda x, at: x - F.element_at("sum", F.floor(at / F.size("sum")).cast("int") + 1) * F.element_at("sum", (at % F.size("sum")).cast("int") + 1) / F.col("n"))
    places = rows.select("n", F.size("sum").alias("d"), F.posexplode(within).alias("at", "x"))
    cov = places.groupBy(F.floor(F.col("at") / F.col("d")).cast("int").alias("i"), (F.col("at") % F.col("d")).cast("int").alias("j")).agg((F.sum("x") / F.sum("n")).alias("cov"))
    return means, cov


# --- thresholds ---


def thresholds_of(histogram: DataFrame, cls: str, width: float, alpha: float = 0.05, least: int = 100) -> DataFrame:
    """cls, tau, n of counts (cls, bin, n) in bins of a width: the upper end of the bin that holds the conformal quantile, so at
    most a width over it; classes of fewer than `least` rows, and the row without a class, have that of all rows together.
    Infinite where there are too few rows."""
    by = Window.partitionBy("__one", "__c")
    both = histogram.select(F.lit(0).alias("__one"), F.col(cls).alias("__c"), "bin", "n").unionByName(histogram.select(F.lit(1).alias("__one"), F.lit(None).cast(histogram.schema[cls].dataType).alias("__c"), "bin", "n"))
    both = both.groupBy("__one", "__c", "bin").agg(F.sum("n").alias("n")).withColumn("all", F.sum("n").over(by)).withColumn("upto", F.sum("n").over(by.orderBy("bin")))
    k = F.ceil((F.col("all") + 1) * F.lit(1 - alpha))
    tau = F.coalesce(F.min(F.when(F.col("upto") >= k, (F.col("bin") + 1) * F.lit(float(width)))), F.lit(float("inf")))
    each = both.groupBy("__one", "__c").agg(tau.alias("tau"), F.max("all").alias("n"))
    every = each.filter("__one = 1").select(F.col("tau").alias("tau_all"))
    out = each.filter("__one = 0 OR __c IS NULL").crossJoin(F.broadcast(every))
    return out.select(F.col("__c").alias(cls), F.when((F.col("__one") == 1) | (F.col("n") >= least), F.col("tau")).otherwise(F.col("tau_all")).alias("tau"), "n", (F.col("__one") == 1).alias("every"))


class LiveThresholds:
    """Flags a stream by thresholds of what came before, and keeps them current.

    For batch b, version b - 1 of the histograms gives the thresholds, which flag the batch's rows; then the batch's calibration
    rows are added and make version b. Flags and versions are folders by batch, which a batch that is run again writes
    once more from the same version: so each row counts and is flagged once, and in the same way. Rows are flagged strictly
    over their class's threshold; before any version there is none to go over.
    """

    def __init__(self, path: str, cls: str, calibrates: Callable[[], Column], score: str = "score", width: float = 0.01, alpha: float = 0.05, least: int = 100) -> None:
        self.path, self.cls, self.calibrates, self.score, self.width, self.alpha, self.least = path, cls, calibrates, score, width, alpha, least

    def histogram(self, spark: SparkSession, version: int, like: DataFrame) -> DataFrame:
        if version < 0:
            return spark.createDataFrame([], f"{self.cls} {like.schema[self.cls].dataType.simpleString()}, bin long, n long")
        return spark.read.parquet(f"{self.path}/histograms/version={version}")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before = self.histogram(spark, batch - 1, rows)
        thresholds = thresholds_of(before, self.cls, self.width, self.alpha, self.least)
        own = F.broadcast(thresholds.filter("NOT every").select(F.col(self.cls).alias("__c"), F.col("tau").alias("__own")))  # a row per class
        every = F.broadcast(thresholds.agg(F.max(F.when(F.col("every"), F.col("tau"))).alias("__every")))
        flagged = rows.join(own, F.col(self.cls).eqNullSafe(F.col("__c")), "left").crossJoin(every)
        flagged = flagged.withColumn("tau", F.coalesce("__own", "__every", F.lit(float("inf")))).drop("__c", "__own", "__every")
        flagged = flagged.withColumn("flag", F.col(self.score) > F.col("tau")).withColumn("version", F.lit(batch - 1))
        flagged.write.mode("overwrite").parquet(f"{self.path}/flags/batch={batch}")
        counts = rows.filter(self.calibrates()).groupBy(self.cls, F.floor(F.col(self.score) / self.width).alias("bin")).agg(F.count("*").alias("n"))
        now = before.unionByName(counts).groupBy(self.cls, "bin").agg(F.sum("n").alias("n"))
        now.write.mode("overwrite").parquet(f"{self.path}/histograms/version={batch}")

    def follow(self, rows: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        out = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self)
        return (out.trigger(availableNow=True) if available_now else out).start()

    def flags(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/flags")
