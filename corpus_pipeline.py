"""The corpus pipeline: quality, near duplicates, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns the rows that stay, with the columns of
documents; the last adds slot and shard. A stage's result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, jaccard_join, mixing, quality, sharding
from quarry.llm.common import read, small_or_plain, table
from quarry.llm.queries import trusted_ids

#: Up to so many names of rows are broadcast, at 16 bytes each; with more, the documents are shuffled.
BROADCAST_ROWS = 1_000_000
ROW = "__row"


def _named(docs: DataFrame) -> DataFrame:
    """docs with ROW, a name of each row: its file and its place there. Rows that don't come from files are written first."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias(ROW)
    try:
        return docs.select("*", place)
    except AnalysisException:
        return table(docs, "rows").select("*", place)


def _without(docs: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of docs whose ROW isn't in gone (ROW). Rows are named, not documents: ids may be null or occur again."""
    gone = table(gone.select(F.col(f"{ROW}.file").alias("__f"), F.col(f"{ROW}.at").alias("__a")).distinct(), "gone")
    gone = small_or_plain(gone, gone.count(), BROADCAST_ROWS)
    return docs.join(gone, (F.col(f"{ROW}.file") == F.col("__f")) & (F.col(f"{ROW}.at") == F.col("__a")), "left_anti").select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps, each by its own text and language; null and empty texts go, texts are read
    whole, equal rows stay or go alike, other columns stay as they are, no rows give none."""
    rows = _named(docs)
    rated = quality.classify(rows, trusted_ids(spark, sf_dir), carry=(ROW,))
    return _without(rows, rated.filter("NOT kept"), docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the row with the smallest id (none first; of equal ids, the first by file and
    place); so of equal rows with words one stays. Rows without words, null texts too, all stay. Texts are read whole,
    other columns stay as they are, no rows give none."""
    rows = _named(docs)
    found = jaccard_join.join(rows.withColumn("__id", F.struct("doc_id", ROW)), "__id")
    return _without(rows, found.filter("component_id <> __id").select(f"__id.{ROW}"), docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no item of the benchmark, each by its own text; null and empty texts hold none. Texts are read
    whole, other columns stay as they are; no rows give none, and without items all stay."""
    rows = _named(docs)
    return _without(rows, decontamination.decontaminate(rows, read(spark, sf_dir, "benchmark"), ROW), docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: as many equal rows as its taken words hold its size. Texts without words,
    null ones too, add nothing to a mix and go; rows of one id are taken alike, each by its own size. Other columns stay
    as they are; no rows give none."""
    return mixing.take(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its slot and shard (they replace columns of these names): rows of one id share both, null is an id
    too. No row is moved or lost; texts aren't looked at; no rows give none."""
    return sharding.place(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL cannot express the first three stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = table(docs, f"stage-{name}")
    return docs
