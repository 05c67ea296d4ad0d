"""Mixing sources to target weights by hash-threshold histograms.

Word counts are summed by source and by the leading bits of a hash of the id. In each source the running sum tells
which bucket holds the budget's end; only that bucket is cut again by the next bits, until a single hash value is
left. Every document under its source's threshold is taken: one filter, no sort. A larger budget has a larger
threshold, so its sample contains the smaller one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, small_or_plain, table

HASH_BITS, LEVEL_BITS = 48, 12
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(c: Column) -> Column:
    """48 bits of the id's MD5; null hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(source_sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, repeat: float = 2.0) -> DataFrame:
    """source_sizes (source, source_size) with sid and target.

    Sources by code point, null last, have the weights in turn and share `share` of all words; none is over
    `repeat` times its size, and what is cut off goes to the others by weight. The result is one water level:
    target = min(cap, level * weight). Works on one row per source.
    """
    one = Window.partitionBy(F.lit(0))
    ranked = source_sizes.withColumn("sid", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", repeat * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = one.orderBy("ratio", "sid")
    budget, cap_before = share * F.sum("source_size").over(one), F.sum("cap").over(by_ratio) - F.col("cap")
    weight_left = F.sum("w").over(one.orderBy(F.desc("ratio"), F.desc("sid")))
    levelled = ranked.withColumn("level", (budget - cap_before) / weight_left)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(one)["level"]
    return levelled.withColumn("target", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap")))).select("sid", "source", "source_size", "target")


def thresholds(sizes: DataFrame, wanted: DataFrame, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """Of sizes (sid, size, h) and wanted (sid, rest): (sid, cut), such that the words of h < cut come nearest to rest."""
    state = table(wanted.select("sid", "rest", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("below"), F.lit(False).alias("done")), "mix-state")
    n = state.count()
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        # path: the leading bits of the boundary bucket; below: the words under it
        inside = sizes.join(small_or_plain(state.filter("NOT done"), n, broadcast_sources), "sid").filter(F.shiftright("h", shift + LEVEL_BITS) == F.col("path"))
        hist = inside.groupBy("sid", "rest", "below", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = F.col("below") + F.sum("words").over(Window.partitionBy("sid").orderBy("bucket"))
        edge = hist.withColumn("run", run).filter("run > rest").groupBy("sid").agg(F.min(F.struct("bucket", "run", "words")).alias("e"))
        step = state.join(edge, "sid", "left").withColumn("open", F.col("e").isNotNull() & ~F.col("done"))
        # a source whose words all fit has no boundary: its threshold is past the last hash
        path = F.when(F.col("open"), F.col("e.bucket")).when(F.col("done"), F.col("path")).otherwise(F.lit(1 << HASH_BITS))
        if shift == 0:
            over = F.col("open") & (F.col("e.run") - F.col("rest") < F.col("rest") - (F.col("e.run") - F.col("e.words")))
            return step.select("sid", (path + F.when(over, 1).otherwise(0)).alias("cut"))
        state = table(step.select("sid", "rest", path.alias("path"), F.when(F.col("open"), F.col("e.run") - F.col("e.words")).otherwise(F.col("below")).alias("below"), (F.col("done") | ~F.col("open")).alias("done")), "mix-state")


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The words and the hash of every row, written once."""
    return table(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("h")), "mix-sizes")


def plan(sizes: DataFrame, weights: tuple[float, ...], share: float, repeat: float, broadcast_sources: int) -> DataFrame:
    """A row per source of sizes (source, size, h): source, source_size, target, whole (copies of every document) and cut (a
    document whose hash is under it is taken once more), for a join by source; broadcast if counted sources allow."""
    made = table(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeat), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    made = made.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    n = made.count()
    keyed = sizes.join(small_or_plain(made.select("sid", F.col("source").alias("__s")), n, broadcast_sources), F.col("source").eqNullSafe(F.col("__s"))).select("size", "h", "sid")
    final = made.join(thresholds(keyed, made, broadcast_sources), "sid").select(F.col("source").alias("__source"), "source_size", "target", "whole", "cut")
    return small_or_plain(table(final, "mix-plan"), n, broadcast_sources)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, repeat: float = 2.0, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """One row per row of docs: <id>, source, size, source_size, target, taken.

    size counts words (null text: 0); taken is the words that the mix takes of the document, its whole copies
    and, under the source's threshold, one more. Repeated ids are taken or left together. An empty table gives
    an empty result; a source without words has target 0. Texts are counted whole, however long; null is a source and
    an id like others; other columns of docs, whatever their names, are not looked at.
    """
    sizes = _sizes(docs, id_col, text_col, source_col)
    rows = sizes.join(plan(sizes, weights, share, repeat, broadcast_sources), F.col("source").eqNullSafe(F.col("__source")))
    taken = F.col("size") * (F.col("whole") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0))
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, repeat: float = 2.0, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The rows of docs, each as often as mix() takes it; those without words go. Only the sources' plan is joined, so no
    row is shuffled. Nulls, ties and empty tables: as in mix()."""
    made = plan(_sizes(docs, id_col, text_col, source_col), weights, share, repeat, broadcast_sources)
    columns = docs.columns
    rows = docs.withColumn("__h", id_hash(F.col(id_col))).join(made, F.col(source_col).eqNullSafe(F.col("__source")))
    copies = (F.col("whole") + F.when(F.col("__h") < F.col("cut"), 1).otherwise(0)).cast("int")
    rows = rows.filter(F.col(text_col).rlike(WORD)).select(*(docs[c] for c in columns), copies.alias("__n")).filter("__n > 0")
    return rows.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*columns)
