"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

The first scan keeps an id, a length and a hash of the first characters for each row. Only rows whose (length,
prefix hash) occurs again are read in full and hashed; all others are settled by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, small_or_plain, table

PREFIX_CHARS = 256
#: Up to so many (length, prefix hash) pairs, at 16 bytes each, are broadcast. More are joined by a shuffle of hashes: so as not
#: to shuffle texts, all are hashed in full before it, as nearly all would be behind it.
BROADCAST_KEYS = 500_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, carry: dict[str, Column] | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per row of docs: <id>, keep_id, group_size, kept, full_hash and the carried columns.

    Texts are equal when identical after lower-casing A-Z; null is the empty text. keep_id is the largest id
    among equal texts (null only if all are null). Of rows that share text and the largest id one is kept.
    full_hash (SHA-256, binary) is null where length or prefix already tell a row from all others. Texts are compared whole,
    however long; other columns of docs, whatever their names, are not looked at. No rows give none.
    carry: expressions over docs to return for every row; equal rows must have equal values.
    """
    carry = carry or {}
    norm = ascii_lower(F.col(text_col))
    keys = {"__len": F.octet_length(F.coalesce(F.col(text_col), F.lit(""))), "__prefix": F.xxhash64(ascii_lower(F.substring(F.col(text_col), 1, prefix_chars)))}
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col), *(c.alias(f"__c_{n}") for n, c in carry.items()), *(c.alias(n) for n, c in keys.items()))
    extra = [f"__c_{n}" for n in carry]

    narrow = table(rows.select("__len", "__prefix"), "dedup-keys")
    lengths = narrow.groupBy("__len").count().filter("count > 1").select("__len")
    again = table(narrow.join(lengths, "__len", "left_semi").groupBy("__len", "__prefix").count().filter("count > 1").select("__len", "__prefix", F.lit(True).alias("__again")), "dedup-again")
    n_keys, full_hash = again.count(), F.unhex(F.sha2(norm, 256))
    if n_keys > broadcast_keys:
        rows = rows.withColumn("__full", full_hash).drop(text_col)
        full_hash = F.col("__full")
    marked = rows.join(small_or_plain(again, n_keys, broadcast_keys), ["__len", "__prefix"], "left")

    alone = marked.filter("__again IS NULL").select("__id", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lit(None).cast("binary").alias("full_hash"), *extra)
    full = marked.filter("__again").select("__id", full_hash.alias("full_hash"), *extra)
    full = table(full.groupBy("full_hash", "__id", *extra).agg(F.count("*").alias("__n")), "dedup-full")
    groups = full.groupBy("full_hash").agg(F.max("__id").alias("keep_id"), F.sum("__n").alias("group_size"))
    copies = full.join(groups, "full_hash").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    copies = copies.select("__id", "keep_id", "group_size", (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__copy") == 1)).alias("kept"), "full_hash", *extra)
    return alone.unionByName(copies).select(F.col("__id").alias(id_col), "keep_id", "group_size", "kept", "full_hash", *(F.col(f"__c_{n}").alias(n) for n in carry))
