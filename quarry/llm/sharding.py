"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: a start and a step, taken from hashes
of its name, walk through all slots. The shards take turns, each claiming the first slot it prefers that is still
free, until the table is full; so each shard owns an equal share (to one slot), and removing a shard moves few
slots of the others. The table's size is a parameter, so its broadcast has a fixed bound, and a row's shard is one
hash and one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: int | list[str], slots: int = SLOTS) -> list[int]:
    """The shard's number for every slot. slots: a prime of at least the number of shards."""
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    if not names or not _is_prime(slots) or slots < len(names):
        raise ValueError("shards must be there, and slots a prime that is no smaller than their number")
    walks = []
    for name in names:
        digest = hashlib.sha256(name.encode()).digest()
        walks.append([int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1])
    owner, left = [-1] * slots, slots
    while True:
        for shard, walk in enumerate(walks):
            while owner[walk[0]] >= 0:
                walk[0] = (walk[0] + walk[1]) % slots
            owner[walk[0]], left = shard, left - 1
            if not left:
                return owner


def slot_table(spark: SparkSession, shards: int | list[str], slots: int = SLOTS) -> DataFrame:
    """(slot int, shard int): the filled table as rows."""
    text = F.lit(",".join(map(str, fill_table(shards, slots))))
    return spark.range(1).select(F.posexplode(F.split(text, ",")).alias("slot", "owner")).select("slot", F.col("owner").cast("int").alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of the MD5 of its string, so that other systems can tell it too; null has the slot of the
    empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, key: str = "doc_id", shards: int | list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """docs with two more columns: slot and shard (they replace columns of these names).

    Every row stays, repeated ones too; rows of one key, and all rows without a key, share a shard. Other columns, texts
    of any length among them, stay as they are and aren't looked at; no rows give none. No row is shuffled: the table of
    fixed size is broadcast.
    """
    rows = docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return rows.join(F.broadcast(slot_table(docs.sparkSession, shards, slots)), "slot").select(*rows.columns[:-1], "slot", "shard")
