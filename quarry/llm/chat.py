"""Multi-party perspective rotation of dialogues.

For every participant of a dialogue the whole dialogue is rendered once, with that speaker as the assistant and all
others as named users; the assistant's own words are the spans that a loss would count. Turns stay rows: a running
offset gives each its place in the rendering, and parts of bounded length are put together, so that no task holds a
whole dialogue, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import table

#: A part holds the turns that begin within so many characters of the rendering.
PART_CHARS = 65_536
NOBODY = "unknown"


def ordered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The turns with pid (a range of the global order) and at (the place within it); written, so that both are fixed.

    Order within a dialogue: turn (none first), speaker, text. Equal rows stay; a salt lets them lie in several ranges.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    speaker = F.when(F.length(F.trim(F.coalesce(role_col, F.lit("")))) > 0, F.trim(role_col)).otherwise(NOBODY)
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), speaker.alias("speaker"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "conv_id", "turn", "speaker", "text", F.rand(seed=1)).sortWithinPartitions("conv_id", "turn", "speaker", "text")
    return table(rows.withColumn("pid", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "turns")


def running(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """rows with before: the sum of value over the rows of the same key that precede in (pid, at).

    Sums within each range first, then over a key's ranges, of which there are no more than partitions; so a key
    with very many rows is dealt to several tasks.
    """
    local = rows.withColumn("__v", value).withColumn("__run", F.sum("__v").over(Window.partitionBy(*by, "pid").orderBy("at")) - F.col("__v"))
    keys = {f"__{c}": F.col(c) for c in [*by, "pid"]}
    totals = rows.withColumn("__v", value).withColumns(keys).groupBy(*keys).agg(F.sum("__v").alias("__sum"))
    bases = totals.withColumn("__base", F.sum("__sum").over(Window.partitionBy(*(f"__{c}" for c in by)).orderBy("__pid")) - F.col("__sum"))
    joined = local.join(bases, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*by, "pid"]])
    return joined.select(*rows.columns, (F.col("__run") + F.col("__base")).alias("before"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per dialogue, perspective and turn: conv_id, perspective, seq, speaker, chat_role, segment, start, stop,
    mask_start, mask_stop (offsets in characters of the rendered dialogue; a mask only where the speaker is the
    perspective), pid, at.

    A turn without a speaker is spoken by "unknown"; a null text is empty; turns without a dialogue's id form one
    dialogue. Repeated rows are turns of their own, and those of equal turn and speaker follow by text. Texts are kept
    whole, however long; other columns of turns, whatever their names, are not looked at. No rows give none.
    """
    rows = ordered(turns, conv_col, turn_col, role_col, text_col)
    numbered = running(rows, ["conv_id"], F.lit(1)).withColumnRenamed("before", "seq")
    people = numbered.groupBy("conv_id", "speaker").count().select(F.col("conv_id").alias("__c"), F.col("speaker").alias("perspective"))
    seen = numbered.join(people, numbered["conv_id"].eqNullSafe(people["__c"])).drop("__c")
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("<|im_start|>assistant\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), F.regexp_replace("speaker", r"\s+", "_"), F.lit("\n")))
    seen = seen.withColumn("head", head).withColumn("segment", F.concat("head", "text", F.lit("<|im_end|>\n")))
    placed = running(seen, ["conv_id", "perspective"], F.length("segment").cast("long")).withColumnRenamed("before", "start")
    mask = F.col("start") + F.length("head")
    return placed.select(
        "conv_id", "perspective", "seq", "speaker", F.when(own, "assistant").otherwise("user").alias("chat_role"), "segment", "start", (F.col("start") + F.length("segment")).alias("stop"),
        F.when(own, mask).alias("mask_start"), F.when(own, mask + F.length("text")).alias("mask_stop"), "pid", "at",
    )


def render(rotated: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """A row per dialogue, perspective and part: conv_id, perspective, part, n_turns, part_start, text, masks
    ("start:stop" of the whole rendering, comma-joined). The parts' texts in order are the rendering."""
    parts = rotated.withColumn("part", F.floor(F.col("start") / part_chars))
    turn = F.struct("seq", "segment", "mask_start", "mask_stop")
    grouped = parts.groupBy("conv_id", "perspective", "part").agg(F.array_sort(F.collect_list(turn)).alias("t"), F.count("*").alias("n_turns"), F.min("start").alias("part_start"))
    masks = F.transform(F.filter("t", lambda x: x["mask_start"].isNotNull()), lambda x: F.concat(x["mask_start"].cast("string"), F.lit(":"), x["mask_stop"].cast("string")))
    return grouped.select("conv_id", "perspective", "part", "n_turns", "part_start", F.array_join(F.col("t.segment"), "").alias("text"), F.array_join(masks, ",").alias("masks"))
