"""Line dedup by a suffix array over line-ID sequences.

Texts are sequences of lines, lines are numbers. Prefix doubling ranks the suffixes by their first 1, 2, 4, ... lines:
a rank pairs the ranks of two halves, and is the place of the pair in a global sort, so each level is the suffix array
to that depth. Only blocks that occur again go on, as a block can't repeat when one of its halves doesn't. Suffixes that
share their first f lines form a longest-common-prefix interval; its name is (f, rank of the first 2**k lines, rank of
the last 2**k), with 2**k <= f. In every interval whose common lines reach min_words, the lines of later runs are deleted,
but those that they share with the earliest one. A maximal repeated run is the union of the shortest runs of min_words in it, taken
forward from each of its lines and backward from each, so only these are looked up, and no level past min_words
lines is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, drop_table, table
from quarry.operators.ranking import place_in

MIN_WORDS = 50


def _in_order(keys: DataFrame, cols: list[str], name: str) -> DataFrame:
    """keys with rank: a number that grows with cols, by a range-partitioned sort."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table(keys.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("rank", F.monotonically_increasing_id()), name)


def _again(rows: DataFrame, cols: list[str], name: str) -> DataFrame:
    """(rid, pos, rank) of the rows whose cols occur more than once."""
    ranks = _in_order(rows.groupBy(*cols).count().filter("count > 1").drop("count"), cols, f"{name}-ranks")
    out = table(rows.join(ranks, cols).select("rid", "pos", "rank"), name)
    drop_table(ranks)
    return out


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(rid, first, last): from each line forward, and to each line backward, the shortest run of min_words words."""
    one = Window.partitionBy("rid")
    summed = lines.select("rid", "pos", "words", F.sum("words").over(one.orderBy("pos")).alias("upto"))

    def nearest(value: Column, goal: Column, order: Column, place: Column) -> DataFrame:
        """For each line the last line, in that order, whose value has reached its goal."""
        marks = F.array(F.struct(value.alias("v"), F.lit(0).alias("ask"), F.col("pos").alias("line"), F.lit(None).cast("int").alias("of")), F.struct(goal.alias("v"), F.lit(1).alias("ask"), F.lit(None).cast("int").alias("line"), F.col("pos").alias("of")))
        rows = summed.select("rid", F.explode(marks).alias("m")).select("rid", "m.*")
        found = F.last("line", ignorenulls=True).over(one.orderBy(order, "ask", place).rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("line", found).filter("ask = 1 AND line IS NOT NULL").select("rid", "of", "line")

    before = F.col("upto") - F.col("words")
    forward = nearest(F.col("upto"), before + min_words, F.col("v").desc(), F.col("line").desc())
    backward = nearest(before, F.col("upto") - min_words, F.col("v").asc(), F.col("line").asc())
    return forward.select("rid", F.col("of").alias("first"), F.col("line").alias("last")).unionByName(backward.select("rid", F.col("line").alias("first"), F.col("of").alias("last"))).distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text cleaned, and three more columns: n_lines, n_removed, words_removed (they replace columns of
    these names).

    A line goes when a run of lines that holds it, of at least min_words words together, also occurs at an earlier
    place, and the earliest such place doesn't hold the line itself; so of a run that overlaps its own copies (a line
    repeated over and over) the first min_words words' worth stays. What goes has an equal line that stays at an earlier
    place. Places are ordered by id (none first), then by row, then by line, and a run lies within one text. Lines are
    compared without white space at their ends; blank lines are passed over: they stay, and a run may go on beyond
    them. Every row stays, also one whose lines all go (its text is then what blank lines it had, or empty). A null
    text stays null and, like an empty one, has one line, a blank one; repeated rows and rows that share an id are
    documents of their own. Texts are read whole, however long; other columns of docs stay as they are. No rows give none.
    """
    base = table(docs.drop("n_lines", "n_removed", "words_removed").withColumn("__rid", F.monotonically_increasing_id()), "line-docs")
    raw = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    # pos counts the lines that aren't blank, raw all lines
    trimmed = F.transform(raw, lambda line, at: F.struct(at.alias("raw"), F.trim(F.regexp_replace(line, r"[\x09-\x0D]", " ")).alias("line")))
    lines = base.select(F.col("__rid").alias("rid"), F.posexplode(F.filter(trimmed, lambda x: x["line"] != "")).alias("pos", "x")).select("rid", "pos", "x.raw", "x.line")
    lines = table(lines.select("rid", "pos", "raw", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("words")), "lines")

    level = _again(lines.select("rid", "pos", "a", "b"), ["a", "b"], "blocks")
    written = [lines, level]
    ends = level.select("rid", "pos")
    runs = shortest_runs(lines, min_words).join(ends.withColumnRenamed("pos", "first"), ["rid", "first"], "left_semi")
    runs = table(runs.join(ends.withColumnRenamed("pos", "last"), ["rid", "last"], "left_semi").withColumn("len", F.col("last") - F.col("first") + 1), "runs")
    written.append(runs)
    longest = runs.agg(F.max("len")).first()[0] or 0

    named, k = None, 0
    while 1 << k <= longest:
        own = runs.filter((F.col("len") >= 1 << k) & (F.col("len") < 2 << k))
        head = level.select("rid", F.col("pos").alias("first"), F.col("rank").alias("head"))
        tail = level.select("rid", (F.col("pos") + (1 << k) - 1).alias("last"), F.col("rank").alias("tail"))
        here = own.join(head, ["rid", "first"]).join(tail, ["rid", "last"]).select("rid", "first", "last", "len", "head", "tail")
        named = here if named is None else named.unionByName(here)
        k += 1
        if 1 << k <= longest:
            half = level.select("rid", (F.col("pos") - (1 << (k - 1))).alias("pos"), F.col("rank").alias("second"))
            level = _again(level.withColumnRenamed("rank", "head").join(half, ["rid", "pos"]), ["head", "second"], "blocks")
            written.append(level)
    if named is None:
        for done in written:
            drop_table(done)
        return base.select(*base.columns[:-1], F.size(raw).alias("n_lines"), F.lit(0).alias("n_removed"), F.lit(0).cast("long").alias("words_removed"))

    ids = base.select(F.col("__rid").alias("rid"), F.col(id_col).alias("id"))
    named = table(named.join(ids, "rid").withColumn("place", F.struct("id", "rid", "first")), "intervals")
    written.append(named)
    name = ["len", "head", "tail"]
    first = named.groupBy(*name).agg(F.min("place").alias("earliest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = named.join(first, name).filter(F.col("place") > F.col("earliest"))
    begin = F.when(F.col("rid") == F.col("earliest.rid"), F.greatest("first", F.col("earliest.first") + F.col("len"))).otherwise(F.col("first"))
    gone = later.select("rid", F.explode(F.sequence(begin, "last")).alias("pos")).distinct()
    gone = lines.join(gone, ["rid", "pos"], "left_semi").groupBy("rid").agg(F.sort_array(F.collect_set("raw")).alias("__gone"), F.sum("words").alias("__words"))
    gone = table(gone.withColumnRenamed("rid", "__rid"), "gone")
    for done in written:
        drop_table(done)

    # a binary search for each line: a text may have as many lines as it likes
    kept = F.filter(raw, lambda line, at: F.element_at("__gone", place_in(at, F.col("__gone")) + 1) != at)
    cut = F.col("__gone").isNotNull()
    out = base.join(gone, "__rid", "left").select(
        *(F.when(cut, F.array_join(kept, "\n")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in base.columns[:-1]),
        F.size(raw).alias("n_lines"), F.when(cut, F.size("__gone")).otherwise(0).alias("n_removed"), F.coalesce("__words", F.lit(0)).alias("words_removed"),
    )
    return out
