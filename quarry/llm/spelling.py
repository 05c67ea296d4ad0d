"""Spelling variants: words within one edit, by a join of even partitions.

A word of length l is cut into two segments, of l // 2 and the other code points. A word of equal length or one longer
that is one edit away holds one segment whole: the first at its start, or the second at its end, shifted by the
difference of lengths. So segments of l are indexed, and words of l and l + 1 probe them. A segment that too many words
share is partitioned again: with it fixed, the edit lies in what is left of the word, half of which is again whole. A
pair is taken at the first segment of a level that it shares only, so candidates come once, and are verified there.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_table, nullable, ship_code, small_batches, table, tidy

MODULUS, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Words that may share a segment before it is partitioned again.
BUCKET = 64
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
_LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}


def slipped(doc_id: object, run: str, modulus: int = MODULUS) -> str:
    """The lower-cased run, without one code point if the checksum of its document and itself says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % modulus else run[: h % len(run)] + run[h % len(run) + 1 :]


def count_words(docs: DataFrame, id_col: str, text_col: str, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n), partly added up: words of `least_length` code points or more, by task."""
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least_length)  # maximal, as the class is greedy; shorter runs give shorter words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return rows

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("t"), strict=True):
                for word, n in Counter(runs.findall(text.as_py() or "")).items():
                    word = slipped(doc_id, word.translate(_LOWER))
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
        yield out()

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).mapInArrow(tidy(run), "word string, n long")


def segments(words: DataFrame, most: int = BUCKET) -> DataFrame:
    """(l, a, b, head, tail, word, length): a word at every segment where it may meet a partner.

    l: the length of the shorter word of a pair; what is left of that one is its code points from a to b. head and tail
    are the word's code points before and behind. Segments that one word has alone, or no word of length l, are left out.
    """
    left = lambda a, b: F.struct(F.col("l"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    rows = words.select("word", F.char_length("word").alias("length")).withColumn("l", F.explode(F.array("length", F.col("length") - 1)))
    rows, out, written = rows.withColumn("a", F.lit(0)).withColumn("b", F.col("l")), [], []
    while True:
        m = F.floor((F.col("a") + F.col("b")) / 2)
        rows = rows.select("word", "length", F.explode(F.array(left(m, F.col("b")), left(F.col("a"), m))).alias("s")).select("word", "length", "s.*")
        rows = rows.withColumn("head", F.expr("substring(word, 1, a)")).withColumn("tail", F.expr("substring(word, b + length - l + 1, length)"))
        rows = table(rows, "segments")
        key = ["l", "a", "b", "head", "tail"]
        sizes = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum((F.col("length") == F.col("l")).cast("int")).alias("short")).filter("n > 1 AND short > 0")
        sizes = table(sizes.select(*key, ((F.col("n") > most) & (F.col("b") - F.col("a") > 1)).alias("big")), "sizes")
        written += [rows, sizes]
        rows = rows.join(sizes, key)
        out.append(rows.filter("NOT big").select(*key, "word", "length"))
        if sizes.filter("big").isEmpty():
            break
        rows = rows.filter("big").select("word", "length", "l", "a", "b")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    whole = table(whole, "segments")
    for done in written:
        drop_table(done)
    return whole


def near_pairs(words: DataFrame, most: int = BUCKET) -> DataFrame:
    """(x, y): pairs of words (word) that one inserted, deleted or replaced code point tells apart, each once; x isn't the longer."""
    rows = segments(words, most)
    key = ["l", "a", "b", "head", "tail"]
    index = rows.filter("length = l").select(*key, F.col("word").alias("x"))
    probe = rows.select(*key, F.col("word").alias("y"), "length")
    pairs = index.join(probe, key).filter("length > l OR x < y")
    # a pair that agrees up to b met, or will meet, at a segment with more of its start
    pairs = pairs.filter("b = l OR substring(x, 1, b) <> substring(y, 1, b)")
    return pairs.filter(F.levenshtein("x", "y", 1) == 1).select("x", "y")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT, ratio: int = RATIO, most: int = BUCKET) -> DataFrame:
    """A row per word: word, form, root, n, n_near, form_n.

    Words are the maximal runs of A-Z, a-z and the code points 00C0 to 00FF of whole texts, A-Z lower-cased, with one code
    point left out where slipped() says so, of six code points or more and with `least_count` occurrences over all texts or
    more. form is the near word (one edit away) of most occurrences, ties going to the smaller by code points, if it has
    `ratio` times the word's or more, else null; root is where forms lead. Null and empty texts have no words; a null id
    counts as an empty one; rows of one id count each with their own text; equal rows count as often as they occur. Other
    columns, whatever their names, are not looked at. No rows, or no words, give no rows.
    """
    if ratio < 2:
        raise ValueError("with a ratio under 2 forms may lead in circles")
    ship_code(docs.sparkSession)
    with small_batches(docs.sparkSession):
        docs = docs.select(nullable(docs, id_col).alias("__i"), F.col(text_col).alias("__t"))
        words = table(count_words(docs, "__i", "__t").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count), "words")
    pairs = table(near_pairs(words, most), "pairs")
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    best = both.join(words.select(F.col("word").alias("y"), F.col("n").alias("m")), "y")
    best = best.groupBy("x").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("y").alias("form"))).alias("best"))
    found = words.join(best.withColumnRenamed("x", "word"), "word", "left")
    found = found.withColumn("m", -F.col("best.less")).withColumn("good", F.col("m") >= ratio * F.col("n"))
    found = table(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("good"), F.col("best.form")).alias("form"), F.when(F.col("good"), F.col("m")).alias("form_n")), "forms")
    # forms have `ratio` times the occurrences, so ways are short; each turn doubles how far all have gone
    way, reach, longest = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), 1, 0
    top = words.agg(F.max("n")).first()[0] or 0
    while least_count * ratio ** longest <= top:
        longest += 1
    while reach < longest:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        way = table(way.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        reach *= 2
    out = found.join(way, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
