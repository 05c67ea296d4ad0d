"""Benchmark decontamination by template canonicalisation.

Every word becomes a template word: a word with a digit is #num, a word of a fixed list of units is #unit, a
capitalised word within a sentence is #name, any other is itself, lower-cased and without punctuation. Windows of
template words are hashed and joined with the benchmark's; along each diagonal (place in the text minus place in the
item) the placeholders' fillers must then map one to one, so that a question with other numbers and names is caught and
text that only looks alike is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_by_bytes, table

#: Words of a window; an item with fewer has windows of the largest power of two of words that it has.
WINDOW = 8
#: Items with fewer words aren't looked for, as they say too little: clean texts hold them too. 1 looks for all.
LEAST_WORDS = 4
#: Share of an item's windows that a text must have.
COVERAGE = 0.5
#: Up to so many bytes of items are broadcast, once to look windows up and once to compare words; more are shuffled.
BROADCAST_BYTES = 64 << 20

#: Units of measure (fixed values).
UNITS = (
    "mm cm km kg mg g lb lbs oz ml cl dl km/h mph kmh hz khz mhz ghz kw kwh mw watt watts volt volts amp amps"
    " meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters inch inches foot feet yard yards mile miles"
    " gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces liter liters litre litres gallon gallons"
    " second seconds minute minutes hour hours day days week weeks month months year years"
    " dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit"
)
_GAP = r"[\x20\x09-\x0D]+"
_NUM, _NAME, _UNIT = "\u0001", "\u0002", "\u0003"


def _any_of(words: list[str]) -> str:
    """A pattern for the words that branches by one letter at a time."""
    heads = sorted({w[0] for w in words if w})
    branches = [h + _any_of([w[1:] for w in words if w[:1] == h]) for h in heads]
    if not branches:
        return ""
    return "(?:" + "|".join(branches) + ")" + ("?+" if "" in words else "")


def flat(text: Column) -> Column:
    """The text's words with single spaces between them."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _GAP, " "))


def canonical(text: Column) -> Column:
    """flat(text) with a template word in the place of every word. Patterns enter each run of letters once."""
    t = F.regexp_replace(flat(text), "[\u0001-\u0003]", "")
    t = F.regexp_replace(t, r"\p{Lu}(?<=[^ .!?:] \p{Lu})\p{Ll}++(?=[^ \p{L}\p{Nd}]*+(?: |$))", _NAME)
    t = F.regexp_replace(t, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", _NUM)
    t = F.lower(F.regexp_replace(t, r"[^ \p{L}\u0001-\u0003]++", ""))
    return F.regexp_replace(t, "(?<![^ ])" + _any_of([u.replace("/", "") for u in UNITS.split()]) + "(?![^ ])", _UNIT)


def _windows(rows: DataFrame, words: str, sizes: list[int], keep: list[str]) -> DataFrame:
    """(keep, window, place, h): a hash for every window of so many words, for all sizes (powers of two) in one pass. Windows
    double, so that a word is hashed once."""
    out = rows.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("h1"))
    size = 1
    while size < max(sizes):
        done = [f"h{s}" for s in sizes if s <= size]
        n = F.greatest(F.size(f"h{size}") - size, F.lit(0))
        out = out.select(*keep, *done, F.slice(f"h{size}", 1, n).alias("a"), F.slice(f"h{size}", F.lit(size + 1), n).alias("b"))
        size *= 2
        out = out.select(*keep, *done, F.zip_with("a", "b", lambda x, y: F.xxhash64(x, y)).alias(f"h{size}"))
    # outer: else the optimizer filters by the size of h first, with a copy of h for each time that it is used above
    if len(sizes) == 1:
        return out.select(*keep, F.lit(size).alias("window"), F.posexplode_outer(f"h{size}").alias("place", "h")).filter("h IS NOT NULL")

    def named(size: int) -> Column:
        return F.transform(f"h{size}", lambda h, at: F.struct(F.lit(size).alias("window"), at.alias("place"), h.alias("h")))

    each = [named(size) for size in sizes]
    return out.select(*keep, F.explode_outer(F.concat(*each)).alias("w")).select(*keep, "w.window", "w.place", "w.h").filter("h IS NOT NULL")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, least_words: int = LEAST_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row for each text and item that it holds: <id>, item_id, windows (of the item, found in the text),
    item_windows, slots (placeholders in the stretch found), changed (those with another filler), kind ("exact" where
    none is changed, else "reparameterised").

    A text holds an item if, on diagonals whose fillers map one to one, it has the share `coverage` of the item's
    windows, of 8 template words (or 4, 2, 1 for items that are shorter than the next). Items of fewer than least_words
    words, null or empty ones are not looked for; a null or empty text holds none, and no rows give none. Texts that
    share an id are looked at one by one and reported if any holds the item; repeated rows and items count once. Texts
    are read whole, however long; other columns of docs and benchmark, whatever their names, are not looked at.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.split(canonical(F.col(item_text_col)), " ").alias("words"), F.split(flat(F.col(item_text_col)), " ").alias("raw")).dropDuplicates(["item", "raw"])
    items = items.withColumn("ifp", F.xxhash64("raw")).filter((F.size("words") >= least_words) & (F.col("raw") != F.array(F.lit(""))))
    powers = F.filter(F.array(*(F.lit(1 << k) for k in range(WINDOW.bit_length()))), lambda n: n <= F.size("words"))
    items = table(items.withColumn("window", F.array_max(powers)), "items")
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = keyed.select("id", F.xxhash64("text").alias("fp"), F.split(canonical(F.col("text")), " ").alias("words"))

    hits, sizes = None, sorted(r[0] for r in items.select("window").distinct().collect())
    if sizes:
        known = _windows(items.withColumnRenamed("window", "of"), "words", sizes, ["item", "ifp", "of"])
        known = table(known.filter("window = of").select("item", "ifp", "window", F.col("place").alias("at"), "h"), "item-windows")
        known = small_by_bytes(known, 48 + F.octet_length(F.coalesce(F.col("item").cast("string"), F.lit(""))), broadcast_bytes)
        hits = _windows(texts, "words", sizes, ["id", "fp"]).join(known, ["window", "h"]).select("id", "fp", "item", "ifp", (F.col("place") - F.col("at")).alias("delta"), "at", "window")
    schema = "item_id {}, windows long, item_windows int, slots long, changed long, kind string".format(benchmark.schema[item_col].dataType.simpleString())
    if hits is None:
        return docs.sparkSession.createDataFrame([], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {schema}")

    # the places on one diagonal are no more than the item has words
    lines = table(hits.groupBy("id", "fp", "item", "ifp", "delta", "window").agg(F.collect_set("at").alias("ats")), "diagonals")
    whole = items.select(F.col("item").alias("i"), F.col("ifp").alias("ifp2"), F.col("words").alias("iwords"), F.col("raw").alias("iraw"), (F.size("words") - F.col("window") + 1).alias("item_windows"))
    pair = ["id", "fp", "item", "ifp"]
    found = lines.groupBy(*pair).agg(F.size(F.array_distinct(F.flatten(F.collect_set("ats")))).alias("n"))
    whole = small_by_bytes(whole, 64 + F.octet_length(F.coalesce(F.col("i").cast("string"), F.lit(""))) + F.octet_length(F.array_join("iwords", " ")) + F.octet_length(F.array_join("iraw", " ")) + 16 * F.size("iwords"), broadcast_bytes)
    sized = found.join(whole, (F.col("item").eqNullSafe(F.col("i"))) & (F.col("ifp") == F.col("ifp2")))
    wanted = table(sized.filter(F.col("n") >= coverage * F.col("item_windows")).select(*pair, "item_windows", "iwords", "iraw"), "suspects")

    own = wanted.select(F.col("id").alias("id2"), F.col("fp").alias("fp2")).distinct()
    full = keyed.withColumn("fp", F.xxhash64("text")).join(small_by_bytes(own, 32 + F.octet_length(F.coalesce(F.col("id2").cast("string"), F.lit(""))), broadcast_bytes), F.col("id").eqNullSafe(F.col("id2")) & (F.col("fp") == F.col("fp2")), "left_semi")
    full = full.select(F.col("id").alias("id2"), F.col("fp").alias("fp2"), F.split(flat(F.col("text")), " ").alias("traw"), F.split(canonical(F.col("text")), " ").alias("twords"))
    full = full.dropDuplicates(["id2", "fp2"])

    def same(a: list[str]) -> Column:
        return (F.col(a[0]).eqNullSafe(F.col(f"{a[0]}3"))) & (F.col("fp") == F.col("fp3")) & (F.col("item").eqNullSafe(F.col("item3"))) & (F.col("ifp") == F.col("ifp3"))

    checked = lines.join(wanted.select(F.col("id").alias("id3"), F.col("fp").alias("fp3"), F.col("item").alias("item3"), F.col("ifp").alias("ifp3"), "item_windows", "iwords", "iraw"), same(["id"]))
    checked = checked.join(full, F.col("id").eqNullSafe(F.col("id2")) & (F.col("fp") == F.col("fp2")))
    place = F.sequence(F.array_min("ats"), F.array_max("ats") + F.col("window") - 1)
    typed = F.filter(place, lambda k: F.element_at("iwords", k + 1).isin(_NUM, _NAME, _UNIT) & (F.element_at("iwords", k + 1) == F.element_at("twords", k + F.col("delta") + 1)))

    def filler(words: str, k: Column) -> Column:
        return F.regexp_replace(F.lower(F.element_at(words, k)), r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}%]+$", "")

    slots = F.transform(typed, lambda k: F.struct(F.element_at("iwords", k + 1).alias("kind"), filler("iraw", k + 1).alias("a"), filler("traw", k + F.col("delta") + 1).alias("b")))
    checked = checked.select(*pair, "item_windows", "ats", slots.alias("s")).withColumn("d", F.array_distinct("s"))
    left, right = F.transform("d", lambda x: F.struct(x["kind"], x["a"])), F.transform("d", lambda x: F.struct(x["kind"], x["b"]))
    checked = checked.filter((F.size(F.array_distinct(left)) == F.size("d")) & (F.size(F.array_distinct(right)) == F.size("d")))
    checked = checked.withColumn("slots", F.size("s").cast("long")).withColumn("changed", F.size(F.filter("s", lambda x: x["a"] != x["b"])).cast("long"))
    # of several diagonals, the figures of the one with most windows
    best = F.max_by(F.struct("slots", "changed"), F.struct(F.size("ats"), -F.col("changed"), F.col("slots"))).alias("b")
    out = checked.groupBy(*pair, "item_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_set("ats")))).cast("long").alias("windows"), best)
    out = out.filter(F.col("windows") >= coverage * F.col("item_windows"))
    out = out.groupBy("id", "item").agg(F.max(F.struct("windows", "item_windows", F.col("b.slots"), (-F.col("b.changed")).alias("less"))).alias("m"))
    changed = -F.col("m.less")
    return out.select(
        F.col("id").alias(id_col), F.col("item").alias("item_id"), "m.windows", "m.item_windows", "m.slots", changed.alias("changed"), F.when(changed == 0, "exact").otherwise("reparameterised").alias("kind")
    )
