"""Quality classifier: an interpolated modified Kneser-Ney model trained on trusted text.

The model's tokens are characters, in n-grams of ORDER tokens: a text is the sequence of its words with single spaces
between them, padded at its start and closed by an end sign, so that contexts reach across words. Counts are exact, over
all trusted texts: tasks count their own n-grams, the shuffle adds them up, and each lower order counts how many
different tokens precede (the continuation counts). Probabilities are made by joins of
sharded count tables, order by order, for just those n-grams that the documents have. Each block of documents asks for
its distinct n-grams once and gets their log-probabilities back; a document's perplexity is that of its tokens. Texts travel
to their block as compressed batches, and are unpacked one batch at a time.
Thresholds are quantiles, by language, of trusted documents held out from the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import MIX, drop_table, nullable, ship_code, small_batches, small_or_plain, table, tidy, trim

ORDER = 5
PAD, END = "\u0002", "\u0003"
#: Characters of text in a block, whose distinct n-grams one task holds at a time.
BLOCK_CHARS = 32_000_000
#: Characters that are worked on together, and distinct n-grams that a task holds before it hands them on.
STEP_CHARS, GRAMS_AT_ONCE = 1_000_000, 2_000_000
#: Share of held-out trusted documents that a language's threshold keeps.
KEEP_QUANTILE = 0.995
#: Of ten trusted documents, so many set the thresholds and aren't counted.
HELD_OUT_TENTHS = 2
#: Up to so many trusted ids are broadcast, so that texts aren't shuffled to find them.
BROADCAST_IDS = 1_000_000
#: Held-out documents at which a language's own quantile counts as much as its median plus what all languages' quantile
#: is above their medians.
PRIOR_HELD_OUT = 50
#: Up to so many languages' thresholds are broadcast.
BROADCAST_LANGS = 100_000


def padded(text: str) -> str:
    """The sequence of a text's tokens; empty without words."""
    words = " ".join(text.split())
    return PAD * (ORDER - 1) + words + END if words else ""


def text_grams(text: str) -> list[str]:
    s = padded(text)
    return [s[k : k + ORDER] for k in range(len(s) - ORDER + 1)]


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def steps(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """The sequences of texts in lots of bounded size, with the number of the text that each belongs to; longer ones come in
    pieces that overlap by what an n-gram needs."""
    lot, whose, size = [], [], 0
    for k, t in enumerate(texts):
        s = padded(t)
        for a in range(0, len(s) - ORDER + 1, STEP_CHARS):
            lot.append(s[a : a + STEP_CHARS + ORDER - 1])
            whose.append(k)
            size += len(lot[-1])
            if size >= STEP_CHARS:
                yield lot, whose
                lot, whose, size = [], [], 0
    if lot:
        yield lot, whose


def gram_keys(lot: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The sequences as one string; of all their n-grams, one sequence after the other, the place and a 64-bit key; and the
    number of each sequence."""
    s = "".join(lot)
    codes = _codes(s)
    n = len(codes) - ORDER + 1
    keys = codes[:n] * MIX[0]
    for k in range(1, ORDER):
        keys += codes[k : k + n] * MIX[k]
    # leading bits, by which keys are looked up, depend on all tokens
    keys ^= keys >> np.uint64(29)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    many = np.fromiter(map(len, lot), np.int64, len(lot)) - ORDER + 1
    inside = np.ones(len(codes), bool)
    ends = np.cumsum(many + ORDER - 1)
    for k in range(1, ORDER):
        inside[ends - k] = False
    places = np.flatnonzero(inside)
    return s, places, keys[places], many


class Grams:
    """Distinct n-grams with their counts, of texts that are added bit by bit."""

    BITS = 21

    def __init__(self) -> None:
        # most n-grams are found by their leading bits; number 0 is none
        self.table, self.shift = np.zeros(1 << self.BITS, np.int32), np.uint64(64 - self.BITS)
        self.keys, self.counts, self.grams = np.zeros(1, np.uint64), np.zeros(1, np.int64), [""]
        self.order = np.zeros(1, np.int64)

    def add(self, texts: list[str]) -> None:
        for lot, _ in steps(texts):
            s, places, keys, _ = gram_keys(lot)
            at = self.table[(keys >> self.shift).astype(np.int64)]
            hit = (self.keys[at] == keys) & (at > 0)
            self.counts += np.bincount(at[hit], minlength=len(self.counts))
            if hit.all():
                continue
            places, (keys, first, n) = places[~hit], np.unique(keys[~hit], return_index=True, return_counts=True)
            place = np.searchsorted(self.keys, keys, sorter=self.order)
            place = self.order[np.minimum(place, len(self.order) - 1)]
            old = (self.keys[place] == keys) & (place > 0)
            self.counts[place[old]] += n[old]
            if not old.all():
                new, known = ~old, len(self.grams)
                self.grams += [s[p : p + ORDER] for p in places[first[new]].tolist()]
                self.keys, self.counts = np.concatenate([self.keys, keys[new]]), np.concatenate([self.counts, n[new]])
                self.table[(keys[new] >> self.shift).astype(np.int64)] = known + np.arange(new.sum())
                self.order = np.argsort(self.keys)

    def __len__(self) -> int:
        return len(self.grams) - 1

    def columns(self) -> tuple[pa.Array, pa.Array]:
        return pa.array(self.grams[1:], pa.string()), pa.array(self.counts[1:], pa.int64())


class GramScores:
    """Mean negative log-probabilities of texts, from those of n-grams."""

    def __init__(self, grams: list[str], lp: np.ndarray):
        keys = np.concatenate([gram_keys(grams[a : a + STEP_CHARS // ORDER])[2] for a in range(0, len(grams), STEP_CHARS // ORDER)])
        order = np.argsort(keys)
        self.keys, self.nll = keys[order], -lp[order].astype(np.float64)
        # most keys are found by their leading bits, the others by a search
        self.shift = np.uint64(64 - max(10, int(4 * len(keys)).bit_length()))
        self.slots = np.zeros(1 << int(64 - self.shift), np.int32)
        self.slots[(self.keys >> self.shift).astype(np.int64)] = np.arange(len(keys))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text and their mean negative log-probability."""
        tokens, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for lot, whose in steps(texts):
            _, _, keys, many = gram_keys(lot)
            at = self.slots[(keys >> self.shift).astype(np.int64)]
            missed = np.flatnonzero(self.keys[at] != keys)
            at[missed] = np.searchsorted(self.keys, keys[missed])
            tokens += np.bincount(whose, many, len(texts)).astype(np.int64)
            total += np.bincount(whose, np.add.reduceat(self.nll[at], np.cumsum(many) - many), len(texts))
        return tokens, np.where(tokens > 0, total / np.maximum(tokens, 1), np.nan)


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Grams]:
    """The n-grams of the first column's texts, in lots of bounded size."""
    found = Grams()
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            found.add([t for t in batch.column(0).slice(a, 500).to_pylist() if t])
            if len(found) > GRAMS_AT_ONCE:
                yield found
                found = Grams()
    yield found


def count_grams(docs: DataFrame, text_col: str) -> DataFrame:
    """(gram, n): n-grams of full order over all of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _grams_of(batches):
            yield pa.RecordBatch.from_arrays([*found.columns()], ["gram", "n"])

    ship_code(docs.sparkSession)
    return docs.select(F.col(text_col).alias("t")).mapInArrow(tidy(run), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def model_tables(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame], list[list[float]]]:
    """For each order from 1: (gram, n), (context, total, n1, n2, n3) and the discounts [0, D1, D2, D3+].

    n counts occurrences at the full order and different preceding tokens below it.
    """
    grams, contexts, discounts = [], [], []
    current = table(counts, "grams")
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            current = table(current.groupBy(F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("n")), "grams")
        of = current.agg(*(F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
        y = of.n1 / (of.n1 + 2 * of.n2) if of.n1 else 0.5
        # the published estimate; where counts of counts are too few for it, the plain discount y
        d = [k - (k + 1) * y * of[k] / of[k - 1] if of[k - 1] and of[k] else y for k in (1, 2, 3)]
        discounts.insert(0, [0.0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))])
        context = F.substring("gram", 1, order - 1) if order > 1 else F.lit("")
        some = [F.count(F.when(c, 1)).alias(a) for a, c in (("n1", F.col("n") == 1), ("n2", F.col("n") == 2), ("n3", F.col("n") > 2))]
        contexts.insert(0, table(current.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), *some), "contexts"))
        grams.insert(0, current)
    return grams, contexts, discounts


def probabilities(asked: DataFrame, grams: list[DataFrame], contexts: list[DataFrame], discounts: list[list[float]]) -> DataFrame:
    """(gram, p) for the n-grams of full order in asked (gram); unseen tokens share the lowest order's rest evenly."""
    types = grams[0].count()
    wanted = [asked]
    for order in range(ORDER - 1, 0, -1):
        wanted.insert(0, table(wanted[0].select(F.substring("gram", 2, order).alias("gram")).distinct(), "asked"))
    lower = None
    for order in range(1, ORDER + 1):
        d = discounts[order - 1]
        rows = wanted[order - 1].join(grams[order - 1], "gram", "left")
        rows = rows.withColumn("context", F.substring("gram", 1, order - 1) if order > 1 else F.lit("")).join(contexts[order - 1], "context", "left")
        if lower is None:
            rows = rows.withColumn("below", F.lit(1.0 / (types + 1)))
        else:
            rows = rows.withColumn("suffix", F.substring("gram", 2, order - 1)).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        n = F.coalesce("n", F.lit(0))
        cut = F.when(n == 0, 0.0).when(n == 1, d[1]).when(n == 2, d[2]).otherwise(d[3])
        rest = (d[1] * F.col("n1") + d[2] * F.col("n2") + d[3] * F.col("n3")) / F.col("total")
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise((n - cut) / F.col("total") + rest * F.col("below"))
        lower = table(rows.select("gram", p.alias("p")), "probabilities")
    return lower


def _pack(batch: pa.RecordBatch) -> bytes:
    import zstandard

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _unpack(payload: bytes) -> pa.Table:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all()


def packed(rows: DataFrame) -> DataFrame:
    """rows (block, ...) as (block, payload): the rows of each batch that share a block are one payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.append(True, block[order][1:] != block[order][:-1])) if len(block) else []
            rest = batch.drop_columns(["block"])
            for own in np.split(order, cuts[1:]) if len(block) else []:
                yield pa.RecordBatch.from_pydict({"block": pa.array(block[own[:1]], pa.int32()), "payload": pa.array([_pack(rest.take(pa.array(own)))], pa.binary())})

    return rows.mapInArrow(tidy(run), "block int, payload binary")


def score(docs: DataFrame, counts: DataFrame, keys: list[str], text_col: str = "text", n_blocks: int | None = None) -> DataFrame:
    """(keys, tokens, nll): the number of tokens of each text and the mean of their negative log-probabilities; nll is
    null for a text without words."""
    ship_code(docs.sparkSession)
    grams, contexts, discounts = model_tables(counts)
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    n_blocks = n_blocks or int(chars // BLOCK_CHARS) + 1
    block = F.pmod(F.xxhash64(*keys, F.col(text_col)), F.lit(n_blocks)).cast("int").alias("block")
    rows = docs.select(block, *keys, F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def all_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _grams_of(batches):
            yield pa.RecordBatch.from_arrays([found.columns()[0]], ["gram"])

    def block_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition has few blocks, each of them whole, and their rows come mixed
        of: dict[int, Grams] = {}

        def out(b: int) -> pa.RecordBatch:
            grams = of.pop(b).columns()[0]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), b, np.int32)), grams], ["block", "gram"])

        for batch in batches:
            for b, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                found = of.setdefault(b, Grams())
                texts = _unpack(payload.as_buffer()).column("t")
                for a in range(0, len(texts), 500):
                    found.add(texts.slice(a, 500).to_pylist())
                if sum(map(len, of.values())) > GRAMS_AT_ONCE:
                    yield out(max(of, key=lambda k: len(of[k])))
        for b in list(of):
            yield out(b)

    asked = table(rows.select("t").mapInArrow(tidy(all_grams), "gram string").distinct(), "asked")
    answers = probabilities(asked, grams, contexts, discounts)
    for done in (asked, *grams, *contexts):
        drop_table(done)
    # both uses of blocks read all of its columns, so that the texts are shuffled once
    blocks = packed(rows).repartition(max(n_blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block")
    told = blocks.mapInArrow(tidy(block_grams), "block int, gram string").join(answers, "gram").select("block", "gram", F.log("p").cast("float").alias("lp"))

    def rated(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rate = GramScores(right.column("gram").to_pylist(), right.column("lp").to_numpy()) if right.num_rows else None
        out = []
        for payload in left.column("payload"):
            own = _unpack(payload.as_buffer())
            tokens, nll = [np.zeros(0, np.int64)], [np.zeros(0)]
            for a in range(0, own.num_rows, 500):
                texts = own.column("t").slice(a, 500).to_pylist()
                got = rate(texts) if rate else (np.zeros(len(texts), np.int64), np.full(len(texts), np.nan))
                tokens, nll = [*tokens, got[0]], [*nll, got[1]]
            out.append(pa.table({k: own.column(k) for k in keys} | {"tokens": np.concatenate(tokens), "nll": pa.array(np.concatenate(nll), from_pandas=True)}))
        trim()
        return pa.concat_tables(out)

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    # every block has texts: a block of answers alone can't come
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(rated, f"{kinds}, tokens long, nll double")


def thresholds(held: DataFrame, quantile: float, prior: int) -> tuple[DataFrame, DataFrame]:
    """Of held-out documents (__lang, nll): (lang, own), and one row (every) for languages that have none.

    A language's threshold is its own quantile, weighted with its number of documents, and its median plus the quantile of
    what all documents are above their languages' medians, weighted with prior.
    """
    cut = lambda c, q: F.percentile_approx(c, q, 100_000)
    by_lang = held.groupBy(F.col("__lang").alias("__l")).agg(cut("nll", quantile).alias("top"), cut("nll", 0.5).alias("mid"), F.count("*").alias("m"))
    by_lang = table(by_lang, "languages")
    above = held.join(small_or_plain(by_lang, by_lang.count(), BROADCAST_LANGS), F.col("__lang").eqNullSafe(F.col("__l"))).agg(cut(F.col("nll") - F.col("mid"), quantile).alias("above"), cut("nll", quantile).alias("every"))
    every = table(above, "all-languages")
    # every is one row
    own = (F.col("m") * F.col("top") + prior * (F.col("mid") + F.col("above"))) / (F.col("m") + prior)
    return by_lang.crossJoin(F.broadcast(every)).select("__l", own.alias("own")), every.select("every")


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = KEEP_QUANTILE, n_blocks: int | None = None, broadcast_ids: int = BROADCAST_IDS, prior: int = PRIOR_HELD_OUT, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per row of docs: <id>, lang, tokens, perplexity, threshold, kept, and the columns named in carry.

    trusted has the ids (column <id>) of trusted documents: by a hash of the id, HELD_OUT_TENTHS in ten of them set the
    thresholds, the others are counted. A document goes if its perplexity is over its language's threshold (see
    thresholds(); null is a language too; a language without held-out documents has the quantile of all). A text
    without words, or null, has no perplexity and goes. Without trusted documents there is no threshold: all with
    words stay. Repeated rows are scored each, and rows of one id each by their own text. Texts are read whole, however
    long. Other columns of docs, whatever their names, are not looked at. No rows give no rows.
    """
    ids = trusted.select(F.col(id_col).alias("__id")).filter("__id IS NOT NULL").distinct().withColumn("held", F.pmod(F.xxhash64(F.lit(11), "__id"), F.lit(10)) < HELD_OUT_TENTHS)
    ids = table(ids, "trusted")
    counted = small_or_plain(ids.filter("NOT held").select("__id"), ids.count(), broadcast_ids)
    known = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t"))
    counts = count_grams(known.join(counted, "__id", "left_semi"), "t")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("t"), *(nullable(docs, c).alias(f"__c_{c}") for c in carry))
    with small_batches(docs.sparkSession):
        scored = table(score(rows, counts, ["__id", "__lang", *(f"__c_{c}" for c in carry)], "t", n_blocks), "scores")

    held = scored.join(ids.filter("held").select("__id"), "__id", "left_semi").filter("nll IS NOT NULL")
    by_lang, every = thresholds(held, quantile, prior)
    out = scored.join(small_or_plain(by_lang, by_lang.count(), BROADCAST_LANGS), F.col("__lang").eqNullSafe(F.col("__l")), "left").crossJoin(F.broadcast(every))
    threshold = F.coalesce("own", "every")
    kept = F.col("nll").isNotNull() & F.coalesce(F.col("nll") <= threshold, F.lit(True))
    return out.select(F.col("__id").alias(id_col), F.col("__lang").alias("lang"), "tokens", F.exp("nll").alias("perplexity"), F.exp(threshold).alias("threshold"), kept.alias("kept"), *(F.col(f"__c_{c}").alias(c) for c in carry))
