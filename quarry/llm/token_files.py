"""Token-ID output in patched frame-of-reference blocks.

A segment holds the ids of consecutive documents, in blocks of BLOCK ids. A block's minimum is subtracted; the rest
is packed at the width that a percentile of its values needs; values that need more bits keep their low bits in
place and their high bits go to the block's exception list. An index holds every block's first byte, so any id can
be read without what stands before it.

Layout, little-endian: magic 8s | docs u32 | tokens u64 | block length u32 | blocks u32 | doc ids i64[docs] |
id present u8[docs] | ids per document u32[docs] | block starts u64[blocks + 1] | blocks; a block is
minimum u32 | width u8 | pad u8 | exceptions u16 | packed bits | exception places u16[] | exception high bits u32[].

A segment is one file, <pid>-<seg>.pfor, that its task writes under another name and then renames, so a lost task leaves
no half file and a repeated one writes the same. A manifest, a table that Spark writes, names the files that count. They
are read back through Spark.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import shared_dir, ship_code, small_batches, table, tidy

MAGIC, HEAD, BLOCK_HEAD = b"QPFOR\0\0\1", "<8sIQII", "<IBBH"
BLOCK = 1024
PERCENTILE = 90
SEGMENT_TOKENS = 1 << 21
#: Pieces of text whose ids a worker remembers before it starts anew, and twenty times the parts of odd pieces; a bound on
#: its memory.
CACHE_PIECES = 600_000
#: Characters of text that are encoded together.
CHARS_AT_ONCE = 3_000_000


def _word(width: int) -> tuple[int, str]:
    """Bits and type of the words that values of a width go through."""
    return (16, ">u2") if width <= 16 else (32, ">u4")


def pack(ids: np.ndarray, width: int) -> np.ndarray:
    """Rows of u32 values under 2**width as rows of bytes."""
    size, kind = _word(width)
    bits = np.unpackbits(ids.astype(kind).view(np.uint8), axis=-1).reshape(*ids.shape, size)
    return np.packbits(bits[..., size - width :].reshape(len(ids), -1), axis=-1)


def unpack(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    size, kind = _word(width)
    out = np.zeros((len(packed), n, size), np.uint8)
    out[..., size - width :] = np.unpackbits(packed, axis=-1, count=n * width).reshape(len(packed), n, width)
    return np.packbits(out, axis=-1).view(kind).reshape(len(packed), n).astype(np.uint32)


def _width(top: np.ndarray) -> np.ndarray:
    """Bits that the values need."""
    return np.frexp(top.astype(np.float64))[1].astype(np.int64)


def encode_segment(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    n = len(ids)
    blocks = -(-n // block)
    full = np.zeros(blocks * block, np.uint32)
    full[:n] = ids
    if n:
        full[n:] = full[n - 1]
    rows = full.reshape(blocks, block)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = rows - low[:, None]
    at = min(block - 1, int(block * percentile / 100))
    widths = _width(np.partition(rest, at, axis=1)[:, at]) if blocks else np.zeros(0, np.int64)
    bodies: list[bytes] = [b""] * blocks
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        for part in np.array_split(own, -(-len(own) // 64)):
            values = rest[part]
            bits = pack(values & np.uint32((1 << width) - 1), width) if width else np.zeros((len(part), 0), np.uint8)
            high = values >> np.uint32(width)
            for k, b in enumerate(part.tolist()):
                places = np.flatnonzero(high[k])
                bodies[b] = struct.pack(BLOCK_HEAD, int(low[b]), width, 0, len(places)) + bits[k].tobytes() + places.astype("<u2").tobytes() + high[k][places].astype("<u4").tobytes()
    starts = np.zeros(blocks + 1, "<u8")
    np.cumsum([len(x) for x in bodies], out=starts[1:])
    known = np.array([x is not None for x in doc_ids], np.uint8)
    numbers = np.array([int(x) if k else 0 for x, k in zip(doc_ids, known, strict=True)], "<i8")
    head = struct.pack(HEAD, MAGIC, len(doc_ids), n, block, blocks)
    return b"".join([head, numbers.tobytes(), known.tobytes(), np.asarray(lengths, "<u4").tobytes(), starts.tobytes(), *bodies])


def decode_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Doc ids (None where there was none), ids per document, all ids."""
    magic, docs, n, block, blocks = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a segment of this format")
    at = struct.calcsize(HEAD)
    numbers, at = np.frombuffer(data, "<i8", docs, at), at + 8 * docs
    known, at = np.frombuffer(data, np.uint8, docs, at), at + docs
    lengths, at = np.frombuffer(data, "<u4", docs, at), at + 4 * docs
    starts, at = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64), at + 8 * (blocks + 1)
    out, size = np.zeros((blocks, block), np.uint32), struct.calcsize(BLOCK_HEAD)
    heads = [struct.unpack_from(BLOCK_HEAD, data, at + int(s)) for s in starts[:-1]]
    widths = np.array([h[1] for h in heads], np.int64)
    for width in np.unique(widths).tolist():
        own, many = np.flatnonzero(widths == width), -(-block * width // 8)
        for part in np.array_split(own, -(-len(own) // 64)):
            if width:
                packed = np.stack([np.frombuffer(data, np.uint8, many, at + int(starts[b]) + size) for b in part])
                out[part] = unpack(packed, width, block)
            for b in part.tolist():
                low, _, _, count = heads[b]
                if count:
                    to = at + int(starts[b]) + size + many
                    places = np.frombuffer(data, "<u2", count, to)
                    out[b, places] |= np.frombuffer(data, "<u4", count, to + 2 * count) << np.uint32(width)
                out[b] += np.uint32(low)
    ids = [int(x) if k else None for x, k in zip(numbers, known, strict=True)]
    return ids, lengths, out.reshape(-1)[:n]


#: What a text is also cut before, with the character that marks it.
_MARKS = (("\n\n", "\x03"), ("\n", "\x02"), (",", "\x04"), (".", "\x05"))
_MARKED = {mark: cut for cut, mark in _MARKS}
_FIRST = "\x06"  # marks a text's first piece, which has no space before it
_OWN = "[\x02-\x06\x1c-\x1f\u0085]"  # marks, and separators that one library counts as white space and the other doesn't
#: Of a piece: it begins, it ends with white space (or is empty), it ends with a letter or a digit, it begins with a sign.
_BLANK_HEAD, _BLANK_TAIL, _WORD_TAIL, _SIGN_HEAD = 1, 2, 4, 8


class PieceTokenizer:
    """Ids as Tokenizer.encode gives them, with a memory of pieces.

    The byte-level pattern takes a space together with what follows, so a text may be cut before any space that
    doesn't have white space on both sides; and so before a line's end after anything but white space, and before a comma
    or a full stop after a letter or a digit. Texts with other commas and the like are cut at spaces only, and texts with
    a space that forbids it are encoded whole. The distinct pieces of many texts are looked up together in an array of
    those known, so that only new ones become Python objects. A new piece is cut by the pattern, and the library's BPE model turns that into ids. Tokenizers of other kinds, and texts with
    special tokens, are encoded whole.
    """

    def __init__(self, path: str, end_id: int, cache_pieces: int = CACHE_PIECES):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.most = Tokenizer.from_file(path), end_id, cache_pieces
        pre, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and self.tokenizer.normalizer is None and self.tokenizer.truncation is None and type(model).__name__ == "BPE"
        self.code = "H" if max(self.tokenizer.get_vocab_size(), end_id) < 1 << 16 else "I"
        # the published pattern of this pre-tokenizer (a fixed value)
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = iter(range(256, 512))
        self.bytes = {b: b if b in shown else next(other) for b in range(256)}
        self.space = chr(self.bytes[32])
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.parts: dict[str, array] = {}
        # number 0 is the end, others are one more than the place in known
        self.flat, self.start, self.length, self.kind = array(self.code, [self.end_id]), array("i", [0]), array("i", [1]), bytearray(1)

    def _part(self, part: str) -> array:
        known = self.parts.get(part)
        if known is None:
            shown = part.encode("utf-8", "replace").decode("latin-1").translate(self.bytes)
            known = self.parts[part] = array(self.code, [x.id for x in self.tokenizer.model.tokenize(shown)])
        return known

    def _learn(self, new: pa.Array) -> None:
        """Adds new pieces."""
        flat, space, tokenize, lengths, kinds = self.flat, self.space, self.tokenizer.model.tokenize, [], bytearray()
        for piece in new.to_pylist():
            lead = " "
            if piece[:1] == _FIRST:
                piece, lead = piece[1:], ""
            if piece.isalpha():  # one part; ASCII letters are shown as they are
                shown = piece if piece.isascii() else piece.encode("utf-8", "replace").decode("latin-1").translate(self.bytes)
                ids = [t.id for t in tokenize(space + shown if lead else shown)]
                kinds.append(_WORD_TAIL)
            else:
                head = piece[:1]
                if lead and head in _MARKED:
                    piece, lead = _MARKED[head] + piece[1:], ""  # a first piece never begins with a mark
                ids = array(self.code)
                for part in self.pattern(lead + piece):
                    ids += self._part(part)
                tail = _BLANK_TAIL if not piece or piece[-1].isspace() else _WORD_TAIL if piece[-1].isalpha() or piece[-1].isdecimal() else 0
                kinds.append((_BLANK_HEAD if not piece or piece[0].isspace() else 0) + tail + (_SIGN_HEAD if head in ("\x04", "\x05") else 0))
            lengths.append(len(ids))
            flat.extend(ids)
        if lengths:
            sizes = np.array(lengths, np.int32)
            self.start.frombytes((len(flat) - sizes.sum() + np.cumsum(sizes) - sizes).astype(np.int32).tobytes())
            self.length.frombytes(sizes.tobytes())
            self.kind += kinds
            self.known = pa.concat_arrays([self.known, new])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (strings, without nulls), each with the end id, and the number of each."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.known) > self.most or len(self.flat) > 1 << 29:
            self.clear()
        if len(self.parts) > self.most // 20:
            self.parts.clear()
        return self._cut(texts, True) if self.plain else self._whole(texts)

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, self.end_id], np.uint32) for t in texts.to_pylist()]
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def _cut(self, texts: pa.Array, at_marks: bool) -> tuple[np.ndarray, np.ndarray]:
        n, marked = len(texts), texts
        odd = pc.match_substring_regex(texts, _OWN).to_numpy(zero_copy_only=False)
        for special in self.special:
            odd = odd | pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        for cut, mark in _MARKS if at_marks else ():
            marked = pc.replace_substring(marked, cut, f" {mark}")
        cut = pc.split_pattern(pc.binary_join_element_wise(_FIRST, marked, ""), " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        offsets, pieces = offsets - offsets[0], cut.flatten().cast(pa.string()).dictionary_encode()
        found = pc.index_in(pieces.dictionary, value_set=self.known)
        number, new = found.fill_null(0).to_numpy() + np.int32(1), found.is_null()
        number[new.to_numpy(zero_copy_only=False)] = len(self.known) + 1 + np.arange(found.null_count)
        self._learn(pieces.dictionary.filter(new))
        index = number[pieces.indices.to_numpy()]
        # an end after each text's pieces
        with_ends = np.zeros(len(index) + n, np.int32)
        with_ends[np.arange(len(index)) + np.repeat(np.arange(n), np.diff(offsets))] = index
        index, stops = with_ends, offsets[1:] + np.arange(1, n + 1)
        begins = np.concatenate([[0], stops[:-1]])

        kind = np.frombuffer(self.kind, np.uint8)[index]
        before = np.concatenate([kind[:1] & 0, kind[:-1]])
        # a cut within a run of white space, or before white space that ends the text; a sign after what isn't a word
        bad = ((before & _BLANK_TAIL) > 0) & ((kind & _BLANK_HEAD) > 0) | ((kind & _SIGN_HEAD) > 0) & ((before & _WORD_TAIL) == 0)
        bad[begins] = bad[stops - 1] = False
        odd[np.searchsorted(stops, np.flatnonzero(bad), side="right")] = True
        odd = np.flatnonzero(odd)
        own, sizes = (np.zeros(0, np.uint32), np.zeros(0, np.int64)) if not len(odd) else self._cut(texts.take(pa.array(odd)), False) if at_marks else self._whole(texts.take(pa.array(odd)))
        # views of the arrays; they must be gone before the next piece is learnt
        lengths, starts = np.frombuffer(self.length, np.int32)[index], np.frombuffer(self.start, np.int32)[index]
        flat = np.frombuffer(self.flat, np.uint16 if self.code == "H" else np.uint32)
        for k, size, upto in zip(odd.tolist(), sizes.tolist(), np.cumsum(sizes).tolist(), strict=True):
            lengths[begins[k] : stops[k]] = 0
            starts[begins[k]], lengths[begins[k]] = len(flat) + upto - size, size
        total = np.zeros(len(lengths) + 1, np.int32)
        np.cumsum(lengths, out=total[1:])
        take = np.repeat(starts - total[:-1], lengths)
        take += np.arange(total[-1], dtype=np.int32)
        flat = np.concatenate([flat.astype(np.uint32), own]) if len(own) else flat
        return flat[take].astype(np.uint32), np.diff(total[np.concatenate([[0], stops])]).astype(np.int64)


_tokenizers: dict[tuple, PieceTokenizer] = {}


def _put(folder: str, name: str, data: bytes, attempt: str) -> None:
    """Writes a file in a shared folder, complete or not at all."""
    if "://" in folder and not folder.startswith("file://"):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        with store.open_output_stream(f"{base}/{name}.{attempt}") as out:
            out.write(data)
        store.move(f"{base}/{name}.{attempt}", f"{base}/{name}")
        return
    base = folder.removeprefix("file://")
    os.makedirs(base, exist_ok=True)
    with open(f"{base}/{name}.{attempt}", "wb") as out:
        out.write(data)
    os.replace(f"{base}/{name}.{attempt}", f"{base}/{name}")


def _get(path: str) -> pa.Buffer:
    """A file that _put has written."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        with store.open_input_stream(base) as own:
            return pa.py_buffer(own.read())
    with open(path.removeprefix("file://"), "rb") as own:
        return pa.py_buffer(own.read())


def write_tokens(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, segment_tokens: int = SEGMENT_TOKENS, folder: str | None = None) -> DataFrame:
    """Encodes docs into segment files in ascending order of id (none first; equal ids by text).

    Returns the manifest: pid, seg, path (of the file), start (ids before the segment in its pid), n_docs, n_tokens. Files
    go to folder, by default a new one in the shared folder; it may be a path that all executors share or an address
    that pyarrow can write to. Null texts count as empty and get the end id alone; repeated rows are documents of their
    own; texts are encoded whole, however long; other columns of docs are not looked at. No rows give no files. path: a
    vocabulary file of the tokenizers library that every executor has.
    """
    ship_code(docs.sparkSession)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = (folder or f"{shared_dir(docs.sparkSession)}/segments-{uuid.uuid4().hex}").rstrip("/")
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if (path, end_id) not in _tokenizers:
            _tokenizers[path, end_id] = PieceTokenizer(path, end_id)
        known, pid, attempt = _tokenizers[path, end_id], TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        seg, start, held, size = 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seg, start, held, size
            ids, lengths = np.concatenate([x[2] for x in held]), np.concatenate([x[1] for x in held])
            doc_ids, name = [y for x in held for y in x[0]], f"{pid:05d}-{seg:05d}.pfor"
            _put(folder, name, encode_segment(doc_ids, lengths, ids), f"{attempt}.tmp")
            out = pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "seg": pa.array([seg], pa.int32()), "path": [f"{folder}/{name}"], "start": [start], "n_docs": [len(doc_ids)], "n_tokens": [len(ids)]})
            seg, start, held, size = seg + 1, start + len(ids), [], 0
            return out

        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            # rows that together have CHARS_AT_ONCE bytes, or a longer text alone
            upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CHARS_AT_ONCE, side="right")))
                tokens, lengths = known.encode(texts.slice(a, b - a))
                held, size, a = [*held, (ids[a:b], lengths, tokens)], size + len(tokens), b
                if size >= segment_tokens:
                    yield flush()
        if held:
            yield flush()

    with small_batches(docs.sparkSession):
        return table(rows.mapInArrow(tidy(run), "pid int, seg int, path string, start long, n_docs long, n_tokens long"), "manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """From the files of a manifest, a row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    and, if asked for, ids."""
    spark = manifest.sparkSession
    ship_code(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    # one row per partition of the writer, whose number is a setting
    totals = manifest.groupBy("pid").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("pid", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("pid")) - F.col("n")).alias("base"))
    # the manifest's rows are dealt out, and tasks open their files: no folder is listed, and no contents are shuffled
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = manifest.join(F.broadcast(bases), "pid").select("path", (F.col("base") + F.col("start")).alias("first")).repartition(n, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, path in zip(batch.column("first").to_pylist(), batch.column("path").to_pylist(), strict=True):
                doc_ids, lengths, ids = decode_segment(_get(path))
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = ids.astype("<u4", copy=False)
                crcs = [zlib.crc32(raw[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                out = {"doc_id": pa.array(doc_ids, pa.int64()), "start": first + ends - lengths, "n_tokens": lengths.astype(np.int64), "ids_crc32": pa.array(crcs, pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(raw.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    return named.mapInArrow(tidy(run), schema)  # files are few megabytes each
