"""Removal of long repeated byte strings by a logarithmic family of sparse suffix arrays.

A suffix array of every position would be many times the text. Here one suffix
in about fifty is kept: of the ``PREFIX``-byte strings inside each window of
``min_bytes`` bytes the one with the smallest hash is the window's anchor, so
equal windows have equal anchors at equal places. A batch's suffix array lists
the distinct anchors' suffixes with the first document and place that has each,
in shards; a shard is ordered by the first bytes of the suffix and then by the
hash of its first PREFIX bytes. A new batch is merge-scanned against the levels
there are for suffixes with a common prefix of PREFIX bytes or more; levels of
equal size merge, so a suffix is rewritten log(batches) times. The index
outlives a batch: texts added later meet those added before.

Suffixes without a partner rule out all windows around them. For the others the
whole stretch of windows that share the anchor is hashed at once; stretches
that occur twice are removed whole. Only at the ends of matches, where
stretches differ, is more to compare: first what each sixteen neighbouring
windows have in common, then the windows of those that are left, one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.storage import bit_array, bit_filter, bits_for, bits_set, delete, maybe_in, read_table, save, scratch_folder, text_or_empty
from factlake.llm.words import BASE, BYTE_VALUE, mix, parts, powers, text_bytes

WANTED = "array<struct<first:int,last:int,anchor:int,alone:boolean,mixed:boolean>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
#: Bytes of a suffix that its partners share at least, and that its order goes by before the hash.
PREFIX, HEAD = 96, 4
#: Least bits of a filter of repeated hashes (4 MB); windows that are compared together first.
BITS, GROUP = 1 << 25, 16
SECOND = 0xC2B2AE3D27D4EB4F | 1
LOW = np.uint64((1 << 24) - 1)
#: Windows of a long text that are looked at together.
SEGMENT = 1 << 22


def prefix_sums(data: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(base, len(data)), out=out[1:])
    return out


def hashes(sums: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte string from start to end."""
    return mix((sums[end] - sums[start]) * powers(pow(base, -1, 1 << 64), len(sums))[start])


def slide_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return values if size == width else np.minimum(values[: len(values) - (width - size)], values[width - size :])


def stretches(data: np.ndarray, offsets: np.ndarray, min_bytes: int) -> tuple[np.ndarray, ...]:
    """Anchor place, first and last window, and anchor hash of each stretch; places in ``data``."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < min_bytes:
        return none, none, none, none.astype(np.uint64)
    prefix = min(PREFIX, min_bytes // 2)
    sums = prefix_sums(data, BASE)
    gram = mix((sums[prefix:] - sums[:-prefix]) * powers(pow(BASE, -1, 1 << 64), len(sums))[: n - prefix + 1])
    key = (gram & ~LOW) | np.arange(len(gram), dtype=np.uint64)
    anchor = (slide_min(key, min_bytes - prefix + 1) & LOW).astype(np.int64)
    window = np.arange(n - min_bytes + 1)
    fits = np.repeat(offsets[1:], np.diff(offsets))[: len(window)] - window >= min_bytes
    anchor, window = anchor[fits], window[fits]
    if not len(window):
        return none, none, none, none.astype(np.uint64)
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1))
    first, last = np.r_[0, cut + 1], np.r_[cut, len(window) - 1]
    return anchor[first], window[first], window[last], gram[anchor[first]]


@dataclass
class Piece:
    """Some texts of a batch, or a segment of a long one: their numbers, bytes and offsets, and the place of the segment in its text."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    base: int = 0


def _pieces(column: pa.Array, min_bytes: int) -> Iterator[Piece]:
    """A long text comes in segments of SEGMENT windows, so some 60 bytes a byte of a segment are held, not of a text."""
    data, offsets = text_bytes(column)
    for a, b in parts(offsets):
        text = data[offsets[a] : offsets[b]]
        if b - a > 1 or len(text) < SEGMENT + min_bytes:
            yield Piece(a, b, text, offsets[a : b + 1] - offsets[a])
            continue
        for s in range(0, len(text) - min_bytes + 1, SEGMENT):
            own = text[s : s + SEGMENT + min_bytes - 1]
            yield Piece(a, b, own, np.array([0, len(own)]), s)


def suffix_entries(docs: DataFrame, min_bytes: int) -> DataFrame:
    """(head, prefix_hash, n, doc_key, place) of the kept suffixes of ``docs(doc_key, text)``, each once a piece of texts."""
    names = ["head", "prefix_hash", "n", "doc_key", "place"]

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for piece in _pieces(batch.column(1), min_bytes):
                with np.errstate(over="ignore"):
                    anchor, _, _, gram = stretches(piece.data, piece.offsets, min_bytes)
                gram, at, n = np.unique(gram, return_index=True, return_counts=True)
                anchor = anchor[at]
                head = np.zeros(len(anchor), np.uint32)
                for k in range(HEAD):
                    head = head << np.uint32(8) | piece.data[anchor + k].astype(np.uint32)
                doc = np.searchsorted(piece.offsets, anchor, "right") - 1
                columns = [head.astype(np.int64), gram.astype(np.int64), n.astype(np.int32), keys[piece.first : piece.last][doc], (anchor - piece.offsets[doc] + piece.base).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return docs.select("doc_key", "text").mapInArrow(run, "head long, prefix_hash long, n int, doc_key long, place int")


@dataclass
class Level:
    """A suffix array of ``batches`` batches."""

    batches: int
    path: str
    suffixes: DataFrame


class SuffixIndex:
    """Suffix arrays of batches of texts; level k holds 2**k batches."""

    def __init__(self, spark: SparkSession, min_bytes: int = 200):
        self.spark, self.min_bytes = spark, min_bytes
        self.levels: list[Level] = []
        self.repeated: list[DataFrame] = []
        self.batches: list[DataFrame] = []

    def _write(self, entries: DataFrame, batches: int) -> Level:
        """A suffix array of entries: of equal prefixes the number and one document and place."""
        path = scratch_folder(self.spark)
        merged = entries.groupBy("head", "prefix_hash").agg(F.sum("n").cast("int").alias("n"), F.first("doc_key").alias("doc_key"), F.first("place").alias("place"))
        merged.sortWithinPartitions("head", "prefix_hash").write.parquet(path)
        return Level(batches, path, self.spark.read.schema(merged.schema).parquet(path))

    def add(self, docs: DataFrame) -> DataFrame:
        """Add ``docs(doc_id, text)``; returns the suffixes of the batch that share a prefix with another, of it or of a level.

        Columns are head, prefix_hash, n, doc_key, place, and, from the level
        that has the partner, level_key and level_place (null within the batch).
        """
        docs = docs.select("doc_id", text_or_empty().alias("text")).withColumn("doc_key", F.xxhash64("doc_id", "text"))
        self.batches.append(docs)
        new = self._write(suffix_entries(docs, self.min_bytes), 1)
        none = [F.lit(None).cast("long").alias("level_key"), F.lit(None).cast("int").alias("level_place")]
        found = [new.suffixes.where("n > 1").select("*", *none)]
        for level in self.levels:
            other = level.suffixes.select("head", "prefix_hash", F.col("doc_key").alias("level_key"), F.col("place").alias("level_place"))
            found.append(new.suffixes.join(other, ["head", "prefix_hash"]))
        matches = save(reduce(DataFrame.unionByName, found))
        self.repeated.append(matches.select("prefix_hash"))
        self.levels.append(new)
        while len(self.levels) > 1 and self.levels[-1].batches == self.levels[-2].batches:
            two, one = self.levels.pop(), self.levels.pop()
            self.levels.append(self._write(one.suffixes.unionByName(two.suffixes), one.batches + two.batches))
            for old in (one, two):
                delete(self.spark, old.path)
        return matches

    def repeats(self) -> DataFrame:
        """The prefix hashes that occur more than once in all batches."""
        return reduce(DataFrame.unionByName, self.repeated).distinct()

    def cut(self) -> DataFrame:
        """All documents added so far without the strings that repeat among them: see ``remove_repeats``."""
        return _remove(reduce(DataFrame.unionByName, self.batches), save(self.repeats()), self.min_bytes)


def _broadcast(hashes: DataFrame, column: str):
    """A filter of hashes for use in tasks, of 64 MB at most; a full one lets all through, which is slower only."""
    bits = bits_for(hashes.count(), BITS)
    return hashes.sparkSession.sparkContext.broadcast(bit_array(bit_filter(hashes, column, bits, hashed=True), bits))


def _stretch_hashes(docs: DataFrame, repeats, min_bytes: int) -> DataFrame:
    """The stretches of ``docs(doc_key, text)`` whose anchor may be repeated."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for piece in _pieces(batch.column(1), min_bytes):
                with np.errstate(over="ignore"):
                    anchor, first, last, gram = stretches(piece.data, piece.offsets, min_bytes)
                    keep = bits_set(repeats.value, gram)
                    anchor, first, last, gram = anchor[keep], first[keep], last[keep], gram[keep]
                    place = mix((anchor - first).astype(np.uint64) * np.uint64(BASE) + (last - first).astype(np.uint64))
                    whole = hashes(prefix_sums(piece.data, SECOND), SECOND, first, last + min_bytes) ^ place
                doc = np.searchsorted(piece.offsets, first, "right") - 1
                shift = piece.base - piece.offsets[doc]
                columns = [keys[piece.first : piece.last][doc], gram.astype(np.int64), whole.astype(np.int64), *((x + shift).astype(np.int32) for x in (first, last, anchor))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_key", "prefix_hash", "whole_hash", "first", "last", "anchor"])

    return docs.select("doc_key", "text").mapInArrow(run, "doc_key long, prefix_hash long, whole_hash long, first int, last int, anchor int")


def _wanted(piece: Piece, column: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Text, first, last, anchor and alone of the stretches in ``piece`` that are to be compared; places in its texts."""
    column = column.slice(piece.first, piece.last - piece.first)
    flat = column.flatten()
    doc = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy())
    first, last, anchor, alone, mixed = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
    own = (first >= piece.base) & (first < piece.base + SEGMENT) if len(column) == 1 else True
    keep = mixed.astype(bool) & own
    return doc[keep], first[keep] - piece.base, last[keep] - piece.base, anchor[keep] - piece.base, alone[keep].astype(bool)


def _groups(doc: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows by distance to the anchor, GROUP at a time: text, low and high distance of the group, those in the stretch, anchor, alone."""
    near, far = anchor - last, anchor - first  # distances that the stretch has
    count = far // GROUP - near // GROUP + 1
    at = np.repeat(near // GROUP, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    doc, near, far, anchor, alone = (np.repeat(x, count) for x in (doc, near, far, anchor, alone))
    return doc, at, np.maximum(near, at * GROUP), np.minimum(far, at * GROUP + GROUP - 1), anchor, alone


def _core(sums: np.ndarray, at: np.ndarray, anchor: np.ndarray, start: np.ndarray, min_bytes: int) -> np.ndarray:
    """Hash of what all windows of a group hold, as far as a window of the stretch shows it."""
    low = anchor + start - at * GROUP
    return hashes(sums, BASE, low, low + min_bytes - GROUP + 1) ^ mix(at.astype(np.uint64))


def _core_hashes(docs: DataFrame, min_bytes: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for piece in _pieces(batch.column(1), min_bytes):
                doc, at, _, _, anchor, _ = _groups(*_wanted(piece, batch.column(2)))
                with np.errstate(over="ignore"):
                    core = _core(prefix_sums(piece.data, BASE), at, anchor, piece.offsets[doc], min_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(core.astype(np.int64))], ["core"])

    return docs.select("doc_key", "text", "wanted").mapInArrow(run, "core long")


def _window_hashes(docs: DataFrame, cores, min_bytes: int, twice=None) -> DataFrame:
    """Each window of the wanted stretches whose group's core may be repeated; with ``twice`` only windows that are alone in their stretch and may be in it."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for piece in _pieces(batch.column(1), min_bytes):
                doc, at, near, far, anchor, alone = _groups(*_wanted(piece, batch.column(2)))
                with np.errstate(over="ignore"):
                    sums = prefix_sums(piece.data, BASE)
                    keep = bits_set(cores.value, _core(sums, at, anchor, piece.offsets[doc], min_bytes))
                    if twice is not None:
                        keep &= alone
                    doc, near, far, anchor = (x[keep] for x in (doc, near, far, anchor))
                    count = far - near + 1
                    window = np.repeat(anchor - far, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    doc = np.repeat(doc, count)
                    start = window + piece.offsets[doc]
                    one = hashes(sums, BASE, start, start + min_bytes)
                    if twice is not None:
                        keep = bits_set(twice.value, one)
                        doc, window, start, one = doc[keep], window[keep], start[keep], one[keep]
                    two = hashes(prefix_sums(piece.data, SECOND), SECOND, start, start + min_bytes)
                columns = [keys[piece.first : piece.last][doc], one.astype(np.int64), two.astype(np.int64), (window + piece.base).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_key", "one", "two", "first"])

    return docs.select("doc_key", "text", "wanted").mapInArrow(run, "doc_key long, one long, two long, first int")


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals in order with those that overlap or touch made one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(start[1:] > end[:-1])
    return start[np.r_[0, cut + 1]], end[np.r_[cut, len(end) - 1]]


def _cut(docs: DataFrame, repeats, min_bytes: int) -> DataFrame:
    """Remove from each ``docs(doc_id, text, wanted, windows)`` its repeated stretches, but those alone, and its repeated windows."""

    def lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
        return np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy()), column.flatten()

    def run(batches):
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 500):
                batch = whole_batch.slice(at, 500)
                data, offsets = text_bytes(batch.column(1))
                found = []
                for piece in _pieces(batch.column(1), min_bytes):
                    with np.errstate(over="ignore"):
                        _, first, last, gram = stretches(piece.data, piece.offsets, min_bytes)
                    keep = bits_set(repeats.value, gram)
                    first, last = first[keep], last[keep]
                    doc = np.searchsorted(piece.offsets, first, "right") - 1
                    shift = piece.base - piece.offsets[doc]
                    found.append((doc + piece.first, first + shift, last + shift + min_bytes))
                doc, start, end = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
                lone_doc, flat = lists(batch.column(2))
                lone = flat.field(3).to_numpy(zero_copy_only=False).astype(bool)
                alone = lone_doc[lone] * (1 << 32) + flat.field(0).to_numpy(zero_copy_only=False)[lone]
                keep = ~np.isin(doc * (1 << 32) + start, alone)
                window_doc, window = lists(batch.column(3))
                window = window.to_numpy(zero_copy_only=False).astype(np.int64)
                doc, start, end = np.r_[doc[keep], window_doc], np.r_[start[keep], window], np.r_[end[keep], window + min_bytes]
                order = np.argsort(doc, kind="stable")
                doc, start, end = doc[order], start[order], end[order]
                spans, kept = [], []
                for i in range(batch.num_rows):
                    lo, hi = np.searchsorted(doc, [i, i + 1])
                    text = data[offsets[i] : offsets[i + 1]]
                    s, e = _merged(start[lo:hi], end[lo:hi])
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)])
                    kept.append(b"".join(text[x:y].tobytes() for x, y in zip(np.r_[0, e], np.r_[s, len(text)], strict=True)))
                columns = [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])

    return docs.select("doc_id", "text", "wanted", "windows").mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def _remove(docs: DataFrame, repeated: DataFrame, min_bytes: int) -> DataFrame:
    """The documents ``docs(doc_id, text, doc_key)`` without their repeats, whose anchors are among ``repeated(prefix_hash)``."""
    repeats = _broadcast(repeated, "prefix_hash")
    place = F.min(F.struct("doc_key", "first", "last", "anchor"))
    found = _stretch_hashes(docs, repeats, min_bytes)
    groups = found.groupBy("prefix_hash", "whole_hash").agg(F.count(F.lit(1)).alias("n"), place.alias("at"))
    groups = save(groups.select("prefix_hash", (F.col("n") == 1).alias("alone"), "at"))
    mixed = groups.groupBy("prefix_hash").agg(F.max("alone").alias("alone"), F.count(F.lit(1)).alias("kinds")).where("alone and kinds > 1").select("prefix_hash", F.lit(True).alias("mixed"))
    # A stretch that is alone is not removed whole; where others have its anchor, one of each kind is compared by windows.
    wanted = groups.join(mixed, "prefix_hash", "left").where("alone or mixed")
    item = F.struct("at.first", "at.last", "at.anchor", "alone", F.coalesce("mixed", F.lit(False)).alias("mixed"))
    wanted = save(wanted.groupBy("at.doc_key").agg(F.collect_list(item).cast(WANTED).alias("wanted")))
    bits = bits_for(wanted.count())
    some = bit_filter(wanted, "doc_key", bits)
    texts = save(maybe_in(docs, "doc_key", some, bits).join(wanted, "doc_key", "left"))

    compared = texts.where("exists(wanted, w -> w.mixed)")
    cores = save(_core_hashes(compared, min_bytes).groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"))
    cores = _broadcast(cores, "core")
    twice = save(_window_hashes(compared, cores, min_bytes).groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two"))
    again = _window_hashes(compared, cores, min_bytes, _broadcast(twice, "one"))
    single = again.join(twice, ["one", "two"], "left_semi").groupBy("doc_key").agg(F.collect_set("first").alias("windows"))

    none = F.lit(None)
    rest = maybe_in(docs, "doc_key", some, bits, negate=True).select("doc_id", "text", none.cast(WANTED).alias("wanted"), none.cast("array<int>").alias("windows"))
    cut = texts.join(single, "doc_key", "left").select("doc_id", "text", "wanted", "windows")
    return _cut(cut, repeats, min_bytes).unionByName(_cut(rest, repeats, min_bytes))


def remove_repeats(docs: DataFrame, min_bytes: int = 200) -> DataFrame:
    """Remove every byte that a string of ``min_bytes`` bytes covers which also starts elsewhere.

    Texts are UTF-8 bytes, null is empty; strings don't cross texts, overlap is
    allowed, and the input decides, not what is left of it. Returns one row per
    row of ``docs``: doc_id, n_bytes, spans (array of the maximal removed runs,
    start and end in bytes), kept (binary, all other bytes). Repeated rows are
    documents of their own, so their long strings are repeats. A null doc_id is
    returned as such. Texts under ``min_bytes`` stay whole; an empty table
    gives an empty result; other columns are ignored. A very long text is
    hashed in segments of some megabytes by one task. Strings are equal when
    128 bits of hashes are.

    The table is one batch of a new ``SuffixIndex``; an index that is kept
    takes more batches and gives the result over all of them.
    """
    index = SuffixIndex(docs.sparkSession, min_bytes)
    index.add(docs)
    return index.cut()


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(read_table(spark, sf_dir, "documents"), 200)
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
