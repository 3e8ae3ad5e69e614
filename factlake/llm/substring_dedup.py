"""Removal of long repeated word sequences, found through anchors at the places of a difference cover.

A cover of the numbers modulo PERIOD has, for every two places of a text, a
shift below PERIOD that brings both onto it. So if only the strings of
``words - PERIOD + 1`` words that start at cover places are hashed (five of
twenty-one), two equal windows of ``words`` words share one at the same
distance from their starts: their aligned anchor.

An anchor that occurs once rules out the windows that hold it. The others are
extended as far as windows with this anchor reach, to both sides at once: where
such a stretch occurs twice, all its windows do. What is left are the ends of
matches. There, one stretch of each kind shows its windows, and those that
occur twice are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.storage import bit_array, bit_filter, bits_for, bits_set, hot_keys, join_dealt, maybe_in, read_table, save
from factlake.llm.words import BASE, hashed_words, mix, parts, powers, text_bytes, word_bounds

#: Largest period; a window of fewer words has one of three fifths of its words.
PERIOD = 21
SECOND = 0xC2B2AE3D27D4EB4F | 1
#: Texts that a task cuts together.
ROWS = 500
#: Places are spread by it before they go into a filter.
SPREAD = 2654435761
SPOT = f"doc_key ^ (cast(place as long) * {SPREAD}L)"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def difference_cover(period: int) -> list[int]:
    """The smallest set, first in order, whose differences modulo ``period`` are all the numbers below it."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return list(cover)
    raise ValueError("a period is at least 1")


@dataclass
class Plan:
    """Window, period, cover and anchor length, in words."""

    words: int
    period: int
    on_cover: np.ndarray

    @property
    def anchor(self) -> int:
        return self.words - self.period + 1


def plan_for(words: int) -> Plan:
    period = min(PERIOD, max(1, words * 3 // 5))
    on_cover = np.zeros(period, bool)
    on_cover[difference_cover(period)] = True
    return Plan(words, period, on_cover)


@dataclass
class Anchors:
    """The anchors of some texts: text, place in it, places in ``hashes``, the text's ends there, and the anchors' hashes."""

    text: np.ndarray
    place: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    one: np.ndarray


def run_hashes(hashes: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of words from start to end."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(base, len(hashes)), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(pow(base, -1, 1 << 64), len(sums))[start])


def anchors(hashes: np.ndarray, first: np.ndarray, plan: Plan) -> Anchors:
    """All anchors of the texts whose words begin at ``first``; texts too short for a window have none."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(hashes)) - first[text]
    high = first[1:][text]
    on = plan.on_cover[place % plan.period] & (first[:-1][text] + place + plan.anchor <= high) & ((high - first[:-1][text]) >= plan.words)
    at = np.flatnonzero(on)
    text, place, high = text[at], place[at], high[at]
    return Anchors(text, place, at, first[:-1][text], high, run_hashes(hashes, BASE, at, at + plan.anchor))


def stretch(found: Anchors, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of all windows that hold each anchor."""
    return np.maximum(found.low, found.at - plan.period + 1), np.minimum(found.high, found.at + plan.words)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes of words, first word of each) for some texts of a batch (doc_key, text) at a time."""
    at = 0
    for hashes, first in hashed_words(batch.column(1), lower=False):
        yield at, hashes, first
        at += len(first) - 1


def _arrow(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)


def _anchor_hashes(docs: DataFrame, plan: Plan) -> DataFrame:
    """(anchor, n): the anchors of all texts, counted within some texts."""

    def run(batches):
        for batch in batches:
            for _, hashes, first in _texts(batch):
                with np.errstate(over="ignore"):
                    kinds, n = np.unique(anchors(hashes, first, plan).one, return_counts=True)
                yield _arrow([kinds, n], ["anchor", "n"])

    return docs.select("doc_key", "text").mapInArrow(run, "anchor long, n long")


def _stretches(docs: DataFrame, again, plan: Plan) -> DataFrame:
    """(doc_key, anchor, whole, place) of the stretches whose anchor may be repeated."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for at, hashes, first in _texts(batch):
                with np.errstate(over="ignore"):
                    found = anchors(hashes, first, plan)
                    keep = bits_set(again.value, found.one)
                    start, end = (x[keep] for x in stretch(found, plan))
                    shape = (found.at[keep] - start) * 1000003 + (end - found.at[keep])
                    whole = mix(run_hashes(hashes, SECOND, start, end) ^ mix(shape.astype(np.uint64)))
                yield _arrow([keys[at + found.text[keep]], found.one[keep], whole, found.place[keep].astype(np.int32)], ["doc_key", "anchor", "whole", "place"])

    return docs.select("doc_key", "text").mapInArrow(run, "doc_key long, anchor long, whole long, place int")


def spots(keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number for each place of each text, as SPOT gives it."""
    return keys.astype(np.uint64) ^ (place.astype(np.uint64) * np.uint64(SPREAD))


def _windows(docs: DataFrame, again, shown, plan: Plan) -> DataFrame:
    """(doc_key, start, one, two): the windows of stretches that may be in ``shown``, each once."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for at, hashes, first in _texts(batch):
                with np.errstate(over="ignore"):
                    found = anchors(hashes, first, plan)
                    keep = bits_set(again.value, found.one) & bits_set(shown.value, spots(keys[at + found.text], found.place))
                    low, high = (x[keep] for x in stretch(found, plan))
                    count = np.maximum(high - plan.words + 1 - low, 0)
                    start = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    start = np.unique(start)
                    one, two = (run_hashes(hashes, base, start, start + plan.words) for base in (BASE, SECOND))
                text = np.searchsorted(first, start, "right") - 1
                yield _arrow([keys[at + text], (start - first[text]).astype(np.int32), one, two], ["doc_key", "start", "one", "two"])

    return docs.select("doc_key", "text").mapInArrow(run, "doc_key long, start int, one long, two long")


def spans_of(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs in order with those that overlap or touch made one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(start[1:] > end[:-1])
    return (start[np.r_[0, cut + 1]], end[np.r_[cut, len(end) - 1]]) if len(start) else (start, end)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words from starts to ends with a blank after each, and where each text's begin (``number`` is the first word of each, one more)."""
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(to[-1], 32, np.uint8)
    shift = np.repeat(to[:-1] - starts, size)
    place = np.arange(size.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(size)])[:-1], size) if len(size) else np.zeros(0, np.int64)
    out[place + shift] = data[place]
    return out, to[number]


def _cut(docs: DataFrame, again, plan: Plan) -> DataFrame:
    """Remove from each ``docs(doc_id, text, alone, starts)`` its stretches with repeated anchors, but those alone, and the windows at ``starts``."""
    names = ["doc_id", "n_words", "spans", "kept"]

    def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy()), column.flatten().to_numpy().astype(np.int64)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                data, offsets = text_bytes(batch.column(1))
                alone_text, alone = lists(batch.column(2))
                window_text, window = lists(batch.column(3))
                alone = alone_text << 40 | alone
                n_words, spans, kept = np.zeros(batch.num_rows, np.int64), [], []
                for (a, b), (hashes, first) in zip(parts(offsets), hashed_words(batch.column(1), lower=False), strict=True):
                    text = data[offsets[a] : offsets[b]]
                    starts, ends = word_bounds(text, offsets[a : b + 1] - offsets[a])
                    with np.errstate(over="ignore"):
                        found = anchors(hashes, first, plan)
                        keep = bits_set(again.value, found.one) & ~np.isin((found.text + a) << 40 | found.place, alone)
                        low, high = (x[keep] for x in stretch(found, plan))
                    here = (window_text >= a) & (window_text < b)
                    more = first[window_text[here] - a] + window[here]
                    # A gap of one between texts keeps their runs apart.
                    gap = np.r_[found.text[keep], window_text[here] - a]
                    low, high = spans_of(np.r_[low, more] + gap, np.r_[high, more + plan.words] + gap)
                    cut = np.searchsorted(low, first + np.arange(len(first)))
                    gap = np.repeat(np.arange(b - a), np.diff(cut))
                    low, high = low - gap, high - gap
                    stays = np.cumsum(np.bincount(low, minlength=len(hashes) + 1) - np.bincount(high, minlength=len(hashes) + 1))[:-1] == 0
                    n_words[a:b] = np.diff(first)
                    line, begin = joined(text, starts[stays], ends[stays], np.concatenate([[0], np.cumsum(stays)])[first])
                    for k in range(b - a):
                        mine = slice(cut[k], cut[k + 1])
                        spans.append([{"start": x, "end": y} for x, y in zip((low[mine] - first[k]).tolist(), (high[mine] - first[k]).tolist(), strict=True)])
                        kept.append(line[begin[k] : max(begin[k], begin[k + 1] - 1)].tobytes().decode())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(spans, SPANS), pa.array(kept, pa.string())], names)

    return docs.select("doc_id", "text", "alone", "starts").mapInArrow(run, "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept string")


def _broadcast(hashes: DataFrame, column: str):
    """A filter of hashes for use in tasks, of 64 MB at most; a full one lets all through, which is slower only."""
    bits = bits_for(hashes.count())
    return hashes.sparkSession.sparkContext.broadcast(bit_array(bit_filter(hashes, column, bits, hashed=True), bits))


def remove_repeated_words(docs: DataFrame, words: int = 35) -> DataFrame:
    """Remove every word that a sequence of ``words`` words covers which also starts elsewhere.

    Words are the longest runs of other than ``[\\x20\\x09-\\x0D]``, unchanged;
    sequences don't cross texts, may overlap and may be of one text, and the
    input decides, not what is left of it. Returns one row per row of
    ``docs``: doc_id, n_words, spans (array of the maximal removed runs, start
    and end in words), kept (the other words, joined by one space).

    Null, empty and blank texts have no words, and kept is empty. Repeated
    rows are documents of their own, so their long sequences are repeats. A
    null doc_id is returned as such. Texts under ``words`` words lose nothing;
    an empty table gives an empty result; other columns are ignored. One task
    holds a very long text whole, beside it some 40 bytes a word. Words are
    equal when 64 bits of a keyed hash are, sequences when 128 bits are.
    """
    plan = plan_for(words)
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc_key"))
    count = F.count(F.lit(1)).alias("n")
    repeated = _anchor_hashes(docs, plan).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    again = _broadcast(save(repeated), "anchor")

    groups = _stretches(docs, again, plan).groupBy("anchor", "whole").agg(count, F.min(F.struct("doc_key", "place")).alias("at"))
    groups = save(groups.select("anchor", (F.col("n") == 1).alias("alone"), "at.doc_key", "at.place"))
    # A stretch that is alone stays but for its windows; where others have its anchor, one of each kind shows its windows.
    mixed = groups.groupBy("anchor").agg(F.max("alone").alias("some"), count).where("some and n > 1").select("anchor")
    shown = save(join_dealt(groups, mixed, "anchor").select(F.expr(SPOT).alias("spot")))
    windows = save(_windows(docs, again, _broadcast(shown, "spot"), plan))
    twice = windows.groupBy("one", "two").agg(count).where("n > 1").select("one", F.col("two").alias("same"))
    starts = join_dealt(windows, twice, "one").where("two = same").select("doc_key", F.lit(None).cast("int").alias("place"), "start")
    wanted = groups.where("alone").select("doc_key", "place", F.lit(None).cast("int").alias("start")).unionByName(starts)
    wanted = save(wanted.groupBy("doc_key").agg(F.collect_list("place").alias("alone"), F.collect_list("start").alias("starts")))

    bits = bits_for(wanted.count())
    some, none = bit_filter(wanted, "doc_key", bits), F.lit(None).cast("array<int>")
    rest = maybe_in(docs, "doc_key", some, bits, negate=True).select("doc_id", "text", none.alias("alone"), none.alias("starts"))
    cut = join_dealt(maybe_in(docs, "doc_key", some, bits), wanted, "doc_key", "left", hot=hot_keys(docs, "doc_key"), by=["doc_id"])
    return _cut(cut, again, plan).unionByName(_cut(rest, again, plan))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_words(read_table(spark, sf_dir, "documents"), 35)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with w as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') as ws from documents),
s as (
  select doc_id, unnest(range(1, len(ws) - 33)) as i, ws from w where len(ws) >= 35),
h as (select doc_id, i, sha256(array_to_string(ws[i:i+34], ' ')) as h from s),
r as (select doc_id, i from h where h in (select h from h group by h having count(*) > 1)),
g as (select distinct doc_id, unnest(range(i, i + 35)) as k from r),
gone as (select doc_id, list(k) as ks, count(*) as n from g group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n, 0) as n_removed,
  sha256(array_to_string(case when n is null then ws else list_filter(ws, lambda x, k: not list_contains(ks, k)) end, ' ')) as kept_sha256
from w left join gone on gone.doc_id = w.doc_id
"""
