"""Divergence of sources from each other and from their language, over a minimal acyclic transducer of terms.

The kept terms of a language are sorted and cut into shards of consecutive
terms. Each shard becomes a minimal acyclic transducer: an automaton with one
state for each set of endings, whose transitions carry numbers that add up to a
term's place in the sorted list. Texts are then streamed through the
transducers of their language, and all that follows counts, joins, ranks and
breaks ties by these ordinals; terms come back in for the final rows only.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.llm.storage import first_rows, read_table, save
from factlake.llm.words import LOWER, kinds_of_words, parts, text_bytes, word_bounds

#: Fixed by the contract: documents of a language that have a kept term, the smoothing, the scale and the ranks of terms.
LEAST_DOCS, SMOOTHING, ONE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes that aren't part of a term: up to @, between Z and a, between z and the first of a longer character.
NO_TERM = np.zeros(256, bool)
NO_TERM[0:0x41] = NO_TERM[0x5B:0x61] = NO_TERM[0x7B:0x80] = True
#: Terms of a shard at most; bytes of the transducers that a pass broadcasts.
SHARD, PASS = 1 << 17, 64 << 20
#: Rows that a task gathers before it sends them on; bytes of text that are read at a time.
GATHERED, CHUNK = 1 << 19, 1 << 20
#: Terms and sources of a block whose sources are compared.
TERMS, SOURCES = 1 << 16, 64


@dataclass
class Transducer:
    """A minimal acyclic transducer: transitions in order of 256 * state + byte, their targets and outputs, and the final states."""

    keys: np.ndarray
    targets: np.ndarray
    outputs: np.ndarray
    final: np.ndarray

    def ordinals(self, words: pa.Array) -> np.ndarray:
        """The place of each word among the terms, -1 for other words; all words step together."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] else np.zeros(0, np.uint8)
        size = np.diff(offsets)
        out = np.zeros(len(words), np.int64)
        state = np.zeros(len(words), np.int64)
        live, depth = np.arange(len(words)), 0
        while len(live):
            done = size[live] == depth
            ended = live[done]
            out[ended] = np.where(self.final[state[ended]], out[ended], -1)
            live = live[~done]
            key = state[live] * 256 + data[offsets[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(live), bool)
            out[live[~hit]] = -1
            live, at = live[hit], at[hit]
            state[live] = self.targets[at]
            out[live] += self.outputs[at]
            depth += 1
        return out


def build(terms: list[bytes]) -> Transducer:
    """The transducer of sorted distinct terms.

    States of the term before that the next one leaves behind are final in
    shape, so they are looked up among the states there are and shared.
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (is final, ((byte, target), ..)) of each shared state
    path: list[tuple[bool, list]] = [(False, [])]  # of the last term: (is final, transitions that are settled)
    labels: list[int] = []

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            shape = (final, tuple(edges))
            number = register.get(shape)
            if number is None:
                number = register[shape] = len(states)
                states.append(shape)
            path[-1][1].append((labels.pop(), number))

    before = b""
    for term in terms:
        common, most = 0, min(len(before), len(term))
        while common < most and before[common] == term[common]:
            common += 1
        settle(common)
        for byte in term[common:]:
            labels.append(byte)
            path.append((False, []))
        path[-1] = (True, path[-1][1])
        before = term
    settle(0)
    final, edges = path[0]
    states.append((final, tuple(edges)))
    size = [0] * len(states)  # terms that a state ends; targets come before their sources
    for k, (final, edges) in enumerate(states):
        size[k] = final + sum(size[t] for _, t in edges)
    keys, targets, outputs = [], [], []
    for k, (final, edges) in enumerate(reversed(states)):  # the start is state 0
        passed = int(final)
        for byte, target in edges:
            keys.append(k * 256 + byte)
            targets.append(len(states) - 1 - target)
            outputs.append(passed)
            passed += size[target]
    return Transducer(np.array(keys, np.int64), np.array(targets, np.int32), np.array(outputs, np.int32), np.array([f for f, _ in reversed(states)], bool))


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """(first text, last, distinct terms, term of each occurrence, text of each) for some texts at a time."""
    data, offsets = text_bytes(column)
    for a, b in parts(offsets, CHUNK):
        text, own = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends = word_bounds(text, own, NO_TERM)
        if len(starts):
            kinds, which = kinds_of_words(text, starts, ends)
            yield a, b, kinds, which.astype(np.int64), np.searchsorted(own, starts, "right") - 1


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, n): in how many of the documents of each language a term occurs; tasks add up theirs first."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("n", pa.int64())])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            code, langs = _codes(batch.column(0))
            for a, b, kinds, which, text in _chunks(batch.column(1)):
                once = np.unique(text * len(kinds) + which)  # a term of a document counts once
                pairs, n = np.unique(code[a:b][once // len(kinds)] * len(kinds) + once % len(kinds), return_counts=True)
                lang = pa.DictionaryArray.from_arrays(pa.array(pairs // len(kinds)), pa.array(langs, pa.string())).cast(pa.string())
                held.append(pa.Table.from_arrays([lang, kinds.take(pa.array(pairs % len(kinds))).cast(pa.binary()), pa.array(n)], schema=schema))
                rows += len(pairs)
                if rows > GATHERED:
                    whole = pa.concat_tables(held).group_by(["lang", "term"]).aggregate([("n", "sum")])
                    held = [whole.select(["lang", "term", "n_sum"]).rename_columns(["lang", "term", "n"])]
                    rows = held[0].num_rows
                    if rows > GATHERED // 2:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            whole = pa.concat_tables(held).group_by(["lang", "term"]).aggregate([("n", "sum")])
            yield from whole.select(["lang", "term", "n_sum"]).rename_columns(["lang", "term", "n"]).to_batches()

    return docs.select("lang", "text").mapInArrow(run, "lang string, term binary, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def transducers(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, ordinal, term) and (lang, shard, base, n, n_bytes, transducer), from ``kept(lang, term)``.

    Sorting deals ranges of terms to tasks. A task cuts its own into shards of
    SHARD terms and builds the transducer of each; where a shard's ordinals
    begin follows from the sizes of those before it.
    """
    names = ["lang", "first", "n", "transducer", "terms"]

    def run(batches):
        def shard(lang, terms):
            packed = pickle.dumps(build(terms))
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([terms[0]]), pa.array([len(terms)], pa.int64()), pa.array([packed]), pa.array([terms], pa.list_(pa.binary()))], names)

        lang, terms = None, []
        for batch in batches:
            for own, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if terms and (own != lang or len(terms) == SHARD):
                    yield shard(lang, terms)
                    terms = []
                lang = own
                terms.append(term)
        if terms:
            yield shard(lang, terms)

    tasks = 1 + kept.count() * 4 // SHARD
    ranges = kept.repartitionByRange(tasks, "lang", "term").sortWithinPartitions("lang", "term")
    shards = save(ranges.mapInArrow(run, "lang string, first binary, n long, transducer binary, terms array<binary>"))
    sizes = shards.select("lang", "first", "n")  # a row for thousands of terms
    base = sizes.alias("a").join(sizes.alias("b"), F.expr("a.lang = b.lang and b.first < a.first"), "left").groupBy("a.lang", "a.first").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("base"))
    shards = save(shards.join(base, ["lang", "first"]))
    terms = shards.select("lang", "base", F.posexplode("terms").alias("at", "term")).select("lang", (F.col("base") + F.col("at")).alias("ordinal"), F.col("term").cast("string").alias("term"))
    return terms, shards.select("lang", "base", "n", F.octet_length("transducer").alias("n_bytes"), "transducer")


def recount(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """(lang, source, ordinal, n): the occurrences of every kept term, from all texts streamed through the transducers.

    Each pass broadcasts transducers of PASS bytes at most, and streams the
    texts of their languages.
    """
    spark = docs.sparkSession
    passes, room = [[]], 0
    for r in shards.select("lang", "base", "n_bytes").orderBy("lang", "base").toLocalIterator():
        if passes[-1] and room + r["n_bytes"] > PASS:
            passes.append([])
            room = 0
        passes[-1].append((r["lang"], r["base"]))
        room += r["n_bytes"]
    found = []
    for wanted in passes:
        keys = spark.createDataFrame(wanted, "lang string, base long")
        own = shards.join(F.broadcast(keys), ["lang", "base"]).select("lang", "base", "transducer").collect()
        by_lang: dict[str, list] = {}
        for r in own:
            by_lang.setdefault(r["lang"], []).append((r["base"], pickle.loads(r["transducer"])))
        found.append(save(_counts(docs.join(F.broadcast(keys.select("lang").distinct()), "lang", "left_semi"), spark.sparkContext.broadcast(by_lang))))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _counts(docs: DataFrame, shared) -> DataFrame:
    names = ["lang", "source", "ordinal", "n"]

    def merged(held: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(held).group_by(names[:3]).aggregate([("n", "sum")])
        return whole.select([*names[:3], "n_sum"]).rename_columns(names)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            (lang_code, langs), (source_code, sources) = _codes(batch.column(0)), _codes(batch.column(1))
            for a, _, kinds, which, text in _chunks(batch.column(2)):
                for code in np.unique(lang_code[a + text]):
                    mine = lang_code[a + text] == code
                    used, own = np.unique(which[mine], return_inverse=True)
                    words, place = kinds.take(pa.array(used)), np.full(len(used), -1, np.int64)
                    for base, transducer in shared.value.get(langs[code], ()):
                        at = transducer.ordinals(words)
                        place[at >= 0] = base + at[at >= 0]
                    kept = place[own] >= 0
                    width = int(place.max(initial=0)) + 1
                    pairs, n = np.unique(source_code[a + text[mine]][kept] * width + place[own][kept], return_counts=True)
                    source = pa.DictionaryArray.from_arrays(pa.array(pairs // width), pa.array(sources, pa.string())).cast(pa.string())
                    held.append(pa.Table.from_arrays([pa.array([langs[code]] * len(pairs), pa.string()), source, pa.array(pairs % width), pa.array(n)], names))
                    rows += len(pairs)
                if rows > GATHERED:
                    held = [merged(held)]
                    rows = held[0].num_rows
                    if rows > GATHERED // 2:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from merged(held).to_batches()

    out = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, ordinal long, n long")
    return out.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(ONE * (count + 5) / (total + 5 * terms)), exact for any long."""
    over = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(ONE).cast("decimal(10,0)")
    under = total.cast("decimal(20,0)") + terms.cast("decimal(18,0)") * F.lit(SMOOTHING).cast("decimal(1,0)")
    return F.lit(1).cast("long") + F.call_function("div", over, under)


def exact_shares(over: np.ndarray, under: np.ndarray) -> np.ndarray:
    """1 + floor(ONE * over / under) for ``over`` up to ``under`` up to 2**53, three digits at a time."""
    out, rest = np.zeros(len(over), np.int64), over.astype(np.int64)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // under, rest % under
    return 1 + out


def _distances(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed differences of each two sources of a language.

    A source's shares of TERMS terms are one vector, its share of none where it
    lacks a term. Blocks of some SOURCES sources meet block by block within
    tasks, which give one sum for two sources.
    """
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCES).cast("int").alias("blocks"))
    pieces = F.expr(f"sequence(0L, greatest(0L, (terms - 1) div {TERMS}))")
    ground = groups.join(blocks, "lang").select("lang", "source", "total", "terms", "blocks", F.explode(pieces).alias("piece"))
    ground = ground.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    own = F.array_sort(F.collect_list(F.struct((F.col("ordinal") % TERMS).cast("int").alias("at"), "n")))
    sparse = counts.groupBy("lang", "source", F.expr(f"ordinal div {TERMS}").alias("piece")).agg(own.alias("own"))
    width = F.least(F.lit(TERMS), F.col("terms") - F.col("piece") * TERMS).cast("int")
    rows = ground.join(sparse, ["lang", "source", "piece"], "left").select("lang", "source", "piece", "block", "blocks", "total", "terms", width.alias("width"), "own")
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("lang", "piece", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "source", "total", "terms", "width", "own")

    def run(table: pa.Table) -> pa.Table:
        width = table.column("width")[0].as_py()
        terms = table.column("terms")[0].as_py()
        sources, block = table.column("source").to_pylist(), table.column("block").to_numpy()
        under = table.column("total").to_numpy() + SMOOTHING * terms
        shares = np.zeros((table.num_rows, width), np.int64)
        if width:
            shares[:] = exact_shares(np.full(table.num_rows, SMOOTHING), under)[:, None]
            own = table.column("own").combine_chunks()
            row, cells = np.repeat(np.arange(table.num_rows), own.value_lengths().fill_null(0).to_numpy()), own.flatten()
            shares[row, cells.field("at").to_numpy()] = exact_shares(cells.field("n").to_numpy() + SMOOTHING, under[row])
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        one, two, value = [], [], []
        for k in left:
            sums = np.abs(shares[right] - shares[k]).sum(axis=1).tolist()
            for m, s in zip(right.tolist(), sums, strict=True):
                if m != k:
                    one.append(sources[k]), two.append(sources[m]), value.append(s)
                    if i != j:
                        one.append(sources[m]), two.append(sources[k]), value.append(s)
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.table([pa.array(c, kind) for c, kind in zip(([table.column("lang")[0].as_py()] * len(one), one, two, value), kinds, strict=True)], ["lang", "source", "item", "value"])

    found = rows.groupBy("lang", "piece", "i", "j").applyInArrow(run, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence_audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """How far sources are from each other, and the terms that set each apart from its language.

    Terms are the longest runs of ASCII letters and characters beyond ASCII,
    A-Z lower-cased; a language keeps the terms of at least ``least_docs`` of
    its documents. Returns lang, source, part, item, value, rank: part "pair"
    has a row for each other source of the language, its value the summed
    absolute difference of the shares of all kept terms; part "term" has the
    ``top`` kept terms that occur in the source with a larger share than in
    the language. Ranks are from 1, by falling value, ties by the UTF-8 bytes
    of the item.

    Null text, lang and source count as empty, and so are a language and a
    source of their own. Sources without terms take part in pairs. A language
    without kept terms has pairs of value 0. Repeated rows are documents of
    their own; the order of rows doesn't matter. An empty table gives an empty
    result; other columns are ignored. A very long text is held whole by one
    task, beside it some 40 bytes a term.
    """
    empty = {c: F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")}
    docs = docs.select(*empty.values())
    kept = save(document_frequencies(docs).where(F.col("n") >= least_docs).select("lang", "term"))
    terms, shards = transducers(kept)
    counts = save(recount(docs, shards))

    sizes = shards.groupBy("lang").agg(F.sum("n").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    of_lang = counts.groupBy("lang").agg(F.sum("n").alias("all_total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").join(of_lang, "lang", "left")
    groups = save(groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "terms", "all_total"))))
    pairs = _distances(groups, counts)
    pair_rank = F.row_number().over(_by_value(F.col("item")))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", pair_rank.alias("rank"))

    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("all_n"))
    shares = counts.join(groups, ["lang", "source"]).join(whole, ["lang", "ordinal"])
    value = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("all_n"), F.col("all_total"), F.col("terms"))
    shares = shares.select("lang", "source", "ordinal", value.alias("value")).where("value > 0")
    best = first_rows(shares, ["lang", "source"], [F.desc("value"), F.col("ordinal")], top)
    best = best.withColumn("rank", F.row_number().over(_by_value(F.col("ordinal"))))
    best = best.join(terms, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(best)


def _by_value(then: Column):
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), then)


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with d as (
  select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from documents),
t as (select i, lang, source, unnest(ts) as term from d),
k as (select lang, term from t group by lang, term having count(distinct i) >= 30),
v as (select lang, count(*) as v from k group by lang),
g as (select distinct lang, source from d),
c as (select t.lang, t.source, t.term, count(*) as n from t join k on k.lang = t.lang and k.term = t.term group by all),
gk as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as total, v.v
  from g join k on k.lang = g.lang join v on v.lang = g.lang
  left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
lk as (select lang, term, sum(n) as n, sum(sum(n)) over (partition by lang) as total from gk group by lang, term),
p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v) as p from gk),
q as (select lk.lang, term, 1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v) as q from lk join v on v.lang = lk.lang),
pair as (
  select g.lang, g.source, 'pair' as part, h.source as item, (
      coalesce(s.value, 0))::bigint as value
  from g join g h on h.lang = g.lang and h.source <> g.source
  left join (
    select a.lang, a.source, b.source as other, sum(abs(a.p - b.p)) as value
    from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) s
  on s.lang = g.lang and s.source = g.source and s.other = h.source),
term as (
  select p.lang, p.source, 'term' as part, p.term as item, (p - q)::bigint as value
  from p join q on q.lang = p.lang and q.term = p.term where n > 0 and p > q),
r as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pair union all select * from term))
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 50
"""
