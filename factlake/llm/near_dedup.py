"""MinHash near-duplicates with sequential Bayesian verification.

Documents with the same shingle set are one class from the start. Classes
whose signatures agree in a band share a bucket. In a bucket of a few classes
all are compared, in a larger one a pivot with the rest: signature batches are
read until the posterior of the similarity rules the pair out, survivors are
confirmed on their full sets, and confirmed links join components. A large
bucket that is one component then needs no more comparing. In the others every
two classes of different components are compared on their full sets, block by
block within tasks, so that pairs that aren't links are never rows; members of
the bucket's main component only meet the others.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.components import components
from factlake.llm.storage import bit_filter, hot_keys, join_dealt, maybe_in, read_table, save
from factlake.llm.words import mix, shingle_sets

#: Values in a signature, in a band of it, and in a batch of sequential comparing.
SIGNATURE, BAND, BATCH = 100, 4, 20
#: Classes of a bucket that are all compared; shingles and classes of a block in larger ones.
FEW, BLOCK, ROWS = 32, 1 << 18, 2000
#: Shingles that a block's matrices have as columns at a time.
COLUMNS = 1024
#: Bits of the filter of keys that several classes have.
KEY_BITS = 1 << 25
#: Chance at which a pair at the threshold may be ruled out by its posterior.
MISS = 1e-7
_rng = np.random.default_rng(7)
FACTOR = (_rng.integers(1, 1 << 31, SIGNATURE, dtype=np.uint32) * np.uint32(2)) | np.uint32(1)
SHIFT = _rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation over the set."""
    out = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 2048):
        values = FACTOR[:, None] * low[None, at : at + 2048]
        values += SHIFT[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def least_matches(percent: int) -> list[tuple[int, int]]:
    """(values compared, matches needed to go on) after each batch.

    With a uniform prior the similarity after m matches of n is Beta(m + 1,
    n - m + 1); the pair goes on while P(similarity >= percent) >= MISS.
    """
    t, out = percent / 100, []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        tail = 0.0
        for m in range(n + 1):  # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= MISS:
                break
        out.append((n, m))
    return out


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        bands = np.arange(SIGNATURE // BAND, dtype=np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows = []
                for found in shingle_sets(part.column(1), words):
                    if not len(found):
                        rows.append((0, None, None, []))
                        continue
                    with np.errstate(over="ignore"):
                        own = signature(found)
                        key = bands + np.uint64(1)
                        for k in range(BAND):
                            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + own[k::BAND])
                    rows.append((len(found), set_name(found), own.tobytes(), key.astype(np.int64)))
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *columns], ["doc_id", "text_hash", "n_shingles", "set_id", "signature", "keys"])

    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_id binary, signature binary, keys array<long>")


def set_name(found: np.ndarray) -> bytes:
    """A 128-bit hash of a set of shingles."""
    return hashlib.blake2b(found, digest_size=16).digest()


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(set_id, shingles) of the sets of ``docs``, each once."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                found = [s for s in shingle_sets(batch.column(0).slice(at, 200), words) if len(s)]
                names = [set_name(s) for s in found]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["set_id", "shingles"])

    sets = save(docs.select("text").mapInArrow(run, "set_id binary, shingles binary"))
    # Only sets that several rows have are shuffled to be one.
    again = bit_filter(sets.groupBy("set_id").count().where("count > 1"), "set_id")
    return maybe_in(sets, "set_id", again, negate=True).unionByName(maybe_in(sets, "set_id", again).dropDuplicates(["set_id"]))


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs that the sequential comparing of their signatures doesn't rule out."""
    steps = least_matches(percent)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                n = part.num_rows
                one, two = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint32).reshape(n, SIGNATURE) for k in (2, 3))
                alive, matches, done = np.arange(n), np.zeros(n, np.int64), 0
                for upto, need in steps:
                    matches[alive] += (one[alive, done:upto] == two[alive, done:upto]).sum(axis=1)
                    alive, done = alive[matches[alive] >= need], upto
                yield pa.RecordBatch.from_arrays([part.column(k).take(pa.array(alive)) for k in (0, 1, 4, 5)], ["a", "b", "name_a", "name_b"])

    return pairs.select("a", "b", "sign_a", "sign_b", "name_a", "name_b").mapInArrow(run, "a long, b long, name_a binary, name_b binary")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets with 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["a", "b"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def forest(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links ``(a, b)`` between components left and right those that join two for the first time."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.get(k, k)) != k:
            root[k] = root.get(up, up)
            k = root[k]
        return k

    out = []
    for x, y, i, j in zip(left.tolist(), right.tolist(), a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            out.append((min(i, j), max(i, j)))
    return out


def _block_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links between the blocks i and j of a bucket, no more than it takes to join their components.

    ``rows(key, i, j, block, id, label, shingles)``. Sets are multiplied as 0/1
    matrices over the shingles that both sides have, some columns at a time.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, labels, block = (table.column(c).to_numpy() for c in ("id", "label", "block"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = []
        if len(left) and len(right) and len(np.unique(labels)) > 1:
            size = np.array([len(x) for x in sets])
            _, code = np.unique(np.concatenate(sets), return_inverse=True)
            start = np.concatenate([[0], np.cumsum(size)])
            cells = []
            for side in (left, right):
                row = np.repeat(np.arange(len(side)), size[side])
                cells.append((row, np.concatenate([code[start[k] : start[k + 1]] for k in side])))
            both = np.intersect1d(cells[0][1], cells[1][1])
            shared = np.zeros((len(left), len(right)), np.float32)
            spots = []
            for row, col in cells:
                at = np.searchsorted(both, col)
                at[at == len(both)] = 0
                hit = both[at] == col if len(both) else np.zeros(len(col), bool)
                order = np.argsort(at[hit], kind="stable")
                spots.append((row[hit][order], at[hit][order]))
            for c in range(0, len(both), COLUMNS):
                parts = []
                for (row, col), n in zip(spots, (len(left), len(right)), strict=True):
                    lo, hi = np.searchsorted(col, [c, c + COLUMNS])
                    m = np.zeros((n, COLUMNS), np.float32)
                    m[row[lo:hi], col[lo:hi] - c] = 1
                    parts.append(m)
                shared += parts[0] @ parts[1].T
            found = []
            for r in range(0, len(left), 256):
                own, n = left[r : r + 256], shared[r : r + 256].astype(np.int64)
                union = size[own][:, None] + size[right][None] - n
                i_, j_ = np.nonzero((100 * n >= percent * union) & (labels[own][:, None] != labels[right][None]))
                found.append((own[i_], right[j_]))
            x, y = (np.concatenate(f) for f in zip(*found, strict=True))
            names, own = np.unique(labels, return_inverse=True)
            code = np.minimum(own[x], own[y]) * len(names) + np.maximum(own[x], own[y])
            _, first = np.unique(code, return_index=True)
            out = forest(own[x[first]], own[y[first]], ids[x[first]], ids[y[first]])
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows of ``keys(id, size, key)`` whose key several rows have, and a few others.

    Most keys are of one class only. They are counted once and told by a filter,
    so that rows of the others are never sorted nor shuffled.
    """
    again = save(bit_filter(keys.groupBy("key").count().where("count > 1"), "key", KEY_BITS))
    return save(maybe_in(keys, "key", again, KEY_BITS))


def _links(members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links: of all classes of small buckets, and of the pivot with the others in larger ones."""
    few = members.where(f"n <= {FEW}").select("key", "id", "size")
    pairs = few.join(few.toDF("key", "o_id", "o_size"), "key").where("id < o_id").select("id", "size", "o_id", "o_size")
    many = members.where(f"n > {FEW} and id <> pivot.id").select("id", "size", F.col("pivot.id").alias("o_id"), F.col("pivot.size").alias("o_size"))
    alike = f"100 * least(size, o_size) >= {percent} * greatest(size, o_size)"
    pairs = save(pairs.unionByName(many).where(alike).select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct())
    hot = {c: hot_keys(pairs, c) for c in ("a", "b")}
    for c in ("a", "b"):
        pairs = join_dealt(pairs, reps.select(F.col("id").alias(c), F.col("signature").alias(f"sign_{c}"), F.col("set_id").alias(f"name_{c}")), c, hot=hot[c])
    pairs = save(_likely(pairs, percent))
    hot = {c: hot_keys(pairs, c) for c in ("name_a", "name_b")}
    for c in ("a", "b"):
        pairs = join_dealt(pairs, sets.toDF(f"name_{c}", f"set_{c}"), f"name_{c}", hot=hot[f"name_{c}"])
    return save(_confirmed(pairs, percent))


def _open_buckets(large: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with their blocks.

    ``large(key, id, size, label)``. A bucket's most frequent component is its
    main one; members of it need no comparing with each other. Blocks hold
    BLOCK shingles and ROWS members on average; those of the main component
    have the numbers from 0, the rest follow.
    """
    parts = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"))
    total = parts.groupBy("key").agg(
        F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"), F.sum("volume").alias("volume"), F.max(F.struct("n", "volume", "label")).alias("main"),
    )

    def blocks(volume: str, n: str) -> Column:
        return F.ceil(F.greatest(F.expr(volume) / BLOCK, F.expr(n) / ROWS)).cast("int")

    total = total.where("labels > 1").select(
        "key", F.col("main.label").alias("main"), blocks("main.volume", "main.n").alias("first"), blocks("volume - main.volume", "n - main.n").alias("rest")
    )
    live = join_dealt(large.select("key", "id", "label"), total, "key")
    h = F.xxhash64("id")
    block = F.when(F.col("label") == F.col("main"), F.pmod(h, F.col("first"))).otherwise(F.col("first") + F.pmod(h, F.col("rest"))).cast("int")
    return live.select("key", "id", "label", "first", "rest", block.alias("block"))


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Link documents whose sets of ``words``-word shingles have a similarity of ``percent`` or more.

    Returns one row per row of ``docs``: doc_id, n_shingles, component_id
    (smallest doc_id that links reach, itself included), kept (doc_id =
    component_id), text_hash (64 bits of the text, to tell rows of one doc_id
    apart). A text with fewer words is one shingle; a null, empty
    or blank text has none and links with nothing. Rows that repeat a doc_id
    are rows of their own, each with the component of its own text; the answer
    doesn't depend on their order. A row with a null doc_id links with
    nothing, has a null component_id and is kept. Empty tables give empty
    results; other columns are ignored. A very long text is hashed in segments
    of a few megabytes; one task holds its set, 8 bytes a distinct shingle.

    Candidates are found with probability 1 - (1 - s**4)**25 at similarity s:
    all but 6e-6 of the pairs at 0.8, 1e-8 at 0.85. That larger buckets are
    compared with their pivot first loses nothing: if all members are then in
    one component, no link between them could change a component, and else
    every two members of different components are compared on their full sets.
    """
    docs = docs.select("doc_id", "text")
    sketches = save(_sketches(docs, words))
    linkable = sketches.where("set_id is not null and doc_id is not null")
    one = F.max(F.struct("n_shingles", "signature", "keys")).alias("x")  # alike in all rows of a set
    reps = linkable.groupBy("set_id").agg(F.min("doc_id").alias("first_doc"), one)
    reps = save(reps.select(F.monotonically_increasing_id().alias("id"), "set_id", "first_doc", F.col("x.n_shingles").alias("size"), "x.signature", "x.keys"))

    keys = shared_keys(save(reps.select("id", "size", F.explode("keys").alias("key"))))
    order = F.struct(F.xxhash64("id").alias("h"), "id", "size")
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("pivot")).where("n > 1")
    members = save(join_dealt(keys, buckets, "key"))
    wanted = reps.join(members.select("id").distinct(), "id", "left_semi")
    sets = _sets(maybe_in(docs, "doc_id", bit_filter(wanted, "first_doc")), words)
    links = _links(members, reps, sets, percent)
    labels = components(links)

    large = members.where(f"n > {FEW}").select("key", "id", "size").join(labels, "id", "left")
    live = save(_open_buckets(save(large.withColumn("label", F.coalesce("label", "id")))))
    if not live.isEmpty():
        other = F.when(F.col("block") < F.col("first"), F.expr("sequence(first, first + rest - 1)")).otherwise(F.expr("sequence(0, first + rest - 1)"))
        rows = live.join(reps.select("id", "set_id"), "id").join(sets, "set_id").withColumn("other", F.explode(other))
        rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "label", "shingles")
        more = save(_block_links(rows, percent))
        if not more.isEmpty():
            labels = components(links.select("a", "b").unionByName(more))
    # The smallest doc_id of each component, over its classes.
    own = save(reps.select("id", "set_id", "first_doc").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")))
    first = own.groupBy("label").agg(F.min("first_doc").alias("component"))
    own = join_dealt(own, first, "label").select("set_id", "component")
    out = join_dealt(sketches.select("doc_id", "text_hash", "n_shingles", "set_id"), own, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(read_table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) end) as sh from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.sh = y.sh and x.doc_id < y.doc_id group by all),
l as (
  select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * shared >= 85 * (na.n + nb.n - shared)),
e as (select a, b from l union all select b, a from l),
r as (
  select doc_id as x, doc_id as y from documents union select r.x, e.b from r join e on e.a = r.y),
c as (select x as doc_id, min(y) as component_id from r group by x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n on n.doc_id = d.doc_id join c on c.doc_id = d.doc_id
"""
