"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.storage import read_table, save
from factlake.llm.words import word_counts

#: A document is taken this many times at most; so a source's target is at most so many times its size.
MOST_COPIES = 3
#: Rows of a block on average, and blocks whose rests meet in one block of the next level.
BLOCK, REST_BLOCKS = 500, 100
#: Units that a block holds back for the landing, at least.
RESERVE = 12
#: Units of more than LARGE mean sizes of their source are decided before the others; MOST units of a source at most.
#: A source's blocks hold back MOST units at most for the landing where there are more than RESERVE a block.
LARGE, MOST = 16, 50_000
EPS = 1e-9


def fly(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase: move the inclusion probabilities through the null-space of
    the two balancing totals until two at most are neither 0 nor 1.

    Three open units have one direction that changes neither the number of
    documents nor the number of words: ``(c - b, a - c, b - a)`` of their sizes
    a, b, c. The step along it, up or down, is drawn so that each probability
    keeps its mean; it ends where a unit reaches 0 or 1.
    """
    p, x = pi.tolist(), size.tolist()
    draws = iter(rng.random(len(p) + 1).tolist())
    open_: list[int] = []
    for unit in range(len(p)):
        if not EPS < p[unit] < 1 - EPS:
            p[unit] = float(round(p[unit]))
            continue
        open_.append(unit)
        if len(open_) < 3:
            continue
        i, j, k = open_
        u = (x[k] - x[j], x[i] - x[k], x[j] - x[i])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = down = np.inf
        for unit_, d in zip(open_, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[unit_]) / d), min(down, p[unit_] / d)
            elif d < 0:
                up, down = min(up, p[unit_] / -d), min(down, (1 - p[unit_]) / -d)
        step = up if next(draws) * (up + down) < down else -down
        still = []
        for unit_, d in zip(open_, u, strict=True):
            p[unit_] += step * d
            if EPS < p[unit_] < 1 - EPS:
                still.append(unit_)
            else:
                p[unit_] = float(round(p[unit_]))
        open_ = still
    return np.array(p)


def fly_most(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator, enough: bool, reserve: int = RESERVE) -> np.ndarray:
    """Fly all but a reserve of small units and some spread over all sizes.

    With ``enough`` the reserve grows until it can make up for the rounding of
    the largest unit; else other blocks add theirs.
    """
    open_ = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    by_size = open_[np.argsort(size[open_], kind="stable")]
    held = by_size
    while reserve < len(by_size):
        spread = np.linspace(0, len(by_size) - 1, reserve * 3 // 4).astype(int)
        held = np.union1d(by_size[: reserve // 4], by_size[spread])
        lesser = held[held != by_size[-1]]
        if not enough or (size[lesser] * np.minimum(pi[lesser], 1 - pi[lesser])).sum() >= size[by_size[-1]]:
            break
        reserve, held = 2 * reserve, by_size
    out = pi.copy()
    rest = np.setdiff1d(np.arange(len(pi)), held)
    out[rest] = fly(pi[rest], size[rest], rng)
    return out


def land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the open units from the largest to the smallest, each so that the
    words stay nearest to their total: small ones make up for large ones."""
    out, over = pi.copy(), 0.0
    open_ = np.flatnonzero((out > EPS) & (out < 1 - EPS))
    for k in open_[np.argsort(-size[open_], kind="stable")]:
        no, yes = over - size[k] * out[k], over + size[k] * (1 - out[k])
        take = abs(yes) < abs(no)
        out[k], over = float(take), yes if take else no
    return np.round(out)


def _level(rows: DataFrame) -> DataFrame:
    """Fly each block; the only block of a source lands, others hold back their share of ``reserve`` units."""

    def run(key, table):
        table = table.sort_by([("doc_id", "ascending"), ("text_hash", "ascending"), ("size", "ascending"), ("copy", "ascending")])
        seed = hashlib.sha256(repr([k.as_py() for k in key]).encode()).digest()
        pi, size = table.column("pi").to_numpy(), table.column("size").to_numpy()
        rng = np.random.default_rng(int.from_bytes(seed[:8], "little"))
        blocks, reserve = table.column("blocks")[0].as_py(), max(table.column("reserve").to_pylist())
        last = blocks <= 1
        out = fly_most(pi, size, rng, last, RESERVE if last else max(RESERVE, -(-reserve // blocks)))
        out = land(out, size) if last else out
        return table.set_column(table.schema.get_field_index("pi"), "pi", pa.array(out, pa.float64()))

    return rows.groupBy("source", "level", "block").applyInArrow(run, rows.schema)


def large_first(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decide the large open units of each source, and let the others make up for it.

    One very long document can outweigh all that blocks hold back. So units of
    more than LARGE mean sizes (and of more than 1 / MOST of their source, so
    there are fewer than MOST) land on their own, and what they miss goes into
    the probabilities of the source's other open units, however many these are.
    Returns the rows decided, and the others with their new pi and reserve.
    """
    least = F.col("source_size") * F.greatest(LARGE / F.col("n"), F.lit(1 / MOST))
    open_ = f"pi > {EPS} and pi < 1 - {EPS}"
    is_large = F.expr(open_) & (F.col("size") > least)
    decided = save(_level(rows.where(is_large).withColumns({"level": F.lit(-1), "block": F.lit(0).cast("long"), "blocks": F.lit(1).cast("long")})))
    others = rows.where(~is_large)
    got = decided.groupBy(F.col("source").alias("of")).agg(F.sum(F.col("size") * F.col("pi")).alias("got"))
    parts = rows.where(open_).groupBy("source").agg(F.max("pi").alias("pi"), F.sum(F.when(is_large, F.col("size"))).alias("large"), F.sum(F.when(~is_large, F.col("size"))).alias("small"))
    shift = (F.col("large") * F.col("pi") - F.col("got")) / F.col("small")
    shifts = parts.join(got, F.expr("source <=> of")).where("small > 0").select("of", shift.alias("shift"))
    pi = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("pi") + F.coalesce("shift", F.lit(0.0))))
    others = others.join(shifts, F.expr("source <=> of"), "left").withColumn("pi", F.when(F.expr(open_), pi).otherwise(F.col("pi")))
    # Twice the units of mean size whose rounding offsets the largest of the others.
    need = 2 * F.greatest(F.lit(float(LARGE)), F.col("n") / MOST) / F.greatest(F.lit(EPS), F.least("pi", 1 - F.col("pi")))
    need = F.ceil(F.least(F.lit(float(MOST)), need)).cast("int")
    return decided, others.withColumn("reserve", F.when(F.expr(open_), need).otherwise(0)).select(rows.columns)


def targets(sources: DataFrame) -> DataFrame:
    """``sources(source, source_size, n)`` with weight and target.

    Weights 1, 2, 3 repeat in code-point order, null last. Shares go by weight;
    a target stops at MOST_COPIES times its source's size and the excess is
    shared again by weight. Only sums over all sources reach the driver.
    """
    spark = sources.sparkSession
    in_order = sources.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], x[1] % 3 + 1))
    ranked = save(spark.createDataFrame(in_order, "source string, source_size long, n long, weight int"))
    most = F.col("source_size") * MOST_COPIES
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    unit, before = 0.0, -1.0
    while unit > before:
        full = F.col("weight") * F.lit(unit) >= most
        used, weight = ranked.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        before, unit = unit, max(unit, (total - (used or 0)) / weight) if weight else unit
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(float(unit)), most.cast("double")))


def mix_sources(docs: DataFrame) -> DataFrame:
    """Take documents, some several times, so that each source comes near its target.

    Each row of a source whose target is r times its size is taken floor(r)
    times, and once more with probability r - floor(r); these draws balance
    words and documents. A source's few very large rows are drawn first, and
    the others' probability makes up for them. Blocks of rows fly on their own,
    their few open rows go on to the next level, and one last block a source
    lands; a source's draw doesn't depend on other sources but by its target.
    Returns one row per row of ``docs``: doc_id, size, source_size, target,
    taken, copies, source, text_hash. Null, empty and blank texts have size 0
    and are not taken. A null source is a source of its own, the last. Null and
    repeated ids are rows like others; the draw depends on doc_id and text
    only, so reruns agree. An empty table gives an empty result; other
    columns are ignored. A very long text is counted in segments.
    """

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(word_counts(part.column(3)))], ["doc_id", "source", "text_hash", "size"])

    sizes = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), "text")
    sizes = sizes.mapInArrow(count, "doc_id long, source string, text_hash long, size long")
    # Repeated rows are counted, numbered and dealt over tasks, so that a row that is there very often is not one block.
    sizes = sizes.groupBy("doc_id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("rows"))
    parts = sizes.withColumn("part", F.explode(F.expr(f"sequence(0L, (rows - 1) div {BLOCK})"))).repartition("doc_id", "text_hash", "part")
    copy = F.explode(F.expr(f"sequence(part * {BLOCK}, least(rows, (part + 1) * {BLOCK}) - 1)"))
    sizes = save(parts.withColumn("copy", copy).drop("rows", "part"))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = save(targets(save(sources)))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST_COPIES)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    whole = F.floor(F.col("rate") + EPS).cast("int")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("long")
    joined = (
        sizes.join(sources.withColumnRenamed("source", "of"), F.expr("source <=> of")).drop("of")
        .withColumn("rate", rate).withColumn("whole", whole)
        .withColumn("pi", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("rate") - whole)).otherwise(0.0))
        .withColumn("whole", F.when(F.col("size") > 0, F.col("whole")).otherwise(0))
        .withColumn("level", F.lit(0)).withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash", "copy"), blocks))
        .withColumn("blocks", blocks).withColumn("reserve", F.lit(0))
        .select("doc_id", "source", "text_hash", "copy", "size", "source_size", "target", "n", "whole", "pi", "level", "block", "blocks", "reserve")
    )
    n_blocks = sources.agg(F.max(blocks)).first()[0] or 1
    decided, rows = large_first(save(joined))
    done, level = [decided], 0
    while True:
        rows = save(_level(rows))
        done.append(rows.where(f"pi <= {EPS} or pi >= 1 - {EPS}"))
        if n_blocks <= 1:
            break
        level, n_blocks = level + 1, -(-n_blocks // REST_BLOCKS)
        up = {"level": F.lit(level), "block": F.floor(F.col("block") / REST_BLOCKS), "blocks": F.ceil(F.col("blocks") / REST_BLOCKS)}
        rows = rows.where(f"pi > {EPS} and pi < 1 - {EPS}").withColumns(up)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.round("pi").cast("int")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source", "text_hash")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))
