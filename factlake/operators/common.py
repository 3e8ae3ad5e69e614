"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.operators.store import save

#: Rows up to which a parameter table (points, viewers, a registry) is broadcast.
SMALL = 10_000
#: Names up to which every label is compared with each; characters of a gram; labels with a gram that a task compares on average.
FEW_NAMES, GRAM, GRAM_ROWS = 64, 3, 20_000


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has SMALL rows at most, else as it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts each task's rows before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def sorted_set(column: Column | str) -> Column:
    return F.array_sort(F.collect_set(column))


def grams(label: str) -> Column:
    """The distinct strings of GRAM characters of a label."""
    places = F.expr(f"sequence(1, greatest(length({label}) - {GRAM - 1}, 1))")
    return F.array_distinct(F.transform(places, lambda k: F.substring(label, k, F.lit(GRAM))))


def holding(rows: DataFrame, label: Column, names: DataFrame, wanted: Column) -> DataFrame:
    """Pairs of ``rows`` and ``names`` where ``label`` holds ``wanted``.

    A few names are broadcast. Of many, each meets the labels by the one of its
    grams that the fewest labels have: grams are counted over all labels, so a
    beginning that all names share joins nothing. A gram that many labels have
    all the same is dealt over tasks. Only names shorter than a gram are
    compared with every label. Null labels and names hold nothing.
    """
    rows, names = rows.withColumn("_label", label), names.withColumn("_wanted", wanted).where("_wanted is not null")
    held = F.contains("_label", "_wanted")
    if names.limit(FEW_NAMES + 1).count() <= FEW_NAMES:
        return rows.join(F.broadcast(names), held).drop("_label", "_wanted")
    asked = save(names.where(f"length(_wanted) >= {GRAM}").select("_wanted").distinct().select("_wanted", F.explode(grams("_wanted")).alias("_gram")))
    labels = rows.where("_label is not null").withColumn("_gram", F.explode(grams("_label")))
    known = asked.select("_gram").distinct()
    counts = save(labels.select("_gram").join(known, "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n")))
    # A name with a gram that no label has is held by none.
    rare = asked.join(counts, "_gram", "left").groupBy("_wanted").agg(F.min(F.struct(F.coalesce("_n", F.lit(0).cast("long")).alias("n"), F.col("_gram").alias("gram"))).alias("_rare"))
    rare = save(rare.where("_rare.n > 0").select("_wanted", F.col("_rare.gram").alias("_gram"), F.ceil(F.col("_rare.n") / GRAM_ROWS).cast("int").alias("_parts")))
    met = names.join(rare, "_wanted").withColumn("_part", F.explode(F.expr("sequence(0, _parts - 1)"))).drop("_parts")
    parts = rare.groupBy("_gram").agg(F.max("_parts").alias("_parts"))
    found = labels.join(parts, "_gram").withColumn("_part", F.pmod(F.xxhash64(*[c for c, kind in labels.dtypes if "map<" not in kind]), F.col("_parts")).cast("int")).drop("_parts")
    long = found.join(met, ["_gram", "_part"]).where(held).drop("_gram", "_part")
    short = rows.join(small(names.where(f"length(_wanted) < {GRAM}")), held)
    return long.unionByName(short.select(long.columns)).drop("_label", "_wanted")


def paired(rows: DataFrame, asked: DataFrame, condition: Column) -> DataFrame:
    """Every row with every one of ``asked`` that fits ``condition``.

    A stated set of queries against all rows: a small one is broadcast, a
    larger one is cut in blocks of SMALL, and each block meets all rows, which
    are dealt over tasks.
    """
    n = asked.count()
    if n <= SMALL:
        return rows.join(F.broadcast(asked), condition)
    blocks, tasks = -(-n // SMALL), 256
    left = rows.withColumn("_task", F.pmod(F.xxhash64(*rows.columns), F.lit(tasks))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("_task", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))))
    return left.join(right, ["_block", "_task"]).where(condition).drop("_block", "_task")
