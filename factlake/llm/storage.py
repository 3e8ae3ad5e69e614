"""Intermediate tables, kept in the folder that all executors share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BITS_PER_BUCKET = 32768
#: Bytes of the rows that are sent to a Python worker at a time, where a stage asks for it.
BATCH_BYTES = 4 << 20
#: A key with more than 1 / HOT_SHARE of all rows, and more than HOT_ROWS, is dealt over SALTS tasks when it is joined.
HOT_SHARE, HOT_ROWS, SALTS = 4096, 500, 256


def scratch_folder(spark: SparkSession) -> str:
    """A new, unused folder name below ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset (tests on one
    machine) the folder is below the warehouse, which executors share as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/factlake-{uuid.uuid4().hex}"


def save(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate files with the file system that holds it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def rename_files(spark: SparkSession, path: str, suffix: str, new: str) -> None:
    """Move all files below ``path`` that end in ``suffix`` into it, as part-00000, part-00001 .. with the ending ``new``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed, n = files.listFiles(hadoop, True), 0
    found = []
    while listed.hasNext():
        at = listed.next().getPath()
        if at.getName().endswith(suffix):
            found.append(at)
    for at in found:
        files.rename(at, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(hadoop, f"part-{n:06d}{new}"))
        n += 1


def short_batches(spark: SparkSession) -> None:
    """Have rows sent to Python workers in batches of BATCH_BYTES, not of 64 MB, from now on in this session.

    A task holds several copies of a batch, in the JVM and in Python. No result depends on their size.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bit_filter(keys: DataFrame, column: str, bits: int = 1 << 24, hashed: bool = False) -> DataFrame:
    """A hash filter of the values of ``column``: one row per 4 KB slice of ``bits`` bits.

    It has at most ``bits / 8`` bytes whatever the number of keys, so it may be
    broadcast (2 MB by default). A full filter lets every row through, which
    costs time and never changes a result. ``hashed``: the values are hashes
    already, their last bits are the place.
    """
    place = F.pmod(F.col(column) if hashed else F.xxhash64(column), F.lit(bits))
    return keys.select(
        F.floor(place / BITS_PER_BUCKET).cast("int").alias("_slice"),
        (place % BITS_PER_BUCKET).alias("_bit"),
    ).groupBy("_slice").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def bits_for(n: int, least: int = 1 << 24, most: int = 1 << 29) -> int:
    """Bits of a filter of ``n`` values: 16 a value, but 64 MB at most; a power of two."""
    return min(most, max(least, 1 << (16 * max(1, n) - 1).bit_length()))


def bit_array(filter_: DataFrame, bits: int) -> np.ndarray:
    """A filter as an array of ``bits / 8`` bytes, for use within tasks."""
    out = np.zeros(bits // 8, np.uint8)
    for r in filter_.collect():
        out[r["_slice"] * (BITS_PER_BUCKET // 8) :][: BITS_PER_BUCKET // 8] = np.frombuffer(r["_bits"], np.uint8)
    return out


def bits_set(array: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the (unsigned) hashes may be in a filter of hashed values."""
    place = hashes & np.uint64(8 * len(array) - 1)
    return (array[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def maybe_in(df: DataFrame, column: str, filter_: DataFrame, bits: int = 1 << 24, negate: bool = False) -> DataFrame:
    """The rows whose ``column`` may be in ``filter_``: all that are, few that aren't. ``negate`` gives the others."""
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    set_ = F.expr("shiftright(cast(conv(hex(substring(_bits, _bit div 8 + 1, 1)), 16, 10) as int), _bit % 8) & 1 = 1")
    set_ = F.coalesce(set_, F.lit(False))
    return (
        df.withColumn("_slice", F.floor(place / BITS_PER_BUCKET).cast("int"))
        .withColumn("_bit", (place % BITS_PER_BUCKET).cast("int"))
        .join(F.broadcast(filter_), "_slice", "left")
        .where(~set_ if negate else set_)
        .drop("_slice", "_bit", "_bits")
    )


def hot_keys(df: DataFrame, key: str) -> DataFrame | None:
    """The values of ``key`` with many of the rows: HOT_SHARE values at most, whatever the size of ``df``; None if there are none."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS)
    least = F.lit(df.count() // HOT_SHARE)
    found = [F.lit(r[0]) for r in counts.where(F.col("_n") > least).select(key).collect()]
    return df.sparkSession.range(1).select(F.explode(F.array(*found)).alias("_key")) if found else None


def join_dealt(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: DataFrame | None | bool = False, by: list[str] | None = None) -> DataFrame:
    """Join ``left`` to ``right``, whose rows are few per key, by ``key``; no key of ``left`` is one task's.

    The rows of its hot keys are dealt over SALTS tasks, to each of which the
    rows that ``right`` has for them are sent. ``left`` is read twice unless
    ``hot`` is given, so it should be a stored table. Columns but ``key`` have
    different names. Where a row goes depends on its content (the columns
    ``by``, or all) and file only, so a task that runs again deals alike.
    """
    hot = hot_keys(left, key) if hot is False else hot
    if hot is None:
        return left.join(right, key, how)
    is_hot = F.col("_key").isNotNull()
    salt = F.when(is_hot, F.pmod(F.xxhash64(*(by or left.columns)) + F.spark_partition_id(), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    mine = left.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left").withColumn("_salt", salt).drop("_key")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    theirs = right.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left").withColumn("_salt", F.explode(salts)).drop("_key")
    return mine.join(theirs, [key, "_salt"], how).drop("_salt")


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; tasks cut their own rows before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
