"""A corpus pipeline of five stages over ``documents``; each is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.llm.byte_bpe import encode_documents
from factlake.llm.exact_dedup import exact_dedup, normalised
from factlake.llm.language_id import judge, learn_outside
from factlake.llm.mixing import mix_sources
from factlake.llm.near_dedup import near_dedup
from factlake.llm.storage import bit_filter, join_dealt, maybe_in, read_table, save, short_batches

#: A text whose best dictionary saves less than this share over the second is rejected.
LEAST_MARGIN = 0.002
#: Bits of a filter of rows that a stage must join; the texts of the others aren't shuffled. A full filter lets all through.
BITS = 1 << 25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language ID rejects: no letter, or a narrow margin.

    Each row is judged by its own text; rows whose text is null or has no
    letter go. A row with a null doc_id or a repeated one is judged as any
    other. An empty table stays empty; other columns come through unchanged. A
    very long text is compressed in pieces within one task.
    """
    short_batches(spark)
    name = "_" + "_".join(docs.columns)  # no other column has it
    judged = judge(docs, learn_outside(docs), LEAST_MARGIN, name)
    return judged.where(~F.col(name)["rejected"]).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts (blanks don't count).

    The longest text stays, then the smallest doc_id; a group without ids keeps
    one row. Null and empty texts are one group. Of repeated rows one stays. An
    empty table stays empty; other columns come through unchanged, of the row
    that is first by a hash of all columns where rows tie. A very long text is normalised
    within the JVM, whole.
    """
    found = exact_dedup(docs)
    repeated = save(bit_filter(found.where("group_size > 1"), "text_sha256", BITS))
    kept = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    kept = maybe_in(kept, "_sha", repeated, BITS)
    every = docs.withColumn("_norm", F.sha2(normalised(), 256))
    alone, texts = maybe_in(every, "_norm", repeated, BITS, negate=True), maybe_in(every, "_norm", repeated, BITS)
    same = (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("_norm") == F.col("_sha"))
    first = Window.partitionBy("_norm", "doc_id").orderBy(F.length("text").desc_nulls_last(), "text", F.xxhash64(*docs.columns))
    return texts.join(kept, same).withColumn("_row", F.row_number().over(first)).where("_row = 1").select(docs.columns).unionByName(alone.select(docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five words, 0.8).

    Which row stays goes by doc_id and text, not by doc_id alone: a row that
    repeats a dropped row's id with another text is judged by that text. Rows with a null doc_id, or a text without words, are
    kept. Repeated rows of the kept id and text stay as they came. An empty
    table stays empty; other columns come through unchanged. A very long text
    is hashed in segments.
    """
    short_batches(spark)
    dropped = save(near_dedup(docs).where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    hashes = save(bit_filter(dropped, "_hash", BITS))
    own = docs.withColumn("_own", F.xxhash64("text"))
    gone = (F.col("doc_id") == F.col("_id")) & (F.col("_own") == F.col("_hash"))
    left = maybe_in(own, "_own", hashes, BITS).join(dropped, gone, "left_anti")
    return left.select(docs.columns).unionByName(maybe_in(own, "_own", hashes, BITS, negate=True).select(docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix takes it.

    Null, empty and blank texts are never taken. Null ids and sources are rows
    like others, a null source a source of its own. Rows that repeat an id,
    source and text share what the mix takes of them: each as often as any
    other, or once more. An empty table stays empty; other columns come
    through unchanged. A very long text is counted in segments.
    """
    short_batches(spark)
    key = F.xxhash64("doc_id", "source", "_own", F.col("doc_id").isNull(), F.col("source").isNull()).alias("_key")
    taken = mix_sources(docs).withColumn("_own", F.col("text_hash")).select(key, "copies")
    taken = save(taken.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows"), F.sum("copies").alias("_copies")))
    # Rows that are taken once as they are, and those that are not taken, are told by filters; what is left is joined.
    other, some = (save(bit_filter(taken.where(rows), "_key", BITS)) for rows in ("_rows > 1 or _copies <> 1", "_copies > 0"))
    texts = docs.withColumn("_own", F.xxhash64("text")).select(*docs.columns, key)
    plain = maybe_in(texts, "_key", other, BITS, negate=True).select(docs.columns)
    texts = maybe_in(maybe_in(texts, "_key", other, BITS), "_key", some, BITS)
    taken = taken.where("_copies > 0")
    once = texts.join(taken.where("_rows = 1"), "_key").select(*docs.columns, "_copies")
    repeated = taken.where("_rows > 1")
    if repeated.isEmpty():
        return once.withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)"))).select(docs.columns).unionByName(plain)
    # Rows of one key are numbered within tasks, behind those of the tasks before.
    rows = save(join_dealt(texts, repeated, "_key").withColumn("_id", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_id", 33)))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    tasks = rows.groupBy("_key", "_task").agg(F.count(F.lit(1)).alias("_n")).select("_key", "_task", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_key", "_task").orderBy("_id")) + F.col("_before")
    own = F.expr("_copies div _rows") + (F.col("_place") <= F.col("_copies") % F.col("_rows")).cast("int")
    again = rows.join(tasks, ["_key", "_task"]).withColumn("_place", place).select(*docs.columns, own.alias("_copies"))
    rows = once.unionByName(again).where("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)"))).select(docs.columns).unionByName(plain)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the decoded text's digest.

    Returns doc_id, n_tokens, ids, decoded_sha256, one row per row. A null text
    counts as empty and has no ids; null and repeated ids come back as they
    are; an empty table gives an empty result; other columns are ignored. A
    text is held whole by one task.
    """
    short_batches(spark)
    coded = encode_documents(docs)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixing),
    ("byte_bpe", encoding),
]
#: The stages learn, hash and draw; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
