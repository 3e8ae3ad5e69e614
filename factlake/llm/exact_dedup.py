"""Exact duplicates by a log-structured merge index of text digests.

Everything here is DataFrame code that runs inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.storage import bit_filter, delete, join_dealt, maybe_in, read_table, save, scratch_folder, text_or_empty

#: Fixed by the contract: the characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
#: Entries that a task sorts and flushes as one run at most; runs of a level that are merged into one of the next.
MEMTABLE, FANOUT = 1_000_000, 4
#: Of equal texts the one with the most code points stays, then the smallest doc_id; null ids come last.
ORDER = "struct(-n_points as less, doc_id is null as nameless, doc_id)"


def normalised(column: str = "text") -> Column:
    """The text without blanks; null counts as empty."""
    out = text_or_empty(column)
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank))
    return out


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def with_digest(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, norm, digest, n_points) of each row."""
    points = F.length(text_or_empty()).cast("long").alias("n_points")
    return docs.select("doc_id", normalised().alias("norm"), points).withColumn("digest", digest(F.col("norm")))


def compact(entries: DataFrame, *by: str) -> DataFrame:
    """Merge entries ``(digest, best, group_size)``: the best identifier of each digest and its number of rows.

    Partial aggregation inside every run leaves one row a digest and task to
    shuffle, so a digest that holds a third of all rows costs no more than another.
    """
    return entries.groupBy("digest", *by).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))


@dataclass
class Run:
    """One sorted run of the index: its level, its entries, and the filter of their digests."""

    level: int
    path: str
    entries: DataFrame
    filter: DataFrame


class DigestIndex:
    """Runs of (digest, best, group_size). A level of FANOUT runs is merged into one run of the next level.

    The index outlives a batch: rows added later meet those added before.
    """

    def __init__(self, spark: SparkSession, digest: Callable[[Column], Column] = sha256, bits: int = 1 << 24):
        self.spark, self.digest, self.bits = spark, digest, bits
        self.runs: list[Run] = []
        self.batches: list[DataFrame] = []

    def _write(self, entries: DataFrame, level: int) -> Run:
        path = scratch_folder(self.spark)
        entries.sortWithinPartitions("digest").write.parquet(path)
        stored = self.spark.read.schema(entries.schema).parquet(path)
        return Run(level, path, stored, save(bit_filter(stored, "digest", self.bits)))

    def flush(self, docs: DataFrame) -> DataFrame:
        """Write a batch as runs: each task is a memtable, and each MEMTABLE entries of it a file sorted by digest."""
        entries = with_digest(docs, self.digest).drop("norm").sortWithinPartitions("digest")
        return save(entries, {"maxRecordsPerFile": str(MEMTABLE)})

    def lookup(self, entries: DataFrame) -> list[DataFrame]:
        """What each run holds of the digests of ``entries``; only digests that pass a run's filter are joined."""
        return [maybe_in(entries.select("digest"), "digest", run.filter, self.bits).join(run.entries, "digest") for run in self.runs]

    def insert(self, run: Run) -> None:
        """Add a run, and merge levels that are full."""
        self.runs.append(run)
        while len(full := [r for r in self.runs if r.level == self.runs[-1].level]) >= FANOUT:
            merged = self._write(compact(reduce(DataFrame.unionByName, [r.entries for r in full])), full[0].level + 1)
            self.runs = [r for r in self.runs if r not in full] + [merged]
            for old in full:
                delete(self.spark, old.path)

    def collided(self, level: DataFrame) -> DataFrame:
        """Digests of ``level`` whose rows don't all have the same bytes, from the texts of all hits.

        Only rows that pass the filter of repeated digests send their text, and
        equal texts meet before the shuffle.
        """
        hits = bit_filter(level.where("group_size > 1"), "digest", self.bits)
        texts = reduce(DataFrame.unionByName, [with_digest(d, self.digest).select("norm", "digest") for d in self.batches])
        texts = maybe_in(texts, "digest", hits, self.bits).groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
        return texts.groupBy("digest").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1").select("digest")

    def add(self, docs: DataFrame) -> DataFrame:
        """Add a batch; returns its rows as ``exact_dedup`` does, grouped with all rows added before too."""
        docs = docs.select("doc_id", "text")
        self.batches.append(docs)
        rows = self.flush(docs)
        own = self._write(compact(rows.select("digest", F.expr(ORDER).alias("best"), F.lit(1).cast("long").alias("group_size"))), 0)
        level = own.entries
        if self.runs:
            level = save(compact(reduce(DataFrame.unionByName, self.lookup(level), level)))
        collided = save(self.collided(level))
        out = join_dealt(rows, level, "digest").select("digest", "doc_id", "best", "group_size", F.lower(F.hex("digest")).alias("text_sha256"))
        if not collided.isEmpty():
            every = reduce(DataFrame.unionByName, [with_digest(d, self.digest) for d in self.batches]).join(collided, "digest", "left_semi")
            groups = compact(every.select("digest", "norm", F.expr(ORDER).alias("best"), F.lit(1).cast("long").alias("group_size")), "norm")
            apart = with_digest(docs, self.digest).join(groups, ["digest", "norm"]).select("digest", "doc_id", "best", "group_size", F.sha2("norm", 256).alias("text_sha256"))
            out = out.join(collided, "digest", "left_anti").unionByName(apart)
        out = save(out)  # runs that are merged later are deleted
        self.insert(own)
        keep = F.col("best.doc_id")
        return out.select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, bits: int = 1 << 24) -> DataFrame:
    """Group documents whose texts are equal after all blanks are deleted.

    Returns one row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256. A null text counts as empty, so all empty, blank and null
    texts are one group. Rows that repeat a doc_id are counted and returned
    each; they are kept if they carry the id that stays. A null doc_id loses
    to any other; a group of nothing but null ids keeps them (keep_id null).
    An empty table gives an empty result; other columns are ignored. A very
    long text is normalised and hashed whole within the JVM; it is shuffled
    only if another text has its digest.
    """
    return DigestIndex(docs.sparkSession, digest, bits).add(docs)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents),
g as (
  select norm, arg_max(doc_id, (length(text), -doc_id)) as keep_id, count(*) as group_size from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
from t join g on t.norm = g.norm
"""
