"""The change feed as Structured Streaming: keyed state, replays, sessions, late events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from factlake.operators import ledger

DOC_STATE = "t timestamp, acl_t timestamp, visible boolean, principals string, version long, text_hash string, deleted boolean"
DOC_OUTPUT = "doc_id string, seq long, outcome string, event_time timestamp, text_hash string, deleted boolean, org_visible boolean, allowed_principals string, acl_version long"


class DocumentState(StatefulProcessor):
    """One document's state: content by event time, the access list by its own clock.

    The rules are those of the batch operators: content older than the state is
    stale; an access list moves its clock and version only if it differs;
    deletes always apply; events on unknown documents are errors.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("document", DOC_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values("seq")
        held = self.state.get() if self.state.exists() else None
        s = dict(zip(("t", "acl_t", "visible", "principals", "version", "text_hash", "deleted"), held, strict=True)) if held else None
        out = []
        for e in events.itertuples():
            principals, at = e.principals, e.event_time
            if e.change_kind in ("create", "update"):
                if s is None:
                    s = {"t": at, "acl_t": at, "visible": e.org_visible, "principals": principals, "version": 1, "text_hash": e.text_hash, "deleted": False}
                    outcome = "created"
                elif at < s["t"]:
                    outcome = "skipped_stale"
                else:
                    outcome = "updated"
                    if at >= s["acl_t"] and (e.org_visible, principals) != (s["visible"], s["principals"]):
                        s |= {"acl_t": at, "visible": e.org_visible, "principals": principals, "version": s["version"] + 1}
                    s |= {"t": at, "text_hash": e.text_hash, "deleted": False}
            elif s is None:
                outcome = "unknown_document"
            elif e.change_kind == "delete":
                s["deleted"], outcome = True, "deleted"
            elif at < s["acl_t"]:
                outcome = "skipped_stale"
            else:
                s |= {"acl_t": at, "visible": e.org_visible, "principals": principals, "version": s["version"] + 1}
                outcome = "permissions"
            now = s or {"t": None, "text_hash": None, "deleted": None, "visible": None, "principals": None, "version": None}
            out.append((key[0], e.seq, outcome, now["t"], now["text_hash"], now["deleted"], now["visible"], now["principals"], now["version"]))
        if s is not None:
            self.state.update((s["t"], s["acl_t"], s["visible"], s["principals"], s["version"], s["text_hash"], s["deleted"]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DOC_OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def stream_documents(env: DataFrame) -> DataFrame:
    """One row per event of ``env(doc_id, seq, change_kind, event_time, text_hash, org_visible, allowed_principals)``: its outcome and the state after it."""
    rows = env.select("doc_id", "seq", "change_kind", F.col("event_time").cast("timestamp").alias("event_time"), "text_hash", "org_visible", F.array_join(F.array_sort(F.array_distinct("allowed_principals")), ",").alias("principals"))
    return rows.groupBy("doc_id").transformWithStateInPandas(DocumentState(), DOC_OUTPUT, "Update", "None")


def stream_versions(env: DataFrame, delay: str = "1 day") -> DataFrame:
    """Content events without replays of the same document and text within the watermark."""
    rows = env.where(F.col("change_kind").isin("create", "update")).withColumn("at", F.col("event_time").cast("timestamp"))
    return rows.withWatermark("at", delay).dropDuplicatesWithinWatermark(["doc_id", "text_hash"])


def stream_debounce(work: DataFrame, gap: str = "60 seconds", delay: str = "1 minute") -> DataFrame:
    """One row per key and burst of ``work(key, at)``; each event puts the end of the burst off by ``gap``."""
    session = work.withWatermark("at", delay).groupBy("key", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return session.select("key", F.col("w.start").alias("first_at"), F.col("w.end").alias("due_at"), "n")


def stream_source_freshness(accepted: DataFrame) -> DataFrame:
    return accepted.groupBy("source_system").agg(F.max("arrived_at").alias("last_arrival"), F.max("event_time").alias("last_event"), F.count(F.lit(1)).alias("accepted"))


def late_event_report(rejects: DataFrame, width: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Rejected events per source, reason and window of arrival; with ``delay`` for streams."""
    rows = rejects.withColumn("at", F.col("arrived_at").cast("timestamp"))
    if delay:
        rows = rows.withWatermark("at", delay)
    out = rows.groupBy("source_system", "reason", F.window("at", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("source_system", "reason", F.col("w.start").alias("window_start"), "n")


#: Buckets of a ledger table; a batch writes those that it touches anew.
BUCKETS = 64
_FACT = (
    "confidence double, status string, evidence_doc_ids array<string>, evidence_quotes array<struct<doc_id:string,quote:string>>, valid_from timestamp_ntz, valid_to timestamp_ntz, time_grain string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, invalidated_at timestamp_ntz, superseded_by string, created_by string, bucket int, version long"
)
#: The ledger's tables and what a row's bucket goes by.
LEDGER = {
    "claims": ("claim_id string, subject_type string, subject_id string, predicate string, object_text string, " + _FACT, "subject_id"),
    "relationships": ("relationship_id string, from_type string, from_id string, relationship_type string, to_type string, to_id string, " + _FACT, "from_id"),
    "entities": ("entity_id string, entity_type string, name string, description string, evidence_doc_ids array<string>, bucket int, version long", None),
}


def read_ledger(spark: SparkSession, path: str, name: str, before: int | None = None) -> DataFrame:
    """The rows of a ledger table: of each bucket its newest version, or the newest that batches before ``before`` wrote."""
    empty = spark.createDataFrame([], LEDGER[name][0])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return empty.drop("version")
    rows = spark.read.schema(empty.schema).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    if before is not None:
        rows = rows.where(F.col("version") < before)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))  # BUCKETS rows
    return rows.join(F.broadcast(newest), ["bucket", "version"], "left_semi").drop("version")


def _write_ledger(rows: DataFrame, path: str, name: str, version: int) -> None:
    rows.withColumn("version", F.lit(version)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{path}/{name}")


def stream_ledger(
    parsed: DataFrame, path: str, docs: DataFrame, predicates: DataFrame, edge_types: DataFrame, entity_types: DataFrame, persons: DataFrame, exclusive: DataFrame, now: Column,
    checkpoint: str, threshold: float = 0.8, available_now: bool = False,
):
    """Apply each micro-batch of parsed windows to the ledger tables below ``path`` with the batch operators.

    A batch extracts, merges into the live rows of the buckets that it touches
    and closes their exclusive slots, then writes these buckets as a version of
    its own number. It reads versions of earlier batches only, so a batch that
    is run again writes the same once more.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        entities = read_ledger(spark, path, "entities", number)

        def store(df: DataFrame, name: str) -> DataFrame:
            at = f"{path}/_batches/{number}/{name}"
            df.write.mode("overwrite").parquet(at)
            return spark.read.schema(df.schema).parquet(at)

        found = ledger.apply_extractions(batch, docs, predicates, edge_types, entity_types, persons, entities.drop("bucket"), threshold, store)
        bucket = F.pmod(F.xxhash64("normalized_name"), F.lit(BUCKETS)).cast("int")
        merged = found["entities"].withColumn("bucket", bucket).drop("normalized_name").select([c for c in entities.columns])
        _write_ledger(merged, path, "entities", number)
        for name, (schema, by) in LEDGER.items():
            if by is None:
                continue
            key = schema.split()[0]
            fresh = store(found[name].withColumns({"bucket": F.pmod(F.xxhash64(by), F.lit(BUCKETS)).cast("int"), "updated_at": F.col("created_at")}), name)
            own = read_ledger(spark, path, name, number)
            own = own.join(F.broadcast(fresh.select("bucket").distinct()), "bucket", "left_semi").select(own.columns)
            merge = ledger.merge_claims if name == "claims" else ledger.merge_relationships
            rows = store(merge(own, fresh), f"{name}_merged")
            if name == "claims":
                rows = ledger.close_claim_slots(rows.drop("superseded_by").join(own.select(key, "superseded_by"), key, "left").withColumnRenamed("superseded_by", "was"), docs, exclusive, now)
                rows = rows.withColumn("superseded_by", F.coalesce("superseded_by", "was")).drop("was")
            _write_ledger(rows.select(own.columns), path, name, number)

    writer = parsed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_stream(spark, path: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)
