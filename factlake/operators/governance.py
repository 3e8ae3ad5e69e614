"""Retention, spend, work queues and audit reports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.operators.common import first_rows

#: Documents of a purge batch; traces that are looked at for reuse.
PURGE_BATCH, TRACES = 500, 5
#: Ids whose requests are admitted at once while they all fit.
RANGE = 10_000


def held_docs(docs: DataFrame, holds: DataFrame, participants: DataFrame) -> DataFrame:
    """Documents under an active hold by id, source system or a person who takes part."""
    live = holds.where("active")
    by_doc = docs.select("doc_id").join(live.where("scope = 'doc'").select(F.col("value").alias("doc_id")), "doc_id", "left_semi")
    by_source = docs.join(live.where("scope = 'source'").select(F.col("value").alias("source_system")), "source_system", "left_semi").select("doc_id")
    by_person = participants.join(live.where("scope = 'person'").select(F.col("value").alias("person_id")), "person_id", "left_semi").select("doc_id")
    return by_doc.unionByName(by_source).unionByName(by_person).distinct()


def retention_plan(docs: DataFrame, holds: DataFrame, participants: DataFrame, days: int, now: Column, batch: int | None = PURGE_BATCH) -> DataFrame:
    """Documents with text older than ``days``: held or purge; 0 days is off; ``batch`` limits the purge, oldest first."""
    old = docs.where((F.coalesce("rendered_text", F.lit("")) != "") & (F.col("event_time") < now - F.make_dt_interval(F.lit(days))))
    if days <= 0:
        old = old.where("false")
    held = held_docs(docs, holds, participants).withColumn("held", F.lit(True))
    rows = old.join(held, "doc_id", "left").select("doc_id", "event_time", F.when(F.col("held"), "held").otherwise("purge").alias("action"))
    if batch is None:
        return rows
    return rows.where("action = 'held'").unionByName(rows.where("action = 'purge'").orderBy("event_time", "doc_id").limit(batch))


def apply_purge(purge: DataFrame, docs: DataFrame, chunks: DataFrame, participants: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, chunks, participants): purged documents are blank tombstones, their passages and people are gone."""
    ids = purge.select("doc_id").distinct()
    mark = docs.join(ids.withColumn("_gone", F.lit(True)), "doc_id", "left")
    blank = [F.when(F.col("_gone"), F.lit("")).otherwise(F.col(c)).alias(c) if c in ("title", "rendered_text") else F.coalesce("_gone", c).alias(c) if c == "deleted" else F.col(c) for c in docs.columns]
    return mark.select(*blank), chunks.join(ids, "doc_id", "left_anti"), participants.join(ids, "doc_id", "left_anti")


def purge_blob_keys(purged: DataFrame, versions: DataFrame) -> DataFrame:
    """Blob keys of purged documents, of their versions too; no empty ones."""
    old = versions.join(purged.select("doc_id"), "doc_id", "left_semi").select("blob_key")
    return purged.select(F.col("raw_blob_key").alias("blob_key")).unionByName(old).where("blob_key is not null and blob_key <> ''").distinct()


def spend_by_class(ledger: DataFrame, now: Column, alert: int, limit: int) -> DataFrame:
    """This month's tokens by class, with the total over all classes and its flags."""
    rows = ledger.where((F.col("created_at") >= F.date_trunc("month", now).cast("timestamp_ntz")) & (F.col("created_at") <= now))
    per = rows.groupBy("job_class").agg(F.sum("tokens").alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy())
    return per.withColumn("total", total).withColumns({"alert": F.col("total") >= alert, "over_limit": F.col("total") >= limit})


def spend_admission(requests: DataFrame, limit: int) -> DataFrame:
    """In order of entry_id a request is admitted while used + tokens stays within ``limit``; refused ones use nothing.

    A workspace's month is one sequence by nature, but most of it needs no
    sequence: as long as the running total of whole ranges of RANGE ids stays
    within the limit all of them are admitted, and what is larger than the
    room left after those is refused. Only the rest is folded in order, row by
    row as it streams by, so nothing but the amount used is held.
    """
    keys = ["workspace_id", "month"]
    rows = requests.select("workspace_id", F.date_format("created_at", "yyyy-MM").alias("month"), "entry_id", "tokens", F.floor(F.col("entry_id") / RANGE).alias("range"))
    ranges = rows.groupBy(*keys, "range").agg(F.sum("tokens").alias("used"), F.min("tokens").alias("least"))
    # A range with a negative amount (a refund) and all after it are folded.
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("total", F.sum("used").over(before)).withColumn("fits", F.max((F.col("total") > limit) | (F.col("least") < 0)).over(before) == F.lit(False))
    room = ranges.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("fits"), F.col("total"))), F.lit(0)).cast("long").alias("start"), F.min("least").alias("lowest"))
    rows = rows.join(ranges.select(*keys, "range", "fits"), [*keys, "range"]).join(room, keys)
    refused = (F.col("tokens") > limit - F.col("start")) & (F.col("lowest") >= 0)
    plain = rows.where("fits").withColumn("admitted", F.lit(True)).unionByName(rows.where(~F.col("fits") & refused).withColumn("admitted", F.lit(False)))
    rest = rows.where(~F.col("fits") & ~refused).select(*keys, "entry_id", "tokens", "start").repartition(*keys).sortWithinPartitions(*keys, "entry_id")

    def fold(batches):
        held, used = None, 0
        for batch in batches:
            out = []
            for workspace, month, tokens, start in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if (workspace, month) != held:
                    held, used = (workspace, month), start
                fits = used + tokens <= limit
                used += tokens if fits else 0
                out.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.bool_())], [*keys, "entry_id", "admitted"])

    folded = rest.mapInArrow(fold, "workspace_id string, month string, entry_id long, admitted boolean")
    return plain.select(*keys, "entry_id", "admitted").unionByName(folded)


def reconcile_reservations(ledger: DataFrame, actuals: DataFrame, limit: int) -> DataFrame:
    """Estimates replaced by ``actuals(entry_id, actual)``; rows at which the month's running total passes the limit are marked.

    The total runs per workspace (if the ledger names it) and month: over the
    sums of its hours, and from there within each hour.
    """
    keys = [c for c in ("workspace_id",) if c in ledger.columns] + ["month"]
    rows = ledger.join(actuals, "entry_id", "left").withColumn("tokens", F.coalesce("actual", "tokens")).withColumns({"month": F.date_format("created_at", "yyyy-MM"), "hour": F.date_format("created_at", "yyyy-MM-dd HH")})
    hours = rows.groupBy(*keys, "hour").agg(F.sum("tokens").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy(*keys).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))
    hours = hours.select(*keys, "hour", F.coalesce(before, F.lit(0)).alias("before"))
    run = F.sum("tokens").over(Window.partitionBy(*keys, "hour").orderBy("created_at", "entry_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(hours, [*keys, "hour"]).withColumn("running", F.col("before") + run)
    return rows.withColumn("over_limit", F.col("running") > limit).drop("actual", "before", "hour")


def work_counts(jobs: DataFrame) -> DataFrame:
    """Items by status, and by status and type (type null: all)."""
    return jobs.rollup("status", "job_type").agg(F.count(F.lit(1)).alias("n")).where("status is not null")


def work_lag(jobs: DataFrame) -> DataFrame:
    """One row: pending, running and dead items, the oldest pending one and the last activity."""
    return jobs.agg(
        F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "dead").alias("dead"),
        F.min(F.when(F.col("status") == "pending", F.col("created_at"))).alias("oldest_pending"), F.max("updated_at").alias("last_activity"),
    )


#: The payload fields that name what a job of each type works on. A job type without an entry, or a job
#: without one of its fields, is no duplicate of another; one of no fields is open once; a pair is the same both ways.
WORK_KEYS = {
    "extract_graph": ("doc_id",), "embed_chunks": ("doc_id",), "adjudicate_persons": ("person_a", "person_b"),
    "resolve_claim_conflict": ("subject_type", "subject_id", "predicate"), "resolve_relationship_conflict": ("from_type", "from_id", "relationship_type"),
    "generate_taxonomy_proposals": (), "aggregate_collaboration_edges": (), "push_taxonomy_proposal_webhook": (), "refresh_identity_embedding": ("person_id",),
}
UNORDERED = frozenset({"adjudicate_persons"})


def logical_key(rules: dict[str, tuple[str, ...]] = WORK_KEYS, unordered: frozenset[str] = UNORDERED) -> Column:
    """The JSON list of what a job works on, from its ``payload`` (JSON); null where it has no key."""
    out = F.lit(None).cast("string")
    for job_type, fields in rules.items():
        found = [F.nullif(F.get_json_object("payload", f"$.{f}"), F.lit("")) for f in fields]
        missing = F.lit(False)
        for f in found:
            missing = missing | f.isNull()
        values = F.array(*found) if found else F.array().cast("array<string>")
        key = F.to_json(F.array_sort(values) if job_type in unordered else values)
        out = F.when((F.col("job_type") == job_type) & ~missing, key).otherwise(out)
    return out


def open_work(jobs: DataFrame, rules: dict[str, tuple[str, ...]] = WORK_KEYS, unordered: frozenset[str] = UNORDERED) -> DataFrame:
    """Open items of ``jobs(workspace_id, job_id, job_type, status, payload, created_at)``: the newest of each logical key, and all without one."""
    rows = jobs.where(F.col("status").isin("pending", "running")).withColumn("logical_key", logical_key(rules, unordered))
    keyed = first_rows(rows.where("logical_key is not null"), ["workspace_id", "job_type", "logical_key"], [F.desc("created_at"), F.desc("job_id")])
    return keyed.unionByName(rows.where("logical_key is null"))


def embed_backlog(chunks: DataFrame) -> DataFrame:
    return chunks.where("chunk_role = 'child' and embedding is null").groupBy("embedding_model").agg(F.count(F.lit(1)).alias("waiting"))


def recent_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def version_history(versions: DataFrame, ids: DataFrame) -> DataFrame:
    rows = versions.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows.withColumn("version", F.row_number().over(Window.partitionBy("doc_id").orderBy("event_time", "seq")).cast("long"))


def problem_work(jobs: DataFrame, n: int) -> DataFrame:
    return jobs.where("status = 'dead' or (status = 'pending' and last_error is not null)").orderBy(F.desc("updated_at"), F.desc("job_id")).limit(n)


def reusable_traces(traces: DataFrame, wanted: DataFrame, ttl_days: int, now: Column) -> DataFrame:
    """Per ``wanted(subject_id, evidence)`` the newest of the last few traces with the same evidence set that is young enough."""
    last = first_rows(traces, ["subject_id"], [F.desc("created_at"), F.desc("trace_id")], TRACES)
    same = F.array_sort(F.array_distinct("evidence_doc_ids")) == F.array_sort(F.array_distinct("evidence"))
    hits = last.join(wanted, "subject_id").where(same & (F.col("created_at") >= now - F.make_dt_interval(F.lit(ttl_days))))
    return first_rows(hits, ["subject_id"], [F.desc("created_at"), F.desc("trace_id")])


def legal_holds(events: DataFrame) -> DataFrame:
    """Holds in force after place and release events."""
    last = events.groupBy("hold_id").agg(F.max_by(F.struct("action", "scope", "value"), F.struct("at", "seq")).alias("e"))
    return last.select("hold_id", "e.scope", "e.value", (F.col("e.action") == "place").alias("active"))


def retrieval_audit_rows(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row a query: who asked, and what was returned, by kind, in rank order."""
    listed = hits.groupBy("query_id", "kind").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("l"))
    wide = listed.groupBy("query_id").agg(*[F.first(F.when(F.col("kind") == k, F.col("l.item_id")), ignorenulls=True).alias(f"{k}_ids") for k in ("chunk", "fact")])
    none = F.array().cast("array<string>")
    return queries.join(wide, "query_id", "left").select(*queries.columns, *[F.coalesce(f"{k}_ids", none).alias(f"{k}_ids") for k in ("chunk", "fact")])


def proposal_export(proposals: DataFrame, limit: int) -> DataFrame:
    """Pending proposals as JSON, oldest first."""
    return proposals.where("status = 'pending'").orderBy("created_at", "proposal_id").limit(limit).select("proposal_id", F.to_json(F.struct("proposal_id", "subject_id", "field_key", "value_text")).alias("payload"))
