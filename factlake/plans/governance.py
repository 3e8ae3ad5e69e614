"""Queries on governance, spend and work, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.operators import feed, governance
from factlake.plans.facts import stamp
from factlake.plans.feed import ENV, clock, env
from factlake.plans.registry import query
from factlake.streaming import feed_streams

HOLDS = "holds as (select * from (values ('doc', 'src3:3'), ('source', 'src5'), ('person', 'p7')) t(scope, value))"
HELD = "hd as (select doc_id from v_documents where doc_id = 'src3:3' or source_system = 'src5' union select doc_id from v_participants where person_id = 'p7')"


def holds(t):
    rows = [("doc", "src3:3", True), ("source", "src5", True), ("person", "p7", True), ("source", "src6", False)]
    return t.spark.createDataFrame(rows, "scope string, value string, active boolean")


@query("k2_held_docs", f"with {HELD} select doc_id from hd where doc_id in (select doc_id from v_documents) or doc_id in (select doc_id from v_participants)")
def k2(t):
    return governance.held_docs(t.v_documents, holds(t), t.v_participants)


@query("k1_retention_plan", f"with {HELD} select d.doc_id, case when hd.doc_id is not null then 'held' else 'purge' end as action from v_documents d left join hd using (doc_id) where coalesce(rendered_text, '') <> '' and event_time < timestamp '2024-02-01' - interval 20 day")
def k1(t):
    return governance.retention_plan(t.v_documents, holds(t), t.v_participants, 20, clock(), None).select("doc_id", "action")


@query("k3_apply_purge", "with p as (select doc_id from v_documents where n % 4 = 0) select 'docs' as part, count(*) as n, count_if(deleted or n % 4 = 0) as gone from v_documents union all select 'chunks', count(*), 0 from v_chunks where doc_id not in (select doc_id from p) union all select 'people', count(*), 0 from v_participants where doc_id not in (select doc_id from p)")
def k3(t):
    docs, chunks, people = governance.apply_purge(t.v_documents.where("n % 4 = 0"), t.v_documents, t.v_chunks, t.v_participants)
    out = docs.agg(F.lit("docs").alias("part"), F.count(F.lit(1)).alias("n"), F.count_if("deleted").alias("gone"))
    for name, df in (("chunks", chunks), ("people", people)):
        out = out.unionByName(df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("gone")))
    return out


@query("k4_spend_by_class", "with s as (select job_class, sum(tokens)::bigint as tokens from v_spend where created_at >= timestamp '2024-01-01' and created_at <= timestamp '2024-01-20' group by 1) select *, (sum(tokens) over ())::bigint as total, sum(tokens) over () >= 1000 as alert, sum(tokens) over () >= 1000000000 as over_limit from s")
def k4(t):
    return governance.spend_by_class(t.v_spend, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 1000, 1_000_000_000)


@query("k5_spend_admission", """with recursive e as (select entry_id, concat('w', entry_id % 7) as workspace_id, strftime(created_at, '%Y-%m') as month, tokens, row_number() over (partition by entry_id % 7, strftime(created_at, '%Y-%m') order by entry_id) as n from v_spend),
f as (select entry_id, workspace_id, month, n, tokens <= 400000 as admitted, case when tokens <= 400000 then tokens else 0 end as used from e where n = 1
 union all select e.entry_id, e.workspace_id, e.month, e.n, f.used + e.tokens <= 400000, f.used + case when f.used + e.tokens <= 400000 then e.tokens else 0 end from f join e on e.workspace_id = f.workspace_id and e.month = f.month and e.n = f.n + 1)
select workspace_id, month, entry_id, admitted from f""")
def k5(t):
    rows = t.v_spend.select("entry_id", F.concat(F.lit("w"), F.col("entry_id") % 7).alias("workspace_id"), "created_at", "tokens")
    return governance.spend_admission(rows, 400_000)


@query("k6_reconcile", "with r as (select entry_id, created_at, case when entry_id % 3 = 0 then entry_id % 100 else tokens end as tokens from v_spend) select entry_id, tokens, (sum(tokens) over (partition by strftime(created_at, '%Y-%m') order by created_at, entry_id rows unbounded preceding))::bigint as running, sum(tokens) over (partition by strftime(created_at, '%Y-%m') order by created_at, entry_id rows unbounded preceding) > 1000000 as over_limit from r")
def k6(t):
    actuals = t.v_spend.where("entry_id % 3 = 0").select("entry_id", (F.col("entry_id") % 100).alias("actual"))
    return governance.reconcile_reservations(t.v_spend, actuals, 1_000_000).select("entry_id", "tokens", "running", "over_limit")


@query("k7_work_counts", "select status, job_type, count(*) as n from v_jobs group by 1, 2 union all select status, null, count(*) from v_jobs group by 1")
def k7(t):
    return governance.work_counts(t.v_jobs)


@query("k8_work_lag", "select count_if(status = 'pending') as pending, count_if(status = 'running') as running, count_if(status = 'dead') as dead, strftime(min(case when status = 'pending' then created_at end), '%Y-%m-%d %H:%M:%S') as oldest_pending, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') as last_activity from v_jobs")
def k8(t):
    out = governance.work_lag(t.v_jobs)
    return out.withColumns({c: stamp(c) for c in ("oldest_pending", "last_activity")})


@query("k9_open_work", """with j as (select *, json_extract_string(payload, '$.doc_id') as d, json_extract_string(payload, '$.person_a') as a, json_extract_string(payload, '$.person_b') as b, json_extract_string(payload, '$.subject_type') as st, json_extract_string(payload, '$.subject_id') as si, json_extract_string(payload, '$.predicate') as pr,
 json_extract_string(payload, '$.from_type') as ft, json_extract_string(payload, '$.from_id') as fi, json_extract_string(payload, '$.relationship_type') as rt, json_extract_string(payload, '$.person_id') as pe from v_work where status in ('pending', 'running')),
k as (select *, case when job_type in ('extract_graph', 'embed_chunks') then concat('["', d, '"]') when job_type = 'adjudicate_persons' then concat('["', least(a, b), '","', greatest(a, b), '"]')
 when job_type = 'resolve_claim_conflict' and st is not null then concat('["', st, '","', si, '","', pr, '"]') when job_type = 'resolve_relationship_conflict' then concat('["', ft, '","', fi, '","', rt, '"]')
 when job_type in ('generate_taxonomy_proposals', 'aggregate_collaboration_edges', 'push_taxonomy_proposal_webhook') then '[]' when job_type = 'refresh_identity_embedding' and pe is not null then concat('["', pe, '"]') end as logical_key from j)
select job_id, job_type, logical_key from k qualify logical_key is null or row_number() over (partition by workspace_id, job_type, logical_key order by created_at desc, job_id desc) = 1""")
def k9(t):
    return governance.open_work(t.v_work).select("job_id", "job_type", "logical_key")


@query("k10_embed_backlog", "select embedding_model, count(*) as waiting from v_chunks where label % 3 = 0 group by 1")
def k10(t):
    return governance.embed_backlog(t.v_chunks.withColumn("embedding", F.when(F.col("label") % 3 != 0, F.col("embedding"))))


@query("k11_recent_rows", "select job_id from v_jobs order by updated_at desc, job_id desc limit 50")
def k11(t):
    return governance.recent_rows(t.v_jobs, [F.desc("updated_at"), F.desc("job_id")], 50).select("job_id")


@query("k12_version_history", f"with {ENV} select doc_id, seq, row_number() over (partition by doc_id order by event_time, seq) as version from ce where doc_id like 'src1:%' or doc_id like 'src2:%'")
def k12(t):
    rows = env(t).where("change_kind in ('create', 'update')")
    return governance.version_history(rows, rows.where("doc_id like 'src1:%' or doc_id like 'src2:%'")).select("doc_id", "seq", "version")


@query("k13_problem_work", "select job_id from v_jobs where status = 'dead' or (status = 'pending' and job_id % 50 = 0) order by updated_at desc, job_id desc limit 100")
def k13(t):
    return governance.problem_work(t.v_jobs.withColumn("last_error", F.when(F.col("job_id") % 50 == 0, "x")), 100).select("job_id")


@query("k14_reusable_traces", """with tr as (select *, row_number() over (partition by subject_id order by created_at desc, claim_id desc) as k from v_claims), w as (select subject_id, arg_max(evidence_doc_ids, claim_id) as ev from v_claims group by 1)
select tr.subject_id, tr.claim_id as trace_id from tr join w using (subject_id) where k <= 5 and list_sort(list_distinct(tr.evidence_doc_ids)) = list_sort(list_distinct(w.ev)) and created_at >= timestamp '1998-01-01' - interval 3000 day qualify row_number() over (partition by tr.subject_id order by created_at desc, claim_id desc) = 1""")
def k14(t):
    traces = t.v_claims.withColumnRenamed("claim_id", "trace_id")
    wanted = t.v_claims.groupBy("subject_id").agg(F.max_by("evidence_doc_ids", "claim_id").alias("evidence"))
    return governance.reusable_traces(traces, wanted, 3000, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).select("subject_id", "trace_id")


@query("k15_legal_holds", "select concat('h', doc_id) as hold_id, arg_max(person_a, (created_at, job_id)) as value, arg_max(job_id, (created_at, job_id)) % 2 = 0 as active from v_jobs group by 1")
def k15(t):
    events = t.v_jobs.select(F.concat(F.lit("h"), "doc_id").alias("hold_id"), F.when(F.col("job_id") % 2 == 0, "place").otherwise("release").alias("action"), F.lit("person").alias("scope"), F.col("person_a").alias("value"), F.col("created_at").alias("at"), F.col("job_id").alias("seq"))
    return governance.legal_holds(events).select("hold_id", "value", "active")


@query("a6_audit_rows", "with h as (select concat('q', label) as query_id, case when n % 3 = 0 then 'fact' else 'chunk' end as kind, chunk_id as item_id, n as rank from (select *, cast(split(chunk_id, '#')[2] as bigint) as n from v_chunks)) select query_id, coalesce(string_agg(case when kind = 'chunk' then item_id end, ',' order by rank), '') as chunk_ids, coalesce(string_agg(case when kind = 'fact' then item_id end, ',' order by rank), '') as fact_ids from h group by 1")
def a6(t):
    n = F.expr("cast(split(chunk_id, '#')[1] as bigint)")
    hits = t.v_chunks.select(F.concat(F.lit("q"), "label").alias("query_id"), F.when(n % 3 == 0, "fact").otherwise("chunk").alias("kind"), F.col("chunk_id").alias("item_id"), n.alias("rank"))
    out = governance.retrieval_audit_rows(hits.select("query_id").distinct(), hits)
    return out.select("query_id", *[F.array_join(c, ",").alias(c) for c in ("chunk_ids", "fact_ids")])


@query("a7_proposal_export", """select claim_id as proposal_id, concat('{"proposal_id":"', claim_id, '","subject_id":"', subject_id, '","field_key":"', predicate, '","value_text":"', object_text, '"}') as payload from v_claims where status = 'proposed' order by created_at, claim_id limit 100""")
def a7(t):
    rows = t.v_claims.select(F.col("claim_id").alias("proposal_id"), "subject_id", F.col("predicate").alias("field_key"), F.col("object_text").alias("value_text"), F.when(F.col("status") == "proposed", "pending").otherwise("applied").alias("status"), "created_at")
    return governance.proposal_export(rows, 100)


@query("a8_purge_blob_keys", f"with {ENV}, p as (select distinct doc_id from ce where doc_id like 'src1%') select concat('raw/', doc_id) as blob_key from p union select concat('v/', ce.text_hash) from ce join p using (doc_id) where ce.seq % 2 = 0")
def a8(t):
    rows = env(t).where("change_kind in ('create', 'update')")
    purged = rows.where("doc_id like 'src1%'").select("doc_id").distinct().withColumn("raw_blob_key", F.concat(F.lit("raw/"), "doc_id"))
    return governance.purge_blob_keys(purged, rows.select("doc_id", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("v/"), "text_hash")).otherwise("").alias("blob_key")))


@query("s6_late_events", f"with {ENV} select source_system, 'stale' as reason, strftime(date_trunc('hour', arrived_at), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n from ce where not accepted group by 1, 2, 3")
def s6(t):
    bad = feed.content_events(env(t)).where("not accepted").withColumn("reason", F.lit("stale"))
    return feed_streams.late_event_report(bad).withColumn("window_start", stamp("window_start"))


@query("s3_debounced_work", """with e as (select concat(source_system, ':', external_id) as key, arrived_at as t, coalesce(arrived_at - lag(arrived_at) over w > interval 60 minute, true) as brk from v_envelopes window w as (partition by source_system, external_id order by arrived_at, seq)),
g as (select key, t, sum(brk::int) over (partition by key order by t rows unbounded preceding) as s from e) select key, strftime(min(t), '%Y-%m-%d %H:%M:%S') as first_at, count(*) as n from g group by key, s""")
def s3(t):
    work = t.v_envelopes.select(F.concat_ws(":", "source_system", "external_id").alias("key"), F.col("arrived_at").cast("timestamp").alias("at"))
    return feed_streams.stream_debounce(work, "60 minutes").select("key", stamp("first_at").alias("first_at"), "n")


@query("s4_source_freshness", "select source_system, strftime(max(arrived_at), '%Y-%m-%d %H:%M:%S') as last_arrival, strftime(max(event_time), '%Y-%m-%d %H:%M:%S') as last_event, count(*) as accepted from v_envelopes group by 1")
def s4(t):
    out = feed_streams.stream_source_freshness(t.v_envelopes)
    return out.withColumns({c: stamp(c) for c in ("last_arrival", "last_event")})
