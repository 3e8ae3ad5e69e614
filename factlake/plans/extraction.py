"""Queries on files, extractions, model replies and streams, with SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factlake.functions import ranking
from factlake.operators import feed, intent, ledger, profiles
from factlake.plans.facts import joined, stamp
from factlake.plans.registry import query
from factlake.sources import files
from factlake.streaming import feed_streams


def folder(t) -> str:
    """A new folder in the place that all executors share."""
    base = t.spark.conf.get("spark.checkpoint.dir", None) or f"{t.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/plan-{uuid.uuid4().hex}"


def envelopes(t):
    """The events with the columns of an envelope that they have."""
    return t.v_envelopes.select("seq", "source_system", "external_id", "change_kind", "text", "event_time", "arrived_at", "org_visible", "allowed_principals")


ENVELOPES = "select seq, source_system, external_id, change_kind, strftime(event_time, '%Y-%m-%d %H:%M:%S') as event_time, org_visible, array_to_string(allowed_principals, ',') as principals, text from v_envelopes"


@query("a1_read_envelopes", ENVELOPES)
def a1(t):
    path = folder(t)
    envelopes(t).write.json(path)
    rows = files.read_envelopes(t.spark, path)
    return rows.select("seq", "source_system", "external_id", "change_kind", stamp("event_time").alias("event_time"), "org_visible", joined("allowed_principals").alias("principals"), "text")


@query("a2_archive_envelopes", "select 'default' as workspace_id, concat(source_system, ':', external_id) as doc_id, strftime(event_time, '%Y%m%dT%H%M%S') as at, count(*) as n from v_envelopes group by all")
def a2(t):
    path = folder(t)
    files.archive_envelopes(envelopes(t), path)
    rows = t.spark.read.schema("doc_id string, event_key string, body string, workspace_id string").json(path)
    return rows.groupBy("workspace_id", "doc_id", F.substring_index("event_key", "-", 1).alias("at")).agg(F.count(F.lit(1)).alias("n"))


@query("a5_save_and_load_tables", "select status, predicate, count(*) as n, round(sum(confidence), 6) as confidence from v_claims where status <> 'retracted' or predicate = 'title' group by all")
def a5(t):
    """All claims are saved by status; one status is then written again with its titles only."""
    path = folder(t)
    files.save_tables({"claims": t.v_claims}, path, "status")
    files.save_tables({"claims": t.v_claims.where("status = 'retracted' and predicate = 'title'")}, path, "status")
    rows = files.load_tables(t.spark, path, ["claims"])["claims"]
    return rows.groupBy("status", "predicate").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


@query("b14_merge_metadata", "select doc_id, case when doc_id % 5 = 0 then 'given' else cast(doc_id % 2 = 0 as varchar) end as verified, coalesce(lang, '') as lang, coalesce(source, '') as team, case when doc_id % 5 = 0 then 4 else 3 end - (lang is null)::int + case when doc_id % 5 = 0 then -1 else 0 end + (lang is null)::int as n from documents")
def b14(t):
    given = F.when(F.col("doc_id") % 5 == 0, F.array(F.struct(F.lit("author_email_verified").alias("key"), F.lit("given").alias("value"))))
    own = F.array(F.struct(F.lit("team").alias("key"), F.coalesce("source", F.lit("")).alias("value")))
    fields = F.concat(own, F.coalesce(given, F.array().cast("array<struct<key:string,value:string>>")))
    connector = F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("")), F.lit("team"), F.lit("old"), F.lit("author_email_verified"), F.lit("old"))
    m = feed.merge_metadata(connector, F.col("doc_id") % 2 == 0, fields)
    rows = t.documents.select("doc_id", m.alias("m"))
    return rows.select("doc_id", F.col("m")["author_email_verified"].alias("verified"), F.col("m")["lang"].alias("lang"), F.col("m")["team"].alias("team"), F.size("m").cast("long").alias("n"))


PLANS = """pl as (select point_id, cast(substr(point_id, 2) as bigint) as k, case cast(substr(point_id, 2) as bigint) % 5 when 0 then 'current' when 1 then 'world' when 2 then 'belief' when 3 then 'never' end as axis, as_of as point, (cast(substr(point_id, 2) as bigint) % 13) / 8.0 - 0.25 as confidence from v_order_points)"""


@query("e19_validate_model_plan", f"""with {PLANS}, b as (select *, coalesce(axis not in ('current', 'world', 'belief'), true) or (axis <> 'current' and point is null) as bad, least(greatest(confidence, 0), 1) as sure from pl)
select point_id, case when axis in ('current', 'world', 'belief') then axis else 'current' end as axis, case when bad then 'ambiguous' else 'ok' end as status, round(case when bad then least(sure, 0.3) else sure end, 6)::double as confidence from b""")
def e19(t):
    k = F.expr("cast(substr(point_id, 2) as bigint)")
    axis = F.when(k % 5 == 0, "current").when(k % 5 == 1, "world").when(k % 5 == 2, "belief").when(k % 5 == 3, "never")
    plans = t.v_order_points.select("point_id", axis.alias("axis"), F.col("as_of").alias("point"), ((k % 13) / 8.0 - 0.25).alias("confidence"))
    return intent.validate_model_plan(plans).select("point_id", "axis", "status", F.round("confidence", 6).alias("confidence"))


@query("f16_f23_confidence_and_status", """with c as (select o_orderkey, case o_orderkey % 5 when 0 then ' 0.85 ' when 1 then '1.5' when 2 then 'high' when 3 then '0.' || (o_orderkey % 90 + 10) end as raw from orders),
p as (select o_orderkey, case when o_orderkey % 5 in (0, 3) then cast(trim(raw) as double) end as confidence from c) select o_orderkey, confidence, case when confidence >= 0.8 then 'active' else 'proposed' end as status from p""")
def f1623(t):
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, " 0.85 ").when(k % 5 == 1, "1.5").when(k % 5 == 2, "high").when(k % 5 == 3, F.concat(F.lit("0."), k % 90 + 10))
    rows = t.orders.select("o_orderkey", ranking.parse_confidence(raw).alias("confidence"))
    return rows.withColumn("status", ranking.status_for_confidence(F.col("confidence"), 0.8))


@query("l7_parse_profiles", "select c_custkey, case when c_custkey % 3 = 2 then 0 else 1 end as n_descriptions, case c_custkey % 3 when 0 then c_name when 1 then c_mktsegment else concat('plain ', c_name) end as prose, c_custkey % 3 <> 2 as parsed from customer")
def l7(t):
    k = F.col("c_custkey")
    body = F.to_json(F.struct(F.array("c_name").alias("descriptions"), F.when(k % 3 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment")).alias("prose")))
    reply = F.when(k % 3 == 0, body).when(k % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("plain "), "c_name"))
    out = profiles.parse_profiles(t.customer.select(k.alias("subject_id"), reply.alias("reply")))
    return out.select(F.col("subject_id").alias("c_custkey"), F.coalesce(F.when(F.col("parsed"), F.size("descriptions")), F.lit(0)).alias("n_descriptions"), "prose", "parsed")


def windows(t):
    """A window of parsed items a customer: an entity, an edge and a claim; names, quotes, types and numbers that are wrong in turn."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    times = [none.alias(c) for c in ("valid_from", "valid_to", "time_expression", "time_grain")]
    quote = F.concat("c_name", F.lit(" works for"))
    person, team = F.struct(F.lit("person").alias("type"), F.col("c_name").alias("name")), F.struct(F.lit("Team").alias("type"), F.col("c_mktsegment").alias("name"))
    entity = F.struct(F.when(k % 6 == 0, "planet").when(k % 6 == 1, "person").otherwise("team").alias("type"), F.col("c_mktsegment").alias("name"), F.lit("").alias("description"), quote.alias("evidence_quote"))
    edge = F.struct(person.alias("from"), team.alias("to"), F.lit("member_of").alias("relationship_type"), F.lit("0.8").alias("confidence"), quote.alias("evidence_quote"), *times)
    claim = F.struct(
        person.alias("subject"), F.when(k % 3 == 0, "title").when(k % 3 == 1, "Mood").otherwise("reports_to").alias("predicate"), F.concat(F.lit("v"), k % 7).alias("object"),
        F.when(k % 4 == 0, "0.9").when(k % 4 == 1, "0.5").when(k % 4 == 2, "high").otherwise("1.0").alias("confidence"), F.when(k % 5 == 0, "never said so").otherwise(quote).alias("evidence_quote"), *times,
    )
    doc = F.concat(F.lit("src"), (k % 200) % 20, F.lit(":"), k % 200)
    rows = t.customer.select(doc.alias("doc_id"), k.cast("int").alias("window_id"), F.concat("c_name", F.lit(" works for "), "c_mktsegment", F.lit(" as manager")).alias("source_window"), F.array(entity).alias("entities"), F.array(edge).alias("relationships"), F.array(claim).alias("claims"))
    return rows.select([F.col(f.name).cast(f.dataType) for f in t.spark.createDataFrame([], ledger.PARSED).schema.fields])


def registries(t):
    one = t.spark.createDataFrame
    return {
        "predicates": one([("title", ["person"]), ("reports_to", ["team"])], "predicate string, subject_types array<string>"),
        "edge_types": one([("member_of", ["person"], ["team"])], "relationship_type string, from_types array<string>, to_types array<string>"),
        "entity_types": one([("team",), ("glossary",)], "key string"), "persons": t.v_persons,
        "entities": one([], "entity_id string, entity_type string, name string, description string, evidence_doc_ids array<string>"),
    }


WINDOWS = """w as (select c_custkey as k, concat('p', c_custkey) as person, concat('src', (c_custkey % 200) % 20, ':', c_custkey % 200) as doc_id, c_custkey % 10 <> 3 as known, c_custkey % 5 <> 0 as held from customer join v_documents d on d.doc_id = concat('src', (c_custkey % 200) % 20, ':', c_custkey % 200) and not d.deleted),
f as (select *, known and held and k % 4 <> 2 and k % 3 <> 2 as claimed, case when k % 3 = 0 and k % 4 in (0, 3) then 'active' else 'proposed' end as status from w)"""


@query("f19_apply_extractions", f"""with {WINDOWS} select 'claim' as kind, doc_id, person as subject, case k % 3 when 0 then 'title' else 'mood' end as name, concat('v', k % 7) as value, status, case k % 3 when 0 then 'extraction' else 'extraction:untyped' end as created_by from f where claimed
union all select 'relationship', doc_id, person, 'member_of', 'team', 'active', 'extraction' from f where known""")
def f19(t):
    out = ledger.apply_extractions(windows(t), t.v_documents, **registries(t))
    claims = out["claims"].select(F.lit("claim").alias("kind"), F.col("evidence_doc_ids")[0].alias("doc_id"), F.col("subject_id").alias("subject"), F.col("predicate").alias("name"), F.col("object_text").alias("value"), "status", "created_by")
    rels = out["relationships"].select(F.lit("relationship").alias("kind"), F.col("evidence_doc_ids")[0].alias("doc_id"), F.col("from_id").alias("subject"), F.col("relationship_type").alias("name"), F.col("to_type").alias("value"), "status", "created_by")
    return claims.unionByName(rels)


@query("f19_extraction_counters", f"""with {WINDOWS} select doc_id, count_if(k % 6 >= 2) as entities, count_if(known) as relationships, count_if(claimed) as claims, count_if(known) + count_if(claimed and status = 'active') as active_facts, count_if(claimed and status = 'proposed') as proposed_facts,
 count_if(k % 6 = 0) + count_if(claimed and k % 3 = 1) + count_if(known and held and k % 4 <> 2 and k % 3 = 2) as dropped_untyped, count_if(not held) as dropped_unverifiable, count_if(k % 6 = 1) + count_if(not known) + count_if(held and not known) as skipped_mentions, count_if(known and held and k % 4 = 2) as malformed from f group by 1""")
def f19c(t):
    return ledger.apply_extractions(windows(t), t.v_documents, **registries(t))["counters"]


@query("s2_stream_versions", "select distinct concat('src', user_id % 20, ':', user_id) as doc_id, sha256(props) as text_hash from events where event_type not in ('error', 'purchase')")
def s2(t):
    """The events as a stream, in one batch: replays of the same document and text are dropped."""
    rows = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "permission_change").otherwise("update")
    env = rows.select(F.concat(F.lit("src"), F.col("user_id") % 20, F.lit(":"), "user_id").alias("doc_id"), kind.alias("change_kind"), F.col("ts").alias("event_time"), F.sha2("props", 256).alias("text_hash"))
    path = folder(t)
    feed_streams.stream_versions(env).select("doc_id", "text_hash").writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return t.spark.read.schema("doc_id string, text_hash string").parquet(f"{path}/out")


@query("s5_stream_ledger", f"""with {WINDOWS}, g as (select person, case k % 3 when 0 then 'title' else 'mood' end as name, concat('v', k % 7) as value, max(status = 'active') as active, string_agg(distinct doc_id, ',' order by doc_id) as docs from f where claimed group by all)
select person as subject_id, name as predicate, value as object_text, case when active then 'active' else 'proposed' end as status, docs from g""")
def s5(t):
    """All windows as a stream of files in two batches; the ledger that they leave."""
    path, told = folder(t), windows(t)
    told.repartition(2).write.parquet(f"{path}/parsed")
    stream = t.spark.readStream.schema(told.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/parsed")
    tables = registries(t)
    tables.pop("entities")
    exclusive = t.spark.createDataFrame([("title",)], "predicate string")
    feed_streams.stream_ledger(stream, f"{path}/ledger", t.v_documents, exclusive=exclusive, now=F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), checkpoint=f"{path}/state", available_now=True, **tables).awaitTermination()
    rows = feed_streams.read_ledger(t.spark, f"{path}/ledger", "claims")
    return rows.select("subject_id", "predicate", "object_text", "status", joined("evidence_doc_ids").alias("docs"))
