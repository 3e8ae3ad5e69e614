"""Queries on claims, relationships and their reads, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.functions import ranking, temporal
from factlake.operators import acl, ledger, reads
from factlake.plans.registry import query
from factlake.plans.views import Tables

def now():
    """The reading clock of the claims, which end in 1998 here."""
    return F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")

#: The ontology's predicates (exclusive, half-life in days) and exclusive edge types.
PREDICATES = [("title", True, 180.0), ("team", False, 90.0), ("reports_to", True, 180.0), ("definition", True, 365.0)]
EXCLUSIVE_EDGES = ["reports_to"]


def predicates(t: Tables):
    return t.spark.createDataFrame(PREDICATES, "predicate string, mutually_exclusive boolean, freshness_half_life_days double")


def exclusive(t: Tables):
    return predicates(t).where("mutually_exclusive").select("predicate")


def edges(t: Tables):
    return t.spark.createDataFrame([(e,) for e in EXCLUSIVE_EDGES], "relationship_type string")


def visible(t: Tables):
    return acl.visible_docs(t.v_documents, t.v_viewers)


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def joined(column: str):
    return F.array_join(column, ",")


VIS = """vis as (select v.viewer_id, d.doc_id from v_viewers v join v_documents d on not d.deleted and (d.org_visible or list_has_any(d.allowed_principals, v.principals)))"""


def seen(view: str, key: str, name: str = "av") -> str:
    return f"""{name}_c as (select distinct {key}, unnest(evidence_doc_ids) as doc_id from {view}),
{name}_n as (select {key}, count(*) as n from {name}_c group by {key}),
{name} as (select c.{key}, vis.viewer_id from {name}_c c join vis using (doc_id) join {name}_n n on n.{key} = c.{key} group by c.{key}, vis.viewer_id, n.n having count(*) = n.n)"""


FROM = """case f.time_grain when 'month' then date_trunc('month', f.valid_from) when 'quarter' then date_trunc('quarter', f.valid_from) when 'year' then date_trunc('year', f.valid_from) else f.valid_from end"""
PTS = """pts as (select point_id, coalesce(as_of, believed_as_of, timestamp '1998-01-01') as i, case when as_of is not null then coalesce(as_of_grain, 'unknown') else 'day' end as g,
 coalesce(believed_as_of, timestamp '1998-01-01') as b, as_of is not null or believed_as_of is not null as is_point from v_points),
pb as (select *, case g when 'month' then date_trunc('month', i) when 'quarter' then date_trunc('quarter', i) when 'year' then date_trunc('year', i) end as s,
 case g when 'month' then date_trunc('month', i) + interval 1 month when 'quarter' then date_trunc('quarter', i) + interval 3 month when 'year' then date_trunc('year', i) + interval 12 month end as e from pts)"""
AT = f"""(f.status = 'active' or (pb.is_point and f.status = 'superseded')) and f.recorded_at <= pb.b and (f.invalidated_at is null or f.invalidated_at > pb.b)
 and case when pb.s is not null then ({FROM} is null or {FROM} < pb.e) and (f.valid_to is null or f.valid_to > pb.s) else ({FROM} is null or {FROM} <= pb.i) and (f.valid_to is null or f.valid_to > pb.i) end"""


@query("d2_visible_docs", f"with {VIS} select viewer_id, doc_id from vis")
def d2(t):
    return visible(t).pairs(t.v_viewers)


@query("d3_all_visible_claims", f"with {VIS}, {seen('v_claims', 'claim_id')} select claim_id, viewer_id from av")
def d3(t):
    rows = t.v_claims.select("claim_id").join(F.broadcast(t.v_viewers.select("viewer_id")), how="cross")
    return acl.seen_by(rows, t.v_claims, visible(t), "claim_id")


@query("d4_visible_evidence", f"""with {VIS}, e as (select c.claim_id, v.viewer_id, list_filter(c.evidence_doc_ids, lambda d: list_contains(l.ids, d)) as k
 from v_claims c cross join v_viewers v join (select viewer_id, list(doc_id) as ids from vis group by viewer_id) l on l.viewer_id = v.viewer_id)
select claim_id, viewer_id, array_to_string(k, ',') as visible_doc_ids from e""")
def d4(t):
    rows = t.v_claims.select("claim_id", "evidence_doc_ids").join(F.broadcast(t.v_viewers.select("viewer_id")), how="cross")
    return acl.visible_evidence(rows, visible(t), "claim_id").select("claim_id", "viewer_id", joined("visible_doc_ids").alias("visible_doc_ids"))


@query("d7_person_evidence", f"with {VIS} select distinct v.viewer_id, p.person_id, count(distinct p.doc_id) as n_docs from v_participants p join vis v using (doc_id) group by all")
def d7(t):
    seen_ = acl.person_evidence(t.v_participants, visible(t))
    public = seen_.where("viewer_id is null").drop("viewer_id").join(F.broadcast(t.v_viewers.select("viewer_id")), how="cross")
    return seen_.where("viewer_id is not null").unionByName(public).groupBy("viewer_id", "person_id").agg(F.count(F.lit(1)).alias("n_docs"))


@query("d6_document_filters", """select doc_id from v_documents d where source_type in ('en', 'de') and event_time >= timestamp '2024-01-02' and event_time <= timestamp '2024-01-08'
 and exists (select 1 from v_participants p where p.doc_id = d.doc_id and p.role = 'author' and p.person_id = 'p7')""")
def d6(t):
    spec = acl.FilterSpec(source_types=["en", "de"], event_from=F.lit("2024-01-02").cast("timestamp_ntz"), event_to=F.lit("2024-01-08").cast("timestamp_ntz"), author_person="p7")
    return acl.document_filters(t.v_documents, spec, t.v_participants).select("doc_id")


@query("d8_node_labels", f"""with {VIS}, {seen('v_entities', 'entity_id', 'ae')},
nodes as (select v.viewer_id, 'person' as node_type, canonical_id as node_id from v_persons cross join v_viewers v union all select v.viewer_id, entity_type, entity_id from v_entities cross join v_viewers v)
select n.viewer_id, n.node_type, n.node_id, coalesce(p.display_name, e.name, concat(n.node_type, ':', n.node_id)) as label from nodes n
left join v_persons p on n.node_type = 'person' and p.canonical_id = n.node_id
left join (select ae.viewer_id, e.entity_id, e.name from ae join v_entities e using (entity_id)) e on n.node_type <> 'person' and e.entity_id = n.node_id and e.viewer_id = n.viewer_id""")
def d8(t):
    people = t.v_persons.select(F.lit("person").alias("node_type"), F.col("canonical_id").alias("node_id"))
    nodes = people.unionByName(t.v_entities.select(F.col("entity_type").alias("node_type"), F.col("entity_id").alias("node_id")))
    nodes = nodes.join(F.broadcast(t.v_viewers.select("viewer_id")), how="cross")
    return acl.node_labels(nodes, t.v_persons, t.v_entities, visible(t))


@query("d9_read_sources", f"""with {VIS}, p as (select doc_id, string_agg(chunk_id, '|' order by chunk_id) as passages from v_chunks group by doc_id)
select v.viewer_id, d.doc_id, case when d.deleted then 'not_found' when vis.doc_id is null then 'forbidden' else 'ok' end as status,
 case when not d.deleted and vis.doc_id is not null then p.passages end as passages
from v_documents d cross join v_viewers v left join vis on vis.viewer_id = v.viewer_id and vis.doc_id = d.doc_id left join p on p.doc_id = d.doc_id""")
def d9(t):
    requests = t.v_documents.select("doc_id").join(F.broadcast(t.v_viewers.select("viewer_id")), how="cross")
    chunks = t.v_chunks.select("doc_id", "chunk_role", F.col("chunk_id").alias("chunk_index"), F.col("chunk_id").alias("text"))
    out = acl.read_sources(requests, t.v_documents, chunks, visible(t))
    return out.withColumn("passages", F.array_join("passages", "|"))


@query("d10_require_visible_evidence", f"with {VIS}, {seen('v_claims', 'claim_id')} select c.claim_id from v_claims c where not exists (select 1 from av where av.claim_id = c.claim_id and av.viewer_id = 'v2')")
def d10(t):
    _, bad = acl.require_visible_evidence(t.v_claims.withColumn("viewer_id", F.lit("v2")), visible(t), "claim_id")
    return bad.select("claim_id")


@query("e3_expand_valid_from", f"select claim_id, strftime({FROM}, '%Y-%m-%d %H:%M:%S') as floored from v_claims f")
def e3(t):
    out = t.v_claims.select("claim_id", temporal.expand_valid_from(F.col("valid_from"), F.col("time_grain")).alias("at"))
    return out.select("claim_id", stamp("at").alias("floored"))


@query("e4_query_bucket", """select claim_id, strftime(case time_grain when 'month' then date_trunc('month', valid_from) when 'quarter' then date_trunc('quarter', valid_from) when 'year' then date_trunc('year', valid_from) end, '%Y-%m-%d') as s,
 strftime(case time_grain when 'month' then date_trunc('month', valid_from) + interval 1 month when 'quarter' then date_trunc('quarter', valid_from) + interval 3 month when 'year' then date_trunc('year', valid_from) + interval 12 month end, '%Y-%m-%d') as e from v_claims""")
def e4(t):
    s, e = temporal.query_bucket(F.col("valid_from"), F.col("time_grain"))
    return t.v_claims.select("claim_id", F.date_format(s, "yyyy-MM-dd").alias("s"), F.date_format(e, "yyyy-MM-dd").alias("e"))


@query("e5_valid_believed_claims", f"with {PTS} select f.claim_id, pb.point_id from v_claims f join pb on {AT}")
def e5(t):
    return reads.at_points(t.v_claims, t.v_points, now()).select("claim_id", "point_id")


@query("e5_claims_at_order_points", f"with {PTS.replace('v_points', 'v_order_points')} select f.claim_id, pb.point_id from v_claims f join v_claims o on o.subject_id = f.subject_id join pb on substr(pb.point_id, 2) = substr(o.claim_id, 2) and {AT}")
def e5_orders(t):
    """Each order's point in time for the claims of its own subject."""
    order = F.substring("claim_id", 2, 20)
    subjects = t.v_claims.select(F.concat(F.lit("o"), order).alias("point_id"), "subject_id")
    return reads.at_points(t.v_claims, t.v_order_points.drop("host_grain").join(subjects, "point_id"), now(), ["subject_id"], ["claim_id", "point_id"])


@query("e2_validate_points", """select point_id, case trim(lower(host_grain)) when 'month' then 'month' when 'quarter' then 'quarter' when 'year' then 'year' else '' end as grain, coalesce(host_grain <> 'decade', true) as ok from v_order_points""")
def e2(t):
    grain, ok = temporal.host_grain(F.col("host_grain"))
    return t.v_order_points.select("point_id", F.coalesce(grain, F.lit("")).alias("grain"), ok.alias("ok"))


@query("e9_shift_months", "select claim_id, strftime(valid_from - interval 7 month, '%Y-%m-%d') as back, strftime(valid_from + interval 13 month, '%Y-%m-%d') as ahead from v_claims")
def e9(t):
    back, ahead = (temporal.plus_months(F.col("valid_from"), F.lit(n)) for n in (-7, 13))
    return t.v_claims.select("claim_id", F.date_format(back, "yyyy-MM-dd").alias("back"), F.date_format(ahead, "yyyy-MM-dd").alias("ahead"))


PHRASES = """p as (select claim_id, valid_from as r, case hash_k when 0 then concat(k, ' weeks ago') when 1 then concat('about ', k, ' months ago') when 2 then 'last summer' when 3 then 'last winter' when 4 then 'this year' when 5 then concat(k, ' days ago') when 6 then 'Yesterday' else 'once' end as phrase, k, hash_k
 from (select claim_id, valid_from, cast(substr(claim_id, 2) as bigint) % 8 as hash_k, cast(substr(claim_id, 2) as bigint) % 11 as k from v_claims))"""


@query("e10_e11_ground_times", f"""with {PHRASES} select claim_id, strftime(case hash_k when 0 then r - to_days(cast(7 * k as int)) when 1 then r - to_months(cast(k as int)) when 2 then make_timestamp(case when month(r) >= 9 then year(r) else year(r) - 1 end, 7, 15, 0, 0, 0)
 when 3 then make_timestamp(case when month(r) >= 3 then year(r) else year(r) - 1 end, 1, 15, 0, 0, 0) when 4 then date_trunc('year', r) when 5 then r - to_days(cast(k as int)) when 6 then r - interval 1 day else r end, '%Y-%m-%d') as grounded,
 case hash_k when 0 then 'day' when 1 then 'month' when 2 then 'month' when 3 then 'month' when 4 then 'year' else 'day' end as grain from p""")
def e11(t):
    n = F.expr("cast(substr(claim_id, 2) as bigint)")
    k = (n % 11).cast("string")
    options = [F.concat(k, F.lit(" weeks ago")), F.concat(F.lit("about "), k, F.lit(" months ago")), F.lit("last summer"), F.lit("last winter"), F.lit("this year"), F.concat(k, F.lit(" days ago")), F.lit("Yesterday")]
    phrase = F.lit("once")
    for i, option in enumerate(options):
        phrase = F.when(n % 8 == i, option).otherwise(phrase)
    rows = t.v_claims.select("claim_id", "valid_from", phrase.alias("phrase"))
    none = F.lit(None).cast("string")
    at, _, grain, _ = temporal.ground_times(F.col("phrase"), none, F.col("phrase"), none, F.col("valid_from"))
    return rows.select("claim_id", F.date_format(at, "yyyy-MM-dd").alias("grounded"), grain.alias("grain"))


@query("f1_collapse_duplicates", """with live as (select * from v_claims where status in ('proposed', 'active', 'retracted')),
g as (select subject_id, predicate, object_text, count(*) as n, max(confidence) as confidence from live group by all)
select subject_id, predicate, object_text, confidence, n - 1 as superseded from g""")
def f1(t):
    out = ledger.collapse_duplicates(t.v_claims, t.v_documents, now())
    slot = ["subject_id", "predicate", "object_text"]
    kept = out.where("status in ('proposed', 'active', 'retracted')").select(*slot, "confidence", "claim_id")
    lost = out.where("superseded_by is not null").groupBy(F.col("superseded_by").alias("claim_id")).agg(F.count(F.lit(1)).alias("superseded"))
    return kept.join(lost, "claim_id", "left").select(*slot, "confidence", F.coalesce("superseded", F.lit(0).cast("long")).alias("superseded"))


@query("f2_merge_evidence", """with e as (select subject_id, predicate, object_text, unnest(evidence_doc_ids) as d from v_claims),
g as (select subject_id, predicate, object_text, string_agg(distinct d, ',' order by d) as docs from e group by all),
c as (select subject_id, predicate, object_text, max(confidence) as confidence, strftime(arg_min(valid_from, (created_at, claim_id)), '%Y-%m-%d') as valid_from, count(*) as merged from v_claims group by all)
select c.*, g.docs from c join g using (subject_id, predicate, object_text)""")
def f2(t):
    out = ledger.merge_evidence(t.v_claims, ["subject_id", "predicate", "object_text"])
    return out.select("subject_id", "predicate", "object_text", "confidence", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), "merged", joined("evidence_doc_ids").alias("docs"))


RANKED = """nt as (select c.claim_id, max(d.event_time) as newest from (select claim_id, unnest(list_distinct(evidence_doc_ids)) as doc_id from v_claims) c join v_documents d on d.doc_id = c.doc_id and not d.deleted group by 1),
rk as (select c.*, nt.newest, case when starts_with(created_by, 'structured_field') then 4 when starts_with(created_by, 'agent_promote') then 3 when len(list_distinct(evidence_doc_ids)) >= 2 then 2 else 1 end as precedence from v_claims c left join nt using (claim_id))"""
ORDER = "precedence desc, newest desc nulls last, confidence desc, updated_at desc, claim_id desc"


@query("f5_rank_conflicts", f"""with {RANKED} select claim_id, cast(row_number() over (partition by subject_id, predicate order by {ORDER}) as bigint) as place,
 case precedence when 4 then 'ground_truth' when 3 then 'agent_promote' when 2 then 'extraction_multi' else 'extraction_single' end as precedence_class from rk where status = 'active'""")
def f5(t):
    return ledger.rank_conflicts(t.v_claims, t.v_documents, ["subject_id", "predicate"]).select("claim_id", "place", "precedence_class")


@query("f6_latest_evidence", f"with {RANKED} select claim_id, strftime(newest, '%Y-%m-%d %H:%M:%S') as newest from rk")
def f6(t):
    return ledger.latest_evidence_time(t.v_claims, t.v_documents, "claim_id").select("claim_id", stamp("newest").alias("newest"))


@query("f8_close_claim_slots", f"""with {RANKED}, a as (select *, first_value(object_text) over w as best, first_value(valid_from) over w as best_from, first_value(claim_id) over w as best_id
 from rk where status = 'active' and predicate in ('title', 'reports_to', 'definition') window w as (partition by subject_id, predicate order by {ORDER}))
select c.claim_id, case when a.best <> a.object_text then 'superseded' else c.status end as status, case when a.best <> a.object_text then a.best_id end as superseded_by,
 strftime(case when a.best <> a.object_text then coalesce(c.valid_to, a.best_from) else c.valid_to end, '%Y-%m-%d') as valid_to from v_claims c left join a using (claim_id)""")
def f8(t):
    out = ledger.close_claim_slots(t.v_claims, t.v_documents, exclusive(t), now())
    return out.select("claim_id", "status", "superseded_by", F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"))


@query("f10_lower_rivals", """with p as (select *, case when starts_with(created_by, 'structured_field') then 4 when starts_with(created_by, 'agent_promote') then 3 when len(list_distinct(evidence_doc_ids)) >= 2 then 2 else 1 end as pr from v_claims where status = 'active'),
w as (select * from p where pr = 4 and claim_id = (select max(q.claim_id) from p q where q.pr = 4 and q.subject_id = p.subject_id and q.predicate = p.predicate))
select p.claim_id, p.pr < w.pr as closed from p join w on p.subject_id = w.subject_id and p.predicate = w.predicate and p.claim_id <> w.claim_id and p.object_text <> w.object_text""")
def f10(t):
    told = t.v_claims.where("status = 'active' and created_by like 'structured_field%'")
    winners = told.groupBy("subject_id", "predicate").agg(F.max_by(F.struct(*told.columns), "claim_id").alias("w")).select("w.*")
    closed, left = ledger.supersede_lower_rivals(winners, t.v_claims, now())
    return closed.select("claim_id", F.lit(True).alias("closed")).unionByName(left.select("claim_id", F.lit(False).alias("closed")))


@query("f11_claim_conflicts", "select subject_id, predicate, count(*) as n_claims, count(distinct object_text) as n_values from v_claims where status = 'active' group by all having count(*) > 1")
def f11(t):
    return ledger.claim_conflicts(t.v_claims)


@query("f11_relationship_conflicts", "select from_type, from_id, relationship_type, count(distinct concat(case when cast(split_part(substr(relationship_id, 2), '_', 1) as bigint) % 3 = 0 then 'team' else to_type end, ':', to_id)) as n_targets from v_relationships where relationship_type = 'reports_to' group by all having n_targets > 1")
def f11r(t):
    kind = F.when(F.expr("cast(split_part(substr(relationship_id, 2), '_', 1) as bigint) % 3 = 0"), "team").otherwise(F.col("to_type"))
    return ledger.relationship_conflicts(t.v_relationships.withColumn("to_type", kind), edges(t))


@query("f15_check_transitions", """select claim_id, status as old, case when cast(substr(claim_id, 2) as bigint) % 3 = 0 then 'active' else 'proposed' end as new from v_claims where
 (status, case when cast(substr(claim_id, 2) as bigint) % 3 = 0 then 'active' else 'proposed' end) not in (('proposed', 'active'), ('retracted', 'proposed'), ('retracted', 'active'), ('active', 'active'), ('proposed', 'proposed'))""")
def f15(t):
    after = t.v_claims.withColumn("status", F.expr("case when cast(substr(claim_id, 2) as bigint) % 3 = 0 then 'active' else 'proposed' end"))
    return ledger.check_transitions(t.v_claims, after, "claim_id")


@query("f17_retract_evidence", """with r as (select doc_id, not org_visible as private, event_time from v_documents where n % 5 = 0),
x as (select c.claim_id, r.* from (select claim_id, unnest(list_distinct(evidence_doc_ids)) as doc_id from v_claims where status in ('proposed', 'active')) c join r using (doc_id)),
g as (select claim_id, list(doc_id) as gone, bool_or(private) as p, max(event_time) as at from x group by 1)
select c.claim_id, case when len(list_filter(c.evidence_doc_ids, lambda d: not list_contains(g.gone, d))) = 0 or g.p then 'retracted' else c.status end as status,
 array_to_string(list_filter(list_distinct(c.evidence_doc_ids), lambda d: not list_contains(g.gone, d)), ',') as docs from v_claims c join g using (claim_id)""")
def f17(t):
    removed = t.v_documents.where("n % 5 = 0").select("doc_id", (~F.col("org_visible")).alias("private"), "event_time")
    return ledger.retract_evidence(t.v_claims, removed, "claim_id", now()).select("claim_id", "status", joined("evidence_doc_ids").alias("docs"))


@query("f18_strip_entity_evidence", """select e.entity_id, array_to_string(list_filter(evidence_doc_ids, lambda d: not list_contains(g.gone, d)), ',') as docs from v_entities e cross join (select list(doc_id) as gone from v_documents where n % 5 = 0) g""")
def f18(t):
    return ledger.strip_entity_evidence(t.v_entities, t.v_documents.where("n % 5 = 0")).select("entity_id", joined("evidence_doc_ids").alias("docs"))


@query("f20_resolve_mentions", """with m as (select entity_id as mention_id, upper(name) as name, entity_type as type from v_entities),
h as (select m.mention_id, min(e.entity_id) as id, min(e.entity_type) as et, count(distinct e.entity_id) as n from m join v_entities e on lower(e.name) = lower(m.name) and e.entity_type = m.type group by 1)
select m.mention_id, case when h.n = 1 then h.et end as subject_type, case when h.n = 1 then h.id end as subject_id from m left join h using (mention_id)""")
def f20(t):
    mentions = t.v_entities.select(F.col("entity_id").alias("mention_id"), F.upper("name").alias("name"), F.col("entity_type").alias("type"))
    return ledger.resolve_mentions(mentions, t.v_persons, t.v_entities)


@query("f21_seed_definitions", "select entity_id, 'definition' as predicate, trim(description) as object_text, 0.85 as confidence, array_to_string(evidence_doc_ids, ',') as docs from v_entities where entity_type = 'glossary' and length(trim(description)) >= 8")
def f21(t):
    return ledger.seed_definitions(t.v_entities, t.v_claims).select("entity_id", "predicate", "object_text", F.round("confidence", 6).alias("confidence"), joined("evidence_doc_ids").alias("docs"))


@query("f22_upsert_entities", """with e as (select entity_type, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) as normalized_name, unnest(evidence_doc_ids) as d from v_entities)
select entity_type, normalized_name, string_agg(distinct d, ',' order by d) as docs from e group by all""")
def f22(t):
    half = F.expr("cast(substr(entity_id, 2) as bigint) % 2 = 0")
    out = ledger.upsert_entities(t.v_entities.where(half), t.v_entities.where(~half))
    return out.select("entity_type", "normalized_name", joined("evidence_doc_ids").alias("docs"))


@query("f24_generate_proposals", """with d as (select c.claim_id, count_if(doc.doc_id is null) as dead from (select claim_id, unnest(list_distinct(evidence_doc_ids)) as doc_id from v_claims) c left join v_documents doc on doc.doc_id = c.doc_id and not doc.deleted group by 1)
select coalesce(case when predicate = 'team' then 'unbound' when not starts_with(created_by, 'structured_field') and confidence < 0.8 then 'low_confidence' when d.dead > 0 then 'stale_evidence' end, 'proposed') as outcome, count(*) as n from v_claims c left join d using (claim_id) where status = 'active' group by 1""")
def f24(t):
    bindings = predicates(t).where("predicate <> 'team'").select("predicate", F.lit("people").alias("taxonomy_key"), F.col("predicate").alias("field_key"))
    out = ledger.generate_proposals(t.v_claims, t.v_documents, bindings)
    return out.groupBy(F.coalesce("skip_reason", F.lit("proposed")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("f25_slot_winners", f"""with {RANKED} select subject_id, predicate, claim_id from (select *, row_number() over (partition by subject_id, predicate order by precedence desc, confidence desc, newest desc nulls last, claim_id desc) as r from rk where status = 'active') where r = 1""")
def f25(t):
    bindings = predicates(t).select("predicate", F.lit("people").alias("taxonomy_key"), F.col("predicate").alias("field_key"))
    return ledger.pick_slot_winners(t.v_claims.where("status = 'active'"), t.v_documents, bindings).select("subject_id", "predicate", "claim_id")


@query("c9_content_support", """with e as (select c.claim_id, lower(c.object_text) as v, unnest(list_distinct(c.evidence_doc_ids)) as doc_id from v_claims c)
select e.claim_id, bool_and(coalesce(contains(lower(concat(d.title, chr(10), d.rendered_text)), e.v), false)) as supported from e left join v_documents d using (doc_id) group by 1""")
def c9(t):
    return ledger.content_support(t.v_claims, t.v_documents)


@query("g1_claims_for_viewers", f"with {VIS}, {seen('v_claims', 'claim_id')}, {PTS} select f.claim_id, av.viewer_id, pb.point_id from v_claims f join pb on {AT} join av on av.claim_id = f.claim_id")
def g1(t):
    return reads.claims_for_viewers(t.v_claims, None, t.v_viewers, visible(t), t.v_points, now()).select("claim_id", "viewer_id", "point_id")


@query("g2_relationships_for_viewers", f"""with {VIS}, {seen('v_relationships', 'relationship_id')}, {PTS}, nodes as (select distinct subject_id as id from v_claims)
select f.relationship_id, n.id as node_id, av.viewer_id, pb.point_id from v_relationships f join nodes n on n.id in (f.from_id, f.to_id) join pb on {AT} join av on av.relationship_id = f.relationship_id""")
def g2(t):
    nodes = t.v_claims.select(F.lit("person").alias("node_type"), F.col("subject_id").alias("node_id")).distinct()
    out = reads.relationships_for_viewers(t.v_relationships, nodes, t.v_viewers, visible(t), t.v_points, now())
    return out.select("relationship_id", "node_id", "viewer_id", "point_id")


HALF = "case predicate when 'title' then 180.0 when 'team' then 90.0 when 'reports_to' then 180.0 else 365.0 end"
FACTS = f"""q as (select f.*, av.viewer_id, pb.point_id, f.confidence * greatest(pow(0.5, greatest(date_diff('second', f.valid_from, timestamp '1998-01-01') / 86400.0, 0) / {HALF}), 0.25) as freshness
 from v_claims f join pb on {AT} join av on av.claim_id = f.claim_id),
r as (select *, row_number() over w as rank, count(*) over (partition by viewer_id, point_id, subject_id) > 5 as truncated from q window w as (partition by viewer_id, point_id, subject_id order by freshness desc, confidence desc, claim_id desc))"""


@query("g5_query_facts", f"""with {VIS}, {seen('v_claims', 'claim_id')}, {PTS}, {FACTS}
select viewer_id, point_id, subject_id, cast(rank as bigint) as rank, claim_id, predicate, object_text, round(freshness, 6) as freshness, truncated from r where rank <= 5""")
def g5(t):
    out = reads.query_facts(t.v_claims, None, t.v_viewers, visible(t), t.v_points, predicates(t), now(), 5)
    return out.select("viewer_id", "point_id", "subject_id", "rank", "claim_id", "predicate", "object_text", F.round("freshness", 6).alias("freshness"), "truncated")


@query("g7_diff_facts", f"""with {VIS}, {seen('v_claims', 'claim_id')}, {PTS}, c as (select f.claim_id, f.subject_id, f.predicate, f.object_text, av.viewer_id, pb.point_id from v_claims f join pb on {AT} join av on av.claim_id = f.claim_id),
b as (select coalesce(o.viewer_id, n.viewer_id) as viewer_id, coalesce(o.subject_id, n.subject_id) as subject_id, coalesce(o.predicate, n.predicate) as predicate, o.claim_id as oid, n.claim_id as nid, coalesce(o.object_text, n.object_text) as v
 from (select * from c where point_id = 'w1') o full join (select * from c where point_id = 'now') n on o.viewer_id = n.viewer_id and o.claim_id = n.claim_id),
u as (select viewer_id, subject_id, predicate, 'unchanged' as kind, oid as old_id, nid as new_id from b where oid is not null and nid is not null
 union all select viewer_id, subject_id, predicate, case when oid is null then 'added' else 'removed' end, oid, nid from b where (oid is null or nid is null) and predicate = 'team'),
o as (select *, row_number() over (partition by viewer_id, subject_id, predicate order by oid) as p from b where nid is null and predicate <> 'team'),
n as (select *, row_number() over (partition by viewer_id, subject_id, predicate order by nid) as p from b where oid is null and predicate <> 'team'),
x as (select coalesce(o.viewer_id, n.viewer_id) as viewer_id, coalesce(o.subject_id, n.subject_id) as subject_id, coalesce(o.predicate, n.predicate) as predicate,
 case when o.oid is not null and n.nid is not null then case when o.v <> n.v then 'changed' else 'replaced' end when o.oid is not null then 'removed' else 'added' end as kind, o.oid as old_id, n.nid as new_id
 from o full join n on o.viewer_id = n.viewer_id and o.subject_id = n.subject_id and o.predicate = n.predicate and o.p = n.p)
select * from u union all select * from x""")
def g7(t):
    rows = reads.claims_for_viewers(t.v_claims, None, t.v_viewers, visible(t), t.v_points, now())
    out = reads.diff_snapshots(rows.where("point_id = 'w1'"), rows.where("point_id = 'now'"), ["viewer_id", "subject_id"], exclusive(t))
    return out.select("viewer_id", "subject_id", "predicate", "kind", "old_id", "new_id")


def walks(kinds: str, limit: int) -> str:
    return f"""with {VIS}, {seen('v_relationships', 'relationship_id')}, {PTS}, e as (select av.viewer_id, pb.point_id, f.relationship_id as id, f.from_id as a, f.to_id as b from v_relationships f join pb on {AT} join av on av.relationship_id = f.relationship_id where {kinds}),
p1 as (select viewer_id, point_id, a as start, [a, b] as nodes, [id] as es, b from e where a <> b),
p2 as (select p.viewer_id, p.point_id, start, list_append(nodes, e.b) as nodes, list_append(es, e.id) as es, e.b from p1 p join e on e.viewer_id = p.viewer_id and e.point_id = p.point_id and e.a = p.b where not list_contains(nodes, e.b)),
p3 as (select p.viewer_id, p.point_id, start, list_append(nodes, e.b) as nodes, list_append(es, e.id) as es, e.b from p2 p join e on e.viewer_id = p.viewer_id and e.point_id = p.point_id and e.a = p.b where not list_contains(nodes, e.b)),
u as (select *, 1 as depth from p1 union all select *, 2 from p2 union all select *, 3 from p3),
r as (select *, row_number() over (partition by viewer_id, point_id, start order by depth, es[-1], es) as rank, count(*) over (partition by viewer_id, point_id, start) > {limit} as truncated from u)
select viewer_id, point_id, start, cast(depth as bigint) as depth, array_to_string(es, ',') as edges, truncated from r where rank <= {limit}"""


def walked(t, types, limit):
    starts = t.v_relationships.select(F.col("from_type").alias("node_type"), F.col("from_id").alias("node_id")).distinct()
    out = reads.walk_paths(t.v_relationships, starts, t.v_viewers, visible(t), t.v_points, now(), 3, limit, types)
    return out.select("viewer_id", "point_id", F.regexp_replace("start", "person:", "").alias("start"), "depth", joined("edges").alias("edges"), "truncated")


@query("g8_walk_paths", walks("true", 20))
def g8(t):
    return walked(t, None, 20)


@query("g8_walk_paths_of_types", walks("f.relationship_type in ('reports_to', 'member_of')", 50))
def g8_types(t):
    return walked(t, ["reports_to", "member_of"], 50)


@query("g3_search_entities", f"""with {VIS}, {seen('v_entities', 'entity_id')}, h as (select q.query_id, av.viewer_id, e.entity_id, row_number() over (partition by q.query_id, av.viewer_id order by lower(e.name), e.entity_id) as rank
 from v_words q join v_entities e on contains(lower(e.name), lower(q.pattern)) and (q.entity_type is null or q.entity_type = e.entity_type) join av on av.entity_id = e.entity_id)
select query_id, viewer_id, entity_id, cast(rank as bigint) as rank from h where rank <= 10""")
def g3(t):
    return reads.search_entities(t.v_entities, t.v_words, t.v_viewers, visible(t), 10).select("query_id", "viewer_id", "entity_id", "rank")


@query("g4_list_entities", f"""with {VIS}, {seen('v_entities', 'entity_id')}, h as (select av.viewer_id, e.entity_type, e.entity_id, row_number() over (partition by av.viewer_id, e.entity_type order by e.name, e.entity_id) as rank from v_entities e join av on av.entity_id = e.entity_id)
select viewer_id, entity_type, entity_id from h where rank <= 7""")
def g4(t):
    return reads.list_entities(t.v_entities, t.v_viewers, visible(t), 7).select("viewer_id", "entity_type", "entity_id")


@query("g9_subject_card", f"""with {VIS}, {seen('v_claims', 'claim_id')}, {seen('v_relationships', 'relationship_id', 'ar')}, {PTS},
ps as (select canonical_id as subject_id, coalesce(merged_into_id, canonical_id) as root_id from v_persons),
cl as (select av.viewer_id, pb.point_id, f.subject_id as root_id, string_agg(f.claim_id, ',' order by f.claim_id) as claims from v_claims f join pb on {AT} join av on av.claim_id = f.claim_id group by all),
ed as (select viewer_id, point_id, root_id, string_agg(id, ',' order by id) as edges from (select distinct ar.viewer_id, pb.point_id, u.root_id, f.relationship_id as id from v_relationships f join pb on {AT} join ar on ar.relationship_id = f.relationship_id
 join (select distinct root_id from ps) u on u.root_id in (f.from_id, f.to_id)) group by all)
select ps.subject_id, ps.root_id, v.viewer_id, p.point_id, cl.claims, ed.edges from ps cross join v_viewers v cross join v_points p left join cl on cl.viewer_id = v.viewer_id and cl.point_id = p.point_id and cl.root_id = ps.root_id
left join ed on ed.viewer_id = v.viewer_id and ed.point_id = p.point_id and ed.root_id = ps.root_id""")
def g9(t):
    subjects = t.v_persons.select(F.col("canonical_id").alias("subject_id"))
    out = reads.subject_card(subjects, t.v_persons, t.v_claims, t.v_relationships, t.v_viewers, visible(t), t.v_points, now())
    return out.select("subject_id", "root_id", "viewer_id", "point_id", joined("claims.claim_id").alias("claims"), joined("edges.relationship_id").alias("edges"))


@query("g10_search_people", """select query_id, canonical_id, cast(row_number() over (partition by query_id order by display_name, canonical_id) as bigint) as rank from v_names join v_persons on merged_into_id is null and contains(lower(display_name), lower(name)) qualify rank <= 20""")
def g10(t):
    return reads.search_people(t.v_persons, t.v_names.withColumnRenamed("name", "pattern"), 20).select("query_id", "canonical_id", "rank")


@query("g14_alias_query_text", "select p.canonical_id, coalesce(case when a.n is null or a.n = p.display_name then p.display_name else concat(p.display_name, ' ', a.n) end, '') as query_text from v_persons p left join (select person_id, min(display_name) as n from v_aliases group by 1) a on a.person_id = p.canonical_id")
def g14(t):
    return reads.alias_query_text(t.v_persons, t.v_aliases)


@query("h6_fact_freshness", f"select claim_id, round(confidence * greatest(pow(0.5, greatest(date_diff('second', valid_from, timestamp '1998-01-01') / 86400.0, 0) / {HALF}), 0.25), 6) as freshness from v_claims")
def h6(t):
    rows = t.v_claims.join(F.broadcast(predicates(t)), "predicate")
    score = ranking.fact_freshness(F.col("confidence"), F.col("valid_from"), now(), F.col("freshness_half_life_days"))
    return rows.select("claim_id", F.round(score, 6).alias("freshness"))


@query("e1_normalize_grain", "select claim_id, case when g in ('day', 'month', 'quarter', 'year', 'unknown') then g else 'unknown' end as grain from (select claim_id, lower(trim(case cast(substr(claim_id, 2) as bigint) % 4 when 0 then ' Month ' when 1 then 'decade' when 2 then null else upper(time_grain) end)) as g from v_claims)")
def e1(t):
    n = F.expr("cast(substr(claim_id, 2) as bigint)") % 4
    raw = F.when(n == 0, " Month ").when(n == 1, "decade").when(n == 3, F.upper("time_grain"))
    return t.v_claims.select("claim_id", temporal.normalize_grain(raw).alias("grain"))


@query("e7_e8_resolved_points", """select point_id, strftime(coalesce(as_of, believed_as_of, timestamp '1998-01-01'), '%Y-%m-%d') as instant, case when as_of is not null then coalesce(as_of_grain, 'unknown') else 'day' end as grain,
 strftime(coalesce(believed_as_of, timestamp '1998-01-01'), '%Y-%m-%d') as belief, case when as_of is not null or believed_as_of is not null then 'active,superseded' else 'active' end as statuses from v_order_points""")
def e78(t):
    out = reads.resolved_points(t.v_order_points, now())
    return out.select("point_id", F.date_format("instant", "yyyy-MM-dd").alias("instant"), "grain", F.date_format("belief", "yyyy-MM-dd").alias("belief"), joined("statuses").alias("statuses"))


@query("e12_merge_windows", "select subject_id, strftime(arg_min(valid_to, (created_at, claim_id)) filter (valid_to is not null), '%Y-%m-%d') as valid_to, strftime(arg_min(valid_from, (created_at, claim_id)), '%Y-%m-%d') as valid_from from v_claims group by 1")
def e12(t):
    out = ledger.merge_evidence(t.v_claims, ["subject_id"])
    return out.select("subject_id", F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"), F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"))


@query("d5_redact_quotes", f"""with {VIS}, q as (select claim_id, unnest(evidence_doc_ids) as doc_id from v_claims) select q.claim_id, v.viewer_id, count(vis.doc_id) as n_quotes from q cross join v_viewers v left join vis on vis.viewer_id = v.viewer_id and vis.doc_id = q.doc_id group by 1, 2""")
def d5(t):
    quotes = F.transform("evidence_doc_ids", lambda d: F.struct(d.alias("doc_id"), F.lit("said so").alias("quote")))
    rows = t.v_claims.select("claim_id", "evidence_doc_ids", quotes.alias("quotes")).join(F.broadcast(t.v_viewers.select("viewer_id")), how="cross")
    rows = acl.visible_evidence(rows, visible(t), "claim_id")
    return rows.select("claim_id", "viewer_id", F.size(acl.redact_quotes(F.col("quotes"), F.col("visible_doc_ids"))).cast("long").alias("n_quotes"))


def relationships(t):
    """Edges with the ledger's columns: two creators, some confidence, an update time."""
    k = F.expr("cast(split(substr(relationship_id, 2), '_')[0] as bigint)")
    return t.v_relationships.withColumns({"confidence": F.round(0.5 + (k % 50) / 100.0, 2), "created_by": F.when(k % 3 == 0, "structured_field:x").otherwise("extraction"), "updated_at": F.col("valid_from"), "created_at": F.col("valid_from"), "to_id": F.concat("to_id", F.lit("_"), k % 2)})


@query("f9_close_relationship_slots", """with r as (select *, cast(split_part(substr(relationship_id, 2), '_', 1) as bigint) as k from v_relationships), x as (select *, concat(to_id, '_', k % 2) as t2, round(0.5 + (k % 50) / 100.0, 2) as confidence, case when k % 3 = 0 then 4 when len(list_distinct(evidence_doc_ids)) >= 2 then 2 else 1 end as precedence from r where relationship_type = 'reports_to'),
n as (select x.relationship_id, max(d.event_time) as newest from x join v_documents d on d.doc_id = x.evidence_doc_ids[1] and not d.deleted group by 1),
w as (select x.*, first_value(t2) over ws as best from x left join n using (relationship_id) window ws as (partition by from_id order by precedence desc, newest desc nulls last, confidence desc, valid_from desc, relationship_id desc))
select r.relationship_id, case when w.best <> w.t2 then 'superseded' else r.status end as status from r left join w using (relationship_id)""")
def f9(t):
    return ledger.close_relationship_slots(relationships(t), t.v_documents, edges(t), now()).select("relationship_id", "status")


@query("f12_resolve_conflicts", f"""with {RANKED}, a as (select *, first_value(object_text) over w as best from rk where status = 'active' and predicate in ('title', 'team') window w as (partition by subject_id, predicate order by {ORDER}))
select c.claim_id, case when a.best <> a.object_text then 'superseded' else c.status end as status from v_claims c left join a using (claim_id)""")
def f12(t):
    registry = predicates(t).where("predicate in ('title', 'definition')").withColumn("mutually_exclusive", F.col("predicate") == "title")
    verdicts = t.spark.createDataFrame([("team", True), ("reports_to", False)], "predicate string, exclusive boolean")
    return ledger.resolve_conflicts(t.v_claims, t.v_documents, registry, verdicts, now()).select("claim_id", "status")



@query("f13_merge_relationships", """with r as (select *, cast(split_part(substr(relationship_id, 2), '_', 1) as bigint) as k from v_relationships), o as (select from_id, relationship_type, to_id, min(relationship_id) as id, count(*) as c from r where k < 500 group by all), n as (select from_id, relationship_type, to_id, min(relationship_id) as id from r where k >= 500 group by all),
e as (select from_id, relationship_type, to_id, string_agg(distinct d, ',' order by d) as docs from (select from_id, relationship_type, to_id, unnest(evidence_doc_ids) as d from r) group by all)
select from_id, relationship_type, to_id, coalesce(o.id, n.id) as relationship_id, e.docs from o full join n using (from_id, relationship_type, to_id) join e using (from_id, relationship_type, to_id)""")
def f13(t):
    rows = t.v_relationships.withColumns({"confidence": F.lit(0.9), "created_by": F.lit("extraction")})
    k = F.expr("cast(split(substr(relationship_id, 2), '_')[0] as bigint)")
    out = ledger.merge_relationships(rows.where(k < 500), rows.where(k >= 500))
    return out.select("from_id", "relationship_type", "to_id", "relationship_id", joined("evidence_doc_ids").alias("docs"))


@query("f14_merge_claims", """with c as (select *, cast(substr(claim_id, 2) as bigint) as k from v_claims where status <> 'superseded'), b as (select *, row_number() over (partition by subject_id, predicate, object_text order by k) as rn from c),
e as (select subject_id, predicate, object_text, string_agg(distinct d, ',' order by d) as docs from (select subject_id, predicate, object_text, unnest(evidence_doc_ids) as d from b) group by all)
select subject_id, predicate, object_text, max(confidence) as confidence, any_value(e.docs) as docs from b join e using (subject_id, predicate, object_text) group by all""")
def f14(t):
    from pyspark.sql import Window

    k = F.expr("cast(substr(claim_id, 2) as bigint)")
    rows = t.v_claims.where("status <> 'superseded'").withColumn("rn", F.row_number().over(Window.partitionBy("subject_id", "predicate", "object_text").orderBy(k)))
    out = ledger.merge_claims(rows.where("rn = 1"), rows.where("rn > 1"))
    return out.select("subject_id", "predicate", "object_text", "confidence", F.array_join(F.array_sort(F.array_distinct("evidence_doc_ids")), ",").alias("docs"))


@query("f28_decide_proposals", "select claim_id as proposal_id, case when status <> 'proposed' then 'not_pending' when cast(substr(claim_id, 2) as bigint) % 4 = 0 then 'applied' else 'rejected' end as outcome from v_claims")
def f28(t):
    rows = t.v_claims.select(F.col("claim_id").alias("proposal_id"), F.when(F.col("status") == "proposed", "pending").otherwise("applied").alias("status"))
    told = rows.select("proposal_id", F.when(F.expr("cast(substr(proposal_id, 2) as bigint) % 4 = 0"), "apply").otherwise("reject").alias("decision"), F.lit("u").alias("decided_by"))
    return ledger.decide_proposals(rows, told).select("proposal_id", "outcome")


@query("f26_upsert_proposals", """with w as (select subject_id, predicate, arg_max(claim_id, claim_id) as n_claim, arg_max(object_text, claim_id) as n_value from v_claims where status = 'active' group by all), o as (select subject_id, predicate, arg_min(claim_id, claim_id) as claim, arg_min(object_text, claim_id) as value from v_claims where status = 'active' and predicate <> 'team' group by all)
select coalesce(w.subject_id, o.subject_id) as subject_id, coalesce(w.predicate, o.predicate) as field_key, case when o.claim is null then 'created' when w.n_claim = o.claim then 'raised' else 'superseded' end as action, w.n_claim as source_claim_id from w full join o using (subject_id, predicate)""")
def f26(t):
    active = t.v_claims.where("status = 'active'")
    pick = lambda f: active.groupBy("subject_id", "predicate").agg(f(F.struct("claim_id", "object_text", "evidence_doc_ids", "confidence"), "claim_id").alias("c")).select("subject_id", F.lit("people").alias("taxonomy_key"), F.col("predicate").alias("field_key"), "c.*")
    old = pick(F.min_by).where("field_key <> 'team'").select("subject_id", "taxonomy_key", "field_key", F.concat(F.lit("q"), "claim_id").alias("proposal_id"), F.lit("pending").alias("status"), F.col("object_text").alias("value_text"), F.col("claim_id").alias("source_claim_id"), "evidence_doc_ids", "confidence")
    return ledger.upsert_proposals(old, pick(F.max_by)).select("subject_id", "field_key", "action", "source_claim_id")


@query("f27_promote_claims", f"""with {VIS}, {seen('v_claims', 'claim_id')}, e as (select c.claim_id, bool_and(coalesce(contains(lower(concat(d.title, chr(10), d.rendered_text)), 'doc'), false)) as ok from (select claim_id, unnest(list_distinct(evidence_doc_ids)) as doc_id from v_claims) c left join v_documents d using (doc_id) group by 1)
select c.claim_id as promotion_id, case when c.predicate = 'team' then 'unbound' when p.canonical_id is null then 'unknown_subject' when av.claim_id is null then 'evidence_not_visible' when not e.ok then 'unsupported' else 'promoted' end as outcome
 from v_claims c left join v_persons p on p.canonical_id = c.subject_id left join av on av.claim_id = c.claim_id and av.viewer_id = 'v1' left join e on e.claim_id = c.claim_id""")
def f27(t):
    bindings = predicates(t).where("predicate <> 'team'").select("predicate", F.lit("people").alias("taxonomy_key"))
    rows = t.v_claims.select(F.col("claim_id").alias("promotion_id"), F.lit("v1").alias("viewer_id"), "subject_id", "predicate", F.lit("Doc").alias("object_text"), "evidence_doc_ids")
    ok, bad = ledger.promote_claims(rows, bindings, t.v_persons, t.v_documents, visible(t), now())
    return ok.select(F.col("claim_id").alias("promotion_id"), F.lit("promoted").alias("outcome")).unionByName(bad.select("promotion_id", F.col("reason").alias("outcome")))


@query("g13_subject_candidates", """with w as (select query_id, lower(name) as name from v_names), s as (select 'person' as type, canonical_id as id, display_name as label from v_persons where merged_into_id is null union all select entity_type, entity_id, name from v_entities)
select w.query_id, s.type, count(*) as n from w join s on contains(lower(s.label), w.name) group by all""")
def g13(t):
    return reads.subject_candidates(t.v_names, t.v_persons, t.v_entities).groupBy("query_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query("i13_reconcile_slots", f"""with {RANKED}, roots as (select distinct coalesce(merged_into_id, canonical_id) as id from v_persons where merged_into_id is not null), a as (select rk.*, first_value(object_text) over w as best from rk join roots on roots.id = rk.subject_id where status = 'active' and predicate in ('title', 'reports_to', 'definition') window w as (partition by subject_id, predicate order by {ORDER}))
select c.claim_id, case when a.best <> a.object_text then 'superseded' else c.status end as status from v_claims c join roots on roots.id = c.subject_id left join a using (claim_id)""")
def i13(t):
    roots = t.v_persons.where("merged_into_id is not null").select(F.col("merged_into_id").alias("subject_id")).distinct()
    own = t.v_claims.join(roots, "subject_id", "left_semi").select(t.v_claims.columns)
    return ledger.close_claim_slots(own, t.v_documents, exclusive(t), now()).select("claim_id", "status")
