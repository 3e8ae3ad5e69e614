"""Queries on identity and collaboration, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.functions.identity import normalize_email
from factlake.operators import people, reads
from factlake.plans.facts import VIS, joined, seen, stamp, visible
from factlake.plans.feed import clock
from factlake.plans.registry import query



def mail(c: str) -> str:
    lower = f"lower(trim({c}))"
    return f"(case when split_part({lower}, '@', 2) in ('gmail.com', 'googlemail.com') then concat(replace(split_part(split_part({lower}, '@', 1), '+', 1), '.', ''), '@gmail.com') else concat(split_part(split_part({lower}, '@', 1), '+', 1), '@', split_part({lower}, '@', 2)) end)"


@query("i1_normalize_email", f"select person_id, {mail('email')} as mail from v_aliases")
def i1(t):
    return t.v_aliases.select("person_id", normalize_email(F.col("email")).alias("mail"))


@query("i2_match_identities", f"""with i as (select concat('n', c_custkey) as identity_id, case when c_custkey % 5 = 0 then 'service' else 'person' end as kind, case when c_custkey % 2 = 0 then 'slack' else 'hr' end as source_system, concat('x', c_custkey % 600) as external_id,
 concat('user.', c_custkey % 450, '@corp.example') as email, c_custkey % 3 <> 0 as email_verified from customer),
s as (select source_system, external_id, min(person_id) as p from v_aliases group by 1, 2), m as (select {mail('email')} as mail, min(person_id) as p from v_aliases where email_verified group by 1)
select i.identity_id, coalesce(s.p, m.p) as person_id, case when s.p is not null then 'source' when m.p is not null then 'email' else 'new' end as matched_by from i left join s using (source_system, external_id) left join m on i.email_verified and m.mail = {mail('i.email')} where kind = 'person'""")
def i2(t):
    k = F.col("c_custkey")
    rows = t.customer.select(
        F.concat(F.lit("n"), k).alias("identity_id"), F.when(k % 5 == 0, "service").otherwise("person").alias("kind"), F.when(k % 2 == 0, "slack").otherwise("hr").alias("source_system"), F.concat(F.lit("x"), k % 600).alias("external_id"),
        F.concat(F.lit("user."), k % 450, F.lit("@corp.example")).alias("email"), (k % 3 != 0).alias("email_verified"),
    )
    return people.match_identities(rows, t.v_aliases)


@query("i3_upsert_aliases", "with n as (select *, cast(substr(person_id, 2) as bigint) as k from v_aliases), c as (select person_id, source_system, external_id, case when k % 3 = 1 then 'new@corp.example' else email end as email, false as history from n) select * from c union all select person_id, source_system, external_id, email, true from n where k % 3 = 1")
def i3(t):
    k = F.expr("cast(substr(person_id, 2) as bigint)")
    incoming = t.v_aliases.where(k % 3 == 1).withColumns({"email": F.lit("new@corp.example"), "email_verified": F.lit(False)})
    return people.upsert_aliases(t.v_aliases, incoming).select("person_id", "source_system", "external_id", "email", "history")


@query("i4_embedding_candidates", """with p as (select vec_id as id, embedding from embeddings where vec_id % 9 <> 4), s as (select q.id as q_id, e.id as id, list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) as sim from p q join p e on e.id <> q.id and q.id % 20 = 0),
r as (select *, row_number() over (partition by q_id order by round(sim, 9) desc, id) as rank from s where sim >= 0.3) select q_id, id, round(sim, 6) as similarity from r where rank <= 3""")
def i4(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    persons = rows.select(F.col("id").alias("canonical_id"), F.when(F.col("id") % 9 == 4, F.col("id") + 1).alias("merged_into_id"))
    found = people.embedding_candidates(rows, rows.where("id % 20 = 0"), 0.3, persons=persons, index=people.person_index(rows, persons))
    return found.select("q_id", "id", F.round("similarity", 6).alias("similarity"))


@query("i4_name_candidates", """with n as (select distinct canonical_id as id, concat('n', cast(substr(canonical_id, 2) as bigint) % 100) as name from v_persons where merged_into_id is null),
r as (select *, row_number() over (partition by name order by id) as k from n) select distinct least(a.id, b.id) as a, greatest(a.id, b.id) as b from r a join r b on a.name = b.name and b.k between a.k + 1 and a.k + 5""")
def i4n(t):
    named = t.v_persons.withColumn("display_name", F.concat(F.lit("N"), F.expr("cast(substr(canonical_id, 2) as bigint)") % 100))
    return people.name_candidates(named, t.v_aliases.where("false"))


PAIRS = "pairs as (select concat('p', k) as a, concat('p', k + 300) as b from (select c_custkey as k from customer))"


def pairs(t):
    k = F.col("c_custkey")
    return t.customer.select(F.concat(F.lit("p"), k).alias("a"), F.concat(F.lit("p"), k + 300).alias("b"))


@query("i5_hard_conflicts", f"with {PAIRS} select p.a, p.b, x.source_system as sources from pairs p join v_aliases x on x.person_id = p.a join v_aliases y on y.person_id = p.b and y.source_system = x.source_system and y.external_id <> x.external_id")
def i5(t):
    return people.hard_conflicts(pairs(t), t.v_aliases).select("a", "b", joined("sources").alias("sources"))


SIGNALS = f"""f as (select person_id, lower(display_name) as n, case when email_verified then {mail('email')} end as m from v_aliases),
sg as (select p.a, p.b, x.n = y.n as nm, coalesce(split_part(x.m, '@', 2) = split_part(y.m, '@', 2), false) as d, coalesce(x.m = y.m, false) as e from pairs p left join f x on x.person_id = p.a left join f y on y.person_id = p.b)"""


@query("i6_signals", f"with {PAIRS}, {SIGNALS} select a, b, array_to_string(list_filter([case when nm then 'shared_name' end, case when d then 'shared_domain' end, case when e then 'shared_email' end], lambda v: v is not null), ',') as signals from sg")
def i6(t):
    return people.corroborating_signals(pairs(t), t.v_aliases).select("a", "b", joined("signals").alias("signals"))


FACETS = f"""fs as (select person_id, string_agg(distinct lower(trim(regexp_replace(display_name, '\\s+', ' ', 'g'))), chr(31) order by lower(trim(regexp_replace(display_name, '\\s+', ' ', 'g')))) as names,
 string_agg(distinct case when email_verified then {mail('email')} end, chr(31) order by case when email_verified then {mail('email')} end) as mails, string_agg(distinct concat(source_system, ':', external_id), chr(31) order by concat(source_system, ':', external_id)) as ids from v_aliases group by 1)"""


@query("i8_fingerprints", f"with {PAIRS}, {FACETS} select p.a, p.b, sha256(concat(coalesce(x.names, ''), chr(30), coalesce(x.mails, ''), chr(30), coalesce(x.ids, ''), chr(30), coalesce(y.names, ''), chr(30), coalesce(y.mails, ''), chr(30), coalesce(y.ids, ''))) as fingerprint from pairs p left join fs x on x.person_id = p.a left join fs y on y.person_id = p.b")
def i8(t):
    return people.identity_fingerprint(pairs(t), t.v_aliases)


@query("i9_merge_decisions", f"""with {PAIRS}, c as (select distinct p.a, p.b from pairs p join v_aliases x on x.person_id = p.a join v_aliases y on y.person_id = p.b and y.source_system = x.source_system and y.external_id <> x.external_id), {SIGNALS}
select sg.a, sg.b, case when c.a is not null then 'blocked_conflict' when not (coalesce(nm, false) and e) then 'unsure' when cast(substr(sg.a, 2) as bigint) % 2 = 0 then 'auto_merged' else 'different' end as outcome from sg left join c on c.a = sg.a and c.b = sg.b""")
def i9(t):
    rows = pairs(t)
    even = F.expr("cast(substr(a, 2) as bigint) % 2 = 0")
    verdicts = rows.select("a", "b", F.when(even, "same").otherwise("different").alias("verdict"), F.lit(0.97).alias("confidence"))
    return people.merge_decisions(rows, t.v_aliases, verdicts).select("a", "b", "outcome")


@query("i10_merge_people", """with recursive p as (select canonical_id, case when cast(substr(canonical_id, 2) as bigint) % 10 = 3 then concat('p', cast(substr(canonical_id, 2) as bigint) - 1) end as up from v_persons),
r as (select canonical_id, coalesce(up, canonical_id) as root_id from p) select c.claim_id, r.root_id as subject_id, c.subject_id as origin_subject_id from v_claims c join r on r.canonical_id = c.subject_id""")
def i10(t):
    roots = reads.person_roots(t.v_persons)
    return people.repoint(t.v_claims, roots, ["subject_id"]).select("claim_id", "subject_id", "origin_subject_id").join(roots.select(F.col("canonical_id").alias("origin_subject_id")), "origin_subject_id", "left_semi")


@query("i11_split_people", "select claim_id, case when cast(substr(subject_id, 2) as bigint) % 20 = 3 then subject_id when cast(substr(subject_id, 2) as bigint) % 10 = 3 then concat('p', cast(substr(subject_id, 2) as bigint) - 1) else subject_id end as subject_id from v_claims where subject_id <> 'p0'")
def i11(t):
    merged = people.repoint(t.v_claims.where("subject_id <> 'p0'"), reads.person_roots(t.v_persons), ["subject_id"])
    splits = t.v_persons.where("cast(substr(canonical_id, 2) as bigint) % 20 = 3").select(F.col("canonical_id").alias("person_id"))
    return people.split_people(merged, splits, ["subject_id"]).select("claim_id", "subject_id")


@query("i12_detect_splits", "select a.person_id as a, b.person_id as b from v_persons p join v_aliases a on a.person_id = p.canonical_id join v_aliases b on b.person_id = p.merged_into_id and b.source_system = 'slack' where p.merged_into_id is not null and a.external_id <> b.external_id")
def i12(t):
    return people.detect_splits(t.v_persons, t.v_aliases.withColumn("source_system", F.lit("slack"))).select("a", "b")


@query("i14_identity_metadata", f"select person_id, count(*) as n_aliases, count_if(email_verified) as n_verified, string_agg(distinct source_system, ',' order by source_system) as sources, string_agg(distinct split_part({mail('email')}, '@', 2), ',') as domains from v_aliases group by 1")
def i14(t):
    return people.identity_metadata(t.v_aliases).select("person_id", "n_aliases", "n_verified", joined("sources").alias("sources"), joined("domains").alias("domains"))


@query("i15_platform_user", "with o as (select concat(external_id, display_name) as external_id, min(person_id) as p from v_aliases where source_system = 'hr' group by 1 having count(*) = 1) select o.external_id, coalesce(v.merged_into_id, v.canonical_id) as person_id from o join v_persons v on v.canonical_id = o.p")
def i15(t):
    return people.platform_user(t.v_aliases.withColumn("external_id", F.concat("external_id", "display_name")), t.v_persons, "hr")


EDGES = """bp as (select doc_id, person_id, max(case role when 'author' then 1.0 when 'to' then 0.9 when 'participant' then 0.8 when 'reviewer' then 0.7 when 'cc' then 0.5 else 0.6 end) as w from v_participants where identity_kind <> 'service' group by 1, 2),
ce as (select a.person_id as person_a, b.person_id as person_b, sum(pow(0.5, greatest(date_diff('second', d.event_time, timestamp '2024-02-01') / 86400.0, 0) / 90.0) * case when d.org_visible then 0.25 else 1.0 end * sqrt(a.w * b.w)) as weight, count(*) as n_docs, max(d.event_time) as last
 from bp a join bp b on a.doc_id = b.doc_id and a.person_id < b.person_id join v_documents d on d.doc_id = a.doc_id and not d.deleted group by 1, 2)"""


def collaboration(t):
    return people.collaboration_edges(t.v_participants, t.v_documents, clock())


@query("j1_collaboration_edges", f"with {EDGES} select person_a, person_b, round(weight, 6) as weight, n_docs, strftime(last, '%Y-%m-%d %H:%M:%S') as last_seen from ce")
def j1(t):
    return collaboration(t).select("person_a", "person_b", F.round("weight", 6).alias("weight"), F.size("evidence_doc_ids").cast("long").alias("n_docs"), stamp("last_seen_at").alias("last_seen"))


@query("j2_top_collaborators", f"""with {VIS}, {EDGES}, ev as (select distinct a.person_id as pa, b.person_id as pb, a.doc_id from bp a join bp b on a.doc_id = b.doc_id and a.person_id < b.person_id join v_documents d on d.doc_id = a.doc_id and not d.deleted),
s as (select ev.pa, ev.pb, vis.viewer_id from ev join vis using (doc_id) join ce on ce.person_a = ev.pa and ce.person_b = ev.pb group by ev.pa, ev.pb, vis.viewer_id, ce.n_docs having count(*) = ce.n_docs),
x as (select s.viewer_id, s.pa as person_id, s.pb as other_id, ce.weight from s join ce on ce.person_a = s.pa and ce.person_b = s.pb union all select s.viewer_id, s.pb, s.pa, ce.weight from s join ce on ce.person_a = s.pa and ce.person_b = s.pb),
r as (select *, row_number() over (partition by viewer_id, person_id order by round(weight, 9) desc, other_id) as rank from x) select viewer_id, person_id, other_id, rank from r where rank <= 5""")
def j2(t):
    return people.top_collaborators(collaboration(t), t.v_viewers, visible(t), 5).select("viewer_id", "person_id", "other_id", "rank")


@query("j3_pair_strength", f"with {EDGES}, q as (select concat('p', (k + 7) % 500) as x, concat('p', k) as y from range(1, 150) t(k)) select q.x, q.y, round(coalesce(ce.weight, 0), 6) as weight from q left join ce on ce.person_a = least(q.x, q.y) and ce.person_b = greatest(q.x, q.y)")
def j3(t):
    k = F.col("id")
    q = t.spark.range(1, 150).select(F.concat(F.lit("p"), (k + 7) % 500).alias("x"), F.concat(F.lit("p"), k).alias("y"))
    return people.pair_strength(collaboration(t), q).select("x", "y", F.round("weight", 6).alias("weight"))


@query("g12_list_subjects", f"with {VIS}, {seen('v_entities', 'entity_id')}, h as (select av.viewer_id, e.entity_type as category, e.entity_id as subject_id, e.name as label from v_entities e join av on av.entity_id = e.entity_id union all select distinct vis.viewer_id, 'person', p.canonical_id, p.display_name from v_participants x join vis on vis.doc_id = x.doc_id join v_persons p on p.canonical_id = x.person_id and p.merged_into_id is null), r as (select *, row_number() over (partition by viewer_id, category order by label, subject_id) as rank from h) select viewer_id, category, subject_id, rank from r where rank <= 10")
def g12(t):
    return reads.list_subjects(t.v_entities, t.v_participants, t.v_persons, t.v_viewers, visible(t), 10).select("viewer_id", "category", "subject_id", "rank")


@query("g11_resolve_subjects", """with w as (select query_id, lower(name) as name from v_names), s as (select 'person' as type, canonical_id as id, display_name as label, 0 as place from v_persons where merged_into_id is null union all select entity_type, entity_id, name, case entity_type when 'team' then 1 when 'project' then 2 else 3 end from v_entities),
h as (select w.query_id, s.*, case when lower(s.label) = w.name then 0 else 1 end as inexact from w join s on contains(lower(s.label), w.name)), b as (select * from h qualify row(place, inexact) = min(row(place, inexact)) over (partition by query_id)),
f as (select query_id, min(type) as type, string_agg(distinct id, ',' order by id) as candidates, count(distinct id) as n from b group by 1)
select w.query_id, w.name, f.type, f.candidates, case when f.n is null then 'unknown' when f.n = 1 then 'resolved' else 'ambiguous' end as status from w left join f using (query_id)""")
def g11(t):
    return reads.resolve_subjects(t.v_names.withColumn("name", F.lower("name")), t.v_persons, t.v_entities).withColumn("candidates", F.array_join("candidates", ","))
