"""Derived views over the benchmark tables, spelled alike for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: ``[table]`` is a base table and ``<ts>`` the timestamp type without a zone.
VIEWS = {
    "v_documents": """
select concat('src', cast(doc_id % 20 as int), ':', doc_id) as doc_id, 'ws' as workspace_id, source as source_system, lang as source_type,
 concat('Doc ', doc_id) as title, text as rendered_text,
 <ts> '2024-01-01 00:00:00' + interval '1' hour * cast(doc_id % 2000 as int) as event_time,
 <ts> '2024-01-02 00:00:00' + interval '1' hour * cast(doc_id % 2000 as int) as updated_at,
 doc_id % 3 = 0 as org_visible, split(concat('g', doc_id % 5, ',u', doc_id % 11), ',') as allowed_principals,
 doc_id % 17 = 16 as deleted, doc_id as n from [documents]""",
    "v_viewers": """
select * from (values ('v1', split('u1,g0,g1,g2', ',')), ('v2', split('u2,g3', ',')), ('v3', split('u9', ','))) as t(viewer_id, principals)""",
    "v_points": """
select * from (values ('now', cast(null as <ts>), cast(null as <ts>), cast(null as varchar(10))),
 ('w1', <ts> '1995-03-15 00:00:00', cast(null as <ts>), 'month'), ('b1', cast(null as <ts>), <ts> '1996-06-01 00:00:00', cast(null as varchar(10))),
 ('j1', <ts> '1995-03-15 00:00:00', <ts> '1996-06-01 00:00:00', 'quarter')) as t(point_id, as_of, believed_as_of, as_of_grain)""",
    "v_order_points": """
select concat('o', o_orderkey) as point_id, case when o_orderkey % 3 <> 0 then o_orderdate end as as_of,
 case when o_orderkey % 4 < 2 then o_orderdate + interval '1' day * cast(o_orderkey % 200 as int) end as believed_as_of,
 case o_orderkey % 6 when 0 then ' Month ' when 1 then 'quarter' when 2 then 'YEAR' when 3 then '' when 4 then 'decade' end as host_grain,
 case o_orderkey % 5 when 0 then 'day' when 1 then 'month' when 2 then 'quarter' when 3 then 'unknown' end as as_of_grain from [orders]""",
    "v_claims": """
select concat('c', o_orderkey) as claim_id, 'ws' as workspace_id, 'person' as subject_type, concat('p', o_custkey % 500) as subject_id,
 case o_orderkey % 4 when 0 then 'title' when 1 then 'team' when 2 then 'reports_to' else 'definition' end as predicate, o_orderpriority as object_text,
 o_orderdate as valid_from, case when o_orderkey % 3 = 0 then o_orderdate + interval '1' day * cast(o_orderkey % 400 as int) end as valid_to,
 case o_orderkey % 5 when 0 then 'day' when 1 then 'month' when 2 then 'quarter' when 3 then 'year' else 'unknown' end as time_grain,
 o_orderdate + interval '1' day * cast(o_orderkey % 30 as int) as recorded_at,
 case when o_orderkey % 7 = 0 then o_orderdate + interval '1' day * cast(30 + o_orderkey % 300 as int) end as invalidated_at,
 cast(0.5 + (o_orderkey % 50) / 100.0 as double) as confidence,
 case o_orderkey % 10 when 0 then 'proposed' when 1 then 'superseded' when 2 then 'retracted' else 'active' end as status,
 split(concat('src', (o_orderkey % 200) % 20, ':', o_orderkey % 200, case when o_orderkey % 2 = 0 then concat(',src', (o_orderkey * 7 % 200) % 20, ':', o_orderkey * 7 % 200) else '' end), ',') as evidence_doc_ids,
 case o_orderkey % 6 when 0 then 'structured_field:ground_truth' when 1 then 'agent_promote:u1' else 'extraction' end as created_by,
 o_orderdate as created_at, o_orderdate + interval '1' day * cast(o_orderkey % 9 as int) as updated_at from [orders]""",
    "v_relationships": """
select concat('r', c_custkey, '_', k) as relationship_id, 'person' as from_type, concat('p', c_custkey % 500) as from_id, 'person' as to_type, concat('p', (c_custkey * (k + 1) + k) % 500) as to_id,
 case k when 1 then 'reports_to' when 2 then 'member_of' else 'uses_term' end as relationship_type, 'active' as status,
 <ts> '1995-01-01 00:00:00' + interval '1' day * cast(c_custkey % 900 as int) as valid_from, cast(null as <ts>) as valid_to, 'day' as time_grain,
 <ts> '1995-01-01 00:00:00' as recorded_at, cast(null as <ts>) as invalidated_at, split(concat('src', (c_custkey % 200) % 20, ':', c_custkey % 200), ',') as evidence_doc_ids
 from [customer] cross join (values (1), (2), (3)) as ks(k)""",
    "v_participants": """
select distinct concat('src', (event_id % 200) % 20, ':', event_id % 200) as doc_id, concat('p', user_id % 500) as person_id,
 case event_type when 'click' then 'author' when 'view' then 'to' when 'signup' then 'cc' when 'error' then 'reviewer' else 'participant' end as role, case when event_id % 23 = 0 then 'service' else 'person' end as identity_kind from [events]""",
    "v_chunks": """
select concat('src', (vec_id % 200) % 20, ':', vec_id % 200, '#', vec_id) as chunk_id, concat('src', (vec_id % 200) % 20, ':', vec_id % 200) as doc_id, 'child' as chunk_role, embedding, 'm1' as embedding_model, label from [embeddings]""",
    "v_query_vectors": "select concat('q', vec_id) as query_id, embedding from [embeddings] where vec_id % 20 = 0",
    "v_aliases": """
select concat('p', c_custkey) as person_id, case when c_custkey % 2 = 0 then 'slack' else 'hr' end as source_system, concat('x', c_custkey % 400) as external_id, c_name as display_name,
 concat('User.', c_custkey % 300, '+t@', case when c_custkey % 3 = 0 then 'GoogleMail.com' else 'corp.example' end) as email, c_custkey % 4 <> 0 as email_verified from [customer]""",
    "v_envelopes": """
select event_id as seq, concat('src', user_id % 20) as source_system, concat('', user_id) as external_id, case event_type when 'signup' then 'create' when 'error' then 'delete' when 'purchase' then 'permission_change' else 'update' end as change_kind,
 ts - interval '1' minute * cast(event_id * 37 % 600 as int) as event_time, ts as arrived_at, cast(floor(value) as bigint) % 2 = 0 as org_visible, split(concat('g', event_id % 5), ',') as allowed_principals, props as text from [events]""",
    "v_spend": """
select event_id as entry_id, event_type as job_class, ts as created_at, cast(floor(value * 100) as bigint) as tokens from [events]""",
    "v_persons": """
select concat('p', c_custkey) as canonical_id, c_name as display_name, case when c_custkey % 10 = 3 then concat('p', c_custkey - 1) end as merged_into_id,
 <ts> '2023-01-01 00:00:00' + interval '1' day * cast(c_custkey % 300 as int) as created_at from [customer]""",
    "v_entities": """
select concat('e', p_partkey) as entity_id, case p_partkey % 3 when 0 then 'team' when 1 then 'project' else 'glossary' end as entity_type, p_name as name,
 case when p_partkey % 4 = 0 then '' else concat('about ', p_name) end as description,
 split(concat('src', (p_partkey % 200) % 20, ':', p_partkey % 200), ',') as evidence_doc_ids from [part]""",
    "v_jobs": """
select event_id as job_id, event_type as job_type, case event_id % 5 when 0 then 'pending' when 1 then 'running' when 2 then 'done' when 3 then 'dead' else 'pending' end as status,
 concat('d', user_id % 50) as doc_id, concat('p', user_id % 30) as person_a, concat('p', event_id % 30) as person_b, ts as created_at, ts + interval '1' minute * cast(event_id % 90 as int) as updated_at from [events]""",
    "v_names": """
select concat('n', c_custkey) as query_id, case c_custkey % 10 when 0 then upper(c_name) when 1 then substr(c_name, 12, 6) when 2 then concat(c_name, 'x') else substr(c_name, 14, 5) end as name from [customer]""",
    "v_words": """
select w as query_id, upper(w) as pattern, case when length(w) % 2 = 0 then 'team' end as entity_type from (select distinct split_part(p_name, ' ', 1) as w from [part]) as ws""",
    "v_searches": """
select concat('q', item_id) as query_id, concat('"', split_part(text, ' ', 2), ' ', split_part(text, ' ', 3), ' ', split_part(text, ' ', 4), '" or ', split_part(text, ' ', 5), ' ', split_part(text, ' ', 6), ' -', split_part(text, ' ', 7)) as text from [benchmark]""",
    "v_work": """
select event_id as job_id, concat('ws', user_id % 2) as workspace_id,
 case event_id % 11 when 0 then 'extract_graph' when 1 then 'embed_chunks' when 2 then 'adjudicate_persons' when 3 then 'resolve_claim_conflict' when 4 then 'resolve_relationship_conflict'
 when 5 then 'generate_taxonomy_proposals' when 6 then 'aggregate_collaboration_edges' when 7 then 'push_taxonomy_proposal_webhook' when 8 then 'refresh_identity_embedding' when 9 then 'extract_graph' else 'export_bundle' end as job_type,
 case event_id % 3 when 0 then 'pending' when 1 then 'running' else 'done' end as status,
 concat('{"doc_id":"d', user_id % 50, '","person_a":"p', user_id % 12, '","person_b":"p', (event_id * 7) % 12, case when event_id % 13 = 0 then '' else '","subject_type":"person' end,
 '","subject_id":"s', user_id % 20, '","predicate":"', event_type, '","from_type":"person","from_id":"p', user_id % 9, '","relationship_type":"', event_type, case when event_id % 17 = 0 then '' else concat('","person_id":"p', user_id % 25) end, '"}') as payload,
 ts as created_at from [events]""",
    "v_episodes": """
select conv_id, count(*) as n_events, min(case when turn = 0 then text end) as objective from [conversations] group by conv_id""",
}
TIMESTAMPS = {"spark": "timestamp_ntz", "duckdb": "timestamp"}


class Tables:
    """Base tables and derived views of one folder as DataFrames: ``t.orders``, ``t.v_claims``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            found = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        elif name in VIEWS:
            sql = VIEWS[name].replace("<ts>", TIMESTAMPS["spark"]).replace("{", "{{").replace("}", "}}")
            used = re.findall(r"\[(\w+)\]", sql)
            found = self.spark.sql(re.sub(r"\[(\w+)\]", r"{\1}", sql), **{u: getattr(self, u) for u in used})
        else:
            raise AttributeError(name)
        setattr(self, name, found)
        return found


def twin(sql: str) -> str:
    """A DuckDB statement with the derived views that ``sql`` names put before it."""
    sql = sql.strip()
    used, todo = [], re.findall(r"\bv_\w+", sql)
    for name in todo:
        if name in VIEWS and name not in used:
            used.append(name)
    views = ", ".join(f"{v} as ({re.sub(r'\[(\w+)\]', r'\1', VIEWS[v]).replace('<ts>', TIMESTAMPS['duckdb'])})" for v in used)
    if not views:
        return sql
    if sql.lower().startswith("with recursive "):
        return f"with recursive {views}, {sql[15:]}"
    return f"with {views}, {sql[5:]}" if sql.lower().startswith("with ") else f"with {views} {sql}"
