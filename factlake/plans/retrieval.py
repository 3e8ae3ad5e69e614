"""Queries on retrieval and its evaluation, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.functions import ranking, temporal
from factlake.functions.text import STOP_WORDS, tokens
from factlake.operators import acl, context, profiles, search
from factlake.operators.term_index import TermIndex
from factlake.plans.facts import AT, HALF, PTS, VIS, joined, now, predicates, seen, stamp, visible
from factlake.plans.feed import FITS, TERMS, clock, searches
from factlake.plans.registry import query


def asked(t):
    return t.v_query_vectors.select("query_id", F.concat(F.lit("v"), F.expr("cast(substr(query_id, 2) as int) % 3 + 1")).alias("viewer_id"), "embedding")


VEC = f"""{VIS}, s as (select q.query_id, c.chunk_id, list_cosine_similarity(cast(c.embedding as double[]), cast(q.embedding as double[])) as sim from v_query_vectors q join v_chunks c on true
 join vis on vis.doc_id = c.doc_id and vis.viewer_id = concat('v', cast(substr(q.query_id, 2) as int) % 3 + 1)),
vc as (select *, row_number() over (partition by query_id order by round(sim, 9) desc, chunk_id) as rank from s)"""


@query("h1_vector_candidates", f"with {VEC} select query_id, chunk_id, cast(rank as bigint) as rank, round(sim, 6) as similarity from vc where rank <= 20")
def h1(t):
    out = search.vector_candidates(t.v_chunks, asked(t), visible(t), 20, search.passage_index(t.v_chunks))
    return out.select("query_id", "chunk_id", "rank", F.round("similarity", 6).alias("similarity"))


@query("h2_keyword_candidates", f"with {FITS}, kr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from fits) select query_id, doc_id, cast(rank as bigint) as rank, round(score, 6) as score from kr where rank <= 25")
def h2(t):
    out = TermIndex.build(t.v_documents, "doc_id").top(searches(t), 25)
    return out.select("query_id", F.col("key").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query("h3_fact_candidates", """with x as (select claim_id as id, concat(predicate, ': ', object_text) as text from v_claims union all select relationship_id, concat(from_id, ' ', relationship_type, ' ', to_id) from v_relationships),
tf as (select id, term, count(*)::double as score from (select id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from x) group by 1, 2),
h as (select id, sum(score) as score from tf where term in ('title', 'urgent') group by 1 having count(*) = 2),
r as (select id, score, row_number() over (order by score desc, id) as rank from h)
select id as fact_id, cast(rank as bigint) as rank, score from r where rank <= 30""")
def h3(t):
    queries = t.spark.createDataFrame([("q1", ["title", "urgent"], [], [])], "query_id string, must array<string>, any array<string>, no array<string>")
    return search.keyword_candidates(search.fact_terms(t.v_claims, t.v_relationships), queries, "fact_id", None, 30).select("fact_id", "rank", "score")


def ranked_lists(t):
    rows = t.v_chunks.select(F.lit("q").alias("query_id"), F.col("chunk_id").alias("item_id"), F.expr("cast(split(chunk_id, '#')[1] as bigint)").alias("n"))
    return rows.where("n % 2 = 0").withColumn("rank", F.col("n") % 97 + 1), rows.where("n % 3 = 0").withColumn("rank", F.col("n") % 89 + 1)


RRF = """l as (select chunk_id as item_id, doc_id, cast(split(chunk_id, '#')[2] as bigint) as n from v_chunks),
f as (select item_id, doc_id, sum(s) as score from (select item_id, doc_id, 1.0 / (60 + n % 97 + 1) as s from l where n % 2 = 0 union all select item_id, doc_id, 1.0 / (60 + n % 89 + 1) from l where n % 3 = 0) group by 1, 2)"""


@query("h4_rrf_fuse", f"with {RRF} select item_id, round(score, 9) as score from f")
def h4(t):
    return search.rrf_fuse(list(ranked_lists(t)), "item_id").select("item_id", F.round("score", 9).alias("score"))


@query("h5_recency", "select doc_id, round(greatest(pow(0.5, greatest(date_diff('second', event_time, timestamp '2024-02-01') / 86400.0, 0) / 90.0), 0.3), 6) as m from v_documents")
def h5(t):
    return t.v_documents.select("doc_id", F.round(ranking.recency_multiplier(F.col("event_time"), clock(), 90, 0.3), 6).alias("m"))


SHORT = f"""{RRF}, d as (select f.item_id, f.doc_id, f.score * greatest(pow(0.5, greatest(date_diff('second', d.event_time, timestamp '2024-02-01') / 86400.0, 0) / 90.0), 0.3) as score from f join v_documents d using (doc_id)),
sl as (select *, row_number() over (order by round(score, 12) desc, item_id) as rank from d)"""


def shortlist(t):
    items = t.v_chunks.join(t.v_documents.select("doc_id", "event_time"), "doc_id").select(F.col("chunk_id").alias("item_id"), F.lit("passage").alias("kind"), F.col("event_time").alias("at"), F.col("doc_id").alias("parent_id"))
    return search.decayed_shortlist(search.rrf_fuse(list(ranked_lists(t)), "item_id"), items, clock())


@query("h7_decayed_shortlist", f"with {SHORT} select item_id, cast(rank as bigint) as rank, round(score, 9) as score from sl where rank <= 100")
def h7(t):
    return shortlist(t).select("item_id", "rank", F.round("score", 9).alias("score"))


@query("h8_apply_rerank", f"with {SHORT}, g as (select *, cast(split(item_id, '#')[2] as bigint) % 13 as given from sl where rank <= 100), r as (select *, row_number() over (order by given desc, item_id) as r from g) select item_id, cast(r as bigint) as rank from r where r <= 10")
def h8(t):
    rows = shortlist(t)
    scores = rows.select("query_id", "item_id", F.expr("cast(cast(split(item_id, '#')[1] as bigint) % 13 as double)").alias("score"))
    return search.apply_rerank(rows, scores, 10).select("item_id", "rank")


@query("h9_dedupe_parents", f"with {SHORT}, p as (select *, row_number() over (partition by doc_id order by rank) as k, count(*) over () as n from sl where rank <= 100) select item_id, cast(n - (select count(*) from p where k = 1) as bigint) as removed from p where k = 1")
def h9(t):
    return search.dedupe_parents(shortlist(t)).select("item_id", "removed")


@query("h10_expand_authors", "with a as (select query_id, name as author from v_names), h as (select a.query_id, p.canonical_id, p.display_name, count(*) over (partition by a.query_id) as n from a join v_persons p on contains(lower(p.display_name), lower(a.author))) select query_id, concat('%', author, '%') as pattern from a union select query_id, concat('%', display_name, '%') from h where n <= 3 union select h.query_id, concat('%', l.display_name, '%') from h join v_aliases l on l.person_id = h.canonical_id where n <= 3")
def h10(t):
    authors = t.v_names.withColumnRenamed("name", "author")
    return search.expand_authors(authors, t.v_persons, t.v_aliases)


@query("h11_canonical_author", "select 'q' as query_id, canonical_id as person_id, merged_into_id is null as usable from v_persons union all select 'q', 'p-1', false")
def h11(t):
    ids = t.v_persons.select(F.lit("q").alias("query_id"), F.col("canonical_id").alias("person_id"))
    return search.canonical_author(ids.unionByName(t.spark.createDataFrame([("q", "p-1")], "query_id string, person_id string")), t.v_persons)


HYBRID = f"""{VEC}, {TERMS}, {seen('v_claims', 'claim_id')},
qs as (select query_id, concat('v', cast(substr(query_id, 2) as int) % 3 + 1) as viewer_id, cast(substr(query_id, 2) as int) // 20 % 3 as k from v_query_vectors),
w as (select qs.query_id, x.term, x.side from qs join (values (0, 'en', 'must'), (0, 'les', 'any'), (0, 'des', 'any'), (0, 'title', 'any'), (1, 'doc', 'must'), (1, 'und', 'any'), (1, 'der', 'any'), (1, 'rights', 'no'), (2, 'license', 'any'), (2, 'urgent', 'any'), (2, 'doc', 'no')) x(k, term, side) on x.k = qs.k),
nw as (select query_id, count_if(side = 'must') as n_must, count_if(side = 'any') as n_any from w group by 1),
kc as (select w.query_id, c.chunk_id, count(distinct case when side = 'must' then term end) as gm, count(distinct case when side = 'any' then term end) as ga, count_if(side = 'no') as gn, sum(case when side <> 'no' then tm.score end) as score
 from w join tm using (term) join v_chunks c on c.doc_id = tm.doc_id join qs on qs.query_id = w.query_id join vis on vis.doc_id = c.doc_id and vis.viewer_id = qs.viewer_id group by 1, 2),
hk as (select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from kc join nw using (query_id) where gm = n_must and (n_any = 0 or ga > 0) and gn = 0),
tf as (select claim_id, term, count(*)::double as score from (select claim_id, unnest(regexp_extract_all(lower(concat(predicate, ': ', object_text)), '[\\p{{L}}\\p{{N}}]+')) as term from v_claims) group by 1, 2),
fc as (select w.query_id, tf.claim_id, count(distinct case when side = 'must' then term end) as gm, count(distinct case when side = 'any' then term end) as ga, count_if(side = 'no') as gn, sum(case when side <> 'no' then tf.score end) as score
 from w join tf using (term) join qs on qs.query_id = w.query_id join av on av.claim_id = tf.claim_id and av.viewer_id = qs.viewer_id group by 1, 2),
hf as (select query_id, claim_id, row_number() over (partition by query_id order by round(score, 9) desc, claim_id) as rank from fc join nw using (query_id) where gm = n_must and (n_any = 0 or ga > 0) and gn = 0),
fu as (select query_id, item_id, sum(1.0 / (60 + rank)) as score from (select query_id, concat('chunk:', chunk_id) as item_id, rank from vc where rank <= 100 union all select query_id, concat('chunk:', chunk_id), rank from hk where rank <= 100 union all select query_id, concat('fact:', claim_id), rank from hf where rank <= 100) group by 1, 2),
ti as (select concat('chunk:', c.chunk_id) as item_id, d.event_time as at, c.doc_id as parent_id, 90.0 as half, 0.3 as floor from v_chunks c join v_documents d using (doc_id) union all select concat('fact:', claim_id), valid_from, null, 180.0, 0.25 from v_claims),
de as (select fu.query_id, fu.item_id, ti.parent_id, fu.score * greatest(pow(0.5, greatest(date_diff('second', ti.at, timestamp '2024-02-01') / 86400.0, 0) / half), floor) as score from fu join ti using (item_id)),
sl as (select *, row_number() over (partition by query_id order by round(score, 12) desc, item_id) as rank from de),
dp as (select *, row_number() over (partition by query_id, coalesce(parent_id, item_id) order by rank) as nth, count(*) over (partition by query_id) as n from sl where rank <= 10)"""


@query("h12_hybrid_search", f"with {HYBRID} select query_id, item_id, cast(rank as bigint) as rank, round(score, 9) as score, n - count(*) over (partition by query_id) as removed from dp where nth = 1")
def h12(t):
    chunks = t.v_chunks.join(t.v_documents.select("doc_id", "title", "rendered_text"), "doc_id")
    index = TermIndex.build(chunks, "chunk_id")
    words_ = [(0, "en les or en des or en title", ["en"], ["les", "des", "title"], []), (1, "doc und -rights or doc der -rights", ["doc"], ["und", "der"], ["rights"]), (2, "license -doc or urgent -doc", [], ["license", "urgent"], ["doc"])]
    words_ = t.spark.createDataFrame(words_, "k int, text string, must array<string>, any array<string>, no array<string>")
    queries = asked(t).withColumn("k", F.expr("cast(substr(query_id, 2) as int) div 20 % 3").cast("int")).join(F.broadcast(words_), "k").drop("k")
    facts = acl.with_readers(t.v_claims.select("claim_id", "evidence_doc_ids", "valid_from"), visible(t)).select(F.col("claim_id").alias("fact_id"), "viewer_id", F.col("valid_from").alias("at"))
    fact_index = search.fact_terms(t.v_claims, t.v_relationships)
    chunks = chunks.select("chunk_id", "doc_id", "chunk_role", "embedding")
    out = search.hybrid_search(queries, chunks, t.v_documents, index, facts, fact_index, visible(t), None, clock(), 10, vectors=search.passage_index(chunks))
    return out.select("query_id", "item_id", "rank", F.round("score", 9).alias("score"), "removed")


@query("h13_search_diagnostics", "select label::varchar as query_id, count_if(n % 6 = 0) as vector, count_if(n % 6 = 1) as keyword, count_if(n % 6 = 2) as fact, count_if(n % 6 = 3) as fused, count_if(n % 6 = 4) as shortlist, count_if(n % 6 = 5) as returned from (select label, cast(split(chunk_id, '#')[2] as bigint) as n from v_chunks) group by 1")
def h13(t):
    names = F.array(*[F.lit(x) for x in ("vector", "keyword", "fact", "fused", "shortlist", "returned")])
    n = F.expr("cast(split(chunk_id, '#')[1] as bigint)")
    return search.search_diagnostics(t.v_chunks.select(F.col("label").cast("string").alias("query_id"), F.element_at(names, (n % 6 + 1).cast("int")).alias("stage"), F.col("chunk_id").alias("item_id")))


PACK = """i as (select claim_id, subject_id as request_id, case cast(substr(claim_id, 2) as bigint) % 5 when 0 then 'passages' when 1 then 'search_facts' when 2 then 'paths' when 3 then 'fact_diffs' else 'structured_facts' end as channel,
 cast(substr(claim_id, 2) as bigint) as position, cast(substr(claim_id, 2) as bigint) % 40 + 1 as cost, case cast(substr(subject_id, 2) as bigint) % 3 when 0 then 'graph_first' when 1 then 'joint' else 'vector_first' end as mode from v_claims),
o as (select *, case mode when 'graph_first' then case channel when 'structured_facts' then 0 when 'fact_diffs' then 1 when 'paths' then 2 when 'search_facts' then 3 else 4 end
 when 'joint' then case channel when 'passages' then 0 when 'structured_facts' then 1 when 'search_facts' then 2 when 'fact_diffs' then 3 else 4 end
 else case channel when 'passages' then 0 when 'search_facts' then 1 when 'structured_facts' then 2 when 'fact_diffs' then 3 else 4 end end as imp from i),
r as (select *, sum(cost) over (partition by request_id order by imp, position rows unbounded preceding) as running from o)"""


@query("h15_pack_tokens", f"with {PACK} select request_id, channel, position from r where running <= 200")
def h15(t):
    n = F.expr("cast(substr(claim_id, 2) as bigint)")
    names = F.array(*[F.lit(x) for x in ("passages", "search_facts", "paths", "fact_diffs", "structured_facts")])
    items = t.v_claims.select(F.col("subject_id").alias("request_id"), F.element_at(names, (n % 5 + 1).cast("int")).alias("channel"), n.alias("position"), (n % 40 + 1).alias("cost"))
    modes = F.array(*[F.lit(x) for x in ("graph_first", "joint", "vector_first")])
    budgets = t.v_claims.select(F.col("subject_id").alias("request_id"), F.element_at(modes, (F.expr("cast(substr(subject_id, 2) as bigint)") % 3 + 1).cast("int")).alias("mode")).distinct().withColumn("budget", F.lit(200))
    return search.pack_tokens(items, budgets).select("request_id", "channel", "position")


@query("h14_pack_context", """with i as (select subject_id as request_id, claim_id, cast(substr(claim_id, 2) as bigint) as position, cast(substr(claim_id, 2) as bigint) % 40 + 1 as cost, cast(substr(claim_id, 2) as bigint) % 3 as c from v_claims),
r as (select *, sum(cost) over (partition by request_id order by case c when 0 then 0 when 1 then 1 else 2 end, position rows unbounded preceding) as running, sum(cost) over (partition by request_id) as total from i)
select request_id, bool_or(total > 100) as trimmed, count_if(c = 0 and running <= 100) as n_passages, count_if(c = 1 and running <= 100) as n_facts, count_if(c = 2 and running <= 100) as n_paths from r group by 1 having count_if(running <= 100) > 0""")
def h14_pack(t):
    n = F.expr("cast(substr(claim_id, 2) as bigint)")
    items = t.v_claims.select(F.col("subject_id").alias("request_id"), F.col("claim_id").alias("item_id"), n.alias("position"), (n % 40 + 1).alias("cost"), (n % 3).alias("c"))
    parts = [items.where(F.col("c") == k).drop("c") for k in range(3)]
    requests = t.v_claims.select(F.col("subject_id").alias("request_id")).distinct().withColumns({"mode": F.lit("joint"), "budget": F.lit(100)})
    out = search.pack_context(requests, *parts).where("channels is not null")
    size = lambda c: F.coalesce(F.size(F.col("channels")[c]), F.lit(0)).cast("long")
    return out.select("request_id", "trimmed", F.greatest(size("passages"), F.lit(0)).alias("n_passages"), F.greatest(size("structured_facts"), F.lit(0)).alias("n_facts"), F.greatest(size("paths"), F.lit(0)).alias("n_paths"))


EPISODES = """ep as (select conv_id, conv_id % 3 = 0 as open, concat('u', conv_id % 11) as principal, conv_id % 4 as agent, concat('src', (conv_id % 200) % 20, ':', conv_id % 200) as doc_id, lower(string_agg(text, ' ' order by turn)) as body from conversations group by all),
tk as (select conv_id, unnest(regexp_extract_all(body, '[\\p{L}\\p{N}]+')) as term from ep), ti as (select conv_id, term, count(*) * 0.4 as score from tk where term not in ([stop]) group by 1, 2),
qs as (select item_id, concat('v', item_id % 3 + 1) as viewer_id, case when item_id % 2 = 0 then item_id % 4 end as agent, lower(text) as body from benchmark),
qt as (select distinct item_id, unnest(regexp_extract_all(body, '[\\p{L}\\p{N}]+')) as term from qs),
ok as (select qs.item_id, ep.conv_id from qs join v_viewers v on v.viewer_id = qs.viewer_id join ep on (ep.open or list_contains(v.principals, ep.principal)) and (qs.agent is null or qs.agent = ep.agent) join vis on vis.viewer_id = qs.viewer_id and vis.doc_id = ep.doc_id),
kw as (select qt.item_id, ti.conv_id, sum(ti.score) as score from qt join ti using (term) join ok on ok.item_id = qt.item_id and ok.conv_id = ti.conv_id group by all),
kr as (select *, row_number() over (partition by item_id order by round(score, 9) desc, conv_id) as rank from kw),
vs as (select qs.item_id, ok.conv_id, list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) as sim from qs join ok using (item_id) join embeddings a on a.vec_id = qs.item_id join embeddings b on b.vec_id = ok.conv_id),
vr as (select *, row_number() over (partition by item_id order by round(sim, 9) desc, conv_id) as rank from vs),
fu as (select item_id, conv_id, sum(1.0 / (60 + rank)) as score from (select item_id, conv_id, rank from kr where rank <= 100 union all select item_id, conv_id, rank from vr where rank <= 100) group by all),
rr as (select *, row_number() over (partition by item_id order by round(score, 12) desc, conv_id) as rank from fu)""".replace("[stop]", ", ".join(f"'{w}'" for w in STOP_WORDS))


@query("h16_episode_search", f"with {VIS}, {EPISODES} select item_id, conv_id, cast(rank as bigint) as rank, round(score, 9) as score from rr where rank <= 10")
def h16(t):
    i, c = F.col("item_id"), F.col("conv_id")
    text = search.episode_text(t.conversations.withColumn("role", F.lit(None).cast("string")), 2**31 - 1)
    vectors = t.embeddings.select(F.col("vec_id").alias("conv_id"), "embedding")
    doc = F.concat(F.lit("src"), (c % 200) % 20, F.lit(":"), c % 200)
    episodes = text.join(vectors, "conv_id", "left").select(
        F.format_string("%012d", c).alias("memory_id"), "conv_id", F.lit("active").alias("status"), (c % 4).cast("string").alias("agent_id"), "embedding", F.lit("m").alias("embedding_model"),
        (c % 3 == 0).alias("org_visible"), F.array(F.concat(F.lit("u"), c % 11)).alias("allowed_principals"), F.array(doc).alias("evidence_doc_ids"), F.lit("").alias("objective"), F.col("episode_text").alias("summary"),
    )
    none = F.array().cast("array<string>")
    asked_ = t.benchmark.join(vectors.withColumnRenamed("conv_id", "item_id"), "item_id", "left").select(
        F.concat(F.lit("q"), i).alias("query_id"), F.concat(F.lit("v"), i % 3 + 1).alias("viewer_id"), F.when(i % 2 == 0, (i % 4).cast("string")).alias("agent_id"), "embedding", F.lit("m").alias("embedding_model"),
        none.alias("must"), F.array_distinct(tokens(F.coalesce("text", F.lit("")))).alias("any"), none.alias("no"),
    )
    out = search.episode_search(asked_, episodes, t.v_viewers, visible(t), None, 10, search.episode_index(episodes))
    return out.select(F.expr("cast(substr(query_id, 2) as bigint)").alias("item_id"), F.col("item_id").cast("long").alias("conv_id"), "rank", F.round("score", 9).alias("score"))


@query("h17_supersede_episodes", """with m as (select *, first_value(conv_id) over (partition by conv_id % 7, n_events order by conv_id desc) as newest from v_episodes) select conv_id as memory_id, case when newest <> conv_id then 'superseded' else 'active' end as status, case when newest <> conv_id then newest end as superseded_by from m""")
def h17(t):
    rows = t.v_episodes.select(F.col("conv_id").alias("memory_id"), (F.col("conv_id") % 7).alias("agent_id"), F.col("n_events").alias("procedure_key"), F.lit("u").alias("created_by"), F.lit(0).alias("created_at"))
    return search.supersede_episodes(rows)


@query("h18_export_hits", """select concat('{"doc_id":"', doc_id, '","title":"', title, '","event_time":"', strftime(event_time, '%Y-%m-%dT%H:%M:%SZ'), '"', case when deleted then '' else ',"note":"live"' end, '}') as value from v_documents""")
def h18(t):
    rows = t.v_documents.select("doc_id", "title", "event_time", F.when(F.col("deleted"), "").otherwise("live").alias("note"))
    return search.export_hits(rows, ["note"])


INTENT = """i as (select item_id, case item_id % 8 when 0 then 'who is the owner in March 2023' when 1 then 'what did we think in Q2 2022' when 2 then 'what changed between March 2021 and June 2022' when 3 then 'as of the reorg' when 4 then '' when 5 then 'who is the lead now' when 6 then 'status report 2021' else 'tell me more' end as q, item_id % 8 as k from benchmark)"""


@query("e14_plan_temporal", f"""with {INTENT} select item_id, case k when 0 then 'world' when 1 then 'belief' when 2 then 'world' when 3 then 'world' when 6 then 'world' else 'current' end as axis, case k when 0 then '2023-03-15' when 1 then '2022-05-15' when 2 then '2021-03-15' when 6 then '2021-07-01' end as point,
 case k when 2 then '2022-06-15' end as range_end, case when k = 3 then 'ambiguous' else 'ok' end as status, case k when 0 then 0.9 when 1 then 0.85 when 2 then 0.9 when 3 then 0.3 when 4 then 1.0 when 5 then 0.95 when 6 then 0.9 else 0.8 end as confidence from i""")
def e14(t):
    from factlake.operators.intent import plan_temporal_queries

    texts = ["who is the owner in March 2023", "what did we think in Q2 2022", "what changed between March 2021 and June 2022", "as of the reorg", "", "who is the lead now", "status report 2021", "tell me more"]
    rows = t.benchmark.select("item_id", F.element_at(F.array(*map(F.lit, texts)), (F.col("item_id") % 8 + 1).cast("int")).alias("query"))
    out = plan_temporal_queries(rows, clock())
    return out.select("item_id", "axis", F.date_format("point", "yyyy-MM-dd").alias("point"), F.date_format("range_end", "yyyy-MM-dd").alias("range_end"), "status", "confidence")


@query("e17_passage_clocks", """select point_id, strftime(case when h = 0 then timestamp '1997-01-01' else as_of end, '%Y-%m-%d') as event_to, strftime(believed_as_of, '%Y-%m-%d') as updated_to, case when h = 0 then 'host' when as_of is not null then 'world' when believed_as_of is not null then 'belief' else 'none' end as derived_from
 from (select *, cast(substr(point_id, 2) as bigint) % 7 as h from v_order_points)""")
def e17(t):
    from factlake.operators.intent import passage_clocks

    told = F.when(F.expr("cast(substr(point_id, 2) as bigint) % 7 = 0"), F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"))
    out = passage_clocks(t.v_order_points.withColumn("host_event_to", told))
    return out.select("point_id", F.date_format("event_to", "yyyy-MM-dd").alias("event_to"), F.date_format("updated_to", "yyyy-MM-dd").alias("updated_to"), "derived_from")


@query("e18_day_bounds", "select claim_id, strftime(date_trunc('day', valid_from), '%Y-%m-%d %H:%M:%S') as s, strftime(date_trunc('day', valid_from) + interval 1 day - interval 1 microsecond, '%Y-%m-%d %H:%M:%S') as e from v_claims")
def e18(t):
    s, e = temporal.day_bounds(F.date_format("valid_from", "yyyy-MM-dd"))
    return t.v_claims.select("claim_id", stamp(s).alias("s"), stamp(e).alias("e"))


@query("e13_finer_grain", """with g as (select claim_id, time_grain as a, case length(claim_id) % 3 when 0 then 'month' when 1 then 'Year ' else 'never' end as b from v_claims), r as (select *, case a when 'day' then 0 when 'month' then 1 when 'quarter' then 2 when 'year' then 3 else 4 end as ra, case b when 'month' then 1 when 'Year ' then 3 else 4 end as rb from g)
select claim_id, case when ra <= rb then a else case b when 'month' then 'month' when 'Year ' then 'year' else 'unknown' end end as finer from r""")
def e13(t):
    n = F.length("claim_id") % 3
    b = F.when(n == 0, "month").when(n == 1, "Year ").otherwise("never")
    return t.v_claims.select("claim_id", temporal.finer_grain(F.col("time_grain"), b).alias("finer"))


GOLD = """g as (select item_id as case_id, 5 as k, list_distinct([item_id % 50, (item_id * 3) % 50]) as expected from benchmark), p as (select item_id as case_id, (item_id * r) % 50 as item, r as rank from benchmark cross join range(1, 9) t(r) where item_id % 9 <> 0),
s as (select g.case_id, count(distinct case when p.rank <= k and list_contains(expected, p.item) then p.item end) as found, count_if(p.rank <= k and list_contains(expected, p.item)) as hits, count_if(p.rank <= k) as returned, min(case when list_contains(expected, p.item) then p.rank end) as first, max(len(expected)) as n from g left join p on p.case_id = g.case_id group by 1),
sc as (select case_id, coalesce(returned, 0) = 0 as missing, (found > 0)::int::double as hit, found / n as recall, coalesce(hits / nullif(returned, 0), 0) as precision, coalesce(1.0 / first, 0) as mrr from s)"""


def gold(t):
    i = F.col("item_id")
    g = t.benchmark.select(i.alias("case_id"), F.lit(5).alias("k"), F.array(i % 50, (i * 3) % 50).alias("expected"))
    p = t.benchmark.where("item_id % 9 <> 0").select(i.alias("case_id"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("rank")).withColumn("item_id", (F.col("case_id") * F.col("rank")) % 50)
    return profiles.score_cases(g, p)


@query("m1_m4_score_cases", f"with {GOLD} select case_id, missing, round(hit, 6) as hit, round(recall, 6) as recall, round(precision, 6) as precision, round(mrr, 6) as mrr from sc")
def m14(t):
    return gold(t).select("case_id", "missing", *[F.round(c, 6).alias(c) for c in ("hit", "recall", "precision", "mrr")])


@query("m6_m8_report_and_gate", f"with {GOLD} select count(*) as cases, count_if(missing) as missing, round(avg(hit), 6) as hit, round(avg(recall), 6) as recall, round(avg(precision), 6) as precision, round(avg(mrr), 6) as mrr, avg(hit) >= 1.0 as passed from sc")
def m68(t):
    out = profiles.quality_gate(profiles.score_report(gold(t)))
    return out.select("cases", "missing", *[F.round(c, 6).alias(c) for c in ("hit", "recall", "precision", "mrr")], "passed")


@query("m5_diff_pairs", "with e as (select item_id % 20 as case_id, item_id as old_id, item_id + 1 as new_id from benchmark), p as (select * from e where old_id % 7 <> 0) select e.case_id, bool_and(p.case_id is not null) as all_hit from e left join p on p.case_id = e.case_id and p.old_id = e.old_id and p.new_id = e.new_id group by 1")
def m5(t):
    e = t.benchmark.select((F.col("item_id") % 20).alias("case_id"), F.col("item_id").alias("old_id"), (F.col("item_id") + 1).alias("new_id"))
    return profiles.diff_pairs_hit(e, e.where("old_id % 7 <> 0"))


@query("m7_predictions", "with f as (select conv_id as case_id, role as item_id, min(turn) as p from conversations group by 1, 2) select case_id, item_id, row_number() over (partition by case_id order by p, item_id) as rank from f")
def m7(t):
    return profiles.predictions_from_results(t.conversations.select(F.col("conv_id").alias("case_id"), F.col("role").alias("item_id"), F.col("turn").alias("position")))


@query("l1_profile_from_facts", """with s as (select distinct subject_id from v_claims), d as (select distinct subject_id, concat(predicate, ': ', object_text) as x from v_claims where predicate <> 'definition'), n as (select subject_id, x, row_number() over (partition by subject_id order by x) as k from d),
p as (select subject_id, count(*) as n_desc, string_agg(case when k <= 8 then x end, '; ' order by x) as prose from n group by 1), v as (select subject_id, count(distinct object_text) as n_voc from v_claims where predicate = 'definition' group by 1),
m as (select from_id as subject_id, string_agg(distinct to_id, ',' order by to_id) as team from v_relationships where relationship_type = 'member_of' group by 1)
select s.subject_id, coalesce(n_desc, 0) as n_desc, coalesce(prose, '') as prose, coalesce(n_voc, 0) as n_voc, coalesce(team, '') as team from s left join p using (subject_id) left join v using (subject_id) left join m using (subject_id)""")
def l1(t):
    out = profiles.profile_from_facts(t.v_claims.select("subject_id").distinct(), t.v_claims, t.v_relationships)
    return out.select("subject_id", F.size("descriptions").cast("long").alias("n_desc"), "prose", F.size("vocabulary").cast("long").alias("n_voc"), joined("team_signals").alias("team"))


PASSAGES = """ps as (select concat('p', n % 500) as subject_id, doc_id, event_time, n, doc_id as item_id, n % 4 as mentions, (n % 17) / 17.0 as score from v_documents)"""


def passages(t):
    n = F.col("n")
    return t.v_documents.select(F.concat(F.lit("p"), n % 500).alias("subject_id"), "doc_id", "event_time", F.col("doc_id").alias("item_id"), (n % 4).alias("mentions"), ((n % 17) / 17.0).alias("score"), "n")


@query("l2_ground_citations", "select claim_id, array_to_string(list_filter(list_distinct(evidence_doc_ids), lambda d: list_contains(['src0:0', 'src0:20', 'src0:40', 'src2:2', 'src2:22', 'src4:4', 'src8:8'], d)), ',') as cited from v_claims where list_has_any(evidence_doc_ids, ['src0:0', 'src0:20', 'src0:40', 'src2:2', 'src2:22', 'src4:4', 'src8:8'])")
def l2(t):
    allowed = F.array(*[F.lit(x) for x in ("src0:0", "src0:20", "src0:40", "src2:2", "src2:22", "src4:4", "src8:8")])
    items = F.array(F.struct(F.col("object_text").alias("text"), F.col("evidence_doc_ids").alias("cited")))
    rows = t.v_claims.select("claim_id", profiles.ground_citations(items, allowed).alias("items")).where(F.size("items") > 0)
    return rows.select("claim_id", F.array_join(F.col("items")[0]["cited"], ",").alias("cited"))


@query("l3_staleness", f"with {PASSAGES}, m as (select subject_id, max(event_time) as newest from ps group by 1) select c.claim_id from v_claims c join m using (subject_id) where date_diff('day', c.valid_from, m.newest) > 180")
def l3(t):
    return profiles.staleness(t.v_claims, passages(t)).select("claim_id")


@query("l4_profile_summary", f"with {PASSAGES}, u as (select subject_id, unnest(evidence_doc_ids) as doc_id, valid_from as vt from v_claims union all select subject_id, doc_id, event_time from ps) select subject_id, string_agg(distinct doc_id, ',' order by doc_id) as citations, strftime(min(vt), '%Y-%m-%d %H:%M:%S') as first_at, strftime(max(vt), '%Y-%m-%d %H:%M:%S') as last_at from u group by 1")
def l4(t):
    return profiles.profile_summary(t.v_claims, passages(t)).select("subject_id", joined("citations").alias("citations"), stamp("first_at").alias("first_at"), stamp("last_at").alias("last_at"))


@query("l5_broaden_evidence", f"with {PASSAGES}, sc as (select * from ps where n % 3 = 0), c as (select subject_id from sc group by 1 having count(*) >= 3), b as (select *, true as s from sc union all select *, false from ps where n % 3 <> 0 and subject_id not in (select subject_id from c)), r as (select *, row_number() over (partition by subject_id order by s desc, mentions desc, score desc, item_id) as rank from b) select subject_id, item_id, rank from r where rank <= 12")
def l5(t):
    rows = passages(t)
    return profiles.broaden_evidence(rows.where("n % 3 = 0"), rows.where("n % 3 <> 0")).select("subject_id", "item_id", "rank")


@query("l6_graph_fact_lines", "select from_id as subject_id, relationship_id as id, concat(from_id, ' ', relationship_type, ' ', to_id, ' [', array_to_string(evidence_doc_ids[1:3], ', '), ']') as line from v_relationships union all select subject_id, claim_id, concat(predicate, ': ', object_text, ' [', array_to_string(evidence_doc_ids[1:3], ', '), ']') from v_claims")
def l6(t):
    return profiles.graph_fact_lines(t.v_claims, t.v_relationships).select("subject_id", "id", "line")


CONTEXT = f"""{VIS}, {seen('v_claims', 'claim_id')}, {INTENT}, rq as (select concat('r', item_id) as request_id, concat('v', item_id % 3 + 1) as viewer_id, concat('p', item_id * 7 % 500) as subject_id, k from i),
pts as (select *, case k when 0 then timestamp '2023-03-15' when 2 then timestamp '2022-06-15' when 6 then timestamp '2021-07-01' when 1 then timestamp '2022-05-15' else timestamp '1998-01-01' end as i,
 case k when 0 then 'month' when 2 then 'month' when 6 then 'year' else 'day' end as g, case k when 1 then timestamp '2022-05-15' else timestamp '1998-01-01' end as b, k in (0, 1, 2, 6) as is_point from rq where k <> 3),
{PTS[PTS.index("pb as"):]},
q as (select f.*, pb.request_id, f.confidence * greatest(pow(0.5, greatest(date_diff('second', f.valid_from, timestamp '1998-01-01') / 86400.0, 0) / {HALF}), 0.25) as freshness
 from v_claims f join pb on f.subject_id = pb.subject_id and {AT} join av on av.claim_id = f.claim_id and av.viewer_id = pb.viewer_id),
r as (select request_id, claim_id, row_number() over (partition by request_id order by freshness desc, confidence desc, claim_id desc) as rank from q),
fs as (select request_id, string_agg(claim_id, ',' order by rank) as facts from r where rank <= 20 group by 1)"""


@query("h14_retrieve_context", f"with {CONTEXT} select rq.request_id, case k when 3 then 'ambiguous' else 'ok' end as status, case k when 3 then 'temporal_axis_ambiguous' else '' end as detail, case k when 2 then 'world' else '' end as diff_axis, coalesce(facts, '') as facts from rq left join fs using (request_id)")
def h14(t):
    """All benchmark items as requests of the three modes: the whole answer, of which facts, plan and status have a twin."""
    texts = ["who is the owner in March 2023", "what did we think in Q2 2022", "what changed between March 2021 and June 2022", "as of the reorg", "", "who is the lead now", "status report 2021", "tell me more"]
    i, modes = F.col("item_id"), F.array(*map(F.lit, ("graph_first", "joint", "vector_first")))
    subject = F.struct(F.lit("Person ").alias("type"), F.concat(F.lit("p"), i * 7 % 500).alias("id"))
    vectors = t.embeddings.select(F.col("vec_id").alias("item_id"), "embedding")
    requests = t.benchmark.join(vectors, "item_id", "left").select(
        F.concat(F.lit("r"), i).alias("request_id"), F.concat(F.lit("v"), i % 3 + 1).alias("viewer_id"), F.element_at(modes, (i % 3 + 1).cast("int")).alias("mode"),
        F.element_at(F.array(*map(F.lit, texts)), (i % 8 + 1).cast("int")).alias("query"), F.array(subject, subject).alias("subjects"), "embedding",
    )
    chunks = t.v_chunks.join(t.v_documents.select("doc_id", "title", F.col("rendered_text").alias("text")), "doc_id").drop("embedding_model")
    facts = t.v_claims.select("claim_id", F.lit("").alias("title"), F.concat_ws(": ", "predicate", "object_text").alias("rendered_text"))
    sources = context.Sources(
        t.v_persons, t.v_entities, t.v_claims, t.v_relationships, t.v_documents, t.v_participants, chunks, predicates(t), predicates(t).where("predicate <> 'team'"), visible(t),
        TermIndex.build(chunks, "chunk_id", body="text"), TermIndex.build(facts, "claim_id"), search.passage_index(chunks),
    )
    out = context.retrieve_context(requests, sources, now())
    return out.select("request_id", "status", F.coalesce("detail", F.lit("")).alias("detail"), F.coalesce("diff_axis", F.lit("")).alias("diff_axis"), F.coalesce(F.array_join(F.col("channels")["structured_facts"], ","), F.lit("")).alias("facts"))
