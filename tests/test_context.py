"""Whole answers to requests: each channel as the single operators give it, and a loop over scopes."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factlake.operators import context, reads, search
from factlake.operators.acl import Visible, visible_docs
from factlake.operators.term_index import TermIndex

T = "timestamp_ntz"
NOW = datetime(2024, 6, 1)


def day(y, m=1, d=1):
    return datetime(y, m, d)


@pytest.fixture(scope="module")
def world(spark):
    docs = [(f"d{k}", "ws", f"Title {k % 3}", f"alpha beta w{k} " + ("gamma plan " if k % 2 else "delta ") * (k % 4 + 1), day(2020 + k % 5, k % 12 + 1), day(2021 + k % 4, k % 12 + 1), k % 3 == 0, ["u1"] if k % 2 else ["u2"], k == 11) for k in range(24)]
    docs = spark.createDataFrame(docs, f"doc_id string, workspace_id string, title string, rendered_text string, event_time {T}, updated_at {T}, org_visible boolean, allowed_principals array<string>, deleted boolean")
    chunks = docs.withColumn("part", F.explode(F.array(F.lit("a"), F.lit("b")))).select(F.concat_ws("#", "doc_id", "part").alias("chunk_id"), "doc_id", F.lit("child").alias("chunk_role"), F.col("rendered_text").alias("text"), "title")
    h = F.abs(F.xxhash64("chunk_id"))
    chunks = chunks.withColumn("embedding", F.array(*[(h % p / p + 0.01).cast("double") for p in (97, 89, 83)]))
    claims = [(f"c{k}", "person", f"p{k % 4}", ["title", "team"][k % 2], f"value {k % 5}", day(2020 + k % 4), day(2023) if k % 5 == 0 else None, "day", day(2020 + k % 5), day(2024, 2) if k % 7 == 0 else None, 0.5 + k % 5 / 10, "active", [f"d{k % 11}"]) for k in range(60)]
    claims = spark.createDataFrame(claims, f"claim_id string, subject_type string, subject_id string, predicate string, object_text string, valid_from {T}, valid_to {T}, time_grain string, recorded_at {T}, invalidated_at {T}, confidence double, status string, evidence_doc_ids array<string>")
    rels = [(f"r{k:02d}", "person", f"p{k % 4}", "person", f"p{(k * 3 + 1) % 6}", ["knows", "leads"][k % 2], "active", day(2020 + k % 4), None, "day", day(2020), None, [f"d{k % 9}"]) for k in range(30)]
    rels = spark.createDataFrame(rels, f"relationship_id string, from_type string, from_id string, to_type string, to_id string, relationship_type string, status string, valid_from {T}, valid_to {T}, time_grain string, recorded_at {T}, invalidated_at {T}, evidence_doc_ids array<string>")
    persons = spark.createDataFrame([("p0", "Ann Lee", None), ("p1", "Bob Lee", None), ("p2", "Cid Ray", None), ("p9", "Old Ann", "p0")], "canonical_id string, display_name string, merged_into_id string")
    entities = spark.createDataFrame([("e1", "team", "Red Team")], "entity_id string, entity_type string, name string")
    participants = spark.createDataFrame([(f"d{k}", f"p{k % 5}") for k in range(24)] + [("d0", "p2")], "doc_id string, person_id string")
    predicates = spark.createDataFrame([("title", 180.0), ("team", None)], "predicate string, freshness_half_life_days double")
    viewers = spark.createDataFrame([("v1", ["u1"]), ("v2", ["u2"])], "viewer_id string, principals array<string>")
    facts = claims.select("claim_id", F.lit("").alias("title"), F.concat_ws(": ", "predicate", "object_text").alias("rendered_text"))
    sources = context.Sources(persons, entities, claims, rels, docs, participants, chunks, predicates, predicates.where("predicate = 'title'").select("predicate"), visible_docs(docs, viewers), TermIndex.build(chunks, "chunk_id", body="text"), TermIndex.build(facts, "claim_id"), search.passage_index(chunks))
    return sources, viewers


P = [{"type": "Person", "id": " p0 "}]
V = [0.3, 0.5, 0.2]
REQUESTS = {
    "mode": ("v1", "fast", "alpha", None, None, None, None, None, None),
    "alone": ("v1", "graph_first", "alpha", None, None, None, None, None, None),
    "lee": ("v1", "joint", "alpha", None, "lee", None, None, None, None),
    "soft": ("v1", "joint", "as of the reorg", P, None, None, None, None, None),
    "plain": ("v1", "vector_first", "gamma plan", None, None, None, None, V, None),
    "graph": ("v2", "graph_first", "value delta", P + P, "bob lee", day(2022, 6), None, V, None),
    "belief": ("v1", "joint", "what did we believe in 2022 title", P, None, None, None, V, None),
    "diff": ("v2", "joint", "what changed between March 2021 and June 2023", P, None, None, None, None, None),
    "team": ("v1", "vector_first", "value beta", None, "red team", None, day(2023), V, None),
    "unknown": ("v2", "vector_first", "value", None, "zzz", None, None, V, 6),
    "tight": ("v1", "graph_first", "alpha value", P, None, None, None, V, 25),
}


def answers(spark, sources, limits=None):
    rows = [(k, v[0], v[1], v[2], v[3], v[4], v[5], v[6], v[7], v[8]) for k, v in REQUESTS.items()]
    schema = f"request_id string, viewer_id string, mode string, query string, subjects array<struct<type:string,id:string>>, about string, as_of {T}, believed_as_of {T}, embedding array<double>, budget long"
    out = context.retrieve_context(spark.createDataFrame(rows, schema), sources, F.lit(NOW).cast(T), limits).collect()
    return {r["request_id"]: r for r in out}


def test_plans_and_channels(spark, world):
    sources, viewers = world
    now = F.lit(NOW).cast(T)
    got = answers(spark, sources, context.Limits(5, 4, 2, 6))
    assert {k: (r["status"], r["detail"]) for k, r in got.items() if r["status"] != "ok"} == {
        "mode": ("invalid", "unknown_mode"), "alone": ("invalid", "graph_first_without_subject"), "lee": ("ambiguous", "subject_ambiguous"), "soft": ("ambiguous", "temporal_axis_ambiguous"),
    }
    assert all(got[k]["channels"] is None for k in ("mode", "alone", "lee", "soft"))
    assert [tuple(s) for s in got["graph"]["subjects"]] == [("person", "p0"), ("person", "p1")] and [tuple(s) for s in got["team"]["subjects"]] == [("team", "e1")] and not got["unknown"]["subjects"]
    assert (got["diff"]["diff_axis"], got["diff"]["diff_from"], got["diff"]["derived_from"]) == ("world", got["diff"]["event_from"], "as_of_range") and got["diff"]["as_of"] == got["diff"]["diff_to"] == got["diff"]["event_to"]
    assert (got["belief"]["as_of"], got["belief"]["derived_from"], got["belief"]["updated_to"]) == (None, "believed_as_of", got["belief"]["believed_as_of"]) and got["belief"]["believed_as_of"] is not None
    assert (got["graph"]["event_to"], got["graph"]["derived_from"], got["plain"]["derived_from"]) == (day(2022, 6), "as_of", None)
    allowed = {(r["viewer_id"], r["doc_id"]) for r in sources.visible.pairs(viewers).collect()}
    documents = {r["doc_id"]: r for r in sources.documents.collect()}
    taking_part = {(r["doc_id"], r["person_id"]) for r in sources.participants.collect()}
    for k, r in got.items():
        if k not in ("plain", "graph", "diff", "tight"):
            continue
        own = lambda c, r=r: list((r["channels"] or {}).get(c, []))
        viewer = viewers.where(F.col("viewer_id") == REQUESTS[k][0])
        subjects = [tuple(s) for s in r["subjects"]]
        point = lambda a, b, r=r: spark.createDataFrame([("x", a, b, r["as_of_grain"])], f"point_id string, as_of {T}, believed_as_of {T}, as_of_grain string")
        at = point(r["as_of"], r["believed_as_of"])
        facts, walks, diffs = [], [], []
        for kind, s in sorted(subjects):
            ids = spark.createDataFrame([(s,)], "subject_id string")
            if kind == "person":
                rows = reads.query_facts(sources.claims, ids, viewer, sources.visible, at, sources.predicates, now, 4).orderBy("rank").collect()
                facts += [x["claim_id"] for x in rows]
            start = spark.createDataFrame([(kind, s)], "node_type string, node_id string")
            walks += [">".join(x["edges"]) for x in reads.walk_paths(sources.relationships, start, viewer, sources.visible, at, now, 2, 6).orderBy("rank").collect()]
            if r["diff_axis"]:
                ends = [reads.claims_for_viewers(sources.claims, ids, viewer, sources.visible, point(e, None), now) for e in (r["diff_from"], r["diff_to"])]
                rows = reads.diff_snapshots(*ends, ["subject_id"], sources.exclusive).collect()
                diffs += sorted(":".join(v for v in (x["kind"], x["predicate"], x["old_id"], x["new_id"]) if v is not None) for x in rows)
        people = {s for kind, s in subjects if kind == "person"}
        reach = {d for v, d in allowed if v == REQUESTS[k][0]}
        reach = {d for d in reach if not people or any((d, p) in taking_part for p in people)}
        for c, low, high in (("event_time", "event_from", "event_to"), ("updated_at", "updated_from", "updated_to")):
            reach = {d for d in reach if (r[low] is None or documents[d][c] >= r[low]) and (r[high] is None or documents[d][c] <= r[high])}
        mine = sources.chunks.where(F.col("doc_id").isin(*reach))
        asked = spark.createDataFrame([("q", REQUESTS[k][2], REQUESTS[k][7])], "query_id string, text string, embedding array<double>")
        lists = [search.vector_candidates(mine, asked.where("embedding is not null").drop("text"), None).select("query_id", F.concat(F.lit("chunk:"), "chunk_id").alias("item_id"), "rank")]
        lists.append(sources.passages.top(asked, 100, asked.select("query_id", F.lit("").alias("key")), mine.select(F.col("chunk_id").alias("key"))).select("query_id", F.concat(F.lit("chunk:"), "key").alias("item_id"), "rank"))
        seen = reads.claims_for_viewers(sources.claims, None, viewer, sources.visible, at, now)
        lists.append(sources.facts.top(asked, 100, public=seen.select(F.col("claim_id").alias("key")), allowed=asked.select("query_id", F.lit("").alias("key"))).select("query_id", F.concat(F.lit("fact:"), "key").alias("item_id"), "rank"))
        times = mine.join(sources.documents.select("doc_id", "event_time"), "doc_id").select(F.concat(F.lit("chunk:"), "chunk_id").alias("item_id"), F.lit("passage").alias("kind"), F.col("event_time").alias("at"), F.col("doc_id").alias("parent_id"))
        times = times.unionByName(sources.claims.select(F.concat(F.lit("fact:"), "claim_id").alias("item_id"), F.lit("fact").alias("kind"), F.col("valid_from").alias("at"), F.lit(None).cast("string").alias("parent_id")))
        none = spark.createDataFrame([], "query_id string, item_id string, score double")
        found = search.dedupe_parents(search.apply_rerank(search.decayed_shortlist(search.rrf_fuse(lists, "item_id"), times, now), none, 5)).orderBy("rank").collect()
        want = {"structured_facts": facts, "paths": walks, "fact_diffs": diffs, "passages": [x["item_id"][6:] for x in found if x["item_id"].startswith("chunk:")], "search_facts": [x["item_id"][5:] for x in found if x["item_id"].startswith("fact:")]}
        if REQUESTS[k][8] is None:
            assert {c: own(c) for c in want} == want and not r["trimmed"], k
        else:
            assert r["trimmed"] and all(own(c) == want[c][: len(own(c))] for c in want), k
    assert got["belief"]["channels"]["structured_facts"] and not got["team"]["channels"].get("structured_facts") and got["team"]["channels"]["passages"]
    assert got["unknown"]["trimmed"] and sum(map(len, got["unknown"]["channels"].values())) < 6
    assert got["tight"]["channels"]["structured_facts"] and not (got["tight"]["channels"].get("passages") or [])
    assert got["plain"]["channels"]["passages"] and got["diff"]["channels"]["fact_diffs"] and got["graph"]["channels"]["paths"]


def test_capped_and_empty(spark, world):
    sources, _ = world
    empty = spark.createDataFrame([], "request_id string, viewer_id string, mode string, query string")
    assert context.retrieve_context(empty, sources, F.lit(NOW).cast(T)).isEmpty()
    rels, start = sources.relationships, spark.createDataFrame([("person", "p0")], "node_type string, node_id string")
    viewers, points = world[1], spark.createDataFrame([("x", None, None, None)], f"point_id string, as_of {T}, believed_as_of {T}, as_of_grain string")
    public = Visible(sources.documents.select("doc_id"), sources.visible.private.limit(0))
    for depth, limit, capped in ((2, 201, True), (2, 200, False)):
        assert {r["capped"] for r in reads.walk_paths(rels, start, viewers, public, points, F.lit(NOW).cast(T), depth, limit).collect()} == {capped}


def test_answers_are_gathered_from_stored_items(spark, world):
    """What a request gets is worked out once: the answer reads stored items, and no claim again."""
    sources, _ = world
    rows = [(k, *v[:5]) for k, v in REQUESTS.items() if k in ("diff", "tight")]
    requests = spark.createDataFrame(rows, "request_id string, viewer_id string, mode string, query string, subjects array<struct<type:string,id:string>>, about string")
    out = context.retrieve_context(requests, sources, F.lit(NOW).cast(T), context.Limits(5, 4, 2, 6))
    assert "object_text" not in out._jdf.queryExecution().optimizedPlan().toString()
