"""Merge chains to their end, cycles, and the keys of open work."""

import json

from factlake.operators import governance
from factlake.operators.reads import person_roots


def roots(spark, merges):
    rows = spark.createDataFrame(list(merges.items()), "canonical_id string, merged_into_id string").repartition(3)
    return {r["canonical_id"]: (r["root_id"], r["in_cycle"]) for r in person_roots(rows).collect()}


def test_a_long_chain(spark):
    merges = {f"p{k:05d}": f"p{k + 1:05d}" for k in range(9_999)} | {"p09999": None}
    assert set(roots(spark, merges).values()) == {("p09999", False)}


def test_cycles_and_unknown_people(spark):
    merges = {"a": "b", "b": "c", "c": "b", "x": "y", "y": "x", "d": "d", "e": "d", "f": "gone", "g": "f", "0": "a", "h": None}
    want = {"a": ("b", True), "b": ("b", True), "c": ("b", True), "x": ("x", True), "y": ("x", True), "0": ("b", True)}
    want |= {"d": ("d", False), "e": ("d", False), "f": ("gone", False), "g": ("gone", False), "h": ("h", False)}
    assert roots(spark, merges) == want
    assert roots(spark, {}) == {}


def test_open_work(spark):
    def job(k, kind, status="pending", ws="w", **payload):
        return (k, ws, kind, status, json.dumps(payload), k)

    slot, edge = {"subject_type": "person", "subject_id": "s", "predicate": "title"}, {"from_type": "person", "from_id": "s", "relationship_type": "r"}
    rows = [
        job(1, "extract_graph", doc_id="d"), job(2, "extract_graph", doc_id="d"), job(3, "embed_chunks", doc_id="d"), job(4, "extract_graph", "done", doc_id="d"), job(5, "extract_graph", ws="v", doc_id="d"), job(6, "extract_graph"), job(7, "extract_graph", doc_id=""),
        job(10, "adjudicate_persons", person_a="a", person_b="b"), job(11, "adjudicate_persons", "running", person_a="b", person_b="a"), job(12, "adjudicate_persons", person_a="a"),
        job(20, "resolve_claim_conflict", **slot), job(21, "resolve_claim_conflict", **slot), job(22, "resolve_claim_conflict", **slot | {"predicate": "team"}), job(23, "resolve_claim_conflict", subject_id="s"),
        job(30, "resolve_relationship_conflict", **edge), job(31, "resolve_relationship_conflict", **edge),
        job(40, "generate_taxonomy_proposals"), job(41, "generate_taxonomy_proposals", x=1), job(42, "aggregate_collaboration_edges"),
        job(50, "refresh_identity_embedding", person_id="p"), job(51, "refresh_identity_embedding", person_id="p"), job(60, "export_bundle", doc_id="d"), job(61, "export_bundle", doc_id="d"),
    ]
    jobs = spark.createDataFrame(rows, "job_id int, workspace_id string, job_type string, status string, payload string, created_at int")
    got = {r["job_id"] for r in governance.open_work(jobs).collect()}
    assert got == {2, 3, 5, 6, 7, 11, 12, 21, 22, 23, 31, 41, 42, 51, 60, 61}
    assert {r["job_id"] for r in governance.open_work(jobs, {"export_bundle": ("doc_id",)}).where("job_type = 'export_bundle'").collect()} == {61}
