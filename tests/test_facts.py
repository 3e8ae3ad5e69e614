from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factlake.operators import acl, ledger, reads

CLAIM = (
    "claim_id string, subject_type string, subject_id string, predicate string, object_text string, valid_from timestamp_ntz, valid_to timestamp_ntz, time_grain string, recorded_at timestamp_ntz, "
    "invalidated_at timestamp_ntz, confidence double, status string, evidence_doc_ids array<string>, created_by string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
EDGE = "relationship_id string, from_type string, from_id string, to_type string, to_id string, relationship_type string, status string, valid_from timestamp_ntz, valid_to timestamp_ntz, time_grain string, recorded_at timestamp_ntz, invalidated_at timestamp_ntz, evidence_doc_ids array<string>"
JAN, JUL = datetime(2026, 1, 1), datetime(2026, 7, 1)


def claim(id_, value, status="active", start=JAN, end=None, confidence=0.9, docs=("d1",), by="extraction", predicate="title", subject="alice"):
    return (id_, "person", subject, predicate, value, start, end, "day", JAN, None, confidence, status, list(docs), by, start, start)


def claims(spark, *rows):
    return spark.createDataFrame(list(rows), CLAIM)


def docs(spark, *rows):
    return spark.createDataFrame([(d, v, p, x, datetime(2026, 1, n + 1), f"title {d}", t) for n, (d, v, p, x, t) in enumerate(rows)], "doc_id string, org_visible boolean, allowed_principals array<string>, deleted boolean, event_time timestamp_ntz, title string, rendered_text string")


def now():
    return F.lit("2026-09-01").cast("timestamp_ntz")


def world(spark):
    d = docs(spark, ("d1", True, [], False, "Alice is Engineer"), ("d2", False, ["g1"], False, "x"), ("d3", True, [], True, "y"))
    viewers = spark.createDataFrame([("in", ["g1"]), ("out", ["g2"])], "viewer_id string, principals array<string>")
    return d, viewers, acl.visible_docs(d, viewers)


def points(spark, *rows):
    return spark.createDataFrame(list(rows), "point_id string, as_of timestamp_ntz, believed_as_of timestamp_ntz, as_of_grain string")


def test_world_time(spark):
    _, viewers, visible = world(spark)
    rows = claims(spark, claim("old", "Engineer", "superseded", JAN, JUL), claim("new", "Staff Engineer", start=JUL))
    at = points(spark, ("mar", datetime(2026, 3, 1), None, "day"), ("aug", datetime(2026, 8, 1), None, "day"), ("now", None, None, None))
    got = reads.claims_for_viewers(rows, None, viewers.where("viewer_id = 'out'"), visible, at, now()).select("point_id", "claim_id").collect()
    assert sorted(map(tuple, got)) == [("aug", "new"), ("mar", "old"), ("now", "new")]


def test_evidence_must_be_seen_whole(spark):
    _, viewers, visible = world(spark)
    rows = claims(spark, claim("open", "a"), claim("mixed", "b", docs=("d1", "d2", "d2")), claim("dead", "c", docs=("d1", "d3")), claim("none", "d", docs=()), claim("lost", "e", docs=("nowhere",)))
    pairs = rows.select("claim_id").crossJoin(viewers.select("viewer_id"))
    got = sorted(map(tuple, acl.seen_by(pairs, rows, visible, "claim_id").select("claim_id", "viewer_id").collect()))
    assert got == [("mixed", "in"), ("open", "in"), ("open", "out")]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["d1", "d2", "d3", "d9"]), max_size=4), min_size=1, max_size=12))
def test_nothing_leaks(spark, cited):
    _, viewers, visible = world(spark)
    rows = claims(spark, *[claim(f"c{i}", "v", docs=d) for i, d in enumerate(cited)])
    pairs = rows.select("claim_id").crossJoin(viewers.select("viewer_id"))
    got = {tuple(r) for r in acl.seen_by(pairs, rows, visible, "claim_id").select("claim_id", "viewer_id").collect()}
    sees = {"in": {"d1", "d2"}, "out": {"d1"}}
    assert got == {(f"c{i}", v) for i, d in enumerate(cited) for v in sees if d and set(d) <= sees[v]}


def test_ground_truth_wins_an_exclusive_slot(spark):
    d, _, _ = world(spark)
    rows = claims(spark, claim("s", "Manager", confidence=1.0, by="structured_field:hr"), claim("x", "Director", start=JUL, confidence=0.99), claim("t", "Blue", predicate="team"), claim("u", "Red", predicate="team"))
    exclusive = spark.createDataFrame([("title",)], "predicate string")
    got = {r["claim_id"]: (r["status"], r["superseded_by"], r["valid_to"]) for r in ledger.close_claim_slots(rows, d, exclusive, now()).collect()}
    assert got == {"s": ("active", None, None), "x": ("superseded", "s", JAN), "t": ("active", None, None), "u": ("active", None, None)}


def test_same_object_collapses(spark):
    d, _, _ = world(spark)
    rows = claims(spark, claim("a", "Engineer", confidence=0.8, docs=("d1",)), claim("b", "Engineer", confidence=0.95, docs=("d2",)))
    got = ledger.collapse_duplicates(rows, d, now()).collect()
    live = [r for r in got if r["status"] == "active"]
    assert len(got) == 2 and len(live) == 1 and live[0]["evidence_doc_ids"] == ["d1", "d2"] and live[0]["confidence"] == 0.95


def test_retraction_and_entities(spark):
    rows = claims(spark, claim("one", "a"), claim("two", "b", docs=("d1", "d4")), claim("private", "c", docs=("d2", "d4")))
    removed = spark.createDataFrame([("d1", False, JUL), ("d2", True, JUL)], "doc_id string, private boolean, event_time timestamp_ntz")
    got = {r["claim_id"]: (r["status"], r["evidence_doc_ids"]) for r in ledger.retract_evidence(rows, removed, "claim_id", now()).collect()}
    assert got == {"one": ("retracted", []), "two": ("active", ["d4"]), "private": ("retracted", ["d4"])}
    entities = spark.createDataFrame([("e1", ["d1"]), ("e2", ["d9"])], "entity_id string, evidence_doc_ids array<string>")
    assert {r[0]: r[1] for r in ledger.strip_entity_evidence(entities, removed).select("entity_id", "evidence_doc_ids").collect()} == {"e1": [], "e2": ["d9"]}


def test_merging_is_idempotent(spark):
    rows = claims(spark, claim("a", "x", "proposed", docs=("d2", "d1"), confidence=0.4))
    more = claims(spark, claim("b", "x", docs=("d3",), by="agent_promote:u"), claim("c", "y"))
    once = ledger.merge_claims(rows, more)
    got = {r["object_text"]: (r["claim_id"], r["status"], r["confidence"], r["created_by"], r["evidence_doc_ids"]) for r in once.collect()}
    assert got == {"x": ("a", "active", 0.9, "agent_promote:u", ["d1", "d2", "d3"]), "y": ("c", "active", 0.9, "extraction", ["d1"])}
    again = ledger.merge_claims(once, more).collect()
    assert {r["object_text"]: (r["claim_id"], r["status"], r["confidence"], r["created_by"], r["evidence_doc_ids"]) for r in again} == got


def test_promotions_and_proposals(spark):
    d, _, visible = world(spark)
    people = spark.createDataFrame([("alice",)], "canonical_id string")
    bound = spark.createDataFrame([("title", "people", "title")], "predicate string, taxonomy_key string, field_key string")
    wanted = [("p1", "out", "alice", "title", "Engineer", ["d1"]), ("p2", "out", "alice", "title", "Engineer", ["d2"]), ("p3", "out", "alice", "color", "Engineer", ["d1"]), ("p4", "out", "bob", "title", "Engineer", ["d1"]), ("p5", "out", "alice", "title", "Painter", ["d1"])]
    ok, bad = ledger.promote_claims(spark.createDataFrame(wanted, "promotion_id string, viewer_id string, subject_id string, predicate string, object_text string, evidence_doc_ids array<string>"), bound, people, d, visible, now())
    assert [(r["claim_id"], r["valid_from"]) for r in ok.collect()] == [("p1", datetime(2026, 1, 1))]
    assert {tuple(r) for r in bad.collect()} == {("p2", "evidence_not_visible"), ("p3", "unbound"), ("p4", "unknown_subject"), ("p5", "unsupported")}
    proposals = spark.createDataFrame([("q1", "pending"), ("q2", "applied")], "proposal_id string, status string")
    told = spark.createDataFrame([("q1", "apply", "u"), ("q2", "apply", "u"), ("q3", "reject", "u")], "proposal_id string, decision string, decided_by string")
    assert {r["proposal_id"]: r["outcome"] for r in ledger.decide_proposals(proposals, told).collect()} == {"q1": "applied", "q2": "not_pending", "q3": "not_found"}


def edge(id_, a, b, kind="member_of", docs=("d1",)):
    return (id_, "person", a, "person", b, kind, "active", JAN, None, "day", JAN, None, list(docs))


def test_paths(spark):
    _, viewers, visible = world(spark)
    rels = spark.createDataFrame([edge("r1", "a", "team"), edge("r2", "a", "b"), edge("r3", "b", "c"), edge("r4", "c", "a"), edge("r5", "a", "hidden", docs=("d2",))], EDGE)
    starts = spark.createDataFrame([("person", "a")], "node_type string, node_id string")
    got = reads.walk_paths(rels, starts, viewers, visible, points(spark, ("now", None, None, None)), now())
    assert sorted((r["viewer_id"], r["edges"]) for r in got.collect()) == [("in", ["r1"]), ("in", ["r2"]), ("in", ["r2", "r3"]), ("in", ["r5"]), ("out", ["r1"]), ("out", ["r2"]), ("out", ["r2", "r3"])]
    cut = reads.walk_paths(rels, starts, viewers, visible, points(spark, ("now", None, None, None)), now(), 3, 1).where("viewer_id = 'out'").collect()
    assert [(r["edges"], r["truncated"]) for r in cut] == [(["r1"], True)]


def test_diff(spark):
    old = claims(spark, claim("k", "same"), claim("o", "Engineer"), claim("t1", "Blue", predicate="team"))
    new = claims(spark, claim("k", "same"), claim("n", "Manager"), claim("t2", "Red", predicate="team"))
    got = reads.diff_snapshots(old, new, ["subject_id"], spark.createDataFrame([("title",)], "predicate string"))
    assert {(r["kind"], r["old_id"], r["new_id"]) for r in got.collect()} == {("unchanged", "k", "k"), ("changed", "o", "n"), ("removed", "t1", None), ("added", None, "t2")}


def test_extractions(spark):
    d, _, _ = world(spark)
    from factlake.operators.ledger import PARSED

    text = "Alice Adams is ENGINEER of the Blue team. Blue is a group of painters. Alice joined Blue last month."
    alice, blue = ("person", "Alice Adams"), ("team", "Blue")
    none = (None,) * 4
    entities = [("Team", "Blue", "painters all", "Blue is a  group of painters"), ("person", "Alice Adams", "", "Alice Adams is engineer"), ("planet", "Mars", "", "Alice Adams is engineer"), ("team", "Red", "", "never said so"), ("glossary", "Painter", "a person who paints", "group of painters")]
    edges = [(alice, blue, "member_of", "0.9", "Alice joined Blue last month", None, None, "last month", None), (blue, alice, "member_of", "0.9", "Alice joined Blue", *none), (("person", "Nobody"), blue, "member_of", "0.9", "Alice joined Blue", *none), (alice, blue, "orbits", "0.5", "Alice joined Blue", *none)]
    facts = [(alice, "title", "Engineer", "0.9", "alice adams is  ENGINEER", *none), (alice, "mood", "x", "0.9", "Alice Adams is engineer", *none), (blue, "title", "x", "1", "Alice Adams is engineer", *none), (alice, "title", "y", "high", "Alice Adams is engineer", *none), (alice, "title", "z", "0.7", "never said so", *none), (alice, "title", "w", "0.3", "Alice Adams is engineer", "2026-02-01", "2026-01-01", None, None)]
    parsed = spark.createDataFrame([("d1", 0, text, entities, edges, facts)], PARSED)
    predicates = spark.createDataFrame([("title", ["person"]), ("definition", ["glossary"])], "predicate string, subject_types array<string>")
    kinds = spark.createDataFrame([("member_of", ["person"], ["team"])], "relationship_type string, from_types array<string>, to_types array<string>")
    types = spark.createDataFrame([("team",), ("glossary",)], "key string")
    people = spark.createDataFrame([("alice", "alice  adams", None)], "canonical_id string, display_name string, merged_into_id string")
    known = spark.createDataFrame([("e1", "team", "blue", "", ["d4"])], "entity_id string, entity_type string, name string, description string, evidence_doc_ids array<string>")
    out = ledger.apply_extractions(parsed, d, predicates, kinds, types, people, known)
    assert {(r["entity_type"], r["name"], r["description"], tuple(r["evidence_doc_ids"])) for r in out["entities"].collect()} == {("team", "blue", "painters all", ("d1", "d4")), ("glossary", "Painter", "a person who paints", ("d1",))}
    assert {(r["predicate"], r["object_text"], r["status"], r["created_by"]) for r in out["claims"].collect()} == {("title", "Engineer", "active", "extraction"), ("mood", "x", "proposed", "extraction:untyped"), ("definition", "a person who paints", "active", "extraction:glossary_seed")}
    rel = out["relationships"].collect()
    assert [(r["from_id"], r["to_id"], r["status"], r["time_grain"]) for r in rel] == [("alice", "e1", "active", "month")]
    counts = out["counters"].collect()[0].asDict()
    assert counts == {"doc_id": "d1", "entities": 2, "relationships": 1, "claims": 3, "active_facts": 3, "proposed_facts": 1, "dropped_untyped": 5, "dropped_unverifiable": 3, "skipped_mentions": 2, "malformed": 1}


def test_merging_keeps_whole_rows(spark):
    quoted = "array<struct<doc_id:string,quote:string,note:string>>"

    def rows(*told):
        columns = "claim_id string, subject_type string, subject_id string, predicate string, object_text string, status string, confidence double, created_by string, evidence_doc_ids array<string>, evidence_quotes " + quoted + ", valid_from timestamp_ntz, valid_to timestamp_ntz, time_grain string, invalidated_at timestamp_ntz, created_at timestamp_ntz"
        return spark.createDataFrame([(i, "person", "p", "title", o, s, 0.5, by, docs, q, f, t, g, inv, JAN) for i, o, s, by, docs, q, f, t, g, inv in told], columns)

    old = rows(("a", "x", "retracted", "extraction", ["d1"], [("d1", "q1", "old")], None, JAN, "year", JUL), ("s", "x", "superseded", "extraction", ["d9"], [], None, None, None, JAN), ("k", "y", "active", "extraction", ["d1"], [], JAN, None, "day", None))
    new = rows(("b", "x", "proposed", "extraction", ["d2"], [("d1", "q1", "new"), ("d2", "q2", "n")], JUL, JUL, "month", None), ("c", "z", "proposed", "extraction", ["d3"], [], None, None, "day", None), ("d", "z", "active", "structured_field:t", ["d4"], [("d4", "q4", "z")], JUL, None, "unknown", None))
    for seed in range(2):
        got = {r["claim_id"]: r for r in ledger.merge_claims(old, new.orderBy(F.rand(seed))).collect()}
        assert set(got) == {"a", "s", "k", "c"} and got["s"]["evidence_doc_ids"] == ["d9"] and got["k"]["status"] == "active"
        a, c = got["a"], got["c"]
        assert (a["status"], a["invalidated_at"], a["valid_from"], a["valid_to"], a["time_grain"]) == ("proposed", None, JUL, JAN, "month")
        assert [tuple(q) for q in a["evidence_quotes"]] == [("d1", "q1", "new"), ("d2", "q2", "n")]
        assert (c["status"], c["created_by"], c["evidence_doc_ids"], c["valid_from"], c["time_grain"]) == ("active", "structured_field:t", ["d3", "d4"], JUL, "day")
