import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factlake.functions.identity import normalize_email, valid_principal
from factlake.operators import acl, chunking, feed, governance, people, profiles, search
from factlake.sources import files
from factlake.streaming import feed_streams

ENV = "seq long, source_system string, external_id string, change_kind string, event_time timestamp_ntz, arrived_at timestamp_ntz, org_visible boolean, allowed_principals array<string>, text string"
T0 = datetime(2024, 1, 1)


def event(seq, kind, minute, doc="1", public=False, who=("g1",), text="t"):
    return (seq, "wiki", doc, kind, T0 + timedelta(minutes=minute), T0 + timedelta(minutes=seq), public, list(who), text)


def env(spark, *rows):
    return feed.with_ids(spark.createDataFrame(list(rows), ENV))


def test_old_content_is_stale_and_equal_times_win(spark):
    rows = env(spark, event(1, "create", 5, text="a"), event(2, "update", 3, text="b"), event(3, "update", 5, text="c"), event(4, "delete", 0), event(5, "delete", 1, doc="2"))
    got = feed.apply_documents(rows).collect()
    assert [(r["seq"], r["skipped_stale"], r["deleted"]) for r in got] == [(3, 1, True)]
    assert [tuple(r) for r in feed.feed_errors(rows).collect()] == [(5, "wiki:2", "delete")]
    assert feed.append_versions(rows.limit(0).select("doc_id", "text_hash"), rows).count() == 3


def test_access_clock(spark):
    a, b = ("g1",), ("g2",)
    late = env(spark, event(1, "create", 1, who=a), event(2, "update", 3, who=a), event(3, "permission_change", 2, who=b))
    early = env(spark, event(1, "create", 1, who=a), event(2, "permission_change", 2, who=b), event(3, "update", 3, who=a))
    assert feed.apply_acl(late).first()["allowed_principals"] == ["g2"]
    assert feed.apply_acl(early).first()["allowed_principals"] == ["g1"]
    assert feed.apply_acl(late, strict=True).first()["allowed_principals"] == ["g1"]


def test_envelopes_are_checked(spark):
    rows = env(spark, event(1, "create", 0, who=()), event(2, "delete", 0, who=()), event(3, "create", 0, public=True, who=()), (4, "wiki", "4", "create", datetime(1970, 1, 1), T0, True, [], "x"), (5, "wiki", "5", "create", datetime(2030, 1, 1), T0, True, [], "x"), (6, "wiki", "6", "create", None, T0, True, [], "x"), event(7, "create", 0, who=("bob",)))
    good, bad = feed.validate_envelopes(rows, F.lit("2024-01-02").cast("timestamp_ntz"))
    assert sorted(r["seq"] for r in good.collect()) == [2, 3]
    assert {r["seq"]: r["reason"] for r in bad.collect()} == {1: "private_without_principals", 4: "too_old", 5: "in_future", 6: "no_event_time", 7: "bad_principal"}
    ok = "user:123e4567-e89b-12d3-a456-426614174000"
    assert [r[0] for r in spark.createDataFrame([(ok,), (f" {ok} ",), ("user:1",), ("team:" + ok[5:],)], "p string").select(valid_principal(F.col("p"))).collect()] == [True, True, False, False]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = [event(s, rng.choice(["create", "update", "update", "delete", "permission_change"]), rng.randrange(60), str(rng.randrange(6)), rng.random() < 0.3, rng.choice([("g1",), ("g2",), ("g1", "g2")]), rng.choice("abc")) for s in range(120)]
    data = env(spark, *rows)
    for part in range(3):
        data.where(F.col("seq").between(part * 40, part * 40 + 39)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    kept = []
    query = feed_streams.stream_documents(stream).writeStream.foreachBatch(lambda df, _: kept.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp2")).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for r in sorted(kept, key=lambda r: r["seq"]):
        if r["acl_version"] is not None:
            last[r["doc_id"]] = r
    docs = {r["doc_id"]: r for r in feed.apply_documents(data).collect()}
    lists = {r["doc_id"]: r for r in feed.apply_acl(data).collect()}
    assert set(last) == set(docs) == set(lists)
    for d, r in last.items():
        assert (r["text_hash"], r["deleted"]) == (docs[d]["text_hash"], docs[d]["deleted"])
        assert (r["org_visible"], r["allowed_principals"], r["acl_version"]) == (lists[d]["org_visible"], ",".join(lists[d]["allowed_principals"]), lists[d]["acl_version"])


def test_stream_debounce_and_replays(spark, tmp_path):
    rows = [("a", T0), ("a", T0 + timedelta(seconds=30)), ("a", T0 + timedelta(seconds=200)), ("b", T0 + timedelta(hours=9))]
    spark.createDataFrame(rows, "key string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at timestamp").parquet(str(tmp_path / "in"))
    kept = []
    feed_streams.stream_debounce(stream).writeStream.foreachBatch(lambda df, _: kept.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["key"], r["n"]) for r in kept if r["key"] == "a") == [("a", 1), ("a", 2)]


def test_chunks(spark):
    long = " ".join(f"word{i}" for i in range(2000))
    docs = spark.createDataFrame([("d1", "Title", f"one two\n\nthree\n\n{long}"), ("d2", None, None), ("d3", "T", " \n ")], "doc_id string, title string, rendered_text string")
    rows = chunking.chunk_documents(docs).collect()
    parents, children = ([r for r in rows if r["chunk_role"] == k] for k in ("parent", "child"))
    assert {r["doc_id"] for r in rows} == {"d1"} and [r["chunk_id"] for r in children] == [f"d1#{k}" for k in range(len(children))]
    assert all(chunking.word_tokens(p["text"]) <= chunking.PARENT_MOST for p in parents)
    assert all(chunking.word_tokens(c["text"]) <= chunking.CHILD_MOST + chunking.CHILD_OVERLAP + 1 and c["text"].startswith("Title\n\n") for c in children)
    words = " ".join(p["text"] for p in parents).split()
    assert words == f"one two three {long}".split()
    windows = chunking.extraction_windows(docs.withColumn("rendered_text", F.repeat(F.concat(F.lit("x" * 5000), F.lit("\n\n")), 20)).limit(1)).collect()
    assert len(windows) > 1 and all(len(w["text"]) <= chunking.WINDOW + chunking.WINDOW_OVERLAP for w in windows)


def test_carried_vectors(spark):
    cols = "doc_id string, chunk_id string, chunk_role string, content_hash string, embedding array<float>, embedding_model string"
    old = spark.createDataFrame([("d", "1", "child", "alpha", [1.0], "m"), ("d", "2", "child", "beta", [2.0], "m")], cols)
    new = spark.createDataFrame([("d", "1", "child", "alpha"), ("d", "2", "child", "beta2"), ("d", "3", "child", "alpha")], "doc_id string, chunk_id string, chunk_role string, content_hash string")
    assert sorted(r["chunk_id"] for r in feed.replace_chunks(old, new, "m").where("is_carried").collect()) == ["1", "3"]
    assert feed.replace_chunks(old, new, "other").where("is_carried").count() == 0


def test_fusion_and_packing(spark):
    lists = [spark.createDataFrame([("q", k, r) for k, r in d.items()], "query_id string, item string, rank long") for d in ({"a": 1, "b": 2}, {"b": 1, "c": 2})]
    scores = {r["item"]: r["score"] for r in search.rrf_fuse(lists, "item").collect()}
    swapped = {r["item"]: r["score"] for r in search.rrf_fuse(lists[::-1], "item").collect()}
    assert max(scores, key=scores.get) == "b" and abs(scores["a"] - 1 / 61) < 1e-12 and scores.keys() == swapped.keys()
    items = [("r", c, p, 10) for c in ("passages", "paths", "search_facts") for p in range(5)]
    budgets = spark.createDataFrame([("r", "vector_first", 50)], "request_id string, mode string, budget long")
    kept = search.pack_tokens(spark.createDataFrame(items, "request_id string, channel string, position long, cost long"), budgets).collect()
    assert {r["channel"] for r in kept} == {"passages"} and len(kept) == 5 and all(r["trimmed"] for r in kept)


def test_search_respects_access(spark):
    docs = spark.createDataFrame([("d1", True, [], False), ("d2", False, ["g1"], False)], "doc_id string, org_visible boolean, allowed_principals array<string>, deleted boolean")
    viewers = spark.createDataFrame([("in", ["g1"]), ("out", [])], "viewer_id string, principals array<string>")
    visible = acl.visible_docs(docs, viewers)
    chunks = spark.createDataFrame([("c1", "d1", "child", [0.0, 1.0]), ("c2", "d2", "child", [1.0, 0.0]), ("c3", "d2", "child", [0.0, 0.0])], "chunk_id string, doc_id string, chunk_role string, embedding array<float>")
    queries = spark.createDataFrame([("q1", "in", [1.0, 0.1]), ("q2", "out", [1.0, 0.1])], "query_id string, viewer_id string, embedding array<float>")
    got = {(r["query_id"], r["rank"], r["chunk_id"]) for r in search.vector_candidates(chunks, queries, visible, 1).collect()}
    assert got == {("q1", 1, "c2"), ("q2", 1, "c1")}


def test_people(spark):
    mails = spark.createDataFrame([("Alice.Smith+tag@Gmail.com",), ("alice.smith@googlemail.com",), ("  Bob+news@Example.COM ",), ("nobody",)], "m string")
    assert [r[0] for r in mails.select(normalize_email(F.col("m"))).collect()] == ["alicesmith@gmail.com", "alicesmith@gmail.com", "bob@example.com", "nobody"]
    persons = spark.createDataFrame([("a", "A", None, T0), ("b", "B", None, T0 + timedelta(1)), ("c", "C", None, T0 + timedelta(2))], "canonical_id string, display_name string, merged_into_id string, created_at timestamp_ntz")
    merges = spark.createDataFrame([("b", "a"), ("b", "c")], "a string, b string")
    roots = people.merge_map(merges, persons)
    assert {tuple(r) for r in roots.collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    rows = spark.createDataFrame([("x", "c")], "claim_id string, subject_id string")
    moved = people.repoint(rows, roots, ["subject_id"])
    assert moved.first()["subject_id"] == "a"
    back = people.split_people(moved, spark.createDataFrame([("c",)], "person_id string"), ["subject_id"])
    assert back.first()["subject_id"] == "c"


def test_collaboration(spark):
    docs = spark.createDataFrame([("d", False, False, datetime(2024, 2, 1)), ("gone", True, True, T0)], "doc_id string, org_visible boolean, deleted boolean, event_time timestamp_ntz")
    who = spark.createDataFrame([("d", "a", "cc", "person"), ("d", "a", "author", "person"), ("d", "b", "to", "person"), ("d", "bot", "to", "service"), ("gone", "a", "to", "person"), ("gone", "b", "to", "person")], "doc_id string, person_id string, role string, identity_kind string")
    row = people.collaboration_edges(who, docs, F.lit("2024-02-01").cast("timestamp_ntz")).collect()
    assert len(row) == 1 and abs(row[0]["weight"] - 0.9**0.5) < 1e-12 and row[0]["evidence_doc_ids"] == ["d"]


def test_spend_admission(spark):
    rows = spark.createDataFrame([(1, "w", T0, 60), (2, "w", T0, 50), (3, "w", T0, 40), (4, "w", T0 + timedelta(40), 90)], "entry_id long, workspace_id string, created_at timestamp_ntz, tokens long")
    assert {r["entry_id"]: r["admitted"] for r in governance.spend_admission(rows, 100).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_spend_admission_by_a_plain_loop(spark, monkeypatch):
    """Ranges that fit whole, what is too large for the room left, refunds, and the fold of the rest."""
    import random

    monkeypatch.setattr(governance, "RANGE", 20)
    rng = random.Random(3)
    rows = [(k, f"w{k % 3}", T0 + timedelta(days=k // 40), rng.choice([0, 1, 5, 60, 400, 900]) if k % 3 < 2 else rng.choice([-50, 10, 300])) for k in range(600)]
    used, want = {}, {}
    for entry, workspace, at, tokens in rows:
        key = (workspace, at.strftime("%Y-%m"))
        fits = used.get(key, 0) + tokens <= 4000
        used[key] = used.get(key, 0) + (tokens if fits else 0)
        want[entry] = fits
    df = spark.createDataFrame(rows, "entry_id long, workspace_id string, created_at timestamp_ntz, tokens long").repartition(5)
    assert {r["entry_id"]: r["admitted"] for r in governance.spend_admission(df, 4000).collect()} == want and len(set(want.values())) == 2


def test_passages_by_a_plain_packer(spark):
    """Paragraphs, sentences of one long paragraph and overlaps, packed once more by hand."""
    import random

    rng = random.Random(7)
    texts = ["\n\n".join(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([3, 50, 180, 1500]))) for _ in range(rng.randrange(1, 9))) for _ in range(12)]

    def pieces(text, target, most, overlap):
        units = []
        for part in (p for p in text.split("\n\n") if p):
            w = part.split()
            units += [w] if len(w) <= most else [w[k : k + target] for k in range(0, len(w), target)]
        out, n, held = [], 0, None
        for u in units:
            if held is not None and n + len(u) <= target:
                held.append(" ".join(u))
                n += len(u)
            else:
                tail = " ".join(" ".join(held).split()[-overlap:]) if held and overlap else ""
                held = [tail, " ".join(u)] if tail else [" ".join(u)]
                out.append(held)
                n = len(u) + len(tail.split())
        return ["\n\n".join(p) for p in out]

    docs = spark.createDataFrame([(str(k), None, x) for k, x in enumerate(texts)], "doc_id string, title string, rendered_text string")
    got = {(r["doc_id"], r["chunk_role"], r["chunk_index"]): r["text"] for r in chunking.chunk_documents(docs).collect()}
    want = {}
    for k, x in enumerate(texts):
        n = 0
        for p, parent in enumerate(pieces(x, chunking.PARENT, chunking.PARENT_MOST, 0)):
            want[str(k), "parent", p] = parent
            for child in pieces(parent, chunking.CHILD, chunking.CHILD_MOST, chunking.CHILD_OVERLAP):
                want[str(k), "child", n] = child
                n += 1
    assert got == want
    for r in chunking.extraction_windows(docs).collect():
        assert len(r["text"]) <= chunking.WINDOW + chunking.WINDOW_OVERLAP and r["text"].split()[-1] in texts[int(r["doc_id"])]


def test_profiles(spark):
    raw = spark.createDataFrame([("a", '```json\n{"descriptions": ["x"], "prose": "p"}\n```'), ("b", "no json"), ("c", None)], "subject_id string, reply string")
    got = {r["subject_id"]: (r["descriptions"], r["prose"], r["parsed"]) for r in profiles.parse_profiles(raw).collect()}
    assert got == {"a": (["x"], "p", True), "b": (None, "no json", False), "c": (None, None, False)}
    model = spark.createDataFrame([("a", [], ["v"], ""), ("b", [], [], "told")], "subject_id string, descriptions array<string>, vocabulary array<string>, prose string")
    graph = spark.createDataFrame([("a", ["d"], [], "g"), ("b", [], [], "")], "subject_id string, descriptions array<string>, vocabulary array<string>, prose string")
    assert {r["subject_id"]: (r["source"], r["descriptions"], r["prose"]) for r in profiles.fill_profiles(model, graph).collect()} == {"a": ("model_and_graph", ["d"], "g"), "b": ("prose_only", [], "told")}


def test_files(spark, tmp_path):
    (tmp_path / "onto.json").write_text(json.dumps({"predicates": [{"key": "title", "mutually_exclusive": True, "structured_field_keys": ["job"]}], "relationship_types": [{"key": "member_of"}], "entity_types": ["team"]}))
    found = files.read_registry(spark, str(tmp_path / "onto.json"))
    assert [tuple(r) for r in found["structured_keys"].collect()] == [("job", "title")]
    (tmp_path / "twice.json").write_text(json.dumps({"predicates": [{"key": "x"}, {"key": "x"}]}))
    with pytest.raises(ValueError, match="twice"):
        files.read_registry(spark, str(tmp_path / "twice.json"))
    (tmp_path / "gold.json").write_text(json.dumps({"cases": [{"case_id": "1", "k": 5, "expected_doc_ids": ["a"]}, {"case_id": "2"}]}))
    with pytest.raises(ValueError, match="2"):
        files.read_gold_set(spark, str(tmp_path / "gold.json"))
    (tmp_path / "pred.json").write_text(json.dumps({"predictions": [{"case_id": "1", "doc_ids": ["b", "a"]}]}))
    assert [tuple(r) for r in files.read_predictions(spark, str(tmp_path / "pred.json")).collect()] == [("1", "b", 1), ("1", "a", 2)]
    (tmp_path / "env.json").write_text('{"seq": 1, "source_system": "wiki", "external_id": "1", "change_kind": "create", "event_time": "2024-01-01T00:00:00Z", "participants": [{"role": "to", "external_id": "x"}]}\nnot json\n')
    rows = files.read_envelopes(spark, str(tmp_path / "env.json"))
    assert [r["external_id"] for r in rows.collect()] == ["1", None]
    files.archive_envelopes(rows.where("seq = 1"), str(tmp_path / "archive"))
    assert spark.read.json(str(tmp_path / "archive")).first()["doc_id"] == "wiki:1"
    one, two = (spark.createDataFrame([(w, v)], "workspace_id string, v int") for w, v in (("a", 1), ("b", 2)))
    files.save_tables({"t": one.union(two)}, str(tmp_path / "tables"))
    files.save_tables({"t": two.withColumn("v", F.lit(3))}, str(tmp_path / "tables"))
    assert {tuple(r) for r in files.load_tables(spark, str(tmp_path / "tables"), ["t"])["t"].select("workspace_id", "v").collect()} == {("a", 1), ("b", 3)}


def test_episode_search(spark):
    docs = spark.createDataFrame([("d1", True, [], False), ("d2", False, ["g1"], False), ("d3", True, [], True)], "doc_id string, org_visible boolean, allowed_principals array<string>, deleted boolean")
    viewers = spark.createDataFrame([("v1", ["g1"]), ("v2", ["g2"])], "viewer_id string, principals array<string>")
    rows = [
        # Found by its vector only; by both; by words only, as its vector is another model's.
        ("near", "a", "active", "deploy", "x", [1.0, 0.0], "m", True, [], []),
        ("both", "a", "active", "rotate keys", "x", [0.9, 0.1], "m", True, [], ["d1"]),
        ("word", "b", "active", "keys", "x", [1.0, 0.0], "old", True, [], None),
        # Closed to v2 by its own list and by evidence; deleted evidence closes it to all; not active.
        ("own", "a", "active", "keys", "x", [0.8, 0.2], "m", False, ["g1", "g9"], []),
        ("cited", "b", "active", "keys", "x", [0.7, 0.3], "m", True, [], ["d1", "d2"]),
        ("dead", "a", "active", "keys", "x", [1.0, 0.0], "m", True, [], ["d3"]),
        ("old", "a", "superseded", "keys", "x", [1.0, 0.0], "m", True, [], []),
    ]
    schema = "memory_id string, agent_id string, status string, objective string, summary string, embedding array<double>, embedding_model string, org_visible boolean, allowed_principals array<string>, evidence_doc_ids array<string>"
    episodes = spark.createDataFrame(rows, schema)
    asked = [(q, v, a, [1.0, 0.0], "m", [], ["keys"], []) for q, v, a in (("q1", "v1", None), ("q2", "v2", None), ("q3", "v1", "b"))]
    queries = spark.createDataFrame(asked, "query_id string, viewer_id string, agent_id string, embedding array<double>, embedding_model string, must array<string>, any array<string>, no array<string>")
    visible = acl.visible_docs(docs, viewers)
    got = search.episode_search(queries, episodes, viewers, visible, None).collect()
    found = {q: {r["item_id"]: r["score"] for r in got if r["query_id"] == q} for q in ("q1", "q2", "q3")}
    assert {q: set(x) for q, x in found.items()} == {"q1": {"near", "both", "word", "own", "cited"}, "q2": {"near", "both", "word"}, "q3": {"word", "cited"}}
    assert found["q2"]["near"] == pytest.approx(1 / 61) and found["q2"]["both"] == pytest.approx(1 / 62 + 1 / 61) and found["q2"]["word"] == pytest.approx(1 / 62)
    scores = spark.createDataFrame([("q2", "near", 0.1), ("q2", "both", 0.2), ("q2", "word", 0.9)], "query_id string, item_id string, score double")
    got = search.episode_search(queries.where("query_id = 'q2'"), episodes, viewers, visible, scores, 2).orderBy("rank").collect()
    assert [(r["item_id"], r["reranked"]) for r in got] == [("word", True), ("both", True)]
