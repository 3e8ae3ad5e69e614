"""What plans pass on: joins and generators whose output must not grow with the square of a group."""

import pytest
from pyspark.sql import functions as F

from factlake.operators import acl, intervals, ledger, reads, search, store
from factlake.operators.term_index import TermIndex
from factlake.plans import feed, registry
from factlake.plans.views import Tables

registry.load()


def most_joined(df):
    """Rows of ``df``, and those of the join or generator that gives the most."""
    rows = df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(plan.plan())
        else:
            if "Join" in name or name == "GenerateExec":
                most = max(most, plan.metrics().apply("numOutputRows").value())
            todo += [plan.children().apply(k) for k in range(plan.children().size())]
    return rows, most


def test_mentions_of_one_name(spark):
    people = spark.createDataFrame([("a", "Ann Lee", None), ("b", "Same", None), ("c", "same ", None), ("d", "Ann Lee", "a")], "canonical_id string, display_name string, merged_into_id string")
    things = [("e1", "team", "Red"), ("e2", "team", "Blue"), ("e3", "project", "Blue"), ("e4", None, "Lone"), ("e4", None, "lone"), ("e2", "team", "BLUE")] + [(f"x{k}", "team", "Hot") for k in range(300)]
    entities = spark.createDataFrame(things, "entity_id string, entity_type string, name string")
    told = [("1", "ann  lee", None), ("2", "same", None), ("3", "RED", None), ("4", "red", "project"), ("5", "blue", "team"), ("6", "blue", None), ("7", "lone", None), ("8", "lone", "team"), ("9", None, None)]
    mentions = spark.createDataFrame(told + [(f"m{k}", "hot", "team") for k in range(300)], "mention_id string, name string, type string")
    rows, most = most_joined(ledger.resolve_mentions(mentions, people, entities))
    got = {r["mention_id"]: (r["subject_type"], r["subject_id"]) for r in rows}
    none = (None, None)
    assert {k: got[k] for k in "123456789"} == {"1": ("person", "a"), "2": none, "3": ("team", "e1"), "4": none, "5": ("team", "e2"), "6": none, "7": (None, "e4"), "8": none, "9": none}
    assert len(got) == 309 and got["m7"] == none and most <= 1000


def test_searches_are_cut_at_blanks(spark, tmp_path):
    texts = [(1, "x red the fox or blue.\nsky -don't"), (2, "x a b c -d or \"e"), (3, "x\tno")]
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    bodies = [(1, "or blue sky"), (2, "or blue dull sky"), (3, "or blue sky don t"), (4, "red by fox"), (5, "d or"), (6, "d e"), (7, "d")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in bodies], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    t = Tables(spark, str(tmp_path))
    assert {r["query_id"]: r["text"] for r in feed.searches(t).collect()}["q1"] == '"red the fox" or "or" "blue.sky" -".don.t"'
    for name in ("c11_match_terms", "h2_keyword_candidates"):
        got = sorted((r["query_id"], r["doc_id"]) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == [("q1", "src1:1"), ("q1", "src4:4"), ("q2", "src5:5"), ("q2", "src7:7")], name


def test_points_of_many_subjects(spark, monkeypatch):
    """A node is dealt over tasks by what a subject has in it, so points aren't copied for the windows of others."""
    at = F.lit("2000-01-01").cast("timestamp_ntz")
    none = F.lit(None).cast("timestamp_ntz")
    n = spark.range(2000)
    facts = n.select("id", F.concat(F.lit("s"), F.col("id") % 200).alias("subject_id"), at.alias("valid_from"), none.alias("valid_to"), F.lit("day").alias("time_grain"), at.alias("recorded_at"), none.alias("invalidated_at"), F.lit("active").alias("status"))
    points = n.select(F.col("id").alias("point_id"), F.concat(F.lit("s"), F.col("id") % 200).alias("subject_id"), at.alias("as_of"), none.alias("believed_as_of"), F.lit("day").alias("as_of_grain"))
    monkeypatch.setattr(intervals, "ROWS", 20)
    rows, most = most_joined(reads.at_points(facts, points, at, ["subject_id"]).select("id", "point_id"))
    # Each of 2000 points with the 10 facts of its subject; a point is in 18 nodes.
    assert len(rows) == len(set(rows)) == 20_000 and most <= 40_000


def test_alike_queries_are_searched_once(spark, monkeypatch):
    rows = [("1", "v", "a", ["x"]), ("2", "v", "a", ["x"]), ("3", "w", "a", ["x"]), ("4", None, None, []), ("5", None, None, [])]
    queries = spark.createDataFrame(rows, "query_id string, viewer_id string, text string, must array<string>")
    asked, same = search.alike(queries, ["viewer_id", "text", "must"])
    of = {r["query_id"]: (r["viewer_id"], r["text"], r["must"]) for r in asked.collect()}
    assert len(of) == 3 and {r["query_id"]: of[r["like"]] for r in same.collect()} == {r[0]: r[1:] for r in rows}

    class Stop(Exception):
        pass

    def top(index, queries, *rest):
        raise Stop(queries.count())

    monkeypatch.setattr(TermIndex, "top", top)
    with pytest.raises(Stop) as told:
        registry.QUERIES["h12_hybrid_search"](spark, "/root/testdata/sf0.01")
    assert told.value.args[0] <= 9  # three texts of three viewers, however many vectors


def test_only_terms_asked_for_are_counted(spark):
    claims = spark.createDataFrame([("c1", "title", "urgent urgent"), ("c2", "title", "low")], "claim_id string, predicate string, object_text string")
    rels = spark.createDataFrame([("r1", "title", "urgent", "x")], "relationship_id string, from_id string, relationship_type string, to_id string")
    queries = spark.createDataFrame([("q", ["title", "urgent"], [], [])], "query_id string, must array<string>, any array<string>, no array<string>")
    found = search.keyword_candidates(search.fact_terms(claims, rels), queries, "fact_id")
    assert [(r["fact_id"], r["score"], r["rank"]) for r in found.collect()] == [("c1", 3.0, 1), ("r1", 2.0, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [fact_id#") < plan.index("Join LeftSemi")


def test_evidence_is_dealt_over_more_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([("d1", True, []), ("d2", False, ["g"])], "doc_id string, org_visible boolean, allowed_principals array<string>").withColumn("deleted", F.lit(False))
    viewers = spark.createDataFrame([("in", ["g"]), ("out", ["h"])], "viewer_id string, principals array<string>")
    rows = spark.range(400).select("id", F.array(F.lit("d2"), F.lit("d1"), F.lit("d9")).alias("evidence_doc_ids")).crossJoin(viewers.select("viewer_id"))
    few = acl.visible_evidence(rows, acl.visible_docs(docs, viewers), "id")
    monkeypatch.setattr(acl, "TASK_ROWS", 20)
    many = acl.visible_evidence(rows, acl.visible_docs(docs, viewers), "id")
    got, want = ({(r["id"], r["viewer_id"], tuple(r["visible_doc_ids"])) for r in df.collect()} for df in (many, few))
    assert got == want == {(i, v, e) for i in range(400) for v, e in (("in", ("d2", "d1")), ("out", ("d1",)))}
    assert many.rdd.getNumPartitions() == 40


def test_facts_of_the_same_evidence_are_judged_once(spark):
    """Rows that carry their evidence are read once and not grouped by fact; points cost them comparisons only."""
    at = F.lit("2000-01-01").cast("timestamp_ntz")
    none = F.lit(None).cast("timestamp_ntz")
    docs = spark.createDataFrame([("d1", True, []), ("d2", False, ["g"]), ("d2", False, ["g"])], "doc_id string, org_visible boolean, allowed_principals array<string>").withColumn("deleted", F.lit(False))
    viewers = spark.createDataFrame([("in", ["g"]), ("out", ["h"])], "viewer_id string, principals array<string>")
    cited = F.element_at(F.expr("array(array('d1'), array('d2', 'd1', 'd2'), array('d1', 'd9'), array(), cast(null as array<string>), array('d2', null))"), (F.col("id") % 6 + 1).cast("int"))
    facts = spark.range(600).select("id", cited.alias("evidence_doc_ids"), at.alias("valid_from"), none.alias("valid_to"), F.lit("day").alias("time_grain"), at.alias("recorded_at"), none.alias("invalidated_at"), F.lit("active").alias("status"))
    visible = acl.visible_docs(docs, viewers)
    points = spark.createDataFrame([("now", None, None, None)], "point_id string, as_of timestamp_ntz, believed_as_of timestamp_ntz, as_of_grain string")
    found = acl.for_viewers(facts, visible, "id", viewers, reads.at_points(facts, points, at))
    want = {(i, v) for i in range(600) for v in ("in", "out") if i % 6 == 0 or (i % 6 == 1 and v == "in")}
    assert sorted((r["id"], r["viewer_id"]) for r in found.collect()) == sorted(want)
    pairs = facts.join(viewers.select("viewer_id"), how="cross")
    assert sorted((r["id"], r["viewer_id"]) for r in acl.seen_by(pairs, facts, visible, "id").collect()) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 600") == 1 and "Aggregate [id#" not in plan
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("date_trunc" in line for line in joins)


def test_terms_of_facts_are_grouped_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(search, "FACT_ROWS", 100)
    claims = store.save(spark.range(1000).selectExpr("concat('c', id) as claim_id", "if(id % 2 = 0, 'title', 'team') as predicate", "if(id % 3 = 0, 'urgent title', 'low') as object_text"))
    claims = claims.unionByName(spark.createDataFrame([("c2", "team", "urgent")], claims.schema))  # a fact in two rows
    rels = spark.createDataFrame([], "relationship_id string, from_id string, relationship_type string, to_id string")
    queries = spark.createDataFrame([("q", ["title", "urgent"], [], [])], "query_id string, must array<string>, any array<string>, no array<string>")
    index = search.fact_terms(claims, rels)
    assert index.rdd.getNumPartitions() == 11
    found = search.match_terms(index, queries, "fact_id")
    assert {(r.fact_id, r.score) for r in found.collect()} == {(f"c{k}", 3.0 if k % 2 == 0 else 2.0) for k in range(0, 1000, 3)} | {("c2", 2.0)}


def shuffled(df):
    """Rows of ``df``, and how many its plan shuffles."""
    rows = df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(plan.plan())
        else:
            if name == "ShuffleExchangeExec":
                n += plan.metrics().apply("shuffleRecordsWritten").value()
            todo += [plan.children().apply(k) for k in range(plan.children().size())]
    return rows, n


def test_cards_of_persons_without_facts_are_not_shuffled(spark):
    """Only persons that facts name meet the facts; the others' rows, points times viewers each, are made where they are."""
    people = [("a", None), ("b", "a"), ("c", None), ("d", "gone")] + [(f"x{k}", None) for k in range(300)]
    persons = spark.createDataFrame([(i, f"Name {i}", m) for i, m in people], "canonical_id string, display_name string, merged_into_id string")
    stamps = [f"cast(null as timestamp_ntz) {c}" for c in ("valid_from", "valid_to", "invalidated_at")] + ["timestamp_ntz'2000-01-01' recorded_at", "'day' time_grain", "'active' status"]
    said = [("c2", "a", ["d1"]), ("c1", "a", ["d1", "d1"]), ("c1", "a", ["d1"]), ("c3", "c", ["d2"]), ("c4", "nobody", ["d1"]), ("c5", "a", None), ("c6", "a", []), ("c7", None, ["d1"])]
    claims = spark.createDataFrame(said, "claim_id string, subject_id string, evidence_doc_ids array<string>").selectExpr("*", "'p' predicate", "'v' object_text", *stamps)
    tied = [("r1", "a", "c", "person", ["d1"]), ("r2", "c", "c", "person", ["d1"]), ("r3", "a", "c", "team", ["d2"]), ("r4", "d", "a", "person", ["d3"])]
    rels = spark.createDataFrame(tied, "relationship_id string, from_id string, to_id string, to_type string, evidence_doc_ids array<string>").selectExpr("*", "'person' from_type", "'t' relationship_type", *stamps)
    docs = spark.createDataFrame([("d1", True, [], False), ("d2", False, ["g"], False), ("d3", True, [], True)], "doc_id string, org_visible boolean, allowed_principals array<string>, deleted boolean")
    viewers = spark.createDataFrame([("v1", ["g"]), ("v2", ["h"])], "viewer_id string, principals array<string>")
    points = spark.createDataFrame([(f"p{k}", None, None, None) for k in range(3)], "point_id string, as_of timestamp_ntz, believed_as_of timestamp_ntz, as_of_grain string")
    now = F.lit("2001-01-01").cast("timestamp_ntz")
    subjects = persons.select(F.col("canonical_id").alias("subject_id")).unionByName(spark.createDataFrame([("a",), ("lost",)], "subject_id string"))
    rows, n = shuffled(reads.subject_card(subjects, persons, claims, rels, viewers, acl.visible_docs(docs, viewers), points, now))
    got = {}
    for r in rows:
        card = tuple(None if r[c] is None else [x[0] for x in r[c]] for c in ("claims", "edges"))
        got.setdefault((r["subject_id"], r["root_id"], r["display_name"], r["viewer_id"]), []).append(card)
    want = {("a", "v1"): (["c1", "c1", "c2"], ["r1", "r3"]), ("a", "v2"): (["c1", "c1", "c2"], ["r1"]), ("c", "v1"): (["c3"], ["r1", "r2"]), ("c", "v2"): (None, ["r1", "r2"])}
    for (subject, root, name, viewer), cards in got.items():
        assert name == f"Name {root}" and cards == [want.get((root, viewer), (None, None))] * (6 if subject == "a" else 3), subject
    assert {k[:2] for k in got} == {("a", "a"), ("b", "a"), ("c", "c")} | {(f"x{k}", f"x{k}") for k in range(300)} and len(rows) == 2 * 3 * 304
    assert n < len(rows)


def test_points_of_one_subject_are_not_copied_for_times(spark):
    """Facts and points that are alike in a subject meet in blocks: what is shuffled grows with both, not with nodes of time or pairs."""
    day = "timestamp_ntz'2000-01-01' + make_dt_interval(cast(id * 7 % 1500 as int))"
    none = F.lit(None).cast("timestamp_ntz")
    n = spark.range(1200)
    facts = n.selectExpr("id", "concat('s', id % 3) subject_id", f"{day} valid_from", f"if(id % 2 = 0, {day} + interval 90 days, null) valid_to", "'month' time_grain", f"{day} recorded_at").withColumns({"invalidated_at": none, "status": F.lit("active"), "text": F.lit("t")})
    points = n.selectExpr("id point_id", "concat('s', id % 4) subject_id", f"{day} + interval 11 days as_of", "if(id % 5 = 0, 'quarter', 'day') as_of_grain").withColumn("believed_as_of", none)
    at = F.lit("2005-01-01").cast("timestamp_ntz")
    few = {(r["id"], r["point_id"]) for k in range(0, 1200, 200) for r in reads.at_points(facts, points.where(f"point_id div 200 = {k // 200}"), at, ["subject_id"]).collect()}
    found = reads.at_points(facts, points, at, ["subject_id"], ["id", "point_id"])
    rows, sent = shuffled(found)
    assert found.columns == ["id", "point_id"] and len(rows) == len(few) > 50_000 and {tuple(r) for r in rows} == few
    assert sent <= 3 * 2400


def test_the_driver_never_holds_all_channels_of_a_search(spark):
    """Channels are stored one by one, and times are looked up for what was found; so the last plan joins a stored list with few tables."""
    found = registry.QUERIES["h12_hybrid_search"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 40
    assert 0 < found.count() == found.select("query_id", "item_id").distinct().count()


def test_readers_of_facts(spark):
    docs = spark.createDataFrame([("d1", True, [], False), ("d2", False, ["g"], False), ("d3", True, [], True)], "doc_id string, org_visible boolean, allowed_principals array<string>, deleted boolean")
    viewers = spark.createDataFrame([("v1", ["g"]), ("v2", ["h"]), ("v3", ["g"])], "viewer_id string, principals array<string>")
    said = [("a", ["d1"]), ("b", ["d2", "d1"]), ("c", ["d1", "d3"]), ("d", []), ("e", None), ("f", ["d1", "d1"])]
    facts = spark.createDataFrame(said, "id string, evidence_doc_ids array<string>")
    got = acl.with_readers(facts, acl.visible_docs(docs, viewers))
    assert sorted((r["id"], r["viewer_id"] or "") for r in got.collect()) == [("a", ""), ("b", "v1"), ("b", "v3"), ("f", "")]
