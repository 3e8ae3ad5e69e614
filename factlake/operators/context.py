"""Whole answers to a table of requests: subjects, time, facts, differences, paths, search and packing in one plan.

Each request takes its own way: its mode, viewer, point in time and subjects are
columns, so one plan serves requests of all modes. A request is its own viewer
and point wherever facts, edges and passages are read, and nothing is paired
with requests that could not be part of their answer.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.ranking import FACT_HALF_LIFE, fact_freshness
from factlake.functions.temporal import believed_as_of, valid_as_of
from factlake.functions.text import count_tokens
from factlake.operators.acl import Visible, seen_by
from factlake.operators.common import first_rows, small
from factlake.operators.intent import plan_temporal_queries
from factlake.operators.reads import at_points, diff_snapshots, resolve_subjects, resolved_points
from factlake.operators.search import DROP_ORDER, POOL, apply_rerank, decayed_shortlist, dedupe_parents, pack_tokens, rrf_fuse, vector_candidates
from factlake.operators.store import save
from factlake.operators.term_index import TermIndex
from factlake.operators.vector_index import VectorIndex

NONE = "timestamp_ntz"
POINT = ["as_of", "believed_as_of", "as_of_grain"]
#: The deepest walk and the most walks of a subject, whatever is asked for.
DEEPEST, MOST_PATHS = 3, 200


@dataclass
class Sources:
    """The tables and indexes that answers are made of."""

    persons: DataFrame
    entities: DataFrame
    claims: DataFrame
    relationships: DataFrame
    documents: DataFrame
    participants: DataFrame
    chunks: DataFrame
    predicates: DataFrame
    exclusive: DataFrame
    visible: Visible
    passages: TermIndex
    facts: TermIndex
    vectors: VectorIndex | None = None
    scores: DataFrame | None = None


@dataclass
class Limits:
    """How much of each kind a request gets."""

    passages: int = 20
    facts: int = 20
    depth: int = 2
    paths: int = 20
    types: list[str] = field(default_factory=list)


def _given(requests: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in requests.columns else F.lit(None).cast(kind)


def plan_requests(requests: DataFrame, persons: DataFrame, entities: DataFrame, now: Column) -> DataFrame:
    """What each of ``requests(request_id, viewer_id, mode, query[, subjects, about, as_of, believed_as_of, as_of_grain, event_from, event_to, updated_from, updated_to, embedding, budget])`` asks for.

    Adds status (ok, ambiguous, invalid) and detail, subjects (named ones and
    the one that ``about`` resolves to, each once), the point in time, the ends
    of a comparison, and the bounds on passages. Points and bounds that the
    request gives win over those that its text implies; an unknown name in
    ``about`` adds no subject.
    """
    subject = "array<struct<type:string,id:string>>"
    named = F.coalesce(F.filter(F.transform(_given(requests, "subjects", subject), lambda s: F.struct(F.lower(F.trim(s["type"])).alias("type"), F.trim(s["id"]).alias("id"))), lambda s: (s["type"] != "") & (s["id"] != "")), F.array().cast(subject))
    rows = requests.select(
        "request_id", "viewer_id", "mode", F.coalesce("query", F.lit("")).alias("query"), named.alias("named"), F.trim(_given(requests, "about", "string")).alias("about"),
        *(_given(requests, c, NONE).alias(f"own_{c}") for c in ("as_of", "believed_as_of", "event_from", "event_to", "updated_from", "updated_to")),
        _given(requests, "as_of_grain", "string").alias("own_grain"), _given(requests, "embedding", "array<double>").alias("embedding"), _given(requests, "budget", "long").alias("budget"),
    )
    names = rows.where("about <> ''").select(F.col("request_id").alias("query_id"), F.col("about").alias("name"))
    found = resolve_subjects(names, persons, entities).select(F.col("query_id").alias("request_id"), F.col("status").alias("about_status"), F.array(F.struct("type", F.col("candidates")[0].alias("id"))).alias("told"))
    rows = rows.join(found, "request_id", "left")
    told = F.when(F.col("about_status") == "resolved", F.col("told")).otherwise(F.array().cast(subject))
    rows = rows.withColumn("subjects", F.array_distinct(F.concat("named", told)))
    rows = plan_temporal_queries(rows, now).withColumnsRenamed({c: f"plan_{c}" for c in ("axis", "point", "range_end", "grain", "status", "confidence", "rationale")})
    planned = F.col("own_as_of").isNull() & F.col("own_believed_as_of").isNull()
    world, belief = planned & (F.col("plan_axis") == "world"), planned & (F.col("plan_axis") == "belief")
    compared = F.col("plan_range_end").isNotNull() & F.col("plan_point").isNotNull()
    target = F.when(compared, F.col("plan_range_end")).otherwise(F.col("plan_point"))
    detail = (
        F.when(~F.coalesce(F.col("mode").isin(*DROP_ORDER), F.lit(False)), "unknown_mode").when(F.col("about_status") == "ambiguous", "subject_ambiguous")
        .when((F.col("mode") == "graph_first") & (F.size("subjects") == 0), "graph_first_without_subject").when(planned & (F.col("plan_status") == "ambiguous"), "temporal_axis_ambiguous")
    )
    rows = rows.withColumns({
        "detail": detail, "as_of": F.when(world, target).otherwise(F.col("own_as_of")), "believed_as_of": F.when(belief, target).otherwise(F.col("own_believed_as_of")),
        "as_of_grain": F.coalesce("own_grain", F.when(world, F.col("plan_grain"))), "diff_axis": F.when(compared & world, "world").when(compared & belief, "belief"),
        "diff_from": F.when(compared & (world | belief), F.col("plan_point")), "diff_to": F.when(compared & (world | belief), F.col("plan_range_end")),
    })
    status = F.when(F.col("detail").isNull(), "ok").when(F.col("detail").isin("unknown_mode", "graph_first_without_subject"), "invalid").otherwise("ambiguous")
    from_world, from_belief = F.col("own_event_from").isNull() & (F.col("diff_axis") == "world"), F.col("own_updated_from").isNull() & (F.col("diff_axis") == "belief")
    to_world, to_belief = F.col("own_event_to").isNull() & F.col("as_of").isNotNull(), F.col("own_updated_to").isNull() & F.col("believed_as_of").isNotNull()
    tags = F.concat_ws("+", F.when(from_world, "as_of_range").when(to_world, "as_of"), F.when(from_belief, "believed_as_of_range").when(to_belief, "believed_as_of"))
    return rows.withColumns({
        "status": status, "event_from": F.when(from_world, F.col("diff_from")).otherwise(F.col("own_event_from")), "event_to": F.coalesce("own_event_to", "as_of"),
        "updated_from": F.when(from_belief, F.col("diff_from")).otherwise(F.col("own_updated_from")), "updated_to": F.coalesce("own_updated_to", "believed_as_of"), "derived_from": F.nullif(tags, F.lit("")),
    }).select("request_id", "viewer_id", "mode", "query", "status", "detail", "subjects", *POINT, "diff_axis", "diff_from", "diff_to", "event_from", "event_to", "updated_from", "updated_to", "derived_from", "embedding", "budget")


def _asked(plans: DataFrame, *columns: str) -> DataFrame:
    """One row for each subject of each request."""
    return plans.select(F.col("request_id").alias("point_id"), "viewer_id", F.explode("subjects").alias("s"), *columns).select("point_id", "viewer_id", F.col("s.type").alias("subject_type"), F.col("s.id").alias("subject_id"), *columns)


def _snapshot(asked: DataFrame, sources: Sources, now: Column) -> DataFrame:
    """Claims of known predicates about each request's subjects, at its point and as its viewer sees them."""
    known = sources.claims.join(small(sources.predicates), "predicate")
    rows = at_points(known, asked, now, ["subject_type", "subject_id"])
    return seen_by(rows, sources.claims, sources.visible, "claim_id").withColumnRenamed("point_id", "request_id")


def structured_facts(plans: DataFrame, sources: Sources, now: Column, limit: int) -> DataFrame:
    """(request_id, subject_type, subject_id, claim_id, place, truncated): the freshest facts of each subject."""
    rows = _snapshot(_asked(plans, *POINT), sources, now)
    half_life = F.coalesce("freshness_half_life_days", F.lit(FACT_HALF_LIFE))
    fresh = fact_freshness(F.col("confidence"), F.coalesce("valid_from", "recorded_at"), now, half_life)
    keys = ["request_id", "subject_type", "subject_id"]
    ranked = first_rows(rows.withColumn("freshness", fresh), keys, [F.desc("freshness"), F.desc("confidence"), F.desc("claim_id")], limit + 1, "place")
    return ranked.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy(*keys)) > limit).where(F.col("place") <= limit)


def fact_diffs(plans: DataFrame, sources: Sources, now: Column) -> DataFrame:
    """What changed about each subject between the two ends of a request's comparison, as ``diff_snapshots`` gives it."""
    live = plans.where("diff_axis is not null")
    none = F.lit(None).cast(NONE)
    ends = []
    for end in ("diff_from", "diff_to"):
        world = F.col("diff_axis") == "world"
        at = live.withColumns({"as_of": F.when(world, F.col(end)).otherwise(none), "believed_as_of": F.when(world, none).otherwise(F.col(end))})
        ends.append(_snapshot(_asked(at, *POINT), sources, now))
    return diff_snapshots(*ends, ["request_id", "subject_type", "subject_id"], sources.exclusive)


def paths(plans: DataFrame, sources: Sources, now: Column, limits: Limits) -> DataFrame:
    """(request_id, start, nodes, edges, depth, rank, truncated, capped): walks from each subject along edges that hold at the request's point and that its viewer sees.

    As ``walk_paths``, but only the edges are read that walks reach. capped
    tells that a deeper or longer answer was asked for than there is.
    """
    depth, limit = min(max(limits.depth, 1), DEEPEST), min(max(limits.paths, 1), MOST_PATHS)
    capped = limits.depth > DEEPEST or limits.paths > MOST_PATHS
    rels = sources.relationships.where("not (from_type = to_type and from_id = to_id)")
    if limits.types:
        rels = rels.where(F.col("relationship_type").isin(*limits.types))
    rels = rels.withColumns({"a": F.concat_ws(":", "from_type", "from_id"), "c": F.concat_ws(":", "to_type", "to_id")})
    rels = rels.select("relationship_id", "a", "c", "evidence_doc_ids", "status", "valid_from", "valid_to", "time_grain", "recorded_at", "invalidated_at")
    at = resolved_points(plans.select("request_id", "viewer_id", "subjects", *POINT), now)
    holds = F.array_contains("statuses", F.col("status")) & valid_as_of(F.col("valid_from"), F.col("valid_to"), F.col("time_grain"), F.col("instant"), F.col("grain")) & believed_as_of(F.col("recorded_at"), F.col("invalidated_at"), F.col("belief"))
    own = ["request_id", "viewer_id", "start", "instant", "grain", "belief", "statuses"]
    level = at.withColumn("s", F.explode("subjects")).withColumn("start", F.concat_ws(":", "s.type", "s.id")).select(*own, F.array("start").alias("nodes"), F.array().cast("array<string>").alias("edges"), F.col("start").alias("a"), F.lit(0).cast("long").alias("so_far"))
    keys, found = ["request_id", "start"], []
    for step in range(1, depth + 1):
        grown = level.where(F.col("so_far") <= limit).join(rels, "a").where(holds & ~F.array_contains("nodes", F.col("c")))
        grown = seen_by(grown, sources.relationships, sources.visible, "relationship_id")
        grown = grown.select(*own, F.array_append("nodes", F.col("c")).alias("nodes"), F.array_append("edges", F.col("relationship_id")).alias("edges"), F.col("c").alias("a"), F.col("so_far").alias("before"), F.col("relationship_id").alias("last"))
        grown = first_rows(grown, keys, [F.col("last"), F.col("edges")], limit + 1)
        level = save(grown.withColumn("so_far", F.col("before") + F.count(F.lit(1)).over(Window.partitionBy(*keys))).drop("before"))
        found.append(level.select(*keys, "nodes", "edges", F.lit(step).cast("long").alias("depth"), "last"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    ranked = first_rows(out, keys, [F.col("depth"), F.col("last"), F.col("edges")], limit + 1, "rank")
    ranked = ranked.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy(*keys)) > limit)
    return ranked.where(F.col("rank") <= limit).drop("last").withColumn("capped", F.lit(capped))


def _scopes(plans: DataFrame, sources: Sources) -> tuple[DataFrame, DataFrame, Visible, Visible]:
    """Requests that search all that their viewer sees, those that search some of it, and the documents of both; each request is its own viewer."""
    people = F.transform(F.filter("subjects", lambda s: s["type"] == "person"), lambda s: s["id"])
    rows = plans.withColumn("people", people)
    bounds = ["event_from", "event_to", "updated_from", "updated_to"]
    bounded = F.coalesce(*bounds).isNotNull()
    narrow = rows.where(bounded | (F.size("people") > 0))
    wide = rows.where(~bounded & (F.size("people") == 0))
    visible = sources.visible
    mine = visible.private.join(wide.select("viewer_id", "request_id"), "viewer_id").select(F.col("request_id").alias("viewer_id"), "doc_id")
    about = sources.participants.select("doc_id", "person_id").distinct().join(narrow.select("request_id", F.explode("people").alias("person_id")), "person_id").select("request_id", "doc_id").distinct()
    live = sources.documents.where("not deleted").select("doc_id", "event_time", "updated_at")
    within = F.lit(True)
    for c, bound, low in (("event_time", "event_from", True), ("event_time", "event_to", False), ("updated_at", "updated_from", True), ("updated_at", "updated_to", False)):
        within = within & (F.col(bound).isNull() | ((F.col(c) >= F.col(bound)) if low else (F.col(c) <= F.col(bound))))
    asked = narrow.select("request_id", F.col("viewer_id").alias("reader"), *bounds, (F.size("people") > 0).alias("of_people"))
    pairs = about.join(live, "doc_id").join(asked, "request_id").where(within).select("request_id", "reader", "doc_id")
    pairs = pairs.unionByName(live.join(small(asked.where("not of_people")), within).select("request_id", "reader", "doc_id"))
    public = pairs.join(visible.public, "doc_id", "left_semi")
    private = pairs.join(visible.private.withColumnRenamed("viewer_id", "reader"), ["reader", "doc_id"], "left_semi")
    own = save(public.select("request_id", "doc_id").unionByName(private.select("request_id", "doc_id")).distinct()).select(F.col("request_id").alias("viewer_id"), "doc_id")
    return wide, narrow, Visible(visible.public, mine), Visible(visible.public.limit(0), own)


def search(plans: DataFrame, sources: Sources, now: Column, limit: int) -> DataFrame:
    """(request_id, item_id, rank, reranked, ..): passages and facts for each request's text and vector, fused and cut after its scope.

    Passages about the request's people, or within its bounds in time, where
    it has such; facts hold at its point in time.
    """
    item = lambda kind, key: F.concat(F.lit(f"{kind}:"), key).alias("item_id")
    lists, children = [], sources.chunks.where("chunk_role = 'child'").select(F.col("chunk_id").alias("key"), "doc_id")
    for asked, reach in zip(*(lambda s: (s[:2], s[2:]))(_scopes(plans, sources)), strict=True):
        queries = asked.select(F.col("request_id").alias("query_id"), F.col("request_id").alias("viewer_id"), F.col("query").alias("text"), "embedding")
        near = vector_candidates(sources.chunks, queries.where("embedding is not null").drop("text"), reach, POOL, sources.vectors)
        lists.append(near.select("query_id", item("chunk", F.col("chunk_id")), "rank"))
        allowed = children.join(reach.private.withColumnRenamed("viewer_id", "query_id"), "doc_id").select("query_id", "key").distinct()
        worded = sources.passages.top(queries.select("query_id", "text"), POOL, allowed, children.join(reach.public, "doc_id", "left_semi").select("key"))
        lists.append(worded.select("query_id", item("chunk", F.col("key")), "rank"))
    at = resolved_points(plans.select("request_id", "viewer_id", *POINT), now)
    hits = sources.facts.match(plans.select(F.col("request_id").alias("query_id"), F.col("query").alias("text"))).withColumnRenamed("key", "claim_id").join(sources.claims, "claim_id")
    hits = hits.join(at.withColumnRenamed("request_id", "query_id"), "query_id").where(
        F.array_contains("statuses", F.col("status")) & valid_as_of(F.col("valid_from"), F.col("valid_to"), F.col("time_grain"), F.col("instant"), F.col("grain")) & believed_as_of(F.col("recorded_at"), F.col("invalidated_at"), F.col("belief"))
    )
    facts = first_rows(seen_by(hits, sources.claims, sources.visible, "claim_id"), ["query_id"], [F.desc(F.round("score", 9)), F.col("claim_id")], POOL, "rank")
    lists.append(facts.select("query_id", item("fact", F.col("claim_id")), "rank"))
    times = sources.chunks.join(sources.documents.select("doc_id", "event_time"), "doc_id").select(item("chunk", F.col("chunk_id")), F.lit("passage").alias("kind"), F.col("event_time").alias("at"), F.col("doc_id").alias("parent_id"))
    times = times.unionByName(sources.claims.select(item("fact", F.col("claim_id")), F.lit("fact").alias("kind"), F.col("valid_from").alias("at"), F.lit(None).cast("string").alias("parent_id")))
    shortlist = decayed_shortlist(rrf_fuse(lists, "item_id"), times, now)
    scores = sources.scores if sources.scores is not None else plans.sparkSession.createDataFrame([], "query_id string, item_id string, score double")
    return dedupe_parents(apply_rerank(shortlist, scores, limit)).withColumnRenamed("query_id", "request_id")


def retrieve_context(requests: DataFrame, sources: Sources, now: Column, limits: Limits | None = None) -> DataFrame:
    """The whole answer to each request: one row with its plan and, for each channel, the ids of what fits its budget.

    Returns the columns of ``plan_requests`` but embedding and budget, channels
    (map of passages, search_facts, structured_facts, fact_diffs and paths to
    ids in order), trimmed, truncated and capped. Requests that are ambiguous
    or invalid have no channels. A null budget trims nothing. What an item
    costs is the number of its words.
    """
    limits = limits or Limits()
    plans = save(plan_requests(requests, sources.persons, sources.entities, now))
    live = plans.where("status = 'ok'")
    claims = sources.claims.select("claim_id", F.coalesce(count_tokens(F.concat_ws(": ", "predicate", "object_text")), F.lit(0).cast("long")).alias("cost"))
    subject = F.concat_ws(":", "subject_type", "subject_id")

    def rows(df: DataFrame, channel: str, item: Column, order: list[Column], cost: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("request_id").orderBy(*order)).cast("long")
        return df.select("request_id", F.lit(channel).alias("channel"), item.alias("item_id"), place.alias("position"), cost.cast("long").alias("cost"))

    facts = save(structured_facts(live, sources, now, limits.facts).select("request_id", subject.alias("subject"), "claim_id", "place", "truncated").join(claims, "claim_id"))
    walks = paths(live, sources, now, limits)
    diffs = fact_diffs(live, sources, now).withColumn("item", F.concat_ws(":", "kind", "predicate", "old_id", "new_id"))
    found = search(live, sources, now, limits.passages)
    texts = sources.chunks.select(F.concat(F.lit("chunk:"), "chunk_id").alias("item_id"), F.coalesce(count_tokens(F.col("text")), F.lit(0).cast("long")).alias("cost")) if "text" in sources.chunks.columns else None
    costs = claims.select(F.concat(F.lit("fact:"), "claim_id").alias("item_id"), "cost")
    found = found.join(costs if texts is None else costs.unionByName(texts), "item_id", "left")
    is_fact = F.col("item_id").startswith("fact:")
    cost = F.coalesce("cost", F.lit(0).cast("long"))
    items = [
        rows(facts, "structured_facts", F.col("claim_id"), [F.col("subject"), F.col("place")], F.col("cost")),
        rows(walks, "paths", F.array_join("edges", ">"), [F.col("start"), F.col("rank")], F.size("nodes")),
        rows(diffs, "fact_diffs", F.col("item"), [subject, F.col("item")], count_tokens(F.concat_ws(" ", "predicate", "old_value", "new_value"))),
        rows(found.where(is_fact), "search_facts", F.expr("substr(item_id, 6)"), [F.col("rank")], cost),
        rows(found.where(~is_fact), "passages", F.expr("substr(item_id, 7)"), [F.col("rank")], cost),
    ]
    every = items[0]
    for more in items[1:]:
        every = every.unionByName(more)
    every = save(every)  # packed below, and summed up
    budgets = live.select("request_id", "mode", F.coalesce("budget", F.lit((1 << 62) - 1)).alias("budget"))
    packed = pack_tokens(every, budgets)
    channels = packed.groupBy("request_id", "channel").agg(F.array_sort(F.collect_list(F.struct("position", "item_id"))).alias("items"))
    channels = channels.groupBy("request_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", F.col("items.item_id").alias("ids"))))).alias("channels"))
    totals = every.groupBy("request_id").agg(F.sum("cost").alias("total")).join(budgets, "request_id").select("request_id", (F.col("total") > F.col("budget")).alias("trimmed"))
    cut = facts.groupBy("request_id").agg(F.max("truncated").alias("facts_cut"))
    more = walks.groupBy("request_id").agg(F.max("truncated").alias("paths_cut"), F.max("capped").alias("capped"))
    out = plans.drop("embedding", "budget").join(channels, "request_id", "left").join(totals, "request_id", "left").join(cut, "request_id", "left").join(more, "request_id", "left")
    no = F.lit(False)
    # A request whose budget nothing fits has no items, but channels.
    channels = F.when(F.col("status") == "ok", F.coalesce("channels", F.create_map().cast("map<string,array<string>>")))
    return out.select(*plans.drop("embedding", "budget").columns, channels.alias("channels"), F.coalesce("trimmed", no).alias("trimmed"), (F.coalesce("facts_cut", no) | F.coalesce("paths_cut", no)).alias("truncated"), F.coalesce("capped", no).alias("capped"))
