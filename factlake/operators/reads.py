"""Reads of facts and of the graph by many viewers, subjects and points in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.ranking import FACT_HALF_LIFE, fact_freshness
from factlake.functions.temporal import believed_as_of, expand_valid_from, query_bucket, read_statuses, resolve_point
from factlake.functions.text import normalize_name
from factlake.operators.acl import Visible, for_viewers
from factlake.operators.common import first_rows, holding, small
from factlake.operators.intervals import join_alike, join_points
from factlake.operators.store import save


def resolved_points(points: DataFrame, now: Column) -> DataFrame:
    """``points(point_id, as_of, believed_as_of, as_of_grain)`` with instant, grain and readable statuses."""
    instant, grain, is_point = resolve_point(F.col("as_of"), F.col("believed_as_of"), F.col("as_of_grain"), now)
    belief = F.coalesce("believed_as_of", now)
    return points.select(*points.columns, instant.alias("instant"), grain.alias("grain"), belief.alias("belief"), read_statuses(is_point).alias("statuses"))


#: Points up to which each fact is compared with all of them.
FEW_POINTS = 256
#: Columns of ``with_first`` and ``with_bounds``.
BOUNDS = ["_first", "_start", "_end"]


def with_first(facts: DataFrame) -> DataFrame:
    """With the start of each fact's window, worked out once a fact, so that a pair with a point costs comparisons only."""
    return facts.withColumn("_first", expand_valid_from(F.col("valid_from"), F.col("time_grain")))


def with_bounds(at: DataFrame, name: str = "") -> DataFrame:
    """With the bounds of each point's bucket, worked out once a point."""
    start, end = query_bucket(F.col(f"{name}instant"), F.col(f"{name}grain"))
    return at.withColumns({"_start": start, "_end": end})


def holds_at(name: str = "") -> Column:
    """Whether a fact ``with_first`` is readable, believed and valid at a point ``with_bounds``; as ``valid_as_of``."""
    first, start, valid_to, instant = F.col("_first"), F.col("_start"), F.col("valid_to"), F.col(f"{name}instant")
    meets = (first.isNull() | (first < F.col("_end"))) & (valid_to.isNull() | (valid_to > start))
    holds = (first.isNull() | (first <= instant)) & (valid_to.isNull() | (valid_to > instant))
    valid = F.when(start.isNotNull(), meets).otherwise(holds)
    return F.array_contains(f"{name}statuses", F.col("status")) & believed_as_of(F.col("recorded_at"), F.col("invalidated_at"), F.col(f"{name}belief")) & valid


def at_points(facts: DataFrame, points: DataFrame, now: Column, by: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Facts that are valid and believed at each point; columns ``by`` (a subject, say) that both tables have must be equal.

    A few points are broadcast; many meet the facts by nodes of a tree of time,
    or, with ``by``, in blocks of facts of a subject. The result has the columns
    ``keep``, or all.
    """
    if keep is not None:
        return _at_points(facts, points, now, by, keep).select(*keep)
    return _at_points(facts, points, now, by, None)


def _at_points(facts: DataFrame, points: DataFrame, now: Column, by: list[str] | None, keep: list[str] | None) -> DataFrame:
    by = by or []
    at = resolved_points(points, now).withColumnsRenamed({c: f"at_{c}" for c in ("instant", "grain", "belief", "statuses")})
    at = at.select(*[c for c in at.columns if c.startswith("at_") or c in by or c not in facts.columns])
    if points.limit(FEW_POINTS + 1).count() > FEW_POINTS:
        met = join_alike(facts, at, by, keep) if by else join_points(facts, at, by)
        return met.drop("at_statuses", "as_of", "believed_as_of", "as_of_grain")
    facts = with_first(facts)
    same = F.lit(True)
    for c in by:
        same = same & (facts[c] == F.col(f"_{c}"))
    met = facts.join(F.broadcast(with_bounds(at, "at_").withColumnsRenamed({c: f"_{c}" for c in by})), same & holds_at("at_"))
    return met.drop("at_statuses", "as_of", "believed_as_of", "as_of_grain", *BOUNDS, *[f"_{c}" for c in by])


def claims_for_viewers(claims: DataFrame, subjects: DataFrame | None, viewers: DataFrame, visible: Visible, points: DataFrame, now: Column) -> DataFrame:
    """Claims by viewer and point, of ``subjects(subject_id)`` or of all; the order is the reader's (newest first)."""
    if subjects is not None:
        claims = claims.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    # Time first: it doesn't depend on the viewer.
    return for_viewers(claims, visible, "claim_id", viewers, at_points(claims, points, now))


def relationships_for_viewers(rels: DataFrame, nodes: DataFrame, viewers: DataFrame, visible: Visible, points: DataFrame, now: Column) -> DataFrame:
    """Edges that have one of ``nodes(node_type, node_id)`` at either end; two equi-joins instead of an OR."""
    ends = [
        rels.join(nodes, (F.col(f"{e}_type") == F.col("node_type")) & (F.col(f"{e}_id") == F.col("node_id"))).select(*rels.columns, "node_type", "node_id")
        for e in ("from", "to")
    ]
    both = ends[0].unionByName(ends[1].where("not (from_type = to_type and from_id = to_id)"))
    return for_viewers(rels, visible, "relationship_id", viewers, at_points(both, points, now))


def search_entities(entities: DataFrame, names: DataFrame, viewers: DataFrame, visible: Visible, limit: int) -> DataFrame:
    """Per ``names(query_id, pattern, entity_type)`` and viewer the first entities whose name holds the pattern."""
    hits = holding(entities, F.lower("name"), names.withColumnRenamed("entity_type", "q_type"), F.lower("pattern"))
    hits = for_viewers(entities, visible, "entity_id", viewers, hits.where("q_type is null or entity_type = q_type"))
    return first_rows(hits, ["query_id", "viewer_id"], [F.lower("name"), F.col("entity_id")], limit, "rank")


def list_entities(entities: DataFrame, viewers: DataFrame, visible: Visible, limit: int) -> DataFrame:
    rows = for_viewers(entities, visible, "entity_id", viewers)
    return first_rows(rows, ["viewer_id", "entity_type"], [F.col("name"), F.col("entity_id")], limit, "rank")


def query_facts(
    claims: DataFrame, subjects: DataFrame | None, viewers: DataFrame, visible: Visible, points: DataFrame, predicates: DataFrame, now: Column, limit: int
) -> DataFrame:
    """Known predicates only, scored by freshness; ``limit`` a viewer, subject and point, with a flag where more exist."""
    known = claims.join(small(predicates), "predicate")
    rows = claims_for_viewers(known, subjects, viewers, visible, points, now)
    half_life = F.coalesce("freshness_half_life_days", F.lit(FACT_HALF_LIFE))
    rows = rows.withColumn("freshness", fact_freshness(F.col("confidence"), F.coalesce("valid_from", "recorded_at"), now, half_life))
    keys = ["viewer_id", "point_id", "subject_id"]
    ranked = first_rows(rows, keys, [F.desc("freshness"), F.desc("confidence"), F.desc("claim_id")], limit + 1, "rank")
    more = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > limit
    return ranked.withColumn("truncated", more).where(F.col("rank") <= limit)


def diff_snapshots(old: DataFrame, new: DataFrame, keys: list[str], exclusive: DataFrame) -> DataFrame:
    """Unchanged, added and removed claims; one removed and one added value of an exclusive predicate pair up as changed."""
    fields = [*keys, "claim_id", "predicate", "object_text"]
    both = old.select(*fields, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(*fields, F.lit(0).alias("o"), F.lit(1).alias("n")))
    # Saved, since each kind of row below reads it again.
    kinds = save(both.groupBy(*fields).agg(F.max("o").alias("o"), F.max("n").alias("n")))
    kind = F.when(F.col("o") + F.col("n") == 2, "unchanged").when(F.col("n") == 1, "added").otherwise("removed")
    rows = kinds.select(*fields, kind.alias("kind")).join(small(exclusive.select("predicate", F.lit(True).alias("exclusive"))), "predicate", "left")
    place = F.row_number().over(Window.partitionBy(*keys, "predicate", "kind").orderBy("claim_id"))
    lone = rows.where("exclusive and kind <> 'unchanged'").withColumn("place", place)
    rest = rows.where("exclusive is null or kind = 'unchanged'").select(*keys, "predicate", "kind", F.col("claim_id").alias("id"), F.col("object_text").alias("value"))
    one = lone.where("kind = 'removed'").select(*keys, "predicate", "place", F.col("claim_id").alias("old_id"), F.col("object_text").alias("old_value"))
    two = lone.where("kind = 'added'").select(*keys, "predicate", "place", F.col("claim_id").alias("new_id"), F.col("object_text").alias("new_value"))
    pairs = one.join(two, [*keys, "predicate", "place"], "full_outer")
    changed = F.col("old_id").isNotNull() & F.col("new_id").isNotNull()
    kind = F.when(changed & (F.col("old_value") != F.col("new_value")), "changed").when(changed, "replaced").when(F.col("old_id").isNotNull(), "removed").otherwise("added")
    sides = pairs.select(*keys, "predicate", kind.alias("kind"), "old_id", "old_value", "new_id", "new_value")
    old_side = F.col("kind").isin("unchanged", "removed")
    new_side = F.col("kind").isin("unchanged", "added")
    return sides.unionByName(
        rest.select(*keys, "predicate", "kind", F.when(old_side, F.col("id")).alias("old_id"), F.when(old_side, F.col("value")).alias("old_value"), F.when(new_side, F.col("id")).alias("new_id"), F.when(new_side, F.col("value")).alias("new_value"))
    )


def walk_paths(
    rels: DataFrame, starts: DataFrame, viewers: DataFrame, visible: Visible, points: DataFrame, now: Column, max_depth: int = 3, limit: int = 200, types: list[str] | None = None
) -> DataFrame:
    """Outgoing walks of 1 to ``max_depth`` edges that repeat no node, of edges of the ``types`` (all, if not given).

    Each edge is checked for time and visibility before it is walked; order is
    depth, last edge, edges; ``limit`` a viewer, point and start, and truncated
    where there are more. Depth and limit are clamped to 3 and 200, and capped
    tells that more was asked for.

    Since shorter walks come first, only starts that have ``limit`` walks or
    fewer so far are walked further, and a node needs no more than its first
    edges: a walk passes over the few nodes it has been at, ``limit`` + 1 edges
    to each, and then takes ``limit`` + 1.
    """
    capped = max_depth > 3 or limit > 200
    max_depth, limit = min(max(max_depth, 1), 3), min(max(limit, 1), 200)
    if types is not None:
        rels = rels.where(F.col("relationship_type").isin(*types))
    own = for_viewers(rels, visible, "relationship_id", viewers, at_points(rels.where("not (from_type = to_type and from_id = to_id)"), points, now))
    edges = own.select("viewer_id", "point_id", "relationship_id", F.concat_ws(":", "from_type", "from_id").alias("a"), F.concat_ws(":", "to_type", "to_id").alias("b"))
    edges = first_rows(edges, ["viewer_id", "point_id", "a", "b"], [F.col("relationship_id")], limit + 1)
    edges = first_rows(edges, ["viewer_id", "point_id", "a"], [F.col("relationship_id")], (max_depth + 1) * (limit + 1))
    start = F.concat_ws(":", "node_type", "node_id")
    keys = ["viewer_id", "point_id", "start"]
    level = edges.join(starts.select(start.alias("a")).distinct(), "a", "left_semi")
    level = level.select("viewer_id", "point_id", F.col("a").alias("start"), F.array("a", "b").alias("nodes"), F.array("relationship_id").alias("edges"), "b", F.lit(0).cast("long").alias("before"))
    step = edges.select("viewer_id", "point_id", F.col("a").alias("b"), F.col("b").alias("c"), "relationship_id")
    found = []
    for depth in range(1, max_depth + 1):
        if depth > 1:
            level = level.where(F.col("so_far") <= limit).join(step, ["viewer_id", "point_id", "b"]).where(~F.array_contains("nodes", F.col("c")))
            level = level.select(*keys, F.array_append("nodes", F.col("c")).alias("nodes"), F.array_append("edges", F.col("relationship_id")).alias("edges"), F.col("c").alias("b"), F.col("so_far").alias("before"))
        level = first_rows(level.withColumn("last", F.element_at("edges", -1)), keys, [F.col("last"), F.col("edges")], limit + 1)
        level = level.withColumn("so_far", F.col("before") + F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        found.append(level.select(*keys, "nodes", "edges", F.lit(depth).cast("long").alias("depth"), "last"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    ranked = first_rows(out, keys, [F.col("depth"), F.col("last"), F.col("edges")], limit + 1, "rank")
    more = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > limit
    return ranked.withColumn("truncated", more).where(F.col("rank") <= limit).drop("last").withColumn("capped", F.lit(capped))


def person_roots(persons: DataFrame) -> DataFrame:
    """(canonical_id, root_id, in_cycle): merges followed to their end, however long the chain.

    Each round doubles the length that is followed, until every pointer is at
    a person that is merged into none (or into one that the table lacks). What
    still has no end after as many rounds as it takes to pass everyone leads
    into a cycle: ``in_cycle`` is true, and the root is the cycle's smallest id.
    """
    up = persons.select(F.col("canonical_id").alias("up_id")).distinct()
    own = persons.select("canonical_id", F.nullif("merged_into_id", "canonical_id").alias("into"))
    own = own.join(up, F.col("into") == F.col("up_id"), "left")
    ends = F.col("up_id").isNull()
    at = save(own.select("canonical_id", F.coalesce("into", "canonical_id").alias("root_id"), F.least("canonical_id", "into").alias("least"), ends.alias("ended")))
    for _ in range(at.count().bit_length() + 1):
        if at.where("not ended").isEmpty():
            break
        further = at.select(F.col("canonical_id").alias("root_id"), F.col("root_id").alias("next"), F.col("least").alias("next_least"), F.col("ended").alias("next_ended"))
        moved = at.where("not ended").join(further, "root_id").select("canonical_id", F.col("next").alias("root_id"), F.least("least", "next_least").alias("least"), F.col("next_ended").alias("ended"))
        at = save(at.where("ended").unionByName(moved))
    on_cycle = at.where("not ended").select(F.col("canonical_id").alias("root_id"), F.col("least").alias("first"))
    rows = at.where("not ended").join(on_cycle, "root_id").select("canonical_id", F.col("first").alias("root_id"), F.lit(True).alias("in_cycle"))
    return at.where("ended").select("canonical_id", "root_id", F.lit(False).alias("in_cycle")).unionByName(rows)


def subject_card(subjects: DataFrame, persons: DataFrame, claims: DataFrame, rels: DataFrame, viewers: DataFrame, visible: Visible, points: DataFrame, now: Column) -> DataFrame:
    """Per viewer, point and person of ``subjects(subject_id)``: the root person's name, claims and edges as arrays.

    Only roots that a claim or an edge names meet the facts and their cards;
    the others' persons are dealt over tasks before they meet points and viewers.
    Few such roots are broadcast, so facts aren't shuffled by person first.
    """
    roots = subjects.join(person_roots(persons), F.col("subject_id") == F.col("canonical_id")).select("subject_id", "root_id")
    # Saved, since both kinds of rows read it.
    head = save(roots.join(persons.select(F.col("canonical_id").alias("root_id"), "display_name"), "root_id"))
    named = claims.select(F.col("subject_id").alias("root_id")).distinct()
    for e in ("from", "to"):
        named = named.unionByName(rels.where(f"{e}_type = 'person'").select(F.col(f"{e}_id").alias("root_id")).distinct())
    named = small(save(head.select("root_id").distinct().join(named.distinct(), "root_id", "left_semi")))
    own = claims_for_viewers(claims.join(named.withColumnRenamed("root_id", "subject_id"), "subject_id", "left_semi"), None, viewers, visible, points, now)
    own = own.groupBy(F.col("subject_id").alias("root_id"), "point_id", "viewer_id")
    # sort_array compares natively, array_sort by a lambda; the structs are never null, so their order is the same.
    own = own.agg(F.sort_array(F.collect_list(F.struct("claim_id", "predicate", "object_text"))).alias("claims"))
    nodes = named.select(F.lit("person").alias("node_type"), F.col("root_id").alias("node_id"))
    # Dealt over tasks, since each edge becomes many rows: two ends, points and viewers.
    edges = relationships_for_viewers(rels.repartition("relationship_id"), nodes, viewers, visible, points, now).groupBy(F.col("node_id").alias("root_id"), "point_id", "viewer_id")
    edges = edges.agg(F.sort_array(F.collect_list(F.struct("relationship_id", "relationship_type", "from_id", "to_id"))).alias("edges"))
    # The same columns in the same order as in the groups, so that cards aren't shuffled again; what differs most is sorted by first.
    keys = ["root_id", "point_id", "viewer_id"]
    at, who = small(points.select("point_id")), small(viewers.select("viewer_id"))
    met = head.join(named, "root_id", "left_semi").join(at, how="cross").join(who, how="cross").join(own, keys, "left").join(edges, keys, "left")
    bare = head.join(named, "root_id", "left_anti").repartition("subject_id").join(at, how="cross").join(who, how="cross")
    return met.unionByName(bare.withColumns({c: F.lit(None).cast(met.schema[c].dataType) for c in ("claims", "edges")}))


def search_people(persons: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """Roots whose display name, or one of whose aliases, holds ``names(query_id, pattern)``."""
    roots = persons.where("merged_into_id is null")
    hits = holding(roots, F.lower("display_name"), names, F.lower("pattern"))
    if "name_aliases" in persons.columns:
        listed = roots.withColumn("_alias", F.explode(F.array_distinct("name_aliases")))
        hits = hits.unionByName(holding(listed, F.lower("_alias"), names, F.lower("pattern")).select(hits.columns)).dropDuplicates(["query_id", "canonical_id"])
    return first_rows(hits, ["query_id"], [F.col("display_name"), F.col("canonical_id")], limit, "rank")


def resolve_subjects(names: DataFrame, persons: DataFrame, entities: DataFrame) -> DataFrame:
    """``names(query_id, name)`` to a subject: people first, then teams, projects, glossary; exact names preferred.

    status is resolved, ambiguous or unknown; candidates are listed by id.
    """
    subjects = persons.where("merged_into_id is null").select(F.lit("person").alias("type"), F.col("canonical_id").alias("id"), F.col("display_name").alias("label"), F.lit(0).alias("place"))
    place = F.when(F.col("entity_type") == "team", 1).when(F.col("entity_type") == "project", 2).otherwise(3)
    subjects = subjects.unionByName(entities.select(F.col("entity_type").alias("type"), F.col("entity_id").alias("id"), F.col("name").alias("label"), place.alias("place")))
    hits = holding(subjects.withColumn("norm", normalize_name(F.col("label"))), F.col("norm"), names.withColumn("wanted", normalize_name(F.col("name"))), F.col("wanted"))
    hits = hits.withColumn("inexact", F.when(F.col("norm") == F.col("wanted"), 0).otherwise(1))
    best = F.min(F.struct("place", "inexact")).over(Window.partitionBy("query_id"))
    hits = hits.withColumn("best", best).where((F.col("place") == F.col("best.place")) & (F.col("inexact") == F.col("best.inexact")))
    found = hits.groupBy("query_id").agg(F.min("type").alias("type"), F.array_sort(F.collect_set("id")).alias("candidates"))
    status = F.when(F.col("candidates").isNull(), "unknown").when(F.size("candidates") == 1, "resolved").otherwise("ambiguous")
    return names.join(found, "query_id", "left").select("query_id", "name", "type", "candidates", status.alias("status"))


def list_subjects(entities: DataFrame, participants: DataFrame, persons: DataFrame, viewers: DataFrame, visible: Visible, limit: int) -> DataFrame:
    """Per viewer and category the first subjects with visible evidence: people who take part in a document, entities seen whole."""
    from factlake.operators.acl import person_evidence

    seen = person_evidence(participants, visible)
    own = seen.where("viewer_id is not null").select("viewer_id", "person_id")
    public = seen.where("viewer_id is null").select("person_id").distinct().join(small(viewers.select("viewer_id")), how="cross").select("viewer_id", "person_id")
    people = own.unionByName(public).distinct().join(persons.where("merged_into_id is null"), F.col("person_id") == F.col("canonical_id"))
    people = people.select("viewer_id", F.lit("person").alias("category"), F.col("person_id").alias("subject_id"), F.col("display_name").alias("label"))
    things = for_viewers(entities, visible, "entity_id", viewers)
    things = things.select("viewer_id", F.col("entity_type").alias("category"), F.col("entity_id").alias("subject_id"), F.col("name").alias("label"))
    return first_rows(people.unionByName(things), ["viewer_id", "category"], [F.col("label"), F.col("subject_id")], min(max(limit, 1), 100), "rank")


def alias_query_text(persons: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct names of each person, own name first, joined for a search."""
    own = aliases.groupBy("person_id").agg(F.array_sort(F.collect_set("display_name")).alias("others"))
    out = persons.join(own, F.col("canonical_id") == F.col("person_id"), "left")
    names = F.array_distinct(F.concat(F.array("display_name"), F.coalesce("others", F.array().cast("array<string>"))))
    return out.select("canonical_id", F.array_join(names, " ").alias("query_text"))


def subject_candidates(names: DataFrame, persons: DataFrame, entities: DataFrame) -> DataFrame:
    """All subjects of any type whose name holds ``names(query_id, name)``, in any case and spacing."""
    subjects = persons.where("merged_into_id is null").select(F.lit("person").alias("type"), F.col("canonical_id").alias("id"), F.col("display_name").alias("label"))
    subjects = subjects.unionByName(entities.select(F.col("entity_type").alias("type"), F.col("entity_id").alias("id"), F.col("name").alias("label")))
    return holding(subjects, normalize_name(F.col("label")), names.select("query_id", "name"), normalize_name(F.col("name"))).select("query_id", "type", "id", "label")
