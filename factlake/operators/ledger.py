"""The ledger of claims and relationships: merging, ranking, superseding, retracting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.ranking import precedence_class, precedence_rank, status_for_confidence
from factlake.functions.temporal import grain_rank
from factlake.functions.text import normalize_name
from factlake.operators.common import first_rows, small

#: Moves between statuses; superseded is final.
MOVES = (("proposed", "active"), ("proposed", "retracted"), ("active", "superseded"), ("active", "retracted"), ("retracted", "proposed"), ("retracted", "active"))
LIVE = ("proposed", "active", "retracted")


def latest_evidence_time(facts: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, newest): the newest event time of the live evidence documents, null if none is left."""
    cited = facts.select(key, F.explode(F.array_distinct("evidence_doc_ids")).alias("doc_id"))
    live = docs.where("not deleted").select("doc_id", "event_time")
    newest = cited.join(live, "doc_id").groupBy(key).agg(F.max("event_time").alias("newest"))
    return facts.select(key).distinct().join(newest, key, "left")


def ranked(claims: DataFrame, docs: DataFrame, key: str = "claim_id") -> DataFrame:
    """Claims with precedence and newest evidence, the keys of conflict ranking."""
    rank = precedence_rank(F.col("created_by"), F.size(F.array_distinct("evidence_doc_ids")))
    return claims.withColumn("precedence", rank).join(latest_evidence_time(claims, docs, key), key, "left")


def conflict_order(key: str = "claim_id") -> list[Column]:
    return [F.desc("precedence"), F.col("newest").desc_nulls_last(), F.desc("confidence"), F.desc("updated_at"), F.desc(key)]


def rank_conflicts(claims: DataFrame, docs: DataFrame, slot: list[str]) -> DataFrame:
    """Place of each active claim in its slot: precedence, newest evidence, confidence, update, id."""
    rows = ranked(claims.where("status = 'active'"), docs)
    place = F.row_number().over(Window.partitionBy(*slot).orderBy(*conflict_order())).cast("long")
    return rows.withColumn("place", place).withColumn("precedence_class", precedence_class(F.col("precedence")))


def pick_keeper(claims: DataFrame, docs: DataFrame, slot: list[str]) -> DataFrame:
    """The row that stays of each slot: by conflict rank if two or more are active, else by status and id."""
    rows = ranked(claims.where(F.col("status").isin(*LIVE)), docs)
    active = F.count_if(F.col("status") == "active").over(Window.partitionBy(*slot))
    rows = rows.withColumn("contested", active >= 2).withColumn("state", F.when(F.col("status") == "active", 0).when(F.col("status") == "proposed", 1).otherwise(2))
    contest = [F.when(F.col("contested"), c).desc_nulls_last() for c in (F.col("precedence"), F.col("newest"), F.col("confidence"), F.col("updated_at"), F.col("claim_id"))]
    return first_rows(rows, slot, [F.col("state"), *contest, F.col("claim_id")])


def merge_evidence(claims: DataFrame, slot: list[str]) -> DataFrame:
    """Per slot the union of evidence, the highest confidence, and open window ends filled from others."""
    order = F.struct("created_at", "claim_id")
    return claims.groupBy(*slot).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_doc_ids")))).alias("evidence_doc_ids"),
        F.max("confidence").alias("confidence"),
        F.min_by("valid_from", F.when(F.col("valid_from").isNotNull(), order)).alias("valid_from"),
        F.min_by("valid_to", F.when(F.col("valid_to").isNotNull(), order)).alias("valid_to"),
        F.min_by("time_grain", F.struct(grain_rank(F.col("time_grain")), order)).alias("time_grain"),
        F.count(F.lit(1)).alias("merged"),
    )


def merge_quotes(claims: DataFrame, slot: list[str]) -> DataFrame:
    """Quotes of a slot, one per document and quote; the last one given stays."""
    quotes = claims.select(*slot, "created_at", "claim_id", F.posexplode("evidence_quotes").alias("pos", "quote"))
    last = quotes.groupBy(*slot, F.col("quote.doc_id").alias("doc_id"), F.col("quote.quote").alias("text")).agg(F.max_by("quote", F.struct("created_at", "claim_id", "pos")).alias("quote"))
    return last.groupBy(*slot).agg(F.array_sort(F.collect_list("quote")).alias("evidence_quotes"))


def supersede(losers: DataFrame, winners: DataFrame, slot: list[str], now: Column, key: str = "claim_id") -> DataFrame:
    """Close losers: the world window ends where the winner's begins (or now), belief ends now."""
    heads = winners.select(*slot, F.col(key).alias("winner_id"), F.col("valid_from").alias("winner_from"))
    rows = losers.join(heads, slot)
    return rows.withColumns({
        "valid_to": F.coalesce("valid_to", "winner_from", now), "invalidated_at": now, "status": F.lit("superseded"), "superseded_by": F.col("winner_id"),
    }).drop("winner_id", "winner_from")


def collapse_duplicates(claims: DataFrame, docs: DataFrame, now: Column) -> DataFrame:
    """One live row per subject, predicate and object; the others point to it as superseded."""
    slot = ["subject_id", "predicate", "object_text"]
    live = claims.where(F.col("status").isin(*LIVE))
    keeper = pick_keeper(live, docs, slot).select(*claims.columns)
    merged = merge_evidence(live, slot).withColumnsRenamed({c: f"m_{c}" for c in ("evidence_doc_ids", "confidence", "valid_from", "valid_to", "time_grain")})
    kept = keeper.join(merged, slot).withColumns({
        "evidence_doc_ids": F.col("m_evidence_doc_ids"), "confidence": F.col("m_confidence"), "time_grain": F.col("m_time_grain"),
        "valid_from": F.coalesce("valid_from", "m_valid_from"), "valid_to": F.coalesce("valid_to", "m_valid_to"),
    }).select(*claims.columns, F.lit(None).cast("string").alias("superseded_by"))
    extra = live.join(keeper.select("claim_id"), "claim_id", "left_anti")
    return kept.unionByName(supersede(extra, keeper, slot, now).select(*kept.columns)).unionByName(
        claims.where(~F.col("status").isin(*LIVE)).select(*claims.columns, F.lit(None).cast("string").alias("superseded_by"))
    )


def close_slots(facts: DataFrame, docs: DataFrame, exclusive: DataFrame, slot: list[str], value: list[str], now: Column, key: str) -> DataFrame:
    """Of an exclusive slot's active rows the best stays, rivals with another value are superseded; others are returned as they are."""
    kind = slot[-1]
    names = small(exclusive.select(kind).distinct())
    active = facts.where("status = 'active'").join(names, kind, "left_semi")
    rows = ranked(active, docs, key)
    best = first_rows(rows, slot, conflict_order(key))
    heads = best.select(*slot, F.struct(*value).alias("best_value"))
    rivals = active.join(heads, slot).where(F.struct(*value) != F.col("best_value")).select(*facts.columns)
    closed = supersede(rivals, best, slot, now, key)
    rest = facts.join(rivals.select(key), key, "left_anti").withColumn("superseded_by", F.lit(None).cast("string"))
    return closed.select(*rest.columns).unionByName(rest)


def close_claim_slots(claims: DataFrame, docs: DataFrame, exclusive: DataFrame, now: Column) -> DataFrame:
    return close_slots(claims, docs, exclusive, ["subject_id", "predicate"], ["object_text"], now, "claim_id")


def close_relationship_slots(rels: DataFrame, docs: DataFrame, exclusive: DataFrame, now: Column) -> DataFrame:
    return close_slots(rels, docs, exclusive, ["from_type", "from_id", "relationship_type"], ["to_type", "to_id"], now, "relationship_id")


def supersede_lower_rivals(winners: DataFrame, claims: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(closed, left): rivals of lower precedence close; equal or higher ones are left."""
    slot = ["subject_id", "predicate"]
    rank = precedence_rank(F.col("created_by"), F.size(F.array_distinct("evidence_doc_ids")))
    heads = winners.select(*slot, F.col("claim_id").alias("w_id"), F.col("object_text").alias("w_object"), rank.alias("w_rank"))
    rivals = claims.where("status = 'active'").withColumn("precedence", rank).join(heads, slot).where("claim_id <> w_id and object_text <> w_object")
    lower = rivals.where("precedence < w_rank").select(*claims.columns)
    left = rivals.where("precedence >= w_rank").select(*claims.columns)
    return supersede(lower, winners, slot, now), left


def claim_conflicts(claims: DataFrame) -> DataFrame:
    """Slots with more than one active claim."""
    out = claims.where("status = 'active'").groupBy("subject_id", "predicate").agg(F.count(F.lit(1)).alias("n_claims"), F.countDistinct("object_text").alias("n_values"))
    return out.where("n_claims > 1")


def relationship_conflicts(rels: DataFrame, exclusive: DataFrame) -> DataFrame:
    """Exclusive edge slots with more than one active target, told apart by type and id."""
    rows = rels.where("status = 'active'").join(small(exclusive), "relationship_type", "left_semi")
    out = rows.groupBy("from_type", "from_id", "relationship_type").agg(F.countDistinct("to_type", "to_id").alias("n_targets"))
    return out.where("n_targets > 1")


def resolve_conflicts(claims: DataFrame, docs: DataFrame, registry: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """Close contested slots that are exclusive by the registry or, for unknown predicates, by ``verdicts(predicate, exclusive)``."""
    known = registry.select("predicate", F.col("mutually_exclusive").alias("known"))
    told = verdicts.select("predicate", F.col("exclusive").alias("told"))
    decided = known.join(told, "predicate", "full_outer").where(F.coalesce("known", "told", F.lit(False))).select("predicate")
    return close_claim_slots(claims, docs, decided, now)


def merge_relationships(rels: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming edges into those with the same ends and type, as ``merge_claims`` but that the first creator stays."""
    return _merge(rels, incoming, ["from_type", "from_id", "relationship_type", "to_type", "to_id"], "relationship_id", False)


def merge_claims(claims: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming claims into those with the same subject, predicate and object.

    All rows come back whole: superseded ones, and live ones that nothing
    merges into, as they are. Evidence and quotes join, confidence rises, open
    window ends are filled, the finer grain wins. An active row lifts a
    proposed or retracted one, a proposed row a retracted one, and its belief
    is open again. A creator of higher rank takes over. Incoming rows count in
    the order of created_at and id; columns that ``incoming`` lacks are null.
    """
    return _merge(claims, incoming, ["subject_type", "subject_id", "predicate", "object_text"], "claim_id", True)


def _merge(old: DataFrame, incoming: DataFrame, keys: list[str], key: str, creator: bool) -> DataFrame:
    columns = old.columns
    fresh = incoming.select(*[F.col(c) if c in incoming.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in columns])
    has = set(columns).__contains__
    by = ["created_at", key] if has("created_at") else [key]
    order = F.struct(*by)
    rank = F.when(F.col("created_by").startswith("structured_field"), 2).when(F.col("created_by").startswith("agent_promote"), 1).otherwise(0)
    windows = [c for c in ("valid_from", "valid_to") if has(c)]
    told = fresh.groupBy(*keys).agg(
        F.min_by(F.struct(*columns), order).alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_doc_ids")))).alias("docs"), F.max("confidence").alias("score"),
        F.bool_or(F.col("status") == "active").alias("any_active"), F.bool_or(F.col("status") == "proposed").alias("any_proposed"), F.min_by("created_by", F.struct(-rank, order)).alias("by"), F.max(rank).alias("by_rank"),
        *([F.array_sort(F.collect_list(F.struct(*by, "evidence_quotes"))).alias("said")] if has("evidence_quotes") else []),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"n_{c}") for c in windows],
        *([F.min_by("time_grain", F.struct(grain_rank(F.col("time_grain")), order)).alias("n_grain")] if has("time_grain") else []),
    )
    state = F.when(F.col("status") == "active", 0).when(F.col("status") == "proposed", 1).otherwise(2)
    keeper = first_rows(old.where("status <> 'superseded'"), keys, [state, F.col(key)])
    rest = old.join(keeper.select(key), key, "left_anti").select(columns)
    kept = keeper.select(*keys, F.struct(*columns).alias("own"))
    both = kept.join(told, keys, "full_outer").withColumn("base", F.coalesce("own", "first"))
    new = F.col("first").isNotNull()
    status = F.when(F.col("any_active"), "active").when(F.col("any_proposed") & (F.col("base.status") == "retracted"), "proposed").otherwise(F.col("base.status"))
    own_rank = F.when(F.col("base.created_by").startswith("structured_field"), 2).when(F.col("base.created_by").startswith("agent_promote"), 1).otherwise(0)
    empty = F.array().cast("array<string>")
    out = {
        "evidence_doc_ids": F.array_sort(F.array_distinct(F.concat(F.coalesce("own.evidence_doc_ids", empty), F.coalesce("docs", empty)))),
        "confidence": F.greatest("base.confidence", "score"), "status": status,
    }
    if has("invalidated_at"):
        out["invalidated_at"] = F.when(status != F.col("base.status"), None).otherwise(F.col("base.invalidated_at"))
    if creator:
        out["created_by"] = F.when(F.col("by_rank") > own_rank, F.col("by")).otherwise(F.col("base.created_by"))
    for c in windows:
        out[c] = F.coalesce(f"base.{c}", f"n_{c}")
    if has("time_grain"):
        out["time_grain"] = F.when(grain_rank(F.col("n_grain")) < grain_rank(F.col("base.time_grain")), F.col("n_grain")).otherwise(F.col("base.time_grain"))
    if has("evidence_quotes"):
        quotes = old.schema["evidence_quotes"].dataType
        none = F.array().cast(quotes)
        every = F.concat(F.coalesce("own.evidence_quotes", none), F.flatten(F.transform(F.coalesce(F.col("said"), F.array().cast(both.schema["said"].dataType)), lambda x: F.coalesce(x["evidence_quotes"], none))))
        # One per document and quote: the place of the first, the fields of the last.
        same = lambda x, y: (x["doc_id"] == y["doc_id"]) & (x["quote"] == y["quote"])
        out["evidence_quotes"] = F.aggregate(every, none, lambda held, q: F.when(F.exists(held, lambda h: same(h, q)), F.transform(held, lambda h: F.when(same(h, q), q).otherwise(h))).otherwise(F.concat(held, F.array(q))))
    merged = both.select(*[F.when(new, out[c]).otherwise(F.col(f"base.{c}")).alias(c) if c in out and c not in keys else F.col(f"base.{c}").alias(c) for c in columns])
    return merged.unionByName(rest)


def check_transitions(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows whose status moved in a way that isn't allowed."""
    moved = before.select(key, F.col("status").alias("old")).join(after.select(key, F.col("status").alias("new")), key).where("old <> new")
    allowed = F.lit(False)
    for old, new in MOVES:
        allowed = allowed | ((F.col("old") == old) & (F.col("new") == new))
    return moved.where(~allowed)


def retract_evidence(facts: DataFrame, removed: DataFrame, key: str, now: Column, prefixes: list[str] | None = None) -> DataFrame:
    """Take ``removed(doc_id, private, event_time)`` out of proposed and active facts.

    A fact is retracted if nothing is left, or if a private document went and
    no quote that is left cites a document that is left; its open window then
    ends at the newest removed document's event time. Only touched facts are
    returned.
    """
    open_ = facts.where(F.col("status").isin("proposed", "active"))
    if prefixes is not None:
        match = F.lit(False)
        for p in prefixes:
            match = match | F.col("created_by").startswith(p)
        open_ = open_.where(match)
    cited = open_.select(key, F.explode(F.array_distinct("evidence_doc_ids")).alias("doc_id")).join(removed, "doc_id")
    gone = cited.groupBy(key).agg(F.collect_set("doc_id").alias("gone"), F.max("private").alias("private_gone"), F.max("event_time").alias("gone_at"))
    rows = open_.join(gone, key)
    left = F.array_except("evidence_doc_ids", "gone")
    quoted = F.exists("evidence_quotes", lambda q: F.array_contains(left, q["doc_id"])) if "evidence_quotes" in facts.columns else F.lit(False)
    retract = (F.size(left) == 0) | (F.col("private_gone") & ~quoted)
    return rows.withColumns({
        "evidence_doc_ids": left, "status": F.when(retract, "retracted").otherwise(F.col("status")),
        "valid_to": F.when(retract, F.coalesce("valid_to", "gone_at")).otherwise(F.col("valid_to")), "invalidated_at": F.when(retract, now).otherwise(F.col("invalidated_at")),
    }).drop("gone", "private_gone", "gone_at")


def strip_entity_evidence(entities: DataFrame, removed: DataFrame) -> DataFrame:
    cited = entities.select("entity_id", F.explode("evidence_doc_ids").alias("doc_id")).join(removed.select("doc_id"), "doc_id")
    gone = cited.groupBy("entity_id").agg(F.collect_set("doc_id").alias("gone"))
    return entities.join(gone, "entity_id", "left").withColumn("evidence_doc_ids", F.when(F.col("gone").isNull(), F.col("evidence_doc_ids")).otherwise(F.array_except("evidence_doc_ids", "gone"))).drop("gone")


def resolve_mentions(mentions: DataFrame, persons: DataFrame, entities: DataFrame) -> DataFrame:
    """``mentions(mention_id, name, type)``: exactly one person of that exact name, else exactly one entity (of the type, if given).

    Those who share a name are reduced to the smallest and largest id before
    they meet the mentions: there is exactly one where both are the same.
    """

    def ends(low: str, high: str, *more: Column) -> list[Column]:
        return [F.min(low).alias("low"), F.max(high).alias("high"), *more]

    wanted = mentions.withColumn("norm", normalize_name(F.col("name")))
    people = persons.where("merged_into_id is null").groupBy(normalize_name(F.col("display_name")).alias("norm")).agg(*ends("canonical_id", "canonical_id"))
    person = wanted.join(people, "norm").groupBy("mention_id").agg(*ends("low", "high")).where("low = high").select("mention_id", F.col("low").alias("person_id"))
    typed = entities.groupBy(normalize_name(F.col("name")).alias("norm"), F.col("entity_type").alias("of_type")).agg(*ends("entity_id", "entity_id", F.min("entity_type").alias("entity_type")))
    any_type = typed.groupBy("norm", F.lit(None).cast("string").alias("of_type")).agg(*ends("low", "high", F.min("entity_type").alias("entity_type")))
    things = typed.where("of_type is not null").unionByName(any_type).withColumnRenamed("norm", "of_norm")
    entity = wanted.join(things, (F.col("norm") == F.col("of_norm")) & F.col("type").eqNullSafe(F.col("of_type"))).groupBy("mention_id")
    entity = entity.agg(*ends("low", "high", F.min("entity_type").alias("entity_type"))).where("low = high").select("mention_id", F.col("low").alias("entity_id"), "entity_type")
    out = mentions.join(person, "mention_id", "left").join(entity, "mention_id", "left")
    kind = F.when(F.col("person_id").isNotNull(), "person").otherwise(F.col("entity_type"))
    return out.select("mention_id", kind.alias("subject_type"), F.coalesce("person_id", "entity_id").alias("subject_id"))


def seed_definitions(entities: DataFrame, claims: DataFrame, threshold: float = 0.8) -> DataFrame:
    """A definition claim for each described glossary entity that has none."""
    told = claims.where("predicate = 'definition' and status in ('active', 'proposed')").select(F.col("subject_id").alias("entity_id"))
    rows = entities.where((F.col("entity_type") == "glossary") & (F.length(F.trim("description")) >= 8)).join(told, "entity_id", "left_anti")
    confidence = F.least(F.lit(0.85), F.lit(threshold + 0.05))
    return rows.select("entity_id", F.lit("definition").alias("predicate"), F.trim("description").alias("object_text"), confidence.alias("confidence"), "evidence_doc_ids")


def upsert_entities(entities: DataFrame, incoming: DataFrame) -> DataFrame:
    """By type and normalised name: the first description that isn't empty, all evidence."""
    both = entities.withColumn("fresh", F.lit(0)).unionByName(incoming.withColumn("fresh", F.lit(1))).withColumn("normalized_name", normalize_name(F.col("name")))
    order = F.struct("fresh", "entity_id")
    return both.groupBy("entity_type", "normalized_name").agg(
        F.min_by("entity_id", order).alias("entity_id"), F.min_by("name", order).alias("name"),
        F.coalesce(F.min_by("description", F.when(F.col("description") != "", order)), F.lit("")).alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_doc_ids")))).alias("evidence_doc_ids"),
    )


def content_support(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """(claim_id, supported): title and text of every evidence document hold the value, in any case."""
    cited = claims.select("claim_id", F.lower("object_text").alias("value"), F.explode(F.array_distinct("evidence_doc_ids")).alias("doc_id"))
    texts = docs.select("doc_id", F.lower(F.concat_ws("\n", "title", "rendered_text")).alias("body"))
    held = cited.join(texts, "doc_id", "left").groupBy("claim_id").agg(F.bool_and(F.coalesce(F.contains("body", "value"), F.lit(False))).alias("held"))
    return claims.select("claim_id").join(held, "claim_id", "left").select("claim_id", F.coalesce("held", F.lit(False)).alias("supported"))


def pick_slot_winners(claims: DataFrame, docs: DataFrame, bindings: DataFrame) -> DataFrame:
    """The best claim of each subject, taxonomy and field: precedence, confidence, newest evidence, id."""
    rows = ranked(claims, docs).join(small(bindings), "predicate")
    return first_rows(rows, ["subject_id", "taxonomy_key", "field_key"], [F.desc("precedence"), F.desc("confidence"), F.col("newest").desc_nulls_last(), F.desc("claim_id")])


def generate_proposals(claims: DataFrame, docs: DataFrame, bindings: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Active claims with the reason why they are no proposal: unbound, low_confidence, no_evidence, stale_evidence; null where they are."""
    live = docs.where("not deleted").select("doc_id").withColumn("live", F.lit(True))
    cited = claims.select("claim_id", F.explode(F.array_distinct("evidence_doc_ids")).alias("doc_id")).join(live, "doc_id", "left")
    dead = cited.groupBy("claim_id").agg(F.count_if(F.col("live").isNull()).alias("dead"))
    rows = claims.where("status = 'active'").join(small(bindings), "predicate", "left").join(dead, "claim_id", "left")
    structured = F.col("created_by").startswith("structured_field")
    reason = (
        F.when(F.col("taxonomy_key").isNull(), "unbound").when(~structured & (F.col("confidence") < threshold), "low_confidence")
        .when(F.col("dead").isNull(), "no_evidence").when(F.col("dead") > 0, "stale_evidence")
    )
    return rows.withColumn("skip_reason", reason).drop("dead")


def upsert_proposals(proposals: DataFrame, winners: DataFrame) -> DataFrame:
    """Winners against pending proposals of their slot: the same value, claim and evidence raises confidence, else the old one is superseded."""
    slot = ["subject_id", "taxonomy_key", "field_key"]
    old = proposals.where("status = 'pending'").select(*slot, "proposal_id", "value_text", "source_claim_id", F.array_sort(F.array_distinct("evidence_doc_ids")).alias("docs"), "confidence")
    new = winners.select(*slot, F.col("claim_id").alias("n_claim"), F.col("object_text").alias("n_value"), F.array_sort(F.array_distinct("evidence_doc_ids")).alias("n_docs"), F.col("confidence").alias("n_confidence"))
    both = old.join(new, slot, "full_outer")
    same = (F.col("value_text") == F.col("n_value")) & (F.col("source_claim_id") == F.col("n_claim")) & (F.col("docs") == F.col("n_docs"))
    action = F.when(F.col("n_claim").isNull(), "kept").when(F.col("proposal_id").isNull(), "created").when(same, "raised").otherwise("superseded")
    confidence = F.when(action == "raised", F.greatest("confidence", "n_confidence")).otherwise(F.coalesce("n_confidence", "confidence"))
    return both.select(*slot, "proposal_id", action.alias("action"), F.coalesce("n_value", "value_text").alias("value_text"), F.coalesce("n_claim", "source_claim_id").alias("source_claim_id"), confidence.alias("confidence"))


def promote_claims(promotions: DataFrame, bindings: DataFrame, persons: DataFrame, docs: DataFrame, visible, now: Column) -> tuple[DataFrame, DataFrame]:
    """(claims, rejects) of ``promotions(promotion_id, viewer_id, subject_id, predicate, object_text, evidence_doc_ids)``.

    A promotion needs a bound predicate, a known person, evidence that its
    viewer sees whole, and documents that all hold the value; the claim is
    grounded at its newest evidence. The first rule that fails is the reason.
    """
    from factlake.operators.acl import seen_by

    rows = promotions.withColumn("claim_id", F.col("promotion_id"))
    seen = seen_by(rows, rows, visible, "claim_id").select("claim_id").withColumn("seen", F.lit(True))
    out = rows.join(small(bindings.select("predicate", "taxonomy_key")), "predicate", "left").join(persons.select(F.col("canonical_id").alias("subject_id")).withColumn("known", F.lit(True)), "subject_id", "left")
    out = out.join(seen, "claim_id", "left").join(content_support(rows, docs), "claim_id", "left").join(latest_evidence_time(rows, docs, "claim_id"), "claim_id", "left")
    reason = F.when(F.col("taxonomy_key").isNull(), "unbound").when(F.col("known").isNull(), "unknown_subject").when(F.col("seen").isNull(), "evidence_not_visible").when(~F.col("supported"), "unsupported")
    out = out.withColumn("reason", reason)
    claims = out.where("reason is null").select("claim_id", "subject_id", "predicate", "object_text", "evidence_doc_ids", F.coalesce("newest", now).alias("valid_from"), F.lit("active").alias("status"), F.concat(F.lit("agent_promote:"), "viewer_id").alias("created_by"))
    return claims, out.where("reason is not null").select("promotion_id", "reason")


def decide_proposals(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions(proposal_id, decision, decided_by)`` on pending proposals; outcome tells unknown and decided ones."""
    rows = decisions.join(proposals.select("proposal_id", "status"), "proposal_id", "left")
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "pending", "not_pending").when(F.col("decision") == "apply", "applied").otherwise("rejected")
    return rows.select("proposal_id", "decided_by", outcome.alias("outcome"))


#: What a model read out of one window of a document.
REF = "struct<type:string,name:string>"
TIMES = "valid_from:string,valid_to:string,time_expression:string,time_grain:string"
PARSED = (
    "doc_id string, window_id int, source_window string, entities array<struct<type:string,name:string,description:string,evidence_quote:string>>, "
    f"relationships array<struct<`from`:{REF},`to`:{REF},relationship_type:string,confidence:string,evidence_quote:string,{TIMES}>>, "
    f"claims array<struct<subject:{REF},predicate:string,object:string,confidence:string,evidence_quote:string,{TIMES}>>"
)
COUNTERS = ("entities", "relationships", "claims", "active_facts", "proposed_facts", "dropped_untyped", "dropped_unverifiable", "skipped_mentions", "malformed")


def _clean(column: str, lower: bool = True) -> Column:
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    return F.lower(text) if lower else text


def _resolved(rows: DataFrame, ref: str, persons: DataFrame, entities: DataFrame, entity_types: DataFrame) -> DataFrame:
    """``rows(item_id, .., ref)`` with ref_type, ref_id and the reason why there is none."""
    names = persons.where("merged_into_id is null").select(normalize_name(F.col("display_name")).alias("_norm"), F.col("canonical_id").alias("_person"))
    if "name_aliases" in persons.columns:
        names = names.unionByName(persons.where("merged_into_id is null").select(F.explode("name_aliases").alias("a"), F.col("canonical_id").alias("_person")).select(normalize_name(F.col("a")).alias("_norm"), "_person"))
    people = names.groupBy("_norm").agg(F.count_distinct("_person").alias("_n_people"), F.min("_person").alias("_person"))
    things = entities.select(normalize_name(F.col("name")).alias("_norm"), F.col("entity_type").alias("_kind"), "entity_id").distinct()
    typed = things.groupBy("_norm", "_kind").agg(F.count(F.lit(1)).alias("_n_typed"), F.min("entity_id").alias("_typed"))
    any_ = things.groupBy("_norm").agg(F.count(F.lit(1)).alias("_n_any"), F.min("entity_id").alias("_any"), F.min("_kind").alias("_any_kind"))
    kinds = small(entity_types.select(F.col("key").alias("_kind"), F.lit(True).alias("_known")))
    out = rows.withColumns({"_kind": _clean(f"{ref}.type"), "_norm": normalize_name(_clean(f"{ref}.name", False))})
    out = out.join(people, "_norm", "left").join(typed, ["_norm", "_kind"], "left").join(any_, "_norm", "left").join(kinds, "_kind", "left")
    person, loose = F.col("_kind") == "person", F.col("_kind").isin("", "entity")
    got = F.when(person, F.when(F.col("_n_people") == 1, F.col("_person"))).when(loose, F.when(F.col("_n_any") == 1, F.col("_any"))).when(F.col("_known"), F.when(F.col("_n_typed") == 1, F.col("_typed")))
    kind = F.when(loose, F.col("_any_kind")).otherwise(F.col("_kind"))
    why = F.when(F.col("_norm") == "", "empty").when(got.isNotNull(), None).when(~person & ~loose & F.col("_known").isNull(), "dropped_untyped").otherwise("skipped_mentions")
    got = F.when(F.col("_norm") != "", got)
    return out.withColumns({f"{ref}_id": got, f"{ref}_type": F.when(got.isNotNull(), kind), f"{ref}_why": why}).drop(*[c for c in out.columns if c.startswith("_")])


def apply_extractions(
    parsed: DataFrame, docs: DataFrame, predicates: DataFrame, edge_types: DataFrame, entity_types: DataFrame, persons: DataFrame, entities: DataFrame, threshold: float = 0.8,
    store: Callable[[DataFrame, str], DataFrame] = lambda df, _: df,
) -> dict[str, DataFrame]:
    """Entities, edges and claims of ``parsed`` (see PARSED), as rows to merge, and counters by document.

    ``predicates(predicate, subject_types)``, ``edge_types(relationship_type,
    from_types, to_types)``, ``entity_types(key)``; people are bound by exact
    name only, never created. Each item needs a quote that its window holds.
    An edge or claim of ends that its type doesn't take is dropped as untyped;
    a claim of an unknown predicate stays, proposed, by ``extraction:untyped``.
    A window of time that ends before it begins drops the fact. A described
    glossary entity without a definition in its window gets one. The
    confidence decides the status; one that isn't a number in 0 to 1 makes the
    item malformed. New entities come first, so edges may name them. ``store``
    (a table and its name to the table read back) may keep what is used again.
    """
    from factlake.functions.ranking import parse_confidence
    from factlake.functions.temporal import ground_times
    from factlake.functions.text import quote_supported

    windows = parsed.join(docs.where("not deleted").select("doc_id", "event_time"), "doc_id")

    def items(name: str) -> DataFrame:
        rows = windows.select("doc_id", "window_id", "source_window", "event_time", F.posexplode(name).alias("pos", "i"))
        item_id = F.concat_ws("#", "doc_id", "window_id", F.lit(name), "pos")
        held = F.coalesce(quote_supported(F.col("i.evidence_quote"), F.col("source_window")), F.lit(False))
        return rows.select("doc_id", "window_id", "event_time", "pos", item_id.alias("item_id"), held.alias("held"), "i.*")

    def timed(rows: DataFrame) -> DataFrame:
        start, end, grain, ok = ground_times(F.col("valid_from"), F.col("valid_to"), F.col("time_expression"), F.col("time_grain"), F.col("event_time"))
        rows = rows.withColumns({"at_from": start, "at_to": end, "at_grain": grain, "in_order": ok})
        return rows.withColumn("score", parse_confidence(F.col("confidence"))).withColumn("status", status_for_confidence(F.col("score"), threshold))

    quotes = F.array(F.struct("doc_id", F.col("evidence_quote").alias("quote")))
    kind, label = _clean("type"), _clean("name", False)
    things = items("entities").withColumns({"entity_type": kind, "label": label, "told": _clean("description", False)}).where("entity_type <> '' and label <> ''")
    things = things.join(small(entity_types.select(F.col("key").alias("entity_type"), F.lit(True).alias("known"))), "entity_type", "left")
    things = things.withColumn("why", F.when(F.col("entity_type") == "person", "skipped_mentions").when(F.col("known").isNull(), "dropped_untyped").when(~F.col("held"), "dropped_unverifiable").otherwise("entities"))
    new = things.where("why = 'entities'").select(F.concat(F.lit("x:"), F.sha2(F.concat_ws("|", "entity_type", normalize_name(F.col("label"))), 256)).alias("entity_id"), "entity_type", F.col("label").alias("name"), F.col("told").alias("description"), F.array("doc_id").alias("evidence_doc_ids"))
    merged = store(upsert_entities(entities.select(new.columns), new), "entities")

    edges = timed(items("relationships")).withColumnsRenamed({"from": "source", "to": "target"}).withColumn("relationship_type", _clean("relationship_type"))
    for end in ("source", "target"):
        edges = _resolved(edges, end, persons, merged, entity_types)
    edges = edges.join(small(edge_types.select("relationship_type", "from_types", "to_types")), "relationship_type", "left")
    fits = F.array_contains("from_types", F.col("source_type")) & F.array_contains("to_types", F.col("target_type"))
    found = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    edges = edges.withColumn("why", F.when(~F.col("held"), "dropped_unverifiable").when(~found | (F.col("relationship_type") == ""), "unresolved").when(~F.coalesce(fits, F.lit(False)), "dropped_untyped").when(F.col("score").isNull(), "malformed").when(~F.col("in_order"), "dropped_unverifiable").otherwise("relationships"))
    edges = store(edges, "edges")

    facts = timed(items("claims")).withColumns({"predicate": _clean("predicate"), "value": _clean("object", False)})
    facts = _resolved(facts, "subject", persons, merged, entity_types).join(small(predicates.select("predicate", "subject_types")), "predicate", "left")
    typed = F.col("subject_types").isNotNull()
    facts = facts.withColumn("why", F.when(~F.col("held"), "dropped_unverifiable").when(F.col("subject_id").isNull() | (F.col("predicate") == "") | (F.col("value") == ""), "unresolved").when(~F.col("in_order"), "dropped_unverifiable").when(F.col("score").isNull(), "malformed").when(typed & ~F.array_contains("subject_types", F.col("subject_type")), "dropped_untyped").otherwise("claims"))
    facts = store(facts.withColumns({"untyped": ~typed & (F.col("why") == "claims"), "status": F.when(typed, F.col("status")).otherwise("proposed")}), "facts")

    shared = [F.col("score").alias("confidence"), "status", F.array("doc_id").alias("evidence_doc_ids"), quotes.alias("evidence_quotes"), F.col("at_from").alias("valid_from"), F.col("at_to").alias("valid_to"), F.col("at_grain").alias("time_grain"), F.col("event_time").alias("created_at")]
    claims = facts.where("why = 'claims'").select(F.col("item_id").alias("claim_id"), "subject_type", "subject_id", "predicate", F.col("value").alias("object_text"), *shared, F.when(F.col("untyped"), "extraction:untyped").otherwise("extraction").alias("created_by"))
    rels = edges.where("why = 'relationships'").select(F.col("item_id").alias("relationship_id"), F.col("source_type").alias("from_type"), F.col("source_id").alias("from_id"), "relationship_type", F.col("target_type").alias("to_type"), F.col("target_id").alias("to_id"), *shared, F.lit("extraction").alias("created_by"))

    defined = items("claims").where(_clean("predicate") == "definition").select("doc_id", "window_id", normalize_name(_clean("subject.name", False)).alias("norm")).distinct()
    ids = merged.where("entity_type = 'glossary'").select("entity_id", F.col("normalized_name").alias("norm"))
    seeds = things.where("why = 'entities' and entity_type = 'glossary' and length(told) >= 8").withColumn("norm", normalize_name(F.col("label"))).join(defined, ["doc_id", "window_id", "norm"], "left_anti").join(ids, "norm")
    sure = F.least(F.lit(0.85), F.lit(threshold + 0.05))
    seeds = seeds.withColumns({"score": sure, "status": status_for_confidence(sure, threshold), "at_from": F.col("event_time"), "at_to": F.lit(None).cast("timestamp_ntz"), "at_grain": F.lit("day")})
    seeded = seeds.select(F.concat("item_id", F.lit("#seed")).alias("claim_id"), F.lit("glossary").alias("subject_type"), F.col("entity_id").alias("subject_id"), F.lit("definition").alias("predicate"), F.col("told").alias("object_text"), *shared, F.lit("extraction:glossary_seed").alias("created_by"))

    told = things.select("doc_id", "why").unionByName(edges.select("doc_id", "why")).unionByName(facts.select("doc_id", "why")).unionByName(facts.where("untyped").select("doc_id", F.lit("dropped_untyped").alias("why")))
    refs = [edges.where("held").select("doc_id", F.col(f"{e}_why").alias("why")) for e in ("source", "target")] + [facts.where("held").select("doc_id", F.col("subject_why").alias("why"))]
    for more in [*refs, seeded.select(F.col("evidence_doc_ids")[0].alias("doc_id"), F.lit("claims").alias("why")), *[x.select(F.col("evidence_doc_ids")[0].alias("doc_id"), F.concat("status", F.lit("_facts")).alias("why")) for x in (claims, rels, seeded)]]:
        told = told.unionByName(more)
    counters = told.groupBy("doc_id").agg(*[F.count_if(F.col("why") == c).alias(c) for c in COUNTERS])
    return {"entities": merged, "relationships": rels, "claims": claims.unionByName(seeded), "counters": counters}
