"""The change feed: validation, documents, access lists, versions, passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.identity import valid_principal
from factlake.functions.text import content_hash, doc_id
from factlake.operators.common import first_rows, small

#: The oldest year of an event.
FIRST_YEAR = 1990
#: Errors that a source's report lists at most.
LAST_ERRORS = 20


def validate_envelopes(env: DataFrame, now: Column, principals: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows carry the first reason that applies."""
    private = (F.col("change_kind") != "delete") & ~F.col("org_visible") & (F.coalesce(F.size("allowed_principals"), F.lit(0)) <= 0)
    reason = F.when(F.col("event_time").isNull(), "no_event_time").when(F.year("event_time") < FIRST_YEAR, "too_old").when(F.col("event_time") > now + F.expr("interval '1' day"), "in_future")
    if principals:
        reason = reason.when(F.exists("allowed_principals", lambda p: ~F.coalesce(valid_principal(p), F.lit(False))), "bad_principal")
    rows = env.withColumn("reason", reason.when(private, "private_without_principals"))
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def with_ids(env: DataFrame) -> DataFrame:
    return env.withColumns({"doc_id": doc_id(F.col("source_system"), F.col("external_id")), "text_hash": content_hash(F.coalesce("text", F.lit("")))})


def content_events(env: DataFrame) -> DataFrame:
    """Creates and updates in order of arrival, each accepted if it isn't older than all accepted before it.

    The running maximum over earlier content events decides, so a document's
    events need no state but their order.
    """
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = env.where(F.col("change_kind").isin("create", "update"))
    newest = F.max("event_time").over(before)
    return rows.withColumn("accepted", newest.isNull() | (F.col("event_time") >= newest))


def apply_documents(env: DataFrame) -> DataFrame:
    """Current state per document: the last accepted content, and whether a delete arrived after it."""
    content = content_events(env)
    last = first_rows(content.where("accepted"), ["doc_id"], [F.desc("seq")])
    counts = content.groupBy("doc_id").agg(F.count_if(~F.col("accepted")).alias("skipped_stale"), F.min("seq").alias("first_seq"))
    deletes = env.where("change_kind = 'delete'").join(counts.select("doc_id", "first_seq"), "doc_id").where("seq > first_seq").groupBy("doc_id").agg(F.max("seq").alias("deleted_seq"))
    out = last.join(counts.drop("first_seq"), "doc_id").join(deletes, "doc_id", "left")
    return out.select("doc_id", "seq", "event_time", "text_hash", "skipped_stale", F.coalesce(F.col("deleted_seq") > F.col("seq"), F.lit(False)).alias("deleted"))


def feed_errors(env: DataFrame) -> DataFrame:
    """Deletes and access changes of documents that aren't known yet."""
    first = env.where(F.col("change_kind").isin("create", "update")).groupBy("doc_id").agg(F.min("seq").alias("first_seq"))
    rows = env.where(F.col("change_kind").isin("delete", "permission_change")).join(first, "doc_id", "left")
    return rows.where("first_seq is null or seq < first_seq").select("seq", "doc_id", "change_kind")


def apply_acl(env: DataFrame, strict: bool = False) -> DataFrame:
    """Access list per document, by its own clock, folded in order of arrival.

    A content event sets the list if it isn't older than the list's clock; the
    clock and version move only if the list differs (``strict``: the clock
    always). A permission event that isn't older always moves both. A
    document's events meet in one array, as its history does in the feed.
    """
    event = F.struct("seq", "change_kind", "event_time", F.col("org_visible").alias("visible"), F.array_sort(F.array_distinct("allowed_principals")).alias("principals"))
    folded = env.where("change_kind <> 'delete'").groupBy("doc_id").agg(F.array_sort(F.collect_list(event)).alias("events"))
    start = "cast(null as struct<t: timestamp_ntz, acl_t: timestamp_ntz, visible: boolean, principals: array<string>, version: bigint>)"
    moved = "true" if strict else "not (e.visible <=> s.visible and e.principals <=> s.principals)"
    fold = f"""aggregate(events, {start}, (s, e) ->
      case when s is null then case when e.change_kind = 'permission_change' then s else named_struct('t', e.event_time, 'acl_t', e.event_time, 'visible', e.visible, 'principals', e.principals, 'version', 1L) end
      when e.change_kind = 'permission_change' then case when e.event_time < s.acl_t then s else named_struct('t', s.t, 'acl_t', e.event_time, 'visible', e.visible, 'principals', e.principals, 'version', s.version + 1) end
      when e.event_time < s.t then s
      when e.event_time < s.acl_t then named_struct('t', e.event_time, 'acl_t', s.acl_t, 'visible', s.visible, 'principals', s.principals, 'version', s.version)
      when {moved} then named_struct('t', e.event_time, 'acl_t', e.event_time, 'visible', e.visible, 'principals', e.principals,
        'version', s.version + case when e.visible <=> s.visible and e.principals <=> s.principals then 0 else 1 end)
      else named_struct('t', e.event_time, 'acl_t', s.acl_t, 'visible', s.visible, 'principals', s.principals, 'version', s.version) end)"""
    out = folded.withColumn("state", F.expr(fold)).where("state is not null")
    return out.select("doc_id", F.col("state.visible").alias("org_visible"), F.col("state.principals").alias("allowed_principals"), F.col("state.acl_t").alias("acl_event_time"), F.col("state.version").alias("acl_version"))


def append_versions(versions: DataFrame, env: DataFrame) -> DataFrame:
    """New (doc_id, text_hash) of content events that ``versions`` doesn't have; the first arrival of each."""
    fresh = first_rows(env.where(F.col("change_kind").isin("create", "update")), ["doc_id", "text_hash"], [F.col("seq")])
    return fresh.join(versions.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_anti").select("doc_id", "text_hash", "event_time", "seq")


def replace_chunks(old: DataFrame, new: DataFrame, model: str) -> DataFrame:
    """New passages with the old vector where document, text hash and model agree."""
    have = old.where((F.col("chunk_role") == "child") & (F.col("embedding_model") == model) & F.col("embedding").isNotNull())
    have = first_rows(have, ["doc_id", "content_hash"], [F.desc("chunk_id")]).select("doc_id", "content_hash", F.col("embedding").alias("carried"))
    return new.join(have, ["doc_id", "content_hash"], "left").withColumn("is_carried", F.col("carried").isNotNull())


def sync_chunk_metadata(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Passages of live documents with the document's current columns."""
    now = docs.where("not deleted").select("doc_id", F.col("title").alias("d_title"), F.col("source_type").alias("d_type"), F.col("updated_at").alias("d_updated"))
    return chunks.join(now, "doc_id").withColumns({"title": F.col("d_title"), "source_type": F.col("d_type"), "updated_at": F.col("d_updated")}).drop("d_title", "d_type", "d_updated")


def explode_participants(env: DataFrame) -> DataFrame:
    """Author (with the old fields) and participants of each document's last content event as rows."""
    last = first_rows(env.where(F.col("change_kind").isin("create", "update")), ["doc_id"], [F.desc("seq")])
    author = F.struct(F.lit("author").alias("role"), F.col("author_external_id").alias("external_id"), F.col("author_display_name").alias("display_name"))
    people = F.concat(F.when(F.col("author_external_id").isNotNull(), F.array(author)).otherwise(F.array().cast("array<struct<role:string,external_id:string,display_name:string>>")), F.coalesce("participants", F.array().cast("array<struct<role:string,external_id:string,display_name:string>>")))
    return last.select("doc_id", "source_system", F.posexplode(people).alias("position", "p")).select("doc_id", "source_system", "position", "p.*")


def connector_status(accepted: DataFrame, failures: DataFrame) -> DataFrame:
    """Per source: last arrival and event, accepted and failed totals, the last error and the last few."""
    good = accepted.groupBy("source_system").agg(F.max("arrived_at").alias("last_arrival"), F.max("event_time").alias("last_event"), F.count(F.lit(1)).alias("accepted"))
    newest = first_rows(failures, ["source_system"], [F.desc("seq")], LAST_ERRORS)
    listed = newest.groupBy("source_system").agg(F.reverse(F.array_sort(F.collect_list(F.struct("seq", "reason")))).alias("errors"))
    totals = failures.groupBy("source_system").agg(F.count(F.lit(1)).alias("failed"))
    out = good.join(totals, "source_system", "full_outer").join(listed, "source_system", "left")
    return out.select("source_system", "last_arrival", "last_event", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("failed", F.lit(0)).alias("failed"), F.col("errors")[0]["reason"].alias("last_error"), F.col("errors.reason").alias("last_errors"))


def structured_claims(fields: DataFrame, bindings: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, rejects) of ``fields(doc_id, source_system, author_external_id, key, value, value_type, event_time)``.

    A claim needs a bound key and an author who is a known person; booleans
    print as true and false; an empty value is marked as a retraction.
    """
    person = aliases.groupBy("source_system", "external_id").agg(F.min("person_id").alias("person_id"))
    rows = fields.join(small(bindings), "key", "left").join(person, (fields["source_system"] == person["source_system"]) & (F.col("author_external_id") == F.col("external_id")), "left").drop(person["source_system"])
    reason = F.when(F.col("predicate").isNull(), "unbound_key").when(F.col("person_id").isNull(), "unknown_author")
    value = F.when(F.col("value_type") == "boolean", F.lower("value")).otherwise(F.col("value"))
    rows = rows.withColumn("reason", reason)
    claims = rows.where("reason is null").select("doc_id", F.col("person_id").alias("subject_id"), "predicate", value.alias("object_text"), F.lit(1.0).alias("confidence"), F.lit("active").alias("status"), F.lit("structured_field:ground_truth").alias("created_by"), F.col("event_time").alias("valid_from"), (F.trim(value) == "").alias("retracts"))
    return claims, rows.where("reason is not null").select("doc_id", "key", "reason")


def content_changed(docs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Documents to cut and embed again: new, deleted before, or with another title or text."""
    old = docs.select("doc_id", F.col("title").alias("o_title"), F.col("rendered_text").alias("o_text"), F.col("deleted").alias("o_deleted"))
    rows = incoming.join(old, "doc_id", "left")
    reason = F.when(F.col("o_deleted").isNull(), "new").when(F.col("o_deleted"), "revived").when(~F.col("title").eqNullSafe(F.col("o_title")), "title").when(~F.col("rendered_text").eqNullSafe(F.col("o_text")), "text")
    return rows.withColumn("reason", reason).where("reason is not null").select("doc_id", "reason")


def merge_metadata(connector: Column, verified: Column, fields: Column) -> Column:
    """Connector metadata, the verified flag and structured fields (array of key, value) in one map; later keys win."""
    extra = F.map_from_entries(F.transform(fields, lambda f: F.struct(f["key"].alias("key"), f["value"].cast("string").alias("value"))))
    first = F.map_filter(F.coalesce(connector, F.create_map().cast("map<string,string>")), lambda k, _: (k != "author_email_verified") & ~F.array_contains(F.map_keys(extra), k))
    own = F.create_map(F.lit("author_email_verified"), verified.cast("string"))
    return F.map_concat(first, F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(extra), k)), extra)


def attach_embeddings(chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attached, stale): vectors go to live children without one whose text is still the same."""
    waiting = chunks.where("chunk_role = 'child' and embedding is null").select("chunk_id", "content_hash", "doc_id")
    attached = waiting.join(vectors, ["chunk_id", "content_hash"])
    return attached, vectors.join(waiting, ["chunk_id", "content_hash"], "left_anti")
