"""Who may see what: any-visible documents, all-visible facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.functions.text import escape_like
from factlake.operators.common import SMALL, small
from factlake.operators.store import save

#: Rows whose evidence a task gathers on average.
TASK_ROWS = 200_000


@dataclass
class Visible:
    """Documents that everyone sees, and (viewer_id, doc_id) of the private ones.

    Public documents are never paired with viewers, so the table grows with
    what is private and shared, not with documents times viewers.
    """

    public: DataFrame
    private: DataFrame

    def pairs(self, viewers: DataFrame) -> DataFrame:
        """All (viewer_id, doc_id); for reports on a few viewers."""
        return self.public.join(small(viewers.select("viewer_id")), how="cross").select("viewer_id", "doc_id").unionByName(self.private)


def visible_docs(docs: DataFrame, viewers: DataFrame) -> Visible:
    """Live documents that are open to the organisation or name one of a viewer's principals."""
    live = docs.where("not deleted")
    named = live.where("not org_visible").select("doc_id", F.explode("allowed_principals").alias("principal"))
    holders = viewers.select("viewer_id", F.explode("principals").alias("principal"))
    return Visible(live.where("org_visible").select("doc_id"), named.join(holders, "principal").select("viewer_id", "doc_id").distinct())


def all_visible(facts: DataFrame, visible: Visible, key: str) -> tuple[DataFrame, DataFrame]:
    """Facts with evidence that is seen whole: (key) by everyone, (key, viewer_id) by one viewer.

    A fact needs at least one evidence document; one that is dead or unknown
    hides it. Documents named twice count once.
    """
    cited = facts.select(key, F.explode(F.array_distinct("evidence_doc_ids")).alias("doc_id"))
    cited = cited.join(visible.public.withColumn("public", F.lit(True)), "doc_id", "left")
    closed = cited.groupBy(key).agg(F.count_if(F.col("public").isNull()).alias("closed"))
    seen = cited.where("public is null").join(visible.private, "doc_id").groupBy(key, "viewer_id").agg(F.count(F.lit(1)).alias("seen"))
    own = seen.join(closed, key).where("seen = closed").select(key, "viewer_id")
    return closed.where("closed = 0").select(key), own


def _evidence() -> Column:
    """The set of documents; null counts as none, which no one sees, so that a join by it needs no look for nulls before."""
    return F.coalesce(F.sort_array(F.array_distinct("evidence_doc_ids")), F.array().cast("array<string>"))


def judged(facts: DataFrame, visible: Visible, ids: DataFrame | None = None) -> DataFrame:
    """(_evidence, _viewer): the sets of documents that ``facts`` cite, and who (of ``ids``) sees each whole; viewer null: everyone.

    Facts that cite the same documents are judged once, so rows that carry
    their evidence meet as many sets as there are, and aren't grouped by fact.
    """
    sets = save(facts.select(_evidence().alias("evidence_doc_ids")).distinct().withColumn("_set", F.monotonically_increasing_id()))
    everyone, own = all_visible(sets, visible, "_set")
    own = own if ids is None else own.join(small(ids), "viewer_id", "left_semi")
    seen = own.withColumnRenamed("viewer_id", "_viewer").unionByName(everyone.withColumn("_viewer", F.lit(None).cast("string")))
    return small(save(sets.join(seen, "_set").select(F.col("evidence_doc_ids").alias("_evidence"), "_viewer")))


def with_readers(facts: DataFrame, visible: Visible) -> DataFrame:
    """``facts``, judged by the evidence they carry, with a viewer_id that sees it whole, once for each; null, once, where everyone does."""
    return facts.withColumn("_evidence", _evidence()).join(judged(facts, visible), "_evidence").drop("_evidence").withColumnRenamed("_viewer", "viewer_id")


def _carried(rows: DataFrame | None, facts: DataFrame) -> bool:
    """Whether ``rows`` aren't the facts themselves, and carry the evidence of theirs."""
    return rows is not None and rows is not facts and "evidence_doc_ids" in rows.columns


def seen_by(rows: DataFrame, facts: DataFrame, visible: Visible, key: str) -> DataFrame:
    """The rows (with viewer_id and key) whose fact their viewer sees whole; rows that carry evidence_doc_ids are judged by these."""
    if _carried(rows, facts):
        rows = rows.withColumn("_own", _evidence())
        fits = (F.col("_own") == F.col("_evidence")) & (F.col("_viewer").isNull() | (F.col("_viewer") == F.col("viewer_id")))
        return rows.join(judged(facts, visible), fits, "left_semi").drop("_own")
    everyone, own = all_visible(facts, visible, key)
    own = own.unionByName(everyone.withColumn("viewer_id", F.lit(None).cast("string")))
    # A fact is in one part only, so no row doubles.
    own = own.withColumnsRenamed({key: "_key", "viewer_id": "_viewer"})
    return rows.join(own, (F.col(key) == F.col("_key")) & (F.col("_viewer").isNull() | (F.col("_viewer") == F.col("viewer_id"))), "left_semi")


def for_viewers(facts: DataFrame, visible: Visible, key: str, viewers: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``rows`` (or the facts themselves), once for each viewer who sees the fact's evidence whole.

    Access comes first: what everyone sees is paired with the viewers, what is
    private only with its own. ``rows`` that carry evidence_doc_ids are judged
    by these, and read once where the viewers are few.
    """
    ids = viewers.select("viewer_id").distinct()
    if _carried(rows, facts):
        met = rows.withColumn("_evidence", _evidence()).join(judged(facts, visible, ids), "_evidence").drop("_evidence")
        if ids.limit(SMALL + 1).count() <= SMALL:
            every = F.broadcast(ids.agg(F.collect_list("viewer_id").alias("_every")))
            who = F.when(F.col("_viewer").isNull(), F.col("_every")).otherwise(F.array("_viewer"))
            return met.join(every, how="cross").select(*rows.columns, F.explode(who).alias("viewer_id"))
        public = met.where("_viewer is null").drop("_viewer").join(ids, how="cross")
        return public.unionByName(met.where("_viewer is not null").withColumnRenamed("_viewer", "viewer_id").select(public.columns))
    rows = facts if rows is None else rows
    everyone, own = all_visible(facts, visible, key)
    public = rows.join(everyone, key, "left_semi").join(small(ids), how="cross")
    private = rows.join(own.join(small(ids), "viewer_id", "left_semi"), key)
    return public.unionByName(private.select(public.columns))


def visible_evidence(rows: DataFrame, visible: Visible, key: str) -> DataFrame:
    """``rows(viewer_id, key, evidence_doc_ids)`` with the ids that the viewer sees, in order."""
    cited = rows.select("viewer_id", key, F.posexplode("evidence_doc_ids").alias("pos", "doc_id"))
    public = cited.join(visible.public, "doc_id", "left_semi")
    private = cited.join(visible.private, ["viewer_id", "doc_id"], "left_semi")
    kept = public.select("viewer_id", key, "pos", "doc_id").unionByName(private.select("viewer_id", key, "pos", "doc_id"))
    # Tasks grow in number, not in size: both sides are dealt alike, so neither the grouping nor the join shuffles again.
    parts = -(-rows.count() // TASK_ROWS)
    if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows, kept = (part.repartition(parts, "viewer_id", key) for part in (rows, kept))
    kept = kept.groupBy("viewer_id", key).agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))).alias("kept"))
    kept = kept.select("viewer_id", key, F.col("kept.doc_id").alias("visible_doc_ids"))
    out = rows.join(kept, ["viewer_id", key], "left")
    return out.withColumn("visible_doc_ids", F.coalesce("visible_doc_ids", F.array().cast("array<string>")))


def redact_quotes(quotes: Column, visible_ids: Column) -> Column:
    return F.filter(quotes, lambda q: F.array_contains(visible_ids, q["doc_id"]))


@dataclass
class FilterSpec:
    """Optional filters; only those that are set become predicates."""

    source_types: list[str] | None = None
    source_systems: list[str] | None = None
    author_patterns: list[str] | None = None
    author_person: str | None = None
    about_person: str | None = None
    doc_ids: list[str] | None = None
    event_from: object | None = None
    event_to: object | None = None
    updated_from: object | None = None
    updated_to: object | None = None


def document_filters(docs: DataFrame, spec: FilterSpec, participants: DataFrame | None = None) -> DataFrame:
    out = docs
    for column, values in (("source_type", spec.source_types), ("source_system", spec.source_systems), ("doc_id", spec.doc_ids)):
        if values is not None:
            out = out.where(F.col(column).isin(*values))
    if spec.author_patterns is not None:
        match = F.lit(False)
        for pattern in spec.author_patterns:
            match = match | F.ilike("author_display_name", F.concat(F.lit("%"), escape_like(F.lit(pattern)), F.lit("%")))
        out = out.where(match)
    for column, low, high in (("event_time", spec.event_from, spec.event_to), ("updated_at", spec.updated_from, spec.updated_to)):
        if low is not None:
            out = out.where(F.col(column) >= low)
        if high is not None:
            out = out.where(F.col(column) <= high)
    if spec.author_person is not None:
        own = participants.where((F.col("role") == "author") & (F.col("person_id") == spec.author_person))
        out = out.join(own.select("doc_id"), "doc_id", "left_semi")
    if spec.about_person is not None:
        out = out.join(participants.where(F.col("person_id") == spec.about_person).select("doc_id"), "doc_id", "left_semi")
    return out


def person_evidence(participants: DataFrame, visible: Visible) -> DataFrame:
    """(viewer_id, person_id, doc_id) of visible documents that a person takes part in; viewer null: everyone."""
    own = participants.select("person_id", "doc_id").distinct()
    public = own.join(visible.public, "doc_id", "left_semi").select(F.lit(None).cast("string").alias("viewer_id"), "person_id", "doc_id")
    return public.unionByName(own.join(visible.private, "doc_id").select("viewer_id", "person_id", "doc_id"))


def node_labels(nodes: DataFrame, persons: DataFrame, entities: DataFrame, visible: Visible) -> DataFrame:
    """``nodes(viewer_id, node_type, node_id)`` with a name where the viewer may know it, else type:id."""
    people = persons.select(F.lit("person").alias("node_type"), F.col("canonical_id").alias("node_id"), F.col("display_name").alias("label"))
    everyone, own = all_visible(entities, visible, "entity_id")
    names = entities.select("entity_id", F.col("entity_type").alias("node_type"), F.col("name").alias("label"))
    public = names.join(everyone, "entity_id").select("node_type", F.col("entity_id").alias("node_id"), "label")
    known = people.unionByName(public)
    private = names.join(own, "entity_id").select("viewer_id", "node_type", F.col("entity_id").alias("node_id"), F.col("label").alias("own_label"))
    out = nodes.join(known, ["node_type", "node_id"], "left").join(private, ["viewer_id", "node_type", "node_id"], "left")
    opaque = F.concat_ws(":", "node_type", "node_id")
    return out.select("viewer_id", "node_type", "node_id", F.coalesce("label", "own_label", opaque).alias("label"))


def read_sources(requests: DataFrame, docs: DataFrame, chunks: DataFrame, visible: Visible) -> DataFrame:
    """Per ``requests(viewer_id, doc_id)``: ok, not_found or forbidden, and the passages in order (parents, else children)."""
    known = docs.where("not deleted").select("doc_id").withColumn("known", F.lit(True))
    public = visible.public.withColumn("public", F.lit(True))
    private = visible.private.withColumn("own", F.lit(True))
    out = requests.join(known, "doc_id", "left").join(public, "doc_id", "left").join(private, ["viewer_id", "doc_id"], "left")
    status = F.when(F.col("known").isNull(), "not_found").when(F.coalesce("public", "own").isNull(), "forbidden").otherwise("ok")
    order = F.when(F.col("chunk_role") == "parent", 0).otherwise(1)
    per_role = chunks.groupBy("doc_id", order.alias("rank")).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("passages"))
    passages = per_role.groupBy("doc_id").agg(F.min_by("passages", "rank").alias("passages"))
    out = out.join(passages, "doc_id", "left")
    return out.select("viewer_id", "doc_id", status.alias("status"), F.when(status == "ok", F.col("passages.text")).alias("passages"))


def require_visible_evidence(rows: DataFrame, visible: Visible, key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): every cited document must exist and be seen by the row's viewer; none cited is rejected."""
    ok = seen_by(rows, rows, visible, key)
    return ok, rows.join(ok.select(key, "viewer_id"), [key, "viewer_id"], "left_anti")
