"""Identity resolution and the collaboration graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.identity import normalize_email
from factlake.functions.text import normalize_name
from factlake.operators.acl import Visible, for_viewers
from factlake.operators.common import first_rows, paired, sorted_set
from factlake.operators.search import SAME_MODEL, dot, model, norm
from factlake.operators.vector_index import VectorIndex

#: Similarity and number of candidates; thresholds of a merge.
SIMILAR, MOST_CANDIDATES, NAME_CANDIDATES, VERY_SIMILAR, SURE = 0.88, 3, 5, 0.95, 0.95
#: Weight of a role, of a public document, half-life in days.
ROLE_WEIGHTS = {"author": 1.0, "to": 0.9, "participant": 0.8, "reviewer": 0.7, "cc": 0.5}
OTHER_ROLE, PUBLIC_FACTOR, HALF_LIFE = 0.6, 0.25, 90.0


def person_descriptor(persons: DataFrame, aliases: DataFrame) -> DataFrame:
    """Identity text of each person: its aliases in order, else its name."""
    parts = aliases.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("source_system", "external_id", "display_name", "email"))).alias("a"))
    text = F.array_join(F.transform("a", lambda x: F.concat_ws(" ", x["source_system"], x["external_id"], x["display_name"], x["email"])), " | ")
    return persons.join(parts, F.col("canonical_id") == F.col("person_id"), "left").select("canonical_id", F.coalesce(text, "display_name").alias("descriptor"))


def match_identities(identities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``identities(identity_id, kind, source_system, external_id, email, email_verified)`` to a person: by source id, then by verified mail; else new."""
    rows = identities.where("kind = 'person'").withColumn("mail", F.when(F.col("email_verified"), normalize_email(F.col("email"))))
    by_source = aliases.groupBy("source_system", "external_id").agg(F.min("person_id").alias("by_source"))
    by_mail = aliases.where("email_verified").groupBy(normalize_email(F.col("email")).alias("mail")).agg(F.min("person_id").alias("by_mail"))
    out = rows.join(by_source, ["source_system", "external_id"], "left").join(by_mail, "mail", "left")
    how = F.when(F.col("by_source").isNotNull(), "source").when(F.col("by_mail").isNotNull(), "email").otherwise("new")
    return out.select("identity_id", F.coalesce("by_source", "by_mail").alias("person_id"), how.alias("matched_by"))


def upsert_aliases(aliases: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row a person, source and id; a changed mail leaves a history row; verified stays verified."""
    keys = ["person_id", "source_system", "external_id"]
    new = incoming.select(*keys, F.col("email").alias("n_email"), F.col("display_name").alias("n_name"), F.col("email_verified").alias("n_verified"))
    both = aliases.join(new, keys, "full_outer")
    same = normalize_email(F.col("email")).eqNullSafe(normalize_email(F.col("n_email")))
    current = both.select(*keys, F.coalesce("n_name", "display_name").alias("display_name"), F.coalesce("n_email", "email").alias("email"), (F.coalesce("n_verified", F.lit(False)) | (F.coalesce("email_verified", F.lit(False)) & (same | F.col("n_email").isNull()))).alias("email_verified"), F.lit(False).alias("history"))
    old = both.where(F.col("n_email").isNotNull() & F.col("email").isNotNull() & ~same)
    return current.unionByName(old.select(*keys, "display_name", "email", "email_verified", F.lit(True).alias("history")))


def name_candidates(persons: DataFrame, aliases: DataFrame, most: int = NAME_CANDIDATES) -> DataFrame:
    """Unordered pairs of roots that share a normalised name; a name that many carry gives each person the next few by id.

    Names are blocks; a pair is an equi-join of neighbours in the block's
    order, so a common name gives ``most`` pairs a person, not all pairs.
    """
    roots = persons.where("merged_into_id is null")
    names = roots.select(F.col("canonical_id").alias("id"), normalize_name(F.col("display_name")).alias("name")).unionByName(
        aliases.join(roots.select(F.col("canonical_id").alias("person_id")), "person_id", "left_semi").select(F.col("person_id").alias("id"), normalize_name(F.col("display_name")).alias("name"))
    ).distinct()
    w = Window.partitionBy("name").orderBy("id")
    near = names.withColumn("others", F.array(*[F.lead("id", k).over(w) for k in range(1, most + 1)]))
    rows = near.select("id", F.explode("others").alias("other")).where("other is not null")
    return rows.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def embedding_candidates(vectors: DataFrame, queries: DataFrame, least: float = SIMILAR, most: int = MOST_CANDIDATES, persons: DataFrame | None = None, index: VectorIndex | None = None) -> DataFrame:
    """The few people at least so similar to each of ``queries(id, embedding)``, by vectors of the same length and, where both tables name it, model.

    Merged people of ``persons`` are no candidates and ask nothing. With an
    ``index`` (of ``person_index``, of the same persons) only lists that can
    hold a nearer person are read; without one, all vectors are compared.
    """
    if persons is not None:
        roots = persons.where("merged_into_id is null").select(F.col("canonical_id").alias("id"))
        vectors, queries = vectors.join(roots, "id", "left_semi"), queries.join(roots, "id", "left_semi")
    asked = queries.select(F.col("id").alias("query_id"), F.col("id").alias("q_id"), F.col("embedding").alias("q"), norm("embedding").alias("q_norm"), model(queries).alias("q_model"))
    if index is not None:
        found = index.search(queries.withColumnRenamed("id", "query_id"), None, most + 1)
        rows = found.select(F.col("query_id").alias("q_id"), F.col("key").alias("id"), "similarity").where((F.col("id") != F.col("q_id")) & (F.col("similarity") >= least))
        return first_rows(rows, ["q_id"], [F.desc(F.round("similarity", 9)), F.col("id")], most, "rank")
    rows = vectors.select("id", F.col("embedding").alias("v"), norm("embedding").alias("v_norm"), model(vectors).alias("v_model"))
    rows = paired(rows, asked, (F.col("id") != F.col("q_id")) & (F.size("v") == F.size("q")) & F.expr(SAME_MODEL))
    rows = rows.withColumn("similarity", dot("v", "q") / (F.col("v_norm") * F.col("q_norm"))).where(F.col("similarity") >= least)
    return first_rows(rows.select("q_id", "id", "similarity"), ["q_id"], [F.desc(F.round("similarity", 9)), F.col("id")], most, "rank")


def person_index(vectors: DataFrame, persons: DataFrame | None = None, path: str | None = None) -> VectorIndex:
    """The index of people's vectors ``vectors(id, embedding)``, without those who are merged."""
    if persons is not None:
        vectors = vectors.join(persons.where("merged_into_id is null").select(F.col("canonical_id").alias("id")), "id", "left_semi")
    return VectorIndex.build(vectors, "id", "id", path)


def _facets(aliases: DataFrame) -> DataFrame:
    mail = F.when(F.col("email_verified"), normalize_email(F.col("email")))
    return aliases.groupBy("person_id").agg(
        sorted_set(normalize_name(F.col("display_name"))).alias("names"), sorted_set(mail).alias("mails"), sorted_set(F.substring_index(mail, "@", -1)).alias("domains"),
        sorted_set(F.concat_ws(":", "source_system", "external_id")).alias("keys"), sorted_set("source_system").alias("sources"),
    )


def _sides(pairs: DataFrame, aliases: DataFrame) -> DataFrame:
    f = _facets(aliases)
    out = pairs
    for side in ("a", "b"):
        out = out.join(f.select(F.col("person_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in f.columns[1:]]), side, "left")
    return out


def hard_conflicts(pairs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a source in which their ids have nothing in common."""
    ids = aliases.groupBy("person_id", "source_system").agg(F.collect_set("external_id").alias("ids"))
    one, two = (ids.select(F.col("person_id").alias(s), "source_system", F.col("ids").alias(f"{s}_ids")) for s in ("a", "b"))
    rows = pairs.select("a", "b").join(one, "a").join(two, ["b", "source_system"]).where(~F.arrays_overlap("a_ids", "b_ids"))
    return rows.groupBy("a", "b").agg(sorted_set("source_system").alias("sources"))


def corroborating_signals(pairs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Signals of each pair: shared_name, shared_domain, shared_email, and high_similarity where ``pairs`` has a similarity."""
    rows = _sides(pairs, aliases)
    similar = F.col("similarity") >= VERY_SIMILAR if "similarity" in pairs.columns else F.lit(False)
    found = [F.when(F.arrays_overlap(f"a_{c}", f"b_{c}"), F.lit(name)) for c, name in (("names", "shared_name"), ("domains", "shared_domain"), ("mails", "shared_email"))]
    return rows.select("a", "b", F.array_compact(F.array(*found, F.when(similar, F.lit("high_similarity")))).alias("signals"))


def sufficient(signals: Column) -> Column:
    return F.array_contains(signals, "shared_name") & F.array_contains(signals, "shared_email")


def identity_fingerprint(pairs: DataFrame, aliases: DataFrame) -> DataFrame:
    """A digest of both people's sorted identity evidence; a change of evidence changes it."""
    rows = _sides(pairs, aliases)
    parts = [F.coalesce(F.array_join(f"{s}_{c}", "\x1f"), F.lit("")) for s in ("a", "b") for c in ("names", "mails", "keys")]
    return rows.select("a", "b", F.sha2(F.concat_ws("\x1e", *parts), 256).alias("fingerprint"))


def merge_decisions(pairs: DataFrame, aliases: DataFrame, verdicts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Decide ``pairs(a, b)``: hard conflict, too few signals, else the supplied verdict; sure ones merge."""
    rows = pairs.join(identity_fingerprint(pairs, aliases), ["a", "b"])
    if known is not None:
        rows = rows.join(known.select("fingerprint"), "fingerprint", "left_anti")
    rows = rows.join(hard_conflicts(pairs, aliases).select("a", "b", F.lit(True).alias("conflict")), ["a", "b"], "left")
    rows = rows.join(corroborating_signals(pairs, aliases), ["a", "b"], "left").join(verdicts, ["a", "b"], "left")
    sure = (F.col("verdict") == "same") & (F.col("confidence") >= SURE)
    outcome = F.when(F.col("conflict"), "blocked_conflict").when(~F.coalesce(sufficient(F.col("signals")), F.lit(False)), "unsure").when(sure, "auto_merged").otherwise(F.coalesce("verdict", F.lit("unsure")))
    return rows.select("a", "b", "fingerprint", outcome.alias("outcome"))


def merge_map(merges: DataFrame, persons: DataFrame) -> DataFrame:
    """(canonical_id, root_id) after ``merges(a, b)``: the older person of a pair stays; chains are followed."""
    from factlake.operators.reads import person_roots

    age = persons.select(F.col("canonical_id").alias("id"), F.struct("created_at", "canonical_id").alias("age"))
    one, two = age.toDF("a", "a_age"), age.toDF("b", "b_age")
    told = merges.join(one, "a").join(two, "b").select(F.when(F.col("a_age") < F.col("b_age"), F.col("b")).otherwise(F.col("a")).alias("canonical_id"), F.when(F.col("a_age") < F.col("b_age"), F.col("a")).otherwise(F.col("b")).alias("into"))
    told = told.groupBy("canonical_id").agg(F.min("into").alias("into"))
    rows = persons.join(told, "canonical_id", "left").select("canonical_id", F.coalesce("into", "merged_into_id").alias("merged_into_id"))
    return person_roots(rows).drop("in_cycle")


def repoint(df: DataFrame, roots: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with each person column at its root; the first value stays as ``origin_`` column."""
    out = df
    for c in columns:
        m = roots.select(F.col("canonical_id").alias(c), F.col("root_id").alias("_root"))
        out = out.join(m, c, "left").withColumn(f"origin_{c}", F.col(c)).withColumn(c, F.coalesce("_root", c)).drop("_root")
    return out


def split_people(df: DataFrame, splits: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose origin is one of ``splits(person_id)`` go back to it."""
    out = df
    for c in columns:
        back = splits.select(F.col("person_id").alias(f"origin_{c}")).withColumn("_back", F.lit(True))
        out = out.join(back, f"origin_{c}", "left").withColumn(c, F.when(F.col("_back"), F.col(f"origin_{c}")).otherwise(F.col(c))).drop("_back")
    return out


def detect_splits(persons: DataFrame, aliases: DataFrame) -> DataFrame:
    """Merged people who conflict with their root."""
    from factlake.operators.reads import person_roots

    pairs = person_roots(persons).where("canonical_id <> root_id").select(F.col("canonical_id").alias("a"), F.col("root_id").alias("b"))
    return hard_conflicts(pairs, aliases)


def identity_metadata(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("person_id").agg(sorted_set("source_system").alias("sources"), F.count(F.lit(1)).alias("n_aliases"), F.count_if("email_verified").alias("n_verified"), sorted_set(F.substring_index(normalize_email(F.col("email")), "@", -1)).alias("domains"))


def platform_user(aliases: DataFrame, persons: DataFrame, source: str) -> DataFrame:
    """Root person of each platform id, where exactly one alias has it."""
    from factlake.operators.reads import person_roots

    one = aliases.where(F.col("source_system") == source).groupBy("external_id").agg(F.count(F.lit(1)).alias("n"), F.min("person_id").alias("canonical_id")).where("n = 1")
    return one.join(person_roots(persons), "canonical_id").select("external_id", F.col("root_id").alias("person_id"))


#: People of a document that are paired in one task with as many others.
PART = 2000


def role_weight(role: Column) -> Column:
    return reduce(lambda out, kv: F.when(role == kv[0], kv[1]).otherwise(out), ROLE_WEIGHTS.items(), F.lit(OTHER_ROLE))


def collaboration_edges(participants: DataFrame, docs: DataFrame, now: Column) -> DataFrame:
    """Weight of each unordered pair of people who take part in the same live documents.

    A person counts once a document, in the best role. Pairs are what is asked
    for, so a document of n people gives n(n-1)/2 of them; the join is one that
    Spark splits where a document is large, and edges add up before the shuffle.
    """
    best = participants.where("identity_kind <> 'service'").groupBy("doc_id", "person_id").agg(F.max(role_weight(F.col("role"))).alias("w"))
    live = docs.where("not deleted").select("doc_id", "event_time", "org_visible")
    age = F.greatest((now.cast("timestamp").cast("double") - F.col("event_time").cast("timestamp").cast("double")) / 86400.0, F.lit(0.0))
    factor = F.pow(F.lit(0.5), age / HALF_LIFE) * F.when(F.col("org_visible"), PUBLIC_FACTOR).otherwise(1.0)
    # A large document is cut in parts of PART people; each part meets each, so no document is one task's.
    parts = best.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = best.join(parts, "doc_id").withColumn("part", F.pmod(F.xxhash64("person_id"), F.col("parts")).cast("int"))
    every = F.explode(F.expr("sequence(0, parts - 1)"))
    a = dealt.join(live.withColumn("factor", factor), "doc_id").select("doc_id", F.col("part").alias("one"), every.alias("two"), F.col("person_id").alias("person_a"), F.col("w").alias("wa"), "factor", "event_time")
    b = dealt.select("doc_id", every.alias("one"), F.col("part").alias("two"), F.col("person_id").alias("person_b"), F.col("w").alias("wb"))
    pairs = a.join(b, ["doc_id", "one", "two"]).where("person_a < person_b")
    return pairs.groupBy("person_a", "person_b").agg(F.sum(F.col("factor") * F.sqrt(F.col("wa") * F.col("wb"))).alias("weight"), sorted_set("doc_id").alias("evidence_doc_ids"), F.max("event_time").alias("last_seen_at"))


def top_collaborators(edges: DataFrame, viewers: DataFrame, visible: Visible, n: int) -> DataFrame:
    """Per viewer and person the ``n`` strongest edges whose evidence the viewer sees whole."""
    rows = edges.withColumn("edge_id", F.concat_ws("-", "person_a", "person_b"))
    seen = for_viewers(rows, visible, "edge_id", viewers)
    ends = seen.select("viewer_id", F.col("person_a").alias("person_id"), F.col("person_b").alias("other_id"), "weight").unionByName(seen.select("viewer_id", F.col("person_b").alias("person_id"), F.col("person_a").alias("other_id"), "weight"))
    return first_rows(ends, ["viewer_id", "person_id"], [F.desc(F.round("weight", 9)), F.col("other_id")], n, "rank")


def pair_strength(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edge of each unordered pair (x, y), weight 0 where there is none."""
    keyed = pairs.withColumns({"person_a": F.least("x", "y"), "person_b": F.greatest("x", "y")})
    return keyed.join(edges.select("person_a", "person_b", "weight"), ["person_a", "person_b"], "left").select("x", "y", F.coalesce("weight", F.lit(0.0)).alias("weight"))
