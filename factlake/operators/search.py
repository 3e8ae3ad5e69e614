"""Hybrid retrieval: vector, keyword and fact channels, fusion, decay, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.ranking import FACT_FLOOR, FACT_HALF_LIFE, PASSAGE_FLOOR, PASSAGE_HALF_LIFE, RRF_K, recency_multiplier
from factlake.functions.text import BODY_WEIGHT, TITLE_WEIGHT, escape_like, terms
from factlake.operators.acl import Visible, seen_by
from factlake.operators.common import first_rows, holding, paired, small
from factlake.operators.store import save
from factlake.operators.term_index import TermIndex
from factlake.operators.vector_index import VectorIndex

#: Candidates of each channel; what a budget drops first to last.
POOL = 100
#: Facts whose terms a task groups on average.
FACT_ROWS = 50_000
DROP_ORDER = {
    "graph_first": ["passages", "search_facts", "paths", "fact_diffs", "structured_facts"],
    "joint": ["paths", "fact_diffs", "search_facts", "structured_facts", "passages"],
    "vector_first": ["paths", "fact_diffs", "structured_facts", "search_facts", "passages"],
}


def index_terms(docs: DataFrame, key: str, title: str = "title", body: str = "rendered_text") -> DataFrame:
    """(key, term, tf, score): frequency and weighted frequency of each term of title and body."""
    none = F.array().cast("array<struct<term:string,weight:double>>")

    def weighted(column: str, weight: float) -> Column:
        return F.coalesce(F.transform(terms(F.col(column)), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight"))), none)

    rows = docs.select(key, F.explode(F.concat(weighted(title, TITLE_WEIGHT), weighted(body, BODY_WEIGHT))).alias("t")).select(key, "t.term", "t.weight")
    return rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.sum("weight").alias("score"))


def match_terms(index: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """(key, query_id, score) where all of ``must``, one of ``any`` (if given) and none of ``no`` occur; score sums matched terms."""
    wanted = small(queries.select("query_id", F.size("must").alias("n_must"), F.size("any").alias("n_any"), "no"))
    side = queries.select("query_id", F.explode(F.concat(
        F.transform("must", lambda w: F.struct(w.alias("term"), F.lit("must").alias("side"))),
        F.transform("any", lambda w: F.struct(w.alias("term"), F.lit("any").alias("side"))),
        F.transform("no", lambda w: F.struct(w.alias("term"), F.lit("no").alias("side"))),
    )).alias("w")).select("query_id", "w.term", "w.side").distinct()
    # An index that is made on the way then counts the terms only that are asked for: Spark takes a semi join before a grouping by its key.
    index = index.join(small(side.select("term").distinct()), "term", "left_semi")
    # Each term once, so that no distinct count is needed, for which Spark would shuffle an index that is dealt by key again.
    hits = index.join(small(side), "term").groupBy(key, "query_id", "term", "side").agg(F.sum("score").alias("score")).groupBy(key, "query_id").agg(
        F.count_if(F.col("side") == "must").alias("got_must"), F.count_if(F.col("side") == "any").alias("got_any"),
        F.count_if(F.col("side") == "no").alias("got_no"), F.sum(F.when(F.col("side") != "no", F.col("score"))).alias("score"),
    )
    return hits.join(wanted, "query_id").where("got_must = n_must and (n_any = 0 or got_any > 0) and got_no = 0").select(key, "query_id", "score")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


#: Vectors of different models are never compared; a table that doesn't name its model has vectors of one.
SAME_MODEL = "v_model is null or q_model is null or v_model = q_model"


def model(vectors: DataFrame) -> Column:
    return F.col("embedding_model") if "embedding_model" in vectors.columns else F.lit(None).cast("string")


def passage_index(chunks: DataFrame, path: str | None = None) -> VectorIndex:
    """The index of the child passages' vectors."""
    return VectorIndex.build(chunks.where("chunk_role = 'child'"), "chunk_id", "doc_id", path)


def vector_candidates(chunks: DataFrame, queries: DataFrame, visible: Visible | None, k: int = POOL, index: VectorIndex | None = None) -> DataFrame:
    """The ``k`` cosine-nearest child passages of each ``queries(query_id, embedding[, viewer_id])``; access comes before the cut.

    With an ``index`` (of passages that all name their model, or all don't)
    lists that access or bounds rule out are not read; without one, all
    passages are compared. Queries are a parameter table. Vectors of another
    length or, where both tables name it, another embedding model are no
    candidates.
    """
    if index is not None:
        if "embedding_model" not in queries.columns and "embedding_model" in chunks.columns:
            queries = queries.join(small(chunks.select("embedding_model").distinct()), how="cross")
        found = index.search(queries, visible, k).withColumnRenamed("key", "chunk_id")
        return found if "embedding_model" not in queries.columns else first_rows(found.drop("rank"), ["query_id"], [F.desc(F.round("similarity", 9)), F.col("chunk_id")], k, "rank")
    base = chunks.where("chunk_role = 'child' and embedding is not null").select("chunk_id", "doc_id", F.col("embedding").alias("v"), norm("embedding").alias("v_norm"), model(chunks).alias("v_model"))
    asked = queries.select(*[c for c in ("query_id", "viewer_id") if c in queries.columns], F.col("embedding").alias("q"), norm("embedding").alias("q_norm"), model(queries).alias("q_model"))
    rows = paired(base, asked, (F.size("v") == F.size("q")) & F.expr(SAME_MODEL))
    rows = rows.withColumn("similarity", F.when(F.col("v_norm") * F.col("q_norm") > 0, dot("v", "q") / (F.col("v_norm") * F.col("q_norm")))).drop("v", "q", "v_norm", "q_norm", "v_model", "q_model").where("similarity is not null")
    if visible is not None:
        public = rows.join(visible.public, "doc_id", "left_semi")
        private = rows.join(visible.private, ["viewer_id", "doc_id"], "left_semi").select(rows.columns)
        rows = public.select(rows.columns).unionByName(private)
    return first_rows(rows, ["query_id"], [F.desc(F.round("similarity", 9)), F.col("chunk_id")], k, "rank")


def keyword_candidates(index: DataFrame, queries: DataFrame, key: str, allowed: DataFrame | None = None, k: int = POOL, public: DataFrame | None = None) -> DataFrame:
    """The ``k`` best matches by summed weighted term frequency; ``allowed(query_id, key)`` and ``public(key)``, open to all, come before the cut."""
    hits = match_terms(index, queries, key)
    if allowed is not None:
        own = hits.join(allowed, ["query_id", key], "left_semi")
        hits = own if public is None else hits.join(public, key, "left_semi").unionByName(own.join(public, key, "left_anti").select(hits.columns))
    return first_rows(hits, ["query_id"], [F.desc(F.round("score", 9)), F.col(key)], k, "rank")


def fact_terms(claims: DataFrame, rels: DataFrame) -> DataFrame:
    """Term frequencies of fact texts, with weight 1.

    Facts are dealt by id over tasks of FACT_ROWS before they are grouped, so
    tasks grow in number, not in size, and what is grouped by fact again isn't
    shuffled again.
    """
    rows = claims.select(F.col("claim_id").alias("fact_id"), F.concat_ws(": ", "predicate", "object_text").alias("text")).unionByName(
        rels.select(F.col("relationship_id").alias("fact_id"), F.concat_ws(" ", "from_id", "relationship_type", "to_id").alias("text"))
    )
    parts = max(1, -(-(claims.count() + rels.count()) // FACT_ROWS))
    rows = rows.select("fact_id", F.explode(terms(F.col("text"))).alias("term")).repartition(parts, "fact_id")
    return rows.groupBy("fact_id", "term").agg(F.count(F.lit(1)).cast("double").alias("score"))


def rrf_fuse(lists: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists (query_id, key, rank)."""
    rows = lists[0].select("query_id", key, "rank")
    for more in lists[1:]:
        rows = rows.unionByName(more.select("query_id", key, "rank"))
    return rows.groupBy("query_id", key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def decayed_shortlist(fused: DataFrame, items: DataFrame, now: Column, pool: int = POOL) -> DataFrame:
    """Fused score times recency of ``items(item_id, kind, at)``: facts and passages decay at their own pace."""
    passage = recency_multiplier(F.col("at"), now, PASSAGE_HALF_LIFE, PASSAGE_FLOOR)
    fact = recency_multiplier(F.col("at"), now, FACT_HALF_LIFE, FACT_FLOOR)
    rows = fused.join(items, "item_id").withColumn("score", F.col("score") * F.when(F.col("kind") == "fact", fact).otherwise(passage))
    return first_rows(rows, ["query_id"], [F.desc(F.round("score", 12)), F.col("item_id")], pool, "rank")


def apply_rerank(shortlist: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """Order by supplied scores where the shortlist is longer than ``limit`` and all of it is scored; else keep the order."""
    rows = shortlist.join(scores.select("query_id", "item_id", F.col("score").alias("given")), ["query_id", "item_id"], "left")
    per_query = Window.partitionBy("query_id")
    long, scored = F.count(F.lit(1)).over(per_query) > limit, F.count("given").over(per_query) == F.count(F.lit(1)).over(per_query)
    rows = rows.withColumn("skip_reason", F.when(~long, "within_limit").when(~scored, "no_scores"))
    place = Window.partitionBy("query_id").orderBy(F.when(F.col("skip_reason").isNull(), -F.col("given")).otherwise(F.col("rank").cast("double")), "item_id")
    return rows.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= limit).withColumn("reranked", F.col("skip_reason").isNull())


def dedupe_parents(hits: DataFrame) -> DataFrame:
    """The first hit of each parent (or of itself), and how many each query lost."""
    rows = hits.withColumn("group", F.coalesce("parent_id", "item_id"))
    kept = first_rows(rows, ["query_id", "group"], [F.col("rank")]).drop("group")
    lost = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).join(kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("m")), "query_id")
    return kept.join(lost.select("query_id", (F.col("n") - F.col("m")).alias("removed")), "query_id")


def expand_authors(authors: DataFrame, persons: DataFrame, aliases: DataFrame, most: int = 3) -> DataFrame:
    """Patterns of ``authors(query_id, author)``: the text and the names of the people it fits, if they are few."""
    people = holding(persons, F.lower("display_name"), authors.select("query_id", "author"), F.lower("author")).select("query_id", "canonical_id", "display_name")
    few = people.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).where(F.col("n") <= most)
    names = few.select("query_id", F.col("display_name").alias("name")).unionByName(
        few.join(aliases, F.col("canonical_id") == F.col("person_id")).select("query_id", aliases["display_name"].alias("name"))
    )
    return authors.select("query_id", F.col("author").alias("name")).unionByName(names).distinct().select("query_id", F.concat(F.lit("%"), escape_like(F.col("name")), F.lit("%")).alias("pattern"))


def canonical_author(ids: DataFrame, persons: DataFrame) -> DataFrame:
    """``ids(query_id, person_id)`` with usable: unknown and merged people give an empty search, not an unfiltered one."""
    return ids.join(persons.select(F.col("canonical_id").alias("person_id"), F.col("merged_into_id").isNull().alias("root")), "person_id", "left").select("query_id", "person_id", F.coalesce("root", F.lit(False)).alias("usable"))


def alike(queries: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Queries that are equal in ``columns`` as one, and (query_id, like) that tells which one each of ``queries`` is."""
    like = F.to_json(F.struct(*columns))
    return queries.select(like.alias("query_id"), *columns).dropDuplicates(["query_id"]), queries.select("query_id", like.alias("like"))


def hybrid_search(
    queries: DataFrame, chunks: DataFrame, docs: DataFrame, index: DataFrame | TermIndex, facts: DataFrame, fact_index: DataFrame, visible: Visible, scores: DataFrame | None,
    now: Column, limit: int = 10, channels: tuple[str, ...] = ("vector", "keyword", "fact"), vectors: VectorIndex | None = None,
) -> DataFrame:
    """Three channels for a table of ``queries(query_id, viewer_id, embedding, must, any, no[, text])`` in one plan.

    With a ``TermIndex`` passages are searched by the queries' ``text``, with
    ``vectors`` by lists of the vector index.

    ``facts(fact_id, viewer_id, at)`` are facts that each viewer may read
    (viewer null: all). Passages and facts compete in one list. Each channel's
    list is stored, so that the driver never holds what all channels broadcast.
    """
    lists = []
    if "vector" in channels:
        lists.append(save(vector_candidates(chunks, queries, visible, POOL, vectors).select("query_id", F.concat(F.lit("chunk:"), "chunk_id").alias("item_id"), "rank")))
    # The other channels don't depend on the vector: queries of one viewer with the same words are searched once.
    if "keyword" in channels:
        own = chunks.where("chunk_role = 'child'").select("doc_id", "chunk_id")
        words = ["text"] if isinstance(index, TermIndex) else ["must", "any", "no"]
        asked, same = (save(part) for part in alike(queries, ["viewer_id", *words]))
        public = own.join(visible.public, "doc_id", "left_semi").select("chunk_id")
        private = own.join(visible.private.join(asked, "viewer_id").select("query_id", "doc_id"), "doc_id").select("query_id", "chunk_id").distinct()
        if isinstance(index, TermIndex):
            worded = index.top(asked.select("query_id", "text"), POOL, private.withColumnRenamed("chunk_id", "key"), public.withColumnRenamed("chunk_id", "key")).withColumnRenamed("key", "chunk_id")
        else:
            worded = keyword_candidates(index, asked, "chunk_id", private, public=public)
        worded = save(worded).withColumnRenamed("query_id", "like").join(same, "like")
        lists.append(worded.select("query_id", F.concat(F.lit("chunk:"), "chunk_id").alias("item_id"), "rank"))
    if "fact" in channels:
        asked, same = (save(part) for part in alike(queries, ["viewer_id", "must", "any", "no"]))
        public = facts.where("viewer_id is null").select("fact_id").distinct()
        private = facts.where("viewer_id is not null").join(asked, "viewer_id").select("query_id", "fact_id").distinct()
        told = save(keyword_candidates(fact_index, asked, "fact_id", private, public=public).withColumnRenamed("query_id", "like")).join(same, "like")
        lists.append(told.select("query_id", F.concat(F.lit("fact:"), "fact_id").alias("item_id"), "rank"))
    fused = save(rrf_fuse(lists, "item_id"))
    # Times of what was found only, which is far less than there is.
    found = small(save(fused.select("item_id").distinct()))
    passages = chunks.select(F.concat(F.lit("chunk:"), "chunk_id").alias("item_id"), "doc_id").join(found, "item_id", "left_semi")
    times = passages.join(docs.select("doc_id", "event_time"), "doc_id").select("item_id", F.lit("passage").alias("kind"), F.col("event_time").alias("at"), F.col("doc_id").alias("parent_id"))
    told = facts.select(F.concat(F.lit("fact:"), "fact_id").alias("item_id"), F.lit("fact").alias("kind"), "at", F.lit(None).cast("string").alias("parent_id"))
    times = times.unionByName(told.join(found, "item_id", "left_semi").select(told.columns).distinct())
    # Parquet holds the stored list in a fraction of what it takes in memory, so its size on disk must not make Spark broadcast it.
    shortlist = decayed_shortlist(fused.hint("merge"), times, now)
    none = queries.sparkSession.createDataFrame([], "query_id string, item_id string, score double")
    return dedupe_parents(apply_rerank(shortlist, scores if scores is not None else none, limit))


def search_diagnostics(stages: DataFrame) -> DataFrame:
    """Per query how many items each of ``stages(query_id, stage, item_id)`` holds."""
    names = ("vector", "keyword", "fact", "fused", "shortlist", "returned")
    return stages.groupBy("query_id").agg(*[F.count_if(F.col("stage") == n).alias(n) for n in names])


def pack_tokens(items: DataFrame, budgets: DataFrame) -> DataFrame:
    """Items of ``items(request_id, channel, position, cost)`` that fit ``budgets(request_id, mode, budget)``.

    What is dropped first is the tail of the mode's least important channel,
    so an item stays if all that is more important fits with it.
    """
    order = F.lit(None).cast("int")
    for mode, channels in DROP_ORDER.items():
        for place, channel in enumerate(reversed(channels)):
            order = F.when((F.col("mode") == mode) & (F.col("channel") == channel), place).otherwise(order)
    rows = items.join(small(budgets), "request_id").withColumn("importance", order)
    run = F.sum("cost").over(Window.partitionBy("request_id").orderBy("importance", "position").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("cost").over(Window.partitionBy("request_id"))
    return rows.withColumn("running", run).withColumn("trimmed", total > F.col("budget")).where("running <= budget")


def pack_context(requests: DataFrame, hits: DataFrame, facts: DataFrame, paths: DataFrame) -> DataFrame:
    """Passages, facts and paths of each ``requests(request_id, mode, budget)``, packed and gathered in one row.

    The channels are ``(request_id, item_id, position, cost)``, from wherever;
    ``context.retrieve_context`` makes them from the request itself.
    """
    rows = hits.withColumn("channel", F.lit("passages")).unionByName(facts.withColumn("channel", F.lit("structured_facts"))).unionByName(paths.withColumn("channel", F.lit("paths")))
    packed = pack_tokens(rows, requests)
    per_channel = packed.groupBy("request_id", "channel").agg(F.array_sort(F.collect_list(F.struct("position", "item_id"))).alias("items"), F.max("trimmed").alias("trimmed"))
    out = per_channel.groupBy("request_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", F.col("items.item_id").alias("ids"))))).alias("channels"), F.max("trimmed").alias("trimmed"))
    return requests.join(out, "request_id", "left").select("request_id", "mode", "channels", F.coalesce("trimmed", F.lit(False)).alias("trimmed"))


def episode_text(turns: DataFrame, most: int) -> DataFrame:
    """Text of each ``turns(conv_id, turn, role, text)`` in order, at most ``most`` characters."""
    lines = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))).alias("lines"))
    return lines.select("conv_id", F.substring(F.array_join("lines.line", "\n"), 1, most).alias("episode_text"))


def episode_index(episodes: DataFrame, path: str | None = None) -> VectorIndex:
    """The index of the active episodes' vectors."""
    return VectorIndex.build(episodes.where("status = 'active'").withColumn("doc_id", F.col("memory_id")), "memory_id", "doc_id", path)


def episode_search(queries: DataFrame, episodes: DataFrame, viewers: DataFrame, visible: Visible, scores: DataFrame | None, limit: int = 10, vectors: VectorIndex | None = None) -> DataFrame:
    """Active episodes for ``queries(query_id, viewer_id, agent_id, embedding, embedding_model, must, any, no)``: vector and keyword lists, fused and reranked.

    A viewer needs access to the episode and to all of its evidence; one
    without evidence needs the first only. A query's agent_id restricts it to
    that agent, null to none. Access and agent come before each list's cut;
    vectors of another model are compared with no query.
    """
    active = episodes.where("status = 'active'")
    keys = queries.select("query_id", "viewer_id", F.col("agent_id").alias("asked_agent"), F.col("embedding_model").alias("asked_model"))
    own = active.select("memory_id", "agent_id", "embedding_model", "org_visible", "allowed_principals", F.coalesce(F.size("evidence_doc_ids") > 0, F.lit(False)).alias("cites"))
    facts = [c for c in own.columns if c not in ("org_visible", "allowed_principals")]
    holders = keys.join(viewers.select("viewer_id", F.explode("principals").alias("principal")), "viewer_id")
    named = own.where("not org_visible").select(*facts, F.explode("allowed_principals").alias("principal")).join(holders, "principal").drop("principal").distinct()
    pairs = own.where("org_visible").select(facts).join(small(keys), how="cross").unionByName(named).where("asked_agent is null or asked_agent = agent_id")
    pairs = pairs.where("not cites").unionByName(seen_by(pairs.where("cites"), active, visible, "memory_id"))
    # Each query is a viewer of its own here, since its agent and model decide too.
    private = pairs.where("embedding_model = asked_model").select(F.col("query_id").alias("viewer_id"), F.col("memory_id").alias("doc_id"))
    chunks = active.select(F.col("memory_id").alias("chunk_id"), F.col("memory_id").alias("doc_id"), F.lit("child").alias("chunk_role"), "embedding")
    own_viewers, reach = queries.withColumn("viewer_id", F.col("query_id")), Visible(private.select("doc_id").limit(0), private)
    near = vector_candidates(chunks, own_viewers, reach) if vectors is None else vectors.search(own_viewers, reach, POOL).withColumnRenamed("key", "chunk_id")
    index = index_terms(active.select("memory_id", F.lit("").alias("title"), F.concat_ws(" ", "objective", "summary").alias("rendered_text")), "memory_id")
    worded = keyword_candidates(index, queries, "memory_id", pairs.select("query_id", "memory_id"))
    fused = rrf_fuse([near.select("query_id", F.col("chunk_id").alias("item_id"), "rank"), worded.withColumnRenamed("memory_id", "item_id")], "item_id")
    shortlist = first_rows(fused, ["query_id"], [F.desc(F.round("score", 12)), F.col("item_id")], POOL, "rank")
    none = queries.sparkSession.createDataFrame([], "query_id string, item_id string, score double")
    return apply_rerank(shortlist, scores if scores is not None else none, limit)


def supersede_episodes(episodes: DataFrame) -> DataFrame:
    """The newest of each agent, procedure and creator is active; older ones point to it."""
    w = Window.partitionBy("agent_id", "procedure_key", "created_by").orderBy(F.desc("created_at"), F.desc("memory_id"))
    rows = episodes.withColumn("newest", F.first("memory_id").over(w))
    older = F.col("newest") != F.col("memory_id")
    return rows.select("memory_id", F.when(older, "superseded").otherwise("active").alias("status"), F.when(older, F.col("newest")).alias("superseded_by"))


def export_hits(hits: DataFrame, optional: list[str]) -> DataFrame:
    """Each hit as a JSON line; timestamps in UTC with Z, empty optional fields left out."""
    columns = []
    for name, kind in hits.dtypes:
        c = F.col(name)
        if kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        if name in optional and kind == "string":
            c = F.nullif(c, F.lit(""))
        columns.append(c.alias(name))
    return hits.select(F.to_json(F.struct(*columns)).alias("value"))
