"""Subject profiles from facts, and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.operators.common import first_rows

#: Facts in a profile's prose; days after which claims are stale; passages that suffice and are kept; cited ids of a line.
PROSE, STALE_DAYS, ENOUGH, KEPT, CITED = 8, 180, 3, 12, 3


def profile_from_facts(subjects: DataFrame, claims: DataFrame, rels: DataFrame) -> DataFrame:
    """Buckets of each subject from its facts: descriptions, vocabulary, team signals, and the first few joined as prose."""
    text = F.concat_ws(": ", "predicate", "object_text")
    own = claims.groupBy("subject_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("predicate") != "definition", text))).alias("descriptions"), F.array_sort(F.collect_set(F.when(F.col("predicate") == "definition", F.col("object_text")))).alias("vocabulary")
    )
    team = rels.where("relationship_type = 'member_of'").groupBy(F.col("from_id").alias("subject_id")).agg(F.array_sort(F.collect_set("to_id")).alias("team_signals"))
    out = subjects.join(own, "subject_id", "left").join(team, "subject_id", "left")
    for c in ("descriptions", "vocabulary", "team_signals"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out.withColumn("prose", F.array_join(F.slice("descriptions", 1, PROSE), "; "))


def fill_profiles(model: DataFrame, graph: DataFrame) -> DataFrame:
    """Empty buckets of the model's profile filled from the graph's, with the source of what is there."""
    g = graph.select("subject_id", F.col("descriptions").alias("g_d"), F.col("vocabulary").alias("g_v"), F.col("prose").alias("g_p"))
    rows = model.join(g, "subject_id", "left")
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    filled = ~has("descriptions") & has("g_d") | ~has("vocabulary") & has("g_v")
    own = has("descriptions") | has("vocabulary")
    tag = F.when(own & filled, "model_and_graph").when(own, "model").when(filled, "graph").otherwise("prose_only")
    pick = lambda c, g_: F.when(has(c), F.col(c)).otherwise(F.col(g_))
    return rows.select("subject_id", pick("descriptions", "g_d").alias("descriptions"), pick("vocabulary", "g_v").alias("vocabulary"), F.coalesce(F.nullif("prose", F.lit("")), "g_p").alias("prose"), tag.alias("source"))


def ground_citations(items: Column, allowed: Column) -> Column:
    """Items (struct text, cited) with cited ids outside ``allowed`` dropped, and items without any left out."""
    kept = F.transform(items, lambda i: F.struct(i["text"].alias("text"), F.array_intersect(i["cited"], allowed).alias("cited")))
    return F.filter(kept, lambda i: F.size(i["cited"]) > 0)


def staleness(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Claims that are STALE_DAYS older than their subject's newest passage."""
    newest = passages.groupBy("subject_id").agg(F.max("event_time").alias("newest"))
    return claims.join(newest, "subject_id").where(F.datediff("newest", F.coalesce("valid_from", "recorded_at")) > STALE_DAYS)


def profile_summary(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Sorted citations and the time range of evidence of each subject."""
    rows = claims.select("subject_id", F.explode("evidence_doc_ids").alias("doc_id"), F.col("valid_from").alias("at")).unionByName(passages.select("subject_id", "doc_id", F.col("event_time").alias("at")))
    return rows.groupBy("subject_id").agg(F.array_sort(F.collect_set("doc_id")).alias("citations"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def broaden_evidence(scoped: DataFrame, broad: DataFrame) -> DataFrame:
    """Subjects with too few scoped passages take broad ones: mentions first, then by score."""
    counts = scoped.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    few = broad.join(counts.where(F.col("n") >= ENOUGH), "subject_id", "left_anti").withColumn("scoped", F.lit(False))
    rows = scoped.withColumn("scoped", F.lit(True)).unionByName(few)
    return first_rows(rows, ["subject_id"], [F.desc("scoped"), F.desc("mentions"), F.desc("score"), F.col("item_id")], KEPT, "rank")


def graph_fact_lines(claims: DataFrame, rels: DataFrame) -> DataFrame:
    """A text line per edge and claim with the first few evidence ids."""
    cite = F.concat(F.lit(" ["), F.array_join(F.slice("evidence_doc_ids", 1, CITED), ", "), F.lit("]"))
    edges = rels.select(F.col("from_id").alias("subject_id"), F.lit(0).alias("part"), F.col("relationship_id").alias("id"), F.concat("from_id", F.lit(" "), "relationship_type", F.lit(" "), "to_id", cite).alias("line"))
    return edges.unionByName(claims.select("subject_id", F.lit(1).alias("part"), F.col("claim_id").alias("id"), F.concat("predicate", F.lit(": "), "object_text", cite).alias("line")))


def parse_profiles(raw: DataFrame) -> DataFrame:
    """``raw(subject_id, reply)``: a model's JSON reply, also in a code fence; what can't be parsed stays as prose."""
    body = F.regexp_replace(F.regexp_replace(F.trim("reply"), r"^```[a-z]*\s*", ""), r"\s*```$", "")
    parsed = F.from_json(body, "descriptions array<string>, vocabulary array<string>, prose string")
    rows = raw.withColumn("p", parsed)
    ok = F.coalesce(F.col("p.descriptions").isNotNull() | F.col("p.vocabulary").isNotNull() | F.col("p.prose").isNotNull(), F.lit(False))
    return rows.select("subject_id", "p.descriptions", "p.vocabulary", F.when(ok, F.col("p.prose")).otherwise(F.trim("reply")).alias("prose"), ok.alias("parsed"))


def score_cases(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Hit, recall, precision and reciprocal rank of each ``gold(case_id, k, expected array)`` by ``predictions(case_id, item_id, rank)``.

    Precision divides by the length of the list returned within k. A case
    without expectations has null scores, one without predictions scores 0.
    """
    wanted = gold.select("case_id", "k", F.explode(F.array_distinct("expected")).alias("item_id")).withColumn("relevant", F.lit(True))
    rows = predictions.join(gold.select("case_id", "k"), "case_id").join(wanted.drop("k"), ["case_id", "item_id"], "left")
    top = (F.col("rank") <= F.col("k"))
    per = rows.groupBy("case_id").agg(
        F.countDistinct(F.when(top & F.col("relevant"), F.col("item_id"))).alias("found"), F.count_if(top & F.coalesce("relevant", F.lit(False))).alias("hits"),
        F.count_if(top).alias("returned"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
    )
    n = F.size(F.array_distinct("expected"))
    out = gold.join(per, "case_id", "left")
    scored = n > 0
    return out.select(
        "case_id", F.col("returned").isNull().alias("missing"), F.when(scored, (F.coalesce("found", F.lit(0)) > 0).cast("double")).alias("hit"), F.when(scored, F.coalesce("found", F.lit(0)) / n).alias("recall"),
        F.when(scored, F.coalesce(F.when(F.col("returned") > 0, F.col("hits") / F.col("returned")), F.lit(0.0))).alias("precision"), F.when(scored, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


def diff_pairs_hit(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per case whether all expected (old, new) pairs are predicted."""
    keys = ["case_id", "old_id", "new_id"]
    got = expected.distinct().join(predicted.select(*keys).distinct().withColumn("got", F.lit(True)), keys, "left")
    return got.groupBy("case_id").agg(F.bool_and(F.coalesce("got", F.lit(False))).alias("all_hit"))


def score_report(scores: DataFrame) -> DataFrame:
    """Means over the cases in which a score is defined, and the number of missing cases."""
    return scores.agg(F.count(F.lit(1)).alias("cases"), F.count_if("missing").alias("missing"), *[F.avg(c).alias(c) for c in ("hit", "recall", "precision", "mrr")])


def predictions_from_results(results: DataFrame) -> DataFrame:
    """(case_id, item_id, rank) of distinct items in the order they first occur in ``results(case_id, item_id, position)``."""
    from pyspark.sql import Window

    first = results.groupBy("case_id", "item_id").agg(F.min("position").alias("position"))
    return first.select("case_id", "item_id", F.row_number().over(Window.partitionBy("case_id").orderBy("position", "item_id")).cast("long").alias("rank"))


def quality_gate(report: DataFrame, least: float = 1.0) -> DataFrame:
    """Whether the mean hit rate reaches ``least``; a report without scored cases fails."""
    return report.select("*", F.coalesce(F.col("hit") >= least, F.lit(False)).alias("passed"))
