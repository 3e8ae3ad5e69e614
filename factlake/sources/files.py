"""Reading and writing: envelopes, ontology, gold sets, ledger tables, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PERSON = "role string, external_id string, display_name string, emails array<struct<value:string,verified:boolean>>, identifiers array<struct<namespace:string,value:string,verified:boolean>>"
#: The schema of a change event.
ENVELOPE = (
    "seq long, source_system string, external_id string, change_kind string, source_type string, title string, text string, author_external_id string, author_display_name string, "
    f"author_email string, author_email_verified boolean, participants array<struct<{PERSON.replace(' string', ':string').replace(' array', ':array')}>>, event_time timestamp, arrived_at timestamp, org_visible boolean, "
    "allowed_principals array<string>, structured_fields array<struct<key:string,value:string,value_type:string>>, parent_external_id string, deep_link string, metadata map<string,string>"
)
PREDICATE = "key string, subject_types array<string>, value_type string, mutually_exclusive boolean, structured_field_keys array<string>, taxonomy_key string, field_key string, freshness_half_life_days double"
EDGE = "key string, from_types array<string>, to_types array<string>, mutually_exclusive boolean"


def read_envelopes(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON-lines change events of a fixed schema; rows that aren't JSON have nulls only."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(ENVELOPE).json(path)


def archive_envelopes(env: DataFrame, path: str) -> None:
    """Raw events as JSON lines below workspace and document, with the time and a short hash as key."""
    body = F.to_json(F.struct(*[c for c in env.columns if c != "workspace_id"]))
    key = F.concat(F.date_format("event_time", "yyyyMMdd'T'HHmmss"), F.lit("-"), F.substring(F.sha2(body, 256), 1, 12))
    workspace = F.col("workspace_id") if "workspace_id" in env.columns else F.lit("default")
    rows = env.select(workspace.alias("workspace_id"), F.concat_ws(":", "source_system", "external_id").alias("doc_id"), key.alias("event_key"), body.alias("body"))
    rows.write.mode("append").partitionBy("workspace_id").json(path)


def read_registry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Predicates, relationship types and structured keys of ontology files; a key in two places is an error."""
    schema = f"predicates array<struct<{_fields(PREDICATE)}>>, relationship_types array<struct<{_fields(EDGE)}>>, entity_types array<string>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    out = {"predicates": raw.select(F.explode("predicates").alias("p")).select("p.*"), "relationship_types": raw.select(F.explode("relationship_types").alias("p")).select("p.*"), "entity_types": raw.select(F.explode("entity_types").alias("key"))}
    out["structured_keys"] = out["predicates"].select(F.explode("structured_field_keys").alias("key"), F.col("key").alias("predicate")).toDF("key", "predicate")
    for name, df in out.items():
        twice = [r["key"] for r in df.groupBy("key").count().where("count > 1").orderBy("key").limit(5).collect()]
        if twice:
            raise ValueError(f"{name}: keys given twice: {', '.join(twice)}")
    return out


def _fields(ddl: str) -> str:
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in ddl.split(", "))


def read_gold_set(spark: SparkSession, path: str) -> DataFrame:
    """Gold cases; a case without any expectation is an error."""
    schema = "case_id string, query string, mode string, k int, expected_doc_ids array<string>, expected_claim_ids array<string>, expected_diff_changed_pairs array<array<string>>"
    cases = spark.read.schema(f"cases array<struct<{_fields(schema)}>>").json(path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    bare = cases.where((size("expected_doc_ids") <= 0) & (size("expected_claim_ids") <= 0) & (size("expected_diff_changed_pairs") <= 0)).limit(5).collect()
    if bare:
        raise ValueError(f"cases without expectations: {', '.join(str(r['case_id']) for r in bare)}")
    return cases


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, item_id, rank) of ranked predictions."""
    raw = spark.read.schema("predictions array<struct<case_id: string, doc_ids: array<string>>>").json(path, multiLine=True)
    rows = raw.select(F.explode("predictions").alias("p")).select("p.case_id", F.posexplode("p.doc_ids").alias("pos", "item_id"))
    return rows.select("case_id", "item_id", (F.col("pos") + 1).cast("long").alias("rank"))


def save_tables(tables: dict[str, DataFrame], path: str, partition: str = "workspace_id") -> None:
    """Ledger tables as Parquet; a write replaces only the workspaces it holds."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(partition) if partition in df.columns else writer).parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_lines(lines: DataFrame, path: str) -> None:
    """JSON lines of a column ``value``."""
    lines.select("value").write.mode("overwrite").text(path)
