"""Many names within labels: as by comparing all, without a hot gram."""

import random

import pytest
from pyspark.sql import functions as F

from factlake.operators import common
from factlake.operators.common import holding


@pytest.mark.parametrize("short", [False, True])
def test_many_names(spark, monkeypatch, short):
    if short:
        monkeypatch.setattr(common, "GRAM_ROWS", 3)
    rng = random.Random(3)
    labels = [(k, f"customer#{k:09d}") for k in range(300)] + [(1000 + k, "".join(rng.choices("abé#0", k=rng.randrange(7)))) for k in range(300)] + [(2000, None), (2001, ""), (2002, "customer#000000007")]
    names = [(k, f"{rng.randrange(400):0{rng.choice([3, 5, 9])}d}") for k in range(200)] + [(500 + k, "".join(rng.choices("abé#0", k=rng.randrange(1, 5)))) for k in range(100)] + [(900, None), (901, ""), (902, "customer#"), (903, "zzz"), (904, "r#0"), (904, "r#0")]
    a, b = spark.createDataFrame(labels, "id int, label string").repartition(3), spark.createDataFrame(names, "query_id int, name string").repartition(2)
    got = sorted((r["query_id"], r["id"]) for r in holding(a, F.col("label"), b, F.col("name")).collect())
    assert got == sorted((q, i) for q, n in names for i, t in labels if n is not None and t is not None and n in t)


def test_a_shared_beginning_joins_nothing(spark):
    """20,000 names that begin alike meet 20,000 labels by their rare grams."""
    people = spark.range(20_000).select("id", F.format_string("customer#%09d", F.col("id") * 7919 % 1_000_000_007 % 10**9).alias("label"))
    names = people.select(F.col("id").alias("query_id"), F.col("label").alias("name"))
    found = holding(people, F.col("label"), names, F.col("name"))
    assert found.count() == 20_000 and found.where("id <> query_id").isEmpty()
