"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.storage import hot_keys, join_dealt, save


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in ``links(a, b)``; label is the smallest id that can be reached.

    Each round takes the smallest label among the neighbours and then the
    label of that label, so chains halve. Labels and links stay distributed;
    only the number of changed labels comes to the driver. An id with very
    many links, and the label of a very large component, are dealt over tasks.
    """
    both = save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    hubs = hot_keys(both, "b")
    labels = save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    while True:
        near = join_dealt(both, labels.withColumnRenamed("id", "b"), "b", hot=hubs).groupBy("a").agg(F.min("label").alias("near"))
        step = save(labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "near").alias("next")))
        target = labels.select(F.col("id").alias("next"), F.col("label").alias("jump"))
        found = F.least("next", F.coalesce("jump", "next"))
        new = save(join_dealt(step, target, "next", "left").select("id", found.alias("label"), (F.col("label") != found).alias("changed")))
        labels = new.select("id", "label")
        if new.where("changed").limit(1).isEmpty():
            return labels
