"""Connected components of a table of links, without the links ever leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from factloom.llm.workspace import drop_table, write_table


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select("b", "a")).distinct()


def neighbourhoods(both: DataFrame) -> DataFrame:
    """``id, component``: the smallest id within two links. Ids of one value are connected, not the reverse."""
    near = both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component"))
    return both.join(near.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min(F.least("component", "a")).alias("component"))


def rough_components(links: DataFrame) -> DataFrame:
    """``id, component`` where equal components mean connected ids; a component may have several names."""
    return neighbourhoods(_both_ways(links))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id, component``: for each id in ``links`` (columns a, b) the smallest id it can reach.

    A round passes labels along links and then replaces each label by its own label, which halves long
    chains; it ends when nothing changes. Labels are written between rounds, so lineage stays short.
    """
    spark = links.sparkSession
    both, both_at = write_table(_both_ways(links), "links", fewer=8)
    labels, at = write_table(neighbourhoods(both), "labels", fewer=8)
    for _ in range(most_rounds):
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        passed = labels.join(seen, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("over"))
        jumped = passed.join(jump, "component", "left").select("id", "was", F.least("component", F.coalesce("over", "component")).alias("component"))
        counted = Observation()
        new, new_at = write_table(jumped.observe(counted, F.count_if(F.col("was") != F.col("component")).alias("changed")).drop("was"), "labels", fewer=8)
        drop_table(spark, at)
        labels, at = new, new_at
        if not counted.get["changed"]:
            drop_table(spark, both_at)
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
