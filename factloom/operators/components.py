"""Connected components of things that share links, as a table that never leaves the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, keep: Callable[[DataFrame], DataFrame], most_rounds: int = 60) -> DataFrame:
    """place, component: for every place of ``links`` (place long, link string) that shares a link the smallest place
    that it reaches. Places that share nothing are left out. keep: writes a table and reads it back.

    A round takes the smallest label of each link and then each label's own label, which halves long chains. A link
    of very many places costs a row each, never a pair.
    """
    shared = links.groupBy("link").agg(F.min("place").alias("low"), F.max("place").alias("high")).filter("low < high").select("link")
    links = keep(links.join(shared, "link").select("place", "link").distinct())
    labels = links.groupBy("place").agg(F.min("place").alias("component"))
    if not labels.head(1):
        return labels
    for _ in range(most_rounds):
        low = links.join(labels, "place").groupBy("link").agg(F.min("component").alias("low"))
        seen = links.join(low, "link").groupBy("place").agg(F.min("low").alias("near"))
        passed = labels.join(seen, "place").select("place", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = passed.select(F.col("place").alias("component"), F.col("component").alias("over"))
        new = keep(passed.join(jump, "component", "left").select("place", "was", F.least("component", F.coalesce("over", "component")).alias("component")))
        labels = new.select("place", "component")
        if not new.filter("was <> component").head(1):
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
