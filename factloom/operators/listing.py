"""Lists, counts and cuts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.entity import clamp
from factloom.operators.snapshot import Snapshot


def get(table: DataFrame, key: str, id_column: str = "id") -> DataFrame:
    return table.filter(F.col(id_column) == key)


def list_memories(memories: DataFrame, include_inactive: bool = False, limit: int = 1000) -> DataFrame:
    found = memories if include_inactive else memories.filter("status = 'active'")
    return found.orderBy(F.desc("updated_at"), "id").limit(clamp(limit, 100_000))


def list_entities(entities: DataFrame, limit: int = 1000) -> DataFrame:
    return entities.orderBy(F.lower("canonical_name"), "id").limit(clamp(limit, 100_000))


def recent_events(events: DataFrame, limit: int = 50) -> DataFrame:
    return events.orderBy(F.desc("id")).limit(clamp(limit, 500))


def stats(store: Snapshot) -> DataFrame:
    """name and count: one aggregate per table. "memories" counts all that aren't deleted."""
    one = F.count(F.lit(1))
    counts = [(store.memories, {"memories": F.count_if(F.col("status") != "deleted"), "active_memories": F.count_if(F.col("status") == "active"), "superseded_memories": F.count_if(F.col("status") == "superseded"), "deleted_memories": F.count_if(F.col("status") == "deleted")})]
    counts += [(getattr(store, t), {t: one}) for t in ("entities", "relationships", "memory_embeddings", "retention_events") if getattr(store, t) is not None]
    return reduce(DataFrame.union, [df.agg(*[c.alias(n) for n, c in own.items()]).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("count")) for n in own])).alias("r")).select("r.*") for df, own in counts])


def decision_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("action").agg(F.count(F.lit(1)).alias("count"))


PARTS = 16


def timeline(memories: DataFrame, at: Column) -> DataFrame:
    """day, part, number and ids of its facts, latest day first. A day comes in up to ``PARTS`` parts by the
    first digit of an md5 of the id, so that a busy day is neither one row nor one task."""
    dealt = memories.withColumn("day", F.date_format(at, "yyyy-MM-dd")).withColumn("part", F.substring(F.md5("id"), 1, 1))
    by_part = dealt.groupBy("day", "part").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list("id")).alias("ids"))
    return by_part.orderBy(F.desc("day"), "part")


def within_budget(rows: DataFrame, length: Column, order: list[Column], budget: int, most: int | None = None) -> DataFrame:
    """The first rows, in order, until one would take the total past ``budget``; later ones that would
    fit don't come back. As lengths are positive, that is a test of the running total. For pools that
    are already cut to a limit."""
    place = Window.orderBy(*order)
    out = rows.withColumn("used", F.sum(length).over(place.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(place))
    out = out.filter(F.col("used") <= budget)
    return out.filter(F.col("place") <= most) if most else out


def exact_duplicates(memories: DataFrame) -> DataFrame:
    """The latest active fact of each normalised content, and how many share it."""
    latest = F.max_by("id", F.struct("updated_at", "id"))
    return memories.filter("status = 'active'").groupBy("normalized_content").agg(F.count(F.lit(1)).alias("copies"), latest.alias("kept_id"))
