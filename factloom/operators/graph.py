"""Facts near the entities that a query names, along the edges of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.entity import cut, match
from factloom.operators.snapshot import Snapshot


def reach(relationships: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """entity_id of the seeds and all within ``max_hops`` edges, either way. The hops are unrolled; each
    is an equi-join on the edges' ends, and the distinct union is the visited set."""
    if max_hops not in (1, 2):
        raise ValueError("max_hops must be 1 or 2")
    out = relationships.select(F.col("subject_entity_id").alias("entity_id"), F.col("object_entity_id").alias("other"))
    edges = out.union(out.select(F.col("other"), F.col("entity_id")))
    seen = seeds.select("entity_id").distinct()
    for _ in range(max_hops):
        seen = seen.union(edges.join(seen, "entity_id", "left_semi").select("other")).distinct()
    return seen


def linked_memories(store: Snapshot, visited: DataFrame) -> DataFrame:
    """memory ids that mention a visited entity or hold an edge with a visited end: two semi-joins side
    by side instead of outer joins under a disjunction."""
    by_entity = store.memory_entities.join(visited, "entity_id", "left_semi").select("memory_id")
    ends = store.relationships.select(F.col("id").alias("relationship_id"), F.explode(F.array("subject_entity_id", "object_entity_id")).alias("entity_id"))
    near = ends.join(visited, "entity_id", "left_semi").select("relationship_id")
    by_edge = store.memory_relationships.join(near, "relationship_id", "left_semi").select("memory_id")
    return by_entity.union(by_edge).distinct()


def arm(store: Snapshot, query: str, limit: int | None = 20, max_hops: int = 1, matched: DataFrame | None = None) -> DataFrame:
    """Active facts within reach: id, importance, updated_at; importance falling, then the latest, then id. All without
    a limit."""
    visited = reach(store.relationships, match(store.entities, query) if matched is None else matched, max_hops)
    ids = linked_memories(store, visited).withColumnRenamed("memory_id", "id")
    found = store.memories.filter("status = 'active'").join(ids, "id", "left_semi")
    return cut(found.select("id", "importance", "updated_at"), limit, 100, F.desc("importance"), F.desc("updated_at"), "id")


BITS = 62  # queries that one number holds


def arm_many(store: Snapshot, matched: DataFrame, limit: int, max_hops: int = 2) -> DataFrame:
    """q, id and place of the facts within reach of each query's entities (q, entity_id), as by :func:`arm`.

    Many queries may name the same many entities. So an entity carries the set of its queries as the bits of a number,
    and a step joins each edge once rather than once a query.
    """
    out = store.relationships.select(F.col("subject_entity_id").alias("entity_id"), F.col("object_entity_id").alias("other"))
    edges = out.union(out.select(F.col("other"), F.col("entity_id")))

    def joined(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key, "word").agg(F.bit_or("bits").alias("bits"))

    seen = joined(matched.select("entity_id", F.expr(f"q div {BITS}").alias("word"), F.expr(f"shiftleft(1L, cast(q % {BITS} as int))").alias("bits")), "entity_id")
    for _ in range(max_hops):
        seen = joined(seen.union(edges.join(seen, "entity_id").select("other", "word", "bits")), "entity_id")
    by_entity = store.memory_entities.join(seen, "entity_id").select("memory_id", "word", "bits")
    ends = store.relationships.select(F.col("id").alias("relationship_id"), F.explode(F.array("subject_entity_id", "object_entity_id")).alias("entity_id"))
    near = joined(ends.join(seen, "entity_id").select("relationship_id", "word", "bits"), "relationship_id")
    by_edge = store.memory_relationships.join(near, "relationship_id").select("memory_id", "word", "bits")
    ids = joined(by_entity.union(by_edge), "memory_id").withColumnRenamed("memory_id", "id")
    own = F.explode(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda k: F.getbit("bits", k) == 1))
    found = store.memories.filter("status = 'active'").select("id", "importance", "updated_at").join(ids, "id")
    found = found.withColumn("k", own).select((F.col("word") * BITS + F.col("k")).cast("int").alias("q"), "id", "importance", "updated_at")
    place = Window.partitionBy("q").orderBy(F.desc("importance"), F.desc("updated_at"), "id")
    return found.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit).select("q", "id", "place")
