"""Clean-up: grace periods, unused facts, orphans, old events."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.snapshot import Snapshot

COMPACT_FROM = 25  # removed facts that make a rewrite worth it


@dataclass(frozen=True)
class Policy:
    """Days; 0 for superseded_ttl_days deletes at once, 0 for expire_unused_days never expires."""

    superseded_ttl_days: float = 3.0
    expire_unused_days: float = 120.0
    expire_max_importance: float = 0.35
    event_log_days: float = 90.0


def _cutoff(now: datetime, days: float):
    return F.lit((now.astimezone(timezone.utc) - timedelta(days=days)).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def doomed(memories: DataFrame, policy: Policy, now: datetime) -> DataFrame:
    """id and reason (superseded_removed, deleted_removed, expired_unused) of facts to delete."""
    old = F.date_trunc("second", "updated_at") <= _cutoff(now, policy.superseded_ttl_days)
    reason = F.when((F.col("status") == "superseded") & old, "superseded_removed").when((F.col("status") == "deleted") & old, "deleted_removed")
    if policy.expire_unused_days > 0:
        unused = (F.col("status") == "active") & (F.col("recall_count") == 0) & (F.col("importance") < policy.expire_max_importance)
        unused = unused & (F.coalesce("subtype", F.lit("")) != "directive") & (F.date_trunc("second", "created_at") <= _cutoff(now, policy.expire_unused_days))
        reason = reason.when(unused, "expired_unused")
    return memories.select("id", reason.alias("reason")).filter("reason is not null")


def old_events(events: DataFrame, policy: Policy, now: datetime) -> DataFrame:
    return events.filter(F.date_trunc("second", "created_at") <= _cutoff(now, policy.event_log_days))


def purge(store: Snapshot, ids: DataFrame) -> Snapshot:
    """Delete facts with all that hangs on them; what names them elsewhere becomes null."""
    gone = ids.select(F.col("id").alias("memory_id")).distinct()
    out: dict[str, DataFrame] = {}
    gone_id = gone.withColumnRenamed("memory_id", "id")
    kept = store.memories.join(gone_id, "id", "left_anti")
    if "superseded_by" in kept.columns:
        kept = _without_names(kept, "superseded_by", gone)
    out["memories"] = kept
    for table in ("memory_entities", "memory_relationships", "memory_embeddings", "temporal_events"):
        if (df := getattr(store, table)) is not None:
            out[table] = df.join(gone, "memory_id", "left_anti").select(*df.columns)
    if (events := store.retention_events) is not None:
        for column in [c for c in ("memory_id", "superseded_id") if c in events.columns]:
            events = _without_names(events, column, gone)
        out["retention_events"] = events
    return store.with_(**out)


def _without_names(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """``df`` with null where ``column`` names a fact that goes. Rows that name none, often most, are dealt by their own
    id and meet nothing, so they don't gather in one task."""
    key = F.coalesce(F.col(column), F.concat(F.lit("\u0000"), F.col("id").cast("string")))
    named = gone.select(F.col("memory_id").alias("__key"), F.lit(True).alias("__gone"))
    joined = df.withColumn("__key", key).join(named, "__key", "left")
    return joined.withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).select(*df.columns)


def orphan_relationships(store: Snapshot) -> DataFrame:
    held = store.memory_relationships.select(F.col("relationship_id").alias("id"))
    return store.relationships.join(held, "id", "left_anti").select("id")


def orphan_entities(store: Snapshot) -> DataFrame:
    held = store.memory_entities.select(F.col("entity_id").alias("id"))
    ends = store.relationships.select(F.explode(F.array("subject_entity_id", "object_entity_id")).alias("id"))
    return store.entities.join(held.union(ends), "id", "left_anti").select("id")


def survivors(store: Snapshot, policy: Policy, now: datetime) -> Snapshot:
    """The store after clean-up: facts, events, then relationships without a fact, then entities without either."""
    out = purge(store, doomed(store.memories, policy, now))
    if out.retention_events is not None:
        out = out.with_(retention_events=out.retention_events.filter(~F.coalesce(F.date_trunc("second", "created_at") <= _cutoff(now, policy.event_log_days), F.lit(False))))
    out = out.with_(relationships=out.relationships.join(orphan_relationships(out), "id", "left_anti").select(*out.relationships.columns))
    return out.with_(entities=out.entities.join(orphan_entities(out), "id", "left_anti").select(*out.entities.columns))


def report(store: Snapshot, policy: Policy, now: datetime, dry_run: bool = False) -> DataFrame:
    """name and count. A dry run doesn't count orphans."""
    reasons = store.memories.sparkSession.createDataFrame([(n,) for n in ("superseded_removed", "deleted_removed", "expired_unused")], "name string")
    counts = doomed(store.memories, policy, now).groupBy(F.col("reason").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    parts = reasons.join(counts, "name", "left").select("name", F.coalesce("count", F.lit(0)).alias("count"))
    events = old_events(store.retention_events, policy, now).agg(F.lit("events_removed").alias("name"), F.count(F.lit(1)).alias("count"))
    if dry_run:
        zero = store.memories.sparkSession.createDataFrame([("orphan_relationships", 0), ("orphan_entities", 0)], "name string, count bigint")
        return parts.union(events.select("name", "count")).union(zero)
    purged = purge(store, doomed(store.memories, policy, now))
    edges = orphan_relationships(purged)
    trimmed = purged.with_(relationships=purged.relationships.join(edges, "id", "left_anti").select(*purged.relationships.columns))
    for name, df in (("orphan_relationships", edges), ("orphan_entities", orphan_entities(trimmed))):
        events = events.select("name", "count").union(df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("count")).select("name", "count"))
    return parts.union(events)


def is_due(last: str | None, now: datetime, min_interval_hours: float = 6.0) -> bool:
    """Whether clean-up should run; a last time that can't be read counts as long ago."""
    try:
        return last is None or now - datetime.fromisoformat(last) >= timedelta(hours=min_interval_hours)
    except (ValueError, TypeError):
        return True
