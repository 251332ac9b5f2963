"""Turns as a stream: files of turns in, retained facts out, each micro-batch committed once.

One writer takes the micro-batches in order, so decisions are serial; a batch that is replayed after a
failure is recognised by its number and changes nothing. The source takes a bounded number of files a
batch, which is the queue's bound: nothing is dropped, a backlog waits.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable
from datetime import datetime, timezone
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from factloom.operators import maintenance, retention
from factloom.operators.folding import NOT_DURABLE
from factloom.operators.snapshot import Snapshot
from factloom.plans.retain import Batch, Decision, decisions, in_order, with_keys
from factloom.sources.models import Extractor, extract_rows
from factloom.sources.store import Store

TURN = "session_id string, seq bigint, user string, assistant string"


def read_turns(spark: SparkSession, folder: str, files_per_batch: int = 128) -> DataFrame:
    """JSON lines of turns, as they arrive in ``folder``."""
    return spark.readStream.schema(TURN).option("maxFilesPerTrigger", files_per_batch).json(folder)


class TurnQueue:
    """Turns of one host that wait for retention: at most ``most``, the newest are refused and counted beyond."""

    def __init__(self, most: int = 128) -> None:
        self.most, self.dropped = most, 0
        self._waiting: deque[tuple[str, str, str]] = deque()
        self._lock = Lock()

    def __len__(self) -> int:
        return len(self._waiting)

    def offer(self, session: str, user: str, assistant: str) -> bool:
        with self._lock:
            if len(self._waiting) >= self.most:
                self.dropped += 1
                return False
            self._waiting.append((session, user, assistant))
            return True

    def take(self) -> list[tuple[str, str, str]]:
        """All that wait, which then wait no more."""
        with self._lock:
            taken = list(self._waiting)
            self._waiting.clear()
            return taken


def worthwhile(turns: DataFrame) -> DataFrame:
    """Turns that say something, with the text to extract from; stateless."""
    return retention.turn_texts(turns.withColumns({"user": F.coalesce("user", F.lit("")), "assistant": F.coalesce("assistant", F.lit(""))}))


def retain_batch(store: Store, batch: DataFrame, batch_id: str, extractor: Extractor, options: dict | None = None, policy: maintenance.Policy | None = None, now: Callable[[], datetime] | None = None) -> list[Decision]:
    """Extract and decide on the executors, in the order of (session, seq, place), commit, then clean up if due; the
    decisions, for a host whose queue bounds them. A stream uses :func:`retained` and collects nothing."""
    if store.has_batch(batch_id):
        return []
    told, engine = retained(store, batch, batch_id, extractor, options, policy, now)
    try:
        return decisions(told)
    finally:
        engine.discard()


def retained(store: Store, batch: DataFrame, batch_id: str, extractor: Extractor, options: dict | None = None, policy: maintenance.Policy | None = None, now: Callable[[], datetime] | None = None) -> tuple[DataFrame, Batch]:
    """The outcomes as a table, after the commit; whoever has read it discards the batch's tables. If another writer
    commits meanwhile, the extracted facts are decided again on its version."""
    at = (now or (lambda: datetime.now(timezone.utc)))()
    payloads = extract_rows(worthwhile(batch), extractor, ["session_id", "seq"]).withColumnRenamed("seq", "turn")
    facts = retention.parse_extractions(payloads.filter("payload is not null").select("session_id", "turn", "payload"))
    engine = Batch(store.open(), at, **(options or {}))
    shaped = facts.withColumn("source", F.concat(F.lit("turn:"), "session_id")).withColumn("refused", F.when(~F.col("durable"), F.lit(NOT_DURABLE)))
    placed = with_keys(in_order(shaped, engine.keep, "session_id", "turn", "seq"))

    def decided(now: Snapshot) -> tuple[DataFrame, Snapshot, list[str]]:
        engine.store = now
        told = engine.outcomes(placed)
        return told, *engine.applied(placed, told)

    told = store.change(decided, batch=batch_id)
    clean_up(store, policy or maintenance.Policy(), at)
    return told, engine


def clean_up(store: Store, policy: maintenance.Policy, now: datetime, min_interval_hours: float = 6.0, force: bool = False) -> dict | None:
    """Maintenance, at most once in an interval; the report, or None where it wasn't due."""
    if not force and not maintenance.is_due(store.manifest()["metadata"].get("last_maintenance_at"), now, min_interval_hours):
        return None
    before = store.open()
    report = {r["name"]: r["count"] for r in maintenance.report(before, policy, now).collect()}
    changed = ["memories", "entities", "relationships", "memory_entities", "memory_relationships", "memory_embeddings", "retention_events"] if any(report.values()) else []
    store.commit(maintenance.survivors(before, policy, now), changed, metadata={"last_maintenance_at": now.isoformat()})
    if sum(report[k] for k in ("superseded_removed", "deleted_removed", "expired_unused")) >= maintenance.COMPACT_FROM:
        store.compact()
    return report


def retain_stream(turns: DataFrame, store: Store, extractor: Extractor, checkpoint: str, options: dict | None = None, policy: maintenance.Policy | None = None) -> DataStreamWriter:
    """A writer that retains each micro-batch; ``start()`` it."""

    def each(batch: DataFrame, number: int) -> None:
        name = f"{checkpoint}#{number}"
        if not store.has_batch(name):
            retained(store, batch, name, extractor, options, policy)[1].discard()

    return turns.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def write_turns(path: str, turns: list[dict]) -> None:
    """A file of turns for :func:`read_turns`; for tests and small hosts."""
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(json.dumps(t, ensure_ascii=False) + "\n" for t in turns)
