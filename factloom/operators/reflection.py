"""Broad candidates for a reflective question, cut to a bundle of bounded size."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import timedelta
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import QUESTION_WORDS
from factloom.operators import entity, fusion, graph, lexical, temporal
from factloom.operators.listing import within_budget
from factloom.operators.snapshot import Snapshot

_MONTH = timedelta(days=30)
MOST_QUERY_CHARS, MOST_CONTENT_CHARS = 8000, 8000


class Reflector(Protocol):
    def reflect(self, query: str, bundle: dict) -> str: ...


def terms_of(query: str) -> list[str]:
    words = [w.casefold() for w in re.findall(r"[\w.+#-]+", query)]
    return list(dict.fromkeys(w for w in words if len(w) >= 3 and w not in QUESTION_WORDS))[:12]


@dataclass(frozen=True)
class Bundle:
    """items: place, used (characters so far) and the facts' columns; truncated: one row."""

    items: DataFrame
    candidates: DataFrame


def candidates(store: Snapshot, query: str, base_limit: int, per_entity: int = 8, backend: fusion.Backend | None = None) -> DataFrame:
    """id, score, sources: recall first, then what single terms, attached entities and nearby times add.

    Every stage is a list of bounded length (100 hits, 12 terms, 16 names, 4 times, ``per_entity`` each),
    found for all its terms or names in one plan; a fact keeps the first stage that found it.
    """
    found: dict[str, tuple[float, list[str]]] = {}
    pool = min(100, max(4 * base_limit, 20))
    for r in fusion.recall(store, query, pool, backend=backend).orderBy(F.desc("score"), "id").collect():
        found[r["id"]] = (r["score"], list(r["sources"]))

    def add(*stages: tuple[str, DataFrame]) -> None:
        rows = [(r["q"], k, r["place"], r["id"], source) for k, (source, df) in enumerate(stages) for r in df.select("q", "id", "place").collect()]
        for *_, key, source in sorted(rows):
            found.setdefault(key, (0.0, [source]))

    terms, few = terms_of(query), min(6, per_entity)
    add(("reflect_term", lexical.search_many(store, terms, few)), ("reflect_entity_seed", entity.arm_many(store, entity.match_many(store.entities, terms), few)))
    names = _names_of(store, list(found))[:16]
    matched = entity.match_many(store.entities, names)
    add(("reflect_entity", entity.arm_many(store, matched, per_entity)), ("reflect_graph", graph.arm_many(store, matched, per_entity)))
    for at in _times_of(store, list(found))[:4]:
        near = temporal.window(store.memories, f"{at - _MONTH:%Y-%m-%d %H:%M:%S}", f"{at + _MONTH:%Y-%m-%d %H:%M:%S}", limit=per_entity)
        for r in near.collect():
            found.setdefault(r["id"], (0.0, ["reflect_temporal"]))
    return store.memories.sparkSession.createDataFrame([(k, s, sources) for k, (s, sources) in found.items()], "id string, score double, sources array<string>")


def _names_of(store: Snapshot, ids: list[str]) -> list[str]:
    own = {r["memory_id"]: r["entities"] for r in entity.names_by_memory(store.with_(memory_entities=store.memory_entities.filter(F.col("memory_id").isin(ids)))).collect()}
    return list(dict.fromkeys(n for i in ids for n in own.get(i, [])))


def _times_of(store: Snapshot, ids: list[str]) -> list:
    column = "event_ts" if "event_ts" in store.memories.columns else "event_time"
    times = store.memories.filter(F.col("id").isin(ids)).select("id", F.col(column).try_cast("timestamp").alias("at")).filter("at is not null")
    by_id = {r["id"]: r["at"] for r in times.collect()}
    return list(dict.fromkeys(by_id[i] for i in ids if i in by_id))


def build_bundle(store: Snapshot, query: str, max_memories: int = 24, max_chars: int = 40_000, per_entity: int = 8, backend: fusion.Backend | None = None) -> Bundle:
    """The best candidates whose JSON fits the budget; the first that doesn't ends the bundle."""
    query = query.strip()
    if not 1 <= len(query) <= MOST_QUERY_CHARS:
        raise ValueError(f"a question has 1 to {MOST_QUERY_CHARS} characters")
    if not (1 <= max_memories <= 40 and 1000 <= max_chars <= 60_000 and 1 <= per_entity <= 25):
        raise ValueError("max_memories is 1 to 40, max_chars 1000 to 60000, per_entity 1 to 25")
    pool = candidates(store, query, max_memories, per_entity, backend)
    facts = store.memories.join(F.broadcast(pool), "id")
    named = facts.join(entity.names_by_memory(store).withColumnRenamed("memory_id", "id"), "id", "left")
    content = F.substring("content", 1, MOST_CONTENT_CHARS)
    time = "event_ts" if "event_ts" in store.memories.columns else "event_time"
    rows = named.select("id", content.alias("content"), "memory_type", "subtype", F.col(time).cast("string").alias("event_time"), "importance", "confidence", "score", "sources", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), (F.length("content") > MOST_CONTENT_CHARS).alias("content_truncated"))
    size = F.length(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))
    order = [F.when(F.col("score") > 0, 0).otherwise(1), F.desc("score"), F.desc("importance"), F.desc("confidence"), F.col("id")]
    return Bundle(within_budget(rows, size, order, max_chars, max_memories), pool)


def reflect(store: Snapshot, query: str, reflector: Reflector, **options) -> dict:
    """The reflector's answer and the facts it rests on; without facts there is no call."""
    bundle = build_bundle(store, query, **options)
    items = [r.asDict(True) for r in bundle.items.orderBy("place").collect()]
    if not items:
        return {"answer": "", "memory_ids": [], "truncated": False, "candidate_count": 0}
    count = bundle.candidates.count()
    memories = [{k: v for k, v in i.items() if k not in ("used", "place")} for i in items]
    answer = reflector.reflect(query.strip(), {"query": query.strip(), "memory_count": len(items), "candidate_count": count, "truncated": len(items) < count, "memories": memories})
    return {"answer": answer, "memory_ids": [i["id"] for i in items], "truncated": len(items) < count, "candidate_count": count}
