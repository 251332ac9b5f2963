"""The tables of the store at one version."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

# Column name and type of each table. Arrays stand where a row store would encode text or blobs.
SCHEMAS = {
    "memories": "id string, content string, normalized_content string, memory_type string, subtype string, source string, confidence double, importance double, status string, superseded_by string, created_at timestamp, updated_at timestamp, event_time string, last_recalled_at timestamp, recall_count int",
    "entities": "id string, canonical_name string, entity_type string, aliases array<string>, created_at timestamp, updated_at timestamp",
    "relationships": "id string, subject_entity_id string, predicate string, object_entity_id string, confidence double, created_at timestamp, updated_at timestamp",
    "memory_entities": "memory_id string, entity_id string, role string",
    "memory_relationships": "memory_id string, relationship_id string",
    "memory_embeddings": "memory_id string, provider string, model string, dimension int, vector array<float>, norm double, unit array<float>, created_at timestamp, updated_at timestamp",
    "retention_events": "id bigint, action string, memory_id string, superseded_id string, reason string, source string, created_at timestamp",
    "temporal_events": "id string, memory_id string, event_time string, end_time string, label string, created_at timestamp",
    "directives": "id string, content string, active boolean, created_at timestamp, updated_at timestamp",
}

# Recalls since the facts were last written; a store sums them when it is opened.
RECALLS = "id string, at timestamp"

# Tables made from others when these are written; a store may lack them.
DERIVED = {
    "postings": "token string, id string, d int, positions array<int>",
    "lexical_totals": "n bigint, tokens bigint",
    "entity_keys": "key string, id string",
}


@dataclass(frozen=True)
class Snapshot:
    """Immutable; a write gives a new one. Only the tables that an operator names are needed."""

    memories: DataFrame | None = None
    entities: DataFrame | None = None
    relationships: DataFrame | None = None
    memory_entities: DataFrame | None = None
    memory_relationships: DataFrame | None = None
    memory_embeddings: DataFrame | None = None
    retention_events: DataFrame | None = None
    temporal_events: DataFrame | None = None
    directives: DataFrame | None = None
    postings: DataFrame | None = None
    lexical_totals: DataFrame | None = None
    entity_keys: DataFrame | None = None
    version: int | None = None  # of the store that it was opened from; a commit checks it

    def with_(self, **tables: DataFrame) -> Snapshot:
        """With other tables; postings of facts and keys of entities that are replaced go, unless new ones are given."""
        if "memories" in tables and "postings" not in tables:
            tables |= {"postings": None, "lexical_totals": None}
        if "entities" in tables and "entity_keys" not in tables:
            tables |= {"entity_keys": None}
        return replace(self, **tables)
