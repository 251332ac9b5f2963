"""From turns to facts: pairing, parsing of extractions, and what a new fact does to the old ones.

The set-oriented parts are frames. Within a micro-batch a fact sees the effects of those before it, so
the decisions are folded in order on the driver, over the facts of a few turns (32 a turn at most) and
the handful of candidates of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import clamp01, clean_name, collapse, is_single_valued, is_trivial, looks_sensitive, normalize, valid_event_time
from factloom.operators.snapshot import Snapshot

MOST_FACTS, MOST_PARTS, MOST_ALIASES = 32, 24, 16
SUBTYPES = ("preference", "decision", "configuration", "project_state", "procedure", "event", "troubleshooting", "relationship", "fact", "directive")
PREDICATE = r"^[A-Za-z0-9_.:-]{1,80}$"

# Lists hold the text of their items, and leaves are strings: a value of a wrong type drops itself alone.
PAYLOAD = "memories array<string>"
FACT = "content string, memory_type string, subtype string, confidence string, importance string, event_time string, durable string, entities array<string>, relationships array<string>"
ENTITY = "name string, entity_type string, role string, aliases array<string>"
EDGE = "subject string, predicate string, object string, confidence string"


def pair_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, user, assistant: each user turn that an assistant turn follows."""
    place = Window.partitionBy("conv_id").orderBy("turn")
    after = conversations.select("conv_id", "turn", "role", "text", F.lead("text").over(place).alias("assistant"), F.lead("role").over(place).alias("next"))
    return after.filter("role = 'user' and next = 'assistant'").select("conv_id", "turn", F.col("text").alias("user"), "assistant")


def turn_texts(pairs: DataFrame, user_chars: int = 100_000, assistant_chars: int = 1500) -> DataFrame:
    """``pairs`` with the text to extract from; turns that say nothing are left out, long ones cut."""
    user, assistant = F.trim("user"), F.trim("assistant")
    text = F.concat(F.lit("User: "), F.substring(user, 1, user_chars), F.lit("\nAssistant (context only): "), F.substring(assistant, 1, assistant_chars))
    return pairs.filter(~is_trivial("user")).withColumn("text", text)


def parse_extractions(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``payloads`` with one row per valid fact: seq, content, memory_type, subtype, confidence, importance,
    event_time, durable, entities, relationships.

    Of a payload the first 32 facts count. Facts without content, of more than 10,000 characters, with a
    secret or an unknown type are dropped; an unknown subtype becomes "fact". Entities and relationships
    (the first 24 each) with bad names or predicates are dropped, as are aliases that equal the name.
    """
    parsed = payloads.withColumn("__x", F.from_json(column, PAYLOAD))
    each = parsed.select(*[c for c in payloads.columns if c != column], F.posexplode(F.slice("__x.memories", 1, MOST_FACTS)).alias("seq", "m")).withColumn("m", F.from_json("m", FACT))
    content = collapse(F.coalesce("m.content", F.lit("")))
    kind = F.lower(F.trim(F.coalesce("m.memory_type", F.lit("world"))))
    subtype = F.lower(F.trim("m.subtype"))
    subtype = F.when(subtype.isNull() | (subtype == ""), subtype).when(subtype.isin(*SUBTYPES), subtype).otherwise("fact")

    def entity(text: Column) -> Column:
        e = F.from_json(text, ENTITY)
        name = clean_name(e["name"])
        aliases = F.transform(F.slice(F.coalesce(e["aliases"], F.array().cast("array<string>")), 1, MOST_ALIASES), clean_name)
        aliases = F.array_distinct(F.filter(aliases, lambda a: a.isNotNull() & (normalize(a) != normalize(name))))
        role = F.substring(F.trim(F.coalesce(e["role"], F.lit("mentioned"))), 1, 80)
        etype = F.substring(F.trim(F.coalesce(e["entity_type"], F.lit(""))), 1, 80)
        return F.struct(name.alias("name"), F.when(etype != "", etype).alias("entity_type"), F.when(role == "", "mentioned").otherwise(role).alias("role"), aliases.alias("aliases"))

    def relationship(text: Column) -> Column:
        r = F.from_json(text, EDGE)
        predicate = F.trim(r["predicate"])
        return F.struct(clean_name(r["subject"]).alias("subject"), F.when(predicate.rlike(PREDICATE), predicate).alias("predicate"), clean_name(r["object"]).alias("object"), clamp01(r["confidence"]).alias("confidence"))

    entities = F.filter(F.transform(F.slice("m.entities", 1, MOST_PARTS), entity), lambda e: e["name"].isNotNull())
    edges = F.filter(F.transform(F.slice("m.relationships", 1, MOST_PARTS), relationship), lambda r: r["subject"].isNotNull() & r["predicate"].isNotNull() & r["object"].isNotNull())
    durable = F.when(F.col("m.durable").isNull(), True).otherwise(F.col("m.durable") == "true")
    rows = each.select(
        *[c for c in payloads.columns if c != column], "seq", content.alias("content"), kind.alias("memory_type"), subtype.alias("subtype"),
        clamp01(F.col("m.confidence")).alias("confidence"), clamp01(F.col("m.importance")).alias("importance"), valid_event_time(F.col("m.event_time")).alias("event_time"),
        durable.alias("durable"), F.coalesce(entities, F.array()).alias("entities"), F.coalesce(edges, F.array()).alias("relationships"),
    )
    known = F.col("memory_type").isin("world", "experience", "observation")
    return rows.filter(F.length("content").between(1, 10_000) & known & ~looks_sensitive("content"))


def contradicted_edges(store: Snapshot, incoming: DataFrame) -> DataFrame:
    """new_id and relationship_id: edges whose single-valued statement an incoming one (memory_id,
    subject_entity_id, predicate, object_entity_id) contradicts, that is, gives another object."""
    own = incoming.filter(is_single_valued("predicate"))
    names = store.entities.select(F.col("id").alias("object_entity_id"), normalize("canonical_name").alias("object_key"))
    new = own.join(names, "object_entity_id").select(F.col("memory_id").alias("new_id"), "subject_entity_id", "predicate", F.col("object_key").alias("new_key"))
    old = store.relationships.join(names, "object_entity_id").select(F.col("id").alias("relationship_id"), "subject_entity_id", "predicate", F.col("object_key").alias("old_key"))
    return new.join(old, ["subject_entity_id", "predicate"]).filter("new_key <> old_key").select("new_id", "relationship_id").distinct()


def exclusive_conflicts(store: Snapshot, incoming: DataFrame) -> DataFrame:
    """new_id and old_id: the active facts that hold a contradicted edge."""
    linked = contradicted_edges(store, incoming).join(store.memory_relationships, "relationship_id").select("new_id", F.col("memory_id").alias("old_id"))
    active = store.memories.filter("status = 'active'").select(F.col("id").alias("old_id"))
    return linked.join(active, "old_id", "left_semi").select("new_id", "old_id").distinct()
