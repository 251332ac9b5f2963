"""Entity matching, lookups by name, and what hangs on entities and facts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import STOPWORDS, ingested_key, normalize, tokenize
from factloom.operators.lexical import query_keywords, words_of
from factloom.operators.snapshot import Snapshot

PREFILTER_CAP = 500  # of the queries whose SQL narrows entities by id


def clamp(limit: int, most: int) -> int:
    return max(1, min(int(limit), most))


def cut(rows: DataFrame, limit: int | None, most: int, *order: Column | str) -> DataFrame:
    """The first rows in order; without a limit all of them, in none."""
    return rows if limit is None else rows.orderBy(*order).limit(clamp(limit, most))


def _names(entities: DataFrame) -> Column:
    aliases = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in entities.columns else F.array().cast("array<string>")
    return F.concat(F.array("canonical_name"), aliases)


def match(entities: DataFrame, query: str, limit: int | None = 25, most: int | None = None) -> DataFrame:
    """entity_id and score of the best entities that the query names; all of them without a limit.

    A name (or alias) whose words stand in the query in a row scores 10 and its number of words; else
    it scores its words among the query's keywords. Entities are first narrowed to those with a keyword
    somewhere in a name (and to the first ``most`` of these by id where that is asked for). So a name of
    stopwords alone never matches.
    """
    terms = query_keywords(query, 12)
    padded = " " + " ".join(words_of(query)) + " "
    names = entities.select("id", F.explode(_names(entities)).alias("name"))
    if not terms:
        return names.select(F.col("id").alias("entity_id"), F.lit(0).alias("score")).limit(0)
    wanted = F.array(*map(F.lit, terms))
    some = entities.filter(F.exists(_names(entities), lambda n: F.exists(wanted, lambda t: F.contains(F.lower(n), t))))
    some = some if most is None else some.orderBy("id").limit(most)
    worded = some.select("id", F.explode(F.transform(_names(entities), tokenize)).alias("words"))
    whole = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    loose = F.size(F.filter("words", lambda w: F.array_contains(wanted, w)))
    score = F.when((F.size("words") > 0) & F.contains(F.lit(padded), whole), 10 + F.size("words")).otherwise(loose)
    best = worded.select("id", score.alias("score")).groupBy("id").agg(F.max("score").alias("score")).filter("score > 0")
    best = best.select(F.col("id").alias("entity_id"), "score")
    return best if limit is None else best.orderBy(F.desc("score"), "entity_id").limit(limit)


def match_many(entities: DataFrame, queries: list[str], limit: int | None = None) -> DataFrame:
    """q (the query's number), entity_id and score for a short list of queries, each as by :func:`match`: of all entities
    that a query names, or of the best ``limit``."""
    asked = [(k, query_keywords(q, 12), " " + " ".join(words_of(q)) + " ") for k, q in enumerate(queries)]
    asked = [x for x in asked if x[1]]
    if not asked:
        return entities.select(F.lit(0).alias("q"), F.col("id").alias("entity_id"), F.lit(0).alias("score")).limit(0)
    literal = F.array(*[F.struct(F.lit(k).alias("q"), F.array(*map(F.lit, terms)).alias("terms"), F.lit(padded).alias("padded")) for k, terms, padded in asked])
    named = entities.select("id", _names(entities).alias("names"), F.transform(_names(entities), tokenize).alias("words"))
    fits = F.filter(literal, lambda x: F.exists("names", lambda n: F.exists(x["terms"], lambda t: F.contains(F.lower(n), t))))
    some = named.select("id", "words", F.explode(fits).alias("a"))

    def score(words: Column) -> Column:
        whole = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        loose = F.size(F.filter(words, lambda w: F.array_contains(F.col("a.terms"), w)))
        return F.when((F.size(words) > 0) & F.contains(F.col("a.padded"), whole), 10 + F.size(words)).otherwise(loose)

    best = some.select("a.q", F.col("id").alias("entity_id"), F.array_max(F.transform("words", score)).alias("score")).filter("score > 0")
    if limit is None:
        return best
    place = Window.partitionBy("q").orderBy(F.desc("score"), "entity_id")
    return best.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit).drop("place")


def arm_many(store: Snapshot, matched: DataFrame, limit: int) -> DataFrame:
    """q, id and place of the best active facts of each query's entities, as by :func:`arm`."""
    linked = store.memory_entities.join(matched, "entity_id").groupBy("q", F.col("memory_id").alias("id")).agg(F.max("score").alias("weight"))
    found = store.memories.filter("status = 'active'").select("id", "importance", "updated_at").join(linked, "id")
    place = Window.partitionBy("q").orderBy(F.desc("weight"), F.desc("importance"), "updated_at", "id")
    return found.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit).select("q", "id", "place")


def arm(store: Snapshot, query: str, limit: int | None = 20, matched: DataFrame | None = None) -> DataFrame:
    """Active facts of the matched entities (of the best 25 where none are given): id, weight of the best entity; best
    first, or all without a limit.

    Ties: importance falling, then updated_at rising, then id.
    """
    matched = F.broadcast(match(store.entities, query)) if matched is None else matched  # 25 rows at most
    linked = store.memory_entities.join(matched, "entity_id").groupBy(F.col("memory_id").alias("id")).agg(F.max("score").alias("weight"))
    found = store.memories.filter("status = 'active'").join(linked, "id")
    return cut(found.select("id", "weight", "importance", "updated_at"), limit, 100, F.desc("weight"), F.desc("importance"), "updated_at", "id")


def name_key(name: str) -> str:
    """The normal form of a name that the driver holds."""
    return " ".join(unicodedata.normalize("NFKC", name).lower().split())


def key_rows(entities: DataFrame) -> DataFrame:
    """key, id: the normal forms of all names and aliases of entities, to be made when they are written. Only names
    beyond ASCII go through NFKC."""
    names = entities.select("id", F.explode(_names(entities)).alias("n")).filter("n is not null")
    folded = names.filter(F.col("n").rlike(r"[^\x00-\x7f]")).select(ingested_key("n").alias("key"), "id")
    return names.select(normalize("n").alias("key"), "id").unionByName(folded).distinct()


def in_key_order(keys: DataFrame, parts: int) -> DataFrame:
    """Written like this, a lookup reads the row groups of its own keys alone."""
    return keys.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")


def keys_of(store: Snapshot | DataFrame) -> DataFrame:
    """key and id: the written keys of a store that has them; else made from the names."""
    if isinstance(store, DataFrame):
        return key_rows(store)
    return key_rows(store.entities) if store.entity_keys is None else store.entity_keys


def with_any_name(store: Snapshot | DataFrame, names: list[str]) -> DataFrame:
    """Entities of a store (or a table of them) with a name or alias of one of the normal forms."""
    wanted = sorted({name_key(n) for n in names})
    own = keys_of(store).filter(F.col("key").isin(wanted)).select("id")
    return (store if isinstance(store, DataFrame) else store.entities).join(own, "id", "left_semi")


def find_by_name(store: Snapshot | DataFrame, name: str) -> DataFrame:
    """The entity, by smallest id, with a name or alias that normalises to ``name``."""
    return with_any_name(store, [name]).orderBy("id").limit(1)


def with_names(store: Snapshot) -> DataFrame:
    """Relationships with the names of both ends."""
    names = store.entities.select("id", "canonical_name")
    subject = names.select(F.col("id").alias("subject_entity_id"), F.col("canonical_name").alias("subject_name"))
    object_ = names.select(F.col("id").alias("object_entity_id"), F.col("canonical_name").alias("object_name"))
    return store.relationships.join(subject, "subject_entity_id").join(object_, "object_entity_id")


def neighbors(store: Snapshot, entity_id: str, limit: int = 100) -> DataFrame:
    """Edges into and out of an entity, the latest first."""
    own = store.relationships.filter((F.col("subject_entity_id") == entity_id) | (F.col("object_entity_id") == entity_id))
    named = with_names(store.with_(relationships=own))
    order = [F.desc("updated_at")] if "updated_at" in named.columns else []
    return named.orderBy(*order, "id").limit(clamp(limit, 500))


def memories_for_entity_names(store: Snapshot, names: list[str], subtype: str | None = None, limit: int = 50) -> DataFrame:
    """Active facts linked to an entity that has one of the names; the latest first."""
    own = with_any_name(store, names).select(F.col("id").alias("entity_id"))
    ids = store.memory_entities.join(own, "entity_id", "left_semi").select(F.col("memory_id").alias("id"))
    found = store.memories.filter("status = 'active'").join(ids, "id", "left_semi")
    if subtype is not None:
        found = found.filter(F.col("subtype") == subtype)
    return found.orderBy(F.desc("updated_at"), "id").limit(clamp(limit, 200))


def memories_for_signature(store: Snapshot, subject: str, predicate: str) -> DataFrame:
    """Active facts that say (subject, predicate, something), with the object's name."""
    own = with_any_name(store, [subject]).select(F.col("id").alias("subject_entity_id"))
    edges = store.relationships.filter(F.col("predicate") == predicate).join(own, "subject_entity_id", "left_semi")
    objects = store.entities.select(F.col("id").alias("object_entity_id"), F.col("canonical_name").alias("relationship_object"))
    named = edges.join(objects, "object_entity_id").select(F.col("id").alias("relationship_id"), "relationship_object")
    linked = store.memory_relationships.join(named, "relationship_id").select(F.col("memory_id").alias("id"), "relationship_object").distinct()
    return store.memories.filter("status = 'active'").join(linked, "id").orderBy(F.desc("updated_at"), "id")


def memories_for_entity(store: Snapshot, entity_id: str, include_inactive: bool = False, limit: int | None = 500) -> DataFrame:
    """Facts linked to an entity, the latest first, up to ``limit`` (5000 at most); with None all of them, in no order."""
    ids = store.memory_entities.filter(F.col("entity_id") == entity_id).select(F.col("memory_id").alias("id"))
    found = store.memories.join(ids, "id", "left_semi")
    found = found if include_inactive else found.filter("status = 'active'")
    return found if limit is None else found.orderBy(F.desc("updated_at"), "id").limit(clamp(limit, 5000))


def entities_for_memory(store: Snapshot, memory_id: str) -> DataFrame:
    links = store.memory_entities.filter(F.col("memory_id") == memory_id).select(F.col("entity_id").alias("id"), "role")
    return store.entities.join(links, "id").orderBy(F.lower("canonical_name"), "id")


def relationships_for_memory(store: Snapshot, memory_id: str) -> DataFrame:
    ids = store.memory_relationships.filter(F.col("memory_id") == memory_id).select(F.col("relationship_id").alias("id"))
    own = store.relationships.join(ids, "id", "left_semi")
    return with_names(store.with_(relationships=own)).orderBy("subject_name", "predicate", "object_name", "id")


def names_by_memory(store: Snapshot, most: int = 32) -> DataFrame:
    """memory_id and the sorted names of its entities, ``most`` at most."""
    names = store.entities.select(F.col("id").alias("entity_id"), "canonical_name")
    each = store.memory_entities.join(names, "entity_id").select("memory_id", "canonical_name").distinct()
    place = Window.partitionBy("memory_id").orderBy("canonical_name")
    few = each.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most)
    return few.groupBy("memory_id").agg(F.array_sort(F.collect_list("canonical_name")).alias("entities"))


def stopword_only(query: str) -> bool:
    return all(w in STOPWORDS or len(w) < 2 for w in words_of(query))
