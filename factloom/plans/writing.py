"""Queries of writes, lookups and text functions, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from functools import partial
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.plans import retain
from factloom.operators import entity, fusion, lexical, listing, maintenance, retention, semantic, writes
from factloom.plans.catalog import ALL, NOW, QUESTION, RECALL_TABLES, VECTOR, WORDS, _context_arms, d_lexical, query, strings, with_rank
from factloom.plans.fixtures import clauses, project, query_vector, snapshot
from factloom.sources.folders import shared_folder
from factloom.sources.store import Store

AT = f"timestamp '{NOW:%Y-%m-%d %H:%M:%S}'"
NARROW = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in NARROW)  # full-width forms, which NFKC makes narrow


def sql_on(spark: SparkSession, sf_dir: str, statement: str, *tables: str) -> DataFrame:
    """A statement with tables in braces; DuckDB takes it with the braces off."""
    return spark.sql(statement, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def _kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Written and read back."""
    path = f"{shared_folder(spark)}/query-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain(statement: str) -> str:
    return statement.replace("{", "").replace("}", "")


# -- lookups ------------------------------------------------------------------


@query(clauses("memories") + "select id, status, md5(content) as content_md5 from memories where id = 'mem_00000042'")
def fact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing.get(snapshot(spark, sf_dir, "memories").memories, "mem_00000042")
    return found.select("id", "status", F.md5("content").alias("content_md5"))


@query(clauses("entities") + "select id, canonical_name from entities where canonical_name = 'NATION_7'")
def find_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a full-width, lower-case form of its name."""
    return entity.find_by_name(snapshot(spark, sf_dir, "entities", "entity_keys"), " ｎａｔｉｏｎ＿７ ").select("id", "canonical_name")


@query(clauses("memories", "memory_entities") + "select id, status, row_number() over (order by updated_at desc, id) as rank from memories where id in (select memory_id from memory_entities where entity_id = 'ent_n7')")
def facts_of_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of them: ranks are counted by range, not in one task."""
    found = entity.memories_for_entity(snapshot(spark, sf_dir, "memories", "memory_entities"), "ent_n7", include_inactive=True, limit=None)
    placed = retain.in_order(found.select("id", "status", "updated_at"), partial(_kept, spark), F.desc("updated_at"), F.col("id"))
    return placed.select("id", "status", (F.col("place") + 1).cast("int").alias("rank"))


@query(clauses("entities", "memory_entities") + "select id, canonical_name, role from memory_entities join entities on id = entity_id where memory_id = 'mem_00000006'")
def entities_of_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.entities_for_memory(snapshot(spark, sf_dir, "entities", "memory_entities"), "mem_00000006").select("id", "canonical_name", "role")


@query(clauses("entities", "relationships", "memory_relationships") + "select r.id, s.canonical_name as subject_name, predicate, o.canonical_name as object_name from memory_relationships join relationships r on r.id = relationship_id join entities s on s.id = subject_entity_id join entities o on o.id = object_entity_id where memory_id = 'mem_00000006'")
def relationships_of_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = snapshot(spark, sf_dir, "entities", "relationships", "memory_relationships")
    return entity.relationships_for_memory(store, "mem_00000006").select("id", "subject_name", "predicate", "object_name")


@query(
    clauses(*RECALL_TABLES, more=", ".join(_context_arms()))
    + " union all ".join(f"select '{arm}' as arm, count(*) as count from {table}" for arm, table in (("lexical", "near"), ("entity", "ea"), ("graph", "g"), ("semantic", "s")))
)
def arm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = fusion.Backend("fixture", "m1", query_vector(spark, sf_dir, VECTOR))
    return fusion.recall_for_context(snapshot(spark, sf_dir, *RECALL_TABLES, "postings"), QUESTION, 6, 0.1, backend).arm_counts()


# -- facts --------------------------------------------------------------------

INCOMING = f"select case when doc_id % 11 = 5 then '  ' when doc_id % 2 = 1 then translate(text, '{NARROW}', '{WIDE}') else text end as content, case when doc_id % 7 = 3 then 1.5D else 0.6D end as confidence from {{documents}}"
D_KEY = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query(f"select distinct concat('mem_', md5(concat({D_KEY}, '|', '{NOW:%Y-%m-%d %H:%M:%S}'))) as id, md5({D_KEY}) as key_md5, 'active' as status, 'world' as memory_type from documents where doc_id % 11 <> 5 and doc_id % 7 <> 3 and trim(text) <> ''")
def insert_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width texts are stored under the same normal form as narrow ones."""
    store, _ = writes.insert_memories(snapshot(spark, sf_dir, "memories").with_(memories=writes.shaped(project(spark, sf_dir, "memories"), "memories")), sql_on(spark, sf_dir, INCOMING, "documents"), NOW)
    return store.memories.filter(F.length("id") == 36).select("id", F.md5("normalized_content").alias("key_md5"), "status", "memory_type")


@query("select case when doc_id % 11 = 5 and doc_id % 7 = 3 then 'content,confidence' when doc_id % 11 = 5 then 'content' else 'confidence' end as problems, count(*) as count from documents where doc_id % 11 = 5 or doc_id % 7 = 3 group by 1")
def rejected_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = sql_on(spark, sf_dir, INCOMING, "documents").selectExpr("*", "'world' as memory_type", "0.5D as importance", "'active' as status", "cast(null as string) as source", "cast(null as string) as subtype")
    _, rejected = writes.split_valid(incoming)
    return rejected.groupBy(F.array_join("problems", ",").alias("problems")).agg(F.count(F.lit(1)).alias("count"))


@query(
    clauses("memories", "memory_embeddings", more="n as (select *, cast(substr(id, 5) as int) as k from memories)")
    + "select id, md5(case when k % 4 = 1 then concat('changed ', k) else normalized_content end) as key_md5, case when k % 8 = 1 then 0.9 else importance end as importance, k % 4 <> 1 and id in (select memory_id from memory_embeddings) as has_vector from n"
)
def update_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = snapshot(spark, sf_dir, "memories", "memory_embeddings")
    number = F.substring("id", 5, 8).cast("int")
    changes = store.memories.filter(number % 4 == 1).select("id", F.concat(F.lit("ＣＨＡＮＧＥＤ   "), number).alias("content"), F.when(number % 8 == 1, 0.9).alias("importance"))
    new = writes.update_memories(store, changes, NOW)
    held = new.memory_embeddings.select(F.col("memory_id").alias("id"), F.lit(True).alias("held"))
    return new.memories.join(held, "id", "left").select("id", F.md5("normalized_content").alias("key_md5"), "importance", F.coalesce("held", F.lit(False)).alias("has_vector"))


@query(
    clauses("memories", more="p as (select a.id as old_id, b.id as new_id from memories a join memories b on cast(substr(b.id, 5) as int) = cast(substr(a.id, 5) as int) + 1 where cast(substr(a.id, 5) as int) % 10 = 1)")
    + f"select id, case when new_id is null then status else 'superseded' end as status, coalesce(new_id, superseded_by) as superseded_by, (case when new_id is null then updated_at else {AT} end) = {AT} as updated_now from memories left join p on id = old_id"
)
def supersede_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = snapshot(spark, sf_dir, "memories")
    ids = store.memories.select("id", F.substring("id", 5, 8).cast("int").alias("k"))
    pairs = ids.filter("k % 10 = 1").select(F.col("id").alias("old_id"), (F.col("k") + 1).alias("k")).join(ids.select(F.col("id").alias("new_id"), "k"), "k")
    new = writes.supersede(store, pairs, NOW)
    return new.memories.select("id", "status", "superseded_by", (F.col("updated_at") == F.lit(f"{NOW:%Y-%m-%d %H:%M:%S}").cast("timestamp")).alias("updated_now"))


@query(clauses("memories") + "select id, case when cast(substr(id, 5) as int) % 6 = 2 then 'deleted' else status end as status from memories")
def soft_deleted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = snapshot(spark, sf_dir, "memories")
    return writes.soft_delete(store, store.memories.filter(F.substring("id", 5, 8).cast("int") % 6 == 2), NOW).memories.select("id", "status")


@query(
    clauses(*ALL, more="gone as (select id from memories where cast(substr(id, 5) as int) % 9 = 0)")
    + "select 'memories' as name, count(*) as count from memories where id not in (select id from gone) union all select 'pointers', count(*) from memories where id not in (select id from gone) and superseded_by is not null and superseded_by not in (select id from gone)"
    + "".join(f" union all select '{t}', count(*) from {t} where memory_id not in (select id from gone)" for t in ("memory_entities", "memory_relationships", "memory_embeddings"))
    + " union all select 'named_events', count(*) from retention_events where memory_id not in (select id from gone)"
)
def purged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = snapshot(spark, sf_dir, *ALL)
    left = maintenance.purge(store, store.memories.filter(F.substring("id", 5, 8).cast("int") % 9 == 0).select("id"))
    counted = {"memories": left.memories, "pointers": left.memories.filter("superseded_by is not null"), **{t: getattr(left, t) for t in ("memory_entities", "memory_relationships", "memory_embeddings")}, "named_events": left.retention_events.filter("memory_id is not null")}
    out = None
    for name, df in counted.items():
        row = df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("name"), "count")
        out = row if out is None else out.union(row)
    return out


@query(clauses("memory_embeddings") + "select memory_id, model from memory_embeddings where cast(substr(memory_id, 5) as int) % 4 <> 0")
def dropped_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = project(spark, sf_dir, "memory_embeddings")
    return semantic.delete(table, table.filter(F.substring("memory_id", 5, 8).cast("int") % 4 == 0)).select("memory_id", "model")


# -- retention ----------------------------------------------------------------

NEW_FACTS = f"""select doc_id as place, 'doc' as source, text as content, cast(null as string) as refused, cast(null as string) as subject, cast(null as string) as predicate, cast(null as string) as object from {{documents}} where doc_id % 4 = 1
 union all select 1000000000 + c_custkey, 'customer', concat('Statement ', cast(c_custkey as string)), case when c_custkey % 9 = 4 then 'not durable' end, c_name, case when c_custkey % 2 = 0 then 'lives_in' else 'visited' end,
 concat('NATION_', cast((c_nationkey + c_custkey % 3) % 25 as string)) from {{customer}}"""


def new_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sql_on(spark, sf_dir, NEW_FACTS, "documents", "customer")
    shaped = rows.selectExpr(
        "cast(place as long) place", "source", "content", "'world' memory_type", "'fact' subtype", "0.5D confidence", "0.5D importance", "cast(null as string) event_time", "refused",
        f"cast(array() as array<{retain.ENTITY}>) entities", f"case when subject is null then cast(array() as array<{retain.EDGE}>) else array(named_struct('subject', subject, 'predicate', predicate, 'object', object, 'confidence', 0.5D)) end relationships",
    )
    return retain.with_keys(shaped)


D_FACTS = f"f as (select *, {D_KEY.replace('text', 'content')} as key from ({plain(NEW_FACTS)}) t)"


@query(
    clauses("memories", "entities", "relationships", "memory_relationships", more=D_FACTS)
    + f""", live as (select *, row_number() over (partition by normalized_content order by updated_at desc, id) as k from memories where status = 'active'),
 docs as (select f.place, f.key, l.id, l.confidence < 0.5 or l.importance < 0.5 as poor, row_number() over (partition by f.key order by f.place) as k, min(f.place) over (partition by f.key) as first from f left join live l on l.normalized_content = f.key and l.k = 1 where f.source = 'doc'),
 told as (select s.canonical_name as subject, r.predicate, o.canonical_name as object, m.id, m.updated_at from relationships r join entities s on s.id = subject_entity_id join entities o on o.id = object_entity_id
  join memory_relationships on relationship_id = r.id join memories m on m.id = memory_id and m.status = 'active'),
 clash as (select f.place, arg_min(told.id, (-epoch_us(updated_at), told.id)) as old from f join told on told.subject = f.subject and told.predicate = f.predicate and lower(told.object) <> lower(f.object) where f.predicate = 'lives_in' group by f.place)
 select place, case when id is null and k = 1 then 'created' when id is not null and k = 1 and poor then 'updated' else 'ignored' end as action, case when id is null and k = 1 then 'new durable memory' else 'exact duplicate' end as reason,
  coalesce(id, concat('mem_', md5(concat(key, '|{NOW:%Y-%m-%d %H:%M:%S}|', first)))) as memory_id, null as superseded_id from docs
 union all select f.place, case when refused is not null then 'ignored' when old is null then 'created' else 'superseded' end, coalesce(refused, case when old is null then 'new durable memory' else 'replaces outdated memory' end),
  case when refused is null then concat('mem_', md5(concat(key, '|{NOW:%Y-%m-%d %H:%M:%S}|', f.place))) end, case when refused is null then old end from f left join clash using (place) where source = 'customer'"""
)
def retention_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each fact of a batch does: a quarter of the documents said again, and a statement of every customer."""
    store = snapshot(spark, sf_dir, "memories", "entities", "relationships", "memory_entities", "memory_relationships")
    shaped = store.with_(entities=writes.shaped(store.entities, "entities"), memories=writes.shaped(store.memories, "memories"))
    told = retain.Batch(shaped, NOW).outcomes(new_facts(spark, sf_dir))
    return told.filter("kind = 'fact'").select("place", "action", "reason", "memory_id", F.get("replaced", F.lit(0)).alias("superseded_id"))


RECALLED = "select concat('mem_', lpad(cast(user_id as string), 8, '0')) as id, ts from {events} where event_type = 'view'"


@query(
    clauses("memories", more=f"r as (select id, count(*) as n, max(ts) as latest from ({plain(RECALLED)}) t group by id)")
    + "select m.id, cast(recall_count + coalesce(n, 0) as int) as recall_count, strftime(latest, '%Y-%m-%d %H:%M:%S') as recalled from memories m left join r on r.id = m.id"
)
def recalls_summed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts with a side table of recalls summed in, as a store is opened."""
    base = writes.shaped(project(spark, sf_dir, "memories"), "memories")
    summed = writes.with_recalls(base, sql_on(spark, sf_dir, RECALLED, "events").withColumnRenamed("ts", "at"))
    return summed.select("id", "recall_count", F.date_format("last_recalled_at", "yyyy-MM-dd HH:mm:ss").alias("recalled"))


# -- postings -----------------------------------------------------------------

# The facts after three commits: all of them, then a new text for those that others have taken the place of, then
# without the deleted ones.
REWORDED = "case when status = 'superseded' then concat('elle was here: ', content) else content end"


@query(
    clauses("memories").replace("memories as (", "memories_0 as (", 1).rstrip()
    + f", memories as (select * replace ({REWORDED} as content, case when status = 'superseded' then concat('elle was here: ', normalized_content) else normalized_content end as normalized_content) from memories_0 where status <> 'deleted'), "
    + d_lexical("lx", WORDS, 50).replace("where status = 'active' and (", "where (")
    + " select id, round(score, 6) as score from lx"
)
def lexical_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over facts of every status, from the segments and the log that three commits have left."""
    store = Store(spark, f"{shared_folder(spark)}/segments-{uuid4().hex}")
    facts = writes.shaped(snapshot(spark, sf_dir, "memories").memories, "memories")
    store.commit(store.open().with_(memories=facts), ["memories"])
    now = store.open()
    reworded = now.memories.withColumns({c: F.when(F.col("status") == "superseded", F.concat(F.lit("elle was here: "), F.col(c))).otherwise(F.col(c)) for c in ("content", "normalized_content")})
    store.commit(now.with_(memories=reworded), ["memories"])
    now = store.open()
    store.commit(now.with_(memories=now.memories.filter("status <> 'deleted'")), ["memories"])
    return lexical.search(store.open(), WORDS, 50, include_inactive=True).select("id", F.round("score", 6).alias("score"))


# -- entities and edges -------------------------------------------------------

NAMES = """select case c_custkey % 4 when 0 then translate('nation_3', 'nation_', 'ｎａｔｉｏｎ_') when 1 then ' Nation_5' when 2 then concat('Person ', cast(c_custkey % 50 as string)) else concat('PERSON  ', cast(c_custkey % 50 as string)) end as canonical_name,
 'person' as entity_type, array(' b ', 'a', 'b', '') as aliases, c_custkey as seq from {customer}"""


@query(clauses("entities") + "select id, lower(canonical_name) as sort_key from entities")
def name_sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What entities' names are ordered by, from their full-width forms."""
    names = snapshot(spark, sf_dir, "entities").entities
    return names.select("id", text.sort_key(F.translate("canonical_name", NARROW, WIDE)).alias("sort_key"))


@query(
    clauses("entities", more="known as (select lower(canonical_name) as k from entities), new as (select case c_custkey % 4 when 0 then 'nation_3' when 1 then 'nation_5' else concat('person ', c_custkey % 50) end as k, case c_custkey % 4 when 2 then concat('Person ', c_custkey % 50) else concat('PERSON  ', c_custkey % 50) end as n, c_custkey as seq from customer)")
    + "select id, canonical_name, entity_type, null as aliases from entities union all select concat('ent_', md5(k)), arg_min(n, seq), 'person', 'a,b' from new where k not in (select k from known) group by k"
)
def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = project(spark, sf_dir, "entities").withColumn("aliases", F.lit(None).cast("array<string>"))
    out = writes.get_or_create_entities(table, sql_on(spark, sf_dir, NAMES, "customer"), NOW)
    return out.select("id", "canonical_name", "entity_type", F.array_join("aliases", ",").alias("aliases"))


@query(
    clauses("entities")
    + "select canonical_name, entity_type, count(*) as count from (select canonical_name, entity_type from entities union all select distinct n_name, case n_nationkey % 3 when 1 then 'place' end from nation where n_nationkey % 3 <> 0) t group by 1, 2"
)
def typed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One name under several types, and under none, is several entities; the same pair is one."""
    incoming = sql_on(spark, sf_dir, "select n_name as canonical_name, case n_nationkey % 3 when 0 then 'nation' when 1 then 'place' end as entity_type, cast(null as array<string>) as aliases, n_nationkey as seq from {nation}", "nation")
    table = project(spark, sf_dir, "entities").withColumn("aliases", F.lit(None).cast("array<string>"))
    once = writes.create_entities(table, incoming.union(incoming), NOW)
    return writes.create_entities(once, incoming, NOW).groupBy("canonical_name", "entity_type").agg(F.count(F.lit(1)).alias("count"))


EDGES = """select concat('ent_s', cast(s_suppkey as string)) as subject_entity_id, case when s_suppkey % 5 = 0 then 'bad predicate!' else 'supplies' end as predicate, concat('ent_n', cast(s_nationkey as string)) as object_entity_id, k * 0.25D as confidence, 3 - k as seq from {supplier} cross join (select 1 as k union all select 2) t
 union all select concat('ent_c', cast(c_custkey as string)), 'lives_in', concat('ent_n', cast(c_nationkey as string)), 0.9D, 1 from {customer}"""


@query(clauses("relationships") + "select id, predicate, 0.5::double as confidence from relationships union all select concat('rel_', md5(concat('ent_s', s_suppkey, '|supplies|ent_n', s_nationkey))), 'supplies', 0.5::double from supplier where s_suppkey % 5 <> 0")
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal new edges the first by ``seq`` gives the confidence; here the second of the two rows."""
    table = project(spark, sf_dir, "relationships").withColumn("confidence", F.lit(0.5))
    return writes.get_or_create_relationships(table, sql_on(spark, sf_dir, EDGES, "supplier", "customer"), NOW).select("id", "predicate", "confidence")


@query(clauses("memory_entities") + "select memory_id, entity_id, role from memory_entities union select concat('mem_', lpad(cast(doc_id as string), 8, '0')), 'ent_r0', 'mentioned' from documents where doc_id % 4 = 0")
def link_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = project(spark, sf_dir, "memory_entities")
    new = sql_on(spark, sf_dir, "select concat('mem_', lpad(cast(doc_id as string), 8, '0')) as memory_id, 'ent_r0' as entity_id, 'mentioned' as role from {documents} where doc_id % 4 = 0", "documents")
    return writes.link(table.distinct(), new.union(new).union(table))


@query(clauses("retention_events") + "select last + doc_id + 1 as id, case doc_id % 3 when 0 then 'created' else 'ignored' end as action, 'why' as reason from documents, (select max(id) as last from retention_events) where doc_id % 3 <> 2")
def appended_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = writes.shaped(project(spark, sf_dir, "retention_events"), "retention_events")
    new = sql_on(spark, sf_dir, "select doc_id + 1 as seq, case doc_id % 3 when 0 then 'created' when 1 then 'ignored' else 'nothing' end as action, cast(null as string) as memory_id, cast(null as string) as superseded_id, 'why' as reason, 'here' as source from {documents}", "documents")
    return writes.append_events(table, new, NOW).filter("reason = 'why'").select("id", "action", "reason")


# -- extractions and texts ----------------------------------------------------

PAYLOAD = r"""select doc_id, concat('{"memories": [{"content": "  Fact   ', cast(doc_id as string), ' of\\n', source, ' ", "memory_type": "', case doc_id % 4 when 0 then 'World' when 1 then 'experience' when 2 then ' observation ' else 'alien' end,
 '", "subtype": "', case doc_id % 3 when 0 then 'Preference' when 1 then 'strange' else '' end, '", "confidence": ', case doc_id % 5 when 0 then '1.7' when 1 then '-1' when 2 then '"x"' when 3 then '0.25' else 'null' end,
 ', "event_time": "', case doc_id % 2 when 0 then '2024-01-05' else 'soon' end, '", "durable": ', case doc_id % 6 when 0 then 'false' else 'true' end,
 ', "entities": [{"name": " Ada  N", "aliases": ["ada n", "A."]}, {"name": ""}, 7], "relationships": [{"subject": "Ada N", "predicate": "lives_in", "object": "Pune", "confidence": 2}, {"subject": "Ada N", "predicate": "not so", "object": "x"}]},',
 ' {"content": "password: hunter', cast(doc_id as string), '"}, {"content": " "}, "text", {"content": "Second of ', cast(doc_id as string), '"}]}') as payload from {documents}"""


@query(
    "select doc_id, 0 as seq, concat('Fact ', doc_id, ' of ', source) as content, case doc_id % 4 when 0 then 'world' when 1 then 'experience' else 'observation' end as memory_type, case doc_id % 3 when 0 then 'preference' when 1 then 'fact' else '' end as subtype,"
    " cast(case doc_id % 5 when 0 then 1.0 when 1 then 0.0 when 3 then 0.25 else 0.5 end as double) as confidence, case when doc_id % 2 = 0 then '2024-01-05' end as event_time, doc_id % 6 <> 0 as durable, 'Ada N/A.' as entities, 'Ada N lives_in Pune 1.0' as edges from documents where doc_id % 4 <> 3"
    " union all select doc_id, 4, concat('Second of ', doc_id), 'world', null, 0.5, null, true, '', '' from documents"
)
def parsed_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.createOrReplaceTempView("__extraction_documents")
    payloads = spark.sql(PAYLOAD.replace("{documents}", "__extraction_documents"))
    found = retention.parse_extractions(payloads)
    entities = F.array_join(F.transform("entities", lambda e: F.concat(e["name"], F.lit("/"), F.array_join(e["aliases"], "+"))), ",")
    edges = F.array_join(F.transform("relationships", lambda r: F.concat_ws(" ", r["subject"], r["predicate"], r["object"], r["confidence"].cast("string"))), ",")
    return found.select("doc_id", "seq", "content", "memory_type", "subtype", "confidence", "event_time", "durable", entities.alias("entities"), edges.alias("edges"))


D_QUESTION = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_.+#-]+'), lambda t: len(t) >= 3 and not list_contains({strings(sorted(text.QUESTION_WORDS))}, t))"


@query(f"with t as (select doc_id, {D_QUESTION} as own from documents) select doc_id, array_to_string(list_filter(own, lambda t, i: list_position(own, t) = i)[1:12], ' ') as terms from t")
def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.array_join(text.question_terms("text"), " ").alias("terms"))


D_ONE_LINE = "trim(regexp_replace(concat('[[a|b]] ', text), '\\s+', ' ', 'g'))"


@query(
    "select doc_id, md5(replace(replace(replace(concat('<b>&', text), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) as escaped,"
    f" md5(replace(replace(replace(substr({D_ONE_LINE}, 1, 240), '[[', '［［'), ']]', '］］'), '|', '¦')) as shown,"
    " case when len(trim(regexp_replace(substr(text, 1, 100 + doc_id % 100), '\\s+', ' ', 'g'))) between 1 and 160 then md5(trim(regexp_replace(substr(text, 1, 100 + doc_id % 100), '\\s+', ' ', 'g'))) end as name,"
    " cast(case doc_id % 5 when 0 then 0.0 when 1 then 1.0 when 2 then 0.5 when 3 then 0.125 else 0.5 end as double) as clamped, case when doc_id % 3 = 0 then concat('2024-02-0', 1 + doc_id % 9) end as event_time,"
    " concat('a-b-c', case when doc_id % 2 = 0 then ' x' else '' end) as stem from documents"
)
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = F.expr("case doc_id % 5 when 0 then '-3' when 1 then '7' when 2 then 'none' when 3 then '0.125' end")
    time = F.expr("case doc_id % 3 when 0 then concat('2024-02-0', cast(1 + doc_id % 9 as string)) when 1 then 'tomorrow' end")
    name = F.expr("substr(text, 1, cast(100 + doc_id % 100 as int))")
    stem = F.expr("concat(' .a/b:c', case when doc_id % 2 = 0 then '   x' else '' end, '. ')")
    return docs.select(
        "doc_id", F.md5(text.html_escaped(F.concat(F.lit("<b>&"), "text"))).alias("escaped"), F.md5(text.safe_display(F.concat(F.lit("[[a|b]] "), "text"))).alias("shown"), F.md5(text.clean_name(name)).alias("name"),
        text.clamp01(number).alias("clamped"), text.valid_event_time(time).alias("event_time"), text.safe_stem(stem, "none").alias("stem"),
    )
