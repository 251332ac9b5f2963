"""The queries of the store, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import entity, fusion, graph, lexical, listing, maintenance, reflection, retention, semantic, temporal, writes
from factloom.plans.fixtures import clauses, project, query_vector, snapshot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS = "what about elle ment thatin and rewh"  # of the corpus; the stopwords fall away
NAMES = "how does Customer#000000007 in NATION_3 compare with NATION_12"
VECTOR = 7
NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)
POLICY = maintenance.Policy(superseded_ttl_days=3, expire_unused_days=10, expire_max_importance=0.35, event_log_days=20)


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# -- DuckDB expressions -------------------------------------------------------


def d_tokens(column: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_@.+:/-]+'), lambda t: trim(t, '.:/-+@')), lambda t: t <> '')"


def d_overlap(terms: list[str], words: str) -> str:
    parts = []
    for t in terms:
        s = t[:-1] if len(t) > 4 and t.endswith("s") else t
        parts.append(f"cast(len(list_filter({words}, lambda w: starts_with(w, '{s}') or (len(w) >= 4 and starts_with('{s}', w)))) > 0 as int)")
    return " + ".join(parts)


def d_limit(limit: int | None) -> str:
    return "" if limit is None else f" limit {limit}"


def d_lexical(name: str, question: str, limit: int | None, where: str = "true") -> str:
    """A clause ``name(id, score)``; the memories clause must stand before it. Clauses hold all rows where no limit is given."""
    terms = lexical.query_terms(question)

    def test(t: lexical.Term) -> str:
        *inner, last = t.tokens
        places = ["w" if k == 0 else f"toks[i + {k}]" for k in range(len(t.tokens))]
        tests = [f"{at} = '{x}'" for at, x in zip(places, inner)]
        return " and ".join([*tests, f"starts_with({places[-1]}, '{last}')" if t.prefix else f"{places[-1]} = '{last}'"])

    folded = [f"coalesce(regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+'), [])" for c in lexical.INDEXED]
    tfs = ", ".join(f"len(list_filter(toks, lambda w, i: {test(t)})) as tf{k}" for k, t in enumerate(terms))
    counts = ", ".join(f"count(*) filter (tf{k} > 0) as n{k}" for k in range(len(terms)))
    idf = "case when ln((n - n{k} + 0.5) / (n{k} + 0.5)) <= 0 then 1e-6 else ln((n - n{k} + 0.5) / (n{k} + 0.5)) end"
    score = " + ".join(f"({idf.format(k=k)}) * (tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * d / avgdl)))" for k in range(len(terms)))
    hit = " or ".join(f"tf{k} > 0" for k in range(len(terms)))
    return f"""{name}_t as (select id, status, content, {" || ['|'] || ".join(folded)} as toks from memories),
 {name}_c as (select id, status, content, cast(len(toks) - 3 as double) as d, {tfs} from {name}_t),
 {name}_s as (select cast(count(*) as double) as n, avg(d) as avgdl, {counts} from {name}_c),
 {name} as (select id, score from (select id, content, {score} as score from {name}_c, {name}_s where status = 'active' and ({hit})) where {where} order by score desc, id{d_limit(limit)})"""


def d_entities(name: str, question: str, limit: int | None = 25, most: int | None = entity.PREFILTER_CAP) -> str:
    terms, padded = lexical.query_keywords(question, 12), " " + " ".join(lexical.words_of(question)) + " "
    like = " or ".join(f"contains(lower(canonical_name), '{t}')" for t in terms)
    return f"""{name}_p as (select id, canonical_name from entities where {like} order by id{d_limit(most)}),
 {name}_w as (select id, {d_tokens('canonical_name')} as ws from {name}_p),
 {name} as (select entity_id, score from (select id as entity_id, case when len(ws) > 0 and contains('{padded}', concat(' ', array_to_string(ws, ' '), ' ')) then 10 + len(ws)
   else len(list_filter(ws, lambda w: list_contains({strings(terms)}, w))) end as score from {name}_w) where score > 0 order by score desc, entity_id{d_limit(limit)})"""


def d_entity_arm(name: str, matched: str, limit: int | None) -> str:
    return f"""{name} as (select id, weight, importance, updated_at from memories join (select memory_id, max(score) as weight from memory_entities join {matched} using (entity_id) group by 1) on id = memory_id
   where status = 'active' order by weight desc, importance desc, updated_at, id{d_limit(limit)})"""


def d_graph_arm(name: str, matched: str, hops: int, limit: int | None) -> str:
    edges = "(select subject_entity_id as a, object_entity_id as b from relationships union select object_entity_id, subject_entity_id from relationships)"
    steps, last = "", matched
    for k in range(hops):
        steps += f"{name}_v{k} as (select entity_id from {last} union select b from {edges} where a in (select entity_id from {last})), "
        last = f"{name}_v{k}"
    return f"""{steps}{name}_m as (select memory_id from memory_entities where entity_id in (select entity_id from {last}) union select memory_id from memory_relationships where relationship_id in
   (select id from relationships where subject_entity_id in (select entity_id from {last}) or object_entity_id in (select entity_id from {last}))),
 {name} as (select id, importance, updated_at from memories where status = 'active' and id in (select memory_id from {name}_m) order by importance desc, updated_at desc, id{d_limit(limit)})"""


COSINE = "list_cosine_similarity(cast(vector as double[]), cast((select embedding from embeddings where vec_id = 7) as double[]))"


def d_semantic(name: str, limit: int | None, floor: float) -> str:
    return f"""{name}_a as (select memory_id as id, {COSINE} as similarity from memory_embeddings where model = 'm1' and memory_id in (select id from memories where status = 'active') order by 2 desc, 1 desc{d_limit(limit)}),
 {name} as (select id, similarity, importance, confidence from {name}_a join memories using (id) where similarity >= {floor})"""


def d_fused(arms: dict[str, tuple[str, str]], limit: int, drop_graph_only: bool = False) -> str:
    rows = " union all ".join(f"select id, row_number() over (order by {order}) as rk, '{arm}' as arm from {table}" for arm, (table, order) in arms.items())
    score = " + ".join(f"coalesce(1.0::double / (60 + min(rk) filter (arm = '{arm}')), 0)" for arm in arms)
    drop = "where sources <> 'graph'" if drop_graph_only else ""
    return f"""f as (select id, {score} as base, string_agg(arm, ',' order by arm) as sources from ({rows}) group by 1)
 select id, round(base + 0.001 * importance + 0.0005 * confidence, 9) as score, sources from f join memories using (id) {drop} order by base + 0.001 * importance + 0.0005 * confidence desc, id limit {limit}"""


LEXICAL_ORDER, ENTITY_ORDER, GRAPH_ORDER, SEMANTIC_ORDER = "score desc, id", "weight desc, importance desc, updated_at, id", "importance desc, updated_at desc, id", "similarity desc, importance desc, confidence desc, id"


def with_rank(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


# -- text ---------------------------------------------------------------------


@query(
    f"with t as (select doc_id, {d_tokens('text')} as toks from documents), c as (select doc_id, toks, list_filter(toks, lambda t: len(t) >= 2 and not list_contains({strings(sorted(text.STOPWORDS))}, t)) as own from t) "
    "select doc_id, len(toks) as n_tokens, array_to_string(list_filter(own, lambda t, i: list_position(own, t) = i)[1:16], ' ') as keywords from c"
)
def keywords_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = docs.select("doc_id", text.tokenize("text").alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join(text.keywords_of("tokens"), " ").alias("keywords"))


OVERLAP_TERMS = ["ments", "thatins", "elle", "rewh"]


@query(f"with w as (select doc_id, {d_tokens('text')} as ws from documents), o as (select doc_id, {d_overlap(OVERLAP_TERMS, 'ws')} as overlap from w) select doc_id, overlap from o where overlap >= 2")
def prefix_overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", text.prefix_overlap(F.array(*map(F.lit, OVERLAP_TERMS)), F.col("text")).alias("overlap"))
    return found.filter("overlap >= 2")


SECRET_TEXT = "case doc_id % 7 when 1 then concat(text, ' password: hunter', cast(doc_id as string)) when 2 then concat(text, ' AKIA', lpad(cast(doc_id as string), 16, '0')) when 3 then concat(text, ' Bearer abcdefghij0123456789') when 4 then concat(text, ' ghp_', repeat('a', 24)) when 5 then concat(text, ' -----BEGIN RSA PRIVATE KEY') else text end"


@query(f"select doc_id, {' or '.join('regexp_matches(x, ' + chr(39) + p + chr(39) + ')' for p in text.SENSITIVE)} as sensitive from (select doc_id, {SECRET_TEXT} as x from documents)")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.expr(SECRET_TEXT).alias("x")).select("doc_id", text.looks_sensitive("x").alias("sensitive"))


# -- arms ---------------------------------------------------------------------


@query(clauses("memories", more=d_lexical("lx", WORDS, 20)) + f"select id, round(score, 6) as score, row_number() over (order by {LEXICAL_ORDER}) as rank from lx")
def lexical_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical.search(snapshot(spark, sf_dir, "memories", "postings"), WORDS, 20)
    return with_rank(hits, F.desc("score"), "id").select("id", F.round("score", 6).alias("score"), "rank")


@query(clauses("entities", more=d_entities("em", NAMES)) + "select entity_id, cast(score as int) as score from em")
def entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.match(project(spark, sf_dir, "entities"), NAMES, most=entity.PREFILTER_CAP)


@query(clauses("memories", "entities", "memory_entities", more=d_entities("em", NAMES) + ", " + d_entity_arm("ea", "em", 20)) + f"select id, cast(weight as int) as weight, row_number() over (order by {ENTITY_ORDER}) as rank from ea")
def entity_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = snapshot(spark, sf_dir, "memories", "entities", "memory_entities")
    hits = entity.arm(store, NAMES, 20, F.broadcast(entity.match(store.entities, NAMES, most=entity.PREFILTER_CAP)))  # 25 rows at most
    return with_rank(hits, F.desc("weight"), F.desc("importance"), "updated_at", "id").select("id", "weight", "rank")


GRAPH_TABLES = ("memories", "entities", "relationships", "memory_entities", "memory_relationships")


def _graph(hops: int):
    sql = clauses(*GRAPH_TABLES, more=d_entities("em", "NATION_3 NATION_12") + ", " + d_graph_arm("g", "em", hops, 20)) + f"select id, row_number() over (order by {GRAPH_ORDER}) as rank from g"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = snapshot(spark, sf_dir, *GRAPH_TABLES)
        hits = graph.arm(store, "NATION_3 NATION_12", 20, hops, entity.match(store.entities, "NATION_3 NATION_12", most=entity.PREFILTER_CAP))
        return with_rank(hits, F.desc("importance"), F.desc("updated_at"), "id").select("id", "rank")

    run.__name__ = f"graph_{hops}hop"
    return query(sql)(run)


graph_1hop, graph_2hop = _graph(1), _graph(2)


@query(
    clauses("entities", "relationships")
    + "select r.id, r.predicate, s.canonical_name as subject_name, o.canonical_name as object_name from relationships r join entities s on s.id = subject_entity_id join entities o on o.id = object_entity_id where subject_entity_id = 'ent_n3' or object_entity_id = 'ent_n3' order by r.id limit 100"
)
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.neighbors(snapshot(spark, sf_dir, "entities", "relationships"), "ent_n3", 100).select("id", "predicate", "subject_name", "object_name")


def _semantic(name: str, limit: int, floor: float, include_inactive: bool = False):
    scored = d_semantic("s", limit, floor)
    scored = scored.replace("from memories where status = 'active'", "from memories") if include_inactive else scored
    sql = clauses("memories", "memory_embeddings", more=scored) + f"select id, round(similarity, 6) as similarity, row_number() over (order by {SEMANTIC_ORDER}) as rank from s"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = snapshot(spark, sf_dir, "memories", "memory_embeddings")
        hits = semantic.top(store, query_vector(spark, sf_dir, VECTOR), "fixture", "m1", limit, floor, include_inactive)
        return with_rank(hits, F.desc("similarity"), F.desc("importance"), F.desc("confidence"), "id").select("id", F.round("similarity", 6).alias("similarity"), "rank")

    run.__name__ = name
    return query(sql)(run)


semantic_topk, semantic_min_score = _semantic("semantic_topk", 20, -1), _semantic("semantic_min_score", 200, 0.2)
semantic_any_status = _semantic("semantic_any_status", 50, -1, include_inactive=True)


@query(
    clauses("memories")
    + "select id, cast(epoch(tm) as bigint) as seconds, row_number() over (order by tm desc, importance desc, id) as rank from (select id, date_trunc('second', coalesce(event_ts, created_at)) as tm, importance from memories where status = 'active') t where tm between timestamp '2023-09-01' and timestamp '2024-01-10' order by tm desc, importance desc, id limit 50"
)
def temporal_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = temporal.window(snapshot(spark, sf_dir, "memories").memories, "2023-09-01", "2024-01-10", limit=50)
    return with_rank(hits, F.desc("at"), F.desc("importance"), "id").select("id", F.unix_timestamp("at").alias("seconds"), "rank")


# -- recall -------------------------------------------------------------------

QUESTION = WORDS + " " + NAMES
RECALL_TABLES = (*GRAPH_TABLES, "memory_embeddings")


def _arms() -> list[str]:
    """Whole: of all entities that the question names, and with all facts that an arm finds."""
    return [d_lexical("lx", QUESTION, None), d_entities("em", QUESTION, None, None), d_entity_arm("ea", "em", None), d_graph_arm("g", "em", 1, None)]


@query(
    clauses(*RECALL_TABLES, more=", ".join([*_arms(), d_semantic("s", None, -1)]) + ", ")
    + d_fused({"lexical": ("lx", LEXICAL_ORDER), "entity": ("ea", ENTITY_ORDER), "graph": ("g", GRAPH_ORDER), "semantic": ("s", SEMANTIC_ORDER)}, 10)
)
def rrf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = fusion.Backend("fixture", "m1", query_vector(spark, sf_dir, VECTOR))
    found = fusion.recall(snapshot(spark, sf_dir, *RECALL_TABLES, "postings"), QUESTION, 10, backend=backend)
    return found.select("id", F.round("score", 9).alias("score"), F.array_join("sources", ",").alias("sources"))


KEYWORDS = lexical.query_keywords(QUESTION)


def _context_arms() -> list[str]:
    return [*_arms(), d_semantic("s", None, 0.1), f"near as (select id, score from lx join memories using (id) where {d_overlap(KEYWORDS, d_tokens('content'))} >= {min(2, len(KEYWORDS))})"]


@query(
    clauses(*RECALL_TABLES, more=", ".join(_context_arms()) + ", ")
    + d_fused({"lexical": ("near", LEXICAL_ORDER), "entity": ("ea", ENTITY_ORDER), "graph": ("g", GRAPH_ORDER), "semantic": ("s", SEMANTIC_ORDER)}, 6, True)
)
def context_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = fusion.Backend("fixture", "m1", query_vector(spark, sf_dir, VECTOR))
    found = fusion.recall_for_context(snapshot(spark, sf_dir, *RECALL_TABLES, "postings"), QUESTION, 6, 0.1, backend)
    return found.hits.select("id", F.round("score", 9).alias("score"), F.array_join("sources", ",").alias("sources"))


@query(
    clauses("memories", more=d_lexical("lx", WORDS, 24) + ", j as (select id, row_number() over (order by score desc, id) as place, strlen(content) as n from lx join memories using (id)), b as (select id, place, sum(n) over (order by place) as used from j) ")
    + "select id, place, cast(used as bigint) as used from b where used <= 40000 and place <= 24"
)
def char_budget_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = snapshot(spark, sf_dir, "memories", "postings")
    memories, hits = store.memories, lexical.search(store, WORDS, 24)
    pool = memories.select("id", "content").join(F.broadcast(hits), "id").withColumn("n", F.octet_length("content"))
    return listing.within_budget(pool, F.col("n"), [F.desc("score"), F.col("id")], 40_000, 24).select("id", "place", F.col("used").cast("long").alias("used"))


# -- retention ----------------------------------------------------------------


@query(clauses("memories") + "select md5(normalized_content) as content_md5, count(*) as copies, arg_max(id, (updated_at, id)) as kept_id from memories where status = 'active' group by normalized_content having count(*) > 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing.exact_duplicates(snapshot(spark, sf_dir, "memories").memories).filter("copies > 1")
    return found.select(F.md5("normalized_content").alias("content_md5"), "copies", "kept_id")


@query(
    clauses("memories", "memory_embeddings", more="v as (select memory_id, cast(vector as double[]) as v from memory_embeddings where model = 'm1' and memory_id in (select id from memories where status = 'active'))")
    + "select p.memory_id as probe_id, m.memory_id, round(list_cosine_similarity(p.v, m.v), 5) as similarity from v p join v m on p.memory_id <> m.memory_id where cast(substr(p.memory_id, 5) as int) % 50 = 0 and list_cosine_similarity(p.v, m.v) >= 0.25"
)
def semantic_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = snapshot(spark, sf_dir, "memories", "memory_embeddings")
    probes = store.memory_embeddings.filter(F.substring("memory_id", 5, 8).cast("int") % 50 == 0)
    found = semantic.similar_pairs(store, probes, "fixture", "m1", 64, 0.25)
    return found.withColumn("similarity", F.round("similarity", 5))


@query(
    clauses("entities", "relationships", "incoming")
    + "select distinct i.memory_id as new_id, r.id as relationship_id from incoming i join relationships r on r.subject_entity_id = i.subject_entity_id and r.predicate = i.predicate join entities a on a.id = i.object_entity_id join entities b on b.id = r.object_entity_id where i.predicate in ('lives_in') and lower(a.canonical_name) <> lower(b.canonical_name)"
)
def exclusive_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.contradicted_edges(snapshot(spark, sf_dir, "entities", "relationships"), project(spark, sf_dir, "incoming"))


# Facts behind the contradicted edges, had every incoming statement been about a customer that facts mention.
MENTIONED = "select concat('mem_new_',cast(c_custkey as string)) as memory_id, concat('ent_c',cast(c_custkey as string)) as subject_entity_id, 'lives_in' as predicate, concat('ent_n',cast((c_nationkey + 1) % 25 as string)) as object_entity_id from {customer} where c_custkey % 3 = 0"


@query(
    clauses("memories", "memory_relationships")
    + "select concat('mem_new_', substr(relationship_id, 7)) as new_id, memory_id as old_id from memory_relationships where memory_id in (select id from memories where status = 'active') and cast(substr(relationship_id, 7) as int) in (select c_custkey from customer)"
)
def conflicting_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = snapshot(spark, sf_dir, "memories", "entities", "relationships", "memory_relationships")
    incoming = spark.sql(MENTIONED, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return retention.exclusive_conflicts(store, incoming)


@query(clauses("turns") + "select conv_id, turn, md5(concat('User: ', substr(trim(user_text), 1, 100000), chr(10), 'Assistant (context only): ', substr(trim(assistant_text), 1, 1500))) as text_md5 from turns where len(regexp_extract_all(lower(user_text), '[\\p{L}\\p{N}]+')) > 0 and not starts_with(ltrim(user_text), '/') and not (len(regexp_extract_all(lower(user_text), '[\\p{L}\\p{N}]+')) <= 5 and len(list_filter(regexp_extract_all(lower(user_text), '[\\p{L}\\p{N}]+'), lambda w: not list_contains(" + strings(sorted(text.ACKNOWLEDGEMENTS)) + ", w))) = 0)")
def turn_pairs_nontrivial(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = retention.turn_texts(retention.pair_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return turns.select("conv_id", "turn", F.md5("text").alias("text_md5"))


@query(clauses("retention_events") + "select action, count(*) as count from retention_events group by 1")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.decision_counts(project(spark, sf_dir, "retention_events"))


# -- maintenance --------------------------------------------------------------

ALL = (*GRAPH_TABLES, "memory_embeddings", "retention_events")
D_DOOMED = """doomed as (select id, case when status = 'superseded' and updated_at <= timestamp '2024-01-29' then 'superseded_removed' when status = 'deleted' and updated_at <= timestamp '2024-01-29' then 'deleted_removed'
 when status = 'active' and recall_count = 0 and importance < 0.35 and coalesce(subtype, '') <> 'directive' and created_at <= timestamp '2024-01-22' then 'expired_unused' end as reason from memories),
 kept as (select id from doomed where reason is null),
 edges as (select * from relationships where id in (select relationship_id from memory_relationships where memory_id in (select id from kept))),
 nodes as (select * from entities where id in (select entity_id from memory_entities where memory_id in (select id from kept)) or id in (select subject_entity_id from edges) or id in (select object_entity_id from edges))"""


@query(
    clauses(*ALL, more=D_DOOMED)
    + """select 'superseded_removed' as name, count(*) filter (reason = 'superseded_removed') as count from doomed union all select 'deleted_removed', count(*) filter (reason = 'deleted_removed') from doomed
 union all select 'expired_unused', count(*) filter (reason = 'expired_unused') from doomed union all select 'events_removed', count(*) from retention_events where date_trunc('second', created_at) <= timestamp '2024-01-12'
 union all select 'orphan_relationships', (select count(*) from relationships) - (select count(*) from edges) union all select 'orphan_entities', (select count(*) from entities) - (select count(*) from nodes)"""
)
def maintenance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.report(snapshot(spark, sf_dir, *ALL), POLICY, NOW)


@query(clauses(*ALL, more=D_DOOMED) + "select 'memory' as kind, id, case when superseded_by in (select id from doomed where reason is not null) then null else superseded_by end as superseded_by from memories where id in (select id from kept) union all select 'relationship', id, null from edges union all select 'entity', id, null from nodes")
def maintenance_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = maintenance.survivors(snapshot(spark, sf_dir, *ALL), POLICY, NOW)
    none = F.lit(None).cast("string").alias("superseded_by")
    return left.memories.select(F.lit("memory").alias("kind"), "id", "superseded_by").union(left.relationships.select(F.lit("relationship"), "id", none)).union(left.entities.select(F.lit("entity"), "id", none))


@query(clauses("relationships", "memory_relationships") + "select id from relationships where id not in (select relationship_id from memory_relationships)")
def orphan_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.orphan_relationships(snapshot(spark, sf_dir, "relationships", "memory_relationships"))


@query(
    clauses("entities", "relationships", "memory_entities", "memory_relationships", more="held as (select * from relationships where id in (select relationship_id from memory_relationships))")
    + "select id from entities where id not in (select entity_id from memory_entities) and id not in (select subject_entity_id from held) and id not in (select object_entity_id from held)"
)
def orphan_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = snapshot(spark, sf_dir, "entities", "relationships", "memory_entities", "memory_relationships")
    held = store.relationships.join(maintenance.orphan_relationships(store), "id", "left_anti")
    return maintenance.orphan_entities(store.with_(relationships=held))


# -- lists and counts ---------------------------------------------------------


@query(
    clauses(*ALL)
    + "select 'memories' as name, count(*) filter (status <> 'deleted') as count from memories union all select 'active_memories', count(*) filter (status = 'active') from memories union all select 'superseded_memories', count(*) filter (status = 'superseded') from memories union all select 'deleted_memories', count(*) filter (status = 'deleted') from memories union all select 'entities', count(*) from entities union all select 'relationships', count(*) from relationships union all select 'memory_embeddings', count(*) from memory_embeddings union all select 'retention_events', count(*) from retention_events"
)
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.stats(snapshot(spark, sf_dir, *ALL))


@query(clauses("memories") + "select id, status, row_number() over (order by updated_at desc, id) as rank from memories where status = 'active' order by updated_at desc, id limit 200")
def list_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing.list_memories(project(spark, sf_dir, "memories"), limit=200)
    return with_rank(found, F.desc("updated_at"), "id").select("id", "status", "rank")


@query(clauses("entities") + "select id, canonical_name, row_number() over (order by lower(canonical_name), id) as rank from entities order by lower(canonical_name), id limit 300")
def list_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing.list_entities(project(spark, sf_dir, "entities"), 300)
    return with_rank(found, F.lower("canonical_name"), "id").select("id", "canonical_name", "rank")


@query(clauses("memories", "memory_embeddings") + "select id, row_number() over (order by created_at, id) as rank from memories where status = 'active' and id not in (select memory_id from memory_embeddings where provider = 'fixture' and model = 'm1') order by created_at, id limit 500")
def stale_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = semantic.stale(snapshot(spark, sf_dir, "memories", "memory_embeddings"), "fixture", "m1")
    return with_rank(found, "created_at", "id").select("id", "rank")


@query(clauses("retention_events") + "select id, action, memory_id from retention_events order by id desc limit 100")
def events_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.recent_events(project(spark, sf_dir, "retention_events"), 100).select("id", "action", "memory_id")


@query(clauses("memories") + "select strftime(coalesce(event_ts, created_at), '%Y-%m-%d') as day, substr(md5(id), 1, 1) as part, count(*) as count, string_agg(id, ',' order by id) as ids from memories group by 1, 2")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing.timeline(project(spark, sf_dir, "memories"), F.coalesce("event_ts", "created_at"))
    return found.select("day", "part", "count", F.array_join("ids", ",").alias("ids"))


@query(clauses("memories", "retention_events") + "select id, cast(recall_count + (id in (select memory_id from retention_events))::int as int) as recall_count from memories")
def touch_recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = project(spark, sf_dir, "retention_events").select(F.col("memory_id").alias("id"))
    return writes.touch_recalled(project(spark, sf_dir, "memories"), named, NOW).select("id", "recall_count")


@query(
    clauses("memory_embeddings")
    + "select memory_id, case when n % 3 = 0 then 'm2' else model end as model, case when n % 3 = 0 then 2 else 64 end as dimension, round(case when n % 3 = 0 then 5 else sqrt(list_sum(list_transform(cast(vector as double[]), lambda x: x * x))) end, 5) as norm from (select *, cast(substr(memory_id, 5) as int) as n from memory_embeddings)"
)
def upsert_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = project(spark, sf_dir, "memory_embeddings")
    table = table.withColumn("norm", F.lit(None).cast("double"))
    number = F.substring("memory_id", 5, 8).cast("int")
    new = table.filter(number % 3 == 0).select("memory_id", "provider", F.lit("m2").alias("model"), F.expr("array(3f, 4f)").alias("vector"))
    incoming = new.withColumn("seq", F.lit(2)).union(new.withColumn("vector", F.expr("array(1f)")).withColumn("seq", F.lit(1))).union(new.withColumn("vector", F.expr("array(0f)")).withColumn("seq", F.lit(3)))
    out = semantic.upsert(table, incoming)
    return out.select("memory_id", "model", "dimension", F.round(F.coalesce("norm", semantic.norm(F.col("vector"))), 5).alias("norm"))


@query(
    clauses("memories", "entities", "memory_entities", "memory_relationships", "relationships")
    + "select memory_id, string_agg(distinct canonical_name, ',' order by canonical_name) as entities from memory_entities join entities on id = entity_id group by 1"
)
def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entity.names_by_memory(snapshot(spark, sf_dir, "entities", "memory_entities"))
    return found.select("memory_id", F.array_join("entities", ",").alias("entities"))


@query(
    clauses("memories", "entities", "memory_entities")
    + "select id, row_number() over (order by updated_at desc, id) as rank from memories where status = 'active' and subtype = 'decision' and id in (select memory_id from memory_entities join entities e on e.id = entity_id where lower(canonical_name) in ('nation_7', 'customer#000000007')) order by updated_at desc, id limit 50"
)
def memories_for_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = snapshot(spark, sf_dir, "memories", "entities", "memory_entities", "entity_keys")
    found = entity.memories_for_entity_names(store, ["Nation_7", " customer#000000007"], "decision", 50)
    return with_rank(found, F.desc("updated_at"), "id").select("id", "rank")


@query(
    clauses("memories", "entities", "relationships", "memory_relationships")
    + "select distinct m.id, o.canonical_name as relationship_object from memories m join memory_relationships mr on mr.memory_id = m.id join relationships r on r.id = mr.relationship_id join entities s on s.id = r.subject_entity_id join entities o on o.id = r.object_entity_id where m.status = 'active' and r.predicate = 'lives_in' and lower(s.canonical_name) = 'customer#000000003'"
)
def memories_for_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = snapshot(spark, sf_dir, "memories", "entities", "relationships", "memory_relationships", "entity_keys")
    return entity.memories_for_signature(store, "customer#000000003", "lives_in").select("id", "relationship_object")


def reflection_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a reflective question, cut to the bundle's budget."""
    backend = fusion.Backend("fixture", "m1", query_vector(spark, sf_dir, VECTOR))
    bundle = reflection.build_bundle(snapshot(spark, sf_dir, *RECALL_TABLES, "postings"), QUESTION, backend=backend)
    return bundle.items.select("id", "place", F.round("score", 9).alias("score"), F.array_join("sources", ",").alias("sources"), "used")


QUERIES["reflection_bundle"] = reflection_bundle


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall over all arms, with the facts' texts."""
    memories = snapshot(spark, sf_dir, "memories").memories.select("id", "content", "memory_type", "subtype")
    return memories.join(F.broadcast(rrf_recall(spark, sf_dir)), "id").orderBy(F.desc("score"), "id")
