"""Steps whose cost must follow what a query reads, and results that must be whole on larger tables."""

import os
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import entity, fusion, graph, lexical, writes
from factloom.plans import fixtures, writing
from tests.helpers import NOW, store_of, table

ODD = ["", "  ", "a", "A-b A b", "Ärzte im Zürich", "straße ½ x²", "İstanbul İ", "étude _x_y", "日本語 text 12", "tail9", "9head " * 50, None]


def test_postings_are_those_of_the_tokens_and_nothing_is_shuffled(spark, monkeypatch):
    rows = [{"id": f"m{k}", "content": c or "", "normalized_content": (ODD[-k] or "").lower(), "subtype": None if k % 2 else "fact", "source": c} for k, c in enumerate(ODD)]
    facts = table(spark, "memories", rows)
    columns = [F.coalesce(F.col(c), F.lit("")) for c in lexical.INDEXED]
    wanted = {}
    for r in facts.select("id", F.array(*[lexical.index_tokens(c) for c in columns]).alias("parts")).collect():
        own = defaultdict(list)
        for c, words in enumerate(r.parts):
            for i, w in enumerate(words):
                own[w].append(c * lexical.GAP + i)
        wanted |= {(w, r.id): (sum(map(len, r.parts)), p) for w, p in own.items()}
    for run in (lexical.RUN, 40):  # a run of all facts, and several
        monkeypatch.setattr(lexical, "RUN", run)
        postings = lexical.index_rows(facts.coalesce(1))
        got = postings.collect()
        assert {(r.token, r.id): (r.d, r.positions) for r in got} == wanted and len(got) == len(wanted)
    assert "Exchange" not in lexical.index_rows(facts)._jdf.queryExecution().executedPlan().toString()


def test_a_query_writes_the_indexes_it_reads(spark, sf, monkeypatch, tmp_path):
    monkeypatch.setattr(fixtures, "_WRITTEN", {})
    monkeypatch.setattr(fixtures, "shared_folder", lambda _: str(tmp_path))
    store = fixtures.snapshot(spark, sf, "memories", "entities", "relationships", "memory_relationships")
    assert store.memories.count() and store.postings is None and not os.listdir(tmp_path)
    assert fixtures.snapshot(spark, sf, "entities", "entity_keys").entity_keys.count()
    assert [os.listdir(tmp_path / d) for d in os.listdir(tmp_path)] == [["entity_keys"]]


def test_all_facts_of_an_entity(spark, monkeypatch):
    n = 6001
    at = F.lit(datetime(2024, 1, 1)) + F.make_interval(hours=(F.col("id") % 50).cast("int"))
    facts = spark.range(n).select(F.format_string("mem_%08d", "id").alias("id"), F.lit("active").alias("status"), at.alias("updated_at"))
    links = facts.select(F.col("id").alias("memory_id"), F.lit("ent_n7").alias("entity_id"), F.lit("mentioned").alias("role"))
    store = store_of(spark).with_(memories=facts, memory_entities=links)
    assert entity.memories_for_entity(store, "ent_n7", True, 9999).count() == 5000
    monkeypatch.setattr(writing, "snapshot", lambda *_: store)
    got = [r.id for r in writing.facts_of_entity(spark, "").orderBy("rank").collect()]
    first = datetime(2024, 1, 1)
    assert got == sorted((f"mem_{k:08d}" for k in range(n)), key=lambda i: (first - timedelta(hours=int(i[4:]) % 50), i))


def test_texts_of_new_facts_move_once(spark):
    old = table(spark, "memories", [{"id": "o", "content": "old"}]).hint("merge")
    new = spark.createDataFrame([("A  b",), ("a b",), ("c",)], "content string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made, _ = writes.insert_memories(store_of(spark).with_(memories=old), new, NOW)
        plan = made.memories._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # the new facts, the old ones' ids
    assert sorted(made.memories.select("normalized_content").collect()) == [("a b",), ("c",), ("old",)]


def test_a_text_of_any_length_is_a_fact(spark):
    made, rejected = writes.insert_memories(store_of(spark), spark.createDataFrame([("a" * 120_001,), ("  ",), (None,)], "content string"), NOW)
    assert [len(r.content) for r in made.memories.collect()] == [120_001] and [r.problems for r in rejected.collect()] == [["content"]] * 2


@pytest.mark.parametrize("terms", [["ments", "thatins", "elle", "rewh", "a", "", "a b", "café", "c++", "x.yz", "abcdef"]])
def test_prefix_overlap_is_that_of_the_words(spark, terms):
    texts = ["", None, "ment", "men", "mentor", "that thatin", "thatins", "ell elle", "x.yz.", "x.y x.yzw", "a b", "cafés", "c++ c+", "abcd", "abc", "abcdefg", "zabcdef", "- . -"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.tokenize("t").alias("w"), text.prefix_overlap(F.array(*map(F.lit, terms)), F.col("t")).alias("n")).collect()
    for r in rows:
        stems = [t[:-1] if len(t) > 4 and t.endswith("s") else t for t in terms]
        assert r.n == sum(any(w.startswith(s) or (len(w) >= 4 and s.startswith(w)) for w in r.w or []) for s in stems), r.t


def test_prefix_overlap_finds_the_words_of_a_text_once(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(text.prefix_overlap(F.array(F.lit("ab"), F.lit("cd")), F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(coalesce(regexp_extract_all" in plan  # bound once, not found again for each term


def customers(spark, n):
    """Facts of which each names an entity of its own."""
    facts = [{"id": f"m{k:04}", "content": "customer " + "tea " * (k * 37 % 50), "importance": k * 53 % 101 / 100, "updated_at": datetime(2024, 1, 1) + timedelta(hours=k % 11)} for k in range(n)]
    links = [{"memory_id": f"m{k:04}", "entity_id": f"e{k:04}"} for k in range(n)]
    return store_of(spark, memories=facts, entities=[{"id": f"e{k:04}", "canonical_name": f"Customer {k:04}"} for k in range(n)], memory_entities=links)


def test_recall_ranks_all_facts_of_all_entities(spark):
    store, question = customers(spark, 600), "which customer is 0599"
    assert entity.match(store.entities, question, limit=None).count() == 600
    facts = {r.id: r for r in store.memories.collect()}
    lexical_scores = {r.id: r.score for r in lexical.search(store, question, None).collect()}
    arms = [
        sorted(facts, key=lambda i: (-lexical_scores[i], i)),
        sorted(facts, key=lambda i: (-(12 if i == "m0599" else 1), -facts[i].importance, facts[i].updated_at, i)),
        sorted(facts, key=lambda i: (-facts[i].importance, -facts[i].updated_at.timestamp(), i)),
    ]
    rank = [{i: k for k, i in enumerate(a, 1)} for a in arms]
    score = {i: sum(1 / (60 + r[i]) for r in rank) + 0.001 * facts[i].importance + 0.0005 * facts[i].confidence for i in facts}
    wanted = sorted(facts, key=lambda i: (-score[i], i))[:100]
    got = fusion.recall(store, question, 100).collect()
    assert [r.id for r in got] == wanted and [r.score for r in got] == pytest.approx([score[i] for i in wanted])
    assert all(r.sources == ["entity", "graph", "lexical"] for r in got)


def test_a_fact_of_two_terms_counts_however_low_it_scores(spark):
    one = [{"id": f"a{k:02}", "content": ("alpha " if k % 2 else "beta ") * 5} for k in range(50)]
    store = store_of(spark, memories=[*one, {"id": "both", "content": "alpha beta " + "tea " * 300}])
    assert lexical.search(store, "alpha beta", 100).collect()[-1].id == "both"
    assert [r.id for r in fusion.recall_for_context(store, "alpha beta").hits.collect()] == ["both"]


def test_all_facts_of_an_arm_are_counted(spark):
    counts = fusion.recall_for_context(customers(spark, 600), "which customer").arm_counts()
    assert {r.arm: r["count"] for r in counts.collect()} == {"lexical": 600, "entity": 600, "graph": 600}


def test_many_queries_take_all_their_entities(spark):
    store, queries = customers(spark, 600), [*["the"] * 61, "customer", "customer 0598", "0599"]
    matched = entity.match_many(store.entities, queries)
    assert {r.q: r["count"] for r in matched.groupBy("q").count().collect()} == {61: 600, 62: 600, 63: 1}
    assert entity.match_many(store.entities, queries, 25).count() == 51
    found = [entity.arm_many(store, matched, 600), graph.arm_many(store, matched, 600)]
    for k, q in enumerate(queries[61:], 61):
        own = entity.match(store.entities, q, limit=None)
        assert {(r.entity_id, r.score) for r in own.collect()} == {(r.entity_id, r.score) for r in matched.filter(f"q = {k}").collect()}
        wanted = [entity.arm(store, q, None, own).orderBy(F.desc("weight"), F.desc("importance"), "updated_at", "id"), graph.arm(store, q, None, 2, own).orderBy(F.desc("importance"), F.desc("updated_at"), "id")]
        for many, one in zip(found, wanted):
            assert [r.id for r in many.filter(f"q = {k}").orderBy("place").collect()] == [r.id for r in one.collect()]
