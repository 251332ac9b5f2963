import sqlite3
from datetime import datetime

import pytest

from factloom.operators import entity, fusion, graph, lexical, listing, semantic, temporal

from .helpers import ids, store_of

FACTS = ["Prefers dark theme in Obsidian", "Listens to lo-fi beats while coding", "Uses a phone with Termux", "Éçole française du café", "Works at Acme on node_3 cluster", "theme theme themes"]


@pytest.fixture(scope="module")
def store(spark):
    memories = [{"id": f"m{k}", "content": c, "subtype": "preference" if k == 0 else None, "source": "chat" if k % 2 else None, "importance": k / 10} for k, c in enumerate(FACTS)]
    memories += [{"id": "gone", "content": "dark theme of old", "status": "superseded"}, {"id": "dead", "content": "theme", "status": "deleted"}]
    entities = [{"id": "e0", "canonical_name": "Obsidian"}, {"id": "e1", "canonical_name": "Acme Corp", "aliases": ["Acme"]}, {"id": "e2", "canonical_name": "Pune"}, {"id": "e3", "canonical_name": "The Who"}, {"id": "e4", "canonical_name": "India"}]
    relationships = [{"id": "r0", "subject_entity_id": "e1", "predicate": "located_in", "object_entity_id": "e2"}, {"id": "r1", "subject_entity_id": "e2", "predicate": "located_in", "object_entity_id": "e4"}]
    links = [{"memory_id": "m0", "entity_id": "e0"}, {"memory_id": "m4", "entity_id": "e1"}, {"memory_id": "m2", "entity_id": "e2"}, {"memory_id": "gone", "entity_id": "e0"}, {"memory_id": "m1", "entity_id": "e4"}]
    return store_of(spark, memories=memories, entities=entities, relationships=relationships, memory_entities=links, memory_relationships=[{"memory_id": "m5", "relationship_id": "r0"}])


@pytest.mark.parametrize("query", ["what theme do I like", "lo-fi", "cafe ecole", "phone termux acme", "node_3", "themes dark", "obsidian"])
def test_bm25_equals_fts5(spark, store, query):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(content, normalized_content, subtype, source, tokenize='unicode61 remove_diacritics 2')")
    rows = store.memories.orderBy("id").collect()
    for k, r in enumerate(rows, 1):
        con.execute("insert into f(rowid, content, normalized_content, subtype, source) values (?,?,?,?,?)", (k, r.content, r.normalized_content, r.subtype, r.source))
    terms = lexical.query_keywords(query)
    match = " OR ".join(f'"{t}"' + ("*" if len(t) >= 4 else "") for t in terms)
    wanted = {rows[k - 1].id: -s for k, s in con.execute("select rowid, bm25(f) from f where f match ?", (match,)) if rows[k - 1].status == "active"}
    found = {r.id: r.score for r in lexical.search(store.memories, query, 100).collect()}
    assert found.keys() == wanted.keys() and found
    assert all(found[i] == pytest.approx(wanted[i], rel=1e-9) for i in found)
    many = {r.id: r.score for r in lexical.search_many(store.memories, [query], 100).collect()}
    assert many == pytest.approx(found)


def test_stopwords_alone_find_nothing(store):
    assert lexical.search(store.memories, "what do you have").count() == 0
    assert entity.match(store.entities, "the who").count() == 0


def test_inactive_facts(store):
    assert "gone" not in ids(lexical.search(store.memories, "dark theme")) and "gone" in ids(lexical.search(store.memories, "dark theme", include_inactive=True))


def test_entities(store):
    found = {r.entity_id: r.score for r in entity.match(store.entities, "who works at acme corp in pune").collect()}
    assert found == {"e1": 12, "e2": 11}
    assert ids(entity.arm(store, "obsidian settings")) == ["m0"]
    assert {(r.q, r.entity_id): r.score for r in entity.match_many(store.entities, ["acme", "the", "pune india"]).collect()} == {(0, "e1"): 11, (2, "e2"): 11, (2, "e4"): 11}
    assert ids(entity.find_by_name(store, "  ACME ")) == ids(entity.find_by_name(store.entities, "  ACME ")) == ["e1"]
    assert [r.object_name for r in entity.neighbors(store, "e2").collect()] == ["Pune", "India"]
    assert ids(entity.memories_for_entity_names(store, ["acme"])) == ["m4"]


def test_graph(store):
    assert sorted(ids(graph.arm(store, "acme"))) == ["m2", "m4", "m5"]
    assert sorted(ids(graph.arm(store, "acme", max_hops=2))) == ["m1", "m2", "m4", "m5"]
    assert ids(graph.arm(store, "acme")) == ["m5", "m4", "m2"]
    many = graph.arm_many(store, entity.match_many(store.entities, ["acme"]), 20, 2).orderBy("place")
    assert ids(many) == ids(graph.arm(store, "acme", max_hops=2))
    with pytest.raises(ValueError):
        graph.arm(store, "acme", max_hops=3)


def test_semantic(spark):
    vectors = {"a": [1, 0], "b": [0.9, 0.1], "c": [0, 1], "d": [1, 0], "bad": [0, 0], "old": [1, 0], "tie": [2, 0]}
    rows = [{"memory_id": k, "vector": [float(x) for x in v], "model": "old" if k == "old" else "m"} for k, v in vectors.items()] + [{"memory_id": "three", "vector": [1.0, 0.0, 0.0]}]
    memories = [{"id": k, "content": k, "status": "deleted" if k == "d" else "active", "importance": 0.9 if k == "tie" else 0.5} for k in [*vectors, "three"]]
    store = store_of(spark, memories=memories, memory_embeddings=rows)
    assert ids(semantic.top(store, [1, 0], "p", "m")) == ["tie", "a", "b", "c"]
    assert ids(semantic.top(store, [1, 0], "p", "m", limit=1)) == ["tie"]
    assert ids(semantic.top(store, [1, 0], "p", "m", min_score=0.5)) == ["tie", "a", "b"]
    assert sorted(ids(semantic.stale(store, "p", "m"))) == ["old"]
    with pytest.raises(ValueError):
        semantic.top(store, [0.0, 0.0], "p", "m")


def test_temporal(spark):
    rows = [{"id": "a", "content": "x", "event_time": "2024-03-01T10:00:00+02:00"}, {"id": "b", "content": "x", "event_time": "soon"}, {"id": "c", "content": "x", "created_at": datetime(2024, 3, 1, 9)}, {"id": "d", "content": "x", "event_time": "2024-03-01T08:00:00Z", "importance": 0.9}]
    memories = store_of(spark, memories=rows).memories
    assert ids(temporal.window(memories, "2024-03-01", "2024-03-02")) == ["c", "d", "a"]
    assert ids(temporal.window(memories, start="2024-03-01 08:30:00")) == ["c"]
    for bounds in ((None, None), ("soon", None), (" ", None)):
        with pytest.raises(ValueError):
            temporal.window(memories, *bounds)


def test_fusion(spark, store):
    def arm(*keys):
        return spark.createDataFrame(list(zip(keys, range(1, 9))), "id string, rank int")

    arms = {"lexical": arm("m0", "m1"), "graph": arm("m2", "m0")}
    rows = fusion.fuse(store.memories, arms, 10).collect()
    assert [r.id for r in rows] == ["m0", "m2", "m1"] and rows[0].sources == ["graph", "lexical"]
    assert rows[0].score == pytest.approx(1 / 61 + 1 / 62 + 0.0005 * 0.5)
    assert ids(fusion.fuse(store.memories, arms, 10, drop_graph_only=True)) == ["m0", "m1"]
    with pytest.raises(ValueError):
        fusion.fuse(store.memories, arms, k=0)


def test_recall_for_context(store):
    good = fusion.recall_for_context(store, "what dark theme do I use in obsidian")
    assert ids(good.hits)[0] == "m0" and {r.arm: r["count"] for r in good.arm_counts().collect()}["lexical"] >= 1
    assert fusion.recall_for_context(store, "weather tomorrow").hits.count() == 0
    broken = fusion.recall_for_context(store, "obsidian", backend=fusion.Backend("p", "m", error="OSError"))
    assert broken.semantic_error == "OSError" and ids(broken.hits) == ["m0"]
    with pytest.raises(RuntimeError):
        fusion.recall(store, "obsidian", backend=fusion.Backend("p", "m", error="OSError"))


def test_time_is_an_arm_not_a_filter(store):
    found = {r.id: r.sources for r in fusion.recall(store, "obsidian", since="2023-01-01").collect()}
    assert found["m0"] == ["entity", "graph", "lexical", "temporal"] and found["m3"] == ["temporal"]


def test_budget_stops_at_the_first_overflow(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "k int, n int")
    assert ids(listing.within_budget(rows, F.col("n"), [F.col("k")], 10), "k") == [1]
    assert ids(listing.within_budget(rows, F.col("n"), [F.col("k")], 100, 2), "k") == [1, 2]
