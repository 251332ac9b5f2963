"""Retention by components against retention in one piece, and what it stands on."""

import random
from datetime import timedelta

from pyspark.sql import functions as F

from factloom.operators import lexical, semantic, writes
from factloom.operators.components import components
from factloom.plans import retain
from factloom.plans.retain import Batch, Retention, decisions, embedded, in_order, with_keys
from factloom.sources import store as stores
from factloom.sources.store import Store

from .helpers import NOW, HashEmbedder, ScriptedJudge, fact, store_of, table


def plain_groups(pairs):
    label = {}
    for place, link in pairs:
        label.setdefault(("p", place), ("p", place)), label.setdefault(("l", link), ("l", link))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for place, link in pairs:
        label[root(("l", link))] = root(("p", place))
    out = {}
    for place, _ in pairs:
        out.setdefault(root(("p", place)), set()).add(place)
    return sorted(sorted(g) for g in out.values() if len(g) > 1)


def kept(spark, tmp_path):
    paths = []

    def keep(df):
        paths.append(f"{tmp_path}/t{len(paths)}")
        df.write.parquet(paths[-1])
        return spark.read.parquet(paths[-1])

    return keep


def test_components_equal_union_find(spark, tmp_path):
    rng = random.Random(5)
    pairs = [(k, f"chain{k // 2}") for k in range(12)] + [(k + 1, f"chain{k // 2}") for k in range(12)] + [(rng.randrange(100, 160), f"x{rng.randrange(40)}") for _ in range(50)] + [(k, "hot") for k in range(200, 260)]
    rows = components(spark.createDataFrame(pairs, "place long, link string"), kept(spark, tmp_path)).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.component, set()).add(r.place)
    assert sorted(sorted(g) for g in groups.values()) == plain_groups(pairs) and all(c == min(g) for c, g in groups.items())


def test_near_groups_connect_what_is_near(spark, monkeypatch):
    monkeypatch.setattr(semantic, "BLOCK", 7)
    rng = random.Random(2)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    raw = [[x + rng.gauss(0, 0.25) for x in base[k % 5]] for k in range(40)]
    units = {str(k): [x / sum(y * y for y in v) ** 0.5 for x in v] for k, v in enumerate(raw)}
    asked = spark.createDataFrame(list(units.items()), "name string, unit array<double>")
    found = [(int(r.name), r.link) for r in semantic.near_groups(asked.select("name", F.col("unit").alias("unit")), 0.9).collect()]
    pairs = [(int(a), f"{min(int(a), int(b))}-{max(int(a), int(b))}") for a, u in units.items() for b, v in units.items() if a != b and sum(x * y for x, y in zip(u, v)) >= 0.9]
    assert plain_groups([(a, f"{link}") for a, link in found] + [(int(link), f"{link}") for _, link in found]) == plain_groups(pairs) and pairs


def test_questions_as_a_table_find_what_single_ones_find(spark):
    rows = [{"id": f"m{k}", "content": c} for k, c in enumerate(["Drinks green tea-leaves", "Works at node_4 of Ärzte e.V.", "Green teapots, teas and TEA", "tea tea tea", "nothing", "node 4 node_44"])]
    rows.append({"id": "gone", "content": "green tea", "status": "deleted"})
    store = store_of(spark, memories=rows)
    asked = ["green tea leaves", "arzte node_4", "nothing here", "the", "", "tea green node_4"]
    found = {}
    for r in lexical.search_for(store, spark.createDataFrame(list(enumerate(asked)), "q long, text string"), 3).collect():
        found.setdefault(r.q, []).append((r.place, r.id, round(r.score, 9)))
    for q, text in enumerate(asked):
        wanted = [(k + 1, r.id, round(r.score, 9)) for k, r in enumerate(lexical.search(store, text, 3).collect())]
        assert sorted(found.get(q, [])) == wanted


def lives(name, city):
    return {"entities": [{"name": name}], "relationships": [{"subject": name, "predicate": "lives_in", "object": city}]}


def crossing():
    """Facts of several components whose links cross in the batch's order."""
    return [
        fact("likes GREEN  tea", confidence=0.95), fact("Asha lives in Goa", **lives("asha", "Goa")), fact("Bo lives in Rome", **lives("Bo", "Rome")), fact("green tea likes"),
        fact("Asha moved to Goa in May", **lives("Asha", "Goa")), fact("Bo lives in Oslo", **lives("bo", "Oslo")), fact("likes green TEA", importance=0.9, event_time="2024-01-01"), fact("Asha lives in Goa"),
        fact("Prefers light theme in the big editor window", subtype="preference", entities=[{"name": "Editor"}]), fact("not kept", durable=False), fact("Owns two cats", entities=[{"name": "Cat", "aliases": ["cats"]}]),
        fact("The cat sleeps", entities=[{"name": "CATS"}]), fact("Bo lives in Rome", **lives("Bo", "Rome")), fact("owns TWO cats"), fact("Prefers grey theme in the big editor window", subtype="preference", entities=[{"name": "editor"}]),
    ]


def base_of(spark):
    names = ("memories", "entities", "relationships", "memory_entities", "memory_relationships", "memory_embeddings")
    engine = Retention(store_of(spark), NOW - timedelta(days=9), embedder=HashEmbedder())
    engine.retain([fact("Asha lives in Pune", **lives("Asha", "Pune")), fact("Likes green tea"), fact("Prefers dark theme in the big editor window", subtype="preference", entities=[{"name": "Editor"}])])
    store, _ = engine.result()
    rows = {n: [r.asDict() for r in getattr(store, n).collect()] for n in names}
    return store_of(spark, **rows)


def both_ways(spark, base, judge=None):
    """The decisions and facts by components, and in one piece."""
    items = [i | {"refused": None if i["durable"] else "not durable"} for i in crossing()]
    fields = [c.split(" ", 1)[0] for c in retain.FACTS.split(", ")[:9]] + ["entities", "relationships"]
    parts = lambda i: {"entities": retain._parts(i["entities"], "name", "entity_type", "role", "aliases"), "relationships": retain._parts(i["relationships"], "subject", "predicate", "object", "confidence")}
    facts = with_keys(spark.createDataFrame([tuple((i | parts(i) | {"place": k, "event_time": i.get("event_time")}).get(f) for f in fields) for k, i in enumerate(items)], retain.FACTS))
    out = []
    for given in (None, embedded(HashEmbedder(), {k: i["content"] for k, i in enumerate(items)})):
        batch = Batch(base, NOW, HashEmbedder(), judge)
        told = batch.outcomes(facts, given)
        after, _ = batch.applied(facts, told)
        out.append((decisions(told), sorted((r.id, r.content, r.status, r.superseded_by or "", r.confidence, r.importance) for r in after.memories.collect())))
        if given is None:
            shape = sorted(r.canonical_name for r in after.entities.collect()), after.relationships.count(), after.memory_entities.count(), after.retention_events.count()
        batch.discard()
    return out, shape


def test_components_decide_as_one_piece(spark):
    (by_parts, whole), (names, edges, _, events) = both_ways(spark, base_of(spark))
    assert by_parts == whole
    assert {d.action for d in whole[0]} == {"created", "updated", "ignored", "superseded"} and {d.reason for d in whole[0]} == {"exact duplicate", "semantic duplicate", "not durable", "new durable memory", "replaces outdated memory"}
    assert names == ["Asha", "Bo", "Cat", "Editor", "Goa", "Oslo", "Pune", "Rome"] and edges == 4 and events == len(crossing())


def test_a_judge_sees_the_same_by_components(spark):
    (by_parts, whole), _ = both_ways(spark, base_of(spark), ScriptedJudge("extends"))
    assert by_parts == whole and not any(d.action == "superseded" for d in whole[0][:1])


def test_places_follow_the_order(spark, tmp_path):
    rows = [(f"s{k % 7}", k) for k in range(100)]
    placed = in_order(spark.createDataFrame(rows, "s string, k long").repartition(5), kept(spark, tmp_path), "s", "k").collect()
    assert [(r.s, r.k) for r in sorted(placed, key=lambda r: r.place)] == sorted(rows) and sorted(r.place for r in placed) == list(range(100))


# -- writers ------------------------------------------------------------------------


def filled(spark, now, *contents):
    rows = table(spark, "memories", [{"id": c, "content": c} for c in contents])
    return now.with_(memories=now.memories.union(rows.select(*now.memories.columns)))


def test_a_writer_that_is_overtaken_keeps_the_other_ones_facts(spark, tmp_path):
    store, tries = Store(spark, f"file://{tmp_path}/s"), []
    store.commit(filled(spark, store.open(), "one"), ["memories"])

    def make(now):
        tries.append(now.version)
        if len(tries) == 1:
            store.commit(filled(spark, store.open(), "two"), ["memories"])  # meanwhile
        return "done", filled(spark, now, "three"), ["memories"]

    assert store.change(make) == "done" and tries == [1, 2]
    assert sorted(r.id for r in store.open().memories.collect()) == ["one", "three", "two"]


def test_recalls_are_rows_beside_the_facts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST_RECALLS", 3)
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit(filled(spark, store.open(), "a", "b"), ["memories"])
    at, opened = store.manifest()["tables"]["memories"], store.open()
    store.touch(["a", "a", "nobody"], NOW)
    store.touch(["a", "b"], NOW + timedelta(days=1))
    counts = lambda: {r.id: (r.recall_count, r.last_recalled_at.day if r.last_recalled_at else None) for r in store.open().memories.collect()}
    assert counts() == {"a": (2, 2), "b": (1, 2)} and store.manifest()["tables"]["memories"] == at and len(store.manifest()["tables"]["recalls"]) == 2
    try:
        store.commit(filled(spark, opened, "c"), ["memories"])
        raise AssertionError("recalls would be lost")
    except stores.ConflictError:
        pass
    store.touch(["b"], NOW)
    assert counts() == {"a": (2, 2), "b": (2, 2)} and "recalls" not in store.manifest()["tables"]
    assert {r.id for r in writes.with_recalls(store.open().memories, spark.createDataFrame([], "id string, at timestamp")).collect()} == {"a", "b"}
    store.compact(keep=1)
    assert counts() == {"a": (2, 2), "b": (2, 2)} and not list((tmp_path / "s").glob("recalls-*"))


def test_an_old_replay_of_a_stream_is_known(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for number in range(3):
        store.commit(filled(spark, store.open(), f"f{number}"), ["memories"], batch=f"stream#{number}")
    assert [store.has_batch(f"stream#{k}") for k in range(4)] == [True, True, True, False] and not store.has_batch("other#0")
    assert store.commit(filled(spark, store.open(), "again"), ["memories"], batch="stream#0") == 3


def test_rows_that_name_no_fact_are_dealt_out(spark):
    """Most pointers are null; the join of a purge must not bring them together."""
    from factloom.operators import maintenance

    rows = [{"id": f"m{k}", "content": "c", "superseded_by": "m1" if k % 50 == 2 else None} for k in range(400)]
    store = store_of(spark, memories=rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = maintenance.purge(store, spark.createDataFrame([("m1",), ("m7",)], "id string")).memories
        dealt = left.select("superseded_by", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [sum(r.p == p for r in dealt) for p in {r.p for r in dealt}]
    assert len(dealt) == 398 and all(r.superseded_by is None for r in dealt) and max(sizes) < 200
