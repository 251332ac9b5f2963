from pyspark.sql import functions as F

from factloom.llm.sharding import Leaf, grown, op2_hash_tree_shards, place, shard_documents, tree


def placed(spark, leaves, n=4000):
    rows = spark.range(n).select("id", place(F.col("id"), leaves).alias("shard")).collect()
    return {r.id: r.shard for r in rows}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    leaves = tree(24)
    before, after = placed(spark, leaves), placed(spark, grown(leaves))
    moved = [i for i in before if before[i] != after[i]]
    assert moved and all(after[i] == 24 for i in moved)
    assert 60 < len(moved) < 280  # 1 of 25 shards


def test_the_tree_is_a_function_of_the_count(spark):
    for n in (24, 25, 30):
        before, after = placed(spark, tree(n), 2000), placed(spark, tree(n + 1), 2000)
        assert all(after[i] in (before[i], n) for i in before)
    assert sorted(x.shard for x in tree(7)) == list(range(7)) and tree(0) == []


def plain_place(key, leaves):
    """The descent in plain Python, level by level."""
    import math

    import xxhash

    def draw(path, weight):
        # Of several columns each is hashed with the hash before it as its seed.
        bits = xxhash.xxh64_intdigest(path.encode(), xxhash.xxh64_intdigest(key.encode(), 42))
        return math.log(((bits >> 11) + 1) / 2.0**53) / weight

    inside, path = leaves, ()
    for level in range(3):
        names = {}
        for x in inside:
            names.setdefault((x.region, x.rack, str(x.shard))[level], []).append(x)
        best = max(names, key=lambda n: (draw("/".join((*path, n)), sum(x.weight for x in names[n])), n))
        inside, path = names[best], (*path, best)
    return inside[0].shard


def test_shares_follow_weights(spark):
    leaves = [Leaf("a", "x", 0, 1), Leaf("a", "y", 1, 2), Leaf("b", "x", 2, 3), Leaf("b", "x", 3, 0)]
    shards = list(placed(spark, leaves, 12_000).values())
    assert [round(shards.count(s) / 2000) for s in range(4)] == [1, 2, 3, 0]


def test_movement_stays_in_the_changed_subtree(spark):
    before = [Leaf(r, k, s) for s, (r, k) in enumerate((r, k) for r in "abc" for k in "xy")]
    after = [Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 2 else 1.0) for x in before]
    old, new = placed(spark, before), placed(spark, after)
    moved = [i for i in old if old[i] != new[i]]
    assert moved and all(new[i] in (2, 3) for i in moved)  # region b
    assert all(new[i] == 2 for i in moved if old[i] in (2, 3))


def test_slots_are_gapless_and_edges_have_results(spark, edge):
    rows = shard_documents(edge, tree(3, 1, 1)).collect()
    assert len(rows) == edge.count()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert {r["size"] for r in rows if r.doc_id == 1} == {8}


def test_a_hot_id_is_dealt_to_many_tasks(spark, make_docs):
    docs = make_docs([(None, "same")] * 300 + [(7, "same")] * 300 + [(k, "x") for k in range(50)])
    rows = shard_documents(docs.selectExpr("*", "1 as shard", "2 as slot", "3 as __part", "4 as size"), tree(4, founded=4)).collect()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 650 and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1
    assert shard_documents(make_docs([]), tree(4)).count() == 0


def test_query_equals_plain_descent(spark, sf):
    import zlib

    rows = op2_hash_tree_shards(spark, sf).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    old, new = tree(24), tree(25)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        assert (r.shard, r.grown_shard) == (plain_place(str(r.doc_id), old), plain_place(str(r.doc_id), new))
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert {r.law for r in rows} == {"key"} and {r.shard for r in rows} <= set(range(24))
    assert all(r.grown_shard in (r.shard, 24) for r in rows)


def test_two_runs_give_equal_slots(spark, sf, make_docs):
    runs = [sorted(map(tuple, op2_hash_tree_shards(spark, sf).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    docs = make_docs([(None, f"t{k % 9}") for k in range(60)] + [(k % 5, "same") for k in range(60)])
    again = [sorted(map(repr, shard_documents(d, tree(3, 1, 1)).collect())) for d in (docs, docs.repartition(3))]
    assert again[0] == again[1]
