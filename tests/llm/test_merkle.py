import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.llm.merkle import lowered_in_a_third, manifest, op13_merkle_manifest
from factloom.llm.ranks import digits_of, radix_ranks
from factloom.llm.registry import ORACLES
from factloom.llm.workspace import write_table


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climbed(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][a : a + 8]) for a in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, at):
    for level in levels[:-1]:
        a = at // 8 * 8
        yield at - a, level[a : at] + level[at + 1 : a + 8]
        at //= 8


def brute(rows):
    """rows: Row of documents; the result's rows, sorted."""
    leaf = lambda r, text: h(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))
    drawn = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    order = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((order(r.doc_id), leaf(r, r.text), leaf(r, low(r.text) if drawn(r) else r.text), r.doc_id))
    trees = {k: climbed([x[1] for x in sorted(v)]) for k, v in groups.items()}
    langs = sorted(groups, key=order)
    over = climbed([trees[k][-1][0] for k in langs])
    out = []
    for place, lang in enumerate(langs):
        for at, (_, own, new, doc_id) in enumerate(sorted(groups[lang])):
            steps = [*path(trees[lang], at), *path(over, place)]
            end = new
            for k, rest in steps:
                end = h(*rest[:k], end, *rest[k:])
            out.append((doc_id, own, trees[lang][-1][0], over[-1][0], h(*(x for _, rest in steps for x in rest)), end, end == over[-1][0]))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_plain_trees(spark, sf):
    rows = found(op13_merkle_manifest(spark, sf))
    assert rows == brute(spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert {r[-1] for r in rows} == {True, False}


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(map(tuple, con.execute(ORACLES["op13_merkle_manifest"]).fetchall()), key=repr) == found(op13_merkle_manifest(spark, sf))


def test_edges_have_results(spark, edge, make_docs):
    assert found(manifest(edge, lowered_in_a_third())) == brute(edge.collect())
    assert manifest(make_docs([]), lowered_in_a_third()).count() == 0
    odd = spark.createDataFrame([(i, f"Text {i}", None if i % 11 == 0 else f"l{i % 11}" * (i % 3), None if i % 2 else "s", i) for i in range(-40, 90)], edge.schema).withColumnsRenamed({"source": "s", "lang": "source"}).withColumnsRenamed({"s": "lang"})
    assert found(manifest(odd.selectExpr("*", "1 as at", "2 as digest", "'x' as `group`"), lowered_in_a_third())) == brute(odd.collect())
    many = spark.createDataFrame([(i, "T", f"lang{i % 13}", "s", i) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    assert found(manifest(many, lowered_in_a_third())) == brute(many.collect())


def test_a_hot_id_and_equal_rows(spark, make_docs):
    rows = [(None, "Same")] * 40 + [(7, f"T{k}") for k in range(40)] + [(7, "same row")] * 30 + [(1 << 62, "far")] + [(k, "x") for k in range(700)]
    docs = make_docs(rows)
    assert found(manifest(docs, lowered_in_a_third())) == brute(docs.collect())


@pytest.mark.parametrize("usual, most", [(4, 6), (256, 4096), (1, 1)])
def test_ranks_through_all_depths(spark, usual, most):
    ids = [5] * 50 + [None] * 20 + list(range(-300, 300)) + [1 << 60, -(1 << 63), (1 << 63) - 1]
    table, _ = write_table(spark.createDataFrame([(i, str((i or 0) % 2)) for i in ids], "id long, g string").repartition(3), "ids")
    ranked = radix_ranks(table, "g", F.concat(digits_of(F.col("id"))), "at", usual, most).collect()
    for g in "01":
        mine = sorted((r["at"], r.id) for r in ranked if r.g == g)
        assert [a for a, _ in mine] == list(range(len(mine)))
        assert [i for _, i in mine] == sorted((i for i in ids if str((i or 0) % 2) == g), key=lambda i: (i is not None, i or 0))


def test_keys_that_continue_others_come_after_them(spark):
    names = ["", "a", "ab", "abc", "b", "ba", "é", "z" * 40, "z" * 41]
    table, _ = write_table(spark.createDataFrame([(n, "") for n in names], "n string, g string"), "names")
    ranked = radix_ranks(table, "g", F.hex("n"), "at", 1, 1).collect()
    assert [r.n for r in sorted(ranked, key=lambda r: r["at"])] == sorted(names, key=str.encode)
