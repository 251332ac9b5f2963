import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import phrases
from factloom.llm.phrases import corpus_runs, op12_phrase_collocations, packed_runs, radix_order, split_words, top_phrases
from factloom.llm.registry import ORACLES

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def words_in(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute(rows, least=10, most=2000, share=50):
    """rows: (lang, text); the result's rows, in order."""
    counts, out = {}, []
    for lang, text in rows:
        mine = counts.setdefault(lang or "und", Counter())
        for piece in words_in(text):
            mine.update(tuple(piece[a : a + k]) for k in (1, 2, 3) for a in range(len(piece) - k + 1))
    for lang, mine in sorted(counts.items()):
        n = sum(v for k, v in mine.items() if len(k) == 1)
        cand = {k: v for k, v in mine.items() if len(k) > 1 and v >= least}
        found = []
        for g, a in cand.items():
            if any(len(x) > len(g) and g in (x[:2], x[1:]) and 100 * v >= share * a for x, v in cand.items() if len(g) == 2):
                continue
            score, _, left, right = min((10**6 * a * a // (mine[g[:k]] * mine[g[k:]]), k, mine[g[:k]], mine[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:most])]
    return out


def found(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=lambda r: r[:2])


def test_query_equals_sql_and_brute_force(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    rows = found(op12_phrase_collocations(spark, sf))
    assert rows == sorted(map(tuple, con.execute(ORACLES["op12_phrase_collocations"]).fetchall()), key=lambda r: r[:2])
    assert rows == brute([(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]) and rows


def test_small_blocks_and_many_ranges_change_nothing(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).cache()
    wanted = brute([(r.lang, r.text) for r in docs.collect()], 3, 50)
    whole = phrases.blocks_of
    monkeypatch.setattr(phrases, "blocks_of", lambda d: whole(d, 5_000))
    assert found(top_phrases(docs, 3, 50)) == wanted and wanted


def test_edges_have_results(spark, edge, make_docs):
    rows = [(r.lang, r.text) for r in edge.collect()]
    assert found(top_phrases(edge.selectExpr("*", "1 as rank", "2 as n", "'w' as word"), 2)) == brute(rows, 2)
    assert top_phrases(make_docs([]), 2).count() == 0
    odd = [(None, "A b. a B; a b\nA b!a\tb"), ("und", "a  b c.d e\x00f  g"), ("x", "..., ,"), ("x", None), ("x", "İ É é"), (None, "b a b a b a")]
    docs = spark.createDataFrame(odd, "lang string, text string")
    assert found(top_phrases(docs, 1)) == [r for r in brute(odd, 1) if r[6]]


def test_ties_and_the_share(spark):
    odd = [("x", "b c. a b. c d. a c d. c d"), ("x", "z y x. z y x. z y. q y")] * 3
    docs = spark.createDataFrame(odd, "lang string, text string")
    for least, most, share in ((3, 4, 50), (3, 100, 70), (1, 100, 100)):
        assert found(top_phrases(docs, least, most, share)) == brute(odd, least, most, share)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 200_000), max_size=200))
def test_packed_runs(ids):
    keys, counts = packed_runs(np.array(ids, np.uint32))
    padded = [*ids, 0, 0]
    wanted = Counter(tuple(padded[a : a + 3]) for a in range(len(ids)) if padded[a] and padded[a + 1])
    assert [tuple(k) for k in keys.tolist()] == sorted(wanted) and counts.tolist() == [wanted[k] for k in sorted(wanted)]


def test_radix_order_is_stable_and_sorts():
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 1 << 20, 5000).astype(np.uint32) for _ in range(3)]
    ids[0] %= 3
    assert radix_order(ids).tolist() == np.lexsort(ids[::-1]).tolist()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aAb .\t\n,é", max_size=30), min_size=1, max_size=5))
def test_split_words(texts):
    codes, words = split_words(pa.array(texts))
    names = ["|", *words.to_pylist()]
    pieces = [p for t in texts for p in words_in(t) if p]
    assert [x.split() for x in " ".join(names[c] for c in codes).split("|") if x.split()] == pieces


@pytest.mark.parametrize("ranges", [1, 7])
def test_pairs_across_ranges(spark, ranges):
    rows = [(np.array([1, 2, k % 9], ">u4").tobytes(), 1) for k in range(300)] + [(np.array([2, k % 5 + 1, 0], ">u4").tobytes(), 2) for k in range(20)]
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = corpus_runs(spark.createDataFrame([(bytearray(k), n) for k, n in rows], "key binary, n long"), 3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    pairs = Counter()
    for r in got:
        if not r.w3:
            pairs[r.w1, r.w2] += r.a
    assert pairs == Counter({(1, 2): 300, **{(2, k + 1): 8 for k in range(5)}})
    assert {(r.w1, r.w2, r.w3): r.a for r in got if r.w3} == {(1, 2, k): sum(x % 9 == k for x in range(300)) for k in range(1, 9)}
