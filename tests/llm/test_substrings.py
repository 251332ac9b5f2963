import hashlib
import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm.automaton import NEVER, SuffixAutomaton
from factloom.llm.registry import ORACLES
from factloom.llm.substrings import op11_substring_automata, without_repeats


def brute(rows, window=13):
    """rows: (doc_id, text); sorted rows of doc_id, n_words, n_removed, kept."""
    split = [(i, NEVER if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for _, doc, words in split:
        for a in range(len(words) - window + 1):
            w = tuple(words[a : a + window])
            first[w] = min(first.get(w, NEVER), doc)
    out = []
    for i, doc, words in split:
        gone = {p for a in range(len(words) - window + 1) if first[tuple(words[a : a + window])] < doc for p in range(a, a + window)}
        out.append((i, len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone)))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr)


def test_query_equals_brute_force_and_sql(spark, sf):
    rows = sorted((tuple(r) for r in op11_substring_automata(spark, sf).select("doc_id", "kept_sha256", "n_removed", "n_words").collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert rows == sorted(con.execute(f"select doc_id, kept_sha256, n_removed, n_words from ({ORACLES['op11_substring_automata']})").fetchall(), key=repr)
    plain = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert rows == sorted(((i, hashlib.sha256(k.encode()).hexdigest(), g, n) for i, n, g, k in plain), key=repr)
    assert any(r[2] for r in rows) and any(0 < r[2] < r[3] for r in rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab", max_size=12), st.integers(0, 3)), max_size=5), st.text(alphabet="abc", max_size=20), st.integers(0, 4))
def test_automaton_equals_brute_force(passages, text, number):
    automaton, least = SuffixAutomaton(), 3
    for words, n in passages:
        automaton.add(words, n)
    automaton.close(least)
    gone = {p for a in range(len(text) - least + 1) if any(n < number and text[a : a + least] in w for w, n in passages) for p in range(a, a + least)}
    spans = automaton.spans(list(text), number)
    assert {p for a, b in spans for p in range(a, b)} == gone
    assert all(b <= a for (_, b), (a, _) in zip(spans, spans[1:]))


@pytest.mark.parametrize("seed, shard_words", [(1, 100_000), (2, 40), (3, 300)])
def test_overlapping_passages(spark, make_docs, seed, shard_words):
    """Passages cut at random places, whose windows first stand in different documents; copies, ties, repeated words."""
    rng = random.Random(seed)
    pool = [f"w{k % 37}x{k}" for k in range(120)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(100)
            parts += pool[a : a + rng.randint(3, 30)] + [f"own{i}"] * rng.randint(0, 2)
        rows.append((rng.choice([i, i, i, 5, None]), rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += rng.choices(rows, k=10) + [(100, "na " * 60), (101, "na " * 20), (102, "na " * 12)]
    assert found(without_repeats(make_docs(rows), shard_words=shard_words)) == brute(rows)


def test_edges_have_results(spark, edge, make_docs):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert found(without_repeats(edge.selectExpr("*", "1 as doc", "'k' as key", "2 as kept"))) == brute(rows)
    assert found(without_repeats(edge, window=6)) == brute(rows, 6)
    assert without_repeats(make_docs([])).count() == 0


def test_one_passage_in_every_document(spark, make_docs):
    common = " ".join(f"c{k}" for k in range(40))
    rows = [(i, f"left{i} " * (i % 5) + common + f" right{i}" * (i % 3)) for i in range(600)]
    got = found(without_repeats(make_docs(rows).repartition(7), shard_words=100))
    assert got == brute(rows) and sum(r[2] for r in got) >= 599 * 40
