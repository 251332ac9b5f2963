import random

import numpy as np

from factloom.llm.decontamination import Index, Rule, best_passage, contaminated, features, find, fingerprints, op9_simhash_decontamination, similarity, weighted, _lane_sums
from factloom.llm.words import word_hashes, words_of


def brute(text, item, rule=Rule()):
    """The best similarity of any passage as long as the item."""
    words, n = words_of(text or ""), len(words_of(item))
    wanted = weighted(words_of(item), rule.size)
    return max((similarity(wanted, weighted(words[k : k + n], rule.size)) for k in range(max(len(words) - n + 1, 1))), default=0.0)


def made(seed=3):
    r = random.Random(seed)
    vocabulary = [f"t{k}" for k in range(400)]
    items = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (3, 5, 9, 15, 16, 24, 40, 59, 130, 300)]
    docs = []
    for k, item in enumerate(items):
        around = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(200))) for _ in range(2)]
        edited = item.split()
        edited[r.randrange(len(edited))] = "changed"
        for own in (item, item.upper(), " ".join(edited), " ".join(item.split()[: len(item.split()) // 2])):
            docs.append(" ".join([around[0], own, around[1]]))
    return items, docs + ["", "   ", "unrelated words only here"]


def test_finds_equal_brute_force():
    items, docs = made()
    found = {(d, i) for d, i, _ in find(docs, Index(list(enumerate(items)), Rule()))}
    wanted = {(d, i) for d, t in enumerate(docs) for i, item in enumerate(items) if brute(t, item) >= 0.8}
    assert found == wanted and len(found) >= 20


def test_long_items_with_edits_gathered_at_the_start():
    r = random.Random(8)
    items, docs = [], []
    for n in (140, 170, 220, 300, 500, 1000):
        for _ in range(6):
            words = [f"t{r.randrange(400)}" for _ in range(n)]
            around = [[f"t{r.randrange(400)}" for _ in range(r.randrange(100, 200))] for _ in range(2)]
            run = n // 12
            at = r.randrange(max(1, 113 - run))
            new = [f"n{k}" for k in range(run)]
            for own in (new + words[run:], words[:at] + new + words[at + run :], words[run:], words[:at] + words[at + run :], words[:at] + new + words[at:]):
                docs.append(" ".join(around[0] + own + around[1]))
            items.append(" ".join(words))
    found = {(d, i) for d, i, _ in find(docs, Index(list(enumerate(items)), Rule()))}
    wanted = {(d, d // 5) for d, t in enumerate(docs) if brute(t, items[d // 5]) >= 0.8}
    assert found == wanted and len(found) >= 100


def test_recall_of_edited_items_of_all_lengths():
    """Edits that leave 0.8: runs at the ends, scattered words, missing and added ones; every passage is found."""
    r = random.Random(12)
    items, docs, owner = [], [], []
    for n in [*range(1, 40), 45, 49, 52, 60, 75, 90, 100, 121, 130, 180, 250, 400, 600, 900, 1200]:
        words = [f"t{r.randrange(900)}" for _ in range(n)]
        items.append(" ".join(words))
        lost = max(n - 4, 1) // 9
        passages = [words]
        for _ in range(10):
            own, left = list(words), lost
            while left > 0 and (kind := r.choice(["head", "tail", "inside", "missing", "added"])):
                if kind in ("head", "tail"):
                    k = r.randrange(1, left + 1)
                    own = [f"n{r.random()}"] * k + own[k:] if kind == "head" else own[:-k] + [f"n{r.random()}"] * k
                    left -= k
                elif left >= 5:
                    at = r.randrange(1, len(own) - 1)
                    own[at : at + (kind != "added")] = [] if kind == "missing" else [f"n{r.random()}"]
                    left -= 5
                else:
                    left -= 1
            passages.append(own)
        for own in passages:
            around = [[f"a{r.randrange(900)}" for _ in range(r.randrange(60))] for _ in range(2)]
            docs.append(" ".join(around[0] + own + around[1]))
            owner.append(len(items) - 1)
    found = {(d, i) for d, i, _ in find(docs, Index(list(enumerate(items)), Rule())) if i == owner[d]}
    wanted = {(d, owner[d]) for d, t in enumerate(docs) if brute(t, items[owner[d]]) >= 0.8}
    assert found == wanted and len(wanted) > 0.7 * len(docs)


def test_edits_in_the_lead_of_long_items():
    r = random.Random(4)
    items, docs = [], []
    for n, edited in ((600, 60), (1200, 60), (1200, 80), (1200, 100)):
        for _ in range(10):
            words = [f"t{r.randrange(2000)}" for _ in range(n)]
            items.append(" ".join(words))
            docs.append(" ".join([f"n{k}" for k in range(edited)] + words[edited:]))
    found = {(d, i) for d, i, _ in find(docs, Index(list(enumerate(items)), Rule()))}
    assert found == {(d, d) for d in range(len(docs))}


def test_short_items_are_found_everywhere():
    r = random.Random(6)
    items = [" ".join(f"k{n}x{j}" for j in range(n)) for n in range(1, 7)]
    docs = [" ".join([f"a{k}" for k in range(shift)] + item.split() + ["end"] * (shift % 3)) for item in items for shift in range(8)]
    found = {(d, i) for d, i, _ in find(docs, Index(list(enumerate(items)), Rule()))}
    assert found == {(d, d // 8) for d in range(len(docs))} and r


def test_an_index_stays_small():
    import sys

    items = [(k, " ".join(f"w{k * 7 + j}" for j in range(55))) for k in range(2000)]
    index = Index(items, Rule())
    held = sum(a.nbytes for g in index.groups for a in (g.items, g.offsets, g.marks)) + sum(o.nbytes for g in index.groups for _, o in g.tables)
    assert held / len(items) < 4000 and sys.getsizeof(index.texts)


def test_best_passage_equals_brute_force():
    r = random.Random(9)
    for n in (2, 4, 5, 8, 30):
        item = [f"t{r.randrange(3)}" for _ in range(n)]
        words = [f"t{r.randrange(3)}" for _ in range(40)]
        wanted = weighted(item, 5)
        s = max(similarity(wanted, weighted(words[k : k + n], 5)) for k in range(41))
        assert best_passage(words, 0, 40, n, wanted, Rule(similarity=0.0)) == s


def test_fingerprints_equal_plain_simhash():
    words = word_hashes(["a b c d e f g h i j k l m"])[0]
    pairs = features(words)
    got = fingerprints(_lane_sums(pairs), np.arange(4), 7)
    for k in range(4):
        own = [int(x) for x in pairs[k : k + 7]]
        assert int(got[k]) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in own) > 3)


def test_lookup_finds_all_within_the_radius():
    items, _ = made()
    group = next(g for g in reversed(Index(list(enumerate(items)), Rule(radius=15)).groups) if g.radius)
    r = np.random.default_rng(1)
    prints = np.array([int(m) ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 20), replace=False)) for m in np.repeat(group.marks, 200)], np.uint64)
    window, member = group.near(prints)
    wanted = {(w, m) for w, p in enumerate(prints) for m, q in enumerate(group.marks) if int(p ^ q).bit_count() <= 15}
    assert set(zip(window.tolist(), member.tolist())) == wanted


def test_edges_and_blocks(spark, edge, make_docs):
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, None), (None, "x"), (3, ""), (4, "word"), (5, "no id at")], "item_id long, text string")
    docs = edge.selectExpr("*", "'old' as item_ids", "0 as similarity", "1 as score")
    for rule in (Rule(), Rule(item_bytes=10), Rule(item_bytes=10, pass_bytes=20, text_chars=5)):
        rows = contaminated(docs, bench, rule).collect()
        assert len(rows) == edge.count()
        assert [r.item_ids for r in rows if r.doc_id in (5, 8)] == [[1]] * 3 and [r.item_ids for r in rows if r.doc_id is None] == [[5]]
        assert all(r.item_ids == [] and r.similarity is None for r in rows if r.doc_id in (1, 2, 3))
        assert all(4 in r.item_ids for r in rows if r.doc_id == 4)
    assert contaminated(make_docs([]), bench).count() == 0
    assert all(r.item_ids == [] for r in contaminated(edge, bench.limit(0)).collect())


def test_query_equals_brute_force_on_the_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    shingles = {i.item_id: set(weighted(words_of(i.text), 5)) for i in items}
    found = {r.doc_id: r.item_ids for r in op9_simhash_decontamination(spark, sf).collect()}
    assert set(found) == set(docs) and any(found.values())
    for doc, text in docs.items():
        own = set(weighted(words_of(text), 5))
        assert found[doc] == sorted(i.item_id for i in items if own & shingles[i.item_id] and brute(text, i.text) >= 0.8)
