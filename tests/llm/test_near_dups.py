import random

from factloom.llm.components import components
from factloom.llm.near_dups import Cells, near_duplicates, one_of_each, op4_tensored_minhash, overlap_bound, parity_bitmap, shingle_set


def brute(rows, size, percent):
    """component by row of (doc_id, text) with distinct ids."""
    sets = {i: shingle_set(t or "", size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def corpus(seed=5):
    """Groups of near copies around the threshold, chains, exact copies and unrelated texts."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, key = [], 0
    for group in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([8, 40, 120, 300]))]
        for copy in range(r.choice([1, 3, 25])):
            words = list(base)
            for _ in range(r.randrange(0, 1 + len(words) // 25)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            if copy % 7 == 3:
                base = words  # a chain
            rows.append((key, " ".join(words)))
            key += 1
    return rows + [(key, rows[0][1]), (key + 1, None), (key + 2, ""), (key + 3, "two words"), (key + 4, "Two WORDS"), (key + 5, "\n")]


def test_components_equal_brute_force(spark, make_docs):
    rows = corpus()
    for size in (4, 5):
        found = near_duplicates(make_docs(rows), size).collect()
        assert {r.doc_id: r.component_id for r in found} == brute(rows, size, 80)
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)
        assert {r.doc_id: r.n_shingles for r in found} == {i: len(shingle_set(t or "", size)) for i, t in rows}


def test_large_group_of_near_copies(spark, make_docs):
    r = random.Random(1)
    base = [f"v{r.randrange(900)}" for _ in range(200)]
    rows = []
    for k in range(300):
        words = list(base)
        for _ in range(r.randrange(9)):
            words[r.randrange(200)] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    found = near_duplicates(make_docs(rows), 4).collect()
    assert {x.doc_id: x.component_id for x in found} == brute(rows, 4, 80)


def family(members=300, pairs=20, seed=4, own=4):
    """A template's members, about 0.7 alike, with pairs among them just above 0.8."""
    r = random.Random(seed)
    base = [f"v{r.randrange(900)}" for _ in range(300)]

    def edited(words, places):
        words = list(words)
        for k in places:
            words[k] = f"x{r.randrange(10**9)}"
        return words

    rows = [edited(base, r.sample(range(300), 7)) for _ in range(members - 2 * pairs)]
    for _ in range(pairs):
        places = r.sample(range(300), 3 + 2 * own)
        shared = edited(base, places[:3])
        rows += [edited(shared, places[3 : 3 + own]), edited(shared, places[3 + own :])]
    r.shuffle(rows)
    return [(k, " ".join(words)) for k, words in enumerate(rows)]


def test_copies_hidden_in_a_template_family(spark, make_docs):
    rows = family()
    wanted = brute(rows, 4, 80)
    assert sum(i != c for i, c in wanted.items()) >= 10
    for cells in (Cells(), Cells(members=40), Cells(shingles=9000), Cells(few=2, members=70)):
        found = near_duplicates(make_docs(rows), 4, cells=cells).collect()
        assert {x.doc_id: x.component_id for x in found} == wanted


def test_bound_is_never_below_the_overlap():
    import numpy as np

    r = np.random.default_rng(2)
    for n in (1, 5, 300, 5000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], r.integers(0, 2**63, n // 3 + 1).astype(np.uint64)]))
        assert overlap_bound(len(a), parity_bitmap(a), len(b), parity_bitmap(b)) >= len(np.intersect1d(a, b))


def test_edges_have_results(spark, edge, make_docs):
    found = near_duplicates(edge).collect()
    assert len(found) == edge.count()
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert by_id[None] == {(None, True)} and by_id[1] == {(1, True)} and by_id[2] == {(2, True)}
    assert by_id[5] == {(5, True)} and by_id[8] == {(5, False)}
    assert near_duplicates(make_docs([])).count() == 0


def test_no_link_rests_on_hashes_alone(spark, make_docs):
    # Two long words that polynomial hashes modulo a power of two can't tell apart.
    a = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    found = near_duplicates(make_docs([(1, a), (2, b), (3, f"x {a} y z q"), (4, f"x {b} y z q")]), 4).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_copies_of_other_word_order_and_repeats(spark, make_docs):
    # Equal sets from different sequences of words.
    rows = [(k, " ".join(["a b c d e"] * (2 + k))) for k in range(40)] + [(50, "a b c d e a b c d f")]
    found = near_duplicates(make_docs(rows), 4).collect()
    assert {x.doc_id: x.component_id for x in found} == brute(rows, 4, 80)


def test_rows_of_one_id_and_other_texts(spark, make_docs):
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (2, "seven eight nine ten eleven twelve"), (0, "one two three four five six")]
    found = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(make_docs(rows)).collect()}
    assert found == {(1, 0, False), (1, 1, True), (2, 1, False), (0, 0, True)}


def test_one_row_of_each_group_stays(spark, make_docs):
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (2, "seven eight nine ten eleven twelve"), (0, "one two three four five six"),
            (0, "one two three four five six"), (3, None), (3, None), (4, " "), (None, "one two three four five six"), (5, "alone here")]
    docs = make_docs(rows).selectExpr("*", "1 as __row", "'x' as component_id")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted(
        [(-1, rows[0][1]), (1, rows[1][1]), (3, ""), (3, ""), (4, " "), (-1, rows[0][1]), (5, "alone here")]
    )


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    assert {r.id: r.component for r in components(links).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def test_query_equals_brute_force_on_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = op4_tensored_minhash(spark, sf).collect()
    assert {r.doc_id: r.component_id for r in found} == brute(rows, 4, 80)
