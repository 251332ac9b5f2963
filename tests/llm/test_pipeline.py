import re

import corpus_pipeline
import pytest

from factloom.llm import quality
from factloom.llm.decontamination import Index, Rule, find
from factloom.llm.secrets import RULES

from .test_near_dups import brute as components_of
from .test_near_dups import family


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    settings = quality.Settings()
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), settings)
    kept = {i: r.text for i, r in rows.items() if model.forward(*quality.passage_features([r.text or ""], settings.passage))["score"][0] >= settings.threshold}
    groups = components_of(list(kept.items()), 5, 80)
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    index = Index([(b.item_id, b.text) for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], Rule())
    leaked = {d for d, _, _ in find(list(kept.values()), index)}
    kept = {i: t for k, (i, t) in enumerate(kept.items()) if k not in leaked}
    assert 0 < len(kept) < len(rows)

    frame = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        frame = stage(spark, frame, sf)
        assert frame.columns == docs.columns, name
    found = {r.doc_id: r for r in frame.collect()}
    assert set(found) == set(kept)
    for i, r in found.items():
        assert r.n_chars == len(r.text)
        spans = [m for rule in RULES for m in re.finditer(rule.pattern, kept[i]) if len(m[rule.group]) >= rule.least]
        assert (r.text == kept[i]) == (not spans)
        assert not any(m[0] in r.text for m in spans)


def test_run_packs_what_the_stages_keep(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


@pytest.mark.parametrize("number", range(4))
def test_stages_take_edges(spark, edge, sf, number):
    _, stage = corpus_pipeline.STAGES[number]
    assert stage(spark, edge, sf).columns == edge.columns
    assert stage(spark, edge.limit(0), sf).count() == 0


def test_one_of_each_group_stays(spark, edge, sf):
    kept = [r.doc_id for r in corpus_pipeline.without_copies(spark, edge, sf).collect()]
    assert sorted(kept, key=lambda i: (i is not None, i)) == [None, 1, 2, 3, 4, 5, 6, 7, 9]


def test_no_copy_hidden_in_a_template_family_stays(spark, make_docs, sf):
    rows = family(members=400, pairs=60, seed=6, own=3)
    groups = components_of(rows, 5, 80)
    assert sum(i != c for i, c in groups.items()) >= 10
    kept = [r.doc_id for r in corpus_pipeline.without_copies(spark, make_docs(rows), sf).collect()]
    assert sorted(kept) == sorted(set(groups.values()))
