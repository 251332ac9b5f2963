import zlib

import numpy as np
from pyspark.sql import functions as F

from factloom.llm.quality import FEATURES, Model, Settings, fit, held_out, op8_attention_quality, passage_features, score, train


def test_passages_cover_whole_texts():
    x, counts = passage_features(["", "abc " * 1000, "é"], 768)
    assert counts.tolist() == [1, 5, 1] and x.shape == (7, FEATURES)
    assert (x[0] == 0).all() and np.allclose((x[1:6, :-2] ** 2).sum(1), 1, atol=1e-5)


def test_gradient_is_right():
    r = np.random.default_rng(1)
    settings = Settings(hidden=4, gate=3)
    model = Model(settings, np.zeros(FEATURES), np.ones(FEATURES))
    x, counts, y = r.normal(size=(7, FEATURES)), np.array([2, 1, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, counts)["score"]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    gradient = model.gradient(x, counts, y)
    for name in ("V", "U", "w", "c", "c0", "b"):
        at = tuple(0 for _ in model.p[name].shape)
        model.p[name][at] += 1e-3
        up = loss()
        model.p[name][at] -= 2e-3
        down = loss()
        model.p[name][at] += 1e-3
        assert abs((up - down) / 2e-3 - gradient[name][at]) < 2e-3, name


def test_attention_finds_the_telling_passage():
    r = np.random.default_rng(2)
    bags, y = [], []
    for k in range(200):
        bag = r.normal(0, 0.1, (6, FEATURES)).astype(np.float32)
        if k % 2:
            bag[r.integers(6), :5] += 3
        bags.append(bag)
        y.append(float(k % 2))
    model = fit(bags, np.array(y), Settings(epochs=30, rate=1e-2))
    f = model.forward(np.concatenate(bags), np.full(200, 6))
    assert ((f["score"] > 0.5) == np.array(y)).mean() > 0.97
    assert f["a"].reshape(200, 6)[1::2].max(1).mean() > 0.5


def test_edges(spark, edge, make_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (8, 1, 0), (None, 1, 0), (4, None, 0), (7, 3, 1)], "doc_id long, quality int, toxic int")
    model = train(edge, labels, Settings(epochs=2))
    rows = score(edge.withColumn("score", F.lit("old")), model).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    empty = train(make_docs([]), labels.limit(0))
    assert {r.score for r in score(edge, empty).collect()} == {0.5}
    assert score(make_docs([]), empty).count() == 0


def test_the_fit_is_bounded_and_depends_on_rows_alone(spark, make_docs):
    docs = make_docs([(k, f"text number {k} " * (k % 5 + 1)) for k in range(60)] + [(3, "another text of the same id"), (4, "y" * 50_000)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    settings = Settings(epochs=1, sample_chars=2000)
    one, two = train(docs, labels, settings), train(docs.repartition(7), labels.repartition(3), settings)
    assert all(np.array_equal(one.p[k], two.p[k]) for k in one.p)
    assert not np.array_equal(one.p["W"], train(docs, labels, Settings(epochs=1)).p["W"])


def test_a_very_long_text_is_scored_whole(spark, make_docs):
    model = Model(Settings(), np.zeros(FEATURES), np.ones(FEATURES))
    long = "word " * 300_000
    rows = {r.doc_id: r.score for r in score(make_docs([(1, long), (2, long), (3, long + "other end " * 500)]), model).collect()}
    assert rows[1] == rows[2] != rows[3]


def test_held_out_rows(spark):
    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op8_attention_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    assert all(r.predicted == 1 for r in rows if r.quality == 1)
