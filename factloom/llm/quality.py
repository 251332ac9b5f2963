"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from its byte statistics by a learned layer,
gated attention weighs the passages, and the weighted representation is scored. Only documents are
labelled; the attention learns which passages tell. Every passage of every text is encoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.segments import chunks

# Kinds of bytes; the features of a passage are how often each kind follows each kind.
_KINDS = np.full(256, 18, np.uint8)  # bytes of characters beyond ASCII
for _kind, _members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t\x0b\x0c", b".", b",", b"!", b"?", b"#", b"$%", b"&", b"*", b"|", b"()[]{}<>", b"\"'`", b";:-_/\\=+~^@", bytes(range(9)) + bytes(range(14, 32)) + b"\x7f")):
    _KINDS[list(_members)] = _kind
_N = 19
FEATURES = _N * _N + 2


@dataclass(frozen=True)
class Settings:
    """sample, sample_chars: labelled documents that are fitted on, at most, and characters of them together;
    passage: bytes of one."""

    sample: int = 3000
    sample_chars: int = 30_000_000
    passage: int = 768
    hidden: int = 24
    gate: int = 12
    epochs: int = 16
    batch: int = 64
    rate: float = 3e-3
    decay: float = 1e-4
    seed: int = 7
    threshold: float = 0.7


def passage_features(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of all texts, and the number of passages of each text.

    A text is cut into passages of about ``size`` bytes; an empty one has a single passage of zeros.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(r) for r in raw], np.int64)
    counts = np.maximum(1, (lengths + size // 2) // size)
    joined = b"".join(raw)
    kinds = _KINDS[np.frombuffer(joined, np.uint8)].astype(np.int64)
    stops = np.cumsum(lengths)
    cuts = np.concatenate([[0], *(first + (np.arange(1, n + 1) * length) // n for first, n, length in zip((stops - lengths).tolist(), counts.tolist(), lengths.tolist()))]).astype(np.int64)
    total = int(counts.sum())
    own = np.repeat(np.arange(total), np.diff(cuts))
    x = np.zeros((total, FEATURES), np.float32)
    if len(kinds) > 1:
        inside = own[1:] == own[:-1]
        pairs = own[:-1] * (_N * _N) + kinds[:-1] * _N + kinds[1:]
        seen = np.bincount(pairs[inside], minlength=total * _N * _N).reshape(total, -1)
        x[:, : _N * _N] = np.sqrt(seen / np.maximum(seen.sum(1, keepdims=True), 1))
    for k in range(total):
        a, b = int(cuts[k]), int(cuts[k + 1])
        if b > a:
            x[k, -2] = len(zlib.compress(joined[a:b], 1)) / (b - a + 16)
            x[k, -1] = np.log1p(b - a) / 10
    return x, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """p = sigmoid(c . sum_k a_k h_k + c0), a = softmax_k(w . (tanh(V h_k) * sigmoid(U h_k))), h = tanh(W x + b)."""

    def __init__(self, settings: Settings, mean: np.ndarray, scale: np.ndarray) -> None:
        rng = np.random.default_rng(settings.seed)
        m, g = settings.hidden, settings.gate
        self.mean, self.scale = mean, scale
        self.p = {"W": rng.normal(0, FEATURES**-0.5, (FEATURES, m)), "b": np.zeros(m), "V": rng.normal(0, m**-0.5, (m, g)), "U": rng.normal(0, m**-0.5, (m, g)), "w": rng.normal(0, g**-0.5, g), "c": rng.normal(0, m**-0.5, m), "c0": np.zeros(1)}

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p = self.p
        starts = np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        x = x.astype(np.float32)
        h = np.tanh(((x - self.mean.astype(np.float32)) / self.scale.astype(np.float32)) @ p["W"].astype(np.float32) + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "starts": starts, "score": _sigmoid(z @ p["c"] + p["c0"])}

    def gradient(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict:
        p, f = self.p, self.forward(x, counts)
        ds = (f["score"] - y) / len(y)
        dz = (ds[:, None] * p["c"])[f["bag"]]
        da = (f["h"] * dz).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["starts"])[f["bag"]])
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        x = (f["x"] - self.mean.astype(np.float32)) / self.scale.astype(np.float32)
        return {"W": x.T @ dh.astype(np.float32), "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ ds, "c0": ds.sum(keepdims=True)}


def fit(bags: list[np.ndarray], labels: np.ndarray, settings: Settings) -> Model:
    """Fit by Adam on the bags' features; with no bags, the model scores everything alike."""
    if not bags:
        model = Model(settings, np.zeros(FEATURES), np.ones(FEATURES))
        model.p["c"][:] = 0
        return model
    flat = np.concatenate(bags)
    model = Model(settings, flat.mean(0), flat.std(0) + 0.02)
    rng = np.random.default_rng(settings.seed + 1)
    first, second, step = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    for epoch in range(settings.epochs):
        order = rng.permutation(len(bags))
        rate = settings.rate * (1 - epoch / settings.epochs)
        for at in range(0, len(order), settings.batch):
            some = order[at : at + settings.batch]
            x, counts = np.concatenate([bags[k] for k in some]), np.array([len(bags[k]) for k in some])
            step += 1
            for k, d in model.gradient(x, counts, labels[some]).items():
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                model.p[k] -= rate * ((first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + settings.decay * model.p[k])
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are for testing only: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on at most ``settings.sample`` labelled documents that are not held out, chosen by a hash of
    the id, whose texts together have at most ``settings.sample_chars`` characters: in the hash's order, what
    would exceed them is left out whole. Labels other than 0 and 1 and null ids are ignored; of an id's
    several labels the mean counts, and of its several texts the one whose features come first as bytes, so
    that the model depends on the rows alone.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    each = usable.groupBy("doc_id").agg(F.avg("quality").alias("y"))
    # At most `sample` rows of two numbers: small enough to send to every task.
    chosen = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sizes = named.groupBy("doc_id", "y").agg(F.sum(F.length("text")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # `sample` rows
    fitting, total = [], 0
    for r in sizes:
        if total + r["n"] <= settings.sample_chars:
            total += r["n"]
            fitting.append((r["doc_id"], r["y"]))
    few = docs.sparkSession.createDataFrame(fitting, "doc_id long, y double")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for k, text in enumerate(batch.column(1).to_pylist()):
                x, _ = passage_features([text], settings.passage)
                yield pa.RecordBatch.from_arrays([pa.array([names[k]], pa.int64()), batch.column(2).slice(k, 1), pa.array([x.tobytes()], pa.binary())], ["doc_id", "y", "x"])

    found = {}
    for row in rows.mapInArrow(encode, "doc_id long, y double, x binary").toLocalIterator():
        if row["doc_id"] not in found or row["x"] < found[row["doc_id"]][1]:
            found[row["doc_id"]] = row["y"], row["x"]
    ids = sorted(found)
    bags = [np.frombuffer(found[i][1], np.float32).reshape(-1, FEATURES) for i in ids]
    return fit(bags, np.array([found[i][0] for i in ids]), settings)


def score(docs: DataFrame, model: Model, settings: Settings = Settings(), out: str = "score") -> DataFrame:
    """``docs`` with the score, 0 to 1, of every whole text; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != out]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores = [np.zeros(0)]
            for a, b in chunks(texts, map(len, texts), 1_000_000):
                scores.append(shared.value.forward(*passage_features(texts[a:b], settings.passage))["score"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores), pa.float64())], [*batch.schema.names, out])

    rows = docs.select(*kept)
    return rows.mapInArrow(apply, rows.withColumn(out, F.lit(0.0)).schema)


def op8_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, as ``labels.quality`` marks it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    settings = Settings()
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), settings), settings)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))
