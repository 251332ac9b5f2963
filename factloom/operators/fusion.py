"""Reciprocal rank fusion and the two ways of recalling facts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import prefix_overlap
from factloom.operators import entity, graph, lexical, semantic, temporal
from factloom.operators.entity import clamp
from factloom.operators.snapshot import Snapshot
from factloom.sources.folders import shared_folder

RRF_K = 60
IMPORTANCE_WEIGHT, CONFIDENCE_WEIGHT = 0.001, 0.0005


# What an arm is ranked by: two numbers, a time and a number, all rising, nulls last; then id.
_SLOTS = {"n0": "double", "n1": "double", "at": "bigint", "n2": "double"}
_ORDERS = {
    "lexical": ("-score", "null", "null", "null"),
    "entity": ("-weight", "-importance", "unix_micros(updated_at)", "null"),
    "graph": ("-importance", "null", "-unix_micros(updated_at)", "null"),
    "semantic": ("-similarity", "-importance", "null", "-confidence"),
    "temporal": ("null", "null", "-unix_micros(at)", "-importance"),
}


def ranked(arms: dict[str, DataFrame], folder: str) -> DataFrame:
    """id, arm and rank, from 1, of all facts of all arms. Their rows are put in order by range and written to ``folder``,
    then numbered: the driver sees a count for each range and arm."""
    rows = reduce(DataFrame.union, [df.select(F.lit(n).alias("arm"), "id", *[F.expr(f"cast({e} as {t})").alias(c) for (c, t), e in zip(_SLOTS.items(), _ORDERS[n])]) for n, df in arms.items()])
    order = [F.col("arm"), *[F.asc_nulls_last(c) for c in _SLOTS], F.col("id")]
    row = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select("arm", "id", F.shiftright(row, 33).alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")).write.parquet(folder)
    written = rows.sparkSession.read.schema("arm string, id string, part bigint, row bigint").parquet(folder)
    starts, before = [], dict.fromkeys(arms, 0)
    for r in written.groupBy("part", "arm").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((r["part"], r["arm"], before[r["arm"]] - r["first"] + 1))
        before[r["arm"]] += r["n"]
    known = rows.sparkSession.createDataFrame(starts, "part bigint, arm string, start bigint")
    return written.join(F.broadcast(known), ["part", "arm"]).select("id", "arm", (F.col("row") + F.col("start")).alias("rank"))


def fuse(memories: DataFrame, arms: dict[str, DataFrame], limit: int = 10, drop_graph_only: bool = False, k: int = RRF_K) -> DataFrame:
    """id, score and sources of the best facts over all arms (name -> id, rank).

    A fact scores the sum of 1/(k + rank) over its arms, in the order of ``arms`` so that sums are the
    same bit for bit, plus a little for importance and confidence. Ties by id.
    """
    rows = reduce(DataFrame.unionByName, [df.select("id", "rank", F.lit(n).alias("arm")) for n, df in arms.items()])
    return _fused(memories, rows, list(arms), limit, drop_graph_only, k)


def _fused(memories: DataFrame, rows: DataFrame, names: list[str], limit: int, drop_graph_only: bool, k: int = RRF_K) -> DataFrame:
    if k < 1:
        raise ValueError("k must be at least 1")
    by_id = rows.groupBy("id").agg(*[F.min(F.when(F.col("arm") == n, F.col("rank"))).alias(f"r_{n}") for n in names])
    parts = [F.coalesce(1.0 / (k + F.col(f"r_{n}")), F.lit(0.0)) for n in names]
    sources = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"r_{n}").isNotNull(), F.lit(n)) for n in names])))
    fused = by_id.select("id", reduce(lambda a, b: a + b, parts).alias("base"), sources.alias("sources"))
    if drop_graph_only:
        fused = fused.filter(F.col("sources") != F.array(F.lit("graph")))
    joined = memories.select("id", "importance", "confidence").join(fused, "id")
    score = F.col("base") + IMPORTANCE_WEIGHT * F.col("importance") + CONFIDENCE_WEIGHT * F.col("confidence")
    return joined.select("id", score.alias("score"), "sources").orderBy(F.desc("score"), "id").limit(clamp(limit, 100))


def best_of(memories: DataFrame, arms: dict[str, DataFrame], limit: int, drop_graph_only: bool = False) -> DataFrame:
    """The best facts over whole arms, 100 at most. They are found at once, since the ranks that are written for them go
    again."""
    spark = memories.sparkSession
    folder = f"{shared_folder(spark)}/ranks-{uuid4().hex}"
    try:
        found = _fused(memories, ranked(arms, folder), list(arms), limit, drop_graph_only)
        return spark.createDataFrame(found.collect(), found.schema)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@dataclass(frozen=True)
class Backend:
    """An embedding backend's name, and the query's vector (or the error that making it raised)."""

    provider: str
    model: str
    vector: list[float] | None = None
    error: str | None = None


def recall(store: Snapshot, query: str, limit: int = 10, lexical_limit: int | None = None, entity_limit: int | None = None, graph_limit: int | None = None, semantic_limit: int | None = None, backend: Backend | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """All arms, fused. An arm ranks all facts that it finds, unless a limit is given for it. A time window is an arm of
    its own, not a filter. A backend's error is raised."""
    arms = _text_arms(store, query, lexical.search(store, query, lexical_limit), entity_limit, graph_limit)
    if backend is not None:
        if backend.error or backend.vector is None:
            raise RuntimeError(backend.error or "no query vector")
        arms["semantic"] = semantic.top(store, backend.vector, backend.provider, backend.model, semantic_limit)
    if since is not None or until is not None:
        arms["temporal"] = temporal.window(store.memories, since, until, limit=None)
    return best_of(store.memories, arms, limit)


def _text_arms(store: Snapshot, query: str, lexical_hits: DataFrame, entity_limit: int | None = None, graph_limit: int | None = None) -> dict[str, DataFrame]:
    matched = entity.match(store.entities, query, limit=None)
    return {"lexical": lexical_hits, "entity": entity.arm(store, query, entity_limit, matched), "graph": graph.arm(store, query, graph_limit, matched=matched)}


@dataclass(frozen=True)
class ContextRecall:
    memories: DataFrame
    limit: int
    arms: dict[str, DataFrame] = field(default_factory=dict)
    semantic_error: str | None = None

    @cached_property
    def hits(self) -> DataFrame:
        """The best facts; those that only the graph found are dropped."""
        return best_of(self.memories, self.arms, self.limit, drop_graph_only=True)

    def arm_counts(self) -> DataFrame:
        """arm and count of all facts that it found, one row per arm."""
        return reduce(DataFrame.union, [df.agg(F.lit(n).alias("arm"), F.count(F.lit(1)).alias("count")).select("arm", "count") for n, df in self.arms.items()])


def recall_for_context(store: Snapshot, query: str, limit: int = 6, min_semantic: float = 0.35, backend: Backend | None = None) -> ContextRecall:
    """Precision first: lexical hits must share two query terms (or the only one), facts that only the
    graph found are dropped, similarity has a floor. A backend's error leaves its arm out and is named."""
    terms = lexical.query_keywords(query)
    lexical_hits = lexical.search(store, query, None)
    if terms:  # tested inside the facts' own rows, so that only ids are joined
        near = store.memories.filter((F.col("status") == "active") & (prefix_overlap(F.array(*map(F.lit, terms)), F.col("content")) >= min(2, len(terms))))
        lexical_hits = lexical_hits.join(near.select("id"), "id", "left_semi")
    arms = _text_arms(store, query, lexical_hits)
    error = None
    if backend is not None and (backend.error or backend.vector is None):
        error = backend.error or "no query vector"
    elif backend is not None:
        arms["semantic"] = semantic.top(store, backend.vector, backend.provider, backend.model, None, min_semantic)
    return ContextRecall(store.memories, limit, arms, error)
