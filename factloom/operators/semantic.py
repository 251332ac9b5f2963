"""Exact cosine top-k, stale vectors, and near-equal pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.vectors import checked, dot, is_valid, norm, unit
from factloom.operators.entity import clamp
from factloom.operators.snapshot import Snapshot

BLOCK = 4096  # vectors of one side of a block of comparisons


def stored_vectors(store: Snapshot, provider: str, model: str, dimension: int, include_inactive: bool = False) -> DataFrame:
    """memory_id and unit vector of active facts, or of all; rows of another backend or size, or broken ones, are left out.

    Unit vectors are stored with the embeddings when these are written; only rows without one make it here.
    """
    own = store.memory_embeddings.filter((F.col("provider") == provider) & (F.col("model") == model) & (F.col("dimension") == dimension) & (F.size("vector") == dimension))
    stored = "unit" in own.columns
    own = own.filter((F.col("unit").isNotNull() if stored else F.lit(False)) | is_valid(F.col("vector")))
    made = unit(F.col("vector"))
    facts = store.memories if include_inactive else store.memories.filter("status = 'active'")
    return own.join(facts.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select("memory_id", (F.when(F.col("unit").isNotNull(), F.col("unit")).otherwise(made) if stored else made).alias("unit"))


def top(store: Snapshot, vector: list[float], provider: str, model: str, limit: int | None = 20, min_score: float = -1.0, include_inactive: bool = False) -> DataFrame:
    """id and similarity of the best active facts, or of facts of every status; all in no order without a limit. The cut at ``limit`` (1 to 200) prefers larger ids among
    equals; what is left is ordered by similarity, importance, confidence (falling) and id.

    Ids and scores alone go through the top-k; the facts' columns are joined to its few rows.
    """
    query = checked(vector)
    literal = unit(F.array(*map(F.lit, query)))
    scored = stored_vectors(store, provider, model, len(query), include_inactive).select(F.col("memory_id").alias("id"), dot(F.col("unit"), literal).alias("similarity"))
    if limit is None:
        return store.memories.join(scored.filter(F.col("similarity") >= min_score), "id").select("id", "similarity", "importance", "confidence")
    best = scored.orderBy(F.desc("similarity"), F.desc("id")).limit(clamp(limit, 200)).filter(F.col("similarity") >= min_score)
    found = store.memories.join(F.broadcast(best), "id")  # at most 200 rows
    return found.select("id", "similarity", "importance", "confidence").orderBy(F.desc("similarity"), F.desc("importance"), F.desc("confidence"), "id")


def top_many(store: Snapshot, vectors: dict[int, list[float]], provider: str, model: str, limit: int) -> DataFrame:
    """q, id and similarity: of each query (number -> vector, all of one dimension) the best ``limit`` active facts,
    by similarity and then by larger id. One pass over the vectors: each batch is multiplied with all queries
    and gives its best rows only."""
    names, asked = list(vectors), np.array([checked(v) for v in vectors.values()], np.float64)
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    dimension = asked.shape[1]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.array(batch.column(0).to_pylist(), object)
            order = np.argsort(ids)[::-1]
            ids = ids[order]
            found = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, dimension)[order] @ asked.T
            few = np.argsort(-found, axis=0, kind="stable")[:limit]
            columns = [np.repeat([names], len(few), 0).ravel(), ids[few].ravel(), np.take_along_axis(found, few, 0).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64()))], ["q", "id", "similarity"])

    rows = stored_vectors(store, provider, model, dimension).mapInArrow(best, "q long, id string, similarity double")
    place = Window.partitionBy("q").orderBy(F.desc("similarity"), F.desc("id"))
    return rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit).drop("place")


def similar_pairs(store: Snapshot, probes: DataFrame, provider: str, model: str, dimension: int, threshold: float) -> DataFrame:
    """probe_id, memory_id, similarity: for each probe (memory_id) the other active facts at ``threshold`` or above.

    The probes are a stated set against all rows. Both sides are dealt into a grid of blocks of about ``BLOCK``
    vectors, and a cell is one matrix product in a task, from which only the pairs at the threshold come out.
    """
    units = stored_vectors(store, provider, model, dimension)
    asked = units.join(probes.select("memory_id").distinct(), "memory_id", "left_semi")
    rows, cols = (max(1, -(-df.count() // BLOCK)) for df in (asked, units))
    left = asked.withColumn("row", F.pmod(F.xxhash64("memory_id"), F.lit(rows).cast("bigint"))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    right = units.withColumn("col", F.pmod(F.xxhash64("memory_id"), F.lit(cols)).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rows - 1).cast("bigint"))))
    cells = left.select("row", "col", "memory_id", "unit", F.lit(True).alias("probe")).union(right.select("row", "col", "memory_id", "unit", F.lit(False)))

    def compare(table: pa.Table) -> pa.Table:
        names, probe = np.array(table.column("memory_id").to_pylist(), object), table.column("probe").to_numpy()
        flat = table.column("unit").combine_chunks()
        vectors = flat.flatten().to_numpy().astype(np.float64).reshape(-1, dimension)
        found = vectors[probe] @ vectors[~probe].T
        i, j = np.nonzero(found >= threshold)
        a, b = names[probe][i], names[~probe][j]
        other = a != b
        return pa.table({"probe_id": pa.array(a[other], pa.string()), "memory_id": pa.array(b[other], pa.string()), "similarity": pa.array(found[i, j][other])})

    return cells.groupBy("row", "col").applyInArrow(compare, "probe_id string, memory_id string, similarity double")


def _grid(asked: DataFrame, units: DataFrame) -> DataFrame:
    """Both sides (name, unit) dealt into cells of about ``BLOCK`` by ``BLOCK`` vectors; asked: whether a row asks."""
    rows, cols = (max(1, -(-df.count() // BLOCK)) for df in (asked, units))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("name"), F.lit(n)).cast("int")
    left = asked.select(F.lit(True).alias("asks"), "name", "unit", place(rows).alias("row"), spread(cols).alias("col"))
    right = units.select(F.lit(False).alias("asks"), "name", "unit", spread(rows).alias("row"), place(cols).alias("col"))
    return left.union(right.select(*left.columns))


def _sides(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    names, asks = np.array(cell["name"].to_pylist(), object), cell["asks"].to_numpy()
    vectors = np.array(cell["unit"].to_pylist(), np.float64).reshape(len(names), -1)
    return names[asks], names[~asks], vectors[asks], vectors[~asks]


def best_for(store: Snapshot, asked: DataFrame, provider: str, model: str, dimension: int, limit: int) -> DataFrame:
    """name, id, similarity: for each row of ``asked`` (name, unit) the best ``limit`` active facts, as for
    :func:`top_many`. A cell gives its best rows for each name, so what leaves the cells grows with both sides' blocks,
    not with their product."""

    def best(cell: pa.Table) -> pa.Table:
        names, others, a, b = _sides(cell)
        order = np.argsort(others)[::-1]
        found = a @ b[order].T if len(a) and len(b) else np.zeros((0, 0))
        few = np.argsort(-found, axis=1, kind="stable")[:, :limit]
        rows = np.repeat(np.arange(len(few)), few.shape[1] if len(few) else 0)
        return pa.table({"name": pa.array(names[rows], pa.string()), "id": pa.array(others[order][few.ravel()], pa.string()), "similarity": pa.array(np.take_along_axis(found, few, 1).ravel() if len(few) else [], pa.float64())})

    units = stored_vectors(store, provider, model, dimension).withColumnRenamed("memory_id", "name")
    rows = _grid(asked, units).groupBy("row", "col").applyInArrow(best, "name string, id string, similarity double")
    place = Window.partitionBy("name").orderBy(F.desc("similarity"), F.desc("id"))
    return rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit).drop("place")


def near_groups(asked: DataFrame, threshold: float) -> DataFrame:
    """name, link: rows of ``asked`` (name, unit) at ``threshold`` or above share links, directly or through others.

    A cell of the grid connects its own rows and names each group by one of them: a row a name and cell, however
    many are alike.
    """

    def groups(cell: pa.Table) -> pa.Table:
        names, others, a, b = _sides(cell)
        alike = a @ b.T >= threshold if len(a) and len(b) else np.zeros((len(a), len(b)), bool)
        alike &= names[:, None] != others[None, :] if alike.size else True
        rows, cols = np.flatnonzero(alike.any(1)), np.flatnonzero(alike.any(0))
        alike = alike[np.ix_(rows, cols)]
        label, before = np.arange(len(cols)), None
        while len(rows) and (before is None or (label != before).any()):
            before = label
            own = np.where(alike, label[None, :], len(cols)).min(1)
            label = np.where(alike, own[:, None], len(cols)).min(0)
        found = [(names[r], others[cols[k]]) for r, k in zip(rows, own)] + [(others[c], others[cols[k]]) for c, k in zip(cols, label)] if len(rows) else []
        return pa.table({"name": pa.array([x for x, _ in found], pa.string()), "link": pa.array([x for _, x in found], pa.string())})

    return _grid(asked, asked).groupBy("row", "col").applyInArrow(groups, "name string, link string").distinct()


def stale(store: Snapshot, provider: str, model: str, force: bool = False, limit: int = 500) -> DataFrame:
    """id of active facts without a vector of this backend, the oldest first; all with ``force``."""
    active = store.memories.filter("status = 'active'").select("id", "content", "created_at")
    if not force:
        own = store.memory_embeddings.filter((F.col("provider") == provider) & (F.col("model") == model)).select(F.col("memory_id").alias("id"))
        active = active.join(own, "id", "left_anti")
    return active.orderBy("created_at", "id").limit(clamp(limit, 5000))


def delete(embeddings: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the vectors of the facts named by memory_id."""
    return embeddings.join(gone.select("memory_id"), "memory_id", "left_anti").select(*embeddings.columns)


def upsert(embeddings: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows (by memory_id, the last by ``seq``) replace those that are there. Vectors that are
    invalid raise no error here; they are left out."""
    valid = incoming.filter(is_valid(F.col("vector")))
    keys = [c for c in embeddings.columns if c != "memory_id"]
    latest = valid.groupBy("memory_id").agg(F.max_by(F.struct(*[c for c in incoming.columns if c not in ("memory_id", "seq")]), "seq").alias("r")).select("memory_id", "r.*")
    latest = latest.withColumn("dimension", F.size("vector")).withColumn("norm", norm(F.col("vector"))).withColumn("unit", unit(F.col("vector")))
    for c in keys:
        if c not in latest.columns:
            latest = latest.withColumn(c, F.lit(None).cast(embeddings.schema[c].dataType))
    return embeddings.join(latest.select("memory_id"), "memory_id", "left_anti").select("memory_id", *keys).union(latest.select("memory_id", *keys))
