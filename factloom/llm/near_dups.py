"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``side`` short bands each (``rows`` minhashes a band) are computed. A table key joins
one band of the first with one of the second, so ``side`` squared tables cost 2 x ``side`` x ``rows``
minhashes instead of ``side`` squared x 2 x ``rows``. A pair of Jaccard similarity s shares no key with
probability at most 2 (1 - s**rows)**side: below 1e-5 at s = 0.8 with the defaults. Every pair that does
share a key is tested, unless it joins documents of a large key that are already connected. Links are confirmed on whole sets of
shingles made of words; hashes only rule pairs out.

1. Documents with equal sequences of words form one class; all further work is on classes.
2. Bands that no other class has are dropped before keys are formed; keys of one class are dropped.
3. Keys of few classes give all their pairs. Of keys with more, each class meets two pivots, so a group of
   n near copies costs O(n) pairs. A parity bitmap of each set bounds the overlap from above and rules
   pairs out; what it lets pass is confirmed on texts.
4. A large key that still holds several components is compared completely, inside tasks. All large keys of
   one first band are one group. Each class outside the group's main component meets every class of the
   group, in a grid of cells of bounded size, and a cell gives at most one link per class. Pairs inside the
   main component need no test.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.components import components, rough_components
from factloom.llm.segments import chunks
from factloom.llm.words import mix, shingle_hashes, word_bytes, word_hashes
from factloom.llm.workspace import drop_table, write_table


@dataclass(frozen=True)
class Tensor:
    side: int = 12
    rows: int = 2
    seed: int = 20240101

    def constants(self) -> tuple[np.ndarray, np.ndarray]:
        """A multiplier and an addend of each minhash."""
        drawn = mix(np.arange(1, 1 + 4 * self.side * self.rows, dtype=np.uint64) + np.uint64(self.seed))
        return drawn[::2] | np.uint64(1), drawn[1::2]


@dataclass(frozen=True)
class Cells:
    """few: most members of a key that gives all its pairs. members, shingles: of one side of a cell."""

    few: int = 6
    members: int = 4096
    shingles: int = 2_000_000


def parity_bitmap(shingles: np.ndarray) -> bytes:
    """Bit i is the parity of the number of shingles that fall on i; about two bits a shingle, a power of two."""
    bits = max(256, 1 << int(2 * len(shingles) - 1).bit_length()) if len(shingles) else 256
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def overlap_bound(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> int:
    """At least the size of the intersection: shingles in one set only are at least the differing bits."""
    x, y = np.frombuffer(bits_a, np.uint64), np.frombuffer(bits_b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)
    return min(n_a, n_b, (n_a + n_b - int(np.bitwise_count(x ^ y).sum())) // 2)


def signatures(docs: DataFrame, size: int, tensor: Tensor) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (of the words in a row), bands (2 x side hashes), bits, of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, addends = tensor.constants()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in chunks(texts, map(len, texts), 1_000_000):
                words, counts = word_hashes(texts[a:b])
                hashes, sizes = shingle_hashes(words, counts, size)
                some = np.flatnonzero(sizes > 0)
                stops = np.cumsum(sizes)
                starts = stops - sizes
                low = np.zeros((len(sizes), len(factors)), np.uint64)
                for k in range(len(factors) if len(some) else 0):
                    low[some, k] = np.minimum.reduceat(hashes * factors[k] + addends[k], starts[some])
                bands = np.zeros((len(sizes), 2 * tensor.side), np.uint64)
                for r in range(tensor.rows):
                    bands = mix(bands * np.uint64(7) + low[:, r :: tensor.rows])
                n, bits = [], []
                for first, stop in zip(starts.tolist(), stops.tolist()):
                    own = np.unique(hashes[first:stop])
                    n.append(len(own))
                    bits.append(parity_bitmap(own))
                digests = [blake2b(b" ".join(word_bytes(t)), digest_size=16).digest() for t in texts[a:b]]
                flat = pa.array(bands.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2 * tensor.side), pa.int32()), flat)
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), lists, pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "digest", "bands", "bits"])

    rows = docs.select("doc_id", text_hash().alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, digest binary, bands array<bigint>, bits binary")


def text_hash():
    """What tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _may_link(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            keep = []
            for n_a, bits_a, n_b, bits_b in zip(x["n_a"], x["bits_a"], x["n_b"], x["bits_b"]):
                over = min(n_a, n_b)
                fits = 100 * over >= percent * (n_a + n_b - over)
                if fits:
                    over = overlap_bound(n_a, bits_a, n_b, bits_b)
                    fits = 100 * over >= percent * (n_a + n_b - over)
                keep.append(fits)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return check


def shingle_set(text: str, size: int) -> frozenset[bytes]:
    words = word_bytes(text)
    return frozenset(b" ".join(words[k : k + size]) for k in range(max(len(words) - size + 1, 1))) if words else frozenset()


def alike(a: frozenset, b: frozenset, percent: int) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _do_link(percent: int, size: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(64)(lambda text: shingle_set(text, size))
        for batch in batches:
            keep = [alike(known(a), known(b), percent) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return check


def _compare_cell(percent: int, size: int):
    """Links between the visitors and the members of one cell (node, component, visitor, main, text)."""

    def compare(table: pa.Table) -> pa.Table:
        node, component, visitor, main = (table.column(c).to_numpy().copy() for c in ("node", "component", "visitor", "main"))
        texts = table.column("text").to_pylist()
        found = []
        for a, b in chunks(texts, map(len, texts), 1_000_000):
            hashes, sizes = shingle_hashes(*word_hashes(texts[a:b]), size)
            ends = np.cumsum(sizes)
            found += [np.unique(hashes[stop - n : stop]) for stop, n in zip(ends.tolist(), sizes.tolist())]
        n = np.array([len(x) for x in found])
        values, ids, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        mark = np.zeros(len(values), np.int32)
        first = np.cumsum(n) - n
        members = np.flatnonzero(~visitor)
        held = np.concatenate([ids[first[k] : first[k] + n[k]] for k in members]) if len(members) else ids[:0]
        heads = np.cumsum(n[members]) - n[members]
        known = lru_cache(256)(lambda k: shingle_set(texts[k], size))
        links = []
        for u in np.flatnonzero(visitor).tolist():
            least, most = np.minimum(n[members], n[u]), np.maximum(n[members], n[u])
            # Two classes outside the main component visit each other; the smaller node's visit counts.
            fits = (component[members] != component[u]) & (100 * least >= percent * most) & ((component[members] == main[members]) | (node[members] > node[u]))
            if not fits.any():
                continue
            own = ids[first[u] : first[u] + n[u]]
            mark[own] = 1
            both = np.add.reduceat(mark[held], heads)
            mark[own] = 0
            near = members[fits & (100 * both >= percent * (n[members] + n[u] - both))]
            for c in np.unique(component[near]).tolist():
                for k in near[component[near] == c].tolist():
                    if alike(known(u), known(k), percent):
                        links.append((min(node[u], node[k]), max(node[u], node[k])))
                        # The main component keeps its name, by which its members are known.
                        keep, gone = (component[k], component[u]) if component[k] == main[k] else (component[u], component[k])
                        component[component == gone] = keep
                        break
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return compare


def shared_keys(classes: DataFrame, tensor: Tensor) -> DataFrame:
    """``key, home (its first band), node, n, pivot, other`` of every table key that more than one class has.

    pivot: of the key's classes the one that holds most keys; other: one drawn by hash.
    """
    bands = classes.select("node", F.posexplode("bands").alias("band", "value"))
    common = bands.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    live = bands.join(common, ["band", "value"], "left_semi").groupBy("node").agg(F.collect_list(F.struct("band", "value")).alias("bands"))
    first, second = F.filter("bands", lambda x: x["band"] < tensor.side), F.filter("bands", lambda x: x["band"] >= tensor.side)
    keys = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.struct(F.xxhash64(a["band"], a["value"], b["band"], b["value"]).alias("key"), F.xxhash64(a["band"], a["value"]).alias("home")))))
    keyed = live.select("node", (-F.size(first) * F.size(second)).alias("__w"), F.explode(keys).alias("k")).select("node", "__w", "k.key", "k.home")
    pivot, other = F.min(F.struct("__w", "node"))["node"], F.min(F.struct(F.xxhash64("node"), F.col("node").alias("node")))["node"]
    held = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), pivot.alias("pivot"), other.alias("other")).filter("n > 1")
    return keyed.drop("__w").join(held, "key")


def grouped(docs: DataFrame, size: int = 5, percent: int = 80, tensor: Tensor = Tensor(), cells: Cells = Cells()) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, chosen for every row of ``docs``; see :func:`near_duplicates`.

    chosen: whether the row's doc_id and text are the one pair that stands for its component.
    """
    spark = docs.sparkSession
    written: list[str] = []

    def write(df: DataFrame, name: str, fewer: int = 8) -> DataFrame:
        table, at = write_table(df, name, fewer=fewer)
        written.append(at)
        return table

    signed = write_table(signatures(docs, size, tensor), "signatures")[0]
    real = signed.filter("n_shingles > 0 and doc_id is not null")
    own = real.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("own"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "bits")])
    # Ids are drawn once, as the table is written.
    classes = write_table(own.select(F.monotonically_increasing_id().alias("node"), "digest", "own", "n_shingles", "bands", "bits"), "classes", fewer=4)[0]
    keyed = write(shared_keys(classes, tensor), "keys", fewer=1)
    some = keyed.select("node").distinct().join(classes.select("node", "own.*"), "node")
    texts = docs.select("doc_id", text_hash().alias("text_hash"), "text").join(some, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash", "node"])
    texts = write(texts.select("node", "text"), "texts", fewer=1)
    sets = classes.select("node", "n_shingles", "bits")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(c).alias(name if c == "node" else f"{c[0] if c == 'n_shingles' else c}_{name}") for c in df.columns])

    def confirmed(pairs: DataFrame) -> DataFrame:
        full = pairs.join(side(texts, "a"), "a").join(side(texts, "b"), "b").select("a", "b", "text_a", "text_b")
        return full.mapInArrow(_do_link(percent, size), "a long, b long")

    few = keyed.filter(F.col("n") <= cells.few).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("m"))
    pairs = few.select(F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, cells.few), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")
    large = keyed.filter(F.col("n") > cells.few)
    met = large.groupBy("node").agg(F.min("pivot").alias("pivot"), F.min("other").alias("other")).select("node", F.explode(F.array("pivot", "other")).alias("to"))
    met = met.filter("node <> to").select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b"))
    wide = pairs.union(met).distinct().join(side(sets, "a"), "a").join(side(sets, "b"), "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    likely = write(wide.mapInArrow(_may_link(percent), "a long, b long"), "likely", fewer=4)
    links = write(confirmed(likely), "links", fewer=1)
    labels = write(rough_components(links), "labels")  # enough to leave out most of the grid

    def labelled(df: DataFrame, at: str, name: str) -> DataFrame:
        return df.join(labels.select(F.col("id").alias(at), F.col("component").alias(name)), at, "left").withColumn(name, F.coalesce(name, at))

    # The groups of large keys that hold more than one component, and each group's main component.
    members = labelled(large.select("home", "node").distinct().join(classes.select("node", "n_shingles"), "node"), "node", "component")
    held = members.groupBy("home", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    held = held.groupBy("home").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "w", "component")).alias("main"), *[F.sum(c).alias(c) for c in ("n", "w")], *[F.bit_xor(c).alias(c) for c in ("x", "y")]).filter("parts > 1")
    # Groups of the same classes are one.
    held = held.groupBy("n", "x", "y").agg(F.min(F.struct("home", "main", "w")).alias("g")).select("n", "g.*")

    def blocks(n, w):
        return F.ceil(F.greatest(n / cells.members, w / cells.shingles)).cast("long")

    held = held.select("home", F.col("main.component").alias("main"), blocks(F.col("n"), F.col("w")).alias("rows"), blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("cols"))
    dealt = members.join(held, "home")
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    row, col = F.pmod(F.xxhash64("node"), F.col("rows")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("cols"))
    stay = dealt.withColumn("row", row).withColumn("col", every("cols")).withColumn("visitor", F.lit(False))
    go = dealt.filter("component <> main").withColumn("col", col).withColumn("row", every("rows")).withColumn("visitor", F.lit(True))
    grid = stay.unionByName(go).select("home", "row", "col", "node", "component", "main", "visitor").join(texts, "node")
    every_link = links.union(write(grid.groupBy("home", "row", "col").applyInArrow(_compare_cell(percent, size), "a long, b long"), "links", fewer=1))
    labels = components(every_link)
    named = labelled(classes.select("node", "digest", "own"), "node", "component")
    heads = named.groupBy("component").agg(F.min("own").alias("head"))
    out = signed.select("doc_id", "text_hash", "n_shingles", "digest").join(named.join(heads, "component").select("digest", "head"), "digest", "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = out.select(
        "doc_id", "text_hash", "n_shingles", F.when(linked, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        (~linked | ((F.col("doc_id") == F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash")))).alias("chosen"),
    )
    for path in written:
        drop_table(spark, path)
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, tensor: Tensor = Tensor(), cells: Cells = Cells()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; others are ignored).

    Links hold where 100 x intersection >= ``percent`` x union of the sets of ``size``-word shingles. A
    text of fewer words counts as one shingle; a null, empty or blank text has none and links with
    nothing. A null doc_id links with nothing and has a null component. Rows that repeat a doc_id are
    documents of their own: each has the smallest doc_id that its own text reaches.
    """
    named = grouped(docs, size, percent, tensor, cells)
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, tensor: Tensor = Tensor(), cells: Cells = Cells()) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: of its smallest doc_id, and there of the smallest text hash.

    Rows without a doc_id or without words have no copies and stay. Of rows that repeat a doc_id and a text one
    stays, by the order of the other columns; rows of one doc_id and unrelated texts both stay.
    """
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    columns = docs.columns
    chosen = grouped(docs.filter(~alone), size, percent, tensor, cells).filter("chosen").select("doc_id", F.col("text_hash").alias("__hash")).distinct()
    rows = docs.filter(~alone).withColumn("__hash", text_hash()).join(chosen, ["doc_id", "__hash"], "left_semi")
    rest = [F.col(c) for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and kind != "variant"]
    first = Window.partitionBy("doc_id", "__hash").orderBy(*(rest or [F.lit(0)]))  # as the join has dealt and sorted them
    return rows.withColumn("__row", F.row_number().over(first)).filter("__row = 1").select(*columns).union(docs.filter(alone))


def op4_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all ``documents``: 4-word shingles, similarity of at least 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4)
