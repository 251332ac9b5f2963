"""A Merkle manifest of a dataset: one tree a language, one over the languages, a proof for every row.

Leaves stand in order of doc_id. Their exact ranks come from histograms of the ids' digits (``ranks``), and
the digits of a rank in base ``FANOUT`` are the leaf's way down a trie: nodes that share all but the last
digit are one run and hash to their parent. Nodes are brought together by the prefix that all levels of one
pass share, so ``SPAN`` levels cost one shuffle, and no group holds more than ``FANOUT ** SPAN`` nodes.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.ranks import digits_of, radix_ranks
from factloom.llm.workspace import drop_table, write_table

FANOUT, BITS, SPAN = 8, 3, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<place int, others string>>"


def leaf_digest(**instead: Column) -> Column:
    """The digest of a row's fields, binary; ``instead`` gives other values for some of them."""
    values = [instead.get(f, F.col(f)).cast("string") for f in FIELDS]
    fields = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def _levels(rows: Column) -> Column:
    """How many times a row of so many nodes is cut to an eighth until one is left."""
    return F.size(F.filter(F.array(*[F.lit(FANOUT**k) for k in range(21)]), lambda x: x < rows))


def _climb(nodes: DataFrame) -> DataFrame:
    """The nodes ``SPAN`` levels up: group, at, digest, left (levels still above a node's)."""
    step = nodes.withColumn("top", F.shiftright("at", BITS * SPAN)).repartition("group", "top")
    for k in range(SPAN):
        runs = step.groupBy("group", "top", "left", F.shiftright("at", BITS).alias("up")).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("run"))
        joined = F.sha2(F.concat_ws("", F.transform("run", lambda x: F.lower(F.hex(x["digest"])))), 256)
        digest = F.when(F.col("left") > k, F.unhex(joined)).otherwise(F.col("run")[0]["digest"])
        step = runs.select("group", "top", "left", F.col("up").alias("at"), digest.alias("digest"))
    return step.select("group", "at", "digest", F.greatest(F.col("left") - SPAN, F.lit(0)).alias("left"))


def _hash(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def others(digests: list[str], left: int) -> list[list[str]]:
    """Of a pass's nodes, lowest level first: for each node of a level the joined digests of the rest of its run."""
    found = []
    for _ in range(min(SPAN, left)):
        runs = [digests[a : a + FANOUT] for a in range(0, len(digests), FANOUT)]
        found.append(["".join(run[:k] + run[k + 1 :]) for run in runs for k in range(len(run))])
        digests = [_hash("".join(run)) for run in runs]
    return found


def folded(own: str, path: list[tuple[int, str]]) -> str:
    """The root that a digest leads to along its proof."""
    for place, rest in path:
        own = _hash(rest[: 64 * place] + own + rest[64 * place :])
    return own


def _paths(k: int, levels: list[list[str]], above: list[tuple[int, str]]) -> list[tuple[int, str]]:
    return [((k >> (BITS * d)) & (FANOUT - 1), level[k >> (BITS * d)]) for d, level in enumerate(levels)] + above


def _sorted_chunk(nodes: pa.Table, tops: pa.Table) -> tuple[pa.Table, list[list[str]], list[tuple[int, str]]]:
    nodes = nodes.sort_by("at")
    levels = others([d.hex() for d in nodes["digest"].to_pylist()], nodes["left"][0].as_py())
    return nodes, levels, [(x["place"], x["others"]) for x in tops["path"][0].as_py()]


def _descend(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """group, at, path of every node, from the paths of the nodes ``SPAN`` levels up."""

    def paths(chunk: pa.Table, top: pa.Table) -> pa.Table:
        chunk, levels, above = _sorted_chunk(chunk, top)
        rows = [[{"place": p, "others": o} for p, o in _paths(k, levels, above)] for k in range(chunk.num_rows)]
        kind = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))
        return pa.table({"group": chunk["group"], "at": chunk["at"], "path": pa.array(rows, kind)})

    dealt = nodes.withColumn("top", F.shiftright("at", BITS * SPAN)).groupBy("group", "top")
    named = tops.select(F.col("group").alias("of"), F.col("at").alias("top"), "path")  # fresh names: both may come from one table
    return dealt.cogroup(named.groupBy("of", "top")).applyInArrow(paths, f"group string, at long, path {_PATH}")


class _Tree:
    """The levels of all groups' trees, ``SPAN`` at a time, each written to a table."""

    def __init__(self, nodes: DataFrame) -> None:
        """nodes: group, at (from 0 without gaps), digest; the lowest pass keeps further columns."""
        sizes = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("n")).select("group", _levels(F.col("n")).alias("left"))
        height = sizes.agg(F.max("left")).first()[0] or 0
        self.passes, self.paths = [nodes.join(sizes, "group")], []
        for _ in range(-(-height // SPAN)):
            self._keep(_climb(self.passes[-1]), "nodes", self.passes)

    def _keep(self, table: DataFrame, name: str, into: list) -> None:
        written, path = write_table(table, name)
        into.append(written)
        self.paths.append(path)

    def roots(self) -> DataFrame:
        return self.passes[-1].select("group", "digest")

    def tops(self, above: DataFrame) -> DataFrame:
        """The paths of the nodes that the lowest pass leads to; above: group, path of the roots."""
        found = above.select("group", F.lit(0).cast("long").alias("at"), "path")
        for nodes in self.passes[-2:0:-1]:
            kept: list = []
            self._keep(_descend(nodes, found), "paths", kept)
            found = kept[0]
        return found

    def drop(self, spark: SparkSession) -> None:
        for path in self.paths:
            drop_table(spark, path)


def manifest(docs: DataFrame, changed: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs``.

    docs: the columns of ``FIELDS``; others are ignored. changed: what stands in for the text when a row is
    checked against its proof; where it equals the text, the row must verify. Null values are marked, so they
    differ from empty ones; a null doc_id stands before all others, rows of one doc_id by their digests, equal
    rows one behind another. A null language has a tree of its own, before all others. A lone leaf is its own
    subroot, a lone subroot the root; a proof without siblings is the digest of nothing. No rows, no result.
    """
    spark = docs.sparkSession
    group = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    now = leaf_digest(text=changed)
    leaves, leaves_at = write_table(docs.select(group.alias("group"), "doc_id", leaf_digest().alias("digest"), F.when(changed.eqNullSafe(F.col("text")), None).otherwise(now).alias("now")), "leaves")
    ranked, ranked_at = write_table(radix_ranks(leaves, "group", F.concat(digits_of(F.col("doc_id")), F.hex("digest")), "at"), "ranked")
    drop_table(spark, leaves_at)

    trees = _Tree(ranked)
    subroots, subroots_at = write_table(trees.roots().select(F.lit("").alias("all"), F.col("group").alias("name"), "digest"), "subroots")
    named, named_at = write_table(radix_ranks(subroots, "all", F.hex("name"), "at").withColumnRenamed("all", "group"), "languages")
    over = _Tree(named)
    ends = over.roots().select("group", F.array().cast(_PATH).alias("path"))
    ways = _descend(over.passes[0], over.tops(ends)).join(over.roots().select("group", F.lower(F.hex("digest")).alias("root")), "group")
    above = named.select("group", "at", "name", F.lower(F.hex("digest")).alias("subroot")).join(ways, ["group", "at"])
    above, _ = write_table(above.select(F.col("name").alias("group"), "path", "subroot", "root"), "above")
    tops = trees.tops(above).join(above.select("group", "subroot", "root"), "group").withColumnsRenamed({"at": "top", "group": "of"})
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def proofs(chunk: pa.Table, top: pa.Table) -> pa.Table:
        chunk, levels, ways = _sorted_chunk(chunk, top)
        subroot, root, rest = top["subroot"][0].as_py(), top["root"][0].as_py(), "".join(o for _, o in ways)
        leaf, proof, reached = [d.hex() for d in chunk["digest"].to_pylist()], [], []
        for k, new in enumerate(chunk["now"].to_pylist()):
            path = _paths(k, levels, ways)
            proof.append(_hash("".join(o for _, o in path[: len(levels)]) + rest))
            reached.append(folded(leaf[k] if new is None else new.hex(), path))
        n = chunk.num_rows
        return pa.table(dict(zip(names, (chunk["doc_id"], leaf, [subroot] * n, [root] * n, proof, reached, [x == root for x in reached]))))

    for path in (leaves_at, subroots_at, named_at, *over.paths):
        drop_table(spark, path)
    dealt = trees.passes[0].withColumn("top", F.shiftright("at", BITS * SPAN)).groupBy("group", "top")
    return dealt.cogroup(tops.groupBy("of", "top")).applyInArrow(proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def lowered_in_a_third() -> Column:
    """The text of a row, its A-Z lower-cased where 3 divides the crc32 of the decimal doc_id."""
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(drawn, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all ``documents``, and what a third of them lower-cased leads to."""
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), lowered_in_a_third())


_FIELD = "coalesce(concat(strlen({0}), ':', {0}), '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(_FIELD.format(text if f == "text" else f"cast({f} as varchar)") for f in FIELDS) + "))"


_BIT = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
_BYTES = "list_concat([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint)))"
_CRC = f"xor(4294967295, list_reduce({_BYTES}, lambda r, b: list_reduce(list_concat([xor(r, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: {_BIT})))"

#: The query in DuckDB's SQL. Levels of languages have numbers below 100, those over them start there.
ORACLE = f"""with recursive docs as (select *, case when {_CRC} % 3 = 0 then translate(text, '{_UPPER}', '{_LOWER}') else text end as text2 from documents),
 leaves as (select doc_id, lang, {_sql_leaf("text")} as leaf, {_sql_leaf("text2")} as leaf2 from docs),
 placed as (select *, coalesce('1' || lang, '0') as grp, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from leaves),
 nodes as (select grp, 0 as lvl, pos, leaf as h, n from placed
  union all select grp, lvl + 1, pos // 8, sha256(string_agg(h, '' order by pos)), (n + 7) // 8 from nodes where n > 1 group by grp, lvl, pos // 8, n),
 subroots as (select grp, h, row_number() over (order by grp) - 1 as place, count(*) over () as n from nodes where n = 1),
 tops as (select 100 as lvl, place as pos, h, n from subroots union all select lvl + 1, pos // 8, sha256(string_agg(h, '' order by pos)), (n + 7) // 8 from tops where n > 1 group by lvl, pos // 8, n),
 every as (select grp, lvl, pos, h from nodes where n > 1 union all select '', lvl, pos, h from tops where n > 1),
 sides as (select a.grp, a.lvl, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as l, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as r
  from every a join every b on a.grp = b.grp and a.lvl = b.lvl and a.pos // 8 = b.pos // 8 group by a.grp, a.lvl, a.pos),
 steps as (select p.grp, p.pos, row_number() over (partition by p.grp, p.pos order by s.lvl) as step, s.l, s.r from placed p join subroots u using (grp)
  join sides s on (s.grp = p.grp and s.pos = p.pos // cast(power(8, s.lvl) as bigint)) or (s.grp = '' and s.pos = u.place // cast(power(8, s.lvl - 100) as bigint))),
 folds as (select grp, pos, 0 as step, leaf2 as own from placed union all select f.grp, f.pos, f.step + 1, sha256(s.l || f.own || s.r) from folds f join steps s on s.grp = f.grp and s.pos = f.pos and s.step = f.step + 1),
 proofs as (select grp, pos, string_agg(l || r, '' order by step) as proof from steps group by 1, 2), ends as (select grp, pos, arg_max(own, step) as own from folds group by 1, 2)
 select p.doc_id, p.leaf, u.h as subroot, t.h as root, sha256(coalesce(q.proof, '')) as proof_sha256, e.own as folded_root, e.own = t.h as verified
 from placed p join subroots u using (grp) join (select h from tops where n = 1) t on true left join proofs q using (grp, pos) join ends e using (grp, pos)"""
