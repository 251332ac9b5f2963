"""Sharding by a hierarchical weighted hash tree.

A row goes down from the root: at each level every child draws ln(u)/weight from a hash of the row's
key and the child's own name, and the largest draw wins. A child's chance is its share of the weight,
and no draw depends on another child; so a changed weight moves rows only into or out of the subtree
that holds it. A shard that is added comes as a new branch at the top, which rows enter and which
changes no draw of the others: one more shard takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.ranks import digits_of, radix_ranks
from factloom.llm.workspace import write_table


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(shards: int, regions: int = 3, racks: int = 2, founded: int = 24) -> list[Leaf]:
    """The tree of a number of shards: the first ``founded`` of them (or all, if there are fewer) dealt evenly
    to ``regions`` of ``racks`` each, in runs, and every later one added as :func:`grown` does. So from
    ``founded`` on the tree of one more shard takes rows only into that shard.
    """
    first = min(shards, founded)
    racks_all = [(r, k) for r in range(regions) for k in range(racks)]
    leaves = [Leaf(f"region{r}", f"rack{k}", s) for s in range(first) for r, k in [racks_all[s * len(racks_all) // first]]]
    while len(leaves) < shards:
        leaves = grown(leaves)
    return leaves


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region and rack of its own."""
    shard = max((x.shard for x in leaves), default=-1) + 1
    return [*leaves, Leaf(f"added{shard}", "rack0", shard, weight)]


def _draw(key: Column, path: str, weight: float) -> Column:
    """ln(u)/weight with u in (0, 1] from 53 bits of the hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11) + F.lit(1).cast("long")
    return F.log(bits.cast("double") / F.lit(float(1 << 53))) / F.lit(weight)


def place(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a row: the winning region, then the winning rack in it, then the winning shard.

    Only the children of the branch a row is in draw for it. A null key hashes as the string "null";
    leaves of weight 0 or less take no rows.
    """
    own = F.coalesce(key.cast("string"), F.lit("null"))

    def descend(path: tuple[str, ...], inside: list[Leaf]) -> Column:
        if len(path) == 3:
            return F.lit(inside[0].shard)
        children: dict[str, list[Leaf]] = {}
        for x in inside:
            children.setdefault((x.region, x.rack, str(x.shard))[len(path)], []).append(x)
        draws = [F.struct(_draw(own, "/".join((*path, name)), sum(x.weight for x in below)).alias("draw"), F.lit(name).alias("name")) for name, below in children.items()]

        def chosen(name: Column) -> Column:
            branch = None
            for child, below in children.items():
                deeper = descend((*path, child), below)
                branch = F.when(name == child, deeper) if branch is None else branch.when(name == child, deeper)
            return branch

        # A transform of one element, so that the winner is computed once and then named.
        return F.transform(F.array(F.array_max(F.array(*draws))["name"]), chosen)[0]

    return descend((), [x for x in leaves if x.weight > 0])


def shard_documents(docs: DataFrame, leaves: list[Leaf], more: list[Leaf] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard, slot of every row of ``docs`` (doc_id, text; others are ignored).

    more: the tree of ``grown_shard``, by default with one shard added. A null text has no bytes. Repeated
    rows share a shard and get slots of their own; an empty table gives no rows. Texts are read once and
    never shuffled: their sizes and places are written. A slot is the row's rank in its shard by doc_id and text_crc32,
    from histograms of digits, so the rows alone decide it and neither a null nor a repeated doc_id gathers in one task.
    """
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sized.withColumn("shard", place(F.col("doc_id"), leaves)).withColumn("grown_shard", place(F.col("doc_id"), more or grown(leaves)))
    digits = F.concat(digits_of(F.col("doc_id")), F.lpad(F.hex("text_crc32"), 8, "0"), digits_of(F.col("size")))
    return radix_ranks(write_table(placed, "placed")[0], "shard", digits, "slot")


def op2_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 23 by the ``key`` law."""
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tree(24), tree(25))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
