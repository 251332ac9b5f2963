"""Exact ranks inside groups without a global sort: histograms of digits, coarse to fine.

Keys are strings of digits whose byte order is the wanted order. Rows are counted by their first digits; where
a prefix holds too many rows more digits are counted, of these rows alone. A prefix starts where the ones
before it end, summed level by level inside the next coarser prefix, and rows are numbered inside their own
prefix. No window or task ever holds more than one prefix's rows or one coarser prefix's children.
"""

from __future__ import annotations

import math
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.workspace import write_table

#: Hex digits by which one level is finer than the one above it: at most 4096 children.
STEP = 3


def digits_of(number: Column) -> Column:
    """A long as digits in its own order; null stands first."""
    biased = number.cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(number.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.lpad(F.hex(biased), 16, "0")))


def _starts(sizes: DataFrame, group: str, cuts: list[int]) -> DataFrame:
    """group, __prefix, __base: the rows of a group before each prefix."""
    if not cuts:
        before = Window.partitionBy(group).orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
        return sizes.select(group, "__prefix", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = sizes.withColumn("__parent", F.substring("__prefix", 1, cuts[-1]))
    parents = inside.groupBy(group, F.col("__parent").alias("__prefix")).agg(F.sum("__n").alias("__n"))
    above = _starts(parents, group, cuts[:-1]).withColumnsRenamed({"__prefix": "__parent", "__base": "__above"})
    before = Window.partitionBy(group, "__parent").orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    own = inside.withColumn("__own", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return own.join(above, [group, "__parent"]).select(group, "__prefix", (F.col("__above") + F.col("__own")).alias("__base"))


def radix_ranks(table: DataFrame, group: str, digits: Column, out: str, usual: int = 256, most: int = 4096) -> DataFrame:
    """``table``, as written to files, with ``out``: each row's place in its ``group`` (never null), from 0.

    Rows of equal digits are numbered by their places in the files, so even one key in a third of all rows is
    dealt out; which of them comes first is then open, their set of ranks isn't. usual: rows of a prefix that
    the first level aims at if keys are spread evenly; most: rows above which a prefix is refined.
    """
    stands = F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    # "!" sorts before every digit, so a key that continues another one comes after it.
    keyed = table.withColumn("__key", F.concat(digits, F.lit("!"), F.lpad(F.hex(F.shiftrightunsigned(stands, 40)), 6, "0")))
    seen = keyed.agg(F.count(F.lit(1)).alias("n"), F.min("__key").alias("low"), F.max("__key").alias("high"), F.max(F.length("__key")).alias("longest")).first()
    if not seen.n:
        return table.withColumn(out, F.lit(0).cast("long"))
    shared = min(len(commonprefix([seen.low, seen.high])), seen.longest - 1)
    depth = min(shared + max(1, math.ceil(math.log(max(seen.n / usual, 1), 16))), seen.longest)
    depths = [*range(depth - STEP, shared, -STEP)][::-1] + [depth]
    keyed = keyed.withColumn("__prefix", F.substring("__key", 1, depth))
    open_rows, light = keyed, None
    for turn in range(8):
        sizes, _ = write_table(open_rows.groupBy(group, "__prefix").agg(F.count(F.lit(1)).alias("__n")), "digits")
        last = depth >= seen.longest
        done = sizes if last else sizes.filter(F.col("__n") <= most)
        light = done if light is None else light.unionByName(done)
        if last or not (heavy := sizes.filter(F.col("__n") > most)).head(1):
            break
        # Six levels of three digits each, then all but a bit of the rest: what is left then are equal rows.
        deeper = depth + STEP if turn < 6 and depth + STEP < seen.longest - STEP else seen.longest - STEP if depth < seen.longest - STEP else seen.longest
        marked = keyed.join(heavy.select(group, "__prefix", F.lit(True).alias("__heavy")), [group, "__prefix"], "left")
        finer = F.when(F.col("__heavy"), F.substring("__key", 1, deeper)).otherwise(F.col("__prefix"))
        keyed = marked.withColumn("__prefix", finer)
        open_rows = keyed.filter("__heavy").drop("__heavy")
        keyed = keyed.drop("__heavy")
        depth = deeper
        depths.append(depth)
    inside = Window.partitionBy(group, "__prefix").orderBy("__key")
    ranked = keyed.join(_starts(light, group, depths[:-1]), [group, "__prefix"]).withColumn(out, F.col("__base") + F.row_number().over(inside) - 1)
    return ranked.select(*table.columns, out)
