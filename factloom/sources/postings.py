"""Postings of the lexical index in immutable segments, with a log of the facts that are gone.

A commit adds one segment, of the facts whose text is new, and one part of the log, of those that are gone or had
another text. What an entry of the log says holds for segments of earlier versions only, so a fact may come back.
Segments of about one size are merged as soon as there are :data:`FAN` of them, and all are once more tokens are gone
than left; so a posting is copied a logarithmic number of times, and a commit of k facts writes in proportion to k.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import lexical
from factloom.operators.snapshot import DERIVED, Snapshot

FAN = 4  # parts of one size are merged when there are as many
LEAST = 10_000  # rows; smaller parts count as of one size
POSTINGS_A_FILE, FACTS_A_FILE = 1_000_000, 5_000  # about
LOG = "id string, upto bigint"

Write = Callable[[str, DataFrame], tuple[DataFrame, str]]  # under a name; gives the table read back and its path


def parts_of(manifest: dict) -> tuple[list[dict], list[dict]]:
    """Segments and log of a version, each part with path, born (the version that made it), rows and tokens."""
    if "segments" in manifest:
        return manifest["segments"], manifest["gone"]
    whole = manifest["tables"].get("postings")  # of a store from before there were segments
    return ([{"path": whole, "born": 0, "rows": LEAST * FAN**30, "tokens": 0}] if whole else []), []


def live(spark: SparkSession, segments: list[dict], gone: list[dict]) -> DataFrame:
    """The postings of all facts that are still there. Filters on tokens reach the scans of the segments."""
    born = [spark.read.schema(DERIVED["postings"]).parquet(s["path"]).withColumn("born", F.lit(s["born"]).cast("bigint")) for s in segments]
    rows = reduce(DataFrame.unionAll, born)
    if gone and min(s["born"] for s in segments) < max(g["born"] for g in gone):
        log = spark.read.schema(LOG).parquet(*[g["path"] for g in gone]).groupBy(F.col("id").alias("gone_id")).agg(F.max("upto").alias("upto"))
        rows = rows.join(log, (F.col("id") == F.col("gone_id")) & (F.col("born") < F.col("upto")), "left_anti")
    return rows.drop("born")


def tier(part: dict) -> int:
    size, out = part["rows"], 0
    while size > LEAST:
        size, out = size // FAN, out + 1
    return out


def crowded(parts: list[dict]) -> list[dict]:
    """The parts of the lowest tier that holds :data:`FAN` or more; none, if no tier does."""
    by_tier: dict[int, list[dict]] = {}
    for p in parts:
        by_tier.setdefault(tier(p), []).append(p)
    return next((by_tier[t] for t in sorted(by_tier) if len(by_tier[t]) >= FAN), [])


def _changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, gone and added of the facts whose indexed text is not what it was."""
    texts = lambda df, name: df.select("id", F.xxhash64(*lexical.INDEXED).alias(name))
    both = texts(before, "old").join(texts(after, "new"), "id", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("id", F.col("old").isNotNull().alias("gone"), F.col("new").isNotNull().alias("added"))


def _segment(name: str, df: DataFrame, version: int, write: Write) -> dict:
    """Write postings as a segment."""
    rows, seen = lexical.counted(df)
    _, path = write(name, rows)
    return {"path": path, "born": version, **seen.get}


def _fresh(facts: DataFrame, n: int) -> DataFrame:
    """The postings of n facts of a join, dealt anew so that few facts make few files."""
    most = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lexical.index_rows(facts.repartition(max(1, min(most, -(-n // FACTS_A_FILE))), "id"))


def _merged(spark: SparkSession, parts: list[dict], gone: list[dict]) -> DataFrame:
    """The postings of several segments as one, in the order of tokens."""
    most, rows = int(spark.conf.get("spark.sql.shuffle.partitions")), sum(p["rows"] for p in parts)
    return lexical.in_token_order(live(spark, parts, gone), max(1, min(most, -(-rows // POSTINGS_A_FILE))))


def update(before: Snapshot | None, memories: DataFrame, manifest: dict, version: int, write: Write) -> tuple[list[dict], list[dict], DataFrame] | None:
    """Segments, log and totals (one row) once the facts of ``version`` are written; None if no text has changed."""
    spark, n = memories.sparkSession, memories.count()
    segments, gone = parts_of(manifest)

    if before is None or not segments:
        whole = _segment("postings", lexical.index_rows(memories), version, write)
        return [whole], [], lexical.totals_of(spark, n, whole["tokens"])
    changes, _ = write("changes", _changed(before.memories, memories))
    counts = changes.agg(F.count_if("gone").alias("gone"), F.count_if("added").alias("added")).first()
    if not counts["gone"] and not counts["added"]:
        return None
    tokens = before.lexical_totals.first()["tokens"]
    if counts["gone"]:
        ids = changes.filter("gone").select("id")
        left = before.memories.join(ids, "id", "left_semi")
        lost = left.agg(F.coalesce(F.sum(lexical.token_count(left)), F.lit(0)).alias("tokens")).first()["tokens"]
        _, path = write("gone", ids.withColumn("upto", F.lit(version).cast("bigint")))
        gone = [*gone, {"path": path, "born": version, "rows": counts["gone"], "tokens": lost}]
        tokens -= lost
    if counts["added"]:
        fresh = _fresh(memories.join(changes.filter("added"), "id", "left_semi"), counts["added"])
        segments = [*segments, _segment("postings", fresh, version, write)]
        tokens += segments[-1]["tokens"]
    merge = segments if sum(g["tokens"] for g in gone) > tokens else crowded(segments)
    while merge:
        one = _segment(f"postings-{len(segments)}", _merged(spark, merge, gone), version, write)
        segments = [*[s for s in segments if s not in merge], one]
        gone = [g for g in gone if g["born"] > min(s["born"] for s in segments)]
        merge = crowded(segments)
    if many := crowded(gone):
        log = spark.read.schema(LOG).parquet(*[g["path"] for g in many]).groupBy("id").agg(F.max("upto").alias("upto"))
        table, path = write("gone-merged", log)
        one = {"path": path, "born": max(g["born"] for g in many), "rows": table.count(), "tokens": sum(g["tokens"] for g in many)}
        gone = [*[g for g in gone if g not in many], one]
    return segments, gone, lexical.totals_of(spark, n, tokens)
