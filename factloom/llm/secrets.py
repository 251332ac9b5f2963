"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean trigram query (:mod:`factloom.llm.trigrams`). The index is a
written table of postings: for each trigram that some query names, and each bucket of doc_ids, the sorted
ids of the documents that hold it. Queries are answered bucket by bucket by intersecting and uniting
postings, and only candidates are searched with the rule itself; the index holds no texts, and candidates
go to the texts, not the reverse, as long as their table is small enough to be broadcast. Rules without a
mandatory trigram search every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.trigrams import Query, narrowed, trigram_query, trigrams_of
from factloom.llm.workspace import partitions, write_table


@dataclass(frozen=True)
class Rule:
    """kind: its name. A match counts if the text of ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])

# A run of a class that is too short holds no longer run, so the least length of "access" and "hex" may
# stand in the pattern; a short "assign" match may overlap a longer one and is dropped afterwards.
BASE = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("web", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + MORE


BUCKETS = 16  # of doc_ids, for each shuffle partition
MOST_BROADCAST = 100_000  # candidate rows, of some 60 bytes each


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """bucket, trigram and ids (sorted): the inverted index of the trigrams that the rules' queries name."""
    wanted = sorted(set().union(*(trigrams_of(narrowed(trigram_query(r.pattern))) for r in rules)))
    low = docs.filter("doc_id is not null and text is not null").select("doc_id", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted])) if wanted else F.array().cast("array<string>")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS * partitions(docs.sparkSession))).cast("int")
    each = low.select(bucket.alias("bucket"), "doc_id", F.explode(present).alias("trigram"))
    return each.groupBy("bucket", "trigram").agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))


def _answer(query: Query, lists: str) -> Column:
    """The ids that a query leaves, from a bucket's map of trigrams to ids."""
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(lists, F.lit(query)), F.array().cast("array<bigint>"))
    parts = [_answer(q, lists) for q in sorted(query[1], key=str)]
    return reduce(F.array_intersect if query[0] == "and" else F.array_union, parts)


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and kinds: the rules whose trigram query the postings satisfy."""
    queries = {r.kind: narrowed(q) for r in rules if (q := trigram_query(r.pattern)) is not True}
    lists = index.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("trigram", F.col("ids").cast("array<bigint>")))).alias("lists"))
    left = [F.struct(F.lit(kind).alias("kind"), _answer(q, "lists").alias("ids")) for kind, q in queries.items()]
    found = lists.select(F.explode(F.array(*left)).alias("x")).select("x.kind", F.explode("x.ids").alias("doc_id"))
    return found.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with ``secrets`` added: an array of spans
    (start, order, kind, end) by start, then by the rules' order; code points, end exclusive.

    A null or empty text has none. Rows without a doc_id are searched with every rule; rows that repeat
    a doc_id are searched one by one. Columns named secrets or beginning with __ are replaced.
    """
    kept = [c for c in docs.columns if c != "secrets" and not c.startswith("__")]
    indexed = {r.kind for r in rules if trigram_query(r.pattern) is not True}
    found, _ = write_table(candidates(write_table(postings(docs, rules), "postings", fewer=8)[0], rules), "candidates", fewer=8)
    found = found.select(F.col("doc_id").alias("__id"), F.col("kinds").alias("__kinds"))
    if found.count() <= MOST_BROADCAST:
        found = F.broadcast(found)
    rows = docs.select(*kept).join(found, F.col("doc_id") == F.col("__id"), "left")
    none = F.array().cast("array<string>")
    text = F.coalesce("text", F.lit(""))

    def searched(rule: Rule, value: Column) -> Column:
        if rule.kind not in indexed:
            return value
        return F.when(F.col("doc_id").isNull() | F.coalesce(F.array_contains("__kinds", rule.kind), F.lit(False)), value).otherwise(none)

    rows = rows.select(*kept, *[searched(r, F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))).alias(f"__all_{r.kind}") for r in rules])

    def spans(order: int, rule: Rule) -> Column:
        matches = F.col(f"__all_{rule.kind}")
        gaps = F.split(text, rule.pattern, -1)
        values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
        each = F.arrays_zip(gaps.alias("gap"), matches.alias("match"), values.alias("value"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>").alias("spans"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["gap"])
            end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
            span = F.struct(begin.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end"))
            counts = F.coalesce(F.length(x["value"]) >= rule.least, F.lit(False))
            return F.struct(end.alias("at"), F.when(counts, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return F.when(F.size(matches) > 0, F.aggregate(each, start, step)["spans"]).otherwise(start["spans"])

    every = F.sort_array(F.flatten(F.array(*[spans(k, r) for k, r in enumerate(rules)])))
    return rows.select(*kept, every.alias("secrets"))


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans become one. Null texts stay null."""
    found = find_secrets(docs, rules)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        before = F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        fresh = F.concat(acc["out"], before, F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))

    return found.withColumn("text", F.when(F.size("secrets") > 0, F.aggregate("secrets", start, step, finish)).otherwise(F.col("text"))).drop("secrets")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``: counts and digest of the base kinds, and all spans."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("secrets", lambda x: x["order"] < len(BASE))

    def count(k: int) -> Column:
        return F.size(F.filter("secrets", lambda x: x["order"] == k)).cast("long").alias(f"n_{BASE[k].kind}")

    counts = map(count, range(len(BASE)))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def _sql_hits(order: int, rule: Rule) -> str:
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    return (
        f"select doc_id, {order} as ord, '{rule.kind}' as kind, {rule.least} as least, regexp_extract_all(text, {pattern}, 0) as m, regexp_extract_all(text, {pattern}, {rule.group}) as v, string_split_regex(text, {pattern}) as g"
        f" from documents where regexp_matches(text, {pattern})"
    )


#: The query in DuckDB's SQL: places follow from the lengths of matches and of what stands between them.
ORACLE = f"""with found as ({" union all ".join(_sql_hits(k, r) for k, r in enumerate(RULES))}),
 each as (select doc_id, ord, kind, least, m, v, g, unnest(range(1, len(m) + 1)) as i from found),
 spans as (select doc_id, ord, kind, cast(list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) as bigint) as a, len(m[i]) as n from each where len(v[i]) >= least),
 joined as (select doc_id, count(*) filter (ord = 0) as n_assign, count(*) filter (ord = 1) as n_access, count(*) filter (ord = 2) as n_hex,
  string_agg(concat(kind, ':', a, ':', a + n), ',' order by a, ord) filter (ord < {len(BASE)}) as base, string_agg(concat(kind, ':', a, ':', a + n), ',' order by a, ord) as spans from spans group by 1)
 select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents left join joined using (doc_id)"""
