"""Lexical search: BM25 over the text columns of the facts, with prefix and phrase terms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import STOPWORDS
from factloom.operators.snapshot import Snapshot

INDEXED = ("content", "normalized_content", "subtype", "source")
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6

# Precomposed letters of up to U+1EFF and what remains of them without marks, by rule.
_MARKED = {chr(c): d for c in range(0xC0, 0x1F00) if len(d := "".join(x for x in unicodedata.normalize("NFD", chr(c).lower()) if unicodedata.category(x) != "Mn")) == 1 and d != chr(c).lower() and chr(c) == chr(c).lower()}


def folded(text: Column | str) -> Column:
    """Lower case without diacritics, in the JVM."""
    plain = F.translate(F.lower(text), "".join(_MARKED), "".join(_MARKED.values()))
    return F.regexp_replace(plain, r"\p{Mn}+", "")


def index_tokens(text: Column | str) -> Column:
    """Runs of letters and digits; ``_`` separates."""
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


@dataclass(frozen=True)
class Term:
    """A phrase of index tokens, the last of which may be a prefix."""

    tokens: tuple[str, ...]
    prefix: bool


def tokens_of(text: str) -> list[str]:
    """The same tokens for text that the driver holds, such as a query."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return re.findall(r"[^\W_]+", plain)


def words_of(text: str) -> list[str]:
    """Tokens of query text with inner marks kept, as :func:`factloom.functions.text.tokenize`."""
    found = re.findall(r"[\w@.+:/-]+", unicodedata.normalize("NFKC", str(text)).lower())
    return [t for t in (w.strip(".:/-+@") for w in found) if t]


def query_keywords(text: str, limit: int = 16) -> list[str]:
    return list(dict.fromkeys(t for t in words_of(text) if t not in STOPWORDS and len(t) >= 2))[:limit]


def query_terms(query: str) -> list[Term]:
    """One phrase per keyword; keywords of four characters or more match as prefixes."""
    out = [Term(tuple(tokens_of(k)), len(k) >= 4) for k in query_keywords(query)]
    return [t for t in out if t.tokens]


def _hits(tokens: Column, term: Term) -> Column:
    """How often a phrase stands in an array of tokens."""
    *inner, last = term.tokens

    def ends(t: Column) -> Column:
        return F.startswith(t, F.lit(last)) if term.prefix else t == last

    if not inner:
        return F.size(F.filter(tokens, ends))

    def begins(t: Column, i: Column) -> Column:
        tests = [t == inner[0]]
        tests += [F.coalesce(F.get(tokens, i + k) == w, F.lit(False)) for k, w in enumerate(inner[1:], 1)]
        tests.append(F.coalesce(ends(F.get(tokens, i + len(inner))), F.lit(False)))
        return reduce(lambda a, b: a & b, tests)

    return F.size(F.filter(tokens, begins))


GAP = 1 << 24  # between the positions of two columns, so that no phrase spans them
RUN = 16_000_000  # bytes of text, about, whose tokens are put in order together
POSTINGS = "token string, id string, d int, positions array<int>"
_LOW = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_IN_TOKEN = np.array([chr(c).isalnum() and c < 128 for c in range(256)])


def index_rows(memories: DataFrame) -> DataFrame:
    """token, id, d (tokens of the fact) and positions: the postings of facts, to be made when they are written.

    All tokens of a fact are in its row, so nothing is shuffled. The rows come in runs of many facts, each in the order
    of tokens; written like this, a query reads the pages of its own tokens from each run. ASCII has nothing to fold, so
    its tokens are found in the bytes; other texts come with theirs.
    """
    columns = {f"c{k}": F.coalesce(F.col(c), F.lit("")) for k, c in enumerate(c for c in INDEXED if c in memories.columns)}
    plain = {c: F.octet_length(c) == F.char_length(c) for c in columns}
    texts = memories.select("id", *[v.alias(c) for c, v in columns.items()])
    parts = [x for c in columns for x in (F.when(plain[c], F.col(c)).alias(c), F.when(~plain[c], index_tokens(c)).alias(f"{c}_tokens"))]
    return texts.select("id", *parts).mapInArrow(_inverted, POSTINGS)


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.ones(batch.num_rows, np.int64)
        for k in range(1, batch.num_columns, 2):
            sizes += pa.compute.binary_length(batch.column(k)).fill_null(0).to_numpy() + 8 * pa.compute.list_value_length(batch.column(k + 1)).fill_null(0).to_numpy()
        run = (np.cumsum(sizes) - sizes) // RUN  # of each fact
        bounds = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for at, end in zip(bounds, bounds[1:]):
            if end > at:
                yield _run(batch.slice(at, end - at))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Tokens of ASCII texts, and how many each text has."""
    texts = pa.concat_arrays([texts.fill_null("")])  # from its own start on
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8, ends[-1])
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_TOKEN[data]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]  # a token never goes from one text on to the next
    begins[edges] = inside[edges + 1]
    stops[edges - 1] = inside[edges]
    begins, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    offsets = np.concatenate([[0], np.cumsum(stops - begins)]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(_LOW[data[inside[1:-1]]]))
    return np.diff(np.searchsorted(begins, ends)), found


def _run(facts: pa.RecordBatch) -> pa.RecordBatch:
    """The postings of some facts by token, then as the facts come."""
    rows, places, words, sizes = [], [], [], np.zeros(facts.num_rows, np.int64)
    for k in range(1, facts.num_columns, 2):
        given = facts.column(k + 1)
        for n, found in (_tokens(facts.column(k)), (pa.compute.list_value_length(given).fill_null(0).to_numpy().astype(np.int64), given.flatten())):
            rows.append(np.repeat(np.arange(len(n)), n))
            places.append((np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + k // 2 * GAP).astype(np.int32))
            words.append(found.cast(pa.string()))
            sizes += n
    coded = pa.concat_arrays(words).dictionary_encode()
    by_token = pa.compute.array_sort_indices(coded.dictionary)
    rank = np.empty(len(by_token), np.int64)
    rank[by_token.to_numpy()] = np.arange(len(rank))
    key = rank[coded.indices.to_numpy()] * len(sizes) + np.concatenate(rows)
    order = np.argsort(key, kind="stable")  # the columns stand one after the other, so positions rise
    key = key[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(first)
    token, row = np.divmod(key[starts], len(sizes))
    positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), pa.array(np.concatenate(places)[order]))
    found = [coded.dictionary.take(by_token).take(pa.array(token)), facts.column(0).take(pa.array(row)), pa.array(sizes[row].astype(np.int32)), positions]
    return pa.RecordBatch.from_arrays(found, ["token", "id", "d", "positions"])


def token_count(memories: DataFrame) -> Column:
    """The index tokens of a fact, as ``d`` of its postings."""
    columns = [F.size(index_tokens(F.coalesce(F.col(c), F.lit("")))) for c in INDEXED if c in memories.columns]
    return reduce(lambda a, b: a + b, columns)


def in_token_order(postings: DataFrame, parts: int) -> DataFrame:
    return postings.repartitionByRange(parts, "token", "id").sortWithinPartitions("token", "id")


def counted(postings: DataFrame) -> tuple[DataFrame, Observation]:
    """Postings whose rows and tokens are known once they are written."""
    seen, tokens = Observation(), F.coalesce(F.sum(F.size("positions")), F.lit(0)).cast("bigint")
    return postings.observe(seen, F.count(F.lit(1)).alias("rows"), tokens.alias("tokens")), seen


def totals_of(spark: SparkSession, n: int, tokens: int) -> DataFrame:
    """n and tokens of all facts, one row."""
    return spark.range(1).select(F.lit(n).cast("bigint").alias("n"), F.lit(tokens).cast("bigint").alias("tokens"))


def index_totals(memories: DataFrame, postings: DataFrame) -> DataFrame:
    """The same, counted from the postings."""
    tokens = postings.agg(F.coalesce(F.sum(F.size("positions")), F.lit(0)).cast("bigint").alias("tokens"))
    return memories.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(tokens))  # one row each


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


def _from_postings(store: Snapshot, terms: list[Term]) -> tuple[DataFrame, DataFrame]:
    """The facts that hold some term (id, status, d, tf0, ...), and the corpus counts, from one scan of the
    terms' own postings."""
    token = F.col("token")

    def fits(t: Term, j: int) -> Column:
        return F.startswith(token, F.lit(t.tokens[j])) if t.prefix and j == len(t.tokens) - 1 else token == t.tokens[j]

    own = store.postings.filter(reduce(lambda a, b: a | b, [fits(t, j) for t in terms for j in range(len(t.tokens))]))
    sums = [F.sum(F.when(fits(t, 0), F.size("positions")).otherwise(0)).cast("int").alias(f"tf{k}") for k, t in enumerate(terms) if len(t.tokens) == 1]
    lists = [F.flatten(F.collect_list(F.when(fits(t, j), F.col("positions")))).alias(f"p{k}_{j}") for k, t in enumerate(terms) if len(t.tokens) > 1 for j in range(len(t.tokens))]
    found = own.groupBy("id").agg(F.max("d").alias("d"), *sums, *lists)

    def phrase(k: int, t: Term) -> Column:
        return F.size(reduce(F.array_intersect, [_moved(F.col(f"p{k}_{j}"), j) for j in range(len(t.tokens))]))

    counted = found.select("id", "d", *[F.col(f"tf{k}") if len(t.tokens) == 1 else phrase(k, t).alias(f"tf{k}") for k, t in enumerate(terms)])
    counts = counted.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"n{k}") for k in range(len(terms))])
    totals = store.lexical_totals.select("n", F.try_divide("tokens", "n").alias("avgdl")).limit(1)
    return counted.join(store.memories.select("id", "status"), "id"), totals.crossJoin(counts)  # one row each


def _from_texts(memories: DataFrame, terms: list[Term]) -> tuple[DataFrame, DataFrame]:
    """The same by tokenising every fact, for a store without postings."""
    columns = [F.coalesce(F.col(c), F.lit("")) for c in INDEXED if c in memories.columns]
    arrays = memories.select("id", "status", F.array(*[index_tokens(c) for c in columns]).alias("parts"))
    counted = arrays.select("id", "status", F.aggregate("parts", F.lit(0), lambda a, p: a + F.size(p)).alias("d"), *[_summed(t).alias(f"tf{k}") for k, t in enumerate(terms)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("avgdl"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"n{k}") for k in range(len(terms))])
    return counted, stats


def _summed(term: Term) -> Column:
    return F.aggregate("parts", F.lit(0), lambda a, p: a + _hits(p, term))


def _scored(store: Snapshot | DataFrame, terms: list[Term], include_inactive: bool) -> tuple[DataFrame, list[Column]]:
    """Facts with some term, their counts beside the corpus counts, and the score of each term."""
    store = Snapshot(memories=store) if isinstance(store, DataFrame) else store
    counted, stats = _from_texts(store.memories, terms) if store.postings is None else _from_postings(store, terms)
    some = counted.filter(reduce(lambda a, b: a | b, [F.col(f"tf{k}") > 0 for k in range(len(terms))]))
    if not include_inactive:
        some = some.filter(F.col("status") == "active")
    parts = []
    for k in range(len(terms)):
        n, tf = F.col(f"n{k}"), F.col(f"tf{k}")
        idf = F.log((F.col("n") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        parts.append(idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("d") / F.col("avgdl")))))
    return some.crossJoin(F.broadcast(stats)), parts  # one row


def search(store: Snapshot | DataFrame, query: str, limit: int | None = 10, include_inactive: bool = False) -> DataFrame:
    """id and score of the best ``limit`` (1 to 100) facts, best first, ties by id; of all in no order without a limit.

    The corpus statistics cover the facts of every status; status is tested after matching. A store with
    postings is asked through them; given facts alone (or a store without), their texts are tokenised.
    A query without keywords finds nothing.
    """
    terms = query_terms(query)
    if not terms:
        memories = store if isinstance(store, DataFrame) else store.memories
        return memories.select("id", F.lit(0.0).alias("score")).limit(0)
    scored, parts = _scored(store, terms, include_inactive)
    found = scored.select("id", reduce(lambda a, b: a + b, parts).alias("score"))
    return found if limit is None else found.orderBy(F.desc("score"), "id").limit(max(1, min(int(limit), 100)))


def search_many(store: Snapshot | DataFrame, queries: list[str], limit: int) -> DataFrame:
    """q (the query's number), id and score: the best ``limit`` active facts of each query, all in one
    plan, scored as by :func:`search`. Ranks are cut inside each task before rows move."""
    parsed = [query_terms(q) for q in queries]
    distinct = list(dict.fromkeys(t for terms in parsed for t in terms))
    if not distinct:
        memories = store if isinstance(store, DataFrame) else store.memories
        return memories.select(F.lit(0).alias("q"), "id", F.lit(0.0).alias("score"), F.lit(1).alias("place")).limit(0)
    number = {t: k for k, t in enumerate(distinct)}
    scored, parts = _scored(store, distinct, False)
    scores = [F.struct(F.lit(q).alias("q"), reduce(lambda a, b: a + b, [parts[number[t]] for t in terms]).alias("score")) for q, terms in enumerate(parsed) if terms]
    rows = scored.select("id", F.explode(F.array(*scores)).alias("s")).select("s.q", "id", "s.score").filter("score > 0")
    place = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit)


def search_for(store: Snapshot | DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """q, id, score, place: the best ``limit`` active facts for each row of ``asked`` (q, text), as :func:`search` finds
    them; the questions are a table, not a list. Of the index only tokens that some term names, or begins, are read on.
    """
    store = Snapshot(memories=store) if isinstance(store, DataFrame) else store
    shape = "array<struct<tokens: array<string>, prefix: boolean>>"

    @F.pandas_udf(shape)
    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"tokens": list(x.tokens), "prefix": x.prefix} for x in query_terms(t or "")])

    wanted = asked.select("q", F.explode(parsed("text")).alias("term")).select("q", "term", F.to_json("term").alias("t")).distinct()
    terms = wanted.select("t", "term").dropDuplicates(["t"])
    words = terms.select("t", F.size("term.tokens").alias("size"), "term.prefix", F.posexplode("term.tokens").alias("j", "word"))
    words = words.select("t", "size", "j", "word", (F.col("prefix") & (F.col("j") == F.col("size") - 1)).alias("begins"))
    postings = store.postings if store.postings is not None else index_rows(store.memories)
    lengths = sorted(r[0] for r in words.filter("begins").select(F.length("word")).distinct().collect())  # a few numbers
    vocabulary = postings.select("token").distinct()
    starts = vocabulary.select("token", F.explode(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("token"))).alias("n"))
    named = words.filter("not begins").select("t", "size", "j", F.col("word").alias("token"))
    begun = starts.select("token", F.expr("substr(token, 1, n)").alias("word")).join(words.filter("begins"), "word").select("t", "size", "j", "token")
    hits = postings.join(named.unionByName(begun), "token")
    places = hits.groupBy("t", "size", "id", "d", "j").agg(F.flatten(F.collect_list("positions")).alias("p"))
    moved = F.transform("p", lambda x: x - F.col("j"))
    phrases = places.groupBy("t", "size", "id", "d").agg(F.collect_list(moved).alias("ps"))
    common = F.aggregate(F.slice("ps", 2, F.size("ps")), F.col("ps")[0], lambda a, p: F.array_intersect(a, p))
    tf = F.when(F.col("size") == 1, F.size(F.col("ps")[0])).when(F.size("ps") == F.col("size"), F.size(common)).otherwise(0)
    counted = phrases.select("t", "id", "d", tf.alias("tf")).filter("tf > 0")
    held = counted.groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    if store.lexical_totals is not None and store.postings is not None:
        totals = store.lexical_totals.select("n", F.try_divide("tokens", "n").alias("avgdl")).limit(1)
    else:
        totals = index_totals(store.memories, postings).select("n", F.try_divide("tokens", "n").alias("avgdl"))
    idf = F.log((F.col("n") - F.col("n_t") + 0.5) / (F.col("n_t") + 0.5))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    part = idf * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("d") / F.col("avgdl"))))
    scored = counted.join(held, "t").crossJoin(F.broadcast(totals)).select("t", "id", part.alias("part"))  # one row
    rows = wanted.select("q", "t").join(scored, "t").groupBy("q", "id").agg(F.sum("part").alias("score"))
    rows = rows.join(store.memories.filter("status = 'active'").select("id"), "id", "left_semi")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return rows.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit)
