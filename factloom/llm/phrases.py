"""Collocations: phrases of two or three words that occur together more often than their parts explain.

Texts are cut into blocks of bounded length, each in one language and with a dictionary of its own. The block
dictionaries give the corpus counts of words; words that are frequent enough get dense ids by falling count,
and come back to the blocks that hold them as a table from a block's codes to ids. A word that is not frequent
breaks its piece, since no frequent phrase holds it. Each place then gives one n-gram of three ids (0 where the
piece ends before), packed in a binary key of fixed width. Blocks radix-sort and run-length count their keys;
the keys are range-partitioned, sorted and counted again. A run of equal keys is a phrase of three words, a run of
equal first two ids one of two, so a single shuffle counts both.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.workspace import drop_table, gapless_rank, write_table

BLOCK = "block string, lang string, codes binary, words array<string>, counts array<bigint>, n bigint"
BREAK = 0  # the id and the code of a place where a piece ends
UNKNOWN = "und"
_ID = np.dtype(">u4")
_RUNS = pa.schema([("key", pa.binary(12)), ("n", pa.int64())])


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of all words of all texts in a row, 0 where a piece or a text ends, and the word of each code from 1."""
    texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"[.,;:!?\n\x0b\x0c\r]+", " . ")  # a word never is "."
    flat = pc.split_pattern(pc.binary_join_element_wise(pc.replace_substring(texts, "\t", " "), pa.scalar("."), pa.scalar(" ")), " ").flatten()
    coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    ends = coded.dictionary.index(".").as_py()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    # The end mark's code becomes 0, codes before it move up by one.
    codes = np.where(codes == ends, 0, np.where(codes < ends, codes + 1, codes)).astype(np.int32)
    return codes, coded.dictionary.filter(pc.not_equal(coded.dictionary, "."))


def blocks_of(docs: DataFrame, most: int = 16_000_000) -> DataFrame:
    """Blocks of the texts of ``docs`` (lang, text) of about ``most`` characters; a longer text is a block of its own.

    A null text has no words, a null language is ``und``. At most ``most`` characters are held by a task besides
    the text at hand, of however many languages.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}
        part, number = f"{TaskContext.get().partitionId()}", 0

        def block(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            del sizes[lang]
            codes, words = split_words(pa.array(held.pop(lang), pa.string()))
            counts = np.bincount(codes, minlength=len(words) + 1)[1:]
            row = ([f"{part}-{number}"], [lang], [codes.astype("<i4").tobytes()], [words], [counts], [int(counts.sum())])
            kinds = (pa.string(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["block", "lang", "codes", "words", "counts", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] >= most:
                    yield block(lang)
            while sum(sizes.values()) >= most:
                yield block(max(sizes, key=sizes.get))
        for lang in list(held):
            yield block(lang)

    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").filter(F.col("text") != "")
    return texts.mapInArrow(cut, BLOCK)


def radix_order(ids: list[np.ndarray]) -> np.ndarray:
    """The order of keys given as columns of 32-bit ids: least digit first, by 16-bit digits, whose stable sort is a
    radix sort in numpy."""
    order = None
    for column in reversed(ids):
        for shift in (0, 16):
            digit = (column >> np.uint32(shift)).astype(np.uint16)
            if digit.any() or order is None:
                order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return order


def packed_runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the n-grams that start at each place of a block, 12 bytes each in order, and their counts."""
    ids = np.concatenate([ids, np.zeros(2, np.uint32)])
    starts = np.flatnonzero((ids[:-2] > 0) & (ids[1:-1] > 0))
    grams = [ids[starts], ids[starts + 1], ids[starts + 2]]
    order = radix_order(grams)
    grams = [g[order] for g in grams]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = reduce(np.logical_or, [g[1:] != g[:-1] for g in grams])
    firsts = np.flatnonzero(fresh)
    keys = np.stack([g[firsts] for g in grams], 1).astype(_ID)
    return keys, np.diff(np.append(firsts, len(starts)))


def block_runs(blocks: DataFrame) -> DataFrame:
    """key, n: the run-length counts of each block. blocks: codes, ids (array of struct<code, id>)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pairs = batch.column(1)[k].values
                codes = np.frombuffer(batch.column(0)[k].as_buffer(), "<i4")
                table = np.zeros(int(codes.max(initial=0)) + 1, np.uint32)
                table[pairs.field("code").to_numpy(zero_copy_only=False)] = pairs.field("id").to_numpy(zero_copy_only=False)
                keys, counts = packed_runs(table[codes])
                for a in range(0, len(counts), 1 << 18):
                    part = keys[a : a + (1 << 18)]
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(12), len(part), [None, pa.py_buffer(part.tobytes())])
                    yield pa.RecordBatch.from_arrays([raw.cast(pa.binary()), pa.array(counts[a : a + (1 << 18)], pa.int64())], ["key", "n"])

    return blocks.select("codes", "ids").mapInArrow(count, "key binary, n long")


def corpus_runs(runs: DataFrame, least: int) -> DataFrame:
    """w1, w2, w3 (0: a phrase of two), a, whole: phrases counted at least ``least`` times.

    Keys are range-partitioned and stream through in order. All of a phrase of three words is in one range; a
    phrase of two may begin in one range and end in another, so the first and the last of a range come with what
    the range has of them (``whole`` is false) and are summed across ranges.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: np.ndarray, n: np.ndarray, whole) -> pa.RecordBatch:
            columns = [pa.array(ids[:, k].astype(np.int64)) for k in range(3)] + [pa.array(n, pa.int64()), pa.array(np.broadcast_to(whole, len(n)))]
            return pa.RecordBatch.from_arrays(columns, ["w1", "w2", "w3", "a", "whole"])

        def threes(ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            keep = (n >= least) & (ids[:, 2] > 0)
            return out(ids[keep], n[keep], True)

        open_key, open_n = np.zeros((0, 3), np.uint32), np.zeros(0, np.int64)  # the last key, whose run may go on
        pair, pair_n, first = None, 0, True  # the last first two ids
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(0).cast(pa.binary(12))
            ids = np.frombuffer(raw.buffers()[1], _ID, count=3 * len(raw), offset=12 * raw.offset).reshape(-1, 3).astype(np.uint32)
            ids, n = np.concatenate([open_key, ids]), np.concatenate([open_n, batch.column(1).to_numpy()])
            firsts = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(1)))
            sums = np.add.reduceat(n, firsts)
            ids, n = ids[firsts], sums
            open_key, open_n = ids[-1:], n[-1:]
            yield threes(ids[:-1], n[:-1])
            # Pairs: all but the open key are final; the open key's pair stays open.
            done, done_n = ids[:-1], n[:-1]
            if not len(done):
                continue
            edges = np.flatnonzero(np.append(True, (done[1:, :2] != done[:-1, :2]).any(1)))
            pairs, sizes = done[edges, :2], np.add.reduceat(done_n, edges)
            if pair is not None:
                if (pairs[0] == pair).all():
                    sizes[0] += pair_n
                else:
                    pairs, sizes = np.concatenate([pair[None], pairs]), np.append(pair_n, sizes)
            pair, pair_n = pairs[-1], sizes[-1]
            pairs, sizes = pairs[:-1], sizes[:-1]
            if len(pairs):
                whole = np.ones(len(pairs), bool)
                whole[0], first = not first, False
                keep = (sizes >= least) | ~whole
                yield out(np.column_stack([pairs[keep], np.zeros(keep.sum(), np.uint32)]), sizes[keep], whole[keep])
        if len(open_n):
            yield threes(open_key, open_n)
            last = [(open_key[0, :2], int(open_n[0]))]
            if pair is not None and (pair == last[0][0]).all():
                last = [(pair, int(pair_n) + last[0][1])]
            elif pair is not None:
                last = [(pair, int(pair_n)), *last]
            for ids, size in last:
                yield out(np.array([[*ids, 0]], np.uint32), np.array([size], np.int64), False)

    counted = runs.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(count, "w1 long, w2 long, w3 long, a long, whole boolean")
    return counted


def top_phrases(docs: DataFrame, least: int = 10, most: int = 2000, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``most`` best phrases of each language of ``docs`` (lang, text).

    Words and pieces: A-Z lower-cased, pieces end at ``.,;:!?`` and line ends, words at spaces and tabs. a: how often
    the phrase occurs; l, r: its parts at the cut of the least score floor(10^6 a a / (l r)), earliest if several; n:
    all words of the language. Phrases below ``least`` are none; one that lies in a longer phrase with at least
    ``share`` percent of its count goes. Ties go by count, then by the phrase's bytes. Null texts and texts without
    words give nothing, a null language counts as ``und``; repeated rows count as often as they are there.
    """
    spark = docs.sparkSession
    blocks, blocks_at = write_table(blocks_of(docs), "blocks")
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("f"))
    known, known_at = write_table(each.groupBy("lang", "word").agg(F.sum("f").alias("f")).filter(F.col("f") >= least).withColumn("all", F.lit(0)), "known")
    words, words_at = write_table(gapless_rank(known, "all", [F.col("f").desc(), F.col("lang"), F.col("word")], "id").select("lang", "word", "f", (F.col("id") + 1).alias("id")), "words")
    drop_table(spark, known_at)
    coded = blocks.select("block", "lang", F.posexplode("words").alias("code", "word")).join(words.drop("f"), ["lang", "word"])
    tables = coded.groupBy("block").agg(F.collect_list(F.struct((F.col("code") + 1).alias("code"), "id")).alias("ids"))
    runs, runs_at = write_table(block_runs(blocks.select("block", "codes").join(tables, "block")), "runs")
    counted, counted_at = write_table(corpus_runs(runs, least), "phrases")
    drop_table(spark, runs_at)

    three = counted.filter("w3 > 0").select("w1", "w2", "w3", "a")
    split = counted.filter("w3 = 0 and not whole").groupBy("w1", "w2").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    two = counted.filter("w3 = 0 and whole").select("w1", "w2", "a").unionByName(split)

    def part(name: str, **columns: str) -> DataFrame:
        return two.select(*[F.col(c).alias(k) for k, c in columns.items()], F.col("a").alias(name))

    heads, tails = part("head", w1="w1", w2="w2"), part("tail", w2="w1", w3="w2")
    single = words.select("id", "lang", "word", "f")
    longest = three.select("w1", "w2", "a").unionByName(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    pairs = two.join(longest, ["w1", "w2"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    pairs = pairs.select("w1", "w2", F.lit(0).cast("long").alias("w3"), "a", F.lit(None).cast("long").alias("head"), F.lit(None).cast("long").alias("tail"))
    threes = three.join(heads, ["w1", "w2"]).join(tails, ["w2", "w3"]).select("w1", "w2", "w3", "a", "head", "tail")

    def named(table: DataFrame, k: int, how: str) -> DataFrame:
        return table.join(single.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else [])), f"w{k}", how)

    both = named(named(named(pairs.unionByName(threes), 1, "inner"), 2, "inner"), 3, "left")
    cuts = F.when(F.col("w3") == 0, F.array(F.struct(F.col("f1").alias("l"), F.col("f2").alias("r")))).otherwise(
        F.array(F.struct(F.col("f1").alias("l"), F.col("tail").alias("r")), F.struct(F.col("head").alias("l"), F.col("f3").alias("r")))
    )
    # Counts have 15 digits at most, so 10^6 a a and l r are exact in decimals of 38.
    exact = "transform(cuts, (x, k) -> struct((1000000 * cast(a as decimal(15)) * cast(a as decimal(15))) div (cast(x.l as decimal(15)) * cast(x.r as decimal(15))) as score, k as cut, x.l as l, x.r as r))"
    scored = both.withColumn("cuts", cuts).withColumn("best", F.array_min(F.expr(exact))).select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", "best.l", "best.r", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # First inside parts of a language, then of what these leave: no task ranks a whole language.
    inside = Window.partitionBy("lang", "part").orderBy(*order)
    few = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("place", F.row_number().over(inside)).filter(F.col("place") <= most).drop("part", "place")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    result, _ = write_table(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    for path in (blocks_at, words_at, counted_at):
        drop_table(spark, path)
    return result


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language of ``documents``."""
    return top_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The query in DuckDB's SQL.
ORACLE = r"""with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
 words as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
 grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) as g from words, (select unnest([1, 2, 3]) as k) where len(w) >= k),
 counts as (select lang, k, g, count(*) as f from grams group by all),
 totals as (select lang, sum(f) as n from counts where k = 1 group by lang),
 cand as (select lang, k, g, f as a from counts where k > 1 and f >= 10),
 cuts as (select c.lang, c.k, c.g, c.a, p.k as cut, p.f as l, q.f as r, (1000000::hugeint * c.a * c.a) // (p.f::hugeint * q.f) as score
  from cand c join counts p on p.lang = c.lang and p.k < c.k and p.g = c.g[1:p.k] join counts q on q.lang = c.lang and q.k = c.k - p.k and q.g = c.g[p.k + 1:c.k]),
 best as (select lang, k, g, any_value(a) as a, arg_min({'l': l, 'r': r, 's': score}, score * 10 + cut) as b from cuts group by lang, k, g),
 held as (select lang, s, max(a) as longer from (select lang, unnest([g[1:2], g[2:3]]) as s, a from cand where k = 3) group by lang, s),
 kept as (select b.lang, array_to_string(b.g, ' ') as phrase, b.a, b.b.l as l, b.b.r as r, cast(b.b.s as bigint) as score from best b left join held h on h.lang = b.lang and h.s = b.g and b.k = 2 where h.longer is null or 100 * h.longer < 50 * b.a),
 ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
 select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from ranked join totals using (lang) where rank <= 2000"""
