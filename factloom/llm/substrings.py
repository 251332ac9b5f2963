"""Substring dedup: words that lie in a window whose words also stand in a document of a smaller id are removed.

What repeats is decided by suffix automata of reference shards: documents stream through an automaton of earlier
passages, and maximal spans of its matching statistics at least a window long go. Automata of a whole corpus would
meet every document with every shard, so numbers lead each document to the shards that hold something of it:

* equal texts are one class, whose smallest doc_id stands for it; its copies lose everything a window covers;
* every window has an anchor, its run of ``GRAM`` words of least hash, so equal windows have equal anchors; only
  windows at anchors that two classes share are looked at further;
* equal hashes of windows link a class to an earlier one that has the window. A task first resolves what meets
  inside its own batch and sends one row for it, so a passage in a third of all documents is a row a batch.

The earlier ends of the links are the reference passages, sharded by their class; a shard with many passages to
stream is copied to as many tasks. Hashes only lead the way: an automaton compares words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.automaton import NEVER, SuffixAutomaton
from factloom.llm.segments import chunks
from factloom.llm.words import mix, plain_word_hashes
from factloom.llm.workspace import drop_bucketed, drop_table, write_bucketed, write_table

GRAM = 5
_NO_WORDS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # sha256 of nothing


def runs_hashed(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each place on."""
    n = max(len(words) - size + 1, 0)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = mix(total * np.uint64(3) + words[k : k + n] + np.uint64(k + 1))
    return total


def window_anchors(words: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The places where a window starts inside one text, and the place of each one's anchor: the leftmost run of
    ``GRAM`` words of least hash."""
    ends = np.cumsum(counts)
    sizes = np.maximum(counts - window + 1, 0)
    starts = np.repeat(ends - counts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    if not len(starts):
        return starts, starts
    grams = runs_hashed(words, GRAM)
    offsets = np.lib.stride_tricks.sliding_window_view(grams, window - GRAM + 1).argmin(1)
    return starts, starts + offsets[starts]


def _hashed(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for a, b in chunks(texts, map(len, texts), most):
        yield a, *plain_word_hashes(texts[a:b])


def _shared(hashes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Which rows have a hash that rows of another owner have too."""
    if not len(hashes):
        return np.zeros(0, bool)
    order = np.lexsort((owners, hashes))
    h, o = hashes[order], owners[order]
    firsts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    lasts = np.append(firsts[1:], len(h)) - 1
    out = np.zeros(len(h), bool)
    out[order] = np.repeat(o[firsts] != o[lasts], lasts - firsts + 1)
    return out


def shared_anchors(classes: DataFrame, window: int) -> DataFrame:
    """key, pos: the anchors (word places) that two classes share. classes: key, text."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owners, places = [], [], []
            for a, words, counts in _hashed(batch.column(1).to_pylist()):
                at = np.unique(window_anchors(words, counts, window)[1])
                ends = np.cumsum(counts)
                own = np.searchsorted(ends, at, side="right")
                hashes.append(runs_hashed(words, GRAM)[at] if len(at) else np.zeros(0, np.uint64))
                owners.append(own + a)
                places.append(at - (ends - counts)[own])
            if not hashes:
                continue
            h, o, p = np.concatenate(hashes), np.concatenate(owners), np.concatenate(places)
            known = _shared(h, o)
            # Of what is shared here already, one row a hash asks no more but tells other batches; the rest goes as it is.
            known_at = np.flatnonzero(known)
            tells = known_at[np.unique(h[known_at], return_index=True)[1]]
            dealt = h.copy()
            dealt[known] = mix(o[known].astype(np.uint64) * np.uint64(1 << 24) + p[known].astype(np.uint64))
            rows = np.concatenate([np.arange(len(h)), tells])
            dealt = np.concatenate([dealt, h[tells]])
            kind = np.concatenate([np.where(known, 2, 0), np.ones(len(tells), int)])  # 0 asks, 1 only tells, 2 is known
            yield pa.RecordBatch.from_arrays(
                [pa.array(dealt.view(np.int64)), pa.array(kind.astype(np.int8)), batch.column(0).take(pa.array(o[rows])), pa.array(p[rows].astype(np.int32))], ["h", "kind", "key", "pos"]
            )

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows = None  # the last hash's rows, which may go on

        def settled(rows: pa.Table) -> pa.RecordBatch:
            kind = rows["kind"].to_numpy()
            codes = rows["key"].combine_chunks().dictionary_encode().indices.to_numpy()
            asks = kind != 2
            keep = ~asks
            known = np.zeros(len(kind), bool)
            known[asks] = _shared(rows["h"].to_numpy()[asks], codes[asks])
            keep |= (kind == 0) & known
            # A telling row was shared in its own batch: whoever asks for its hash is answered.
            told = np.unique(rows["h"].to_numpy()[kind == 1])
            keep |= (kind == 0) & np.isin(rows["h"].to_numpy(), told)
            return rows.select(["key", "pos"]).filter(pa.array(keep)).combine_chunks()

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if open_rows is None else pa.concat_tables([open_rows, rows]).combine_chunks()
            if not rows.num_rows:
                continue
            h = rows["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            open_rows = rows.slice(cut)
            yield from settled(rows.slice(0, cut)).to_batches()
        if open_rows is not None:
            yield from settled(open_rows).to_batches()

    rows = classes.select("key", "text").mapInArrow(anchors, "h long, kind byte, key binary, pos int")
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(resolved, "key binary, pos int")


def window_links(suspects: DataFrame, window: int) -> DataFrame:
    """key, pos, n, from_key, from_pos: ``n`` windows from a place on that an earlier class has from another place on.

    suspects: key, doc, text, marks (places of shared anchors). Earlier is a smaller doc; equal ones give no link.
    """
    schema = "w long, doc long, key binary, pos int, n int, from_key binary, from_pos int"

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owners, places = [], [], []
            marks = [m.values.to_numpy() for m in batch.column(3)]
            for a, words, counts in _hashed(batch.column(2).to_pylist()):
                firsts = np.cumsum(counts) - counts
                starts, at = window_anchors(words, counts, window)
                marked = np.zeros(len(words) + 1, bool)
                for k in range(len(counts)):
                    marked[firsts[k] + marks[a + k]] = True
                starts = starts[marked[at]]
                own = np.searchsorted(firsts + counts, starts, side="right")
                hashes.append(runs_hashed(words, window)[starts] if len(starts) else np.zeros(0, np.uint64))
                owners.append(own + a)
                places.append(starts - firsts[own])
            if not hashes:
                continue
            h, o, p = np.concatenate(hashes), np.concatenate(owners), np.concatenate(places)
            if not len(h):
                continue
            docs = batch.column(1).to_numpy()
            order = np.lexsort((p, o, docs[o], h))
            heads = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
            head = np.empty(len(h), np.int64)
            head[order] = np.repeat(order[heads], np.diff(np.append(heads, len(h))))
            later = docs[o] > docs[o[head]]
            # What an earlier class of this batch has is settled, runs of it in one row; the rest asks other batches.
            rows = np.flatnonzero(later)
            rows = rows[np.lexsort((p[rows], o[rows]))]
            src, at, own, source = head[rows], p[rows], o[rows], o[head[rows]]
            goes_on = np.zeros(len(rows), bool)
            goes_on[1:] = (own[1:] == own[:-1]) & (at[1:] == at[:-1] + 1) & (source[1:] == source[:-1]) & (p[src[1:]] == p[src[:-1]] + 1)
            begins = np.flatnonzero(~goes_on)
            sizes = np.diff(np.append(begins, len(rows)))
            asks = np.flatnonzero(~later)
            own = np.concatenate([asks, rows[begins]])
            dealt = np.concatenate([h[asks], mix(h[rows[begins]] + o[rows[begins]].astype(np.uint64))])
            sources = pa.array(np.concatenate([np.zeros(len(asks), np.int64), o[src[begins]]]), mask=np.concatenate([np.ones(len(asks), bool), np.zeros(len(begins), bool)]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(dealt.view(np.int64)), pa.array(docs[o[own]]), batch.column(0).take(pa.array(o[own])), pa.array(p[own].astype(np.int32)),
                    pa.array(np.concatenate([np.ones(len(asks)), sizes]).astype(np.int32)), batch.column(0).take(sources), pa.array(np.concatenate([np.zeros(len(asks)), p[src[begins]]]).astype(np.int32)),
                ],
                ["w", "doc", "key", "pos", "n", "from_key", "from_pos"],
            )

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w0 = doc0 = key0 = pos0 = None  # the earliest row of the hash at hand
        for batch in batches:
            if not batch.num_rows:
                continue
            w, docs, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(5).is_null().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(asks)
            out = [batch.filter(pa.array(~asks)).select(["key", "pos", "n", "from_key", "from_pos"])]
            if len(at):
                heads = np.flatnonzero(np.append(True, w[at][1:] != w[at][:-1]))
                head = np.repeat(at[heads], np.diff(np.append(heads, len(at))))
                keys, places, sources = batch.column(2).take(pa.array(at)), batch.column(3).to_numpy()[at], batch.column(2).take(pa.array(head))
                first_doc, first_pos = docs[head].copy(), batch.column(3).to_numpy()[head].copy()
                goes_on = w[at] == w0 if w0 is not None else np.zeros(len(at), bool)
                if goes_on.any():
                    first_doc[goes_on], first_pos[goes_on] = doc0, pos0
                    sources = pa.array([key0 if g else k for g, k in zip(goes_on.tolist(), sources.to_pylist())], pa.binary())
                later = docs[at] > first_doc
                some = pa.array(np.flatnonzero(later))
                out.append(pa.RecordBatch.from_arrays([keys.take(some), pa.array(places[later]), pa.array(np.ones(later.sum(), np.int32)), sources.take(some), pa.array(first_pos[later])], ["key", "pos", "n", "from_key", "from_pos"]))
                if not goes_on[-1]:
                    w0, doc0, key0, pos0 = w[at[-1]], docs[head[-1]], batch.column(2)[int(head[-1])].as_py(), int(batch.column(3)[int(head[-1])].as_py())
            yield from out

    rows = suspects.select("key", "doc", "text", "marks").mapInArrow(windows, schema)
    return rows.repartition("w").sortWithinPartitions("w", "doc").mapInArrow(linked, "key binary, pos int, n int, from_key binary, from_pos int")


def joined_runs(links: DataFrame) -> DataFrame:
    """The links of each class, those that go on from one another in one row."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if rows.num_rows < 2:
                held = rows
                continue
            pos, n, src = (rows[c].to_numpy() for c in ("pos", "n", "from_pos"))
            key, source = (rows[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("key", "from_key"))
            goes_on = np.append(False, (key[1:] == key[:-1]) & (source[1:] == source[:-1]) & (pos[1:] == pos[:-1] + n[:-1]) & (src[1:] == src[:-1] + n[:-1]))
            begins = np.flatnonzero(~goes_on)
            out = rows.take(pa.array(begins)).set_column(2, "n", pa.array(np.add.reduceat(n, begins).astype(np.int32)))
            held = out.slice(out.num_rows - 1)
            yield from out.slice(0, out.num_rows - 1).combine_chunks().to_batches()
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return links.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(join, "key binary, pos int, n int, from_key binary, from_pos int")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def confirmed_spans(classes: DataFrame, runs: DataFrame, window: int, shard_words: int) -> DataFrame:
    """key, start, stop: the spans of each class that the automata of earlier passages confirm.

    A shard holds about ``shard_words`` words of reference (one class's passages are never divided), and a task
    streams about ten times as many through a copy of its automaton.
    """
    words = F.col("n") + window - 1
    total = runs.agg(F.sum(words)).first()[0] or 0
    shards = 1 + total // shard_words
    runs = runs.withColumn("shard", F.pmod(F.xxhash64("from_key"), F.lit(shards)))
    copies = runs.groupBy("shard").agg((1 + F.floor(F.sum(words) / (10 * shard_words))).cast("int").alias("copies"))
    dealt = runs.join(copies, "shard").withColumn("part", F.pmod(F.xxhash64("key", "pos"), F.col("copies")).cast("int"))
    asks = dealt.select("key", F.struct(F.lit(False).alias("refers"), "shard", "part", F.col("pos").alias("start"), (F.col("pos") + words).alias("stop")).alias("x"))
    refers = dealt.select(F.col("from_key").alias("key"), F.struct(F.lit(True).alias("refers"), "shard", "part", F.col("from_pos").alias("start"), (F.col("from_pos") + words).alias("stop")).alias("x"))
    items = asks.unionByName(refers).groupBy("key").agg(F.collect_set("x").alias("items"))
    schema = "shard long, part int, refers boolean, key binary, doc long, start int, words string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, doc, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                every = text.encode("utf-8", "surrogatepass").split()
                groups: dict[tuple, list] = {}
                for x in wanted:
                    groups.setdefault((x["shard"], x["part"], x["refers"]), []).append((x["start"], x["stop"]))
                for (shard, part, refers), spans in groups.items():
                    rows += [(shard, part, refers, key, doc, a, b" ".join(every[a:b])) for a, b in _merged(spans)]
            for a, b in chunks(rows, (len(r[6]) for r in rows), 8_000_000):
                kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
                arrays = [pa.array(v, k) for v, k in zip(zip(*rows[a:b]), kinds)]
                yield pa.RecordBatch.from_arrays([*arrays[:6], arrays[6].view(pa.string())], ["shard", "part", "refers", "key", "doc", "start", "words"])

    passages = classes.join(items, "key").select("key", "doc", "text", "items").mapInArrow(cut, schema)

    def stream(references: pa.Table, documents: pa.Table) -> pa.Table:
        automaton = SuffixAutomaton()
        for text, doc in zip(references["words"].to_pylist(), references["doc"].to_pylist()):
            automaton.add(text.split(" "), doc)
        automaton.close(window)
        keys, starts, stops = [], [], []
        for key, doc, start, text in zip(*(documents[c].to_pylist() for c in ("key", "doc", "start", "words"))):
            for a, b in automaton.spans(text.split(" "), doc):
                keys.append(key), starts.append(start + a), stops.append(start + b)
        return pa.table({"key": pa.array(keys, pa.binary()), "start": pa.array(starts, pa.int32()), "stop": pa.array(stops, pa.int32())})

    passages, _ = write_table(passages, "passages")
    sides = [passages.filter(F.col("refers") == r).select(*[F.col(c).alias(c) for c in ("shard", "part", "key", "doc", "start", "words")]) for r in (True, False)]
    return sides[0].groupBy("shard", "part").cogroup(sides[1].groupBy("shard", "part")).applyInArrow(stream, "key binary, start int, stop int")


def without_repeats(docs: DataFrame, window: int = 13, shard_words: int = 100_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept, for every row of ``docs`` (doc_id, text; others are ignored).

    kept: the words that are left, joined by one space. A word goes if a window of ``window`` consecutive words
    covers it that also starts in a row of a smaller doc_id; windows are taken from the texts as they came. Rows of
    one doc_id never remove from one another; a null doc_id is greater than any other. Null texts and texts
    without words keep nothing and lose nothing; rows of equal text are one class and share one computation.
    """
    rows, ends = _decided(docs, window, shard_words, texts=True)
    return _answers(rows, ends, window, F.lit(""), "kept")


def _decided(docs: DataFrame, window: int, shard_words: int, texts: bool) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with their class, and the written results of the classes."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(NEVER)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    classes, classes_at = write_bucketed(rows.groupBy("key").agg(F.min("doc").alias("doc"), F.first("text").alias("text")), "classes", "key")
    marks = shared_anchors(classes, window).groupBy("key").agg(F.collect_set("pos").alias("marks"))
    runs, runs_at = write_table(joined_runs(window_links(classes.join(marks, "key"), window)), "links")
    spans, spans_at = write_table(confirmed_spans(classes, runs, window, shard_words), "spans")
    gone = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    kind = pa.string()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            counts, removed, kept = [], [], []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                left, at = [], 0
                for a, b in _merged([(x["start"], x["stop"]) for x in spans or ()]):
                    left += words[at:a]
                    at = b
                left += words[at:]
                counts.append(len(words)), removed.append(len(words) - len(left))
                whole = b" ".join(left)
                kept.append(whole.decode("utf-8", "surrogatepass") if texts else sha256(whole).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, kind)], ["key", "first", "n_words", "n_removed", "kept"])

    ends = classes.join(gone, "key", "left").select("key", "doc", "text", "gone").mapInArrow(cut, "key binary, first long, n_words long, n_removed long, kept string")
    ends, _ = write_table(ends, "kept")
    drop_bucketed(spark, classes_at)
    for path in (runs_at, spans_at):
        drop_table(spark, path)
    return rows.select("doc_id", "doc", "key"), ends


def _answers(rows: DataFrame, ends: DataFrame, window: int, nothing, name: str) -> DataFrame:
    """Each row's own answer: what its class keeps if it is the first of it, nothing of a window or more otherwise."""
    copy = (F.col("doc") > F.col("first")) & (F.col("n_words") >= window)
    removed = F.when(copy, F.col("n_words")).otherwise(F.col("n_removed"))
    return rows.join(ends, "key").select("doc_id", "n_words", removed.alias("n_removed"), F.when(copy, nothing).otherwise(F.col("kept")).alias(name))


def op11_substring_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` without the words of windows of 13 that an earlier one has."""
    rows, ends = _decided(spark.read.parquet(f"{sf_dir}/documents.parquet"), 13, 100_000, texts=False)
    return _answers(rows, ends, 13, F.lit(_NO_WORDS), "kept_sha256")


#: The query in DuckDB's SQL.
ORACLE = r"""with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
 windows as (select doc_id, unnest(range(1, len(w) - 11)) as i, w from docs where len(w) >= 13),
 each as (select doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) as h from windows),
 firsts as (select h, min(doc_id) as first from each group by h),
 gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from each join firsts using (h) where first < doc_id),
 lost as (select doc_id, list(p) as ps, count(*) as n from gone group by doc_id),
 words as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from docs),
 kept as (select doc_id, string_agg(word, ' ' order by p) as t from words anti join gone using (doc_id, p) group by doc_id)
 select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(l.n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from docs d left join lost l using (doc_id) left join kept using (doc_id)"""
