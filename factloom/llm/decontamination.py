"""Benchmark decontamination by SimHash over item-sized windows.

Items are grouped by length. A group has one window size, a little less than its shortest item or
``MOST_WORDS``. An item gives the fingerprints of windows along all its words, one behind the other and
one at its end, each from ``stride`` neighbouring starts; items longer than a window also give those of
half the size or less. A document's windows start at every ``stride``-th word. Fingerprints are 64-bit
SimHashes of word pairs. Four blocks of 16 bits index the item fingerprints, each with all values up to a
quarter of the radius away: by the pigeonhole principle every fingerprint within the radius shares a block
with the index, so the lookup is complete.

Beside them every item has guards: windows of ``GUARD`` words, one per ``GUARD`` + ``stride`` - 1 words of
the item, looked up at distance 0. A passage of similarity 0.8 has lost at most a ninth of the item's
shingles. An edit inside costs five or more and touches two guards at most, one at an end costs one or
more; so at least one guard of such a passage is whole, and passages are found however far their
fingerprints lie. Items too short for a guard are windows themselves, from every word of a document.

Candidates are verified on words: a passage as long as the item, at the aligned place or as far from it
as words may be missing or added, must reach the similarity of weighted 5-word shingles (a shingle's weight is its number of
occurrences; sum of minima over sum of maxima).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.segments import chunks
from factloom.llm.words import shingle_hashes, word_hashes, words_of
from factloom.llm.workspace import write_table

_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)
_HIGH = np.uint64(0x8080808080808080)
_GATHER = np.uint64(0x0002040810204081)
MOST_WORDS = 120  # of a window: lanes of eight bits count up to it
GUARD, SHORT = 8, 12  # words of a guard; most words of an item that is a window itself


@dataclass(frozen=True)
class Rule:
    size: int = 5
    similarity: float = 0.8
    radius: int = 7
    stride: int = 4
    growth: float = 1.25
    slack: int = 2
    item_bytes: int = 8_000_000  # of an index: text of its items
    pass_bytes: int = 256_000_000  # broadcast at a time: text of items
    text_chars: int = 16_000_000  # of documents that a task holds while it goes through the indexes


def _lane_sums(features: np.ndarray) -> np.ndarray:
    """Running sums, before each feature and after the last, of its 64 bits, eight to a word."""
    sums = np.zeros((8, len(features) + 1), np.uint64)
    for k, octet in enumerate(features.astype("<u8").view(np.uint8).reshape(-1, 8).T):
        np.cumsum(_LANES[octet], out=sums[k, 1:])
    return sums


def fingerprints(sums: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the ``width`` features from each start: bit i is set where most features have it."""
    add = np.uint64((0x80 - (width // 2 + 1)) * 0x0101010101010101)
    out = np.zeros(len(starts), np.uint64)
    for k in range(8):
        over = ((sums[k, starts + width] - sums[k, starts]) + add) & _HIGH
        out |= (((over >> np.uint64(7)) * _GATHER) >> np.uint64(49) & np.uint64(0xFF)) << np.uint64(8 * k)
    return out


class _Group:
    """Windows of one size, as pairs of item and offset, and the index of their fingerprints.

    step: between the starts of a document's windows."""

    def __init__(self, width: int, step: int, items: np.ndarray, offsets: np.ndarray, marks: np.ndarray, radius: int) -> None:
        self.width, self.step, self.items, self.offsets, self.marks, self.radius = width, step, items, offsets, marks, radius
        reach = radius // 4
        ball = np.array([sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(16), n)], np.int32)
        self.tables = []
        for k in range(4 if radius else 1):
            block = (marks >> np.uint64(16 * k)).astype(np.int32) & 0xFFFF
            values = (block[:, None] ^ ball[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            self.tables.append((np.searchsorted(values[order], np.arange(65537)), (order // len(ball)).astype(np.int32)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, member) pairs within the radius."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k, (bounds, owners) in enumerate(self.tables):
            block = (prints >> np.uint64(16 * k)).astype(np.int64) & 0xFFFF
            lo, n = bounds[block], bounds[block + 1] - bounds[block]
            some = np.flatnonzero(n)
            for a in range(0, len(some), 500_000):
                part = some[a : a + 500_000]
                m = n[part]
                window = np.repeat(part, m)
                owner = owners[np.repeat(lo[part] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
                close = np.bitwise_count(prints[window] ^ self.marks[owner]) <= self.radius
                found.append((window[close], owner[close]))
        window, owner = (np.concatenate(x) for x in zip(*found))
        pairs = np.unique(window * np.int64(len(self.marks)) + owner)
        return np.divmod(pairs, len(self.marks))


class Index:
    """Item texts, ready to be looked for. Items of fewer words than a shingle match whole.

    Memory: the texts, a few words and Counters at a time, and for each window 16 bytes and, where the
    radius isn't 0, 4 bytes for each of its 4 x 17 entries.
    """

    def __init__(self, items: list[tuple[int, str]], rule: Rule) -> None:
        self.rule, self.ids, self.texts = rule, [i for i, _ in items], [t for _, t in items]
        self.wanted = lru_cache(4096)(lambda k: weighted(words_of(self.texts[k]), rule.size))
        hashes, counts = word_hashes(self.texts)
        self.counts = counts
        starts = np.cumsum(counts) - counts
        plans: dict[tuple[int, int, int], list[tuple[int, np.ndarray]]] = {}
        for k, n in enumerate(counts.tolist()):
            for width, step, radius, offsets in self._windows(n):
                plans.setdefault((width, step, radius), []).append((k, offsets))
        self.groups = []
        for (width, step, radius), own in sorted(plans.items()):
            marks = []
            for k, offsets in own:
                pairs = features(hashes[starts[k] : starts[k] + counts[k]])
                marks.append(fingerprints(_lane_sums(pairs), offsets, max(width - 1, 1)))
            items_ = np.repeat([k for k, _ in own], [len(o) for _, o in own])
            self.groups.append(_Group(width, step, items_, np.concatenate([o for _, o in own]), np.concatenate(marks), radius))

    def _windows(self, n: int) -> list[tuple[int, int, int, np.ndarray]]:
        """(width, step, radius, offsets) of the windows of an item of ``n`` words."""
        rule = self.rule
        if n <= SHORT:
            return [(n, 1, 0, np.zeros(1, np.int64))] if n else []
        out = []
        for width in {self._width(n), self._width(n // 2 if n > MOST_WORDS else n)}:
            room = n - width + 1
            bases = np.append(np.arange(0, max(room - rule.stride, 0), width), max(room - rule.stride, 0))
            out.append((width, rule.stride, rule.radius, np.unique(bases[:, None] + np.arange(min(rule.stride, room)))))
        place = GUARD + rule.stride - 1
        bases = (n % place) // 2 + place * np.arange(n // place)
        out.append((GUARD, rule.stride, 0, (bases[:, None] + np.arange(rule.stride)).ravel()))
        return out

    def _width(self, n: int) -> int:
        """The largest window size of a geometric series that leaves room for a stride of offsets."""
        most = min(n - self.rule.stride + 1, MOST_WORDS)
        width = float(GUARD + 1)
        while int(width * self.rule.growth) <= most:
            width *= self.rule.growth
        return int(width)


def features(words: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring word pairs; of a single word, the word with nothing behind it."""
    if len(words) < 2:
        return shingle_hashes(words, np.array([len(words)]), 2)[0]
    return shingle_hashes(words, np.array([len(words)]), 2, short=False)[0]


def weighted(words: list[str], size: int) -> Counter:
    return Counter(" ".join(words[k : k + size]) for k in range(max(len(words) - size + 1, 1))) if words else Counter()


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    either = sum(a.values()) + sum(b.values()) - both
    return both / either if either else 0.0


def best_passage(words: list[str], low: int, high: int, n: int, wanted: Counter, rule: Rule) -> float:
    """The best similarity to ``wanted`` of the ``n`` words from a start of ``low`` to ``high``."""
    size, whole = min(rule.size, n), sum(wanted.values())
    runs = [" ".join(words[k : k + size]) for k in range(low, min(high + n, len(words)) - size + 1)]
    if sum(x in wanted for x in runs) < rule.similarity * whole:
        return 0.0
    have: Counter = Counter()
    both, stop, best = 0, 0, 0.0
    for start in range(min(high - low + 1, len(runs))):
        for x in runs[stop : start + n - size + 1]:
            both += have[x] < wanted[x]
            have[x] += 1
        stop = min(start + n - size + 1, len(runs))
        best = max(best, both / (whole + stop - start - both))
        have[runs[start]] -= 1
        both -= have[runs[start]] < wanted[runs[start]]
    return best


def find(texts: list[str], index: Index) -> list[tuple[int, int, float]]:
    """(text, item, best similarity) of every item that some passage of a text reaches."""
    rule = index.rule
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    pairs = shingle_hashes(np.append(hashes, np.uint64(0)), np.array([len(hashes) + 1]), 2, short=False)[0]
    sums = _lane_sums(pairs)
    alone = _lane_sums(shingle_hashes(hashes, np.ones(len(hashes), np.int64), 2)[0]) if any(g.width == 1 for g in index.groups) else sums
    best: dict[tuple[int, int], float] = {}
    places: dict[int, dict[int, set[int]]] = {}
    for group in index.groups:
        room = np.where(counts >= group.width, (counts - group.width) // group.step + 1, 0)
        firsts = np.repeat(ends - counts - group.step * (np.cumsum(room) - room), room) + group.step * np.arange(int(room.sum()))
        owner = np.repeat(np.arange(len(counts)), room)
        prints = fingerprints(sums, firsts, group.width - 1) if group.width > 1 else fingerprints(alone, firsts, 1)
        window, member = group.near(prints)
        docs = owner[window]
        at = firsts[window] - (ends - counts)[docs] - group.offsets[member]
        for doc, item, start in zip(docs.tolist(), group.items[member].tolist(), at.tolist()):
            places.setdefault(doc, {}).setdefault(item, set()).add(start)
    for doc, found in places.items():
        words = words_of(texts[doc])
        for item, starts in found.items():
            n = int(index.counts[item])
            reach = rule.slack + int(np.ceil(n * (1 - rule.similarity)))
            spans: list[list[int]] = []
            for at in sorted(starts):
                # Past the last start of a full passage, only near the aligned place.
                low, high = max(at - reach, 0), max(at + rule.slack, min(at + reach, len(words) - n), 0)
                if spans and low <= spans[-1][1] + 1:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
            s = max(best_passage(words, low, high, n, index.wanted(item), rule) for low, high in spans)
            if s >= rule.similarity:
                best[doc, item] = s
    return sorted((d, i, s) for (d, i), s in best.items())


#: The worker's latest index, by the name of its block: tasks that run one after another share it.
_BUILT: dict[str, Index] = {}


def _built(name: str, block: Broadcast, rule: Rule) -> Index:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Index(block.value, rule)
    return _BUILT[name]


def _marker(blocks: list[tuple[str, Broadcast]], rule: Rule):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        texts: list[str] = []
        chars = 0

        def finished() -> Iterator[pa.RecordBatch]:
            found: list[dict[int, float]] = [{} for _ in texts]
            for name, block in blocks:
                index = _built(name, block, rule)
                for a, b in chunks(texts, map(len, texts), 2_000_000):
                    for doc, item, s in find(texts[a:b], index):
                        found[a + doc][index.ids[item]] = max(s, found[a + doc].get(index.ids[item], 0.0))
            at = 0
            for batch in held:
                ids, best = batch.column("item_ids").to_pylist(), batch.column("similarity").to_pylist()
                for k in range(batch.num_rows):
                    if own := found[at + k]:
                        ids[k], best[k] = sorted({*ids[k], *own}), max(best[k] or 0.0, *own.values())
                at += batch.num_rows
                columns = [batch.column(k) for k in range(batch.num_columns - 2)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64())], batch.schema.names)

        for batch in batches:
            own = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            held.append(batch)
            texts += own
            chars += sum(map(len, own))
            if chars >= rule.text_chars or len(blocks) == 1:
                yield from finished()
                held, texts, chars = [], [], 0
        if held:
            yield from finished()

    return mark


def contaminated(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs`` with item_ids (sorted list of leaked items) and similarity (the best, or null) added.

    ``benchmark`` has item_id and text. Its items go to the executors in blocks of ``item_bytes`` of text, each
    of which is one index; a worker holds one index and ``text_chars`` of documents at a time. Beyond
    ``pass_bytes`` of items the documents are gone through again, from a written table. A null or blank item
    matches nothing, and neither does a null or empty document. Rows keep all their columns; columns named
    item_ids or similarity are replaced. An item of fewer words than a shingle has its whole sequence as its
    single shingle, so an item of one word is found wherever the word stands.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // rule.item_bytes))
    together = max(1, rule.pass_bytes // rule.item_bytes)
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    kept = [c for c in docs.columns if c not in ("item_ids", "similarity")]
    out = docs.select(*kept, F.array().cast("array<bigint>").alias("item_ids"), F.lit(None).cast("double").alias("similarity"))
    for first in range(0, blocks, together):
        own: dict[int, list] = {k: [] for k in range(first, min(first + together, blocks))}
        for r in numbered.filter(F.col("block").between(first, first + together - 1)).collect():  # pass_bytes of text
            own[r["block"]].append((r["item_id"], r["text"]))
        shared = [(uuid4().hex, spark.sparkContext.broadcast(sorted(rows))) for rows in own.values()]
        if first:
            out = write_table(out, "marked")[0]
        out = out.mapInArrow(_marker(shared, rule), out.schema)
    return out


def op9_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("leaked"), "item_ids", F.round("similarity", 6).alias("similarity"))
