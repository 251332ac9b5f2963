"""Best-two-fit packing of token sequences.

Bins are planned on the histogram of lengths, which has at most ``capacity`` entries however many
documents there are: documents of one length are interchangeable. A bin is filled greedily, largest
fitting length first; then its smallest document gives way to the two unpacked ones that fill the gap
this opens more tightly. A bin's pattern is used as often as the counts allow, so the plan stays small;
then every piece finds its place by its number among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.segments import chunks, encoder
from factloom.llm.ranks import digits_of, radix_ranks
from factloom.llm.workspace import write_table

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int = CAPACITY, fold: bool = False) -> DataFrame:
    """Pieces of every document's ids plus ``end_id``: only documents longer than ``capacity`` are cut.

    fold: the tokenizer lower-cases. Null texts count as empty (one piece with the end id alone). Every row is a document of its own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_file, fold)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts, map(len, texts), 1_000_000):
                ids, sizes = coder.encode(texts[a:b])
                stops = np.cumsum(sizes)
                rows = []
                for name, stop, size in zip(names[a:b], stops.tolist(), sizes.tolist()):
                    own = np.append(ids[stop - size : stop], np.uint32(end_id)).astype("<u4")
                    for piece, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        rows.append((name, piece, at, len(part), zlib.crc32(part.tobytes())))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(how often, lengths of a bin) pairs that use up ``counts`` of documents by length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    lengths = np.arange(capacity + 1)
    plan = []
    while True:
        free = left.copy()  # what is unpacked while this bin is filled
        under = np.maximum.accumulate(np.where(free > 0, lengths, 0))  # the largest unpacked length up to each
        if not (largest := int(under[capacity])):
            return plan

        def take(length: int, step: int) -> None:
            before = free[length]
            free[length] -= step
            if (before > 0) != (free[length] > 0):
                under[:] = np.maximum.accumulate(np.where(free > 0, lengths, 0))

        bin_, gap = [largest], capacity - largest
        take(largest, 1)
        while gap and (fit := int(under[gap])):
            bin_.append(fit)
            take(fit, 1)
            gap -= fit
        if gap and len(bin_) > 1:
            smallest = min(bin_)
            room = gap + smallest
            firsts = lengths[1:room][free[1:room] > 0]
            seconds = under[room - firsts]
            same = (seconds == firsts) & (free[firsts] < 2)  # one document can't serve twice
            seconds = np.where(same, under[np.maximum(np.minimum(firsts, room - firsts + 1) - 1, 0)], seconds)
            sums = np.where(seconds > 0, firsts + seconds, 0)
            if len(sums) and sums.max() > smallest:
                best = int(np.argmax(sums))
                bin_.remove(smallest)
                bin_ += [int(firsts[best]), int(seconds[best])]
        used, times = np.unique(bin_, return_counts=True)
        often = int((left[used] // times).min())
        left[used] -= often * times
        plan.append((often, bin_))


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece a ``sequence_id`` and an ``offset``.

    ``pieces`` is a written table; it is read three times. The histogram and the plan on the
    driver are bounded by ``capacity``, whatever the number of pieces.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    given: dict[int, int] = {}
    slots, first = [], 0
    for often, bin_ in plan_bins(histogram, capacity):
        at = 0
        for length in sorted(bin_, reverse=True):
            slots.append((length, given.get(length, 0), first, at))
            given[length] = given.get(length, 0) + often
            at += length
        first += often
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    keys = (table[:, 0] << 44) | table[:, 1]  # pieces of one length: fewer than 2 to the power 44

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) | rank, "right") - 1
            own = table[at]
            columns = [batch.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own[:, 2] + rank - own[:, 1], pa.int64()), pa.array(own[:, 3], pa.int64())], [f.name for f in list(batch.schema)[:5]] + ["sequence_id", "offset"])

    # Ranks by what a piece is, not by where it stands, so every run places it alike.
    digits = F.concat(digits_of(F.col("doc_id")), digits_of(F.col("piece")), F.lpad(F.hex("ids_crc32"), 8, "0"), digits_of(F.col("start")))
    ranked = radix_ranks(pieces, "length", digits, "rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int = CAPACITY, fold: bool = False) -> DataFrame:
    """Pieces of ``docs`` (columns doc_id, text) with their places; an empty table gives no rows."""
    return place_pieces(write_table(token_pieces(docs, tokenizer_file, end_id, capacity, fold), "pieces")[0], capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 4096 tokens of word_bpe_49k, end id 1."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 1, fold=True)
