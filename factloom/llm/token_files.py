"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code.

A file is a run of blocks. Every block carries its own table of token ids by falling frequency (over
all of the block's tokens) and codes a token as its rank in one to four little-endian bytes. The byte
counts, two bits each, stand apart from the data in control bytes, so a decoder looks four values up at
once. Blocks are rows of a Parquet container: Spark's committer then makes the output of a lost
executor's task whole or absent, on any store. Blocks follow doc_id in order, in and across files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.segments import chunks, encoder
from factloom.llm.workspace import write_table

BLOCK_SCHEMA = "part int, base long, doc_ids array<bigint>, lengths array<bigint>, ranked binary, control binary, data binary"

# Byte counts of the four values under each control byte, their offsets, and the bytes they take together.
_SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
_OFFSETS = np.cumsum(_SIZES, 1) - _SIZES
_TOTALS = _SIZES.sum(1)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.asarray(values, np.uint32)
    sizes = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = sizes - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    places = np.cumsum(sizes, dtype=np.int64) - sizes
    data = np.zeros(int(sizes.sum(dtype=np.int64)), np.uint8)
    for k in range(4):
        some = sizes > k
        data[places[some] + k] = (values[some] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def unpack_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The inverse of :func:`pack_values`, by table lookup of whole control bytes."""
    codes = np.frombuffer(control, np.uint8)
    # Unused codes of the last control byte claim a byte each; a margin keeps their reads inside.
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(20, np.uint8)]).astype(np.uint32)
    totals = _TOTALS[codes]
    places = ((np.cumsum(totals) - totals)[:, None] + _OFFSETS[codes]).ravel()[:count]
    sizes = _SIZES[codes].ravel()[:count]
    wide = raw[places] | raw[places + 1] << np.uint32(8) | raw[places + 2] << np.uint32(16) | raw[places + 3] << np.uint32(24)
    return wide & _MASKS[sizes]


def rank_by_frequency(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids by falling count (ties: smaller id first), and the rank of every id."""
    counts = np.bincount(ids)  # as long as the vocabulary, at most
    found = np.flatnonzero(counts)
    order = found[np.lexsort((found, -counts[found]))].astype(np.uint32)
    ranks = np.zeros(len(counts), np.uint32)
    ranks[order] = np.arange(len(order), dtype=np.uint32)
    return order, ranks[ids]


def write_token_files(docs: DataFrame, tokenizer_file: str, end_id: int, block_tokens: int = 1 << 20) -> DataFrame:
    """Encode ``doc_id, text`` of every row and write the blocks; gives the table of blocks read back.

    Null texts count as empty, every document ends in ``end_id``; rows of one doc_id stay separate
    documents, in the order of their texts' hashes, and may stand in several files; a null doc_id stands first. A document longer than a block has a block of its own. Other columns are
    ignored. Memory of a task is bounded by ``block_tokens`` and the longest text.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, base = encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        held_ids: list[np.ndarray] = []
        held_docs: list[int | None] = []
        held_sizes: list[int] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal base, held
            ids = np.concatenate(held_ids)
            ranked, ranks = rank_by_frequency(ids)
            control, data = pack_values(ranks)
            row = [[part], [base], [list(held_docs)], [list(held_sizes)], [ranked.astype("<u4").tobytes()], [control], [data]]
            base += held
            held = 0
            held_ids.clear(), held_docs.clear(), held_sizes.clear()
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], ["part", "base", "doc_ids", "lengths", "ranked", "control", "data"])

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts, map(len, texts), 1_000_000):
                ids, sizes = coder.encode(texts[a:b])
                ends = np.cumsum(sizes)
                for name, stop, size in zip(names[a:b], ends.tolist(), sizes.tolist()):
                    held_ids += (ids[stop - size : stop], np.array([end_id], np.uint32))
                    held_docs.append(name)
                    held_sizes.append(size + 1)
                    held += size + 1
                    if held >= block_tokens:
                        yield block()
        if held:
            yield block()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    return write_table(ordered.mapInArrow(encode, BLOCK_SCHEMA), "tokens", compression="uncompressed")[0]


def block_ids(block: dict) -> np.ndarray:
    """All token ids of one block row."""
    ranked = np.frombuffer(block["ranked"], "<u4")
    return ranked[unpack_values(block["control"], block["data"], int(sum(block["lengths"])))]


def token_index(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """One row per document, from the written files: doc_id, start, n_tokens, ids_crc32."""
    # One row per written part: their number is that of the write's tasks, not of the documents.
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    starts, total = {}, 0
    for row in sorted(sizes, key=lambda r: r["part"]):
        starts[row["part"]] = total
        total += row["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.slice(k, 1).to_pylist()[0]
                ids = block_ids(block).astype("<u4")
                sizes = np.array(block["lengths"], np.int64)
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist())]
                first = starts[block["part"]] + block["base"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block["doc_ids"], pa.int64()), pa.array(first + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.select("part", "base", "doc_ids", "lengths", "ranked", "control", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` through byte_bpe_50k, written as token files and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_index(spark, write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), 0))
