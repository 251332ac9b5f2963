"""Media columns: Netpbm and BMP images as numpy arrays, area-resized tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.segments import chunks
from factloom.llm.workspace import write_table


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """Binary PGM (height x width) or PPM (height x width x 3) of 8-bit samples."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """The pixels of a PBM, PGM or PPM, plain or binary, with at most 255 levels (samples stay as stored;
    bitmaps give 0 for black and 255 for white). ValueError if it is none or too short.
    """
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    fields: list[int] = []
    at = 2
    while len(fields) < (2 if kind in (b"P1", b"P4") else 3):
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) if data[at : at + 1] == b"#" else at + 1
        stop = at
        while data[stop : stop + 1].isdigit():
            stop += 1
        fields.append(int(data[at:stop]))
        at = stop
    width, height = fields[:2]
    if len(fields) > 2 and fields[2] > 255:
        raise ValueError("more than 8 bits a sample")
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    count = int(np.prod(shape))
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, height * (-(-width // 8)), at + 1).reshape(height, -1)
        return (1 - np.unpackbits(rows, 1)[:, :width]) * np.uint8(255)
    if kind in (b"P5", b"P6"):
        return np.frombuffer(data, np.uint8, count, at + 1).reshape(shape)
    body = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
    if kind == b"P1":
        bits = np.frombuffer(b"".join(body.split()), np.uint8)[:count] - 48
        return ((1 - bits) * np.uint8(255)).reshape(shape)
    return np.array(body.split()[:count], np.uint8).reshape(shape)


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed 24-bit BMP, bottom row first, of height x width x 3 samples in RGB."""
    height, width, _ = pixels.shape
    rows = np.zeros((height, -(-width * 3 // 4) * 4), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    head = np.array([40, width, height, 1 | 24 << 16, 0, rows.size, 2835, 2835, 0, 0], "<u4").tobytes()
    return b"BM" + np.array([54 + rows.size, 0, 54], "<u4").tobytes() + head + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """RGB pixels of an uncompressed BMP of 8 (palette), 24 or 32 bits; ValueError otherwise."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    first, head = (int(x) for x in np.frombuffer(data, "<u4", 2, 10))
    width, height = (int(x) for x in np.frombuffer(data, "<i4", 2, 18))
    depth, packing = int(np.frombuffer(data, "<u2", 1, 28)[0]), int(np.frombuffer(data, "<u4", 1, 30)[0])
    if packing or depth not in (8, 24, 32):
        raise ValueError(f"BMP with compression {packing}, {depth} bits")
    step = -(-width * depth // 32) * 4
    rows = np.frombuffer(data, np.uint8, step * abs(height), first).reshape(abs(height), step)[:, : width * depth // 8]
    if depth == 8:
        colours = int(np.frombuffer(data, "<u4", 1, 46)[0]) or 256
        pixels = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[rows][:, :, :3]
    else:
        pixels = rows.reshape(abs(height), width, depth // 8)[:, :, :3]
    return (pixels if height < 0 else pixels[::-1])[:, :, ::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def integral_rows(planes: np.ndarray, edges: np.ndarray, band: int = 4096) -> np.ndarray:
    """The integral image of height x width x channels at (fractional) heights, made band by band.

    Its memory is that of a band and of the heights asked for, however tall the image is."""
    low = np.minimum(edges.astype(np.int64), planes.shape[0] - 1)
    part = (edges - low).reshape(-1, 1, 1)
    needed = np.unique(np.concatenate([low, low + 1]))
    kept, above = np.zeros((len(needed), *planes.shape[1:])), np.zeros(planes.shape[1:], np.int64)
    for at in range(0, planes.shape[0], band):
        sums = above + np.cumsum(planes[at : at + band], 0, dtype=np.int64)
        inside = (needed > at) & (needed <= at + len(sums))
        kept[inside] = sums[needed[inside] - at - 1]
        above = sums[-1]
    rows = kept[np.searchsorted(needed, low)] * (1 - part) + kept[np.searchsorted(needed, low + 1)] * part
    return np.concatenate([np.zeros((len(rows), 1, rows.shape[2])), np.cumsum(rows, 1)], 1)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each target pixel is the mean over its exact area, fractions included, from an integral image."""
    planes = pixels if pixels.ndim == 3 else pixels[:, :, None]
    sums = integral_rows(planes, np.linspace(0, planes.shape[0], height + 1))
    edges = np.linspace(0, planes.shape[1], width + 1)
    low = np.minimum(edges.astype(np.int64), planes.shape[1] - 1)
    part = (edges - low).reshape(1, -1, 1)
    sums = np.take(sums, low, 1) * (1 - part) + np.take(sums, low + 1, 1) * part
    area = planes.shape[0] / height * planes.shape[1] / width
    means = np.diff(np.diff(sums, axis=0), axis=1) / area
    out = np.clip(np.floor(means + 0.5), 0, 255).astype(np.uint8)
    return out if pixels.ndim == 3 else out[:, :, 0]


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of RGB in integer thousandths, rounded."""
    return pixels if pixels.ndim == 2 else ((pixels.astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 9 area means is darker than its right neighbour."""
    small = area_resize(grey(pixels), 8, 9).astype(np.int64)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = 16) -> bytes:
    """The area-resized square tile as the bytes of an NPY file."""
    out = io.BytesIO()
    np.lib.format.write_array(out, area_resize(pixels, side, side), (1, 0), allow_pickle=False)
    return out.getvalue()


def media_features(rows: DataFrame, media: str = "media", side: int = 16) -> DataFrame:
    """``rows`` with width, height, dhash and tile (NPY bytes) of the images in ``media``; null where the
    image is null or can't be decoded. Columns of these names are replaced."""
    kept = [c for c in rows.columns if c not in ("width", "height", "dhash", "tile")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(media).to_pylist():
                try:
                    pixels = decode(data)
                    found.append((pixels.shape[1], pixels.shape[0], difference_hash(pixels), npy_tile(pixels, side)))
                except (ValueError, TypeError, IndexError):
                    found.append((None, None, None, None))
            columns = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.binary()))]], [*batch.schema.names, "width", "height", "dhash", "tile"])

    base = rows.select(*kept)
    shape = base.withColumns({"width": F.lit(0), "height": F.lit(0), "dhash": F.lit(""), "tile": F.lit(b"")}).schema
    return base.mapInArrow(look, shape.simpleString()[7:-1].replace(":", " "))


UNIT = 192  # bytes: a row of 64 pixels in three channels


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text as a PPM image 64 pixels wide, padded with spaces to whole rows,
    of which there is one at least; a null text counts as empty."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for a, b in chunks(raw, map(len, raw), 8_000_000):
                images = [encode_netpbm(np.frombuffer(r + b" " * ((-len(r)) % UNIT if r else UNIT), np.uint8).reshape(-1, 64, 3)) for r in raw[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(list(map(len, raw[a:b])), pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as an image, read back, and its features; an empty table gives no rows.

    A very long text is one tall image: a task holds it once as bytes, and what resizing needs comes in bands."""
    stored, _ = write_table(text_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("media").to_pylist():
                payload = decode(data).tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest()))
            tiles = [f"{h}:{zlib.crc32(t):08x}" for h, t in zip(batch.column("dhash").to_pylist(), batch.column("tile").to_pylist())]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, kinds)]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns, pa.array(tiles)], names)

    shape = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media_features(stored).mapInArrow(digest, shape)
