import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm.media import area_resize, decode, decode_bmp, decode_netpbm, difference_hash, encode_bmp, encode_netpbm, integral_rows, media_features, npy_tile, op7_media_columns, text_media

RNG = np.random.default_rng(4)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 20), st.integers(1, 20))
def test_images_round_trip(height, width):
    rgb = RNG.integers(0, 256, (height, width, 3)).astype(np.uint8)
    assert (decode(encode_netpbm(rgb)) == rgb).all() and (decode(encode_bmp(rgb)) == rgb).all()
    assert (decode(encode_netpbm(rgb[:, :, 0])) == rgb[:, :, 0]).all()


def test_plain_and_bitmap_forms():
    assert decode_netpbm(b"P2\n# note\n2 2\n255\n0 1\n2 3\n").tolist() == [[0, 1], [2, 3]]
    assert decode_netpbm(b"P1\n3 2\n1 0 1\n010\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert decode_netpbm(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert decode_netpbm(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    for bad in (b"", b"GIF89a", b"P6\n9 9\n255\nxx", b"P5\n1 1\n65535\nab"):
        with pytest.raises((ValueError, IndexError)):
            decode(bad)
    with pytest.raises(ValueError):
        decode_bmp(b"xx")


def test_area_means_are_exact():
    pixels = RNG.integers(0, 256, (12, 18)).astype(np.uint8)
    means = pixels.reshape(4, 3, 6, 3).mean((1, 3))
    assert (area_resize(pixels, 4, 6) == np.floor(means + 0.5)).all()
    fine = np.repeat(np.repeat(pixels, 5, 0), 7, 1).reshape(5, 12, 7, 18).mean((1, 3))
    assert (area_resize(pixels, 5, 7) == np.floor(fine + 0.5)).mean() > 0.97  # ties may round either way
    assert (area_resize(pixels, 24, 36) == np.repeat(np.repeat(pixels, 2, 0), 2, 1)).all()


def test_hash_and_tile():
    ramp = np.tile(np.arange(90, dtype=np.uint8), (16, 1))
    assert difference_hash(ramp) == "f" * 16 and difference_hash(ramp[:, ::-1]) == "0" * 16
    assert np.load(io.BytesIO(npy_tile(np.zeros((5, 5, 3), np.uint8)))).shape == (16, 16, 3)


def test_features_of_broken_images_are_null(spark):
    rows = spark.createDataFrame([(1, bytearray(encode_bmp(np.zeros((2, 3, 3), np.uint8))), "x"), (2, None, "x"), (3, bytearray(b"P6 nonsense"), "x")], "id int, media binary, dhash string")
    found = {r.id: r for r in media_features(rows).collect()}
    assert (found[1].width, found[1].height) == (3, 2) and found[2].tile is None and found[3].dhash is None


def test_texts_round_trip(spark, edge):
    for row in text_media(edge).collect():
        payload = decode(bytes(row.media)).tobytes()
        assert len(payload) % 192 == 0 and len(payload) > 0 and payload[row.n_bytes :].strip(b" ") == b""


def plain_means(pixels, height, width):
    """Area means by whole-number weights: each pixel is repeated until target areas are whole."""
    planes = pixels.reshape(*pixels.shape[:2], -1).astype(float)
    for axis, n in ((0, height), (1, width)):
        size = planes.shape[axis]
        weights = np.array([[max(0.0, min((i + 1) * size, (k + 1) * n) - max(i * size, k * n)) for k in range(size)] for i in range(n)]) / size
        planes = np.tensordot(weights, planes, (1, axis)) if axis == 0 else np.moveaxis(np.tensordot(weights, planes, (1, 1)), 0, 1)
    return np.floor(planes + 0.5 + 1e-9).reshape(height, width, *pixels.shape[2:])


def plain_feature(payload):
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
    luma = (pixels.astype(int) @ np.array([299, 587, 114]) + 500) // 1000
    small = plain_means(luma, 8, 9)
    bits = "".join("1" if small[y, x] < small[y, x + 1] else "0" for y in range(8) for x in range(8))
    tile = io.BytesIO()
    np.lib.format.write_array(tile, plain_means(pixels, 16, 16).clip(0, 255).astype(np.uint8), (1, 0))
    return f"{int(bits, 2):016x}:{zlib.crc32(tile.getvalue()):08x}"


def test_tall_images_are_resized_in_bands():
    pixels = RNG.integers(0, 256, (10_000, 5, 3)).astype(np.uint8)
    edges = np.linspace(0, 10_000, 17)
    whole, banded = integral_rows(pixels, edges, 20_000), integral_rows(pixels, edges, 777)
    assert np.array_equal(whole, banded) and (area_resize(pixels, 10, 5) == np.floor(pixels.reshape(10, 1000, 5, 3).mean(1) + 0.5)).all()


def test_empty_table(spark, make_docs):
    assert media_features(text_media(make_docs([]))).count() == 0


def test_query_equals_plain_computation(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_media_columns(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        image = b"P6\n64 %d\n255\n" % (len(payload) // 192) + payload
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        if r.doc_id % 10 == 0:
            assert r.feature == plain_feature(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
