import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import tiff as M


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_packers_round_trip(data):
    assert M.unpack_bits(M.pack_bits(data), len(data)) == data
    assert M.unpack_lzw(M.pack_lzw(data), len(data)) == data


def test_lzw_beyond_a_full_table():
    data = np.random.default_rng(1).integers(0, 40, 60000).astype(np.uint8).tobytes()
    assert M.unpack_lzw(M.pack_lzw(data), len(data)) == data
    # from the specification: 7 7 7 8 8 7 7 6 6
    assert list(M._bits(M.pack_lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])))) == [256, 7, 258, 8, 8, 258, 6, 6]


@pytest.mark.parametrize("compression", [M.NONE, M.LZW, M.DEFLATE, M.OLD_DEFLATE, M.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_layouts(compression, predictor, tile, order):
    rng = np.random.default_rng(0)
    pages = [rng.integers(0, 256, s).astype(np.uint8) for s in ((1, 1), (70, 33), (16, 200))] + [np.zeros((130, 40), np.uint8)]
    data = M.write_pages(pages, compression, predictor, 48, tile, order)
    found = list(M.read_pages(data))
    assert [p.number for p in found] == [0, 1, 2, 3] and not any(p.error for p in found)
    for page, own in zip(found, pages, strict=True):
        assert (page.samples[:, :, 0] == own).all() and page.compression == compression


def colour(planar):
    """A 16-bit picture with three samples, big-endian, without compression."""
    pixels = (np.arange(2 * 3 * 3).reshape(2, 3, 3) * 1000).astype(">u2")
    body = pixels.tobytes() if planar == 1 else b"".join(pixels[:, :, k].tobytes() for k in range(3))
    n = 1 if planar == 1 else 3
    out = bytearray(b"MM\0*\0\0\0\0" + body)
    places = {M.BITS: (3, struct.pack(">3H", 16, 16, 16)), M.STRIP_OFFSETS: (4, struct.pack(f">{n}I", *(8 + len(body) // n * i for i in range(n)))), M.STRIP_COUNTS: (4, struct.pack(f">{n}I", *[len(body) // n] * n))}
    rows = []
    for tag, value in ((M.WIDTH, 3), (M.HEIGHT, 2), (M.BITS, None), (M.COMPRESSION, 1), (M.PHOTOMETRIC, 2), (M.STRIP_OFFSETS, None), (M.SAMPLES, 3), (M.ROWS_PER_STRIP, 2), (M.STRIP_COUNTS, None), (M.PLANAR, planar)):
        kind, raw = places.get(tag, (4, struct.pack(">I", value or 0)))
        count = len(raw) // (2 if kind == 3 else 4)
        if len(raw) > 4:
            out += raw
            raw = struct.pack(">I", len(out) - len(raw))
        rows.append(struct.pack(">HHI", tag, kind, count) + raw)
    struct.pack_into(">I", out, 4, len(out))
    return bytes(out + struct.pack(">H", len(rows)) + b"".join(rows) + b"\0" * 4), pixels


@pytest.mark.parametrize("planar", [1, 2])
def test_colour(planar):
    data, pixels = colour(planar)
    (page,) = M.read_pages(data)
    assert page.error is None and (page.samples == pixels).all()


def with_tag(data, tag, value):
    """The file with another value of a tag of its first directory."""
    out = bytearray(data)
    (at,) = struct.unpack_from("<I", out, 4)
    for i in range(struct.unpack_from("<H", out, at)[0]):
        if struct.unpack_from("<H", out, at + 2 + 12 * i)[0] == tag:
            struct.pack_into("<I", out, at + 10 + 12 * i, value)
    return bytes(out)


def test_hostile_files(spark):
    rng = np.random.default_rng(3)
    plain = M.write_pages([rng.integers(0, 256, (20, 30)).astype(np.uint8)], M.NONE)
    packed = M.write_pages([np.zeros((4000, 4000), np.uint8)], strip_rows=4000)
    tiled = M.write_pages([rng.integers(0, 256, (20, 30)).astype(np.uint8)], tile=(16, 16))
    bad = [with_tag(plain, M.ROWS_PER_STRIP, 0), with_tag(with_tag(plain, M.WIDTH, 2_000_000), M.HEIGHT, 2_000_000), with_tag(plain, M.SAMPLES, 0), with_tag(plain, M.ROWS_PER_STRIP, 1), with_tag(tiled, M.TILE_WIDTH, 0), with_tag(plain, M.WIDTH, 0xFFFFFFFF), with_tag(plain, M.STRIP_OFFSETS, 1 << 31), with_tag(plain, M.STRIP_COUNTS, 0)]
    for data in bad:
        (page,) = M.read_pages(data)
        assert page.error and page.samples is None
    (page,) = M.read_pages(packed, most=1 << 20)
    assert "limit" in page.error
    (page,) = M.read_pages(packed)
    assert page.error is None and page.samples.shape == (4000, 4000, 1)
    bomb = with_tag(packed, M.HEIGHT, 8)  # the strip holds far more than the page
    (page,) = M.read_pages(bomb)
    assert page.error is None and page.samples.shape == (8, 4000, 1) and len(M.inflate(zlib.compress(b"0" * 1_000_000), 100)) == 100
    df = spark.createDataFrame(list(enumerate([*bad, plain])), "id long, media binary")
    assert {r.id for r in M.tiff_pages(df).where("error is null").collect()} == {len(bad)} and M.tiff_pages(df).count() == len(bad) + 1


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_broken_bytes_never_crash(data):
    good = bytearray(M.write_pages([np.arange(60, dtype=np.uint8).reshape(6, 10)], data.draw(st.sampled_from([M.NONE, M.LZW, M.DEFLATE, M.PACKBITS]))))
    for _ in range(data.draw(st.integers(1, 4))):
        good[data.draw(st.integers(4, len(good) - 1))] = data.draw(st.integers(0, 255))
    assert all(p.error or p.samples is not None for p in M.read_pages(bytes(good), most=1 << 20))


def test_pages_as_rows(spark):
    good = M.write_pages([np.zeros((2, 3), np.uint8), np.ones((4, 5), np.uint8)])
    loop = bytearray(M.write_pages([np.zeros((2, 3), np.uint8)]))
    loop[-4:] = loop[4:8]  # the directory names itself as the next one
    cut = good[: len(good) - 30]
    files = [good, None, b"", b"GIF89a..", bytes(loop), cut, good]
    df = spark.createDataFrame([(i, f, "w") for i, f in enumerate(files)], "id long, media binary, WIDTH string")
    rows = sorted(M.tiff_pages(df).collect(), key=lambda r: (r.id, r.page))
    assert [(r.id, r.page, r.width, r.height, r.error is None) for r in rows if r.id != 5] == [(0, 0, 3, 2, True), (0, 1, 5, 4, True), (3, 0, None, None, False), (4, 0, 3, 2, True), (6, 0, 3, 2, True), (6, 1, 5, 4, True)]
    assert any(r.error for r in rows if r.id == 5)
    assert bytes(rows[1].samples) == b"\1" * 20
    assert M.tiff_pages(df.limit(0)).count() == 0
    assert M.read_payloads(df).where("payload_bytes is null").count() == 3  # null, GIF and the cut file


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in M.op3_tiff(spark, sf_dir).collect():
        payload = texts[r.doc_id].ljust(max(192, -(-len(texts[r.doc_id]) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), zlib.crc32(payload[-16:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.feature


def test_odd_texts(spark):
    docs = spark.createDataFrame([(0, None, 1), (1, "", 2), (2, "é" * 200000, 3), (3, "", 4)], "doc_id long, text string, n_bytes int")
    rows = sorted(M.read_payloads(M.store_texts(docs).drop("text")).drop("media").collect())
    assert [(r.n_bytes, r.payload_bytes) for r in rows] == [(0, 192), (0, 192), (400000, 400128), (0, 192)]
    assert rows[0].media_sha256 == rows[1].media_sha256 == rows[3].media_sha256
