"""TIFF columns: image directories to rows, one for each page, and a lossless writer.

Read: both byte orders, chains of image directories, strips and tiles, samples of 8 or 16 bits, one or more samples
a pixel (chunky or planar), compression none, LZW, deflate (both numbers) and PackBits, predictors none and horizontal
differencing. What a page needs beyond that makes it a row with an error and no samples; the pages before it stand.
Files may be hostile: before memory is taken for a page, its size is held against what its strips can unpack to at most
and against a limit (MOST_BYTES), and no strip is unpacked further than it may be long.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.shared import annotate, documents, materialize

# Fixed values of the TIFF 6.0 specification.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}  # byte, short, long

#: Side of the query's pages: samples in a row, and rows in a page at most.
ROW = 192
PAGE_ROWS = 256
STRIP_ROWS = 64


#: Bytes that a decoded page may take; a larger one is a row with an error.
MOST_BYTES = 1 << 28
#: Bytes that one stored byte can become at most, as the formats allow: a 12-bit LZW code has 3 837 (the table's longest word), two
#: bytes of PackBits have 128, and deflate needs a byte for 1 032.
_GROWTH = {NONE: 1, LZW: 2560, DEFLATE: 1032, OLD_DEFLATE: 1032, PACKBITS: 64}
#: Decoded bytes of a file's pages that tiff_pages() holds before it hands rows on.
FLUSH_BYTES = 1 << 25


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        to = at + run
        while to < n and to - at < 128 and not (to + 2 < n and data[to] == data[to + 1] == data[to + 2]):
            to += 1
        to = min(to, at + 128)
        out += bytes((to - at - 1,)) + data[at:to]
        at = to
    return bytes(out)


def _bits(data: bytes) -> Iterator[int]:
    """LZW codes: 9 to 12 bits, the highest bit first, widened one code early; from a clear code to the end code."""
    width, held, have, table = 9, 0, 0, 258
    for byte in data:
        held, have = held << 8 | byte, have + 8
        while have >= width:
            have -= width
            code = held >> have & (1 << width) - 1
            held &= (1 << have) - 1
            if code == 257:
                return
            yield code
            if code == 256:
                width, table = 9, 257
            else:
                table += 1
                width = 9 if table < 511 else 10 if table < 1023 else 11 if table < 2047 else 12


def unpack_lzw(data: bytes, size: int) -> bytes:
    out, table, last = bytearray(), [], b""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    for code in _bits(data):
        if code == 256:
            table, last = base[:], b""
            continue
        if not table:
            raise ValueError("LZW data without a clear code")
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        if last:
            table.append(last + word[:1])
        out += word
        last = word
        if len(out) >= size:
            break
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, have, width, table = bytearray(), 0, 0, 9, {}

    def put(code: int) -> None:
        nonlocal held, have
        held, have = held << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(held >> have & 255)
            held &= (1 << have) - 1

    put(256)
    table, word = {bytes((i,)): i for i in range(256)}, b""
    following = 258
    for i in range(len(data)):
        one = data[i : i + 1]
        if word + one in table:
            word += one
            continue
        put(table[word])
        table[word + one] = following
        following += 1
        if following == 4095:
            put(256)
            table, following, width = {bytes((b,)): b for b in range(256)}, 258, 9
        else:
            width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        word = one
    if word:
        put(table[word])
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    put(257)
    if have:
        out.append(held << (8 - have) & 255)
    return bytes(out)


def inflate(data: bytes, size: int) -> bytes:
    """The first `size` bytes that deflate data hold."""
    return zlib.decompressobj().decompress(data, max(1, size))


_UNPACK = {NONE: lambda d, n: d, LZW: unpack_lzw, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}
_PACK = {NONE: lambda d: d, LZW: pack_lzw, DEFLATE: lambda d: zlib.compress(d, 4), OLD_DEFLATE: lambda d: zlib.compress(d, 4)}


def _pack(kind: int, rows: np.ndarray) -> bytes:
    if kind == PACKBITS:  # each row by itself
        return b"".join(pack_bits(r.tobytes()) for r in rows)
    return _PACK[kind](rows.tobytes())


@dataclass
class Page:
    number: int
    width: int | None = None
    height: int | None = None
    compression: int | None = None
    samples: np.ndarray | None = None  # height x width x samples a pixel
    error: str | None = None


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (count,) = struct.unpack_from(f"{order}H", data, at)
    tags = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        if kind in TYPES:
            letter, size = TYPES[kind]
            place = at + 10 + 12 * i
            if n * size > 4:
                (place,) = struct.unpack_from(f"{order}I", data, place)
            tags[tag] = struct.unpack_from(f"{order}{n}{letter}", data, place)
    (following,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * count)
    return tags, following


def _decode(data: bytes, tags: dict[int, tuple], order: str, page: Page, most: int) -> None:
    def one(tag: int, other: int | None = None) -> int | None:
        return tags[tag][0] if tags.get(tag) else other

    width, height, bands = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    page.width, page.height, page.compression = width, height, one(COMPRESSION, NONE)
    bits, predictor = set(tags.get(BITS, (1,))), one(PREDICTOR, 1)
    if page.compression not in _UNPACK or predictor not in (1, 2) or bits not in ({8}, {16}) or not width or not height:
        raise ValueError(f"not supported: compression {page.compression}, predictor {predictor}, bits {sorted(bits)}")
    kind = np.dtype(np.uint8 if bits == {8} else f"{order}u2")
    planes, deep = (bands, 1) if one(PLANAR, 1) == 2 else (1, bands)
    if TILE_OFFSETS in tags:
        wide, high, offsets, counts = one(TILE_WIDTH), one(TILE_HEIGHT), tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        wide, high, offsets, counts = width, min(height, one(ROWS_PER_STRIP, height)), tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    if not wide or not high or not bands:
        raise ValueError("strips, tiles or samples of size zero")
    across, down = -(-width // wide), -(-height // high)
    if len(offsets) != len(counts) or len(offsets) < planes * across * down:
        raise ValueError(f"{len(offsets)} offsets and {len(counts)} sizes for {planes * across * down} strips or tiles")
    offsets, counts = offsets[: planes * across * down], counts[: planes * across * down]
    full = planes * height * width * deep * kind.itemsize
    stored = sum(max(0, min(n, len(data) - at)) for at, n in zip(offsets, counts, strict=True))
    if full > most or wide * high * deep * kind.itemsize > most or full > _GROWTH[page.compression] * stored:
        raise ValueError(f"{width} x {height} pixels need {full} bytes; {stored} bytes are stored, {most} bytes are the limit")
    out = np.zeros((planes, height, width, deep), kind.newbyteorder("="))
    for k, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        plane, cell = divmod(k, across * down)
        row, column = cell // across * high, cell % across * wide
        rows = high if TILE_OFFSETS in tags else min(high, height - row)
        size = rows * wide * deep * kind.itemsize
        raw = _UNPACK[page.compression](data[at : at + n], size)
        if len(raw) < size:
            raise ValueError("a strip or tile is too short")
        block = np.frombuffer(raw, kind, rows * wide * deep).reshape(rows, wide, deep).astype(out.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        out[plane, row : row + rows, column : column + wide] = block[: height - row, : width - column]
    page.samples = np.concatenate(list(out), axis=-1) if planes > 1 else out[0]


def read_pages(data: bytes | None, most: int = MOST_BYTES) -> Iterator[Page]:
    """The pages of a file, in the order of its directories; what can't be read ends with an error row.

    A page of over `most` decoded bytes, or larger than its stored bytes can unpack to, has an error too.
    """
    if not data:
        return
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if order is None or len(data) < 8:
        yield Page(0, error="not a TIFF file")
        return
    at, seen, number = struct.unpack_from(f"{order}I", data, 4)[0], set(), 0
    while at and at not in seen:
        seen.add(at)
        page = Page(number)
        try:
            tags, at = _directory(data, at, order)
        except struct.error:
            page.error, at = "broken directory", 0
        else:
            try:
                _decode(data, tags, order, page, most)
            except (ValueError, LookupError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
                page.error = f"{type(e).__name__}: {e}"
        yield page
        number += 1


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file of grey 8-bit pages (height x width), in strips or in tiles (width, height)."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0" * 4)
    link = 4
    for page in pages:
        height, width = page.shape
        if tile:
            wide, high = tile
            padded = np.zeros((-(-height // high) * high, -(-width // wide) * wide), np.uint8)
            padded[:height, :width] = page
            blocks = [padded[r : r + high, c : c + wide] for r in range(0, len(padded), high) for c in range(0, padded.shape[1], wide)]
        else:
            blocks = [page[r : r + strip_rows] for r in range(0, height, strip_rows)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.uint8(0))
            packed = _pack(compression, block)
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        entries = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8]), (COMPRESSION, [compression]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor])]
        entries += [(TILE_WIDTH, [tile[0]]), (TILE_HEIGHT, [tile[1]]), (TILE_OFFSETS, offsets), (TILE_COUNTS, counts)] if tile else [(STRIP_OFFSETS, offsets), (ROWS_PER_STRIP, [strip_rows]), (STRIP_COUNTS, counts)]
        rows = []
        for tag, values in sorted(entries):
            if len(values) > 1:
                place = len(out)
                out += struct.pack(f"{order}{len(values)}I", *values)
            else:
                place = values[0]
            rows.append(struct.pack(f"{order}HHII", tag, 4, len(values), place))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(rows)) + b"".join(rows)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def page_feature(samples: np.ndarray) -> str:
    """Shape, mean, deviation, and whether each of 8 x 8 cells is brighter than the page."""
    grey = samples.reshape(samples.shape[0], samples.shape[1], -1)[:, :, 0]
    values = grey.astype(np.float64)
    sums = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    sums[1:, 1:] = values.cumsum(0).cumsum(1)
    r, c = (np.linspace(0, n, 9).astype(int) for n in grey.shape)
    low, high = (np.minimum(x[:-1], n - 1) for x, n in ((r, grey.shape[0]), (c, grey.shape[1])))
    down, right = np.maximum(r[1:], low + 1), np.maximum(c[1:], high + 1)
    cells = sums[down][:, right] - sums[low][:, right] - sums[down][:, high] + sums[low][:, high]
    cells /= np.outer(down - low, right - high)
    bits = np.packbits(cells > values.mean()).tobytes().hex()
    return f"{grey.shape[1]}x{grey.shape[0]}:{values.mean():.4f}:{values.std():.4f}:{bits}"


PAGE_FIELDS = [("page", T.IntegerType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("compression", T.IntegerType()), ("channels", T.IntegerType()), ("samples", T.BinaryType()), ("feature", T.StringType()), ("error", T.StringType())]


def tiff_pages(df: DataFrame, media: str = "media", most: int = MOST_BYTES) -> DataFrame:
    """One row for each page of each file, with df's columns (but media; columns named like the new ones are replaced).

    Null and empty media have no page, repeated rows have theirs each, and an empty table gives an empty result. Samples are row-major, the first row at the top, 16-bit ones little-endian; a page that can't be decoded has none
    (one of over `most` bytes among them) and says why in error.
    """
    names = [n for n, _ in PAGE_FIELDS]
    keep = [c for c in df.columns if c.lower() not in {*names, media.lower()}]
    schema = T.StructType([*(df.schema[k] for k in keep), *(T.StructField(n, t) for n, t in PAGE_FIELDS)])

    types = (pa.int32(),) * 5 + (pa.binary(), pa.string(), pa.string())

    def run(batches):
        for batch in batches:

            def rows_of(i: int, rows: list[tuple]) -> pa.RecordBatch:
                columns = [pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True), types, strict=True)]
                return pa.RecordBatch.from_arrays([batch.column(k).take(pa.array([i] * len(rows))) for k in keep] + columns, names=schema.names)

            for i, data in enumerate(batch.column(media)):
                rows, size = [], 0
                for p in read_pages(data.as_py(), most):
                    s = p.samples
                    little = None if s is None else s.astype(s.dtype.newbyteorder("<"), copy=False).tobytes()
                    rows.append((p.number, *(None if x is None or x >= 1 << 31 else x for x in (p.width, p.height, p.compression)), None if s is None else s.shape[2], little, None if s is None else page_feature(s), p.error))
                    size += len(little or b"") + 256
                    if size >= FLUSH_BYTES:
                        yield rows_of(i, rows)
                        rows, size = [], 0
                if rows:
                    yield rows_of(i, rows)

    return df.mapInArrow(run, schema)


def text_pages(data: bytes) -> list[np.ndarray]:
    """The text, filled up with spaces to full rows (one at least), as pages."""
    size = max(ROW, -(-len(data) // ROW) * ROW)
    rows = np.frombuffer(data.ljust(size), np.uint8).reshape(-1, ROW)
    return [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]


def store_texts(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with `n_bytes` and the text as a TIFF file; null as empty."""

    def make():
        return lambda texts: [[len(t or b"") for t in texts], [write_pages(text_pages(t or b"")) for t in texts]]

    return annotate(docs, text, make, [T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())])


def read_payloads(df: DataFrame, media: str = "media") -> DataFrame:
    """df with the digests and features of what its media hold, the pages in order; null media, and files with an error, have none."""
    fields = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]

    def make():
        def one(data):
            pages = list(read_pages(data))
            if data is None or any(p.error for p in pages):
                return (None,) * 6
            payload = b"".join(p.samples.tobytes() for p in pages)
            return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"{len(pages)};" + ";".join(page_feature(p.samples) for p in pages)

        return lambda all_: list(map(list, zip(*map(one, all_), strict=True)))

    return annotate(df, media, make, [T.StructField(n, t) for n, t in fields])


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(store_texts(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_bytes", "media"), "tiff")
    return read_payloads(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES = {"op3_tiff": op3_tiff}
ORACLE: dict[str, str] = {}
