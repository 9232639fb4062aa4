"""TIFF media columns: write texts as TIFF, walk image directories and emit one row per page.

The reader follows the public TIFF 6.0 layout: both byte orders, any number of directories, strips and
tiles, 8- and 16-bit samples (chunky or planar), compressions none (1), LZW (5), deflate (8, 32946) and PackBits (32773), and
predictor 1 (none) or 2 (horizontal differences).
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH = 64
#: Rows of one strip, and edge of a tile, in what the writer makes.
STRIP_ROWS, TILE = 256, 64
#: Of 16 texts, by a hash of their bytes, so many are stored as LZW strips and as PackBits strips; the rest as deflate strips with
#: differences. Texts of every length meet every codec.
LZW_SHARE, PACKBITS_SHARE = 2, 4
#: More than these bytes of pixels are not decoded from one page: the row carries an error instead. No value that Spark can hold
#: is as long, so a text always fits.
PAGE_BYTES = (1 << 31) + WIDTH

_TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}
_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            out.append(len(part[i : i + 128]) - 1)
            out.extend(part[i : i + 128])

    for m in _RUN.finditer(data):
        literal(data[at : m.start()])
        out.append(257 - (m.end() - m.start()))
        out.append(data[m.start()])
        at = m.end()
    literal(data[at:])
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += k + 2
        elif k > 128:
            out += data[i + 1 : i + 2] * (257 - k)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, with the early width change of TIFF."""
    acc, bits, out = 256, 9, bytearray()
    table = {bytes((i,)): i for i in range(256)}
    top, width, prefix = 258, 9, b""
    for k in range(len(data)):
        longer = prefix + data[k : k + 1]
        if longer in table:
            prefix = longer
            continue
        acc, bits = acc << width | table[prefix], bits + width
        table[longer] = top
        top += 1
        if top == 4095:
            acc, bits = acc << width | 256, bits + width
            table = {bytes((i,)): i for i in range(256)}
            top, width = 258, 9
        elif top > (1 << width) - 1:
            width += 1
        if bits > 4096:
            out += (acc >> bits % 8).to_bytes(bits // 8, "big")
            acc, bits = acc & ((1 << bits % 8) - 1), bits % 8
        prefix = data[k : k + 1]
    if prefix:
        acc, bits = acc << width | table[prefix], bits + width
        top += 1
        if top > (1 << width) - 1 and width < 12:
            width += 1
    acc, bits = acc << width | 257, bits + width
    pad = -bits % 8
    return bytes(out + (acc << pad).to_bytes((bits + pad) // 8, "big"))


def lzw_decode(data: bytes, size: int) -> bytes:
    table: list[bytes] = []
    out, have, width, acc, bits, prev = [], 0, 9, 0, 0, b""
    for byte in data:
        acc, bits = acc << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 256:
            table = [bytes((i,)) for i in range(256)] + [b"", b""]
            width, prev = 9, b""
        elif code == 257:
            break
        else:
            if not table:
                raise ValueError("LZW data without a clear code")
            if not prev:
                word = table[code]
            elif code < len(table):
                word = table[code]
                table.append(prev + word[:1])
            elif code == len(table):
                word = prev + prev[:1]
                table.append(word)
            else:
                raise ValueError("LZW code beyond the table")
            out.append(word)
            have += len(word)
            prev = word
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
            if have >= size:
                break
    return b"".join(out)[:size]


_ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1), DEFLATE_OLD: lambda x: zlib.compress(x, 1), PACKBITS: packbits_encode}


def _decompress(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data[:size]
    if how == LZW:
        return lzw_decode(data, size)
    if how == PACKBITS:
        return packbits_decode(data, size)
    if how in (DEFLATE, DEFLATE_OLD):
        return zlib.decompressobj().decompress(data, size) if size else b""
    raise ValueError(f"unknown compression {how}")


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, order: str = "<", strip_rows: int = STRIP_ROWS) -> bytes:
    """A TIFF of 8- or 16-bit pages, each (rows, columns) or (rows, columns, samples)."""
    body, links = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), 4
    for page in pages:
        page = page if page.ndim == 3 else page[:, :, None]
        height, width, samples = page.shape
        depth = page.dtype.itemsize
        blocks = []
        if tile:
            high = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile, samples), page.dtype)
            high[:height, :width] = page
            blocks = [high[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, height, strip_rows)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            data = _ENCODE[compression](block.astype(page.dtype.newbyteorder(order)).tobytes())
            offsets.append(len(body))
            counts.append(len(data))
            body += data + b"\0" * (len(data) % 2)
        tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8 * depth] * samples), (259, 3, [compression]), (262, 3, [2 if samples == 3 else 1]), (277, 3, [samples]), (284, 3, [1]), (317, 3, [predictor])]
        tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, counts)] if tile else [(273, 4, offsets), (278, 4, [strip_rows]), (279, 4, counts)]
        entries = []
        for tag, kind, values in sorted(tags):
            data = struct.pack(f"{order}{len(values)}{_TYPES[kind]}", *values)
            if len(data) > 4:
                entries.append(struct.pack(order + "HHII", tag, kind, len(values), len(body)))
                body += data + b"\0" * (len(data) % 2)
            else:
                entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        struct.pack_into(order + "I", body, links, len(body))
        body += struct.pack(order + "H", len(entries)) + b"".join(entries)
        links = len(body)
        body += b"\0" * 4
    return bytes(body)


def _tags(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (count,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind in _TYPES:
            size = n * struct.calcsize(_TYPES[kind])
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            tags[tag] = list(struct.unpack_from(f"{order}{n}{_TYPES[kind]}", data, place))
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def _pixels(data: bytes, tags: dict[int, list[int]], order: str) -> np.ndarray:
    width, height = tags[256][0], tags[257][0]
    samples, depth = tags.get(277, [1])[0], tags.get(258, [1])[0]
    how, predictor, planar = tags.get(259, [1])[0], tags.get(317, [1])[0], tags.get(284, [1])[0]
    if depth not in (8, 16) or predictor not in (1, 2):
        raise ValueError(f"{depth}-bit samples with predictor {predictor} are not read")
    if width * height * samples * depth // 8 > PAGE_BYTES:
        raise ValueError("page too large")
    kind = np.dtype(np.uint8 if depth == 8 else np.uint16).newbyteorder(order)
    deep, planes = (samples, 1) if planar == 1 else (1, samples)
    tiled = 324 in tags
    high, wide = (tags[323][0], tags[322][0]) if tiled else (min(tags.get(278, [height])[0], height) or 1, width)
    offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-width // wide) if wide else 0, -(-height // high)
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k, (start, n) in enumerate(zip(offsets, counts, strict=True)):
        plane, rest = divmod(k, across * down) if planes > 1 else (0, k)
        y, x = rest // across * high, rest % across * wide
        rows = high if tiled else min(high, height - y)
        size = rows * wide * deep * depth // 8
        raw = _decompress(data[start : start + n], how, size)
        if len(raw) < size:
            raise ValueError("strip or tile is cut short")
        block = np.frombuffer(raw, kind).reshape(rows, wide, deep).astype(out.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        part = block[: height - y, : width - x]
        out[y : y + part.shape[0], x : x + part.shape[1], plane : plane + deep] = part
    return out


def pages(data: bytes) -> Iterator[dict]:
    """Each page of a TIFF in directory order: its layout and its pixels, or what kept it from being read."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        yield {"page": 0, "error": "not a TIFF"}
        return
    (at,), seen, k = struct.unpack_from(order + "I", data, 4), set(), 0
    while at and at not in seen:
        seen.add(at)
        row = {"page": k, "error": None}
        try:
            tags, at = _tags(data, at, order)
        except struct.error:
            yield row | {"error": "directory beyond the end"}
            return
        try:
            row |= {"width": tags[256][0], "height": tags[257][0], "samples": tags.get(277, [1])[0], "bits": tags.get(258, [1])[0], "compression": tags.get(259, [1])[0], "predictor": tags.get(317, [1])[0], "tiled": 324 in tags}
            row["pixels"] = _pixels(data, tags, order)
        except (ValueError, KeyError, struct.error, zlib.error, IndexError, ZeroDivisionError) as e:
            row["error"] = f"{type(e).__name__}: {e}"[:200]
        yield row
        k += 1


def feature(pixels: np.ndarray) -> str:
    """Mean, and a 64-bit average hash over an 8 x 8 grid, in whole numbers."""
    grey = pixels.sum(axis=2, dtype=np.int64) if pixels.ndim == 3 else pixels.astype(np.int64)
    if not grey.size:
        return "0:0000000000000000"
    ys, xs = np.arange(8) * grey.shape[0] // 8, np.arange(8) * grey.shape[1] // 8
    cells = np.add.reduceat(np.add.reduceat(grey, ys, axis=0), xs, axis=1)
    area = np.outer(np.maximum(np.diff(np.r_[ys, grey.shape[0]]), 1), np.maximum(np.diff(np.r_[xs, grey.shape[1]]), 1))
    bits = np.packbits((cells * grey.size > grey.sum() * area).ravel())
    return f"{int(grey.sum()) * 1000 // grey.size}:{bits.tobytes().hex()}"


PAGE_SCHEMA = "page int, width long, height long, samples int, bits int, compression int, predictor int, tiled boolean, page_bytes long, page_sha256 string, tail_crc32 long, feature string, error string"


def tiff_pages(df: DataFrame, media: str = "media", keep: tuple[str, ...] = (), pixels: bool = False) -> DataFrame:
    """One row per page of each TIFF in a binary column, with the columns in keep.

    page_bytes, page_sha256 and tail_crc32 (last 64 bytes) are of the decoded pixels, row by row; pixels adds them
    as a binary column. A null value gives no page. What cannot be read gives a row whose error says why.
    Pages come from one value in one task, so there is no shuffle. Repeated rows give repeated pages, and an empty table no rows.
    """
    common.small_batches(df.sparkSession)
    names = common.fields(PAGE_SCHEMA) + ["pixels"] * pixels
    kept, head = common.kept_names(df, keep, names)
    schema = head + PAGE_SCHEMA + ", pixels binary" * pixels
    kinds = dict(zip(names, [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()], strict=False))

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows, of = [], []
            for i, data in enumerate(batch.column(len(keep)).to_pylist()):
                for page in pages(data) if data is not None else ():
                    if (px := page.pop("pixels", None)) is not None:
                        raw = px.tobytes()
                        page |= {"page_bytes": len(raw), "page_sha256": hashlib.sha256(raw).hexdigest(), "tail_crc32": zlib.crc32(raw[-64:]), "feature": feature(px)}
                        if pixels:
                            page["pixels"] = raw
                    rows.append(page)
                    of.append(i)
            own = [batch.column(k).take(pa.array(of, pa.int32())) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays(own + [pa.array([r.get(n) for r in rows], kinds[n]) for n in names], names=[*kept, *names])

        return step

    return df.select(*keep, F.col(media)).mapInArrow(common.batches(start), schema)


def store_text(text: bytes) -> bytes:
    """A text as one grey page 64 samples wide, padded with zeros to whole rows, at least one.

    The codec goes by a hash of the text, so that equal texts are stored alike and each codec has texts of any length.
    """
    payload = text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b"\0")
    page = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    draw = zlib.crc32(text) % 16
    if draw < LZW_SHARE:
        return encode([page], LZW, predictor=1)
    if draw < LZW_SHARE + PACKBITS_SHARE:
        return encode([page], PACKBITS)
    return encode([page], DEFLATE, predictor=2, strip_rows=4096)


def text_to_tiff(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each whole text as a TIFF in column media, with n_bytes, media_bytes and media_sha256; null is empty. An empty table gives an empty one."""
    common.small_batches(df.sparkSession)
    kept, head = common.kept_names(df, keep, ["n_bytes", "media_bytes", "media_sha256", "media"])

    def start():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            raw = common.texts(batch.column(len(keep)))
            media = [store_text(x) for x in raw]
            columns = [pa.array(map(len, raw), pa.int64()), pa.array(map(len, media), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in media], pa.string()), pa.array(media, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keep))] + columns, names=[*kept, "n_bytes", "media_bytes", "media_sha256", "media"])

        return step

    return df.select(*keep, F.col(text)).mapInArrow(common.batches(start), head + "n_bytes long, media_bytes long, media_sha256 string, media binary")


def op1_tiff(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents stored as TIFF and read back; repeated rows give repeated results."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    media = text_to_tiff(docs, "text", ("doc_id",))
    rows = tiff_pages(media, "media", ("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    return rows.withColumnsRenamed({"page_bytes": "payload_bytes", "page_sha256": "payload_sha256"})
