"""TIFF media columns (operator 3): write payloads as TIFF, walk image directories, one row per page.

Reader: both byte orders; strips and tiles; compression none, LZW, deflate (both codes), PackBits;
predictors none and horizontal (8, 16 and 32 bits); chunky and planar samples; 1, 2 and 4 bits (one byte a sample).
Writer: 8-bit grey pages of a fixed width, strips or tiles, any of these compressions, with or without predictor.

A page's samples come back in row order without tile padding. Directory cycles end the walk. Whatever is wrong with a
file (data cut short, an unknown scheme, sizes that its data can't fill) is a ValueError of `pages`; `explode_pages` gives
the pages before the fault and then a row with `error` set, so a bad file neither fails a job nor is taken for a shorter
one. No block is inflated beyond the size that the directory states. Null media gives no page. Equal payloads give equal files.

Payload of a text: its UTF-8 bytes, then bytes 0 up to a positive multiple of 64 (null: empty).
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

from .common import slices

#: Fixed values of the format.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 7: "B"}
CLEAR, END = 256, 257

WIDTH, PAGE_ROWS, STRIP_ROWS = 64, 4096, 1024
#: Most bytes that one byte of coded data stands for.
EXPANSION = {NONE: 1, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}
#: A page of more sample bytes than this is an error row: one page must fit a task's memory.
MAX_PAGE_BYTES = 1 << 29
REPEATS = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(to: int):
        for k in range(at, to, 128):
            part = data[k : min(k + 128, to)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in REPEATS.finditer(data):
        literal(m.start())
        at = m.end()
        out.extend((257 - (at - m.start()), data[at - 1]))
    literal(len(data))
    return bytes(out)


def unpack_bits(data: bytes, limit: int) -> bytes:
    """Up to `limit` bytes."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < limit:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:limit])


def packed_codes(codes: list[int], widths: list[int]) -> bytes:
    """Codes of 9 to 12 bits one after the other, most significant bit first, filled up with 0."""
    value, width = np.asarray(codes, np.uint16), np.asarray(widths)
    bits = np.unpackbits(value.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(bits[np.arange(16) >= 16 - width[:, None]]).tobytes()


def lzw(data: bytes) -> bytes:
    """TIFF LZW: most significant bit first, widths change one code early."""
    codes, widths = [CLEAR], [9]
    longer: dict[int, int] = {}  # (code << 8 | byte) -> code
    top, width, run = 258, 9, -1
    for b in data:
        if run < 0:
            run = b
            continue
        key = run << 8 | b
        code = longer.get(key)
        if code is not None:
            run = code
            continue
        codes.append(run)
        widths.append(width)
        longer[key] = top
        top += 1
        if top == 4094:
            codes.append(CLEAR)
            widths.append(width)
            longer, top, width = {}, 258, 9
        elif top >= 1 << width:  # a reader is one entry behind
            width += 1
        run = b
    if run >= 0:
        codes.append(run)
        widths.append(width)
        if top >= (1 << width) - 1 and width < 12:
            width += 1
    return packed_codes([*codes, END], [*widths, width])


def unlzw(data: bytes, limit: int) -> bytes:
    """Up to `limit` bytes."""
    out, table, last, n = [], [], b"", 0
    width, held, bits = 9, 0, 0
    first = [bytes([b]) for b in range(256)] + [b"", b""]
    table = list(first)
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == END or n >= limit:
            break
        if code == CLEAR:
            table, width, last = list(first), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        if last:
            table.append(last + entry[:1])
        out.append(entry)
        n += len(entry)
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)[:limit]


def compress(data: bytes, how: int, level: int) -> bytes:
    return {NONE: lambda: data, LZW: lambda: lzw(data), DEFLATE: lambda: zlib.compress(data, level), OLD_DEFLATE: lambda: zlib.compress(data, level), PACKBITS: lambda: pack_bits(data)}[how]()


def expand(data: bytes, how: int, limit: int) -> bytes:
    """Up to `limit` bytes of a strip or tile."""
    if how == NONE:
        return data[:limit]
    if how == LZW:
        return unlzw(data, limit)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, limit)
    if how == PACKBITS:
        return unpack_bits(data, limit)
    raise ValueError(f"TIFF compression {how} is not supported")


def write(payload: bytes, compression: int = DEFLATE, predictor: int = 1, tile: int = 0, page_rows: int = PAGE_ROWS, strip_rows: int = STRIP_ROWS, level: int = 6, order: str = "<") -> bytes:
    """A multi-page file of 8-bit grey pages, WIDTH wide; len(payload) must be a positive multiple of WIDTH."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    pages = range(0, len(samples), page_rows)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4  # where the offset of the next directory goes
    for number, at in enumerate(pages):
        page = samples[at : at + page_rows]
        if tile:
            rows = -(-len(page) // tile) * tile
            padded = np.zeros((rows, -(-WIDTH // tile) * tile), np.uint8)
            padded[: len(page), :WIDTH] = page
            blocks = [padded[y : y + tile, x : x + tile] for y in range(0, rows, tile) for x in range(0, padded.shape[1], tile)]
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, len(page), strip_rows)]
        places, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            coded = compress(np.ascontiguousarray(block).tobytes(), compression, level)
            places.append(len(out))
            sizes.append(len(coded))
            out += coded
        layout = [(322, 4, [tile]), (323, 4, [tile]), (324, 4, places), (325, 4, sizes)] if tile else [(273, 4, places), (278, 4, [strip_rows]), (279, 4, sizes)]
        tags = sorted([(254, 4, [2]), (256, 4, [WIDTH]), (257, 4, [len(page)]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (297, 3, [number & 0xFFFF, min(len(pages), 0xFFFF)]), (317, 3, [predictor]), *layout])
        stored = []
        for tag, kind, values in tags:
            raw = struct.pack(f"{order}{len(values)}{TYPE_CODES[kind]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                at_value = len(out)
                out += raw
                raw = struct.pack(order + "I", at_value)
            stored.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(stored)) + b"".join(stored)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(media: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """(byte order, tag values) of each image directory."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(media[:2]))
    if order is None or len(media) < 8 or struct.unpack_from(order + "H", media, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, met = struct.unpack_from(order + "I", media, 4)[0], set()
    while at and at not in met:
        met.add(at)
        if at > len(media) - 2:
            raise ValueError("a directory lies outside of the file")
        n = struct.unpack_from(order + "H", media, at)[0]
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", media, at + 2 + 12 * k)
            if kind not in TYPE_CODES:
                continue
            where = at + 10 + 12 * k
            if TYPE_SIZES[kind] * count > 4:
                where = struct.unpack_from(order + "I", media, where)[0]
            tags[tag] = list(struct.unpack_from(f"{order}{count}{TYPE_CODES[kind]}", media, where))
        yield order, tags
        at = struct.unpack_from(order + "I", media, at + 2 + 12 * n)[0]


def pages(media: bytes | None) -> Iterator[dict]:
    """Each page: page, width, height, channels, bits, compression, predictor, samples (native bytes, row order). A fault is a ValueError."""
    if media is None:
        return
    walk = enumerate(directories(media))
    while True:
        try:
            number, (order, tags) = next(walk, (0, (None, None)))
            if order is None:
                return
            page = {"page": number} | page_of(media, order, tags)
        except (struct.error, zlib.error, KeyError, IndexError, ZeroDivisionError, OverflowError, MemoryError) as fault:
            raise ValueError(f"damaged TIFF file: {type(fault).__name__} {fault}") from fault
        yield page


def page_of(media: bytes, order: str, tags: dict[int, list[int]]) -> dict:
    get = lambda tag, default: tags.get(tag, [default])[0]
    width, height, channels, bits = get(256, 0), get(257, 0), get(277, 1), get(258, 1)
    how, predictor, planar = get(259, 1), get(317, 1), get(284, 1)
    if bits not in (1, 2, 4, 8, 16, 32) or predictor not in (1, 2) or (predictor == 2 and bits < 8) or len(set(tags.get(258, [bits]))) > 1 or how not in EXPANSION:
        raise ValueError("sample layout or compression is not supported")
    kind = np.dtype(f"{order}u{max(bits, 8) // 8}")
    tiled = 322 in tags
    bw, bh = (get(322, 0), get(323, 0)) if tiled else (width, min(get(278, height), height) or height)
    if min(width, height, channels, bw, bh) < 1:
        raise ValueError("a size is not positive")
    places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-width // bw), -(-height // bh)
    planes, deep = (channels, 1) if planar == 2 else (1, channels)
    n_blocks = across * down * planes
    if min(len(places), len(sizes)) < n_blocks:
        raise ValueError("too few strips or tiles")
    whole = n_blocks * bw * bh * deep * kind.itemsize
    coded = sum(min(max(n, 0), len(media)) for n in sizes[:n_blocks])
    if width * height * channels * kind.itemsize > EXPANSION[how] * coded * (8 // min(bits, 8)):
        raise ValueError("the data can't fill the stated size")
    if whole > MAX_PAGE_BYTES:
        raise ValueError(f"a page of {whole} bytes is over the limit")
    image = np.zeros((planes, down * bh, across * bw, deep), kind.newbyteorder("="))
    for k in range(n_blocks):
        plane, rest = divmod(k, across * down)
        y, x = divmod(rest, across)
        rows = bh if tiled else min(bh, height - y * bh)
        line = -(-bw * deep * bits // 8)
        raw = expand(bytes(media[places[k] : places[k] + sizes[k]]), how, rows * line)
        if len(raw) < rows * line:
            raise ValueError("a strip or tile is cut short")
        if bits < 8:
            fine = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1).reshape(rows, -1, bits)
            block = (fine @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, : bw * deep].reshape(rows, bw, deep)
        else:
            block = np.frombuffer(raw, kind).reshape(rows, bw, deep).astype(image.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=image.dtype)
        image[plane, y * bh : y * bh + rows, x * bw : x * bw + bw] = block
    image = image[:, :height, :width]
    samples = (image[0] if planes == 1 else np.moveaxis(image[..., 0], 0, -1)).tobytes()
    return {"width": width, "height": height, "channels": channels, "bits": bits, "compression": how, "predictor": predictor, "tiled": tiled, "samples": samples}


#: Ways to write a payload: compression, predictor, tile (0: strips).
SCHEMES = tuple((how, predictor, tile) for how in (DEFLATE, LZW, PACKBITS, NONE) for predictor in (1, 2) for tile in (0, 32))


def scheme_of(payload: bytes) -> tuple[int, int, int]:
    """A scheme by the payload's checksum: all schemes are in use, equal payloads share one."""
    return SCHEMES[zlib.crc32(payload) % len(SCHEMES)]


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)


def text_to_tiff(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: id_col, n_bytes, media (the TIFF file of the text's payload, written as `how` says or else by scheme_of)."""
    src = df.select(id_col, text_col)

    def made(payload: bytes) -> bytes:
        if how:
            return write(payload, **how)
        compression, predictor, tile = scheme_of(payload)
        return write(payload, compression, predictor, tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, 4 << 20):
            payloads = [payload_of(t) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array([n for _, n in payloads], pa.int64()), pa.array([made(p) for p, _ in payloads], pa.binary())], names=[id_col, "n_bytes", "media"])

    return src.mapInArrow(run, f"{id_col} {src.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


PAGE_FIELDS = [
    *((name, pa.int32(), "int") for name in ("page", "width", "height", "channels", "bits", "compression", "predictor")),
    ("tiled", pa.bool_(), "boolean"),
    ("samples", pa.binary(), "binary"),
    ("error", pa.string(), "string"),
]
#: Sample bytes of the rows that are sent on at a time.
BATCH_BYTES = 4 << 20


def page_rows(batches: Iterator[pa.RecordBatch], media: int) -> Iterator[pa.RecordBatch]:
    """The rows of explode_pages: the columns before number `media`, then PAGE_FIELDS."""

    def send(part: pa.RecordBatch, at: list[int], rows: list[dict]) -> pa.RecordBatch:
        take = pa.array(at, pa.int32())
        columns = [part.column(i).take(take) for i in range(media)] + [pa.array([r.get(name) for r in rows], kind) for name, kind, _ in PAGE_FIELDS]
        return pa.record_batch(columns, names=[*part.schema.names[:media], *(f[0] for f in PAGE_FIELDS)])

    for batch in batches:
        for part in slices(iter([batch]), batch.schema.names[media], 1 << 20):
            at, rows, size = [], [], 0
            for i in range(part.num_rows):
                n = 0
                walk = pages(part.column(media)[i].as_py())
                while True:
                    try:
                        if (row := next(walk, None)) is None:
                            break
                    except ValueError as fault:
                        row = {"page": n, "error": str(fault)}
                    at.append(i)
                    rows.append(row)
                    size += len(row.get("samples", b""))
                    n += 1
                    if size >= BATCH_BYTES:
                        yield send(part, at, rows)
                        at, rows, size = [], [], 0
                    if "error" in row:
                        break
            yield send(part, at, rows)


def explode_pages(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page of every media value, in page order: id_col, page, width, height, channels, bits, compression, predictor, tiled, samples, error.

    A fault in a file ends its pages with one row that has only page (the one it struck) and error.
    """
    src = df.select(id_col, media_col)
    return src.mapInArrow(lambda batches: page_rows(batches, 1), f"{id_col} {src.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, _, k in PAGE_FIELDS))


class Reading:
    """What the page rows of one file add up to."""

    def __init__(self):
        self.sha, self.size, self.pages, self.tail, self.counts, self.scheme, self.error = hashlib.sha256(), 0, 0, b"", np.zeros(256, np.int64), None, None

    def add(self, samples: bytes | None, scheme: str, error: str | None) -> None:
        if error is not None:
            self.error = error
            return
        self.sha.update(samples)
        self.size += len(samples)
        self.pages += 1
        self.tail = (self.tail + samples[-64:])[-64:]
        self.counts += np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
        self.scheme = scheme

    def feature(self) -> str:
        """Page count, mean, distinct values and entropy (bits) of the samples, and how they are stored."""
        if self.error is not None:
            return f"error={self.error}"
        share = self.counts[self.counts > 0] / self.size
        mean = (self.counts * np.arange(256)).sum() / self.size
        return f"pages={self.pages};mean={mean:.4f};distinct={len(share)};entropy={-(share * np.log2(share)).sum() + 0.0:.4f};stored={self.scheme}"


def media_digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of text_to_tiff's rows, added up over the page rows that explode_pages makes of them.

    A file's page rows follow each other, so they are added up one by one in the worker that reads them: no shuffle, a few pages in memory.
    """
    hashed = df.select(id_col, "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    names = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
    result = [(id_col, None), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(row: tuple, r: Reading) -> tuple:
            return (row[0], row[1], r.size, r.sha.hexdigest(), zlib.crc32(r.tail), row[2], row[3], r.feature())

        held, reading = None, Reading()
        for batch in page_rows(batches, 4):
            kind = batch.schema.field(0).type
            done = []
            get = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("page", "compression", "predictor", "tiled", "samples", "error")}
            heads = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for k, head in enumerate(heads):
                if get["page"][k] == 0:
                    if held is not None:
                        done.append(finished(held, reading))
                    held, reading = head, Reading()
                reading.add(get["samples"][k], f"{names.get(get['compression'][k])}/{get['predictor'][k]}/{'tiles' if get['tiled'][k] else 'strips'}", get["error"][k])
            if done:
                yield table_of(done, kind)
        if held is not None:
            yield table_of([finished(held, reading)], kind)

    def table_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t or kind) for c, (_, t) in zip(zip(*rows, strict=True), result, strict=True)], names=[n for n, _ in result])

    kind = hashed.schema[id_col].dataType.simpleString()
    return hashed.mapInArrow(run, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
