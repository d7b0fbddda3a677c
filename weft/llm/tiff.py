"""TIFF media columns: one row for each page of each file.

The reader walks the chain of image directories (classic and 64-bit files,
either byte order), decodes uncompressed, PackBits, LZW and deflate strips or
tiles, undoes the horizontal and the floating-point predictor and puts the
samples of a page together. The writer stores rows of 8-bit samples over
several pages, each in another of these layouts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.common import arrow_schema, bounded_batches

# Fixed values of the file format: field types as struct letters, tags, compression schemes.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END, FIRST_FREE, TABLE_FULL = 256, 257, 258, 4094

PAGE_COLUMNS = [("page", "int"), ("width", "long"), ("height", "long"), ("bits", "int"), ("samples", "int"), ("compression", "int"), ("predictor", "int"), ("tiled", "boolean"), ("pixels", "binary"), ("error", "string")]
_PAGE_FIELDS = [("page", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("bits", pa.int32()), ("samples", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())]
#: Bytes of pages in one batch that the reader hands on.
BATCH = 4 << 20


class BadFile(ValueError):
    """The bytes aren't a file that this reader knows."""


# --- compression schemes


def packbits_encode(data: bytes) -> bytes:
    """Runs of three bytes or more as runs, all else as literals."""
    x = np.frombuffer(data, dtype=np.uint8)
    if not len(x):
        return b""
    edges = np.flatnonzero(np.diff(x)) + 1
    starts = np.concatenate([[0], edges])
    lengths = np.diff(np.append(starts, len(x)))
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for k in range(at, end, 128):
            part = data[k : min(k + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, n in zip(starts[lengths >= 3].tolist(), lengths[lengths >= 3].tolist(), strict=True):
        literal(start)
        at = start + n
        while n > 1:
            run = min(n, 128)
            out += bytes((257 - run, data[start]))
            n -= run
        if n:
            at -= 1
    literal(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, have = [], 0, 0
    while at < len(data) and have < size:
        n = data[at]
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            part = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
            continue
        out.append(part)
        have += len(part)
    return b"".join(out)


_SINGLES = [bytes((i,)) for i in range(256)]
_BIT = np.arange(12)


def _code_widths() -> np.ndarray:
    """Bits of each code after a clear code: they grow one code before the table would need it."""
    size = FIRST_FREE + np.maximum(np.arange(TABLE_FULL + 3) - 1, 0)
    return np.clip(np.floor(np.log2(size + 1)).astype(np.int64) + 1, 9, 12)


_CODE_WIDTHS = _code_widths()


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; widths change one code early, as the format asks."""
    codes, since = [CLEAR], [0]
    known: dict[int, int] = {}
    free, word = FIRST_FREE, -1
    for byte in data:
        if word < 0:
            word = byte
            continue
        key = word << 8 | byte
        longer = known.get(key)
        if longer is not None:
            word = longer
            continue
        codes.append(word)
        known[key] = free
        free += 1
        word = byte
        if free == TABLE_FULL:
            codes.append(CLEAR)
            since.append(len(codes) - 1)
            known, free = {}, FIRST_FREE
    if word >= 0:
        codes.append(word)
    codes.append(END)
    values, starts = np.array(codes), np.array(since)
    place = np.arange(len(values)) - 1 - np.repeat(starts, np.diff(np.append(starts, len(values))))
    for start in since[1:]:
        place[start] = start - 1 - since[since.index(start) - 1]
    widths = np.where(place < 0, 9, _CODE_WIDTHS[np.maximum(place, 0)])
    shift = widths[:, None] - 1 - _BIT
    return np.packbits(((values[:, None] >> np.maximum(shift, 0)) & 1)[shift >= 0].astype(np.uint8)).tobytes()


def _codes(data: np.ndarray, at: int) -> tuple[list[int], int]:
    """Codes from bit ``at`` to the next clear or end code, and the bit behind that; -1 where the data end."""
    ends = at + np.cumsum(_CODE_WIDTHS)
    n = int(np.searchsorted(ends, (len(data) - 3) * 8, side="right"))
    begin, width = ends[:n] - _CODE_WIDTHS[:n], _CODE_WIDTHS[:n]
    byte = begin >> 3
    window = (data[byte].astype(np.int64) << 16) | (data[byte + 1].astype(np.int64) << 8) | data[byte + 2]
    codes = (window >> (24 - (begin & 7) - width)) & ((1 << width) - 1)
    marks = np.flatnonzero((codes == CLEAR) | (codes == END))
    if not len(marks):
        return codes.tolist(), -1
    k = int(marks[0])
    return codes[:k].tolist(), int(ends[k]) if codes[k] == CLEAR else -1


def lzw_decode(data: bytes, size: int) -> bytes:
    bits = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out: list[bytes] = []
    have, at = 0, 0
    while at >= 0 and have < size:
        codes, at = _codes(bits, at)
        if not codes:
            continue
        table = [*_SINGLES, b"", b""]
        if codes[0] >= CLEAR:
            raise BadFile("LZW data start with no literal")
        before = table[codes[0]]
        out.append(before)
        add, put = table.append, out.append
        for code in codes[1:]:
            try:
                word = table[code]
                add(before + word[:1])
            except IndexError:
                if code > len(table):
                    raise BadFile("LZW code beyond the table") from None
                word = before + before[:1]
                add(word)
            put(word)
            before = word
        have = sum(map(len, out))
    return b"".join(out)


def decompress(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == NONE:
        out = data
    elif scheme == PACKBITS:
        out = packbits_decode(data, size)
    elif scheme == LZW:
        out = lzw_decode(data, size)
    elif scheme in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise BadFile(f"deflate: {e}") from e
    else:
        raise BadFile(f"compression {scheme} isn't known")
    if len(out) < size:
        raise BadFile(f"{len(out)} bytes where a strip or tile has {size}")
    return out[:size]


def compress(data: bytes, scheme: int) -> bytes:
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: zlib.compress}[scheme](data)


def undo_predictor(data: bytes, predictor: int, rows: int, columns: int, samples: int, bits: int, order: str) -> bytes:
    """The samples themselves, from differences to the sample on the left."""
    if predictor == 1:
        return data
    if predictor == 2 and bits in (8, 16, 32, 64):
        kind = np.dtype(f"{order}u{bits // 8}") if bits > 8 else np.dtype("u1")
        x = np.frombuffer(data, dtype=kind).reshape(rows, columns, samples)
        return np.cumsum(x, axis=1, dtype=kind.newbyteorder("=")).astype(kind).tobytes()
    if predictor == 3 and bits in (16, 32, 64):
        x = np.frombuffer(data, dtype=np.uint8).reshape(rows, columns * samples * bits // 8)
        if samples > 1:
            x = x.reshape(rows, -1, samples)
            x = np.cumsum(x, axis=1, dtype=np.uint8).reshape(rows, -1)
        else:
            x = np.cumsum(x, axis=1, dtype=np.uint8)
        planes = x.reshape(rows, bits // 8, columns * samples).transpose(0, 2, 1)
        return (planes if order == ">" else planes[:, :, ::-1]).tobytes()
    raise BadFile(f"predictor {predictor} with {bits} bits isn't known")


# --- reading


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """The fields of each image directory, in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if not order or len(data) < 8:
        raise BadFile("no TIFF header")
    (magic,) = struct.unpack_from(f"{order}H", data, 2)
    if magic not in (42, 43):
        raise BadFile("no TIFF header")
    big = magic == 43
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    inline = 8 if big else 4
    try:
        (at,) = struct.unpack_from(f"{order}{word}", data, 8 if big else 4)
        seen = set()
        while at:
            if at in seen:
                raise BadFile("the chain of directories comes back to itself")
            seen.add(at)
            (n,) = struct.unpack_from(f"{order}{count}", data, at)
            start = at + struct.calcsize(f"{order}{count}")
            fields = {}
            for k in range(n):
                place = start + k * entry
                tag, kind, number = struct.unpack_from(f"{order}HH{word}", data, place)
                letter = TYPES.get(kind)
                if letter is None:
                    continue
                form = f"{order}{number * len(letter)}{letter[0]}"
                value = place + entry - inline
                if struct.calcsize(form) > inline:
                    (value,) = struct.unpack_from(f"{order}{word}", data, value)
                if value + struct.calcsize(form) > len(data):
                    raise BadFile(f"field {tag} lies beyond the end")
                fields[tag] = struct.unpack_from(form, data, value)
            yield order, fields
            (at,) = struct.unpack_from(f"{order}{word}", data, start + n * entry)
    except struct.error as e:
        raise BadFile("the file ends within a directory") from e


def read_page(data: bytes, order: str, fields: dict[int, tuple]) -> dict:
    """One page as a row: its shape, how it was stored, and its samples, row by row."""

    def one(tag: int, default: int | None = None) -> int:
        if tag in fields and len(fields[tag]):
            return int(fields[tag][0])
        if default is None:
            raise BadFile(f"field {tag} is missing")
        return default

    width, height, samples, scheme, predictor = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    depths = set(fields.get(BITS, (1,)))
    if len(depths) != 1:
        raise BadFile("samples of different depths")
    bits = int(depths.pop())
    if bits < 8 and predictor != 1 or bits not in (1, 2, 4, 8, 16, 32, 64):
        raise BadFile(f"{bits} bits a sample aren't known")
    tiled = TILE_OFFSETS in fields
    if tiled:
        wide, high = one(TILE_WIDTH), one(TILE_HEIGHT)
        places, sizes = fields[TILE_OFFSETS], fields.get(TILE_SIZES, ())
    else:
        wide, high = width, min(one(ROWS_PER_STRIP, height), height)
        places, sizes = fields.get(STRIP_OFFSETS, ()), fields.get(STRIP_SIZES, ())
    if not width or not height or not wide or not high:
        raise BadFile("a page without extent")
    planes = samples if one(PLANAR, 1) == 2 and samples > 1 else 1
    each = samples // planes
    across, down = -(-width // wide), -(-height // high)
    if len(places) < across * down * planes or len(sizes) < len(places):
        raise BadFile("strips or tiles are missing")
    row_bytes, part_bytes = -(-width * each * bits // 8), -(-wide * each * bits // 8)
    if (width * each * bits % 8 or wide * each * bits % 8) and across > 1:
        raise BadFile("tiles that don't end on a byte")
    if row_bytes * height * planes > max(1 << 16, len(data) * 4096):
        raise BadFile("the page is larger than its data can make it")
    canvas = np.zeros((planes, height, row_bytes), dtype=np.uint8)
    for k in range(across * down * planes):
        plane, cell = divmod(k, across * down)
        y, x = divmod(cell, across)
        rows = high if tiled else min(high, height - y * high)
        if places[k] + sizes[k] > len(data):
            raise BadFile("a strip or tile lies beyond the end")
        raw = decompress(bytes(data[places[k] : places[k] + sizes[k]]), scheme, part_bytes * rows)
        part = np.frombuffer(undo_predictor(raw, predictor, rows, wide, each, bits, order), dtype=np.uint8).reshape(rows, part_bytes)
        top, left = y * high, x * part_bytes
        target = canvas[plane, top : top + rows, left : left + part_bytes]
        target[...] = part[: target.shape[0], : target.shape[1]]
    if planes > 1:
        unit = max(1, bits // 8)
        if bits < 8:
            raise BadFile("separate planes of parts of bytes")
        canvas = canvas.reshape(planes, height, width, unit).transpose(1, 2, 0, 3)
    return {"width": width, "height": height, "bits": bits, "samples": samples, "compression": scheme, "predictor": predictor, "tiled": tiled, "pixels": canvas.tobytes(), "error": None}


def pages(data: bytes | memoryview | None) -> Iterator[dict]:
    """A row for each page; where a file or page can't be read, a row that says why."""
    blank = {name: None for name, _ in _PAGE_FIELDS}
    number = 0
    try:
        for order, fields in directories(data or b""):
            try:
                yield {"page": number, **read_page(data, order, fields)}
            except BadFile as e:
                yield blank | {"page": number, "error": str(e)}
            number += 1
    except BadFile as e:
        yield blank | {"page": number, "error": str(e)}


def page_batches(batches: Iterator[pa.RecordBatch], content: str) -> Iterator[pa.RecordBatch]:
    """Batches of files to batches of pages; the other columns are repeated, pages of a file stay in order."""
    for batch in batches:
        kept = [i for i, name in enumerate(batch.schema.names) if name != content]
        index, rows, size = [], [], 0
        files = batch.column(content)
        for i in range(batch.num_rows):
            for row in pages(files[i].as_py()):
                index.append(i)
                rows.append(row)
                size += len(row["pixels"] or b"")
                if size > BATCH:
                    yield _page_batch(batch, kept, index, rows)
                    index, rows, size = [], [], 0
        if rows:
            yield _page_batch(batch, kept, index, rows)


def _page_batch(batch: pa.RecordBatch, kept: list[int], index: list[int], rows: list[dict]) -> pa.RecordBatch:
    take = pa.array(index, pa.int64())
    columns = [batch.column(i).take(take) for i in kept] + [pa.array([r[name] for r in rows], kind) for name, kind in _PAGE_FIELDS]
    return pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[i] for i in kept] + [name for name, _ in _PAGE_FIELDS])


def read_pages(files: DataFrame, content: str = "content") -> DataFrame:
    """One row for each page of the TIFF file in ``content``, beside the file's other columns.

    A null, empty, cut or foreign file gives one row with ``error`` and no
    samples; a page that can't be decoded gives such a row and the next page
    follows. A column named like one of the page's is replaced by the page's.
    An empty table gives an empty result. Nothing is shuffled.
    """
    bounded_batches(files.sparkSession)
    taken = {name for name, _ in _PAGE_FIELDS}
    files = files.drop(*(c for c in files.columns if c in taken and c != content))
    schema = arrow_schema(files, *PAGE_COLUMNS, without=(content,))
    return files.mapInArrow(lambda batches: page_batches(batches, content), schema)


# --- writing

#: The layouts that pages take in turn: compression, predictor, strip rows or tile side.
LAYOUTS = ((DEFLATE, 2, 64, 0), (PACKBITS, 1, 64, 0), (LZW, 1, 32, 0), (DEFLATE, 2, 0, 64))


def _page_parts(image: np.ndarray, scheme: int, predictor: int, strip: int, tile: int) -> list[bytes]:
    height, width = image.shape
    if tile:
        padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), dtype=np.uint8)
        padded[:height, :width] = image
        parts = [padded[y : y + tile, x : x + tile] for y in range(0, padded.shape[0], tile) for x in range(0, padded.shape[1], tile)]
    else:
        parts = [image[y : y + strip] for y in range(0, height, strip)]
    if predictor == 2:
        parts = [np.diff(p, axis=1, prepend=np.zeros((len(p), 1), dtype=np.uint8)) for p in parts]
    return [compress(p.tobytes(), scheme) for p in parts]


def write_pages(samples: bytes, width: int = 192, page_rows: int = 256) -> bytes:
    """Grey 8-bit rows of ``width`` samples over pages of ``page_rows`` rows at most; the length must be a multiple of the width."""
    image = np.frombuffer(samples, dtype=np.uint8).reshape(-1, width)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for number, top in enumerate(range(0, len(image), page_rows)):
        page = image[top : top + page_rows]
        scheme, predictor, strip, tile = LAYOUTS[(number + len(page)) % len(LAYOUTS)]
        places, sizes = [], []
        for part in _page_parts(page, scheme, predictor, strip, tile):
            places.append(len(out))
            sizes.append(len(part))
            out += part
            out += b"\0" * (len(out) & 1)
        fields = {WIDTH: [width], HEIGHT: [len(page)], BITS: [8], COMPRESSION: [scheme], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        fields |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILE_OFFSETS: places, TILE_SIZES: sizes} if tile else {STRIP_OFFSETS: places, ROWS_PER_STRIP: [strip], STRIP_SIZES: sizes}
        entries = bytearray()
        for tag in sorted(fields):
            values = fields[tag]
            packed = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                place = len(out)
                out += packed
                packed = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, 4, len(values)) + packed
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)
