import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import tiff
from weft.llm.media_query import media_digests

ONE_BYTE = st.binary(max_size=3000) | st.lists(st.sampled_from([b"a", b"bb", b"the ", b"\0" * 200]), max_size=60).map(b"".join)


@settings(max_examples=60, deadline=None)
@given(ONE_BYTE)
def test_codecs_restore(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_clears_a_full_table():
    data = random.Random(1).randbytes(20_000)
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_known_streams():
    # examples of the format's published description
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.packbits_decode(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.lzw_decode(tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])), 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def build(order, big, fields, blobs):
    """A one-page file: ``fields`` of (tag, type, values); a value that is an index into ``blobs`` is given as ('at', i)."""
    head = struct.pack(f"{order}2sHHHQ", {"<": b"II", ">": b"MM"}[order], 43, 8, 0, 0) if big else struct.pack(f"{order}2sHI", {"<": b"II", ">": b"MM"}[order], 42, 0)
    out, places = bytearray(head), []
    for b in blobs:
        places.append(len(out))
        out += b
    entries, inline, word = b"", 8 if big else 4, "Q" if big else "I"
    for tag, kind, values in sorted(fields):
        values = [places[v[1]] if isinstance(v, tuple) else v for v in values]
        data = struct.pack(f"{order}{len(values)}{tiff.TYPES[kind]}", *values)
        if len(data) > inline:
            at = len(out)
            out += data
            data = struct.pack(f"{order}{word}", at)
        entries += struct.pack(f"{order}HH{word}", tag, kind, len(values)) + data.ljust(inline, b"\0")
    struct.pack_into(f"{order}{word}", out, 8 if big else 4, len(out))
    return bytes(out + struct.pack(f"{order}{'Q' if big else 'H'}", len(fields)) + entries + b"\0" * inline)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_orders_depths_predictors_and_planes(order, big):
    rng = np.random.default_rng(0)
    for bits, predictor in ((8, 2), (16, 2), (32, 2), (32, 3), (64, 3)):
        kind = np.dtype(f"{order}{'f' if predictor == 3 else 'u'}{bits // 8}")
        x = (rng.normal(size=(5, 7)) * 50).astype(kind) if predictor == 3 else rng.integers(0, 250, (5, 7)).astype(kind)
        if predictor == 2:
            native = x.astype(kind.newbyteorder("="))
            raw = np.diff(native, axis=1, prepend=np.zeros((5, 1), native.dtype)).astype(kind).tobytes()
        else:
            planes = x.astype(kind.newbyteorder(">")).view(np.uint8).reshape(5, 7, -1).transpose(0, 2, 1).reshape(5, -1)
            raw = np.diff(planes, axis=1, prepend=np.zeros((5, 1), np.uint8)).tobytes()
        f = [(256, 3, [7]), (257, 3, [5]), (258, 3, [bits]), (259, 3, [8]), (273, 16 if big else 4, [("at", 0)]), (277, 3, [1]), (278, 3, [5]), (279, 4, [len(tiff.compress(raw, 8))]), (317, 3, [predictor])]
        (page,) = tiff.pages(build(order, big, f, [tiff.compress(raw, 8)]))
        assert page["error"] is None and page["pixels"] == x.tobytes(), (bits, predictor)
    rgb = rng.integers(0, 255, (4, 6, 3)).astype(np.uint8)
    strips = [rgb[:, :, k].tobytes() for k in range(3)]
    f = [(256, 3, [6]), (257, 3, [4]), (258, 3, [8, 8, 8]), (273, 4, [("at", 0), ("at", 1), ("at", 2)]), (277, 3, [3]), (278, 3, [4]), (279, 4, [24] * 3), (284, 3, [2])]
    (page,) = tiff.pages(build(order, big, f, strips))
    assert page["pixels"] == rgb.tobytes()


def test_bad_files_say_why(spark):
    good = tiff.write_pages(b"x" * 192 * 600)
    assert [p["page"] for p in tiff.pages(good)] == [0, 1, 2]
    looped = bytearray(good)
    at = len(good) - 4
    first = struct.unpack_from("<I", good, 4)[0]
    struct.pack_into("<I", looped, at, first)
    assert list(tiff.pages(bytes(looped)))[-1]["error"].startswith("the chain")
    for bad in (None, b"", b"II*\0", b"PNG....................", good[: len(good) // 2], b"MM\0*\0\0\xff\xff"):
        rows = list(tiff.pages(bad))
        assert rows[-1]["error"] and rows[-1]["pixels"] is None
    for cut in range(0, len(good), 97):
        list(tiff.pages(good[:cut]))
    files = spark.createDataFrame([(1, good, "a"), (2, None, "b"), (3, good[:9], "c")], "id long, content binary, page string")
    got = tiff.read_pages(files).orderBy("id", "page").collect()
    assert [(r["id"], r["page"], r["error"] is None) for r in got] == [(1, 0, True), (1, 1, True), (1, 2, True), (2, 0, False), (3, 0, False)]
    assert tiff.read_pages(files.limit(0)).count() == 0


def test_digests_of_texts(spark):
    import hashlib
    import zlib

    texts = [None, "", "é" * 96, "a" * 193, "word " * 40_000, "a" * 193]
    rows = media_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        data = (t or "").encode()
        whole = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]))
    assert rows[3][1:] == rows[5][1:] and rows[0][1:] == rows[1][1:] and rows[4]["n_pages"] > 1


def test_print_covers_all_pages(spark):
    texts = ["a" * 50_000 + "z" * 70_000, "a" * 50_000 + "b" * 50_000 + "z" * 20_000, "short text " * 60]
    rows = media_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        data = t.encode() + b" " * (-len(t) % 192)
        at = [k * len(data) // 64 for k in range(65)]
        cells = [sum(data[a:b]) for a, b in zip(at, at[1:])]
        assert int(r["feature"].rsplit("-", 1)[1], 16) == int("".join(str(int(c * 64 > sum(cells))) for c in cells), 2)


def test_memory_grows_with_the_text_alone():
    """A text of many pages: what is held at once is a small multiple of the text."""
    import tracemalloc

    import pyarrow as pa

    from weft.llm.media_query import digests, files_of

    text = "memory of a long text " * 200_000
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], names=["doc_id", "text"])
    tracemalloc.start()
    (out,) = list(digests(files_of(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column("n_pages")[0].as_py() > 80 and peak < 6 * len(text)
