"""Texts as TIFF files and back: what the media query runs within each partition."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import tiff
from weft.llm.common import bounded_batches, slices

ROW = 192
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"


def _file_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), tiff.write_pages(data + b" " * (max(1, -(-len(data) // ROW)) * ROW - len(data)), ROW)


def files_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, text`` to ``doc_id, n_bytes, content``: the text, filled up with spaces to whole rows, as a file."""
    for batch in slices(batches, "text", 1 << 20):
        made = [_file_of(t.as_py()) for t in batch.column(1)]
        sizes, content = (list(c) for c in zip(*made, strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(content, pa.binary())], names=["doc_id", "n_bytes", "content"])


class _Digest:
    """Running digests over the pages of one file."""

    def __init__(self, doc_id: int | None, n_bytes: int, content: bytes) -> None:
        self.head = (doc_id, n_bytes)
        self.media = (len(content), hashlib.sha256(content).hexdigest())
        self.sha, self.size, self.tail, self.pages = hashlib.sha256(), 0, b"", 0
        self.histogram, self.cells = np.zeros(256, dtype=np.int64), np.zeros(64, dtype=np.int64)
        # 64 even cells of the payload as written; whatever is read beyond it falls into the last
        self.edges = np.append(np.arange(64) * (max(1, -(-n_bytes // ROW)) * ROW) // 64, np.iinfo(np.int64).max)

    def add(self, pixels: bytes) -> None:
        x = np.frombuffer(pixels, dtype=np.uint8)
        self.sha.update(pixels)
        sums = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        self.cells += np.diff(sums[np.clip(self.edges - self.size, 0, len(x))])
        self.size += len(pixels)
        self.tail = (self.tail + pixels[-16:])[-16:]
        self.histogram += np.bincount(x, minlength=256)
        self.pages += 1

    def row(self) -> tuple:
        total = max(1, int(self.histogram.sum()))
        mean = int((self.histogram * np.arange(256)).sum()) * 1000 // total
        used = int((self.histogram > 0).sum())
        bits = int("".join("01"[v] for v in (self.cells > self.cells.mean()).astype(int)), 2)
        return (*self.head, self.size, self.sha.hexdigest(), zlib.crc32(self.tail), *self.media, f"p{self.pages}-m{mean}-u{used}-{bits:016x}", self.pages)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_pages", pa.int32())])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, n_bytes, content`` to one row for each file, read page by page; a page is let go before the next is decoded."""
    for batch in batches:
        rows = []
        for doc_id, n_bytes, content in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "content")), strict=True):
            data = memoryview(content.as_buffer())
            now = _Digest(doc_id.as_py(), n_bytes.as_py(), data)
            for page in tiff.pages(data):
                if page["error"]:
                    raise ValueError(f"document {doc_id}, page {page['page']}: {page['error']}")
                now.add(page["pixels"])
            rows.append(now.row())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def media_digests(docs: DataFrame) -> DataFrame:
    """One row for each document, read back from its file.

    A null text counts as empty and fills one row of spaces; equal texts give
    equal values. Repeated rows give repeated results; an empty table gives
    none. The file is written, read page by page and digested within one pass
    over a partition, without a shuffle. A worker holds a text, its file and one
    page at a time, so that memory grows with the length of a text, not with
    the number of its pages. Columns besides doc_id and text aren't read, and
    a null doc_id stays null.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: digests(files_of(batches)), SCHEMA)
