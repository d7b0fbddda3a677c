"""Chat formatting by columnar byte assembly.

Every turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. For a batch of turns the
lengths of all segments are computed at once, their cumulative offsets give
each segment's place, and headers and contents are scattered into one
preallocated buffer that becomes an Arrow string column.

Control strings begin with ``<|``. Within roles and texts a backslash is put
between ``<`` and ``|``, and one more where backslashes stand there already;
taking one away restores every text. A line break in a role is written ``\\n``
after doubling its backslashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import bounded_batches

START, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"
#: Characters of formatted turns that one row of output holds, a single longer turn aside.
CHUNK = 1 << 18
LEARNED = "assistant"

_ESCAPED = re.compile(r"<(\\+)\|")


def _whole(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.large_string()), "")


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, pattern=r"<(\\*)\|", replacement=r"<\1\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<" + m[1][1:] + "|", text) if "<\\" in text else text


def escape_role(column: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(escape(column), "\\", "\\\\"), "\n", "\\n")


def unescape_role(text: str) -> str:
    if "\\" not in text:
        return text
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def assemble(segments: list[pa.Array | bytes], rows: int) -> pa.Array:
    """Join segments row by row: a column gives its value, bytes stand in every row.

    The lengths of all segments form a table of rows by segments; its running
    sum says where each begins in the output. Contents are moved by one gather
    for each segment, whatever the number of rows.
    """
    lengths = np.empty((rows, len(segments)), dtype=np.int64)
    sources = []
    for k, segment in enumerate(segments):
        if isinstance(segment, bytes):
            lengths[:, k] = len(segment)
            sources.append((np.frombuffer(segment, dtype=np.uint8), None))
        else:
            data, offsets = _bytes_of(segment)
            lengths[:, k] = np.diff(offsets)
            sources.append((data, offsets[:-1]))
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(rows, len(segments))
    out = np.empty(int(ends[-1]) if rows else 0, dtype=np.uint8)
    for k, (data, begins) in enumerate(sources):
        n = lengths[:, k]
        total = int(n.sum())
        if not total:
            continue
        within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        source = within if begins is None else within + np.repeat(begins, n)
        out[within + np.repeat(starts[:, k], n)] = data[source]
    offsets = np.concatenate([[0], ends[len(segments) - 1 :: len(segments)]]).astype(np.int64) if rows else np.zeros(1, np.int64)
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(out))


def format_turns(role: pa.Array, text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted turns, and where in each, in characters, its text begins and ends."""
    role, text = escape_role(_whole(role)), escape(_whole(text))
    out = assemble([START.encode(), role, BREAK.encode(), text, (END + BREAK).encode()], len(role))
    begin = len(START) + len(BREAK) + pc.utf8_length(role).to_numpy(zero_copy_only=False)
    return out, begin, begin + pc.utf8_length(text).to_numpy(zero_copy_only=False)


_CHUNKS = "conv_id long, chunk long, n_turns long, formatted string, loss array<struct<begin:long,end:long>>"
_CHUNK_FIELDS = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.large_string()), ("loss", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to formatted runs of turns of one conversation."""
    for batch in batches:
        formatted, begin, end = format_turns(batch.column("role"), batch.column("text"))
        learned = pc.fill_null(pc.equal(batch.column("role"), LEARNED), False).to_numpy(zero_copy_only=False)
        size = pc.utf8_length(formatted).to_numpy(zero_copy_only=False)
        ids, places = batch.column("conv_id").to_pylist(), batch.column("place").to_pylist()
        data, offsets = _bytes_of(formatted)
        rows, first = [], 0
        while first < len(ids):
            last, held = first + 1, int(size[first])
            while last < len(ids) and ids[last] == ids[first] and held + size[last] <= CHUNK:
                held += int(size[last])
                last += 1
            base = np.cumsum(size[first:last]) - size[first:last]
            loss = [{"begin": int(b + begin[first + k]), "end": int(b + end[first + k])} for k, b in enumerate(base.tolist()) if learned[first + k]]
            rows.append((ids[first], places[first], last - first, data[offsets[first] : offsets[last]].tobytes().decode(), loss))
            first = last
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHUNK_FIELDS, strict=True)], schema=_CHUNK_FIELDS)


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, chunk, n_turns, formatted, loss`` from ``turns(conv_id, turn, role, text)``.

    The formatted text of a conversation is its chunks, in order, joined; a
    chunk is a run of whole turns. ``loss`` lists the spans, in characters of
    the chunk, of the escaped texts of assistant turns. Turns are ordered by
    ``turn``, a null turn last, equal ones by role and text; repeated rows are
    repeated turns. Null roles and texts are empty; rows with a null conv_id
    form one conversation. Other columns are ignored; an empty table gives none.

    Rows are dealt by range of conversation and turn, so that a long
    conversation is formatted by many tasks.
    """
    bounded_batches(turns.sparkSession)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    dealt = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    # grows along the order of rows: partitions are ranges, and rows are sorted within each
    return dealt.withColumn("place", F.monotonically_increasing_id()).drop("turn").mapInArrow(_chunks, _CHUNKS)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to one row for each conversation; texts are hashed as they come, never joined."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, rows = None, []

    def close() -> None:
        if now:
            rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

    for batch in batches:
        for conv_id, formatted, loss in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            if now is None or now[0] != conv_id:
                close()
                now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = unescape(formatted[span["begin"] : span["end"]])
                now[3] += len(text)
                now[4].update(text.encode())
            now[5] += len(formatted)
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
    close()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def conversation_digests(chunks: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its chunks.

    A digest over a conversation is sequential by nature, so its chunks meet in
    one task; they pass through it one by one and nothing is gathered.
    """
    return chunks.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "chunk").mapInArrow(_read_back, _DIGEST)
