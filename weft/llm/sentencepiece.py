"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search keeps, for the last positions within one longest piece, the best
last piece that ends there, and commits ids as soon as the backpointer paths of
all these positions meet at one boundary. For a unigram model the best is the
largest sum of scores. A byte-pair model has no sums to compare: there a path
survives if each two neighbouring pieces are what merging their joined text
gives. That holds for exactly one path to each position, and that path is the
encoding by merges, so that ids equal those of the merge procedure.

No piece of the usual models goes on past a space after another character.
There all paths meet, so the window is cut there: a text is searched from space
to space, all of it by the same search, and what was found for a stretch is
kept for its next occurrence. Merging itself serves only to tell, once, which
pieces and halves of pieces a model's merges reach.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from weft.llm.common import arrow_schema, bounded_batches, slices

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Stretches and pairs that a worker remembers at most, and how long a remembered stretch may be.
REMEMBERED, LONGEST = 600_000, 48
#: New characters between two looks for a common boundary in a long stretch.
LOOK = 256
#: Pieces whose bytes are put in place at once in decoding.
PIECES_AT_ONCE = 1 << 18
#: What the unknown piece reads as.
UNKNOWN_TEXT = " ⁇ ".encode()
#: Added to the least score for a character that no piece has.
PENALTY = 10.0


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _message(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind} in a model file")
        yield key >> 3, value


class PieceModel:
    """A model file, read without the library, and its encoder and decoder."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.byte_fallback, self.dummy_prefix, squeeze = UNIGRAM, False, True, True
        for field, value in _message(data):
            if field == 1:
                own = dict(_message(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif field == 2:
                own = dict(_message(value))
                self.kind, self.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif field == 3:
                own = dict(_message(value))
                if own.get(2):
                    raise ValueError("models that rewrite characters aren't supported")
                self.dummy_prefix, squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
        if squeeze:
            raise ValueError("models that drop spaces aren't supported: their texts can't be restored")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} isn't supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (NORMAL, USER)}
        self.unknown = self.types.index(UNKNOWN)
        self.byte_ids = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.least = min((s for s, t in zip(self.scores, self.types, strict=True) if t == NORMAL), default=0.0)
        # paths meet between two characters that stand side by side in no piece, above all around one that only stands alone
        long = [p for p in self.ids if len(p) > 1]
        self.touching = {p[k : k + 2] for p in long for k in range(len(p) - 1)}
        joined = "".join(map(re.escape, sorted({c for p in long for c in p} - {SPACE})))
        if any(SPACE in p.lstrip(SPACE) for p in long):
            self.stretches = re.compile(".+", re.DOTALL)
        else:
            self.stretches = re.compile(f"{SPACE}*[{joined}]+|{SPACE}+|[^{SPACE}{joined}]" if joined else ".", re.DOTALL)
        self._pairs: dict[str, dict[str, bool]] = {}
        self._known_pairs = 0
        self._whole: dict[str, bool] = {}
        self._split: dict[str, tuple[str, str] | None] = {}
        self.rank = {p: -self.scores[i] for p, i in self.ids.items()}
        #: Pieces that merging their characters gives; others never occur.
        self.usable = {p for p in self.ids if self.kind == UNIGRAM or self._reached(p)}
        #: Those pieces by their characters: for each the piece that ends there, if any, and what may follow. Single characters always end one.
        self.trie: dict[str, list] = {}
        for p in sorted(self.usable):
            below = self.trie
            for k, c in enumerate(p):
                node = below.setdefault(c, [None if k else c, {}])
                below = node[1]
            node[0] = p
        #: What each id stands for, as bytes one after the other; one id more, for a null among ids, stands for nothing.
        raw = [self._bytes_of(i) for i in range(len(self.pieces))] + [b""]
        self.nothing = len(self.pieces)
        self.raw, self.raw_ends = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])
        self._memo = _Memo(self)

    def _bytes_of(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes((int(self.pieces[i][1:-1], 16),))
        if self.types[i] == CONTROL:
            return b""
        return UNKNOWN_TEXT if self.types[i] == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()

    # --- merging, the reference for what may stand side by side

    def merge(self, text: str) -> list[str]:
        """The pieces of a byte-pair model: best score first, leftmost first among equals."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts):
                joined = parts[a] + parts[b]
                i = self.ids.get(joined)
                if i is not None:
                    heapq.heappush(heap, (-self.scores[i], a, b, joined))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, None
            after[a] = after[b]
            if after[a] < len(parts):
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts of the last merge that makes the piece; None for a character, and where merging ends elsewhere."""
        known = self._split.get(piece, 0)
        if known == 0:
            known = None
            if len(piece) > 1:
                # what merging makes of the piece before its own, last merge
                i = self.ids.pop(piece)
                parts = self.merge(piece)
                self.ids[piece] = i
                if len(parts) == 2 and all(len(p) == 1 or self._reached(p) for p in parts):
                    known = (parts[0], parts[1])
            self._split[piece] = known
        return known

    def beside(self, a: str, b: str) -> bool:
        """Whether merging ``a`` and ``b`` written together gives these two again.

        Looks back from the finished pieces: a merge across their border would
        come about if the two parts that touch there at some time make a piece
        that ranks before the merges by which they grew on.
        """
        beside = self._pairs.setdefault(a, {})
        known = beside.get(b)
        if known is None:
            known = self._apart(a, b)
            if self._known_pairs >= REMEMBERED:
                self._pairs.clear()
                self._known_pairs = 0
                beside = self._pairs.setdefault(a, {})
            self._known_pairs += 1
            beside[b] = known
        return known

    def _apart(self, a: str, b: str) -> bool:
        rank, split = self.rank, self._halves
        grown_a = grown_b = float("inf")
        while True:
            across = rank.get(a + b)
            if across is not None and across < grown_a and across <= grown_b:
                return False
            born_a, born_b = rank[a] if len(a) > 1 else -1.0, rank[b] if len(b) > 1 else -1.0
            if born_a < 0 and born_b < 0:
                return True
            if born_a > born_b:
                grown_a, a = born_a, split(a)[1]
            elif born_b > born_a:
                grown_b, b = born_b, split(b)[0]
            else:  # one piece twice: the left one is made first
                grown_b, b = born_b, split(b)[0]

    def _reached(self, piece: str) -> bool:
        known = self._whole.get(piece)
        if known is None:
            known = self._whole[piece] = self.merge(piece) == [piece]
        return known

    # --- encoding

    def _spell(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        if not self.byte_fallback:
            return [self.unknown]
        return [self.byte_ids[b] for b in piece.encode()]

    def search(self, stretch: str) -> list[int]:
        """The ids of one stretch."""
        return Viterbi(self).run(stretch)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        text = text.replace(" ", SPACE)
        if self.dummy_prefix:
            text = SPACE + text
        return np.frombuffer(b"".join(map(self._memo.__getitem__, self.stretches.findall(text))), dtype=np.int32)

    def decode(self, ids: list[int | None]) -> str:
        return self.decode_rows(pa.array([ids], pa.list_(pa.int32())))[0]

    def decode_rows(self, column: pa.Array) -> list[str]:
        """The text of each row of ids: bytes of all pieces are put in place at once."""
        lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        flat = pc.fill_null(column.flatten(), self.nothing).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.where((flat < 0) | (flat > self.nothing), self.unknown, flat)
        n = self.raw_ends[flat + 1] - self.raw_ends[flat]
        ends, parts = np.cumsum(n), []
        for k in range(0, len(flat), PIECES_AT_ONCE):
            ids, size = flat[k : k + PIECES_AT_ONCE], n[k : k + PIECES_AT_ONCE]
            first = np.cumsum(size) - size
            parts.append(self.raw[np.repeat(self.raw_ends[ids] - first, size) + np.arange(int(size.sum()))].tobytes())
        data = b"".join(parts)
        rows = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        out = [data[a:b].decode("utf-8", "replace") for a, b in zip(rows[:-1], rows[1:], strict=True)]
        return [t[1:] if t.startswith(" ") else t for t in out] if self.dummy_prefix else out


class _Memo(dict):
    """What was found for stretches, in two generations: the older goes when the newer is full."""

    def __init__(self, model: PieceModel) -> None:
        super().__init__()
        self.model, self.older = model, {}

    def __missing__(self, stretch: str) -> bytes:
        found = self.older.get(stretch)
        if found is None:
            touching = self.model.touching
            if not touching.issuperset(map(add, stretch, stretch[1:])):
                cuts = [k for k in range(1, len(stretch)) if stretch[k - 1 : k + 1] not in touching]
                ends = [*cuts, len(stretch)]
                found = b"".join([self[stretch[a:b]] for a, b in zip([0, *cuts], ends, strict=True)])
            else:
                found = array("i", self.model.search(stretch)).tobytes()
        if len(stretch) <= LONGEST:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[stretch] = found
        return found


class Viterbi:
    """The search over one stretch; holds back no more than one longest piece and the undecided path.

    Positions are taken in order. From each, pieces are followed to the
    positions where they end, and every position keeps the last piece of its
    one surviving (or best) path. A position whose pieces may reach beyond the
    characters at hand waits for more of them.
    """

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.text, self.at, self.ids = "", 0, []
        #: For each position of the text at hand: the last piece of its path, and for a unigram model the sum of scores.
        self.via: list[str | None] = [""]
        self.sums: list[float] = [0.0]
        self.step = self._survivors if model.kind == BPE else self._best

    def run(self, stretch: str) -> list[int]:
        if len(stretch) <= LOOK:  # all of it at hand: no boundary is looked for before its end
            self.text, self.via = stretch, [""] + [None] * len(stretch)
            return self.finish()
        for k in range(0, len(stretch), LOOK):
            self.push(stretch[k : k + LOOK])
        return self.finish()

    def push(self, more: str) -> None:
        if self.text:
            self._commit(self._meeting())
        self.text += more
        self.via += [None] * len(more)
        ready = len(self.text) - self.model.longest + 1
        if ready > self.at:
            self.step(ready)

    def finish(self) -> list[int]:
        self.step(len(self.text))
        self._commit(len(self.text))
        return self.ids

    def _survivors(self, to: int) -> None:
        """A path lives on in a piece that stands beside its last one; one path survives to each position."""
        model, text, via = self.model, self.text, self.via
        trie, pairs, longest, none = model.trie, model._pairs, model.longest, {}
        for at in range(self.at, to):
            before = via[at]
            if before is None:
                continue
            known, below, end = pairs.get(before, none), trie, at
            for c in text[at : at + longest]:
                node = below.get(c)
                if node is None:
                    break
                end += 1
                piece, below = node
                if piece is not None and via[end] is None:
                    fits = known.get(piece) if before else True
                    if fits is None:
                        fits = model.beside(before, piece)
                    if fits:
                        via[end] = piece
            if end == at and via[at + 1] is None and (not before or model.beside(before, text[at])):
                via[at + 1] = text[at]  # a character that no piece has
        self.at = max(self.at, to)

    def _best(self, to: int) -> None:
        """Each position keeps the path of the largest sum; the path that reached it first among equals."""
        model, text, via, sums = self.model, self.text, self.via, self.sums
        sums += [-float("inf")] * (len(text) + 1 - len(sums))
        for at in range(self.at, to):
            below, end = model.trie, at
            for c in text[at : at + model.longest]:
                node = below.get(c)
                if node is None and end > at:
                    break
                end += 1
                piece, below = node or (c, {})
                if piece is not None:
                    i = model.ids.get(piece)
                    value = sums[at] + (model.least - PENALTY if i is None else model.scores[i])
                    if value > sums[end]:
                        sums[end], via[end] = value, piece
        self.at = max(self.at, to)

    def _meeting(self) -> int:
        """The last boundary that all paths go through which reach a position that wasn't taken yet."""
        via = self.via
        paths = {p for p in range(self.at, len(via)) if via[p] is not None}
        while len(paths) > 1:
            top = max(paths)
            paths.discard(top)
            paths.add(top - len(via[top]))
        return paths.pop() if paths else 0

    def _commit(self, to: int) -> None:
        if not to:
            return
        via, pieces, at = self.via, [], to
        while at:
            pieces.append(via[at])
            at -= len(via[at])
        ids, spell, out = self.model.ids, self.model._spell, self.ids
        for piece in reversed(pieces):
            i = ids.get(piece)
            if i is None:
                out += spell(piece)
            else:
                out.append(i)
        self.text, self.via, self.at = self.text[to:], [pieces[0], *via[to + 1 :]], max(0, self.at - to)
        if self.model.kind == UNIGRAM:
            base = self.sums[to]
            self.sums = [v - base for v in self.sums[to:]]


@lru_cache(maxsize=4)
def _loaded(digest: str, data: bytes) -> PieceModel:
    return PieceModel(data)


def load(data: bytes) -> PieceModel:
    """The model of a file's bytes; one for each process, so that what it remembers serves all tasks."""
    return _loaded(hashlib.sha256(data).hexdigest(), data)


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` with ``token_ids`` of ``text``; a null or empty text has none.

    The file is read on the driver and sent to the executors. Ids are those of
    the merge or unigram procedure on the text itself, special tokens aside. A
    literal U+2581 in a text reads as a space, as in the usual library. Repeated
    rows give repeated results; a column of the same name is replaced.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("token_ids")
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    at = docs.columns.index("text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shared.value)
        for batch in slices(batches, "text", 2 << 20):
            found = [model.encode(t or "") for t in batch.column(at).to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "token_ids"])

    return docs.mapInArrow(encoded, arrow_schema(docs, ("token_ids", "array<int>")))


def decode_ids(tokens: DataFrame, model_path: str) -> DataFrame:
    """``tokens`` with ``decoded``, the text of ``token_ids``.

    Null or no ids give an empty text; a null among ids stands for nothing, and
    an id that the model doesn't have reads as its unknown piece. Repeated rows
    give repeated results; a column of the same name is replaced.
    """
    bounded_batches(tokens.sparkSession)
    tokens = tokens.drop("decoded")
    with open(model_path, "rb") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())
    at = tokens.columns.index("token_ids")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shared.value)
        for batch in batches:
            texts = model.decode_rows(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(decoded, arrow_schema(tokens, ("decoded", "string")))
