import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from tests.oracle import agree
from weft.llm import queries
from weft.llm import vector_codes as v


def plain(rows, parts, entries, rounds):
    """``(rows of vec_id, code, error, label_error), codebooks`` by plain loops over ``(vec_id, vector, label)``."""
    kept = [(i, e, g) for i, e, g in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = max(1, -(-max((len(e) for _, e, _ in kept), default=0) // parts))
    whole = [[math.floor(256 * x) for x in e] + [0] * (width * parts - len(e)) for _, e, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[whole[k][p * width : (p + 1) * width] for k in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for w in whole:
                got[nearest(w[p * width : (p + 1) * width], books[p])[1]].append(w[p * width : (p + 1) * width])
            books[p] = [[sum(c) // len(got[k]) for c in zip(*got[k], strict=True)] if k in got else e for k, e in enumerate(books[p])]
    out, by_label = [], defaultdict(int)
    for (i, _, g), w in zip(kept, whole, strict=True):
        told = [nearest(w[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out.append([i, "".join(f"{k:02x}" for _, k in told), sum(d for d, _ in told), g])
        by_label[g] += out[-1][2]
    return sorted(str([i, c, d, by_label[g]]) for i, c, d, g in out), books


def told(codes):
    return sorted(str([r["vec_id"], r["code"], r["error"], r["label_error"]]) for r in v.code_errors(codes).collect())


def clustered(rng, n, width):
    centres = rng.standard_normal((9, width))
    return (centres[rng.integers(0, 9, n)] + 0.2 * rng.standard_normal((n, width))).astype(np.float32).astype(float)


@pytest.mark.parametrize(("n", "width", "chunk"), [(300, 32, 1 << 19), (200, 37, 50 * 48), (40, 16, 7 * 16)])
def test_equals_plain_loops(spark, monkeypatch, n, width, chunk):
    monkeypatch.setattr(v, "CHUNK", chunk)
    rng = np.random.default_rng(n)
    rows = [(int(k), x.tolist(), int(k) % 3 if k % 5 else None) for k, x in zip(rng.permutation(n), clustered(rng, n, width), strict=True)]
    rows += [(1, None, 1), (2, [None] + [0.0] * (width - 1), 1), (3, [float("nan")] * width, 0), (4, [float("inf")] * width, 0), (5, [], 2), (6, [1.5, -2.25], 1), (None, rows[0][1], 0), *rows[:9], rows[1]]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, n int")
    codes = v.compress_vectors(frame, 16, 64, 2)
    want, books = plain(rows, 16, 64, 2)
    assert told(codes) == want
    assert codes.books.tolist() == books
    assert codes.digest() == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(1, [0.5], None)], "vec_id long, embedding array<float>, label string")
    codes = v.compress_vectors(frame)
    assert told(codes) == [str([1, "00" * 16, 0, 0])]
    empty = v.compress_vectors(frame.limit(0))
    assert told(empty) == [] and empty.digest() == hashlib.sha256(b"").hexdigest()


def test_large_components_do_not_overflow(spark):
    frame = spark.createDataFrame([(1, [1e300, -1e300], 1), (2, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert all(r["error"] == 0 for r in v.compress_vectors(frame).coded.collect())


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(2)
    x = clustered(rng, 400, 20)
    frame = spark.createDataFrame([(k, e.tolist(), 0) for k, e in enumerate(x)], "vec_id long, embedding array<double>, label int")
    codes = v.compress_vectors(frame, 4, 64, 2)
    got = {r["vec_id"]: (r["vector"], r["error"]) for r in codes.decoded().join(codes.coded, "vec_id").collect()}
    for k, (vector, error) in got.items():
        assert len(vector) == 20
        assert ((np.floor(256 * x[k]) - 256 * np.array(vector)) ** 2).sum() == pytest.approx(error)


def test_curve_visits_neighbours():
    # on a whole grid the curve is a path: each step changes one component by one
    for d, side in ((2, 16), (3, 8), (4, 4)):
        grid = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        place = v.hilbert(grid * 255 // (side - 1) if d < 8 else grid)
        path = grid[np.argsort(place, kind="stable")]
        assert len(np.unique(place)) == len(grid)
        assert np.abs(np.diff(path, axis=0)).sum(axis=1).mean() < 1.6


def test_boxes_leave_few_points_to_compare():
    rng = np.random.default_rng(5)
    x = np.floor(256 * clustered(rng, 8192, 8)).astype(np.int64)
    chunk = v.Chunk.of(x, 2)
    books = x[:64].reshape(64, 2, 4).transpose(1, 0, 2)
    short = [v.shortlists(chunk.low[p], chunk.high[p], books[p]) for p in range(2)]
    assert np.mean([s.mean() for s in short]) < 0.4
    counts, sums = np.zeros((2, 64), dtype=np.int64), np.zeros((2, 64, 4), dtype=np.int64)
    v.add_sums(chunk, books, counts, sums)
    assert counts.sum(axis=1).tolist() == [8192, 8192]
    assert sums.sum(axis=1).ravel().tolist() == x.sum(axis=0).tolist()


def test_query_matches_sql(spark):
    name = "op13_vector_codes"
    agree(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), queries.ORACLE[name])
