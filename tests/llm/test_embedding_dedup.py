import numpy as np
import pytest

from weft.llm import embedding_dedup as e


def plain(rows, threshold=0.98):
    root, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def sound(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    for i, (a, x, p) in enumerate(rows):
        for b, y, q in rows[:i]:
            if p is None or p != q or not sound(x) or not sound(y) or len(x) != len(y):
                continue
            u, v = np.array(x, dtype=np.float32).astype(float), np.array(y, dtype=np.float32).astype(float)
            if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                links[a] += 1
                links[b] += 1
                s, t = find(a), find(b)
                root[max(s, t)] = min(s, t)
    return {d: (links[d], find(d)) for d in root}


def vectors(seed, n=40, dims=64, noise=0.02):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        base = rng.normal(size=dims)
        for _ in range(int(rng.integers(1, 8))):
            v = base / np.linalg.norm(base) + rng.normal(size=dims) * noise * rng.random()
            rows.append((len(rows), v.astype(np.float32).tolist(), int(rng.integers(0, 2))))
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, copies string")
    return e.embedding_near_duplicates(df, **options).collect()


def test_recall_and_no_false_link(spark):
    rows = vectors(1)
    want, got = plain(rows), {r["vec_id"]: r for r in run(spark, rows)}
    assert all(got[d]["n_links"] <= n for d, (n, _) in want.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(n for n, _ in want.values()) > 0
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_blocks_give_the_same(spark, monkeypatch):
    """One tight cluster: short codes, buckets that are compared block by block, nearly all links."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.02).astype(np.float32).tolist(), 1) for i in range(90)]
    whole = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in run(spark, rows)}
    assert sum(n for n, _ in whole.values()) >= 0.9 * 90 * 89 and {c for _, c in whole.values()} == {0}
    monkeypatch.setattr(e, "BLOCK", 16)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in run(spark, rows)} == whole


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v, 1), (3, v, 1), (4, v, 2), (6, v, None), (7, None, 1), (8, [], 1), (9, [0.0, 0.0, 0.0], 1), (10, [1.0, None, 3.0], 1), (11, [float("nan"), 1.0, 1.0], 1), (12, [float("inf"), 1.0, 1.0], 1), (13, [2.0, 4.0, 6.0], 1), (14, [1.0, 2.0], 1)]
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in run(spark, rows)} == plain(rows)
    assert run(spark, []) == []
    twice = run(spark, [(1, v, 1), (1, v, 1), (None, v, 1)])
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in twice) == [(-1, 0, None, True), (1, 1, 1, True), (1, 1, 1, True)]


def test_rotation_is_orthogonal_and_codes_are_balanced():
    x = np.random.default_rng(0).normal(size=(3000, 32)) @ np.diag(np.linspace(3, 0.2, 32))
    mean, projection = e.learn_rotation(x, 0.999)
    assert np.allclose(projection.T @ projection, np.eye(projection.shape[1]), atol=1e-9)
    assert e.bits_worth(np.full(64, 1 / 64), 0.98) == 64 and e.bits_worth(np.full(64, 1e-6), 0.98) == 8
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    share = ((unit - mean) @ projection >= 0).mean(axis=0)
    assert (abs(share - 0.5) < 0.1).all()


def test_components_of_any_finite_size(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [1e-200, 2e-200], 1), (3, [2e200, -1e200], 1), (4, [1e308, 1.9e308 / 1], 1)]
    rows[3] = (4, [0.5e308, 1e308], 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.embedding_near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1)}


@pytest.mark.parametrize("dims", [64, 384, 1024])
@pytest.mark.parametrize("typical", [0.9805, 0.985])
def test_recall_in_one_tight_cluster(dims, typical):
    """Pairs at the threshold of vectors that hardly spread share a part of some table; a sample's own axes don't deceive."""
    rng = np.random.default_rng(dims)
    base = rng.standard_normal(dims)
    base /= np.linalg.norm(base)
    x = base + rng.standard_normal((2400, dims)) * np.sqrt((1 / typical - 1) / dims)
    keys = e.table_keys(x, *e.learn_rotation(x), e.TABLES)
    a, b = e.close_pairs(x, None, 0.98)
    assert len(a) > 1000
    assert (keys[a] == keys[b]).any(axis=1).mean() >= 0.95


def test_spread_clusters_keep_long_codes():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 1, 64)) + 0.01 * rng.standard_normal((400, 5, 64))
    labels = np.repeat(np.arange(4), 500)
    _, projection = e.learn_rotation(x.reshape(2000, 64), labels=labels)
    assert projection.shape[1] >= 40
