import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm.mixing import knapsack, mix_sources, source_targets
from weft.llm.sharding import minimax_cuts, shard_by_bytes

RUNS = st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=8).map(lambda d: sorted(d.items(), reverse=True))


def least_capacity(sizes, shards):
    best = {0: 0}
    ends = np.cumsum([0, *sizes])
    cost = [float("inf")] * (len(sizes) + 1)
    cost[0] = 0
    for _ in range(shards):
        new = list(cost)
        for j in range(1, len(sizes) + 1):
            new[j] = min([cost[j], *(max(cost[i], ends[j] - ends[i]) for i in range(j))])
        cost = new
    del best
    return cost[-1]


@settings(max_examples=80, deadline=None)
@given(RUNS, st.integers(1, 9))
def test_cuts_are_minimax(runs, shards):
    sizes = [s for s, c in runs for _ in range(c)]
    cuts = minimax_cuts(runs, shards)
    starts = []
    for s, r in cuts:
        starts.append(sum(c for t, c in runs if t > s) + r)
    assert starts[0] == 0 and starts == sorted(set(starts)) and len(starts) <= shards
    loads = [sum(sizes[a:b]) for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True)]
    assert sum(loads) == sum(sizes) and max(loads) == least_capacity(sizes, shards)


def shards_of(spark, rows, shards):
    return shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string, size string"), shards).collect()


def test_shards_of_a_corpus(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.choice([3, 40, 300]))) for _ in range(120)]
    rows = [(i, t, "x") for i, t in enumerate(texts * 2)] + [(900 + i, "hot" * 40, None) for i in range(150)] + [(1500, None, None), (1501, "", None), (None, "q", None), (None, "q", None)]
    got = shards_of(spark, rows, 7)
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    text = {d: t or "" for d, t, _ in rows}
    place, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        t = text[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode())
        place[t].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in place.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for r in got:
        groups[text[r["doc_id"]]] += r["size"]
    assert max(load.values()) == least_capacity(sorted(groups.values(), reverse=True), 7)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, shards_of(spark, rows[::-1], 7)), key=str)


def test_shards_of_few_rows(spark):
    assert shards_of(spark, [], 40) == []
    got = shards_of(spark, [(1, "a", None), (1, "a", None), (2, "b", None)], 40)
    assert sorted((r["doc_id"], r["slot"]) for r in got) == [(1, 0), (1, 1), (2, 0)]


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 5), min_size=1, max_size=8), st.integers(0, 400))
def test_knapsack_reaches_the_best_sum(lengths, budget):
    n, c = np.array(list(lengths)), np.array(list(lengths.values()))
    taken = knapsack(n, c, budget)
    assert ((taken >= 0) & (taken <= c)).all()
    total = int((n * taken).sum())
    floor = np.array([int(k) * min(budget, int((n * c).sum())) // max(1, int((n * c).sum())) for k in c])
    sums = {int((n * floor).sum())} if budget < (n * c).sum() else {0}
    free = c - floor if budget < (n * c).sum() else c
    for size, k in zip(n.tolist(), free.tolist(), strict=True):
        sums |= {s + size * j for s in sums for j in range(k + 1)}
    assert total == max(s for s in sums if s <= budget)


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        stop = {s for s in free if level * w[s] > most * sizes[s]}
        if not stop:
            return target | {s: level * w[s] for s in free}
        for s in stop:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= stop
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {(None if i == 0 else f"s{i}"): rng.choice([0, 3, 50, 1000, 40_000]) for i in range(9)}
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "B", "é", None])
        rows.append((i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 7, 30]))), source, 1))
    rows += [(1000, None, "a", 1), (1001, "x y z", "a", 1), (7, rows[7][1], rows[7][2], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert {r["doc_id"]: r["size"] for r in got}[1001] == 2
    assert target == pytest.approx(plain_targets(sizes))
    assert all(abs(taken[s] - target[s]) <= 30 and r["source_size"] == sizes[r["source"]] for s in target for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_sources(df.repartition(7)).collect()), key=str)
    assert mix_sources(df.limit(0)).count() == 0
