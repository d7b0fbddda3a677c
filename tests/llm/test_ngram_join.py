import random
import re

import pyarrow as pa
import pytest

from weft.llm.components import components
from weft.llm.common import Scratch
from weft.llm.ngram_join import _shared_shingles, ngram_jaccard_join
from weft.llm.shingles import shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def plain_set(text, words):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return set()
    return {tuple(w)} if len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def plain_components(docs, words, num, den):
    root = {d: d for d, _ in docs if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(d, plain_set(t, words)) for d, t in docs if d is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in root}


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    docs = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([5, 20, 60, 200]))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy) if rng.random() < 0.7 else "\n\t".join(copy).upper())
    docs += [None, "", "  \n ", "one", "ONE", "one two", "x " * 500, "x " * 400]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "words", "num", "den"), [(0, 3, 90, 100), (1, 5, 8, 10), (2, 2, 1, 2)])
def test_components_match_brute_force(spark, seed, words, num, den):
    docs = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(spark.createDataFrame(docs, SCHEMA), words, num, den).collect()}
    roots = plain_components(docs, words, num, den)
    assert got == {d: (len(plain_set(t, words)), roots[d]) for d, t in docs}


def test_odd_rows(spark):
    same = " ".join(f"w{i}" for i in range(30))
    rows = [(3, same, "x"), (3, same, "x"), (1, same, None), (None, same, "y"), (7, None, "y")]
    got = ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA + ", n string"), 3, 9, 10).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got) == [(-1, None), (1, 1), (3, 1), (3, 1), (7, 7)]
    assert ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_long_row_counts_its_overlap_once(spark):
    """Two texts share half, rare shingles of all; one stands in two rows. The parity prints can't tell."""
    shared, one, two = (" ".join(f"{k}{i}" for i in range(1500)) for k in "sab")
    docs = [(1, f"{shared} {one}"), (1, f"{shared} {one}"), (2, f"{shared} {two}")]
    docs += [(10 + i, one) for i in range(4)] + [(20 + i, two) for i in range(4)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join(spark.createDataFrame(docs, SCHEMA), 5, 8, 10).collect()}
    assert got == plain_components(docs, 5, 8, 10) and got[2] == 2


def test_several_texts_of_one_document(spark):
    docs = [(d // 3 if d % 2 else d, t) for d, t in corpus(3)]
    docs += docs[::4]
    long = [" ".join(f"{k}{i}" for i in range(n)) for k, n in (("u", 2000), ("v", 2000))]
    docs += [(900, long[0]), (900, long[1]), (901, long[0][:-9] + " x y"), (902, long[1] + " z"), (903, " ".join(long))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join(spark.createDataFrame(docs, SCHEMA), 5, 8, 10).collect()}
    assert got == plain_components(docs, 5, 8, 10)


def test_words_across_segments_and_rows():
    long = " ".join(f"word{i}" for i in range(300_000))
    column = pa.array(["Ab c d", None, "", long, "tail"])
    hashes, offsets = word_hashes(column)
    assert offsets.tolist() == [0, 2, 2, 2, 300_002, 300_003]
    assert len(set(hashes.tolist())) == 300_003
    one = word_hashes(pa.array(["xx AB y"]))[0]
    assert word_hashes(pa.array(["ab"]))[0][0] == one[1]
    sets = shingle_sets(pa.array(["a b c d", "A b\tC", "a b"]), 3)
    assert [len(s) for s in sets] == [2, 1, 1] and sets[1][0] in sets[0]


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(40)] + [(1000, 500 + i) for i in range(30)] + [(5, 5), (None, 2), (7, 8)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{500 + i: 500 for i in range(30)}, 1000: 500}


def test_components_of_stars_chains_and_random_links(spark):
    def brute(links):
        parent = {}

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            if a is not None and b is not None and a != b:
                low, high = sorted((find(a), find(b)))
                parent[high] = low
        return {x: find(x) for x in parent}

    r = random.Random(3)
    cases = [[], [(1, 1), (None, 2)], [(1, 2), (1, 3)], [(3, 1), (3, 2)], [(i, i + 1) for i in range(30)], [(r.randrange(200), r.randrange(200)) for _ in range(120)]]
    for links in cases:
        got = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()
        assert len(got) == len({x.node for x in got})
        assert {x.node: x.root for x in got} == brute(links)


@pytest.mark.parametrize("num,den", [(9, 10), (8, 10), (1, 1)])
def test_buckets_that_may_hold_a_pair_are_kept(spark, num, den):
    rng = random.Random(num)
    heads = [(n, [rng.randrange(400) for _ in range(n + (-num * n // den) + 1)]) for n in (rng.choice([1, 2, 9, 10, 11, 50, 55, 400, 444, 5000]) for _ in range(300))]
    rows = spark.createDataFrame([(n, h) for n, h in heads], "n long, head array<long>")
    got = {r[0] for r in _shared_shingles(rows, num, den).collect()}
    at = {}
    for n, h in heads:
        for i, s in enumerate(h):
            at.setdefault(s, []).append((n, i))
    meet = lambda x, y: min(x[0] - x[1], y[0] - y[1]) * (num + den) >= (x[0] + y[0]) * num
    want = {s for s, e in at.items() if any(meet(x, y) for k, x in enumerate(e) for y in e[:k])}
    assert want <= got <= {s for s, e in at.items() if len(e) > 1}


def test_an_empty_row_beside_a_full_one(spark):
    """Rows that share a doc_id have one component, that of their texts, whichever of them has words."""
    same = " ".join(f"w{i}" for i in range(200))
    docs = [(3, same), (3, ""), (0, same + " more"), (5, None), (5, " "), (6, ""), (6, "other words than these"), (None, "")]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_jaccard_join(spark.createDataFrame(docs, SCHEMA), 3, 90, 100).collect()}
    assert got == {(3, 198): 0, (3, 0): 0, (0, 199): 0, (5, 0): 5, (6, 0): 6, (6, 2): 6, (None, 0): None}
    roots = plain_components(docs, 3, 90, 100)
    assert all(root == roots.get(d) for (d, _), root in got.items())
