import random
import re

import pytest

from tests.oracle import agree
from weft.llm import decontaminate as d
from weft.llm import queries, terms, textcounts


def words_of(text):
    return re.findall(terms.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, size, slack, anchors):
    """``[doc_id, n_words, n_hit, item_ids, n_near]`` by plain loops."""
    texts = [words_of(t) for _, t in docs]
    counts = {}
    for w in texts:
        for t in w:
            counts[t] = counts.get(t, 0) + 1
    windows = {}
    for i, t in items:
        w = words_of(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for (i, _), w in zip(docs, texts, strict=True):
        hit, found, near = set(), set(), set()
        for x, owners in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found |= owners
            if all(t in counts for t in x):
                rare = sorted((counts[t], at, t) for at, t in enumerate(x))[:anchors]
                for p, t in enumerate(w):
                    if t == rare[0][2] and all(any(w[q] == u and abs(q - (p - rare[0][1]) - at) <= slack for q in range(len(w))) for _, at, u in rare[1:]):
                        near |= owners
                        break
        out.append(str([i, len(w), len(hit), sorted(found), len(near)]))
    return sorted(out)


def told(df):
    rows = df.collect()
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["item_ids"]) for r in rows)
    return sorted(str([r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["n_near"]]) for r in rows)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "the", "the", "the"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 4, 5, 9, 14])))) for k in range(12)]
    items += [(3, "the the the the the the"), (None, "w1 never-seen w2 w3"), (20, None), (21, "The, W1; w2! É")]
    docs = []
    for k in range(40):
        w = rng.choices(vocabulary, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            at, cut = rng.randint(0, len(w)), words_of(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(cut) - 4))
            piece = cut[a : a + rng.randint(1, 8)]
            if rng.random() < 0.4 and len(piece) > 2:
                piece.insert(2, "gap")
            w[at:at] = piece
        docs.append((k, " ".join(w)))
    docs += [(5, None), (None, ""), (None, docs[3][1]), (6, docs[6][1]), (41, "... !!"), (42, "the " * 300 + (items[11][1] or ""))]
    return docs, items


@pytest.mark.parametrize(("seed", "piece", "block"), [(1, 1 << 19, 1 << 18), (2, 16, 5)])
def test_equals_plain_loops(spark, monkeypatch, seed, piece, block):
    monkeypatch.setattr(textcounts, "PIECE", piece)
    monkeypatch.setattr(d, "PAIRS", 7)
    docs, items = corpus(seed)
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, terms string")
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, window int")
    assert told(d.decontaminate(frame, asked, size=5, slack=2, block=block)) == plain(docs, items, 5, 2, 3)


def test_passages_across_long_texts(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    long = "filler words here " * 60_000
    docs = [(1, long + passage + " " + long), (2, long), (3, " ".join(passage.split()[:12])), (4, " ".join(passage.split()[:9]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in d.decontaminate(frame, spark.createDataFrame([(7, passage)], "item_id long, text string")).collect()}
    assert (got[1]["n_hit"], got[1]["item_ids"], got[1]["n_words"]) == (30, ["7"], 360_030)
    assert [got[k]["n_hit"] for k in (2, 3, 4)] == [0, 12, 0]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminate(docs, items).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert told(d.decontaminate(one, items)) == [str([1, 3, 0, [], 0])]


def test_query_matches_sql(spark):
    name = "op12_decontamination"
    agree(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), queries.ORACLE[name])
