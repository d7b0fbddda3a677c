import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.oracle import agree
from weft.llm import queries, terms, textcounts
from weft.llm.resample import bisect, importance_resample

TEXTS = [None, "", "a", "Hello, World! x1 É ü", "z" * 70 + " b " + "y" * 200 + " c", "!!!", " ".join(random.Random(1).choices(["a", "Bc", "ÄÖ", "q" * 65, "7"], k=500))]


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(terms.WORD, low)


def runs_of(text, most=3):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("piece", [1 << 19, 64, 7])
def test_checksums_of_runs(monkeypatch, piece):
    monkeypatch.setattr(textcounts, "PIECE", piece)
    got = {r: [] for r in range(len(TEXTS))}
    for _, rows, crcs in terms.run_crcs(pa.array(TEXTS), 3):
        for r, c in zip(rows.tolist(), crcs.tolist(), strict=True):
            got[r].append(c)
    assert [sorted(got[r]) for r in range(len(TEXTS))] == [sorted(runs_of(t)) for t in TEXTS]


def plain(docs, target, share=(5, 100), least=20, buckets=10_000, seed=42):
    """``{(doc_id, n_features, weight, score, rank)}`` by plain loops."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, text in docs:
        for c in runs_of(text):
            s[c % buckets] += 1
    for text in target:
        for c in runs_of(text):
            t[c % buckets] += 1
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (s.sum() + buckets)) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c % buckets] for c in runs_of(text))
        rows.append([i, len(words_of(text)), len(runs_of(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3]))
    for k, r in enumerate(fit[: len(fit) * share[0] // share[1]], 1):
        r[5] = k
    return sorted(map(str, rows))


def told(df):
    return sorted(str([r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]]) for r in df.collect())


def test_resampling_equals_plain_loops(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "x" * 80]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for k in range(150)]
    docs += [(7, None), (8, ""), (9, docs[9][1]), (None, docs[3][1]), (None, None), (200, " ".join(rng.choices(vocabulary, k=30_000)))]
    target = [docs[5][1], docs[6][1], None, "w1 w2 w3"]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, score string")
    aimed = spark.createDataFrame([(t,) for t in target], "text string")
    for share in ((5, 100), (1, 2), (1, 1)):
        assert told(importance_resample(frame, aimed, share=share)) == plain(docs, target, share)


def test_ties_at_the_cutoff(spark):
    # the same text and doc_id again and again: all scores tie
    text = " ".join(f"w{k}" for k in range(25))
    docs = [(4, text)] * 30 + [(2, text)] * 3
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    aimed = spark.createDataFrame([(text,)], "text string")
    got = importance_resample(frame, aimed, share=(1, 3)).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 12))
    assert told(importance_resample(frame, aimed, share=(1, 3))) == plain(docs, [text], (1, 3))


def test_empty_tables(spark):
    none, aimed = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert importance_resample(none, aimed).count() == 0
    one = spark.createDataFrame([(1, " ".join("abcdefghijklmnopqrstuvwxyz"))], "doc_id long, text string")
    assert told(importance_resample(one, aimed, share=(1, 1))) == plain([(1, " ".join("abcdefghijklmnopqrstuvwxyz"))], [], (1, 1))


def test_bisection_finds_order_statistics(spark):
    rng = np.random.default_rng(0)
    values = [int(v) for v in rng.integers(-5, 5, 100)] + [-(2**40), 2**62, 10**6]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 40, 103):
        assert bisect(frame, "v", k) == sorted(values)[k - 1]


def test_query_matches_sql(spark):
    name = "op11_importance_resampling"
    agree(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), queries.ORACLE[name])
