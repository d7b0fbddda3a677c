import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import boosting
from weft.llm.common import crc_of_id
from weft.llm.quality import QualityModel, fit_quality, leading_directions, term_counts
from weft.llm.textcounts import SPACES, pieces, spans
from weft.llm.toxicity import features, fit_toxicity, lexicon, score_texts

ODD = [(None, None, 1), (1, None, 1), (2, "", 1), (3, " \n", 1), (4, "x" * 50_000, 1), (5, "a b " * 40_000, 1), (5, "a b " * 40_000, 1)]


def corpus(seed, n=900):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        toxic, bad = rng.random() < 0.25, rng.random() < 0.25
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                w[rng.randrange(len(w))] = rng.choice(["you idiot", "stup1d", "zorkab", "zorkel", "zorkum", "worthless"])
        if bad:
            w = [x + "%%%" for x in w] if rng.random() < 0.5 else [x for x in w for _ in range(6)]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.mark.parametrize(("fit", "label"), [(fit_toxicity, "toxic"), (fit_quality, "quality")])
def test_held_out_accuracy_and_odd_rows(spark, fit, label):
    docs, labels = corpus(1)
    d, g = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit(d, g, crc_of_id() % 4 != 2, label)
    scored = score_texts(d, model).join(g, "doc_id").withColumn("held", crc_of_id() % 4 == 2).filter("held").collect()
    assert np.mean([(r["score"] >= 0.3) == r[label] for r in scored]) > 0.93
    assert all(0 <= r["score"] <= 1 for r in scored)
    odd = score_texts(spark.createDataFrame(ODD, "doc_id long, text string, score int"), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert len({r["score"] for r in odd if r["doc_id"] in (1, 2)}) == 1
    assert score_texts(d.limit(0), model).count() == 0


@pytest.mark.parametrize("fit", [fit_toxicity, fit_quality])
def test_without_labels_scores_are_even(spark, fit):
    docs, _ = corpus(2, 20)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len({r["score"] for r in score_texts(d, fit(d, none, F.lit(True))).collect()}) == 1


def test_trees_learn_and_calibration_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] * (x[:, 1] > 0) - 1)))
    y = (rng.random(2000) < p).astype(float)
    m = boosting.fit_trees(x[:1200], y[:1200]).margin(x[1200:])
    c = boosting.fit_isotonic(m, y[1200:])
    order = np.sort(m)
    assert (np.diff(c(order)) >= 0).all() and abs(c(m).mean() - y[1200:].mean()) < 0.02
    assert np.mean((c(m) - p[1200:]) ** 2) < np.mean((y.mean() - p[1200:]) ** 2) / 2


def test_features_of_long_texts_add_up():
    words = "you are a stup1d IDIOT!! "
    short, long = features(pa.array([words * 10]), lexicon({0: 0.0})), features(pa.array([words * 200_000]), lexicon({0: 0.0}))
    dense = [0, 7, 11, 12, 13, 14, 16]
    assert short[0, dense] == pytest.approx(long[0, dense], rel=1e-3) and short[0, 0] > 0 and short[0, 7] > 0


def test_pieces_and_spans():
    column = pa.array(["a bc", "", "def g", None, "h"])
    (data, offsets, first, low, high), *rest = list(pieces(column))
    assert (first, low, high) == (0, 0, len(data)) and not rest
    starts, ends, rows = spans(data, offsets, SPACES)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["a", "bc", "def", "g", "h"]
    assert rows.tolist() == [0, 0, 2, 2, 4]


def test_neighbours_match_brute_force():
    rng = np.random.default_rng(3)
    docs, labels = corpus(3, 120)
    column = pa.array([t for _, t in docs])
    x = term_counts(column)
    directions = leading_directions(lambda: iter([x[:50], x[50:]]), x.shape[1], 16)
    model = QualityModel(np.ones(x.shape[1], dtype=np.float32), directions, np.zeros((0, 0)), np.zeros(0), 0.5)
    model.vectors, model.labels = model.project(x[:80]), rng.integers(0, 2, 80).astype(float)
    got = model.score(column)
    z = model.project(x)
    for i in range(len(docs)):
        cosine = z[i] @ model.vectors.T
        near = np.argsort(-cosine)[:11]
        w = np.maximum(cosine[near], 0).astype(float) ** 8 + 1e-9
        assert got[i] == pytest.approx((w * model.labels[near]).sum() / w.sum(), abs=0.02)
    exact = np.linalg.svd(x, full_matrices=False)[2][:4]
    assert np.linalg.norm(exact @ directions, axis=1) == pytest.approx(np.ones(4), abs=0.02)


def plain_features(text, learned):
    """The features by a walk over words, for texts of ASCII."""
    import re

    from weft.llm import toxicity as t

    words = re.findall(r"[A-Za-z0-9]+", text)
    low = [w.lower() for w in words]
    fixed = [w in t.INSULTS for w in low]
    word = [learned.get(w, 0.0) for w in low]
    begin = [max([learned.get(w[:k] + "*", 0.0) for k in t.BEGINNINGS if len(w) > k] or [0.0]) for w in low]
    you = [w in t.SECOND_PERSON for w in low]
    hit = [i for i in range(len(low)) if fixed[i] or word[i] > 0 or begin[i] > 0]
    near = [min([abs(i - k) for k in range(len(low)) if you[k]] or [50]) for i in hit] if any(you) else []
    letters, upper = sum(c.isalpha() for c in text), sum(c.isupper() for c in text)
    marks = sum(not c.isalnum() and c not in " \t\n\v\f\r" for c in text)
    inner = sum(text[i - 1].isalpha() and text[i + 1].isalpha() and not text[i].isalpha() and text[i] not in " \t\n\v\f\r'-" for i in range(1, len(text) - 1))
    odd = 0
    for w in re.findall(r"[^ \t-\r]+", text):
        meant = "".join(t.LEET.get(c, c.lower()) for c in w)
        meant = "".join(c for c in meant if c.isalpha())
        if not all(c.isalpha() for c in w) and (meant in t.INSULTS or learned.get(meant, 0) > 0) and meant != "".join(c.lower() for c in w if c.isalnum()):
            odd += 1
    n, f, w, b = max(len(low), 1), sum(fixed), sum(x > 0 for x in word), sum(x > 0 for x in begin)
    one = np.log1p
    return [
        f / n, one(f), sum(word) / n, one(w), sum(begin) / n, one(b), max([max(word[i], begin[i]) for i in hit] or [0.0]), odd / n, one(odd),
        1 / (1 + min(near or [50])), sum(d <= t.NEAR for d in near) / max(f + w + b, 1), sum(you) / n, upper / max(letters, 1),
        sum(x.isalnum() and len(x) > 2 and all(c.isupper() for c in x) for x in words) / n, text.count("!") / n, marks / n, inner / n, one(len(low)), one(f + w + b),
    ]


def test_features_match_a_plain_walk():
    from weft.llm import toxicity as t

    known = {"zork": 1.5, "grum": 0.5, "blat*": 2.0, "snarfl*": 0.25}
    entries = {t.hash_word(w, t._VALUES): v for w, v in known.items() if not w.endswith("*")}
    entries |= {t.hash_word(w[:-1], t._VALUES) ^ (len(w) - 1): v for w, v in known.items() if w.endswith("*")}
    rng = random.Random(4)
    bits = ["you", "YOUR", "idiot", "1d10t", "m0ron", "zork", "Zork!", "grum,", "blatter", "blat", "snarfled", "it's", "well-known", "a1b", "HELLO", "fine", "x", "99", "...", "\n", "w*rd"]
    texts = ["", " ", "you", "idiot you"] + [" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    got = features(pa.array(texts), lexicon({0: 0.0} | entries))
    for row, text in zip(got, texts, strict=True):
        assert row.tolist() == pytest.approx(plain_features(text, known)), text


def test_trees_match_plain_splits():
    """Every split of every tree is the best by a plain look at all cuts, and every leaf the damped Newton step."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (120, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3) | (rng.random(120) < 0.1)).astype(float)
    trees = boosting.fit_trees(x, y, trees=4, depth=2)
    margin = np.full(120, np.log(y.mean() / (1 - y.mean())))
    for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        part = [np.arange(120)]
        for node in range(3):
            own = part[node]
            gain = lambda j, c: (lambda r: 0.0 if min(h[own[~r]].sum(), h[own[r]].sum()) < 0.4 else g[own[~r]].sum() ** 2 / (h[own[~r]].sum() + 1) + g[own[r]].sum() ** 2 / (h[own[r]].sum() + 1) - g[own].sum() ** 2 / (h[own].sum() + 1))(x[own, j] > c)
            best = max([gain(j, c) for j in range(3) for c in np.unique(x[:, j])] + [0.0])
            assert (gain(int(feature[node]), cut[node]) if np.isfinite(cut[node]) else 0.0) == pytest.approx(max(best, 0.0), abs=1e-9)
            right = x[own, feature[node]] > cut[node]
            part += [own[~right], own[right]]
        for k, own in enumerate(part[3:]):
            assert leaf[k] == pytest.approx(0.15 * g[own].sum() / (h[own].sum() + 1))
            margin[own] += leaf[k]
    assert trees.margin(x) == pytest.approx(margin)


@pytest.mark.parametrize("piece", [1, 23, 64, 500])
def test_no_feature_depends_on_where_a_text_is_cut(monkeypatch, piece):
    """Nearness, word pairs, repeats and letter triples across a cut count as anywhere else."""
    from weft.llm import quality, textcounts

    rng = random.Random(9)
    bits = ["you", "idiot", "m0ron", "your", "fine", "HELLO", "it's", "w*rd", "a", "a", "the-end", "\n", "  ", "ß"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(0, 400))) for _ in range(25)]
    texts += ["x" * 700 + " you idiot " + "y" * 300, "you " + "fill " * 48 + "idiot", "idiot " + "fill " * 51 + "you", " " * 300, "a,b" * 200, None]
    column = pa.array(texts)
    want = features(column, lexicon({0: 0.0})), quality.term_counts(column)
    monkeypatch.setattr(textcounts, "PIECE", piece)
    assert np.allclose(features(column, lexicon({0: 0.0})), want[0], rtol=1e-12)
    assert np.allclose(quality.term_counts(column), want[1], rtol=1e-6)


def test_nearest_neighbours_of_ties_are_the_first():
    from weft.llm.quality import nearest

    rng = np.random.default_rng(3)
    cosine = rng.integers(0, 6, (50, 40)) / 8
    for k in (1, 7, 40):
        want = [sorted(sorted(range(40), key=lambda j, row=row: (-row[j], j))[:k]) for row in cosine]
        assert nearest(cosine, k).tolist() == want
