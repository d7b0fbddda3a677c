import random
import struct

import pytest
import sentencepiece as library

from weft.llm.queries import PIECES
from weft.llm.sentencepiece import PieceModel, Viterbi, decode_ids, encode_texts


@pytest.fixture(scope="module")
def model():
    with open(PIECES, "rb") as f:
        return PieceModel(f.read())


@pytest.fixture(scope="module")
def processor():
    return library.SentencePieceProcessor(model_file=PIECES)


def texts(seed, n=400):
    rng = random.Random(seed)
    alphabets = ["abcdetherin  ", "aàéè lest", " \n\tab", "日本語の ", "🙂é\u0000%% &", "theinganderon"]
    out = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(0, 200))) for _ in range(n)]
    return out + [" " * k + w for k in range(40) for w in ("", "the", "é", "日")] + ["", "x" * 5000, "thein" * 2000]


def test_ids_equal_the_library(model, processor):
    for t in texts(1):
        assert model.encode(t).tolist() == processor.encode(t), repr(t)


def test_round_trip(model):
    for t in texts(2):
        assert model.decode(model.encode(t).tolist()) == t


def test_streaming_equals_merging(model):
    rng = random.Random(3)
    for _ in range(30):
        word = "".join(rng.choice("theinrasou") for _ in range(rng.randrange(300, 2500)))
        search = Viterbi(model)
        for k in range(0, len(word), 97):
            search.push(word[k : k + 97])
        assert search.finish() == [i for p in model.merge(word) for i in model._spell(p)]


def test_committed_early(model):
    search = Viterbi(model)
    for _ in range(40):
        search.push("theinrasou" * 10)
    assert len(search.text) < 300 and search.ids


def test_pairs_by_ranks_equal_pairs_by_merging(model):
    rng = random.Random(4)
    pieces = sorted(p for p in model.usable if "▁" not in p)
    for _ in range(4000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        assert model._apart(a, b) == (model.merge(a + b) == [a, b]), (a, b)


def _field(number, kind, value):
    head = bytes([number << 3 | kind]) if number < 16 else bytes([number << 3 & 127 | 128 | kind, number >> 4])
    return head + (bytes([len(value)]) + value if kind == 2 else value)


def test_unigram_takes_the_best_sum():
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -3.5, 1), ("ba", -2.5, 1), ("▁ab", -4.0, 1), ("abab", -9.0, 1)]
    data = b"".join(_field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, bytes([t]))) for p, s, t in pieces)
    data += _field(2, 2, _field(3, 0, b"\x01")) + _field(3, 2, _field(3, 0, b"\x01") + _field(4, 0, b"\x00"))
    model = PieceModel(data)
    scores = {p: s for p, s, t in pieces if t == 1}

    def best(text):
        if not text:
            return 0.0
        return max(scores.get(text[:k], -13.0 - 6 if k == 1 else -1e9) + best(text[k:]) for k in range(1, min(4, len(text)) + 1))

    rng = random.Random(5)
    for _ in range(200):
        t = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 9)))
        ids = model.encode(t).tolist()
        marked = "▁" + t.replace(" ", "▁")
        assert "".join(model.pieces[i] for i in ids) == marked
        assert sum(model.scores[i] for i in ids) == pytest.approx(best(marked))
    # a long text makes the window commit; its sum is that of a plain search over all of it
    long = "▁" + "ab" * 3000 + "ba" * 500
    sums = [0.0] + [-1e18] * len(long)
    for at in range(len(long)):
        for k in range(1, 5):
            if (score := scores.get(long[at : at + k])) is not None and at + k <= len(long):
                sums[at + k] = max(sums[at + k], sums[at] + score)
    search = Viterbi(model)
    for k in range(0, len(long), 100):
        search.push(long[k : k + 100])
    assert search.ids and len(search.text) < 200
    assert sum(model.scores[i] for i in search.finish()) == pytest.approx(sums[-1])


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world\n", "x"), (3, "Hello  world\n", "x"), (None, "a" * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    back = decode_ids(encode_texts(df, PIECES), PIECES).collect()
    assert [(r["doc_id"], r["decoded"]) for r in back] == [(d, t or "") for d, t, _ in rows]
    assert encode_texts(df.limit(0), PIECES).count() == 0


def test_odd_ids_and_names(spark):
    """Ids that the model doesn't have read as unknown, a null stands for nothing; columns of any name and type are kept."""
    hello = encode_texts(spark.createDataFrame([("Hello",)], "text string"), PIECES).first()["token_ids"]
    rows = [(1, [-1], (1,)), (2, [None, *hello, None], (2,)), (3, [10**6], None), (4, None, None), (5, [], None)]
    got = decode_ids(spark.createDataFrame(rows, "id long, token_ids array<int>, s struct<`a-b`:int>"), PIECES).collect()
    assert [r["decoded"] for r in got] == ["⁇ ", "Hello", "⁇ ", "", ""] and got[0]["s"]["a-b"] == 1


def test_spaces_take_the_same_search(model):
    for n in range(1, 60):
        for word in ("", "the", "q"):
            text = "▁" * n + word
            assert Viterbi(model).run(text) == [i for p in model.merge(text) for i in model._spell(p)]
