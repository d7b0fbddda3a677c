import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm.chat import assemble, conversation_digests, escape, format_conversations, format_turns, parse, unescape
from weft.llm.queries import CONTROL

TEXT = st.text(max_size=40) | st.lists(st.sampled_from(["<", "|", "\\", "<|im_end|>", "<|im_start|>", "\n", "é", "a"]), max_size=20).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=6))
def test_turns_read_back(turns):
    out, begin, end = format_turns(pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string()))
    assert parse("".join(out.to_pylist())) == turns
    for whole, a, b, (_, t) in zip(out.to_pylist(), begin, end, turns, strict=True):
        assert unescape(whole[a:b]) == t and "<|" not in whole[a:b]


def test_assembly():
    column = pa.array(["x", "", "éé"], pa.large_string())
    assert assemble([b"<", column, b">", column], 3).to_pylist() == ["<x>x", "<>", "<éé>éé"]
    assert assemble([b"a"], 0).to_pylist() == []
    assert assemble([column.slice(1), b"!"], 2).to_pylist() == ["!", "éé!"]
    assert escape(pa.array(["<|a <\\|b"], pa.large_string())).to_pylist() == ["<\\|a <\\\\|b"]


def test_digests(spark):
    rows = [(1, 1, "assistant", "b" * 10, 0), (1, 0, "user", "a", 0), (2, 0, None, None, 0), (-1, 0, "user", CONTROL, 0), (-1, 1, "assistant", CONTROL, 0), (None, 0, "assistant", "q", 0), (3, None, "assistant", "last", 0), (3, 5, "assistant", "first", 0), (3, 5, "assistant", "first", 0)]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i} " * 500, 0) for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk int")
    got = {r["conv_id"]: r for r in conversation_digests(format_conversations(df)).collect()}
    by = {}
    for c, turn, role, text, _ in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0)):
        by.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert format_conversations(df).filter("conv_id = 9").count() > 1
    assert format_conversations(df.limit(0)).count() == 0
