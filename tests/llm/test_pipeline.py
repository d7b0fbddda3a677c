import random

import corpus_pipeline as p
from tests.llm.test_ngram_join import plain_components
from weft.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, tmp_path):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    docs, labels = [], []
    for i in range(260):
        w = [rng.choice(words) for _ in range(rng.randrange(30, 80))]
        bad, toxic = i % 9 == 1, i % 7 == 2
        if toxic:
            w[5:6] = ["you", "idiot"]
            w[20:20] = ["worthless", "scum"]
        if bad:
            w = [x + "%%%" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(1000 + i, docs[i][1]) for i in (0, 3, 4)] + [(1100, docs[5][1] + " more"), (1200, None), (1201, "")]
    rows = [(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in docs] + [(None, "no number here at all", "en", None, 5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows, labels


def test_stages(spark, tmp_path):
    sf_dir, rows, labels = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for name, stage in p.STAGES:
        out = stage(spark, kept[-1], sf_dir)
        assert name and (stage is p.tokens or out.columns == docs.columns)
        out.write.parquet(f"{tmp_path}/{len(kept)}")
        kept.append(spark.read.parquet(f"{tmp_path}/{len(kept)}"))
    ids = [sorted(r["doc_id"] for r in k.collect() if r["doc_id"] is not None) for k in kept]
    good = {d for d, q, _ in labels if q}
    clean = {d for d, _, t in labels if not t}
    assert len(good - set(ids[1])) <= 3 and len(set(ids[1]) & {d for d, q, _ in labels if not q}) <= 3
    assert len(clean & set(ids[1]) - set(ids[2])) <= 3 and len(set(ids[2]) & {d for d, _, t in labels if t}) <= 5
    before = [(r["doc_id"], r["text"]) for r in kept[2].collect() if r["doc_id"] is not None]
    roots = plain_components(before, p.WORDS, p.NUM, p.DEN)
    assert ids[3] == sorted(d for d, r in roots.items() if d == r)
    times = {r["doc_id"]: r["taken"] // r["size"] for r in queries.mix_sources(kept[3]).collect() if r["taken"] and r["doc_id"] is not None}
    assert ids[4] == sorted(d for d, n in times.items() for _ in range(n))
    assert ids[5] == ids[4] and kept[5].filter("size(token_ids) <> n_tokens OR n_tokens = 0").count() == 0


def test_odd_input(spark, tmp_path):
    sf_dir, rows, _ = corpus(spark, tmp_path)
    for odd in ([], [(1, None, None, None, None)] * 2, [(None, "a b", "en", "s", 3), (2, "x " * 5000, None, None, 0)]):
        docs = spark.createDataFrame(odd, SCHEMA)
        for _, stage in p.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs.count()


def test_clashing_columns(spark, tmp_path):
    """Columns named like those that stages make, and one with a dash, come through every stage as they were."""
    sf_dir, rows, _ = corpus(spark, tmp_path)
    docs = spark.createDataFrame([(*r, 0.5, 7, "t", r[0]) for r in rows], SCHEMA + ", score double, times int, copy string, `a-b` long")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/c{_.replace(' ', '')}")
        docs = spark.read.parquet(f"{tmp_path}/c{_.replace(' ', '')}")
    kept = docs.collect()
    assert kept and all(r["score"] == 0.5 and r["times"] == 7 and r["copy"] == "t" and r["a-b"] == r["doc_id"] for r in kept)


def test_mixture_writes_the_words_that_it_takes(spark):
    """Ids that repeat, with other texts too, and rows without one: each source gets what its target says."""
    rng = random.Random(8)
    rows = [(None if k % 5 == 0 else k // 4, " ".join("w" * rng.randrange(1, 30)).strip() if k % 7 else None, "en", "abc"[k % 3] if k % 11 else None, k) for k in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken, written = {}, {}
    for r in queries.mix_sources(docs).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    out = p.mixture(spark, docs, "")
    assert out.columns == docs.columns
    for r in out.collect():
        written[r["source"]] = written.get(r["source"], 0) + len((r["text"] or "").split())
    assert written == {s: n for s, n in taken.items() if n}
