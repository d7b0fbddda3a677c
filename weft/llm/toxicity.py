"""Toxicity scores: boosted trees over dense features of the text, calibrated by isotonic regression.

Features are densities of lexicon words, how near they stand to words for the
second person, capitals, punctuation and obfuscation. The lexicon is a short
fixed list and what the labelled sample shows: words and word beginnings that
toxic documents hold far more often than others. The sample is dealt into
folds. Its own features rest on what the other folds show, and the calibration
on margins of trees that were fit to the other folds, so that all of it serves
for all three and nothing is judged by what it taught.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.boosting import Isotonic, Trees, fit_isotonic, fit_trees
from weft.llm.common import Scratch, arrow_schema, bounded_batches, slices
from weft.llm.textcounts import DIGITS, LETTERS, LOWER, SPACES, UPPER, Hasher, hash_word, letter_values, pieces, spans

# Common insults, and words for the second person, of the four languages.
INSULTS = "idiot moron stupid dumb loser pathetic worthless disgusting trash scum clown fool imbecile cretin jerk bastard bitch shit crap fuck fucking asshole retard freak pig vermin filth garbage idiota imbécil estúpido basura asqueroso idiote imbécile stupide salaud connard ordure dégueulasse dumm trottel abschaum arschloch schwein dreck".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

#: Labelled rows that the classifier is fit on at most, those of least hash.
SAMPLE = 12_000
#: Words and beginnings that are learned at most, and how far they must stand out, in standard deviations.
LEARNED, STANDS_OUT = 4096, 5.9
FOLDS = 3
#: Bytes of the word beginnings.
BEGINNINGS = (4, 5, 6)
#: Words within which an insult counts as near a second person, and beyond which nearness is none.
NEAR, FAR = 5, 50

_PLAIN = LOWER.copy()
_PLAIN[~(LETTERS | DIGITS)] = 0
_VALUES = letter_values(_PLAIN)
_LEET = LOWER.copy()
for _a, _b in LEET.items():
    _LEET[ord(_a)] = ord(_b)
_LEET[~LETTERS[_LEET]] = 0
_LEET_VALUES = letter_values(_LEET)
_SPLITS = ~(LETTERS | DIGITS)
FEATURES = 19


@dataclass
class Lexicon:
    """Hashes in ascending order and a weight for each."""

    hashes: np.ndarray
    weights: np.ndarray

    def __post_init__(self) -> None:
        self.hint = np.zeros(1 << 16, dtype=bool)
        self.hint[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def weight(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes))
        maybe = np.flatnonzero(self.hint[(hashes >> np.uint64(48)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            out[maybe] = np.where(self.hashes[at] == hashes[maybe], self.weights[at], 0.0)
        return out


def lexicon(entries: dict[int, float]) -> Lexicon:
    keys = np.array(sorted(entries), dtype=np.uint64)
    return Lexicon(keys, np.array([entries[int(k)] for k in keys]))


_FIXED = lexicon({hash_word(w, _VALUES): 1.0 for w in INSULTS})
_YOU = lexicon({hash_word(w, _VALUES): 1.0 for w in SECOND_PERSON})


def _kinds(hasher: Hasher, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of words and, marked apart from those, of their beginnings; 0 for words that are no longer."""
    out = [hasher(starts, ends)]
    for k in BEGINNINGS:
        long = ends - starts > k
        out.append(np.where(long, hasher(starts, np.minimum(starts + k, ends)) ^ np.uint64(k), np.uint64(0)))
    return out


def features(column: pa.Array, learned: Lexicon) -> np.ndarray:
    """A row of densities and nearnesses for each text."""
    rows = len(column)
    sums, near = np.zeros((rows, 16)), np.full(rows, float(FAR))

    def add(k: int, at: np.ndarray, weights: np.ndarray | None = None) -> None:
        sums[first : first + n, k] += np.bincount(at, weights, n)

    for data, offsets, first, low, high in pieces(column, margin=FAR, inner=_SPLITS):
        n = len(offsets) - 1
        if not len(data):
            continue
        starts, ends, row = spans(data, offsets, _SPLITS)
        own = (starts >= low) & (starts < high)
        hasher = Hasher(data, _VALUES)
        kinds = _kinds(hasher, starts, ends)
        fixed = _FIXED.weight(kinds[0])
        word, begin = learned.weight(kinds[0]), np.max([learned.weight(h) for h in kinds[1:]], axis=0)
        hit = ((fixed > 0) | (word > 0) | (begin > 0)) & own
        you = _YOU.weight(kinds[0]) > 0
        mine = row[own]
        add(0, mine)
        add(1, mine, fixed[own])
        add(2, mine, word[own])
        add(3, mine, (word > 0)[own].astype(float))
        add(4, mine, begin[own])
        add(5, mine, (begin > 0)[own].astype(float))
        add(6, mine, you[own].astype(float))
        np.maximum.at(sums[:, 7], first + row[hit], np.maximum(word, begin)[hit])
        # words are counted along with the margin, so that persons beyond a cut are as near as they are
        places, persons = np.flatnonzero(hit), np.flatnonzero(you)
        if len(places) and len(persons):
            k = np.searchsorted(persons, places)
            distance = np.full(len(places), float(FAR))
            for other in (persons[np.minimum(k, len(persons) - 1)], persons[np.maximum(k - 1, 0)]):
                same = row[other] == row[places]
                distance[same] = np.minimum(distance[same], np.abs(other - places)[same])
            np.minimum.at(near, first + row[places], distance)
            add(8, row[places], (distance <= NEAR).astype(float))
        of_byte = np.repeat(np.arange(n), np.diff(offsets))[low:high]
        letter, upper, digit, space = LETTERS[data], UPPER[data], DIGITS[data], SPACES[data]
        capital = np.concatenate([[0], np.cumsum(upper)])
        all_caps = (capital[ends] - capital[starts] == ends - starts) & (ends - starts > 2)
        add(9, mine, all_caps[own].astype(float))
        add(10, of_byte, upper[low:high].astype(float))
        add(11, of_byte, letter[low:high].astype(float))
        add(12, of_byte, (data == 33)[low:high].astype(float))
        mark = ~(letter | digit | space)
        add(13, of_byte, mark[low:high].astype(float))
        inner = np.zeros(len(data), dtype=bool)
        inner[1:-1] = letter[:-2] & letter[2:] & (mark | digit)[1:-1] & (data[1:-1] != 39) & (data[1:-1] != 45)
        # the first and the last byte of a row have a neighbour in another one
        some = np.diff(offsets) > 0
        inner[offsets[:-1][some]] = inner[offsets[1:][some] - 1] = False
        add(14, of_byte, inner[low:high].astype(float))
        # words between spaces whose disguised letters spell a word of the lexicon
        b, e, r = spans(data, offsets, SPACES)
        odd = np.concatenate([[0], np.cumsum(~letter)])
        some = (odd[e] > odd[b]) & (b >= low) & (b < high)
        if some.any():
            h = Hasher(data, _LEET_VALUES)(b[some], e[some])
            plain = hasher(b[some], e[some])
            meant = (_FIXED.weight(h) > 0) | (learned.weight(h) > 0)
            add(15, r[some], (meant & (h != plain)).astype(float))
    words, letters = np.maximum(sums[:, 0], 1), np.maximum(sums[:, 11], 1)
    return np.column_stack([
        sums[:, 1] / words, np.log1p(sums[:, 1]), sums[:, 2] / words, np.log1p(sums[:, 3]), sums[:, 4] / words, np.log1p(sums[:, 5]),
        sums[:, 7], sums[:, 15] / words, np.log1p(sums[:, 15]), 1 / (1 + near), sums[:, 8] / np.maximum(sums[:, 1] + sums[:, 3] + sums[:, 5], 1), sums[:, 6] / words,
        sums[:, 10] / letters, sums[:, 9] / words, sums[:, 12] / words, sums[:, 13] / words, sums[:, 14] / words, np.log1p(sums[:, 0]), np.log1p(sums[:, 1] + sums[:, 3] + sums[:, 5]),
    ])


@dataclass
class ToxicityModel:
    learned: Lexicon
    trees: Trees
    calibration: Isotonic

    def score(self, column: pa.Array) -> np.ndarray:
        margin = self.trees.margin(features(column, self.learned))
        # a hundredth of the raw probability orders what the calibration holds equal
        return 0.99 * self.calibration(margin) + 0.01 / (1 + np.exp(-margin))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, limit: int, scratch: Scratch) -> DataFrame:
    """``doc_id, text, y, turn`` for at most ``limit`` labelled documents, those of least hash; ``turn`` deals them out.

    A doc_id that is labelled more than once counts by the mean of its labels;
    of several documents with one doc_id the text of least hash counts, so that
    the limit bounds the rows as well.
    """
    known = labels.filter(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    kept = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(limit)
    # the bound of the sample bounds what is broadcast
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text")).join(F.broadcast(kept), "doc_id").groupBy("doc_id", "y", "h").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return scratch.put(texts.select("doc_id", "text", "y", F.pmod("h", F.lit(FOLDS)).cast("int").alias("turn")))


def _learn_lexicons(sample: DataFrame) -> list[Lexicon]:
    """What the whole sample shows, then what it shows without each of its folds."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            held = [np.zeros((2, 0), dtype=np.uint64)]
            for data, offsets, first, _, _ in pieces(batch.column(0)):
                starts, ends, row = spans(data, offsets, _SPLITS)
                for h in _kinds(Hasher(data, _VALUES), starts, ends):
                    one = np.stack([(first + row).astype(np.uint64), h])[:, h != 0]
                    held.append(np.unique(one, axis=1) if one.shape[1] else one)
            # a text counts once for a word, however many parts it was taken in
            once = np.concatenate(held, axis=1)
            once = np.unique(once, axis=1) if once.shape[1] else once
            if once.shape[1]:
                at = pa.array(once[0].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(once[1].astype(np.int64)), batch.column(1).take(at), batch.column(2).take(at)], names=["h", "y", "turn"])

    per = {r["turn"]: (r["n"], r["t"]) for r in sample.groupBy("turn").agg(F.count("*").alias("n"), F.sum("y").alias("t")).collect()}
    folds = [F.sum((F.col("turn") == f).cast("int")).alias(f"n{f}") for f in range(FOLDS)] + [F.sum(F.when(F.col("turn") == f, F.col("y")).otherwise(0.0)).alias(f"t{f}") for f in range(FOLDS)]
    seen = sample.select("text", "y", "turn").mapInArrow(words, "h long, y double, turn int").groupBy("h").agg(*folds).persist()
    out = []
    for left_out in (None, *range(FOLDS)):
        used = [f for f in range(FOLDS) if f != left_out]
        total, bad = (sum(per.get(f, (0, 0.0))[k] for f in used) for k in (0, 1))
        if not bad or bad == total:
            out.append(lexicon({0: 0.0}))
            continue
        rate = bad / total
        n, t = (sum((F.col(f"{k}{f}") for f in used), F.lit(0.0)) for k in "nt")
        counted = seen.select("h", n.alias("n"), t.alias("t")).filter("n > 0")
        apart = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
        weight = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (total - bad + 1))
        rows = counted.withColumn("apart", apart).filter(F.col("apart") >= STANDS_OUT).select("h", weight.alias("w"), "apart").orderBy(F.desc("apart"), "h").limit(LEARNED).collect()
        out.append(lexicon({0: 0.0} | {int(np.int64(r["h"]).astype(np.uint64)): float(r["w"]) for r in rows if r["w"] > 0}))
    seen.unpersist()
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", limit: int = SAMPLE) -> ToxicityModel:
    """Fit on at most ``limit`` labelled rows for which ``train`` holds; without any, as for empty tables, all scores are even.

    Repeated rows and labels are as ``labelled_sample`` has them; ties of hash
    go by doc_id. Texts of any length are whole.
    """
    scratch = Scratch(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, train, limit, scratch)
    lexicons = _learn_lexicons(sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            turn = batch.column(2).to_numpy()
            x = np.zeros((batch.num_rows, FEATURES))
            for f in range(FOLDS):
                own = np.flatnonzero(turn == f)
                if len(own):
                    x[own] = features(batch.column(0).take(pa.array(own)), lexicons[1 + f])
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64())), batch.column(1), batch.column(2), batch.column(3)], names=["x", "y", "turn", "doc_id"])

    got = sample.select("text", "y", "turn", "doc_id").mapInArrow(rows, "x array<double>, y double, turn int, doc_id long").orderBy("doc_id").collect()
    scratch.drop(sample)
    x, y, turn = np.array([r["x"] for r in got]).reshape(-1, FEATURES), np.array([r["y"] for r in got]), np.array([r["turn"] for r in got])
    margin = np.zeros(len(y))
    for f in range(FOLDS):
        margin[turn == f] = fit_trees(x[turn != f], y[turn != f]).margin(x[turn == f])
    return ToxicityModel(lexicons[0], fit_trees(x, y), fit_isotonic(margin, y))


def score_texts(docs: DataFrame, model, name: str = "score") -> DataFrame:
    """``docs`` with a score of the whole ``text``; a null text counts as empty.

    Every row is scored by its text alone: repeated rows alike, an empty table
    not at all, and a text of any length as a whole, in parts that overlap.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(batch.column(at)))], names=[*batch.schema.names, name])

    return docs.mapInArrow(scored, arrow_schema(docs, (name, "double")))
