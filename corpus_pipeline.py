"""A training corpus from raw documents: quality, toxicity, near-duplicates, mixture, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps, with the
columns of its input; the last returns token ids. A stage works on the whole of
what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import Scratch, crc_of_id, free_name, table
from weft.llm.mixing import mixed_rows
from weft.llm.ngram_join import ngram_jaccard_join
from weft.llm.quality import fit_quality
from weft.llm.queries import PIECES, THRESHOLD
from weft.llm.sentencepiece import encode_texts
from weft.llm.toxicity import fit_toxicity, score_texts

#: Words of a shingle, and the similarity from which documents are near-duplicates.
WORDS, NUM, DEN = 5, 8, 10


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; a null text is scored as an empty one."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), crc_of_id() % 5 != 0)
    score = free_name(docs, "score")
    return score_texts(docs, model, score).filter(F.col(score) >= THRESHOLD).drop(score)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), crc_of_id() % 4 != 2)
    score = free_name(docs, "score")
    return score_texts(docs, model, score).filter(F.col(score) < THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least doc_id.

    Rows that share a doc_id are one document and stay or go together; rows
    without one stay.
    """
    joined = ngram_jaccard_join(docs, WORDS, NUM, DEN)
    gone = joined.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*_own(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, up to three times; rows without words aren't taken."""
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, token_ids`` of every row."""
    encoded = encode_texts(docs.select("doc_id", "source", "text"), PIECES)
    return encoded.select("doc_id", "source", F.size("token_ids").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality classifier", quality_filter),
    ("toxicity", toxicity_filter),
    ("n-gram jaccard join", near_duplicates),
    ("mixing to target weights", mixture),
    ("sentencepiece encoding", tokens),
]

#: Scores, seeded hashes and token ids have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage keeps is written before the next reads it."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.put(docs)
    return docs
