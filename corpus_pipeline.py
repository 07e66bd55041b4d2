"""A training corpus from the table of documents, in five stages.

Toxic documents go; passages of several lines that stand elsewhere first go, and documents that
lose their last word to that; of near-duplicates one document stays; sources are mixed to their
target weights; the mix is encoded. Every stage but the last keeps the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdesk.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from sparkdesk.llm.common import fresh, read, whole
from sparkdesk.session import materialize, remove_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that compression distance, fitted on their labels, does not reject."""
    model = toxicity.learn(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages and chunks; a text that loses all of its words goes."""
    names = ("passages", "lines", "chunks", "removed")
    passages, lines, chunks, removed = fresh(docs.columns, *names)
    cleaned = line_dedup.dedup_passages(docs, removed=passages)
    cleaned = line_dedup.dedup_lines(cleaned, counts=(lines, chunks, removed))
    cleaned = cleaned.withColumn(removed, F.col(removed) + F.col(passages))
    has_word = whole(F.col("text")).rlike(line_dedup.WORD)
    cleaned = cleaned.where((F.col(removed) == 0) | has_word)
    if "n_chars" in docs.columns:
        now = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", now)
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8."""
    return ngram_join.keep_one(docs, n=5, of=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text they decode to."""
    return bpe.digests(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# Compression lengths and byte-pair encodings are beyond SQL; tests hold the stages against
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    A stage's table goes when the next one is written; the last is read by the result.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            remove_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
