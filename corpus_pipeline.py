"""The training-data pipeline: stages over ``documents``, each written and read by the next.

A document goes if no language has a third of its words or fits its trigrams, if a near copy with a smaller id stays,
or if nothing but benchmark passages is in it; benchmark passages are cut out of the others, and
secrets are replaced by a mark. What is left is mixed to the target weights, which adds the
epoch a document is read in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm import decontaminate, language_mix, mixing, secret_scan, simhash
from tallywork.llm.queries import MOST_EPOCHS, SEED, SHARE, WEIGHTS, tree
from tallywork.operators.stages import written

LEAST_SCORE = 1 / 3
SIMILARITY = 0.8


def _measured(docs: DataFrame) -> DataFrame:
    """The length that belongs to a text that may have changed."""
    return docs.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one language has a third of the words and fits as labelled ones do.

    Null texts and those without letters go. Rows are judged one by one, so repeated rows stay
    or go together; ties between languages go to the one that sorts first.
    """
    labelled = docs.where(~language_mix.held_out())
    model = language_mix.learn(labelled)
    return language_mix.accepted(docs, model, least_score=LEAST_SCORE, fits=language_mix.typical_fits(labelled, model))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingles of five words, that with the least id.

    Texts without words are linked with each other. Repeated rows of the id that stays all stay;
    rows without an id go if a linked one has an id, else they stay.
    """
    return simhash.one_of_each(docs, shingle=5, similarity=SIMILARITY)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that were nothing else go.

    Null and blank texts without a passage stay as they are; repeated rows are cut alike.
    """
    return _measured(decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), drop_emptied=True))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each secret; null texts and repeated rows stay."""
    return _measured(secret_scan.redacted(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to the weights, a row for each epoch that reads them.

    Null texts have no tokens; missing names of a level are a source of their own; rows of equal
    place in the seeded order are read together.
    """
    return mixing.mixed(docs, tree(), SHARE, WEIGHTS, most_epochs=MOST_EPOCHS, seed=SEED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("languages", languages),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("secrets", secrets),
    ("mixture", mixture),
]

#: Language inference and fingerprints are beyond SQL; the stages are tested one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are kept as a table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{i + 1}")
    return docs
