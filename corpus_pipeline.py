"""The corpus pipeline: documents in, packed bins out.

Each stage takes (spark, docs, sf_dir), calls one operator on all that the stage before it kept, and returns a DataFrame, which is written and read again as the next
stage's docs. All but the last return the columns of documents. A null text counts as empty; rows without doc_id pass the filters like
others, and neither near-duplicate classes nor shared passages are sought for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm.common import kept, reachable, table
from notemill.llm.near_dup import one_of_each
from notemill.llm.packing import measured, packed
from notemill.llm.quality import fit_quality, with_quality
from notemill.llm.sentence_spans import drop_repeats
from notemill.llm.toxicity import fit_toxicity, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't find toxic."""
    reachable(spark)
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers don't find of low quality."""
    return with_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand elsewhere before; n_chars follows the text."""
    left = drop_repeats(docs, counts=False)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and the bins that they are in."""
    return packed(measured(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", packing),
]

#: SQL can't express trained classifiers or greedy packing; tests/llm hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on documents."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = kept(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
