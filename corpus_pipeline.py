"""The corpus pipeline: five operators in a row, each on all that the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``docs``. Between stages rows are written as Parquet
to the folder that all executors share, so a lost executor costs no more than
the stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetloom.llm import bpe, decontaminate, near, queries, substrings, toxicity
from streetloom.plans.shared import materialise, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, training=queries.remainder(4) != 2)
    return toxicity.drop_toxic(docs, model, queries.TOXIC_THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, similarity 0.8) the document of least id."""
    return near.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings that repeat; ``n_chars`` follows the text. One that loses all stays, empty."""
    left = substrings.remove_repeats(docs)
    return left.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, *queries.tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("byte_bpe", tokenize),
]

#: Fingerprints, suffix arrays, fitted scores and merges are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = materialise(stage(spark, docs, sf_dir))
        release(docs)  # a table of the stage before; the input has none
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
