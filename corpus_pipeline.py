"""A training corpus in five stages, each one of the operators of the library.

A stage takes (spark, docs, sf_dir) and returns what it keeps; what a stage
returns is written as Parquet and read again as the next one's ``docs``.  All
but the last return the columns of ``documents``.
"""

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from chronofact.llm import decontam, near_dup, packing, queries, secrets, store, toxicity

#: Rows that go to a Python worker at a time.  Some texts are very long, and both
#: sides hold a batch whole.
BATCH_ROWS = 2000


def stage(f):
    """``f`` in a session whose batches are small enough for texts."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))
        return f(spark, docs, sf_dir)

    return run


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a model of the labelled ones."""
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of near-duplicates."""
    return near_dup.first_of_class(docs)


@stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return decontam.without_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


@stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and ``n_chars`` brought up to date."""
    return secrets.redact_secrets(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(packing.pieces(docs, queries.tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express the trained classifier of the first stage;
#: ``tests/llm/test_pipeline.py`` holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; tables between them in the shared folder,
    each removed when the next one is written."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    folder = f"{store.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        with store.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            store.remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
