"""A corpus pipeline: language ID, exact dedup, near dedup, PII masking, packing into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession

from cohortline.llm import exact_dedup, jaccard_forest, langid, packing, pii
from cohortline.llm.common import remove, scope, written
from cohortline.llm.queries import ranks_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; the model learns from the labelled rows of its input."""
    return langid.accepted(docs, langid.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text."""
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the largest doc_id."""
    return jaccard_forest.survivors(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked."""
    return pii.redacted(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack(docs, ranks_path())


STAGES = [("language", language), ("exact", exact), ("near", near), ("personal", personal), ("sequences", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(STAGES):
        with scope() as made:
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = written(docs)
                remove([*kept, *made[:-1]])  # the stage's result is written out: what it came from is done with
                kept = made[-1:]
    return docs


#: Models, tries and packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
