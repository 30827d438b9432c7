"""Corpus pipeline: toxicity, near-duplicate join, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodgemetrics.llm import decontaminate, jaccard_join, packing, pii, toxicity
from lodgemetrics.llm.queries import table, vocabulary
from lodgemetrics.llm.shared import staged, without_rows


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labelled rows of docs, does not predict toxic."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return without_rows(docs, toxicity.score(docs, machine, with_key=True).filter(F.col("predicted") == 1))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more: the least doc_id.

    Documents without words and rows without an id are linked with nothing and stay. Rows are told apart by id and text, so
    a repeated id loses only the texts that a smaller id has; rows that share the least id stay.
    """
    groups = jaccard_join.similar_groups(docs, jaccard_join.Rule(n=5, percent=80), with_key=True)
    return without_rows(docs, groups.filter(F.col("component_id") < F.col("doc_id")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"), short_windows=True)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal data replaced by its kind; n_chars follows the text where it told its length."""
    clean = pii.redact(docs, pii.fit(docs))
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 4096 tokens."""
    return packing.packed(docs, vocabulary()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_similar),
    ("decontamination", drop_leaks),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

#: Scores of a fitted model decide what is kept, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
