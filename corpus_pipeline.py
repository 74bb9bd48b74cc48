"""The corpus pipeline: toxic documents, near duplicates and contaminated documents go, secrets are masked, the rest is tokenised.

All stages keep rows that they can't judge, those of a null id or of a null, empty or
blank text; repeated rows stay or go together; columns that a document has besides stay
as they are, whatever their names; an empty table gives an empty one. The classifier's
labels and the benchmark are read from sf_dir; without labels nothing is toxic, without
a benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ctxweave.llm import bpe, decontaminate, jaccard_join, secrets, toxicity
from ctxweave.runtime import prepare, shared_path, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    prepare(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the lowest doc_id, of each group of similar ones."""
    prepare(spark)
    return jaccard_join.drop_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    prepare(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked."""
    prepare(spark)
    return secrets.redact_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of all documents, and whether they decode to the text again: doc_id, tokens, n_tokens, round_trip."""
    prepare(spark)
    return bpe.encode(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_masking),
    ("bpe", tokens),
]

#: SQL can express neither the classifier nor the alignment nor the decoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            at = shared_path(spark, f"pipeline-{k}-{name}")
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
    return docs
