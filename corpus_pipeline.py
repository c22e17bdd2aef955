"""The corpus pipeline over documents: quality, near duplicates, benchmark leaks, personal data, packing.

STAGES lists (name, function) in order; each function takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame.
All but the last return the columns that docs came with; the last returns the packed pieces. Rows with null ids or texts, repeated
rows, extra columns of any name and empty tables are treated as the operators' docstrings say. Stages bound the session's Arrow batches, as their
results run after they return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import decontam, near_dup, packing, pii, quality
from evigraph.llm.common import bounded_batches, fresh, table_at, workdir
from evigraph.llm.queries import tokenizer_path

#: Percent of the union of two documents' five-word shingles that makes them near copies.
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier, fit on all labelled ones, doesn't reject (score of 0.5 or more)."""
    bounded_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")[0]
    return quality.score(docs, model, score).where(F.col(f"`{score}`") >= 0.5).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class: the one with the least doc_id. Of rows that share that doc_id those with equal texts count once;
    rows with null ids all stay."""
    bounded_batches(spark)
    name = fresh(docs, "kept_id")[0]
    kept = near_dup.near_duplicates(docs, percent=NEAR_PERCENT).where("kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    kept = table_at(kept, workdir(spark, "kept"))
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col(name), "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item within its edit budget; rows with null ids are judged by their own text."""
    bounded_batches(spark)
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind; n_chars follows the text."""
    bounded_batches(spark)
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all ids of all documents into sequences."""
    bounded_batches(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = workdir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table_at(docs, f"{where}/{k}")
    return docs
