"""A corpus pipeline of five stages over ``documents``.

Each stage works on what the one before it kept, written as Parquet and read
again. All but the last return the columns of documents, and further ones that
the table has. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpage.llm import decontamination, jaccard, packing, secrets, toxicity
from lumenpage.llm.common import shared_dir, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts have the score of the bias, and stay. Repeated rows
    share a score, so all of them go or stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, lambda doc_id: ~toxicity.held_out(doc_id))
    return toxicity.clean(docs, model)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays.

    It is that of the smallest doc_id; of equal rows one stays. Rows without a
    doc_id stay, and of rows without words one for each doc_id.
    """
    return jaccard.one_of_each(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; null and empty texts, and all texts if the benchmark is empty, stay."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars counts what is then there; no row goes, and null texts stay null."""
    folder = shared_dir(spark)
    versions = docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    table = stored(secrets.addressed(versions), folder, "versions", small=True)
    return secrets.redacted(docs, secrets.brought_up_to_date(table, folder))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 1024 tokens; a null or empty text is a piece of the end id alone."""
    split = stored(packing.pieces(docs), shared_dir(spark), "pieces", small=True)
    return packing.pack(split).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express these stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole table."""
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return docs
