"""From raw documents to token files, in stages.

Every stage is a function of (session, documents, folder of the tables); what it
returns is written as Parquet to the shared folder and read again as the next
one's documents.  All but the last return the columns of documents:

1. quality rules: rejected documents go;
2. SimHash near-duplicates: the row of least id of each class stays;
3. benchmark decontamination: rows that leak an item go;
4. mixing: all documents, stored in the order in which sources take turns by their target weights;
5. token files: the documents' token ids, written in that order and read back.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseries.llm.decontaminate import drop_leaking
from sparkseries.llm.mixing import mixed
from sparkseries.llm.quality import keep_good
from sparkseries.llm.queries import TARGET_WEIGHTS
from sparkseries.llm.simhash import keep_one_of_each
from sparkseries.llm.token_files import token_round_trip
from sparkseries.plans.scratch import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs, weights=TARGET_WEIGHTS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the stored order: files by name, rows by place (by id if ``docs`` is no stored table)."""
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:
        return token_round_trip(docs)
    return token_round_trip(placed, order=[F.col("_file"), F.col("_place")])


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("token files", token_files),
]
#: MinHash search, SimHash components, the schedule and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
