"""A corpus pipeline of the operators in factloom.llm: documents in, packed token sequences out.

Stages: documents that the quality classifier rejects go; one document of each near-duplicate group
stays; documents that hold a benchmark item go; secrets are masked in the text; what is left is packed.
All stages but the last return the columns of ``documents``. No SQL is given for the whole: tests
compare it with a brute-force version on a small table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontamination, near_dups, packing, quality, secrets
from factloom.llm.workspace import write_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold."""
    settings = quality.Settings()
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), settings)
    return quality.score(docs, model, settings, "__score").filter(F.col("__score") >= settings.threshold).drop("__score")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the row of the smallest doc_id; see ``one_of_each``."""
    return near_dups.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    found = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("item_ids") == 0).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mark; n_chars follows the text."""
    masked = secrets.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of all documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1, fold=True)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", without_copies),
    ("benchmark decontamination", without_benchmark),
    ("secret scan", without_secrets),
    ("best-fit packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; between two of them the documents are written as Parquet and read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs, _ = write_table(docs, f"stage{number}")
    return docs
