"""From raw documents to packed sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; its
result is written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dwellspark.llm.decontaminate import decontaminate
from dwellspark.llm.lines import without_boilerplate
from dwellspark.llm.packing import pack_documents
from dwellspark.llm.shared import write_shared
from dwellspark.llm.simhash import drop_near_duplicates
from dwellspark.llm.toxicity import drop_toxic
from dwellspark.session import ship_package


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return drop_toxic(docs, labels)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many documents of their source hold; n_chars follows the text."""
    ship_package(spark)
    return without_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    ship_package(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in benchmark windows."""
    ship_package(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate(docs, items)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces with their places in sequences of at most 2048 tokens."""
    ship_package(spark)
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: The stages can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = write_shared(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
