"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir), works on all rows its predecessor kept, and gives rows to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import decontam, ngramjoin, packing, quality, secretscan
from tessel.llm.common import cut, new_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_rules(docs).where("__q_kept").select(*docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own in __row, as ids may be null or repeated; written, so that all plans see the same numbers."""
    return cut(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, null last, and of rows that share it one."""
    rows = numbered(docs)
    classes = ngramjoin.join_classes(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id")
    members = cut(classes.where("component_id IS NOT NULL").join(rows.select("__row", "doc_id"), "__row"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "__row")).alias("f")).select("f.__row")
    gone = members.select("__row").join(first, "__row", "left_anti")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    rows = numbered(docs).withColumnsRenamed({"doc_id": "__id", "__row": "doc_id"})
    out = decontam.decontaminate(rows, table(spark, sf_dir, "benchmark"))
    return out.drop("doc_id").withColumnRenamed("__id", "doc_id").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    return secretscan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Records of packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]
#: The estimates of the first stage and the components of the second are iterative; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = new_folder(spark, f"stage{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
