"""Scope columns for the driver's documents: the same expressions in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("pending", "sanitized", "blocked", "never")

SCOPE_SQL = """
    select doc_id as document_id, text, source, lang, n_chars, doc_id % 4 as tenant_id, doc_id % 16 as matter_id,
        concat('T', 1 + (doc_id // 16) % 4) as data_level,
        case (doc_id // 64) % 4 when 0 then 'pending' when 1 then 'sanitized' when 2 then 'blocked' else 'never' end as sanitization_state,
        concat('doc_', (doc_id // 16) % 8) as name, 1 + doc_id // 128 as version
    from documents
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    step = lambda n: F.expr(f"doc_id div {n}")
    state = F.element_at(F.array(*map(F.lit, STATES)), (step(64) % 4 + 1).cast("int"))
    return docs.select(
        F.col("doc_id").alias("document_id"), "text", "source", "lang", "n_chars", (F.col("doc_id") % 4).alias("tenant_id"), (F.col("doc_id") % 16).alias("matter_id"),
        F.concat(F.lit("T"), (1 + step(16) % 4).cast("string")).alias("data_level"), state.alias("sanitization_state"),
        F.concat(F.lit("doc_"), (step(16) % 8).cast("string")).alias("name"), (1 + step(128)).alias("version"),
    )
