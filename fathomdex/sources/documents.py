"""Maps source tables onto the engine's documents (id, title, body)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def title_of(text: Column) -> Column:
    """The first sentence or line, at most 80 characters."""
    return F.substring(F.regexp_extract(text, r"^[^.\n]*", 0), 1, 80)


def documents(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """The documents table as id, title and body; where is a filter on the table's own columns,
    so that it reaches the scan."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if where is not None:
        table = table.filter(where)
    text = F.coalesce(F.col("text"), F.lit(""))
    return table.select(F.col("doc_id").cast("string").alias("id"), title_of(text).alias("title"), text.alias("body"))
