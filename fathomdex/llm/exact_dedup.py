"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Copies are counted in three stages: inside each task (the partial aggregate), then in
salted groups of a digest, then over a digest's salts. A text whose digest no other row has
can't equal another text, so only rows of shared digests go on; for those the same three
stages run with the whole text in the grouping key, and the winners of these groups decide.
Should two texts ever share a digest, that digest's rows are told apart by the text.

Defined results: a null text counts as empty; empty texts are copies of each other. Null
ids lose against any other; of rows alike in text and id exactly one is kept. An empty
table gives no rows. Other columns pass through, whatever their names; the added names
replace columns that are called the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomdex.llm.common import lookup, materialize, named_again, numbered_columns, text_of

SALTS = 16
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256. Of equal texts the largest id is kept."""
    given = docs.drop(*ADDED)
    docs = numbered_columns(given)
    id_col, text_col = (f"c{given.columns.index(c)}" for c in (id_col, text_col))
    whole = text_of(text_col)
    digest = F.sha2(whole, 256)
    rows = docs.select(F.col(id_col).alias("id"), digest.alias("text_sha256"))
    # Without texts: in tasks, then by digest and id (the id salts a large group), then by digest.
    salted = rows.groupBy("text_sha256", "id").agg(F.count(F.lit(1)).alias("n"))
    counts = salted.groupBy("text_sha256").agg(F.sum("n").alias("n"), F.max("id").alias("keep"), F.max("n").alias("alike"))
    counts = materialize(counts, "digests")
    total = counts.agg(F.sum("n")).first()[0] or 0
    shared = counts.filter("n > 1")
    # Whole texts of shared digests, compared at each stage.
    texts = docs.select(F.col(id_col).alias("id"), whole.alias("whole"), digest.alias("text_sha256"))
    texts = lookup(texts, shared.select("text_sha256", F.col("n").alias("weight")), "text_sha256", "weight", total)
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    local = texts.groupBy("text_sha256", "whole", salt.alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
    winners = local.groupBy("text_sha256", "whole").agg(F.sum("n").alias("n"), F.max("keep").alias("keep"))
    by_digest = winners.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"), F.max("keep").alias("keep"))
    by_digest = materialize(by_digest, "winners")
    alone = counts.filter("n = 1").select("text_sha256", F.lit(1).cast("long").alias("texts"), "n", "keep", "alike")
    table = by_digest.join(shared.select("text_sha256", "alike"), "text_sha256").select(*alone.columns).unionByName(alone)
    table = table.select("text_sha256", F.col("n").alias("group_size"), F.col("keep").alias("keep_id"), "alike", "texts")
    out = lookup(docs.withColumn("text_sha256", digest), table, "text_sha256", "group_size", total)
    plain = out.filter("texts = 1")
    if by_digest.filter("texts > 1").head(1):  # two texts under one digest: told apart by the text
        split = winners.join(by_digest.filter("texts > 1").select("text_sha256"), "text_sha256")
        split = split.select("text_sha256", "whole", F.col("n").alias("group_size"), F.col("keep").alias("keep_id"))
        odd = out.filter("texts > 1").drop("group_size", "keep_id").withColumn("whole", whole)
        plain = plain.unionByName(odd.join(split, ["text_sha256", "whole"]).drop("whole"))
    stays = F.col(id_col).eqNullSafe(F.col("keep_id"))
    once = plain.filter("alike = 1").withColumn("kept", stays)
    again = Window.partitionBy("text_sha256", id_col).orderBy(F.lit(0))
    repeated = plain.filter("alike > 1").withColumn("kept", stays & (F.row_number().over(again) == 1))
    return once.unionByName(repeated).select(*named_again(given), *ADDED)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows, with the columns of docs."""
    return exact_groups(docs, id_col, text_col).filter("kept").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
