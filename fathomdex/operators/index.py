"""Builds the positional inverted index as DataFrames."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomdex.functions import batch
from fathomdex.functions.analysis import analyze, count_words
from fathomdex.operators.search import ready, with_tokens
from fathomdex.plans.compiler import MAX_COUNT
from fathomdex.plans.query_lang import FIELDS

POSTINGS = "seg int, field string, term string, doc long, tf int, positions array<int>"


def number_documents(docs: DataFrame, seg: int) -> DataFrame:
    """docs (id, title, body) with seg and doc, the document's number in the segment.

    Numbers are unique and follow the input's partitions; they need not be dense. Write the
    result and read it again before building from it twice: numbers can differ between runs.
    """
    return docs.select(F.lit(seg).alias("seg"), F.monotonically_increasing_id().alias("doc"), "id", "title", "body")


def stored_documents(numbered: DataFrame, analyzer=analyze) -> DataFrame:
    """numbered with the lengths of both fields in tokens."""
    if analyzer is analyze:
        ready(numbered)
        return numbered.withColumns({f"{f}_len": count_words(F.col(f)) for f in FIELDS})
    return with_tokens(numbered, analyzer).drop("title_tokens", "body_tokens")


def build_postings(numbered: DataFrame, analyzer=analyze) -> DataFrame:
    """One row (seg, field, term, doc, tf, positions) for each term of each field.

    Counts stop at 65535 and positions beyond it are not kept. Numbers are taken as unique:
    a document's tokens are all in one row, so there is no shuffle.
    """
    texts = numbered.select(F.col("seg").cast("int"), F.col("doc").cast("long"), *FIELDS)
    if analyzer is analyze:
        ready(numbered)
        return texts.mapInArrow(partial(batch.postings, fields=FIELDS, most=MAX_COUNT), POSTINGS)
    tokens = with_tokens(texts.repartition("seg", "doc"), analyzer)
    per_field = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_tokens").alias("tokens")) for f in FIELDS)))
    rows = tokens.select("seg", "doc", per_field.alias("x")).select("seg", "doc", "x.field", F.posexplode("x.tokens").alias("pos", "term"))
    return (
        rows.groupBy("seg", "field", "term", "doc")
        .agg(
            F.least(F.count(F.lit(1)), F.lit(MAX_COUNT)).cast("int").alias("tf"),
            F.sort_array(F.collect_list(F.when(F.col("pos") <= MAX_COUNT, F.col("pos")))).alias("positions"),
        )
        .select("seg", "field", "term", "doc", "tf", "positions")
    )


def ranged_postings(numbered: DataFrame, field: str) -> DataFrame:
    """One field's rows (term, doc, tf, positions), ranged and sorted by term and, for about
    4 MB of text at a time, by document. These many postings of a term are one row until they
    are sorted."""
    ready(numbered)
    kind = "term string, first long, found array<struct<doc: long, tf: int, positions: array<int>>>"
    groups = numbered.select(F.col("doc").cast("long"), field).mapInArrow(partial(batch.grouped_postings, field=field, most=MAX_COUNT), kind)
    order = ["term", "first"]
    return groups.repartitionByRange(*order).sortWithinPartitions(*order).select("term", F.inline("found"))


def merged_numbers(postings: DataFrame, documents: DataFrame) -> DataFrame:
    """postings with the rows of documents of one number as those of one document; documents
    has a row with seg and doc for each. Where numbers are unique nothing is moved."""
    if not documents.groupBy("seg", "doc").count().filter("count > 1").head(1):
        return postings
    return (
        postings.groupBy("seg", "field", "term", "doc")
        .agg(F.least(F.sum("tf"), F.lit(MAX_COUNT)).cast("int").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
        .select("seg", "field", "term", "doc", "tf", "positions")
    )


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: documents, avg_title, avg_body; averages of no documents are 1."""
    return docs.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.avg("title_len"), F.lit(1.0)).alias("avg_title"),
        F.coalesce(F.avg("body_len"), F.lit(1.0)).alias("avg_body"),
    )
