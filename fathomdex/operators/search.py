"""Search: a scan over raw documents, or a lookup in a built index. Both rank alike.

Scan mode reads the documents twice: one aggregate for the corpus figures (a single row to
the driver), and one pass for match and score. Both get a row of a few numbers for each
document from the batch analyzer: lengths, counts of the query's terms, and whether it has
the query's phrases. There is no shuffle but the aggregate. Index mode reads only the postings
of the query's terms and shuffles those once, whatever the depth of the query; titles and
bodies are read for the hits that are shown only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from fathomdex.functions import batch
from fathomdex.functions.analysis import analyze
from fathomdex.plans.compiler import MAX_COUNT, FieldColumns, Similarity, compile_query
from fathomdex.plans.query_lang import FIELDS, Phrase, fields_of, leaves, parse, query_terms
from fathomdex.session import bound_batches, ship

DEFAULT_LIMIT = 10
HIT = ("id", "title", "body", "score")


def ready(docs: DataFrame) -> None:
    """What the batch analyzer needs: the package on executors, and batches of few bytes."""
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)


def with_tokens(docs: DataFrame, analyzer=analyze) -> DataFrame:
    """docs (id, title, body) with the analysed tokens and lengths of both fields.

    A generator of one row makes the tokens of an analyzer of expressions, so filters and
    projections above use them as columns; else they would be repeated wherever a later
    filter is pushed.
    """
    if analyzer is analyze:
        ready(docs)
        out = docs.withColumns({f"{f}_tokens": analyze(F.col(f)) for f in FIELDS})
    else:
        out = docs.select("*", F.inline(F.array(F.struct(*(analyzer(F.col(f)).alias(f"{f}_tokens") for f in FIELDS)))))
    return out.withColumns({f"{f}_len": F.size(f"{f}_tokens") for f in FIELDS})


def _count(fld: str, term: str) -> Column:
    return F.least(F.size(F.filter(F.col(f"{fld}_tokens"), lambda t: t == F.lit(term))), F.lit(MAX_COUNT))


def _adjacent(fld: str, terms: tuple[str, ...]) -> Column:
    """Tokens hold letters and digits only, so adjacency is a substring of the joined list."""
    joined = F.array_join(F.slice(F.col(f"{fld}_tokens"), 1, MAX_COUNT + 1), " ")
    return F.contains(F.concat(F.lit(" "), joined, F.lit(" ")), F.lit(f" {' '.join(terms)} "))


def _figures(row: dict, terms: list[tuple[str, str]]) -> Similarity:
    n = row["n"] or 0
    return Similarity(
        n,
        {f: (row.get(f"{f}_total") or 0) / n if n else 1.0 for f in FIELDS},
        {key: row[f"df{i}"] or 0 for i, key in enumerate(terms)},
    )


def _figured(docs: DataFrame, used: list[str], terms: list[tuple[str, str]], phrases: list[tuple[str, tuple[str, ...]]]) -> tuple[DataFrame, FieldColumns]:
    """docs with a row of numbers in each, and how to find them."""
    ready(docs)
    kind = StructType()
    for f in used:
        kind.add(f"{f}_len", IntegerType())
    for k in range(len(terms)):
        kind.add(f"tf{k}", IntegerType())
    for k in range(len(phrases)):
        kind.add(f"adj{k}", BooleanType())

    def figures(*texts: pa.Array) -> pa.Array:
        return batch.figures(dict(zip(used, texts, strict=True)), terms, phrases, MAX_COUNT)

    # Taken as one of changing results it is made once, and not again in a filter.
    found = F.arrow_udf(figures, kind).asNondeterministic()(*(F.col(f) for f in used))
    x = F.col("_found")
    return docs.withColumn("_found", found), FieldColumns(lambda f, t: x[f"tf{terms.index((f, t))}"], lambda f: x[f"{f}_len"], lambda f, p: x[f"adj{phrases.index((f, p))}"])


def scan_hits(docs: DataFrame, query: str, analyzer=analyze) -> DataFrame:
    """All hits of a query over docs (id, title, body), unordered: id, title, body, score."""
    node = parse(query)
    terms = query_terms(node)
    used = [f for f in FIELDS if any(f == g for g, _ in terms)]
    if analyzer is analyze:
        phrases = [(f, leaf.terms) for leaf in leaves(node) if isinstance(leaf, Phrase) and len(leaf.terms) > 1 for f in fields_of(leaf)]
        tokens, cols = _figured(docs, used, terms, phrases)
    else:
        tokens, cols = with_tokens(docs, analyzer), FieldColumns(_count, lambda f: F.col(f"{f}_len"), _adjacent)
    figures = tokens.select(*(cols.length(f).alias(f"{f}_len") for f in used), *((cols.tf(f, t) > 0).alias(f"has{i}") for i, (f, t) in enumerate(terms))).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(f"{f}_len").alias(f"{f}_total") for f in used),
        *(F.count_if(F.col(f"has{i}")).alias(f"df{i}") for i in range(len(terms))),
    )
    sim = _figures(figures.first().asDict(), terms)
    match, score = compile_query(node, cols, sim)
    return tokens.filter(match).select("id", "title", "body", score.alias("score"))


def ranked(hits: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Best first, ties by id bytewise, cut to limit."""
    return hits.orderBy(F.desc("score"), F.asc("id")).limit(limit)


def search(docs: DataFrame, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return ranked(scan_hits(docs, query), limit)


def index_hits(docs: DataFrame, postings: DataFrame, query: str) -> DataFrame:
    """All hits of a query over an index: id, title, body, score.

    docs: live documents (seg, doc, id, title, body, title_len, body_len). postings: live
    rows (seg, field, term, doc, tf, positions). Only the query's terms are read.
    """
    scores = index_scores(docs, postings, query).select("seg", "doc", "score")
    return scores.join(docs, ["seg", "doc"]).select("id", "title", "body", "score")


def index_scores(docs: DataFrame, postings: DataFrame, query: str) -> DataFrame:
    """seg, doc, id and score of all hits; of docs, titles and bodies aren't read."""
    node = parse(query)
    terms = query_terms(node)
    wanted = F.lit(False)
    for f in FIELDS:
        if mine := [t for g, t in terms if g == f]:
            wanted = wanted | ((F.col("field") == f) & F.col("term").isin(*mine))
    found = postings.filter(wanted)
    keys = {key: i for i, key in enumerate(terms)}
    totals = docs.agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"{f}_len").alias(f"{f}_total") for f in FIELDS)).first()
    df = {(r["field"], r["term"]): r["n"] for r in found.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row for each query term
    sim = _figures(totals.asDict() | {f"df{i}": df.get(key, 0) for key, i in keys.items()}, terms)

    def here(key: tuple[str, str]) -> Column:
        return (F.col("field") == key[0]) & (F.col("term") == key[1])

    phrased = {(f, t) for leaf in leaves(node) if isinstance(leaf, Phrase) for f in ((leaf.field,) if leaf.field else FIELDS) for t in leaf.terms}
    aggs = [F.max(F.when(here(key), F.col("tf"))).alias(f"tf{i}") for key, i in keys.items()]
    aggs += [F.max(F.when(here(key), F.col("positions"))).alias(f"pos{i}") for key, i in keys.items() if key in phrased]
    per_doc = found.groupBy("seg", "doc").agg(*aggs)

    def adjacent(f: str, phrase: tuple[str, ...]) -> Column:
        at = [F.col(f"pos{keys[f, t]}") for t in phrase]

        def follows(p: Column) -> Column:
            ok = F.lit(True)
            for k, positions in enumerate(at[1:], 1):
                ok = ok & F.array_contains(positions, (p + k).cast("int"))
            return ok

        return F.coalesce(F.exists(at[0], follows), F.lit(False))

    cols = FieldColumns(lambda f, t: F.coalesce(F.col(f"tf{keys[f, t]}"), F.lit(0)), lambda f: F.col(f"{f}_len"), adjacent)
    match, score = compile_query(node, cols, sim)
    scored = per_doc.join(docs.select("seg", "doc", "id", *(f"{f}_len" for f in FIELDS)), ["seg", "doc"]).filter(match)
    return scored.select("seg", "doc", "id", score.alias("score"))
