"""The engine's registered queries over the documents table, with SQL of the same meaning."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomdex.functions.analysis import SIBILANT_ES, STOPWORDS
from fathomdex.functions.text import snippet_column
from fathomdex.operators.index import build_postings, corpus_stats, document_frequency, merged_numbers, stored_documents
from fathomdex.operators.search import index_scores, ranked, scan_hits, with_tokens
from fathomdex.operators.store import Engine
from fathomdex.plans.compiler import FIELD_BOOST, K1, MAX_COUNT, PHRASE_BOOST, B
from fathomdex.plans.query_lang import FIELDS, And, Not, Phrase, Term, fields_of, parse
from fathomdex.session import bound_batches, shared_folder
from fathomdex.sources.documents import documents
from fathomdex.sources.segment_text import SegmentTextSource

SEARCHES = {
    "search_term": "anea",
    "search_title_field": "title:anea",
    "search_body_field": "body:anea",
    "search_and": "anea er",
    "search_or": "anea OR eriner",
    "search_not": "anea -er",
    "search_phrase": '"attion thanedble"',
    "search_phrase_reversed": '"thanedble attion"',
    "search_phrase3": '"anea eriner thanea"',
    "search_title_phrase": 'title:"attion thanedble"',
    "search_single_word_phrase": '"anea"',
    "search_nested": "(anea OR re) AND ther",
    "search_repeated": "anea anea",
    "search_or_negated": "anea OR -er",
    "search_negated_group": "anea -(er OR -re)",
    "search_only_negated": "-anea",
}
TOP, TOP_K = "anea OR eriner", 10


def _hits(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"))


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(F.lit(1).alias("seg"), F.col("id").cast("long").alias("doc"), "id", "title", "body")


_stores: dict[tuple[str, str, str], Engine] = {}


def _store(spark: SparkSession, sf: str, kind: str) -> Engine:
    """A store that holds the documents table, built once for an application and table; as
    an index is there to be, every later query reads what is built."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _stores:
        engine = Engine(spark, f"{shared_folder(spark)}/store-{kind}-{uuid.uuid4().hex}")
        _BUILD[kind](engine, spark, sf)
        _stores[key] = engine
    return _stores[key]


def _built(engine: Engine, spark: SparkSession, sf: str) -> None:
    engine.put_all(documents(spark, sf))


def _flushed(engine: Engine, spark: SparkSession, sf: str) -> None:
    """Four segments of different ways in, and a buffer that isn't flushed."""
    part = F.pmod(F.col("doc_id"), F.lit(3))
    for k in range(3):
        engine.put_all(documents(spark, sf, (part == k) & (F.col("doc_id") >= 14)))
    for row in documents(spark, sf, F.col("doc_id") < 14).orderBy(F.col("id").cast("long")).collect():  # the eighth put seals
        engine.put(*row)


def _merged(engine: Engine, spark: SparkSession, sf: str) -> None:
    """Segments of an eighth, an eighth, a quarter and a half, with a merge after each but the first."""
    part = F.pmod(F.col("doc_id"), F.lit(8))
    for k, here in enumerate((part == 0, part == 1, (part == 2) | (part == 3), part > 3)):
        engine.put_all(documents(spark, sf, here))
        if k and engine.merge().outcome != "merged":
            raise RuntimeError("segments of like size weren't merged")


def _deleted(engine: Engine, spark: SparkSession, sf: str) -> None:
    engine.put_all(documents(spark, sf))
    engine.remove_all(documents(spark, sf, (F.pmod(F.col("doc_id"), F.lit(7)) == 0) & (F.col("doc_id") != 0)))
    engine.remove("0")


_BUILD = {"built": _built, "flushed": _flushed, "merged": _merged, "deleted": _deleted}


def _store_search(query: str, kind: str) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        engine = _store(spark, sf, kind)
        return _hits(index_scores(engine.documents(), engine.postings(), query))

    return run


def _store_build(spark: SparkSession, sf: str) -> DataFrame:
    """A store built anew: how many postings and terms each field has."""
    engine = Engine(spark, f"{shared_folder(spark)}/store-new-{uuid.uuid4().hex}")
    _built(engine, spark, sf)
    return engine.postings().groupBy("field").agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("term").alias("terms"))


def _store_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Postings after three merges, by the id of their document."""
    engine = _store(spark, sf, "merged")
    ids = engine.documents().select("seg", "doc", F.col("id").cast("long").alias("doc_id"))
    return engine.postings().join(ids, ["seg", "doc"]).select("doc_id", "field", "term", "tf", _spelled("positions"))


def _store_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = _store(spark, sf, "deleted").stats()
    names = ("sealed_segments", "active_docs", "live_docs", "dead_docs", "posting_lists")
    return spark.createDataFrame([tuple(getattr(s, n) for n in names)], ", ".join(f"{n} long" for n in names))


def _store_top(spark: SparkSession, sf: str) -> DataFrame:
    hits = _store(spark, sf, "built").search(TOP, TOP_K).hits
    return hits.select("id", "title", F.length("body").cast("long").alias("body_chars"), F.round("score", 6).alias("score"))


def _store_get(spark: SparkSession, sf: str) -> DataFrame:
    engine = _store(spark, sf, "deleted")
    return spark.createDataFrame([r for i in ("11", "14") if (r := engine.get(i))], "id string, title string, body string")


_texts: dict[tuple[str, str], str] = {}


def _segment_text(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """The documents table in the text format, written once, and read as one of its tables."""
    spark.dataSource.register(SegmentTextSource)
    bound_batches(spark)
    key = (spark.sparkContext.applicationId, sf)
    if key not in _texts:
        path = f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}"
        documents(spark, sf).write.format("segment_text").mode("append").save(path)
        _texts[key] = path
    return spark.read.format("segment_text").option("table", table).option("ids", "true").load(_texts[key])


def _segment_postings(spark: SparkSession, sf: str) -> DataFrame:
    return _segment_text(spark, sf, "postings").select(F.col("id").cast("long").alias("doc_id"), "field", "term", "tf", _spelled("positions"))


def _reopened(spark: SparkSession, sf: str) -> DataFrame:
    """A store opened anew: the manifest's segments, and the buffer from the log."""
    engine = Engine(spark, _store(spark, sf, "flushed").path)
    return _hits(index_scores(engine.documents(), engine.postings(), SEARCHES["search_or"]))


def _spelled(positions: str):
    return F.array_join(F.col(positions).cast("array<string>"), ",").alias("positions")


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    docs = _numbered(spark, sf)
    return merged_numbers(build_postings(docs), docs.select("seg", "doc"))


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    p = _postings(spark, sf)
    return p.select(F.col("doc").alias("doc_id"), "field", "term", "tf", _spelled("positions"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: (lambda q: lambda spark, sf: _hits(scan_hits(documents(spark, sf), q)))(q) for name, q in SEARCHES.items()}
    out["index_build"] = _store_build
    for name in ("search_and", "search_or", "search_phrase", "search_nested"):
        out[f"index_{name}"] = _store_search(SEARCHES[name], "built")
    out["index_search_top"] = _store_top
    out["flush_invariance"] = _store_search(SEARCHES["search_or"], "flushed")
    out["merge_invariance"] = _store_search(SEARCHES["search_or"], "merged")
    out["merged_postings"] = _store_postings
    out["delete_then_search"] = _store_search(SEARCHES["search_or"], "deleted")
    out["store_stats"] = _store_stats
    out["store_list"] = lambda spark, sf: _store(spark, sf, "deleted").list()
    out["store_get"] = _store_get
    out["reopen_then_search"] = _reopened
    out["segment_text_documents"] = lambda spark, sf: _segment_text(spark, sf, "documents").select("id", "title", "title_len", "body_len")
    out["segment_text_postings"] = _segment_postings
    out["search_topk"] = lambda spark, sf: ranked(_hits(scan_hits(documents(spark, sf), TOP)), TOP_K)
    out["search_total"] = lambda spark, sf: scan_hits(documents(spark, sf), TOP).agg(F.count(F.lit(1)).alias("total"))
    out["analyze_tokens"] = lambda spark, sf: with_tokens(documents(spark, sf)).select("id", *(F.array_join(f"{f}_tokens", " ").alias(f"{f}_tokens") for f in FIELDS))
    out["doc_lengths"] = lambda spark, sf: stored_documents(_numbered(spark, sf)).select("id", *(F.col(f"{f}_len").cast("long").alias(f"{f}_len") for f in FIELDS))
    out["postings"] = lambda spark, sf: _flat(spark, sf)
    out["term_frequency"] = lambda spark, sf: _postings(spark, sf).groupBy("field", "term").agg(F.sum("tf").cast("long").alias("total_tf"))
    out["document_frequency"] = lambda spark, sf: document_frequency(_postings(spark, sf))
    out["corpus_stats"] = lambda spark, sf: corpus_stats(stored_documents(_numbered(spark, sf))).select("documents", *(F.round(c, 6).alias(c) for c in ("avg_title", "avg_body")))
    out["index_stats"] = lambda spark, sf: _postings(spark, sf).groupBy("field").agg(F.countDistinct("term").alias("terms"), F.countDistinct("doc").alias("docs"))
    out["get_by_id"] = lambda spark, sf: documents(spark, sf, F.col("doc_id") == 11)
    out["list_docs"] = lambda spark, sf: documents(spark, sf).select("id", "title")
    out["snippet"] = lambda spark, sf: documents(spark, sf).select("id", snippet_column(F.col("body")).alias("snippet"))
    return out


# SQL of the same meaning

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_ES = " OR ".join(f"ends_with(w, '{e}')" for e in SIBILANT_ES)
_STEM = (
    "CASE WHEN length(w) > 5 AND ends_with(w, 'ing') THEN substring(w, 1, length(w) - 3) "
    "WHEN length(w) > 4 AND ends_with(w, 'ed') THEN substring(w, 1, length(w) - 2) "
    f"WHEN length(w) > 4 AND ({_ES}) THEN substring(w, 1, length(w) - 2) "
    "WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN substring(w, 1, length(w) - 1) ELSE w END"
)


def _tokens(field: str) -> str:
    split = f"list_transform(string_split_regex({field}, '[^A-Za-z0-9]+'), lambda x: lower(x))"
    return f"list_transform(list_filter({split}, lambda x: x <> '' AND x NOT IN ({_STOP})), lambda w: {_STEM})"


def _base(where: str = "") -> str:
    return (
        "d AS (SELECT CAST(doc_id AS VARCHAR) AS id, substr(regexp_extract(coalesce(text, ''), '^[^.\\n]*', 0), 1, 80) AS title, "
        f"coalesce(text, '') AS body FROM documents {where}), "
        f"t AS (SELECT id, title, body, {_tokens('title')} AS title_tokens, {_tokens('body')} AS body_tokens FROM d)"
    )


def _bm25_sql(f: str, term: str) -> str:
    tf = f"least(len(list_filter({f}_tokens, lambda x: x = '{term}')), {MAX_COUNT})"
    df = f"(SELECT count(*) FROM t WHERE list_contains({f}_tokens, '{term}'))"
    n = "(SELECT count(*) FROM t)"
    average = f"(SELECT avg(len({f}_tokens)) FROM t)"
    return f"(CASE WHEN {tf} > 0 THEN ln(1.0::DOUBLE + ({n} - {df} + 0.5) / ({df} + 0.5)) * {tf} * {K1 + 1.0}::DOUBLE / ({tf} + {K1}::DOUBLE * ({1.0 - B}::DOUBLE + {B}::DOUBLE * len({f}_tokens) / {average})) ELSE 0.0::DOUBLE END)"


def _node_sql(node) -> tuple[str, str, bool]:
    if isinstance(node, Term | Phrase):
        matches, scores = [], []
        for f in fields_of(node):
            terms = node.terms if isinstance(node, Phrase) else (node.term,)
            m = f"contains(' ' || array_to_string({f}_tokens[1:{MAX_COUNT + 1}], ' ') || ' ', ' {' '.join(terms)} ')"
            boost = FIELD_BOOST[f] * (PHRASE_BOOST if isinstance(node, Phrase) else 1.0)
            matches.append(m)
            scores.append(f"(CASE WHEN {m} THEN {boost}::DOUBLE * ({' + '.join(_bm25_sql(f, x) for x in terms)}) ELSE 0.0::DOUBLE END)")
        return f"({' OR '.join(matches)})", f"({' + '.join(scores)})", False
    if isinstance(node, Not):
        m, s, negated = _node_sql(node.child)
        return m, s, not negated
    children = [_node_sql(c) for c in node.children]
    positive = [c for c in children if not c[2]]
    if not positive:
        return "false", "0.0::DOUBLE", False
    if isinstance(node, And):
        return "(" + " AND ".join(f"NOT {m}" if n else m for m, _, n in children) + ")", "(" + " + ".join(s for _, s, _ in positive) + ")", False
    return "(" + " OR ".join(m for m, _, _ in positive) + ")", "(" + " + ".join(f"(CASE WHEN {m} THEN {s} ELSE 0.0::DOUBLE END)" for m, s, _ in positive) + ")", False


def search_sql(query: str, where: str = "", shown: bool = False) -> str:
    m, s, negated = _node_sql(parse(query))
    return f"WITH {_base(where)} SELECT id, {'title, body, ' if shown else ''}round({s}, 6) AS score FROM t WHERE {'false' if negated else m}"


def oracle_sql() -> dict[str, str]:
    out = {name: search_sql(q) for name, q in SEARCHES.items()}
    for name in ("search_and", "search_or", "search_phrase", "search_nested"):
        out[f"index_{name}"] = out[name]
    out["flush_invariance"] = out["merge_invariance"] = out["reopen_then_search"] = search_sql(SEARCHES["search_or"])
    out["search_topk"] = f"SELECT * FROM ({search_sql(TOP)}) ORDER BY score DESC, id LIMIT {TOP_K}"
    out["search_total"] = f"SELECT count(*) AS total FROM ({search_sql(TOP)})"
    out["delete_then_search"] = search_sql(SEARCHES["search_or"], "WHERE doc_id % 7 <> 0")
    out["analyze_tokens"] = f"WITH {_base()} SELECT id, array_to_string(title_tokens, ' ') AS title_tokens, array_to_string(body_tokens, ' ') AS body_tokens FROM t"
    out["doc_lengths"] = f"WITH {_base()} SELECT id, len(title_tokens) AS title_len, len(body_tokens) AS body_len FROM t"
    rows = (
        f"{_base()}, x AS (SELECT id, 'title' AS field, unnest(title_tokens) AS term, generate_subscripts(title_tokens, 1) - 1 AS pos FROM t "
        "UNION ALL SELECT id, 'body' AS field, unnest(body_tokens) AS term, generate_subscripts(body_tokens, 1) - 1 AS pos FROM t), "
        f"p AS (SELECT CAST(id AS BIGINT) AS doc_id, field, term, least(count(*), {MAX_COUNT})::INTEGER AS tf, "
        f"coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE pos <= {MAX_COUNT}), '') AS positions FROM x GROUP BY id, field, term)"
    )
    out["segment_text_documents"] = f"WITH {_base()} SELECT id, title, len(title_tokens) AS title_len, len(body_tokens) AS body_len FROM t"
    out["postings"] = out["merged_postings"] = out["segment_text_postings"] = f"WITH {rows} SELECT * FROM p"
    out["index_build"] = f"WITH {rows} SELECT field, count(*) AS postings, count(DISTINCT term) AS terms FROM p GROUP BY field"
    out["index_search_top"] = f"SELECT t.id, t.title, length(t.body) AS body_chars, t.score FROM ({search_sql(TOP, shown=True)}) t ORDER BY score DESC, id LIMIT {TOP_K}"
    live = "WHERE doc_id % 7 <> 0"
    out["store_stats"] = (
        f"WITH {rows} SELECT 1::BIGINT AS sealed_segments, 0::BIGINT AS active_docs, (SELECT count(*) FROM documents {live}) AS live_docs, "
        "(SELECT count(*) FROM documents WHERE doc_id % 7 = 0) AS dead_docs, (SELECT count(*) FROM (SELECT DISTINCT field, term FROM p)) AS posting_lists"
    )
    out["store_list"] = f"WITH {_base(live)} SELECT id, title FROM t"
    out["store_get"] = f"WITH {_base(live)} SELECT id, title, body FROM t WHERE id IN ('11', '14')"
    out["term_frequency"] = f"WITH {rows} SELECT field, term, CAST(sum(tf) AS BIGINT) AS total_tf FROM p GROUP BY field, term"
    out["document_frequency"] = f"WITH {rows} SELECT field, term, count(*) AS df FROM p GROUP BY field, term"
    out["corpus_stats"] = f"WITH {_base()} SELECT count(*) AS documents, round(avg(len(title_tokens)), 6) AS avg_title, round(avg(len(body_tokens)), 6) AS avg_body FROM t"
    out["index_stats"] = f"WITH {rows} SELECT field, count(DISTINCT term) AS terms, count(DISTINCT doc_id) AS docs FROM p GROUP BY field"
    out["get_by_id"] = f"WITH {_base()} SELECT id, title, body FROM t WHERE id = '11'"
    out["list_docs"] = f"WITH {_base()} SELECT id, title FROM t"
    out["snippet"] = f"WITH {_base()}, s AS (SELECT id, translate(body, chr(10) || chr(9), '  ') AS flat FROM t) SELECT id, CASE WHEN length(flat) >= 72 THEN substr(flat, 1, 72) || '...' ELSE flat END AS snippet FROM s"
    return out
