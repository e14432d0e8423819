"""Scores, boolean rules, and agreement of the two physical modes with a plain evaluator."""

import itertools
import math
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomdex.functions import batch
from fathomdex.functions.analysis import Analyzer, analyze, analyze_words, count_words, words_of_stem
from fathomdex.functions.text import snippet, snippet_column
from fathomdex.operators.index import build_postings, merged_numbers, number_documents, stored_documents
from fathomdex.operators.search import index_hits, scan_hits, search
from fathomdex.plans.query_lang import And, Not, Phrase, Term, fields_of, parse

D6 = [
    ("otter", "Small River Otter", "A small river otter dives under the cold bridge near the mill."),
    ("heron", "Cold Heron", "The cold heron waits by the mill after chasing an otter."),
    ("town", "Town Otters", "Noisy otters swim at dawn in the town and dodge herons."),
    ("ledger", "Open Ledger", "An open ledger lists every sale with the buyer that paid it."),
    ("gears", "Mill Gears", "Old mills turn wooden gears and grind them smooth daily."),
    ("trout", "Small Trouts", "The small trout hides in the river and escapes the otter."),
]
#: Queries and the ids that they find; their scores are those of the plain evaluator.
FOUND = {
    "otter": {"town", "otter", "heron", "trout"},
    "heron": {"heron", "town"},
    "small": {"trout", "otter"},
    '"small river"': {"otter"},
    '"river small"': set(),
    '"mill gears"': {"gears"},
    "dive": {"otter"},
    "wood": set(),
    "hide": {"trout"},
    "otter -heron": {"otter", "trout"},
    "title:otter": {"town", "otter"},
    "(otter OR heron) AND trout": {"trout"},
    "NOT otter": set(),
    "otter (-heron -cat)": set(),
    "otter OR -heron": {"town", "otter", "heron", "trout"},
    "otter -(heron OR -cat)": {"otter", "trout"},
    "otter -(-heron -cat)": {"town", "otter", "heron", "trout"},
    "dive dive": {"otter"},
    '"dive"': {"otter"},
    "--dive": {"otter"},
}


def evaluate(rows, query):
    """A plain evaluator over lists."""
    docs = {r[0]: {"title": analyze_words(r[1]), "body": analyze_words(r[2])} for r in rows}
    n = len(docs)
    average = {f: sum(len(d[f]) for d in docs.values()) / n for f in ("title", "body")}

    def bm(d, f, t):
        tf, df = d[f].count(t), sum(t in x[f] for x in docs.values())
        if not tf:
            return 0.0
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d[f]) / (average[f] or 1.0)))

    def leaf(node):
        out = {}
        for i, d in docs.items():
            for f in fields_of(node):
                terms = node.terms if isinstance(node, Phrase) else (node.term,)
                if any(tuple(d[f][k : k + len(terms)]) == terms for k in range(len(d[f]))):
                    boost = (2.0 if f == "title" else 1.0) * (1.25 if isinstance(node, Phrase) else 1.0)
                    out[i] = out.get(i, 0.0) + boost * sum(bm(d, f, t) for t in terms)
        return out

    def run(node):
        if isinstance(node, Term | Phrase):
            return leaf(node), False
        if isinstance(node, Not):
            found, negated = run(node.child)
            return found, not negated
        children = [run(c) for c in node.children]
        positive = [x for x, negated in children if not negated]
        if not positive:
            return {}, False
        if isinstance(node, And):
            keys = set.intersection(*map(set, positive)) - set().union(*(x for x, negated in children if negated))
        else:
            keys = set().union(*positive)
        return {k: sum(x.get(k, 0.0) for x in positive) for k in keys}, False

    found, negated = run(parse(query))
    return {} if negated else found


def both_modes(spark, rows, query):
    docs = spark.createDataFrame(rows, "id string, title string, body string").coalesce(2)
    numbered = number_documents(docs, 1)
    scan = {r["id"]: r["score"] for r in scan_hits(docs, query).collect()}
    index = {r["id"]: r["score"] for r in index_hits(stored_documents(numbered), build_postings(numbered), query).collect()}
    return scan, index


EXPECTED = {query: evaluate(D6, query) for query in FOUND}


@pytest.mark.parametrize("query", FOUND)
def test_scores(spark, query):
    assert set(EXPECTED[query]) == FOUND[query]
    for found in both_modes(spark, D6, query):
        assert found == pytest.approx(EXPECTED[query], abs=1e-9)


def test_one_score_by_hand():
    # N 6, df 1, tf 1, length 8 (of 45 in 6 bodies): the body alone holds it
    tokens = sum(len(analyze_words(b)) for _, _, b in D6)
    n = len(analyze_words(D6[0][2]))
    assert EXPECTED["dive"]["otter"] == pytest.approx(math.log(1 + 5.5 / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n * 6 / tokens)))


def test_order_and_ties(spark):
    docs = spark.createDataFrame([(f"d{i}", f"Title {i}", "a heron again") for i in range(12)], "id string, title string, body string")
    assert [r["id"] for r in search(docs, "heron", 4).collect()] == ["d0", "d1", "d10", "d11"]
    assert search(docs, "heron", 0).count() == 0


def test_modes_agree_on_random_queries(spark):
    pick = random.Random(3)
    words = ["red", "blue", "green", "otter", "trout"]
    rows = [(str(i), " ".join(pick.choices(words, k=pick.randint(0, 3))), " ".join(pick.choices(words, k=pick.randint(0, 9)))) for i in range(30)]

    def make(depth):
        if depth == 0 or pick.random() < 0.3:
            field = pick.choice(["", "", "title:", "body:"])
            return field + (pick.choice(words) if pick.random() < 0.6 else f'"{" ".join(pick.choices(words, k=2))}"')
        kind = pick.choice(["AND", "OR", "NOT"])
        return f"NOT ({make(depth - 1)})" if kind == "NOT" else f"({make(depth - 1)} {kind} {make(depth - 1)})"

    for query in (make(3) for _ in range(8)):
        want = evaluate(rows, query)
        for found in both_modes(spark, rows, query):
            assert found == pytest.approx(want, abs=1e-9), query


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "id string, title string, body string")
    assert search(docs, "otter OR heron").count() == 0


def test_analyzer_matches_driver_side(spark):
    pick = random.Random(11)
    made = [" ".join("".join(pick.choices("aeishcxzngd", k=pick.randint(1, 7))) + pick.choice(["", "s", "es", "ed", "ing", "ches", "sses"]) for _ in range(60)) for _ in range(40)]
    texts = ["The quick foxes' jumping", "café au lait", "Kelvin string during ring used buses houses axes process thes", "", "a.b_c-d  X1Y2", None, "the " * 30_000, "a the x the", *made]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(analyze(df.t)).collect()]
    assert got == [analyze_words(t or "") for t in texts]
    assert [r[0] for r in df.select(Analyzer()(df.t)).collect()] == got
    assert [r[0] for r in df.select(count_words(df.t)).collect()] == list(map(len, got))
    assert got[2] == ["elvin", "str", "dur", "ring", "used", "bus", "hous", "axe", "process", "the"]


def test_wide_documents(spark):
    body = " ".join(itertools.chain(("x1" for _ in range(65535)), ["mark", "tail", "x1", "x1"]))
    docs = spark.createDataFrame([("long", "t9", body)], "id string, title string, body string")
    numbered = number_documents(docs, 1)
    rows = {r["term"]: r for r in build_postings(numbered).filter("field = 'body'").collect()}
    assert rows["x1"]["tf"] == 65535
    assert list(rows["mark"]["positions"]) == [65535]
    assert list(rows["tail"]["positions"]) == []
    assert stored_documents(numbered).first()["body_len"] == 65539
    for query, n in (('"x1 mark"', 1), ('"mark tail"', 0), ("tail", 1)):
        assert [len(x) for x in both_modes(spark, [("long", "t9", body)], query)] == [n, n]


def test_snippet(spark):
    for body in ("a\tb\nc", "x" * 71, "x" * 72, "x" * 90):
        df = spark.createDataFrame([(body,)], "b string")
        assert df.select(snippet_column(df.b)).first()[0] == snippet(body)
    assert snippet("x" * 72) == "x" * 72 + "..."


def test_words_of_stem():
    words = {w + e for w in ("sing", "bus", "box", "church", "red", "us", "the", "k") for e in ("", "s", "es", "ed", "ing")}
    for w in words:
        for stem in analyze_words(w):
            assert w in words_of_stem(stem)


def test_scan_analyses_only_documents_with_a_word(spark):
    docs = spark.createDataFrame([(str(i), "t", f"w{i} Searches x") for i in range(4)] + [("k", "t", "\u212aw1 w1s")], "id string, title string, body string")
    assert {r["id"] for r in search(docs, "w1").collect()} == {"1", "k"}
    assert search(docs, "search").count() == 4


def test_pieces_and_edges_of_texts(monkeypatch):
    """A word ends where its text does, however many texts are analysed at once."""
    pick = random.Random(5)
    texts = ["tail", "s", "", None, "ing", "\u00e9", "thes\u00e9s", "x"] + ["".join(pick.choices("aAbsSeEdDxing \u00e9.,9", k=pick.randint(0, 40))) for _ in range(300)]
    want = [analyze_words(t or "") for t in texts]
    for most in (batch.AT_ONCE, 50, 1):
        monkeypatch.setattr(batch, "AT_ONCE", most)
        column = pa.array(["cut", *texts]).slice(1)
        assert batch.token_lists(column).to_pylist() == want
        assert batch.token_counts(column).to_pylist() == list(map(len, want))
        found = batch.figures({"body": column}, [("body", "x"), ("body", "none")], [("body", ("x", "x"))], 65535).to_pylist()
        assert [r["tf0"] for r in found] == [w.count("x") for w in want] and not any(r["tf1"] for r in found)
        assert [r["adj0"] for r in found] == [("x", "x") in itertools.pairwise(w) for w in want]
    assert batch.token_lists(pa.array([], pa.string())).to_pylist() == []


def test_documents_of_one_number(spark):
    rows = [(1, 7, "t", "otter heron"), (1, 7, "t", "otter"), (1, None, "", "otter"), (1, None, "", "otter otter")]
    docs = spark.createDataFrame(rows, "seg int, doc long, title string, body string")
    got = merged_numbers(build_postings(docs), docs.select("seg", "doc")).filter("field = 'body'").collect()
    assert {(r["doc"], r["term"], r["tf"], tuple(r["positions"])) for r in got} == {(7, "otter", 2, (0, 0)), (7, "heron", 1, (1,)), (None, "otter", 3, (0, 0, 1))}
    assert len(got) == 3


def test_analysis_of_megabytes_takes_seconds(spark):
    """12 MB of text in one task; patterns over the text took over ten seconds for each of these."""
    words = F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda k: F.substring(F.base64(F.sha1(F.concat_ws(" ", k, F.col("id")).cast("binary"))), 1, 5))
    made = spark.range(1000, numPartitions=1).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.array_join(words, " ").alias("body"))
    docs = made.persist()
    docs.count()
    scan_hits(docs.limit(1), "otter").count()
    try:
        for run in (lambda: scan_hits(docs, "otter -heron").count(), lambda: build_postings(number_documents(docs, 1)).agg(F.sum("tf")).first(), lambda: stored_documents(number_documents(docs, 1)).agg(F.sum("body_len")).first()):
            began = time.time()
            run()
            assert time.time() - began < 6
    finally:
        docs.unpersist()


def test_analysis_takes_few_bytes_at_once(spark):
    """The batches that Python workers get are bounded by bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame(D6, "id string, title string, body string")
    try:
        for run in (lambda: scan_hits(docs, "otter"), lambda: build_postings(number_documents(docs, 1)), lambda: stored_documents(number_documents(docs, 1))):
            spark.conf.unset(key)
            run()
            assert int(spark.conf.get(key)) <= 4_000_000
    finally:
        spark.conf.unset(key)
