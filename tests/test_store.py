"""The store's life cycle, its text format and streaming ingestion."""

import pyarrow as pa
import pytest

from fathomdex.cli import demo, handle, split_args
from fathomdex.operators.index import build_postings, number_documents, ranged_postings
from fathomdex.operators.store import Engine, StoreError
from fathomdex.plans.query_lang import QueryError
from fathomdex.sources import segment_text
from fathomdex.sources.segment_text import SegmentError, SegmentTextSource, build_segment, escape, format_segment, parse_segment, segment_lines, unescape
from fathomdex.streaming.ingest import ingest

from .test_search import D6, EXPECTED, evaluate

#: The text format's layout with a document of our own; its first line is a fixed value of the format.
GOLDEN = "INDEXDB 1\n1\nheron\nCold Heron\nThe cold heron waits after chasing an otter.\n2 6\ntitle\n2\ncold\n1\n0 1 1 0\nheron\n1\n0 1 1 1\nbody\n6\nafter\n1\n0 1 1 3\nchas\n1\n0 1 1 4\ncold\n1\n0 1 1 0\nheron\n1\n0 1 1 1\notter\n1\n0 1 1 5\nwait\n1\n0 1 1 2\n"


def ids(engine, query):
    return {r["id"]: r["score"] for r in engine.search(query).hits.collect()}


def test_life_cycle(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    for row in D6[:3]:
        e.put(*row)
    assert e.flush().documents == 3
    for row in D6[3:]:
        e.put(*row)
    s = e.stats()
    assert (s.sealed_segments, s.active_docs, s.live_docs) == (1, 3, 6)
    for query in ("otter", '"small river"', "title:otter", "otter -heron"):
        assert ids(e, query) == pytest.approx(EXPECTED[query], abs=2e-6)
    assert e.search("otter", 1).total == 4
    with pytest.raises(StoreError, match="document already indexed: otter"):
        e.put("otter", "x", "y")
    with pytest.raises(StoreError, match="document id is empty"):
        e.put("", "x", "y")
    with pytest.raises(StoreError, match="newline"):
        e.put("a\nb", "x", "y")
    with pytest.raises(QueryError):
        e.search("the")
    e.remove("heron")
    assert (tmp_path / "seg-000001.dead").exists()
    assert e.stats().dead_docs == 1
    e.remove("trout")
    with pytest.raises(StoreError, match="no such document: trout"):
        e.remove("trout")
    assert ids(e, "hide") == {}
    before = ids(e, "otter OR ledger")
    assert e.merge().outcome == "merged"
    s = e.stats()
    assert (s.sealed_segments, s.active_docs, s.live_docs, s.dead_docs) == (1, 0, 4, 0)
    assert not list(tmp_path.glob("*.dead"))
    assert ids(e, "otter OR ledger") == pytest.approx(before, abs=1e-12)
    again = Engine(spark, str(tmp_path))
    assert again.get("gears")[1] == "Mill Gears"
    assert again.get("heron") is None
    assert [r["id"] for r in again.list().collect()] == ["otter", "town", "ledger", "gears"]
    again.put("heron", "Cold Heron", "back again")
    assert again.get("heron") == ("heron", "Cold Heron", "back again")


def test_auto_flush_and_tiers(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    for pair in (("a", "b"), ("c", "d")):
        for x in pair:
            e.put(x, x, "body")
        e.flush()
    for i in range(8):
        last = e.put(f"big{i}", f"Title {i}", "a heron again")
    assert last.documents == 8 and e.stats().sealed_segments == 3
    assert e.merge().outcome == "merged"
    s = e.stats()
    assert (s.sealed_segments, s.live_docs, s.dead_docs) == (2, 12, 0)


def test_three_merges_and_bulk_deletes(spark, tmp_path):
    """Against the plain evaluator after each merge; document numbers stay apart."""
    e = Engine(spark, str(tmp_path))
    rows = [(f"d{i:02}", f"title {'red' if i % 3 else 'blue'}", " ".join(["heron"] * (1 + i % 4) + ["otter"] * (i % 2) + [f"w{i}"])) for i in range(32)]
    frame = spark.createDataFrame(rows, "id string, title string, body string")
    live = []
    for low, high in ((0, 4), (4, 8), (8, 16), (16, 32)):
        e.put_all(frame.filter((frame.id >= f"d{low:02}") & (frame.id < f"d{high:02}")).repartition(3))
        live += rows[low:high]
        if low == 8:
            assert e.remove_all(spark.createDataFrame([("d01",), ("d09",), ("none",)], "id string")) == 2
            live = [r for r in live if r[0] not in ("d01", "d09")]
        if low:
            assert e.merge().outcome == "merged"
        numbers = [(r["seg"], r["doc"]) for r in e.documents().collect()]
        assert len(set(numbers)) == len(numbers) == len(live)
        for query in ("heron", "otter -blue", '"heron otter"', "title:red w5"):
            want = dict(sorted(evaluate(live, query).items(), key=lambda x: (-x[1], x[0]))[:10])
            assert ids(e, query) == pytest.approx(want, abs=1e-9), (low, query)
    assert e.stats().sealed_segments == 1 and e.stats().live_docs == 30
    assert {p.name for p in tmp_path.glob("seg-*/postings/field=*")} == {"field=title", "field=body"}
    assert e.get("d01") is None and Engine(spark, str(tmp_path)).get("d31")[0] == "d31"


def test_odd_ids(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    for i in ("a\\b", "a\\\\b", " c ", "\\n"):
        e.put(i, "t", "heron")
    e.flush()
    e.remove("a\\b")
    assert e.remove_all(spark.createDataFrame([("\\n",)], "id string")) == 1
    again = Engine(spark, str(tmp_path))
    assert set(ids(again, "heron")) == {"a\\\\b", " c "} and again.stats().dead_docs == 2


def test_copies_in_a_bulk_load(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    rows = [("x", "b", "two"), ("x", "a", "three"), ("x", "a", "one"), ("", "t", "b"), ("y", None, None)]
    assert e.put_all(spark.createDataFrame(rows, "id string, title string, body string").repartition(4)).documents == 2
    assert e.get("x") == ("x", "a", "one") and e.get("y") == ("y", "", "")


def test_crash_recovery(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.put("keep", "t", "b\r\n\\x")
    e.put("drop", "t", "b")
    e.remove("drop")
    with open(tmp_path / "translog", "a") as f:
        f.write("0000 torn")
    again = Engine(spark, str(tmp_path))
    assert again.get("keep") == ("keep", "t", "b\r\n\\x")
    assert again.get("drop") is None
    assert again.stats().sealed_segments == 0 and again.stats().active_docs == 1


def test_stale_log_is_not_replayed(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.put("one", "t", "b")
    log = (tmp_path / "translog").read_text()
    e.flush()
    (tmp_path / "translog").write_text(log)
    e.remove("one")
    assert Engine(spark, str(tmp_path)).get("one") is None


def test_missing_segment(spark, tmp_path):
    (tmp_path / "manifest").write_text("epoch 1\nseg-000009\n")
    with pytest.raises(StoreError, match="manifest names a missing segment: seg-000009"):
        Engine(spark, str(tmp_path))


def test_bulk_and_stream(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame(D6, "id string, title string, body string")
    rows.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, title string, body string").json(str(tmp_path / "in"))
    ingest(e, stream, str(tmp_path / "cp")).awaitTermination()
    assert ids(e, "otter") == pytest.approx(EXPECTED["otter"], abs=2e-6)
    assert e.put_all(rows).documents == 0


def test_segment_text(spark, tmp_path):
    parsed = parse_segment(GOLDEN)
    assert format_segment(parsed) == GOLDEN
    assert format_segment(build_segment([("heron", "Cold Heron", "The cold heron waits after chasing an otter.")])) == GOLDEN
    assert parsed.tokens("body") == 6
    for text, message in (("x\n", "not a segment"), ("INDEXDB 1\n2\na\n", "truncated"), ("INDEXDB 1\nq\n", "bad count"), ("INDEXDB 1\n0\nbody\n", "missing title"), ("INDEXDB 1\n1\na\nb\nc\nz\n", "bad document length")):
        with pytest.raises(SegmentError, match=message):
            parse_segment(text)
    for s in ("a\\b\nc\rd", "\\", "plain"):
        assert unescape(escape(s)) == s
    spark.dataSource.register(SegmentTextSource)
    (tmp_path / "one.seg").write_text(GOLDEN)
    one = spark.read.format("segment_text").option("table", "postings")
    assert [(r["term"], r["doc"], r["tf"], list(r["positions"])) for r in one.option("field", "title").load(str(tmp_path / "one.seg")).collect()] == [("cold", 0, 1, [0]), ("heron", 0, 1, [1])]
    assert spark.read.format("segment_text").option("table", "postings").load(str(tmp_path / "one.seg")).count() == 8
    docs = spark.createDataFrame([(i, t, b + "\n\\") for i, t, b in D6], "id string, title string, body string").coalesce(2)
    docs.write.format("segment_text").mode("append").save(str(tmp_path / "segments"))
    back = spark.read.format("segment_text").load(str(tmp_path / "segments"))
    assert sorted((r["id"], r["title"], r["body"]) for r in back.collect()) == sorted((i, t, b + "\n\\") for i, t, b in D6)


def test_repl(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    assert split_args('a "b \\" c" d"e') == ["a", 'b " c', 'd"e']
    assert handle(e, 'put x "An otter" "the otter ran"') == "ok  x  (1 in the active segment)"
    assert handle(e, "search otter").startswith("1 hit\n  1. ")
    assert handle(e, "search heron") == "no hits"
    assert handle(e, "search (") == "error: unexpected end of query"
    assert handle(e, "get y") == "no such document"
    assert handle(e, "flush") == "sealed seg-000001 (1 docs)"
    assert handle(e, "merge") == "already one segment"
    assert handle(e, "list") == "x  An otter"
    assert handle(e, "quit") is None


def test_demo(spark, tmp_path):
    assert demo(spark, str(tmp_path)) == []


def test_segment_lines_against_the_plain_ones():
    rows = [*D6, ("w", "t9", " ".join(["x1"] * 65535 + ["mark", "tail", "x1", "x1"])), ("e", "", ""), ("o\\d", "a\nb", "\u00e9s otter\r\u00e9")]
    want = format_segment(build_segment(rows))
    assert "".join(segment_lines(*(pa.array(c, pa.string()) for c in zip(*rows, strict=True)))) == want
    assert segment_text.parse_segment(want).docs[0][0] == "otter"


def test_text_of_a_partition_goes_to_files_of_few_megabytes(spark, tmp_path):
    """One partition of 12 MB: no file, and so no writer or reader, holds all of it."""
    spark.dataSource.register(SegmentTextSource)
    docs = spark.range(60, numPartitions=1).selectExpr("string(id) AS id", "concat('Title ', id) AS title", "concat(repeat(concat('w', id, ' '), 50000), 'tail ', repeat('the ', 12500)) AS body")
    docs.write.format("segment_text").mode("append").save(str(tmp_path / "s"))
    files = list((tmp_path / "s").glob("*.seg"))
    assert len(files) >= 3
    assert (tmp_path / "s" / "manifest").read_text().splitlines() == sorted(f.name for f in files)
    for f in files:
        assert sum(len(body) for _, _, body, _, _ in parse_segment(f.read_text()).docs) <= 1.1 * segment_text.SEGMENT_BYTES
    assert spark.read.format("segment_text").load(str(tmp_path / "s")).count() == 60
    tails = spark.read.format("segment_text").option("table", "postings").option("ids", "true").load(str(tmp_path / "s")).filter("term = 'tail' OR field = 'title'").collect()
    assert len(tails) == 180 and all(r["term"] in ("tail", "title", r["id"]) for r in tails)
    assert {r["id"]: list(r["positions"]) for r in tails if r["term"] == "tail"} == {str(i): [50_000] for i in range(60)}


def test_postings_of_odd_files(spark, tmp_path, monkeypatch):
    """Rows out of order, other blanks, a file cut short: as the plain reader has them."""
    spark.dataSource.register(SegmentTextSource)
    head = "INDEXDB 1\n2\n" + "".join(f"{i}\nt\nb\n1 1\n" for i in "ab")
    for k, (rows, message) in enumerate([("2\n1 1 1 0\n0  2 2 1\t3\r\n", None), ("2\n0 1 1 0\n", "bad count|truncated|bad posting"), ("1\n2 1 1 0\n", "bad posting"), ("1\n0 1 2 0\n", "bad posting"), ("1\n0 1 1 65536\n", "bad posting"), ("1\n0 x 1 0\n", "bad posting"), ("3\n0 1 1 0\n", "truncated|bad posting")]):
        path = tmp_path / f"{k}.seg"
        path.write_bytes(f"{head}title\n0\nbody\n1\nb\n{rows}".encode())
        read = spark.read.format("segment_text").option("table", "postings").load(str(path))
        if message:
            with pytest.raises(Exception, match=message):
                read.collect()
        else:
            assert [(r["doc"], r["tf"], list(r["positions"])) for r in read.collect()] == [(0, 2, [1, 3]), (1, 1, [0])]


def test_ranged_postings(spark):
    """The same rows as build_postings, in the order of their terms, with far fewer rows sorted."""
    docs = number_documents(spark.createDataFrame(D6, "id string, title string, body string").coalesce(1), 3)
    want = {(r["term"], r["doc"], r["tf"], tuple(r["positions"])) for r in build_postings(docs).filter("field = 'body'").collect()}
    rows = ranged_postings(docs, "body").collect()
    assert {(r["term"], r["doc"], r["tf"], tuple(r["positions"])) for r in rows} == want and len(rows) == len(want)
    assert [(r["term"], r["doc"]) for r in rows] == sorted((r["term"], r["doc"]) for r in rows)
