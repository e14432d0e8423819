"""Substring deduplication: paragraph MinHash banding, verification, and components.

A paragraph is a line of LEAST_WORDS words or more. Its MinHash signature over five-word
shingles is cut in BANDS bands of ROWS rows, tuned for recall: at the threshold of 0.8 a
pair meets in some band with a probability above 0.999.

Equal passages of LEAST_WORDS words or more are found exactly, wherever they begin and end,
lines and sentences aside. Winnowing ties each window of LEAST_WORDS words to the least of
its GRAM-word grams, which its own words decide, so equal windows have equal grams. A run is
the windows in a row that have one gram. Runs whose gram stands nowhere else are dropped;
equal runs have the first of them as their keeper, and where different runs share a gram,
their windows are compared by content, each with the first equal one as its keeper. Windows
in a row with keepers in a row are one passage. A copy that overlaps its keeper is none.

Copies of one content are combined in each task first, so that a very common line has a row
for each task in its cells, not one for each copy. In a cell every content has a head, the
smallest by id and place, and copies are linked with it. Equal content (two independent
64-bit numbers) is verified as it stands. Of a cell of SMALL_CELL contents or less every
pair is verified by exact Jaccard similarity of the shingle sets. The contents of larger
cells are joined exactly by pivots and triangle-inequality windows (jaccard_join's
region_links), each component of cells being a region: all links that the pairs would have
given are connected, with no pair left out. Components of the verified links are the
repeats: the first member, by id and place, stays, and the others are removed. A passage of
equal words that goes has an equal one before it by id and place, so none goes everywhere.

Defined results: null and short texts have no paragraphs. Words are what white space
separates, A-Z as a-z. A passage repeated within one document counts. Rows without an id
take no part; repeated rows are one document. An empty table gives no rows. Only the id and
text columns are read, and remove_repeats gives back all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomdex.llm.common import components, drop_since, lookup, made_so_far, materialize
from fathomdex.llm.jaccard_join import Rule, region_links
from fathomdex.llm.shingles import BATCH_BYTES, _rolled, mix, placed_words, word_hashes

WIDTH = 5
NUM, DEN = 8, 10
LEAST_WORDS = 25
#: Words of a gram; LEAST_WORDS - GRAM + 1 grams begin in a window.
GRAM = 13
BANDS, ROWS = 14, 4
#: Contents of a cell of which every pair is verified; those of larger cells are joined by pivots.
SMALL_CELL = 8
#: Contents of one cell that a task holds before it hands them on.
MOST_HELD = 10_000
#: Contents that a task remembers, to combine their copies; others are combined in their cell.
MOST_KNOWN = 20_000
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base)
    p[0] = 1
    return np.multiply.accumulate(p)


def _spans(h: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """A number for the words of each span that doesn't depend on where it stands."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    sums = np.r_[np.uint64(0), np.cumsum(mix(h ^ base) * _powers(base, len(h)), dtype=np.uint64)]
    return mix((sums[end] - sums[start]) * _powers(inverse, len(h))[start] + (end - start).astype(np.uint64))


def units(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of these texts' lines, a row for each band: text number, first word and end in it, cell, check."""
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    h, counts, begin = placed_words(texts)
    none = np.zeros(0, dtype=np.int64)
    if len(h) < LEAST_WORDS:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    line = np.cumsum(data == 10)[begin]
    text = np.repeat(np.arange(len(texts)), counts)
    offset = np.repeat(np.cumsum(counts) - counts, counts)
    new = np.r_[True, line[1:] != line[:-1]]
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(h)]
    long = end - start >= LEAST_WORDS
    start, end = start[long], end[long]
    out = []
    if len(start):
        rolled = _rolled(h, WIDTH)
        inside = np.zeros(len(h) + 1, dtype=np.int8)
        np.add.at(inside, start, 1)
        np.add.at(inside, end - WIDTH + 1, -1)
        inside = np.cumsum(inside)[: len(rolled)] > 0
        shingles = rolled[inside]
        x = np.empty_like(shingles)
        sizes = end - start - WIDTH + 1
        at = np.cumsum(sizes) - sizes
        check = _spans(h, start, end, _Q)
        for band in range(BANDS):
            cell = np.full(len(start), np.uint64(band))
            for k in range(band * ROWS, (band + 1) * ROWS):
                np.bitwise_xor(shingles, _SEEDS[k], out=x)
                np.multiply(x, _SEEDS[k] | np.uint64(1), out=x)
                least = np.minimum.reduceat(x, at)
                cell = mix(cell * _P + (least ^ (least >> np.uint64(29))))
            out.append((text[start], start - offset[start], end - offset[start], cell, check))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none, none.view(np.uint64), none.view(np.uint64))


def runs(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts with these word hashes: text number, first word and end of each run in it, gram, content."""
    if len(h) < LEAST_WORDS:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    grams = _rolled(h, GRAM)
    text = np.repeat(np.arange(len(counts)), counts)
    end_of = np.cumsum(counts)
    window = np.arange(len(h) - LEAST_WORDS + 1)
    gram = window + np.lib.stride_tricks.sliding_window_view(grams, LEAST_WORDS - GRAM + 1).argmin(axis=1)
    inside = window + LEAST_WORDS <= end_of[text[window]]
    window, gram = window[inside], gram[inside]
    new = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])
    start, end = window[new], window[np.r_[new[1:], len(window)] - 1] + LEAST_WORDS
    text = text[start]
    offset = (end_of - counts)[text]
    return text, start - offset, end - offset, grams[gram[new]], _spans(h, start, end, _P)


def _batched(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_BYTES):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def _span(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """First and last word as one number of the same order."""
    return first.astype(np.int64) << 32 | last.astype(np.int64)


def _unpacked(rows: pd.DataFrame, of: str = "") -> dict[str, np.ndarray]:
    span = rows[f"{of}span"].to_numpy()
    return {"doc_id": rows[f"{of}doc_id"].to_numpy(), "first": (span >> 32).astype(np.int32), "last": span.astype(np.int32)}


def _unit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of cells (of_span is 0), and links of copies to the one of their content that this
    task has given to the cells. Which copies a task combines doesn't change the groups."""
    known: dict[int, tuple] = {}  # contents that repeat within a batch: what very common lines do
    for batch in batches:
        ids = batch["doc_id"].to_numpy()
        for at, part in _batched([t.encode() for t in batch["text"]]):
            text, start, end, cell, check = units(part)
            if not len(cell):
                continue
            rows = pd.DataFrame({"cell": cell.view(np.int64), "doc_id": ids[at + text], "span": _span(start, end), "check": check.view(np.int64)})
            key, head, of = np.unique(mix(cell * _P + check), return_index=True, return_inverse=True)
            heads = rows.iloc[head].reset_index(drop=True)
            before = np.flatnonzero(np.isin(key, np.fromiter(known, dtype=np.uint64, count=len(known))))
            if len(before):
                told = pd.DataFrame([known[int(key[k])] for k in before], columns=rows.columns, index=before).astype(rows.dtypes)
                heads = pd.concat((heads.drop(index=before), told)).sort_index()
            old = np.zeros(len(key), dtype=bool)
            old[before] = True
            for k in np.flatnonzero((np.bincount(of) > 1) & ~old)[: MOST_KNOWN - len(known)].tolist():
                known[int(key[k])] = tuple(heads.iloc[k])
            copy = old[of] | (head[of] != np.arange(len(of)))
            for x in ("cell", "check"):
                copy &= rows[x].to_numpy() == heads[x].to_numpy()[of]
            yield rows[~copy].assign(of_doc_id=0, of_span=0)
            place = ["doc_id", "span"]
            to = heads[place].iloc[of[copy]].reset_index(drop=True).add_prefix("of_")
            links = pd.concat((rows.loc[copy, place].reset_index(drop=True), to), axis=1).drop_duplicates()
            spread = mix(links["doc_id"].to_numpy().view(np.uint64) + (links["span"].to_numpy() >> 32).astype(np.uint64) * _P)
            yield links.assign(cell=spread.view(np.int64), check=0)[[*rows.columns, "of_doc_id", "of_span"]]


_NAMES = ["doc_id", "first", "last"]
#: What a row of _meet says: equal contents, contents to compare, contents of one large cell.
SAME, PAIR, TIE = 0, 1, 2


def _links(rows: pd.DataFrame, a, b, kind: int) -> pd.DataFrame:
    found = {f"{x}_{s}": rows[x].to_numpy()[i] for s, i in (("a", a), ("b", b)) for x in _NAMES} | {"kind": kind}
    check = rows["check"].to_numpy()
    return _apart(pd.DataFrame(found | {f"check_{s}": check[i] if kind == TIE else 0 for s, i in (("a", a), ("b", b))}))


def _apart(found: pd.DataFrame) -> pd.DataFrame:
    return found[(found["doc_id_a"] != found["doc_id_b"]) | (found["first_a"] != found["first_b"]) | (found["last_a"] != found["last_b"])].drop_duplicates()


def _compared(heads: pd.DataFrame, large: int | None) -> Iterator[pd.DataFrame]:
    """All pairs of contents of small cells, and ties of large ones; large: a cell that is one already."""
    cell = heads["cell"].to_numpy()
    if not len(cell):
        return
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    count = np.diff(np.r_[start, len(cell)])
    many = np.repeat(count > SMALL_CELL, count) | (cell == large if large is not None else False)
    top, end, place = np.repeat(start, count), np.repeat(start + count, count), np.arange(len(cell))
    if many.any():
        yield _links(heads, top[many], place[many], TIE)
    small = np.flatnonzero(~many)
    pairs = [(at, at + k) for k in range(1, SMALL_CELL) for at in [small[small + k < end[small]]]]
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    if len(a):
        yield _links(heads, a, b, PAIR)


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of cells; rows come sorted by cell, content, id and place, a cell in one task."""
    held: pd.DataFrame | None = None  # the contents' heads of the last cell
    large: int | None = None  # that cell, if some of its heads have been handed on
    for batch in batches:
        of = batch["of_span"].to_numpy() > 0
        if of.any():
            linked = batch[of]
            found = {f"{x}_{side}": v for side, o in (("a", "of_"), ("b", "")) for x, v in _unpacked(linked, o).items()}
            yield _apart(pd.DataFrame(found | {"kind": SAME, "check_a": 0, "check_b": 0}))
            batch = batch[~of]
        if not len(batch):
            continue
        batch = pd.DataFrame({"cell": batch["cell"].to_numpy()} | _unpacked(batch) | {"check": batch["check"].to_numpy()})
        rows = batch if held is None else pd.concat((held, batch), ignore_index=True)
        cell, check, place = rows["cell"].to_numpy(), rows["check"].to_numpy(), np.arange(len(rows))
        new_cell = np.r_[True, cell[1:] != cell[:-1]]
        new = new_cell | np.r_[True, check[1:] != check[:-1]]
        head = np.maximum.accumulate(np.where(new, place, 0))
        yield _links(rows, head[~new], place[~new], SAME)
        last = cell == cell[-1]
        yield from _compared(rows[new & ~last], large)
        large = large if large == cell[-1] else None
        held = rows[new & last]
        if len(held) > MOST_HELD:
            large = int(cell[-1])
            yield from _compared(held, large)
            held = held.iloc[[0, -1]]
    if held is not None:
        yield from _compared(held, large)


#: A passage as one number: id, first word and number of words, in this order.
_WORDS = "CAST(1000000000 AS DECIMAL(10, 0))"
_DOC = "CAST(1000000000000000000 AS DECIMAL(19, 0))"


def _key(side: str):
    doc, first, last = (f"{x}_{side}" for x in ("doc_id", "first", "last"))
    return F.expr(f"CAST(CAST({doc} AS DECIMAL(19, 0)) * {_DOC} + CAST({first} AS DECIMAL(10, 0)) * {_WORDS} + CAST({last} - {first} AS DECIMAL(10, 0)) AS DECIMAL(38, 0))")


def _passage(c: str) -> dict:
    """doc_id, first and last of such a number."""
    rest = f"pmod({c}, {_DOC})"
    first = f"CAST({rest} div {_WORDS} AS BIGINT)"
    return {"doc_id": F.expr(f"CAST(({c} - {rest}) div {_DOC} AS BIGINT)"), "first": F.expr(first), "last": F.expr(f"{first} + CAST(pmod({rest}, {_WORDS}) AS BIGINT)")}


def _hashed(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[tuple]]]:
    """Word hashes of many texts at once; of each text its id, its first word's place in them, and its spans."""
    ids, spans = batch["doc_id"].to_numpy(), batch["spans"].to_numpy()
    for at, part in _batched([t.encode() for t in batch["text"]]):
        h, counts = word_hashes(part)
        base = np.cumsum(counts) - counts
        yield h, [(ids[at + k], int(base[k]), spans[at + k]) for k in range(len(part))]


def _passages_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The wanted spans of each text with the size of their sets: heads as texts of their own,
    others with their distinct shingles. No field of a span is null, as pandas has lists of
    numbers with a null as floats."""
    for batch in batches:
        whole = iter(batch["text"])
        for h, texts in _hashed(batch):
            rolled = _rolled(h, WIDTH)
            out = []
            for i, base, spans in texts:
                text, raw = next(whole), None
                for s in spans:
                    line, found = None, np.unique(rolled[base + s["first"] : base + s["last"] - WIDTH + 1])
                    if s["head"]:
                        raw = text.encode().split() if raw is None else raw
                        line = b" ".join(raw[s["first"] : s["last"]]).decode()
                    out.append((i, s["first"], s["last"], s["head"], s["check"], len(found), line, None if s["head"] else found.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "first", "last", "head", "check", "n", "text", "shingles"])


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for x, y in zip(batch["sa"], batch["sb"], strict=True):
            a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(DEN * both >= NUM * (len(a) + len(b) - both))
        yield batch.loc[keep, ["a", "b"]]


def _run_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids = batch["doc_id"].to_numpy()
        for at, part in _batched([t.encode() for t in batch["text"]]):
            text, first, last, gram, run = runs(*word_hashes(part))
            yield pd.DataFrame({"gram": gram.view(np.int64), "run": run.view(np.int64), "doc_id": ids[at + text], "first": first.astype(np.int32), "last": last.astype(np.int32)})


def _lists(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """How many structs each list has, and the fields of all of them in a row."""
    many = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    return many, {f.name: flat.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(flat.type)}


def _batch(columns: dict[str, tuple[np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(kind.to_pandas_dtype(), copy=False), kind) for x, kind in columns.values()], names=list(columns))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the wanted runs of each text, by content (one and two)."""
    for batch in batches:
        ids = batch["doc_id"].to_numpy()
        wanted, spans = _lists(batch["spans"])
        begin = np.r_[0, np.cumsum(wanted)]
        for k, part in _batched(batch["text"].cast(pa.binary()).to_pylist()):
            h, counts = word_hashes(part)
            here = slice(begin[k], begin[k + len(part)])
            text = np.repeat(np.arange(len(part)), wanted[k : k + len(part)])
            if not len(text):
                continue
            first, last = (spans[x][here].astype(np.int64) for x in ("first", "last"))
            many = last - first - LEAST_WORDS + 1
            offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(first, many) + offset
            there = at + np.repeat((np.cumsum(counts) - counts)[text], many)
            one, two = (_spans(h, there, there + LEAST_WORDS, b).view(np.int64) for b in (_P, _Q))
            doc, gram, run = (np.repeat(x, many) for x in (ids[k + text], spans["gram"][here], spans["run"][here]))
            long, short = pa.int64(), pa.int32()
            yield _batch({"one": (one, long), "two": (two, long), "doc_id": (doc, long), "first": (at, short), "gram": (gram, long), "run": (run, long), "offset": (offset, short)})


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run the windows in a row that have keepers in a row, and those keepers. A keeper of
    many copies comes once for each batch that has them; `_joined` makes one of these rows."""
    names = ["doc_id", "first", "last", "keeper_doc_id", "keeper_first"]
    for batch in batches:
        first = batch["first"].to_numpy().astype(np.int64)
        many = batch["last"].to_numpy() - first - LEAST_WORDS + 1
        row = np.repeat(np.arange(len(many)), many)
        base = np.cumsum(many) - many
        offset = np.arange(len(row)) - np.repeat(base, many)
        doc, at = batch["doc_id"].to_numpy()[row], first[row] + offset
        to_doc, to = batch["head_doc_id"].to_numpy()[row], batch["head_first"].to_numpy()[row] + offset
        known, before = _lists(batch["before"])
        place = np.repeat(base, known) + before["offset"]
        to_doc[place], to[place] = before["doc_id"], before["first"]
        far = (to_doc != doc) | (at - to >= LEAST_WORDS)
        row, doc, at, to_doc, to = (x[far] for x in (row, doc, at, to_doc, to))
        if not len(row):
            continue
        new = np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (to_doc[1:] != to_doc[:-1]) | (to[1:] != to[:-1] + 1)]
        new = np.flatnonzero(new)
        length = at[np.r_[new[1:], len(at)] - 1] + LEAST_WORDS - at[new]
        doc, at, to_doc, to = (x[new] for x in (doc, at, to_doc, to))
        found = pd.DataFrame(dict(zip(names, (np.r_[doc, to_doc], np.r_[at, to], np.r_[at + length, to + length], np.r_[to_doc, to_doc], np.r_[to, to]), strict=True))).drop_duplicates()
        yield _batch({x: (found[x].to_numpy(), pa.int64() if "doc_id" in x else pa.int32()) for x in names})


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by id, keeper, distance and place; those whose windows go on in the next are one."""
    held: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if held is None else pd.concat((held, batch), ignore_index=True)
        if not len(rows):
            continue
        first, last = rows["first"].to_numpy(), rows["last"].to_numpy()
        same = np.ones(len(rows) - 1, dtype=bool)
        for c in ("doc_id", "keeper_doc_id", "apart"):
            same &= rows[c].to_numpy()[1:] == rows[c].to_numpy()[:-1]
        # A row ends after all before it, except where it lies within one of them.
        group = np.cumsum(np.r_[True, ~same]) - 1
        wide = np.int64(1) << np.int64(32)
        reach = np.maximum.accumulate(last + group * wide) - group * wide
        new = np.flatnonzero(np.r_[True, ~same | (first[1:] > reach[:-1] - LEAST_WORDS + 1)])
        out = rows.iloc[new].assign(last=np.maximum.reduceat(last, new).astype(np.int32))
        held = out.iloc[-1:]
        yield out.iloc[:-1]
    if held is not None:
        yield held


def repeated_runs(rows: DataFrame) -> DataFrame:
    """doc_id, first, last, keeper_doc_id and keeper_first of every equal passage of rows (doc_id, text), keepers included."""
    spark = rows.sparkSession
    mark = made_so_far(spark)
    every = materialize(rows.mapInPandas(_run_rows, "gram long, run long, doc_id long, first int, last int"), "runs")
    grams = materialize(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n_gram")).filter("n_gram > 1"), "grams")
    met = materialize(lookup(every, grams, "gram", "n_gram", grams.agg(F.sum("n_gram")).first()[0] or 0).drop("n_gram"), "met-runs")
    drop_since(spark, mark, met)
    mark = made_so_far(spark)
    met = met.select(F.struct("gram", "run").alias("key"), "doc_id", "first", "last")
    groups = materialize(met.groupBy("key").agg(F.min(F.struct("doc_id", "first", "last")).alias("head"), F.count(F.lit(1)).alias("n")), "runs-groups")

    several = materialize(groups.groupBy(F.col("key.gram").alias("gram")).agg(F.count(F.lit(1)).alias("n_runs")).filter("n_runs > 1"), "several")
    unsure = lookup(groups.select(F.col("key.gram").alias("gram"), "key.run", "head"), several, "gram", "n_runs", several.agg(F.sum("n_runs")).first()[0] or 0)
    spans = unsure.groupBy(F.col("head.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("gram", "run", "head.first", "head.last")).alias("spans"))
    windows = rows.join(spans.hint("merge"), "doc_id").mapInArrow(_window_rows, "one long, two long, doc_id long, first int, gram long, run long, offset int")
    windows = materialize(windows, "windows").select(F.struct("one", "two").alias("content"), "doc_id", "first", F.struct("gram", "run").alias("key"), "offset")
    firsts = windows.groupBy("content").agg(F.min(F.struct("doc_id", "first")).alias("to"), F.count(F.lit(1)).alias("n_windows")).filter("n_windows > 1")
    firsts = materialize(firsts, "windows-first")
    earlier = lookup(windows, firsts, "content", "n_windows", firsts.agg(F.sum("n_windows")).first()[0] or 0)
    earlier = earlier.filter("doc_id != to.doc_id OR first != to.first").groupBy("key").agg(F.collect_set(F.struct("offset", "to.doc_id", "to.first")).alias("before"))
    known = groups.join(earlier.hint("merge"), "key", "left").filter("n > 1 OR before IS NOT NULL")
    known = materialize(known.select("key", "n", F.col("head.doc_id").alias("head_doc_id"), F.col("head.first").alias("head_first"), "before"), "known")
    drop_since(spark, mark, known)
    found = lookup(met, known, "key", "n", known.agg(F.sum("n")).first()[0] or 0).select("doc_id", "first", "last", "head_doc_id", "head_first", "before")
    found = found.mapInArrow(_kept, "doc_id long, first int, last int, keeper_doc_id long, keeper_first int").withColumn("apart", F.expr("first - keeper_first"))
    order = ["doc_id", "keeper_doc_id", "apart", "first"]
    found = found.repartition("doc_id").sortWithinPartitions(*order).mapInPandas(_joined, "doc_id long, first int, last int, keeper_doc_id long, keeper_first int, apart int")
    return found.drop("apart")


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each member of a group of repeats: doc_id, first and last (words, end
    exclusive), keeper_doc_id, keeper_first, and removed (false for the keeper)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    mark = made_so_far(rows.sparkSession)
    found = rows.mapInPandas(_unit_rows, "cell long, doc_id long, span long, check long, of_doc_id long, of_span long")
    met = found.repartition("cell").sortWithinPartitions("cell", "check", "doc_id", "span").mapInPandas(_meet, "doc_id_a long, first_a int, last_a int, doc_id_b long, first_b int, last_b int, kind int, check_a long, check_b long")
    met = materialize(met.distinct(), "met")
    units = (F.struct(*(F.col(f"{x}_{s}").alias(x) for x in _NAMES)).alias(f"u{s}") for s in "ab")
    pairs = met.select("kind", *units, _key("a").alias("a"), _key("b").alias("b"), "check_a", "check_b")
    unsure, ties = pairs.filter(F.col("kind") == PAIR), pairs.filter(F.col("kind") == TIE)
    heads = _heads(ties)
    passages = _passages(rows, unsure, heads)
    links = pairs.filter(F.col("kind") == SAME).select("a", "b").unionByName(_verified(passages, unsure))
    links = links.unionByName(_joined_cells(passages, ties, heads))
    groups = components(links, "repeats")
    drop_since(rows.sparkSession, mark, groups)

    node, root = _passage("node"), _passage("root")
    lines = groups.select(*(x.alias(n) for n, x in node.items()), root["doc_id"].alias("keeper_doc_id"), root["first"].cast("int").alias("keeper_first"))
    both = lines.withColumn("last", F.col("last").cast("int")).withColumn("first", F.col("first").cast("int")).unionByName(repeated_runs(rows))
    both = both.groupBy("doc_id", "first", "last").agg(F.min(F.struct("keeper_doc_id", "keeper_first")).alias("keeper")).select("doc_id", "first", "last", "keeper.*")
    return both.withColumn("removed", F.expr("keeper_doc_id != doc_id OR keeper_first != first"))


def _heads(ties: DataFrame) -> DataFrame:
    """The first unit (u) of each content of large cells, by its check."""
    heads = F.explode(F.array(*(F.struct(F.col(f"check_{s}").alias("check"), F.struct(F.col(s).alias("key"), F.col(f"u{s}").alias("u")).alias("head")) for s in "ab")))
    heads = ties.select(heads.alias("x")).select("x.*").groupBy("check").agg(F.min("head").alias("head"))
    return materialize(heads.select("check", "head.key", "head.u"), "heads")


def _passages(rows: DataFrame, unsure: DataFrame, heads: DataFrame) -> DataFrame:
    """The units of unsure pairs and the heads, as `_passages_of` gives them, by one reading of the texts."""
    wanted = unsure.select(F.explode(F.array("ua", "ub")).alias("u")).distinct().select("u.*", F.lit(False).alias("head"), F.lit(0).cast("long").alias("check"))
    wanted = wanted.unionByName(heads.select("u.*", F.lit(True).alias("head"), "check"))
    spans = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "head", "check")).alias("spans"))
    found = rows.join(spans.hint("merge"), "doc_id").mapInPandas(_passages_of, "doc_id long, first int, last int, head boolean, check long, n long, text string, shingles binary")
    return materialize(found.dropDuplicates(["doc_id", "first", "last", "head", "check"]), "passages")


def _verified(passages: DataFrame, unsure: DataFrame) -> DataFrame:
    """The links (a, b) of those pairs of lines whose Jaccard similarity is high enough."""
    texts = passages.filter("NOT head").select(F.struct("doc_id", "first", "last").alias("u"), "shingles")
    both = unsure.join(texts.select(F.col("u").alias("ua"), F.col("shingles").alias("sa")), "ua").join(texts.select(F.col("u").alias("ub"), F.col("shingles").alias("sb")), "ub")
    return both.select("a", "b", "sa", "sb").mapInPandas(_similar, "a decimal(38,0), b decimal(38,0)")


def _joined_cells(passages: DataFrame, ties: DataFrame, heads: DataFrame) -> DataFrame:
    """The links (a, b) among the contents of large cells, by an exact join of each component of cells."""
    spark = passages.sparkSession
    mark = made_so_far(spark)
    regions = components(ties.select(F.col("check_a").alias("a"), F.col("check_b").alias("b")), "cells")
    lines = passages.filter("head").select(F.col("check").alias("doc_id"), "n", "text")
    members = materialize(lines.select("doc_id", "n").join(regions.select(F.col("node").alias("doc_id"), F.col("root").alias("region")).hint("merge"), "doc_id"), "members")
    drop_since(spark, mark, members)
    found = region_links(lines.select("doc_id", "text"), members, rule=Rule(WIDTH, NUM, DEN))
    a, b = (heads.select(F.col("check").alias(f"check_{s}"), F.col("key").alias(s)) for s in "ab")
    found = found.withColumnsRenamed({"a": "check_a", "b": "check_b"})
    return found.join(a.hint("merge"), "check_a").join(b.hint("merge"), "check_b").select("a", "b")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the words of removed passages; lines that lose all their words go."""
    gone = repeated_paragraphs(docs, id_col, text_col).filter("removed")
    spans = gone.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    columns, at = docs.columns, docs.columns.index(text_col)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    kept = packed.join(spans.hint("merge"), "doc_id", "left").select("row.*", F.col("spans").alias(f"spans of {'_'.join(columns)}"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [without(t, s) if s is not None else t for t, s in zip(batch.iloc[:, at], batch.iloc[:, -1], strict=True)]
            batch = batch.iloc[:, :-1].copy()
            batch[text_col] = texts
            yield batch

    return kept.mapInPandas(cut, docs.schema)


def without(text: str | None, spans) -> str | None:
    """The text without the words of these spans."""
    if text is None:
        return None
    drop = np.zeros(len(text.encode().split()) + 1, dtype=bool)
    for s in spans:
        drop[s["first"] : s["last"]] = True
    out, at = [], 0
    for line in text.split("\n"):
        words = line.encode().split()
        stay = [w for k, w in enumerate(words, at) if not drop[k]]
        at += len(words)
        if len(stay) == len(words):
            out.append(line)
        elif stay:
            out.append(b" ".join(stay).decode())
    return "\n".join(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
