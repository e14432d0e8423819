"""The line-based text format of a segment, as a Spark data source named "segment_text".

A file holds a header, a document count, four lines for each document and the two field
indexes. Reading gives one row for each stored document or, with the option table=postings,
for each posting (and with field=title or field=body those of one field, with ids=true each
with the id of its document, as a join of both tables would give it). A file is read
line by line, and handed on in batches; what isn't asked for is skipped. `parse_segment` gives
a whole segment. Writing takes (id, title, body) rows and puts a segment file for each few
megabytes of a partition's text, so that neither side holds more than that.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from fathomdex.functions import batch
from fathomdex.functions.analysis import analyze_words

#: Fixed values of the file format.
HEADER = "INDEXDB 1"
MAX_U16 = 65535
MAX_U32 = 4294967295

#: Bytes of text in a segment file that is written, and of a batch that is read; one document may have more.
SEGMENT_BYTES = batch.AT_ONCE
#: Postings of a batch that is read, but for those of its last term.
POSTINGS_AT_ONCE = 50_000

POSTING_SCHEMA = "file string, field string, term string, doc int, tf int, positions array<int>"
WITH_IDS = f"{POSTING_SCHEMA}, id string"
DOCUMENT_SCHEMA = "file string, doc int, id string, title string, body string, title_len long, body_len long"


class SegmentError(ValueError):
    """A segment file can't be read."""


@dataclass
class SegmentFile:
    docs: list[tuple[str, str, str, int, int]] = field(default_factory=list)
    #: field -> term -> [(doc, tf, positions)], sorted by doc
    index: dict[str, dict[str, list[tuple[int, int, list[int]]]]] = field(default_factory=lambda: {"title": {}, "body": {}})

    def tokens(self, name: str) -> int:
        return sum(tf for rows in self.index[name].values() for _, tf, _ in rows)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r"}.get(m[1], m[1]), text, flags=re.DOTALL)


class _SegmentLines:
    """The parts of a segment file in order, read as they are asked for."""

    def __init__(self, lines: Iterable[str], name: str):
        self.rest, self.name = iter(lines), name
        if self._line() != HEADER:
            raise SegmentError(f"not a segment file: {name}")
        self.many = self._count()

    def _line(self) -> str:
        if (x := next(self.rest, None)) is None:
            raise SegmentError(f"truncated segment file: {self.name}")
        return x.removesuffix("\n").removesuffix("\r")

    def _count(self) -> int:
        if not re.fullmatch("[0-9]+", x := self._line()):
            raise SegmentError(f"bad count in segment file: {self.name}")
        return int(x)

    def documents(self) -> Iterator[tuple[str, str, str, int, int]]:
        for _ in range(self.many):
            id_, title, body = (unescape(self._line()) for _ in range(3))
            lengths = self._line().split()
            if len(lengths) < 2 or not all(re.fullmatch("[0-9]+", x) for x in lengths[:2]):
                raise SegmentError(f"bad document length in segment file: {self.name}")
            yield id_, title, body, int(lengths[0]), int(lengths[1])

    def postings(self) -> Iterator[tuple[str, str, list[tuple[int, int, list[int]]]]]:
        """field, term and its rows; after documents() has ended."""
        for fld in ("title", "body"):
            if self._line() != fld:
                raise SegmentError(f"missing {fld} index in segment file: {self.name}")
            for _ in range(self._count()):
                term = self._line()
                yield fld, term, sorted((self._posting() for _ in range(self._count())), key=lambda r: r[0])

    def posting_batches(self) -> Iterator[tuple[str, list[str], list[int], pa.Array, pa.Array, pa.Array]]:
        """What postings() gives, for many terms at once: field, terms, how many rows each has,
        and doc, tf and positions of all rows."""
        for fld in ("title", "body"):
            if self._line() != fld:
                raise SegmentError(f"missing {fld} index in segment file: {self.name}")
            left = self._count()
            while left:
                terms, many, lines, total = [], [], [], 0
                while left and len(lines) < POSTINGS_AT_ONCE:
                    terms.append(self._line())
                    many.append(self._count())
                    lines.extend(islice(self.rest, many[-1]))
                    if len(lines) < (total := total + many[-1]):
                        raise SegmentError(f"truncated segment file: {self.name}")
                    left -= 1
                yield fld, terms, many, *(self._numbers(lines, many) or self._one_by_one(lines, many))

    def _numbers(self, lines: list[str], many: list[int]) -> tuple[pa.Array, pa.Array, pa.Array] | None:
        """The rows of these lines if they are as they are written, and None if anything is not."""
        text = "".join(lines)
        if not re.fullmatch(r"(?:[0-9]{1,9}(?: [0-9]{1,9}){2,}\n)*", text):
            return None
        flat = np.fromstring(text, np.int64, sep=" ")
        size = np.fromiter((x.count(" ") for x in lines), np.int64, len(lines)) + 1
        at = np.cumsum(size) - size
        doc, tf = flat[at], flat[at + 1]
        place = np.ones(len(flat), bool)
        for k in range(3):
            place[at + k] = False
        positions = flat[place]
        same = np.repeat(np.arange(len(many)), many)
        if (flat[at + 2] != size - 3).any() or (doc >= self.many).any() or (tf > MAX_U16).any() or (positions > MAX_U16).any() or ((doc[1:] < doc[:-1]) & (same[1:] == same[:-1])).any():
            return None
        first = np.concatenate([[0], np.cumsum(size - 3)])
        return pa.array(doc, pa.int32()), pa.array(tf, pa.int32()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(positions, pa.int32()))

    def _one_by_one(self, lines: list[str], many: list[int]) -> tuple[pa.Array, pa.Array, pa.Array]:
        rest, self.rest = self.rest, iter(lines)
        rows = [row for n in many for row in sorted((self._posting() for _ in range(n)), key=lambda r: r[0])]
        self.rest = rest
        return pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))

    def _posting(self) -> tuple[int, int, list[int]]:
        numbers = self._line().split()
        if len(numbers) < 3 or not all(re.fullmatch("[0-9]+", x) for x in numbers):
            raise SegmentError(f"bad posting in segment file: {self.name}")
        doc, tf, n, *positions = map(int, numbers)
        if doc >= self.many or tf > MAX_U16 or len(positions) != n or any(p > MAX_U16 for p in positions):
            raise SegmentError(f"bad posting in segment file: {self.name}")
        return doc, tf, positions


def parse_segment(text: str, name: str = "segment") -> SegmentFile:
    lines = _SegmentLines(text.split("\n")[:-1] if text.endswith("\n") else text.split("\n"), name)
    out = SegmentFile(list(lines.documents()))
    for fld, term, rows in lines.postings():
        out.index[fld][term] = rows
    return out


def build_segment(rows: Iterable[tuple[str, str, str]]) -> SegmentFile:
    out = SegmentFile()
    for n, (id_, title, body) in enumerate(rows):
        lengths = []
        for fld, text in (("title", title), ("body", body)):
            tokens = analyze_words(text)
            lengths.append(len(tokens))
            at: dict[str, list[int]] = {}
            for k, token in enumerate(tokens):
                at.setdefault(token, []).append(k)
            for token, positions in at.items():
                kept = [p for p in positions if p <= MAX_U16]
                out.index[fld].setdefault(token, []).append((n, min(len(positions), MAX_U16), kept))
        out.docs.append((id_, title, body, *lengths))
    return out


def format_segment(segment: SegmentFile) -> str:
    lines = [HEADER, str(len(segment.docs))]
    for id_, title, body, title_len, body_len in segment.docs:
        lines += [escape(id_), escape(title), escape(body), f"{title_len} {body_len}"]
    for fld in ("title", "body"):
        terms = segment.index[fld]
        lines += [fld, str(len(terms))]
        for term in sorted(terms, key=str.encode):
            lines += [term, str(len(terms[term]))]
            lines += [" ".join(map(str, (doc, tf, len(positions), *positions))) for doc, tf, positions in terms[term]]
    return "\n".join(lines) + "\n"


def segment_lines(ids: pa.Array, titles: pa.Array, bodies: pa.Array) -> Iterator[str]:
    """What format_segment(build_segment(rows)) gives, part by part, and by arrays."""
    fields = {"title": batch.tokens_of(titles), "body": batch.tokens_of(bodies)}
    lengths = zip(*(t.lengths().tolist() for t in fields.values()), strict=True)
    yield f"{HEADER}\n{len(ids)}\n"
    for row, (title_len, body_len) in zip(zip(*(x.to_pylist() for x in (ids, titles, bodies)), strict=True), lengths, strict=True):
        yield "".join(f"{escape(x or '')}\n" for x in row) + f"{title_len} {body_len}\n"
    for fld, t in fields.items():
        order = pc.sort_indices(t.terms).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        t = batch.Tokens(t.first, rank[t.codes], t.terms.take(pa.array(order)))
        doc, code, tf, positions = batch.posting_arrays(t, MAX_U16, by_term=True)
        many = np.diff(positions.offsets.to_numpy())
        at = np.cumsum(many + 3) - many - 3
        flat = np.empty(int((many + 3).sum()), np.int64)
        place = np.ones(len(flat), bool)
        for k, x in enumerate((doc, tf, many)):
            flat[at + k] = x
            place[at + k] = False
        flat[place] = positions.values.to_numpy()
        numbers = pa.array(np.append(at, len(flat)), pa.int32()), pc.cast(pa.array(flat), pa.string())
        rows = pc.binary_join(pa.ListArray.from_arrays(*numbers), " ").to_pylist()
        begin = np.flatnonzero(np.diff(code, prepend=-1))
        yield f"{fld}\n{len(begin)}\n"
        terms = t.terms.take(pa.array(code[begin])).to_pylist()
        for term, a, b in zip(terms, begin.tolist(), [*begin[1:].tolist(), len(rows)], strict=True):
            yield f"{term.decode()}\n{b - a}\n" + "\n".join(rows[a:b]) + "\n"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """ids, titles and bodies of one segment after the other."""
    held, size = [], 0
    for rows in batches:
        names = [rows.column(c) for c in ("id", "title", "body")]
        for a, b in batch.pieces(names):
            part = [x.slice(a, b - a) for x in names]
            now = sum(x.nbytes for x in part)
            if held and size + now > SEGMENT_BYTES:
                yield [pa.concat_arrays(x) for x in zip(*held, strict=True)]
                held, size = [], 0
            held, size = [*held, part], size + now
    if held:
        yield [pa.concat_arrays(x) for x in zip(*held, strict=True)]


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".seg"))
    return [path]


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, field: str, ids: bool):
        self.path, self.table, self.field, self.ids = path, table, field, ids

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        file = os.path.basename(partition.path)
        with open(partition.path, encoding="utf-8", newline="\n") as f:
            lines = _SegmentLines(f, partition.path)
            documents = enumerate(lines.documents())
            if self.table == "documents":
                yield from _document_batches(file, documents)
                return
            ids = [row[0] if self.ids else None for _, row in documents]
            for fld, terms, many, doc, tf, positions in lines.posting_batches():
                if self.field in ("", fld):
                    names = (_repeated(x, len(doc)) for x in (file, fld))
                    term = pa.array(terms, pa.string()).take(pa.array(np.repeat(np.arange(len(terms)), many)))
                    columns = dict(zip(("file", "field", "term", "doc", "tf", "positions"), (*names, term, doc, tf, positions), strict=True))
                    if self.ids:
                        columns["id"] = pa.array(ids, pa.string()).take(doc)
                    made = pa.RecordBatch.from_pydict(columns)
                    for k in range(0, made.num_rows, POSTINGS_AT_ONCE):
                        yield made.slice(k, POSTINGS_AT_ONCE)


def _repeated(text: str, n: int) -> pa.Array:
    return pa.array([text], pa.string()).take(pa.array(np.zeros(n, np.int32)))


def _document_batches(file: str, documents: Iterator[tuple[int, tuple]]) -> Iterator[pa.RecordBatch]:
    kinds = {"doc": pa.int32(), "id": pa.string(), "title": pa.string(), "body": pa.string(), "title_len": pa.int64(), "body_len": pa.int64()}

    def made() -> pa.RecordBatch:
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
        return pa.RecordBatch.from_arrays([_repeated(file, len(rows)), *columns], ["file", *kinds])

    rows, size = [], 0
    for n, row in documents:
        rows.append((n, *row))
        size += sum(map(len, row[:3]))
        if size > SEGMENT_BYTES:
            yield made()
            rows, size = [], 0
    if rows:
        yield made()


@dataclass
class _Wrote(WriterCommitMessage):
    paths: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def write(self, rows: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        at = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        parts = []
        for k, columns in enumerate(_segments(rows)):
            parts.append(os.path.join(self.path, f"seg-{at.partitionId() + 1:06d}-{k:06d}.{at.taskAttemptId()}.part"))
            with open(parts[-1], "w", encoding="utf-8", newline="") as f:
                f.writelines(segment_lines(*columns))
        return _Wrote(parts)

    def commit(self, messages: list) -> None:
        names = []
        for part in sorted(p for m in messages if m is not None for p in m.paths):
            names.append(f"seg-{len(names) + 1:06d}.seg")
            os.replace(part, os.path.join(self.path, names[-1]))
        with open(tmp := os.path.join(self.path, "manifest.tmp"), "w") as f:
            f.write("".join(f"{n}\n" for n in names))
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, os.path.join(self.path, "manifest"))

    def abort(self, messages: list) -> None:
        for part in (p for m in messages if m is not None for p in m.paths):
            if os.path.exists(part):
                os.unlink(part)


class SegmentTextSource(DataSource):
    """spark.read.format("segment_text").load(path): a .seg file, or a folder of them."""

    @classmethod
    def name(cls) -> str:
        return "segment_text"

    def _table(self) -> str:
        if (table := self.options.get("table", "documents")) not in ("documents", "postings"):
            raise ValueError(f"no such table of a segment: {table}")
        return table

    def _ids(self) -> bool:
        return self.options.get("ids", "false").lower() == "true"

    def schema(self) -> str:
        return DOCUMENT_SCHEMA if self._table() == "documents" else WITH_IDS if self._ids() else POSTING_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._table(), self.options.get("field", ""), self._ids())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])
