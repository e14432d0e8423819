"""The analyzer over Arrow batches: the same tokens as in analysis.py, by arrays of bytes.

Words are found in the bytes of all texts at once and hashed once each; stop words and stems
are settled for distinct words only. A text that isn't ASCII needs no decoding, since bytes
of other characters are never letters or digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fathomdex.functions.analysis import STOPWORDS

#: Bytes of text that are analysed at once; what that takes is about 25 times as much.
AT_ONCE = 4_000_000

_WORD = np.zeros(256, bool)
_LOWER = np.arange(256, dtype=np.uint8)
for _low, _high in (b"az", b"AZ", b"09"):
    _WORD[_low : _high + 1] = True
_LOWER[ord("A") : ord("Z") + 1] += 32
_STOP = pa.array([w.encode() for w in STOPWORDS], pa.large_binary())


@dataclass
class Tokens:
    """The tokens of some texts, one after the other."""

    #: first[k]:first[k + 1] are the tokens of text k
    first: np.ndarray
    #: for each token, its place in terms
    codes: np.ndarray
    #: distinct terms as large_binary; some may not occur
    terms: pa.Array

    def lengths(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """For each token, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.lengths())

    def places(self) -> np.ndarray:
        """For each token, its position in its text."""
        return np.arange(len(self.codes)) - np.repeat(self.first[:-1], self.lengths())

    def code(self, term: str) -> int:
        """-1 if no text has it."""
        return pc.index(self.terms, pa.scalar(term.encode(), pa.large_binary())).as_py()


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, and the end; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings of these lengths, one after the other in data, as large_binary."""
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def _stems(words: pa.Array) -> pa.Array:
    data, at = _bytes_of(words)
    n, end = np.diff(at), at[1:]
    last = [data[np.maximum(end - k, 0)] if len(data) else data for k in range(1, 5)]
    is_ = lambda k, letters: np.isin(last[k - 1], np.frombuffer(letters, np.uint8))
    sibilant = is_(3, b"sxz") | is_(3, b"h") & is_(4, b"cs")
    cut = np.select(
        [
            (n > 5) & is_(1, b"g") & is_(2, b"n") & is_(3, b"i"),
            (n > 4) & is_(1, b"d") & is_(2, b"e"),
            (n > 4) & is_(1, b"s") & is_(2, b"e") & sibilant,
            (n > 3) & is_(1, b"s") & ~is_(2, b"s"),
        ],
        [3, 2, 2, 1],
        0,
    )
    keep = np.ones(len(data), bool)
    for k in range(1, 4):
        keep[end[cut >= k] - k] = False
    return _array(data[keep], n - cut)


def tokens_of(texts: pa.Array) -> Tokens:
    raw, at = _bytes_of(texts)
    word = _WORD[raw]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edges = at[(at > 0) & (at < len(raw))]  # a word ends where its text does
    begins[edges] = word[edges]
    ends[edges - 1] = word[edges - 1]
    begin = np.flatnonzero(begins)
    words = _array(_LOWER[raw[word]], np.flatnonzero(ends) + 1 - begin).dictionary_encode()
    stems = _stems(words.dictionary).dictionary_encode()
    codes = stems.indices.to_numpy(zero_copy_only=False).copy()
    codes[pc.is_in(words.dictionary, value_set=_STOP).to_numpy(zero_copy_only=False)] = -1
    codes = codes[words.indices.to_numpy(zero_copy_only=False)] if len(begin) else np.zeros(0, np.int32)
    kept = codes >= 0
    return Tokens(np.searchsorted(begin[kept], at), codes[kept], stems.dictionary)


def pieces(texts: list[pa.Array]) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, end) of about AT_ONCE bytes in all columns together; of no rows, one of none."""
    size = sum(np.diff(_bytes_of(t)[1]) for t in texts)
    at, done = 0, np.concatenate([[0], np.cumsum(size)])
    if not len(size):
        yield 0, 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(done, done[at] + AT_ONCE, side="right")) - 1)
        yield at, end
        at = end


def _text(terms: pa.Array) -> pa.Array:
    return terms.cast(pa.large_string()).cast(pa.string())


def token_lists(texts: pa.Array) -> pa.Array:
    """Each text's tokens, as list<string>."""
    parts = []
    for a, b in pieces([texts]):
        t = tokens_of(texts.slice(a, b - a))
        parts.append(pa.ListArray.from_arrays(pa.array(t.first, pa.int32()), _text(t.terms).take(pa.array(t.codes))))
    return pa.concat_arrays(parts)


def token_counts(texts: pa.Array) -> pa.Array:
    parts = [tokens_of(texts.slice(a, b - a)).lengths() for a, b in pieces([texts])]
    return pa.array(np.concatenate(parts), pa.int32())


def posting_arrays(t: Tokens, most: int, by_term: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """text, code, count and positions of each text's distinct terms, text by text or term by
    term. Counts stop at most, and positions beyond it are left out."""
    texts, codes, places = t.texts(), t.codes.astype(np.int64), t.places()
    order = np.argsort(codes * (len(t.first) - 1) + texts if by_term else texts * len(t.terms) + codes, kind="stable")
    texts, codes, places = texts[order], codes[order], places[order]
    new = np.ones(len(order), bool)
    new[1:] = (texts[1:] != texts[:-1]) | (codes[1:] != codes[:-1])
    at = np.flatnonzero(new)
    kept = places <= most
    first = np.concatenate([[0], np.cumsum(kept)])[np.append(at, len(order))]
    positions = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(places[kept], pa.int32()))
    return texts[at], codes[at], np.minimum(np.diff(np.append(at, len(order))), most), positions


def postings(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (seg, field, term, doc, tf, positions) of batches (seg, doc and a text for each field)."""
    for batch in batches:
        for a, b in pieces([batch.column(f) for f in fields]):
            part = batch.slice(a, b - a)
            for f in fields:
                t = tokens_of(part.column(f))
                text, code, count, positions = posting_arrays(t, most)
                rows = pa.array(text)
                columns = {
                    "seg": part.column("seg").take(rows),
                    "field": pa.array([f], pa.string()).take(pa.array(np.zeros(len(text), np.int32))),
                    "term": _text(t.terms).take(pa.array(code)),
                    "doc": part.column("doc").take(rows),
                    "tf": pa.array(count, pa.int32()),
                    "positions": positions,
                }
                made = pa.RecordBatch.from_pydict(columns)
                for k in range(0, made.num_rows, 50_000):
                    yield made.slice(k, 50_000)


def grouped_postings(batches: Iterator[pa.RecordBatch], field: str, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (term, first, found) of batches (doc, field): the postings that a term has in some
    texts, and the number of the first of these. They are far fewer to sort than postings are."""
    for batch in batches:
        for a, b in pieces([batch.column(field)]):
            part = batch.slice(a, b - a)
            t = tokens_of(part.column(field))
            text, code, count, positions = posting_arrays(t, most, by_term=True)
            at = np.flatnonzero(np.diff(code, prepend=-1))
            docs = part.column("doc").take(pa.array(text))
            found = pa.StructArray.from_arrays([docs, pa.array(count, pa.int32()), positions], ["doc", "tf", "positions"])
            columns = {
                "term": _text(t.terms).take(pa.array(code[at])),
                "first": docs.take(pa.array(at)),
                "found": pa.ListArray.from_arrays(pa.array(np.append(at, len(code)), pa.int32()), found),
            }
            made = pa.RecordBatch.from_pydict(columns)
            for k in range(0, made.num_rows, 20_000):
                yield made.slice(k, 20_000)


def figures(fields: dict[str, pa.Array], counted: list[tuple[str, str]], phrases: list[tuple[str, tuple[str, ...]]], most: int) -> pa.StructArray:
    """For each row the lengths of fields (title_len), how often it has each counted (field, term)
    up to most (tf0, tf1, ...), and whether it has each phrase in its first most + 1 tokens (adj0, ...)."""
    parts = []
    for a, b in pieces(list(fields.values())):
        found = {f: tokens_of(x.slice(a, b - a)) for f, x in fields.items()}
        out = {f"{f}_len": pa.array(t.lengths(), pa.int32()) for f, t in found.items()}
        for k, (f, term) in enumerate(counted):
            t = found[f]
            at = np.flatnonzero(t.codes == t.code(term))
            many = np.bincount(np.searchsorted(t.first, at, side="right") - 1, minlength=b - a)
            out[f"tf{k}"] = pa.array(np.minimum(many, most), pa.int32())
        for k, (f, terms) in enumerate(phrases):
            t = found[f]
            at = np.flatnonzero(t.codes == t.code(terms[0]))
            text = np.searchsorted(t.first, at, side="right") - 1
            inside = (at + len(terms) <= t.first[text + 1]) & (at - t.first[text] + len(terms) - 1 <= most)
            at, text = at[inside], text[inside]
            for n, term in enumerate(terms[1:], 1):
                here = t.codes[at + n] == t.code(term)
                at, text = at[here], text[here]
            has = np.zeros(b - a, bool)
            has[text] = True
            out[f"adj{k}"] = pa.array(has)
        parts.append(pa.StructArray.from_arrays(list(out.values()), list(out)))
    return pa.concat_arrays(parts)
