"""Word shingles of many texts at once, as 64-bit numbers in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The white space of the contracts.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Text hashed at once; hashing takes about fifty times as much memory.
BATCH_BYTES = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_JOIN = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text.

    Words are runs of other bytes than white space; A-Z count as a-z.
    """
    return placed_words(texts)[:2]


def placed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes, and where each word begins in the texts joined by one byte."""
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), dtype=np.uint8)
    letter = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[False, letter, False].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    text_ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    counts = np.diff(np.r_[0, np.searchsorted(starts, text_ends)])
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts, starts
    lengths = ends - starts
    power = np.full(int(lengths.max()), _BASE)
    power = np.multiply.accumulate(power)
    first = np.cumsum(lengths) - lengths
    small = np.int32 if len(data) < 1 << 31 else np.int64
    into = np.arange(int(lengths.sum()), dtype=small) - np.repeat(first.astype(small), lengths)
    value = data[letter].astype(np.uint64)
    value += np.uint64(1)
    value *= power[into]
    sums = np.add.reduceat(value, first)
    return mix(sums ^ (lengths.astype(np.uint64) << np.uint64(56))), counts, starts


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out = out * _JOIN + h[k : len(h) - width + 1 + k]
    return mix(out)


def _chunks(texts: list[str | None]) -> Iterator[list[bytes]]:
    """The texts as bytes, BATCH_BYTES at a time, encoded when they are needed."""
    chunk: list[bytes] = []
    size = 0
    for t in texts:
        raw = (t or "").encode()
        if chunk and size + len(raw) > BATCH_BYTES:
            yield chunk
            chunk, size = [], 0
        chunk.append(raw)
        size += len(raw)
    if chunk:
        yield chunk


def shingle_runs(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Shingle numbers of each text in the order of the text, repeats included.

    A text of fewer words than width has its whole sequence as its one shingle; a text
    without words has none.
    """
    for raw in _chunks(texts):
        h, counts = word_hashes(raw)
        rolled = _rolled(h, width) if len(h) >= width else h[:0]
        k = 0
        for n in counts.tolist():
            if n >= width:
                yield rolled[k : k + n - width + 1]
            elif n:
                yield mix(_rolled(h[k : k + n], n) + np.uint64(n))
            else:
                yield h[:0]
            k += n


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle numbers of each text."""
    for run in shingle_runs(texts, width):
        s = np.sort(run)
        yield s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s
