"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. In each round every adjacent pair
is looked up by binary search among the sorted pair keys, each word's pair of lowest rank is
merged, and words without a pair leave. Text is normalised and split as the tokenizer file
says (NFC, white space runs to one space, lower case; letters, single digits, other runs),
its added tokens taken out of the raw text first.

Decoding joins the tokens of the ids by spaces, as the library does where the file names no
decoder. Defined results: null text is empty and gives no ids and empty text; texts of any
length are read whole, in memory of a few times one text; repeated rows give repeated rows;
an empty table gives none. Only the id and text columns are read, so other columns may have
any names. Characters that this module's Unicode tables split unlike the library's are found
by comparing each new character once; a text with such a character is split (not encoded) by
the library.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomdex.llm.common import in_batches

#: Fixed values of the tokenizer file: how it splits words, and its word end.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Words kept between batches, and characters of text whose words are merged together.
CACHE_WORDS = 400_000
BATCH_CHARS = 4_000_000
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Bpe:
    """Tables of one tokenizer file, and a bounded store of words met so far."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(*vocab.values(), *self.added.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, i in (*vocab.items(), *self.added.items()):
            self.tokens[i] = token.encode()
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + WORD_END] for c in letters], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        product = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.product = key[order], order.astype(np.int64), product[order]
        # A merge may be done at all its places at once if its product takes part in no earlier merge.
        first = np.full(size, _NONE, dtype=np.int64)
        np.minimum.at(first, key >> 32, np.arange(len(key)))
        np.minimum.at(first, key & 0xFFFFFFFF, np.arange(len(key)))
        self.safe = first[product] > np.arange(len(key))
        self.pattern = regex.compile(PATTERN)
        self.near = near_pattern()
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.ids: dict[str, bytes] = {}
        self._known: dict[str, bool] = {}
        self._library = None

    # splitting

    def _alike(self, c: str) -> bool:
        """Whether this character is treated alike here and by the library, whose Unicode tables are older."""
        if c not in self._known:
            probe = f"a{c}1{c}a.{c}."
            letters = byte_letters()
            ours = ["".join(letters[b] for b in w.encode()) for w in self.pattern.findall(self._normal(probe))]
            self._known[c] = ours == self._split_by_library(probe, raw=True)
        return self._known[c]

    def _split_by_library(self, text: str, raw: bool = False) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        normal = self._library.normalizer.normalize_str(text)
        found = self._library.pre_tokenizer.pre_tokenize_str(normal)
        if raw:
            return [x for x, _ in found]
        back = {c: b for b, c in enumerate(byte_letters())}
        return [bytes(back[c] for c in x).decode("utf-8", "surrogateescape") for x, _ in found]

    @staticmethod
    def _normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # one character at a time in effect: a final sigma is lowered like any other
        return text.replace("Σ", "σ").lower()

    def words(self, text: str) -> list[str]:
        if text.isascii() or not _FAR.search(text):
            return self.near(self._normal(text))
        if all(map(self._alike, set(text))):
            return self.pattern.findall(self._normal(text))
        return self._split_by_library(text)

    # merging

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and where each word's end in it."""
        raw = [w.encode("utf-8", "surrogateescape") for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(lengths)
        sym = self.inner[flat]
        sym[ends - 1] = self.final[flat[ends - 1]]
        word = np.repeat(np.arange(len(raw)), lengths)
        rank, product = np.full(len(sym), _NONE), np.zeros(len(sym), dtype=np.int64)
        self._look_up(np.arange(len(sym)), sym, word, rank, product)
        done_sym, done_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            each = np.repeat(best, np.diff(np.r_[starts, len(sym)]))
            over = each == _NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, rank, product, each = sym[keep], word[keep], rank[keep], product[keep], each[keep]
                if not len(sym):
                    break
            here = np.flatnonzero(rank == each)
            here = here[self._apart(here, word[here], self.safe[rank[here]])]
            sym[here] = product[here]
            keep = np.ones(len(sym), dtype=bool)
            keep[here + 1] = False
            here -= np.arange(len(here))  # one symbol goes behind each place before it
            sym, word, rank, product = sym[keep], word[keep], rank[keep], product[keep]
            changed = np.zeros(len(sym), dtype=bool)
            changed[here] = True
            changed[np.maximum(here - 1, 0)] = True
            self._look_up(np.flatnonzero(changed), sym, word, rank, product)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.cumsum(np.bincount(word, minlength=len(raw)))

    def _look_up(self, at: np.ndarray, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, product: np.ndarray) -> None:
        """Sets rank and product of the pairs that begin at these places."""
        rank[at] = _NONE
        at = at[at < len(sym) - 1]
        at = at[word[at] == word[at + 1]]
        key = sym[at] << 32 | sym[at + 1]
        found = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[found] == key
        at, found = at[hit], found[hit]
        rank[at], product[at] = self.rank[found], self.product[found]

    @staticmethod
    def _apart(here: np.ndarray, word: np.ndarray, safe: np.ndarray) -> np.ndarray:
        """Which places to merge: every other one of a run, only a word's first where not safe."""
        new_run = np.r_[True, (here[1:] != here[:-1] + 1) | (word[1:] != word[:-1])]
        run = np.flatnonzero(new_run)
        into = np.arange(len(here)) - np.repeat(run, np.diff(np.r_[run, len(here)]))
        first = np.r_[True, word[1:] != word[:-1]]
        return (into % 2 == 0) & (safe | first)

    # texts

    def encode_batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        texts = [t or "" for t in texts]
        at = 0
        while at < len(texts):
            split, chars, end = [], 0, at
            while end < len(texts) and (chars == 0 or chars + len(texts[end]) <= BATCH_CHARS):
                split.append(self._parts(texts[end]))
                chars += len(texts[end]) + 1
                end += 1
            self._learn(set(chain.from_iterable(words for parts in split for words, _ in parts)))
            known = self.ids.__getitem__
            for parts in split:
                yield b"".join(b"".join(map(known, words)) + tail for words, tail in parts)
            at = end

    def _parts(self, text: str) -> list[tuple[list[str], bytes]]:
        """Words up to each added token, and that token's id."""
        parts, at = [], 0
        for m in self.special.finditer(text) if "<|" in text else ():
            parts.append((self.words(text[at : m.start()]), np.uint32(self.added[m.group()]).tobytes()))
            at = m.end()
        return [*parts, (self.words(text[at:]), b"")]

    def _learn(self, all_words: set[str]) -> None:
        if len(self.ids) + len(all_words) > CACHE_WORDS:
            self.ids = {w: self.ids[w] for w in all_words & self.ids.keys()}
        if new := list(all_words - self.ids.keys()):
            ids, ends = self.merge(new)
            data, at = ids.astype("<u4").tobytes(), 0
            for w, end in zip(new, (4 * ends).tolist(), strict=True):
                self.ids[w] = data[at:end]
                at = end

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8."""
        tokens = self.tokens
        return b" ".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


#: Below this every table agrees on letters, digits and white space.
NEAR = 0x530
_FAR = re.compile(f"[^\x00-{chr(NEAR - 1)}]")


def near_pattern():
    """PATTERN's findall for text below NEAR, with the classes written out: much faster."""

    def members(kind: str) -> str:
        return "".join(re.escape(c) for c in regex.findall(kind, "".join(map(chr, range(NEAR + 0x1000)))))

    letters, digits, spaces = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+").findall


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, if with_ids), ids_sha256 and decoded_sha256 of every row.

    path is the tokenizer file, on every executor; by default the public one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path or tokenizer_path())
        for batch in batches:
            ids = list(bpe.encode_batch(batch["text"]))
            out = {"doc_id": batch["doc_id"], "n_tokens": [len(x) // 4 for x in ids]}
            if with_ids:
                out["ids"] = ids
            out["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in ids]
            out["decoded_sha256"] = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
            yield pd.DataFrame(out)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long,{' ids binary,' if with_ids else ''} ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return in_batches(rows, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, with_ids=False)
