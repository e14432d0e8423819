"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled with training texts. A text's
letters, lower-cased, are cut into pieces, each piece is compressed with every dictionary,
and the language of the smallest total is chosen; the pieces keep a long text from becoming
its own dictionary. The whole text is read.

Bounds of the model: DICTIONARY bytes for each language, filled from at most SAMPLE training
rows of a language, taken by the least hash of the id; with very many languages each has
fewer, so that MOST_SAMPLED rows are taken in all, but at least one. Every language of the
training rows is learned. Everything is deterministic.

Defined results: null text, and text without a letter, give `und`, score 0 and rejected.
Ties go to the name that is first by code point. Without training rows every row is `und`.
A margin under MARGIN of the smallest size, or of a single byte, is narrow: the prediction
stands but `rejected` is set. Repeated rows give repeated rows; an empty table gives none.
Other columns pass through, whatever their names; the added names replace columns that are
called the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomdex.llm.common import doc_crc, in_batches, lookup, materialize

DICTIONARY = 112 * 1024
#: Rows sampled for all languages together, one of each at least.
MOST_SAMPLED = 100_000
SAMPLE = 400
TAKEN = 2000
PIECE = 4000
LEVEL = 7
MARGIN = 0.005
FOLDS, HELD_OUT = 5, 0

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> str:
    """Words of letters (with their marks); nothing if there is no letter."""
    bare = _OTHER.sub(" ", text.lower()).strip()
    return bare if _LETTER.search(bare) else ""


def held_out(id_col: str = "doc_id"):
    return F.pmod(doc_crc(id_col), F.lit(FOLDS)) == HELD_OUT


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionaries from labelled rows (null labels and texts don't count)."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    languages, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sample = max(1, min(SAMPLE, MOST_SAMPLED // max(1, languages)))
    order = F.xxhash64(F.lit("language"), "id")
    chance = (F.shiftrightunsigned(order, 11).cast("double") / float(1 << 53)) * F.col("n")
    # Over three times the rows that are wanted, by a threshold on the hash, so that no window sees more.
    some = lookup(rows, counts, "lang", "n", total).filter(chance < 3.0 * sample + 20.0)
    first = Window.partitionBy("lang").orderBy(order, "id", "text")
    half = F.greatest((F.length("text") - TAKEN) / 2, F.lit(0)).cast("int") + 1
    some = some.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= sample)
    some = some.select("lang", "k", F.substring(F.col("text"), half, F.lit(TAKEN)).alias("text"))
    parts: dict[str, list[str]] = {}
    for r in some.orderBy("lang", "k").toLocalIterator():  # at most sample * TAKEN characters a language
        parts.setdefault(r["lang"], []).append(letters(r["text"]))
    # The end of a dictionary is the cheapest to refer to; the first rows by hash go there.
    texts = {lang: " ".join(reversed(x)).encode() for lang, x in parts.items()}
    return {lang: t[-DICTIONARY:] for lang, t in sorted(texts.items(), key=lambda x: x[0].encode()) if t.strip()}


@lru_cache(maxsize=4)
def _compressors(model: tuple[tuple[str, bytes], ...]) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, content in model:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def sizes(model: tuple[tuple[str, bytes], ...], text: str) -> np.ndarray:
    """Compressed bytes of a text (letters only) under each dictionary."""
    data = text.encode()
    pieces = [data[k : k + PIECE] for k in range(0, len(data), PIECE)]
    return np.array([sum(len(c.compress(p)) for p in pieces) for c in _compressors(model)], dtype=np.int64)


def predict_one(model: tuple[tuple[str, bytes], ...], text: str | None) -> tuple[str, float, bool]:
    """Language, score (0 to 1) and whether the margin is too narrow."""
    bare = letters(text) if text else ""
    if not bare or not model:
        return "und", 0.0, True
    got = sizes(model, bare)
    best = int(np.argmin(got))
    score = float(1.0 / np.exp2(-(got - got[best]).astype(float)).sum())
    if len(got) == 1:
        return model[best][0], score, False
    margin = int(np.partition(got, 1)[1] - got[best])
    return model[best][0], score, margin < max(1.0, MARGIN * float(got[best]))


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", "rejected")
    model = tuple(dictionaries.items())
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [predict_one(model, t) for t in batch.iloc[:, at]]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield batch.assign(lang_pred=list(lang), score=np.array(score, dtype=float), rejected=np.array(rejected, dtype=bool))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return in_batches(docs, run, f"{kinds}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that aren't held out, then classifies all rows."""
    model = train(docs.filter(~held_out(id_col)), id_col, text_col, lang_col)
    return classify(docs, model, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    out = classify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
