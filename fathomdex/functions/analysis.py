"""The analyzer as a column: split, lower, drop stop words, stem.

Positions are indices into the filtered list, so stop words leave no gap. Only ASCII
letters and digits form tokens; the split comes before lowering, since lowering first
could turn a non-ASCII character into an ASCII letter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: The words that are not indexed.
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "of", "and", "or", "not",
    "to", "in", "on", "for", "with", "at", "by", "from", "as", "it", "that", "this",
)

#: Endings before "es" that make it a plural of its own syllable.
SIBILANT_ES = ("ches", "shes", "ses", "xes", "zes")

#: A stage of the analyzer: array of tokens in, array of tokens out.
TokenFilter = Callable[[Column], Column]


def tokenize(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order; null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+")
    return F.transform(F.filter(parts, lambda t: t != ""), F.lower)


def drop_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*STOPWORDS))


def stem_column(word: Column) -> Column:
    n = F.length(word)

    def cut(k: int) -> Column:
        return F.substring(word, F.lit(1), n - k)

    sibilant = F.lit(False)
    for ending in SIBILANT_ES:
        sibilant = sibilant | F.endswith(word, F.lit(ending))
    return (
        F.when((n > 5) & F.endswith(word, F.lit("ing")), cut(3))
        .when((n > 4) & F.endswith(word, F.lit("ed")), cut(2))
        .when((n > 4) & sibilant, cut(2))
        .when((n > 3) & F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss")), cut(1))
        .otherwise(word)
    )


def stem_tokens(tokens: Column) -> Column:
    return F.transform(tokens, stem_column)


class Analyzer:
    """Tokenizer plus a list of filters; the default list is stop words, then stemming."""

    def __init__(self, filters: Sequence[TokenFilter] = (drop_stopwords, stem_tokens)):
        self.filters = tuple(filters)

    def __call__(self, text: Column) -> Column:
        tokens = tokenize(text)
        for stage in self.filters:
            tokens = stage(tokens)
        return tokens


def analyze(text: Column) -> Column:
    """What Analyzer() gives, for whole Arrow batches at once (see batch.py): functions over an
    array of words aren't compiled, and patterns over the text take over twenty times as long."""
    from fathomdex.functions import batch

    return F.arrow_udf(batch.token_lists, ArrayType(StringType()))(text)


def count_words(text: Column) -> Column:
    """How many tokens analyze gives."""
    from fathomdex.functions import batch

    return F.arrow_udf(batch.token_counts, IntegerType())(text)


def stem_word(word: str) -> str:
    """The same stemmer for query words, on the driver."""
    n = len(word)
    if n > 5 and word.endswith("ing"):
        return word[:-3]
    if n > 4 and word.endswith("ed"):
        return word[:-2]
    if n > 4 and word.endswith(SIBILANT_ES):
        return word[:-2]
    if n > 3 and word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def analyze_words(text: str) -> list[str]:
    """Stems of a query string, as the column analyzer gives them."""
    words = (w.lower() for w in re.findall("[A-Za-z0-9]+", text))
    return [stem_word(w) for w in words if w not in STOPWORDS]


def words_of_stem(stem: str) -> list[str]:
    """Every word that is analysed as stem: itself or with an ending that is cut."""
    words = (stem + ending for ending in ("", "ing", "ed", "es", "s"))
    return [w for w in words if w not in STOPWORDS and stem_word(w) == stem]
