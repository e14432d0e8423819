"""Compiles a syntax tree into a match column and a score column.

Negation depends on the tree's shape only, so it is settled here: AND subtracts its
negated children and is empty without a positive one, OR ignores negated children, and a
negated root finds nothing. Scores of unmatched children never count.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomdex.plans.query_lang import And, Not, Phrase, Term, fields_of

#: Fixed values of the ranking formula.
K1, B = 1.2, 0.75
FIELD_BOOST = {"title": 2.0, "body": 1.0}
PHRASE_BOOST = 1.25
#: Fixed width of term counts and positions in an index.
MAX_COUNT = 65535


@dataclass
class Similarity:
    """Corpus figures over live documents: one row, and one count per query term."""

    documents: int
    average: dict[str, float]
    df: dict[tuple[str, str], int] = field(default_factory=dict)


def bm25(tf: Column, length: Column, sim: Similarity, fld: str, term: str) -> Column:
    """0 where the term is absent. tf and length are columns, the corpus figures constants."""
    df, n = sim.df.get((fld, term), 0), sim.documents
    if not n or not df:
        return F.lit(0.0)
    average = sim.average[fld] if sim.average[fld] > 0 else 1.0
    idf = math.log(1.0 + (n - df + 0.5) / (df + 0.5))
    tf = tf.cast("double")
    norm = tf + K1 * (1.0 - B + B * length / F.lit(float(average)))
    return F.when(tf > 0, F.lit(idf) * tf * (K1 + 1.0) / norm).otherwise(0.0)


@dataclass
class FieldColumns:
    """What a physical mode offers: term counts, field lengths and adjacency, as columns."""

    tf: Callable[[str, str], Column]
    length: Callable[[str], Column]
    adjacent: Callable[[str, tuple[str, ...]], Column]


def _leaf(leaf: Term | Phrase, cols: FieldColumns, sim: Similarity) -> tuple[Column, Column]:
    match, score = F.lit(False), F.lit(0.0)
    for fld in fields_of(leaf):
        terms = leaf.terms if isinstance(leaf, Phrase) else (leaf.term,)
        found = cols.tf(fld, terms[0]) > 0 if len(terms) == 1 else cols.adjacent(fld, terms)
        total = F.lit(0.0)
        for term in terms:
            total = total + bm25(cols.tf(fld, term), cols.length(fld), sim, fld, term)
        boost = FIELD_BOOST[fld] * (PHRASE_BOOST if isinstance(leaf, Phrase) else 1.0)
        match = match | found
        score = score + F.when(found, total * boost).otherwise(0.0)
    return match, score


def _compile(node, cols: FieldColumns, sim: Similarity) -> tuple[Column, Column, bool]:
    if isinstance(node, Term | Phrase):
        return *_leaf(node, cols, sim), False
    if isinstance(node, Not):
        match, score, negated = _compile(node.child, cols, sim)
        return match, score, not negated
    children = [_compile(c, cols, sim) for c in node.children]
    positive = [c for c in children if not c[2]]
    if not positive:
        return F.lit(False), F.lit(0.0), False
    if isinstance(node, And):
        match, score = F.lit(True), F.lit(0.0)
        for m, s, negated in children:
            match = match & (~m if negated else m)
            score = score if negated else score + s
        return match, score, False
    match, score = F.lit(False), F.lit(0.0)
    for m, s, _ in positive:
        match, score = match | m, score + F.when(m, s).otherwise(0.0)
    return match, score, False


def compile_query(node, cols: FieldColumns, sim: Similarity) -> tuple[Column, Column]:
    match, score, negated = _compile(node, cols, sim)
    return (F.lit(False) if negated else match), score
