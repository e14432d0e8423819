"""Lexer and recursive-descent parser of the query language.

    or      := and (OR and)*
    and     := unary ([AND] unary)*
    unary   := (NOT | '-') unary | primary
    primary := '(' or ')' | [field ':'] word | [field ':'] '"' text '"'

A clause whose words are all stop words disappears; lists of one clause collapse.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from fathomdex.functions.analysis import analyze_words

FIELDS = ("title", "body")


class QueryError(ValueError):
    """The query text can't be parsed."""


@dataclass(frozen=True)
class Term:
    field: str  # "" for both
    term: str


@dataclass(frozen=True)
class Phrase:
    field: str
    terms: tuple[str, ...]


@dataclass(frozen=True)
class And:
    children: tuple


@dataclass(frozen=True)
class Or:
    children: tuple


@dataclass(frozen=True)
class Not:
    child: object


@dataclass(frozen=True)
class Token:
    kind: str  # end ( ) - and or not word quoted
    text: str = ""
    field: str | None = None


_SPACE = re.compile(r"[ \t\n\v\f\r]*")
_WORD = re.compile("[A-Za-z0-9]+")
_SAYS = {"end": "end of query", "or": "OR", "and": "AND", "not": "NOT", "(": "'('", ")": "')'", "-": "'-'"}


class _Lexer:
    """Gives tokens one at a time, so an error late in the text shows only when it is reached."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def next(self) -> Token:
        self.at = _SPACE.match(self.text, self.at).end()
        if self.at >= len(self.text):
            return Token("end")
        c = self.text[self.at]
        if c in "()-":
            self.at += 1
            return Token(c)
        if c == '"':
            return Token("quoted", self._quoted())
        if not (m := _WORD.match(self.text, self.at)):
            raise QueryError(f"unexpected character '{c}'")
        self.at = m.end()
        word = m.group()
        if self.text[self.at : self.at + 1] == ":":
            return self._fielded(word.lower())
        if word.lower() in ("and", "or", "not"):
            return Token(word.lower(), word)
        return Token("word", word)

    def _fielded(self, field: str) -> Token:
        self.at += 1
        if self.text[self.at : self.at + 1] == '"':
            return Token("quoted", self._quoted(), field)
        if not (m := _WORD.match(self.text, self.at)):
            raise QueryError(f"expected a term after '{field}:'")
        self.at = m.end()
        return Token("word", m.group(), field)

    def _quoted(self) -> str:
        out, i = [], self.at + 1
        while i < len(self.text):
            c = self.text[i]
            if c == '"':
                self.at = i + 1
                return "".join(out)
            if c == "\\" and i + 1 < len(self.text):
                i += 1
                c = self.text[i]
            out.append(c)
            i += 1
        raise QueryError("unterminated quote")


class _Parser:
    def __init__(self, text: str):
        self.lexer = _Lexer(text)
        self.tok = self.lexer.next()

    def advance(self) -> Token:
        tok, self.tok = self.tok, self.lexer.next()
        return tok

    def unexpected(self) -> QueryError:
        return QueryError(f"unexpected {_SAYS.get(self.tok.kind, f"'{self.tok.text}'")}")

    @staticmethod
    def join(kind, found: list):
        found = [x for x in found if x is not None]
        return kind(tuple(found)) if len(found) > 1 else found[0] if found else None

    def any_of(self):
        found = [self.all_of()]
        while self.tok.kind == "or":
            self.advance()
            found.append(self.all_of())
        return self.join(Or, found)

    def all_of(self):
        found = [self.unary()]
        while self.tok.kind in ("and", "not", "-", "(", "word", "quoted"):
            if self.tok.kind == "and":
                self.advance()
            found.append(self.unary())
        return self.join(And, found)

    def unary(self):
        if self.tok.kind in ("not", "-"):
            self.advance()
            child = self.unary()
            return None if child is None else Not(child)
        return self.primary()

    def primary(self):
        if self.tok.kind == "(":
            self.advance()
            inner = self.any_of()
            if self.tok.kind != ")":
                raise QueryError("expected ')'")
            self.advance()
            return inner
        if self.tok.kind not in ("word", "quoted"):
            raise self.unexpected()
        tok = self.tok
        if tok.field is not None and tok.field not in FIELDS:
            raise QueryError(f'unknown field "{tok.field}" (use title or body)')
        self.advance()
        terms = analyze_words(tok.text)
        if not terms:
            return None
        return Phrase(tok.field or "", tuple(terms)) if tok.kind == "quoted" else Term(tok.field or "", terms[0])


def parse(query: str):
    """The syntax tree of a query; QueryError if there is nothing to search for."""
    parser = _Parser(query)
    if parser.tok.kind == "end":
        raise QueryError("query has no searchable terms")
    node = parser.any_of()
    if parser.tok.kind != "end":
        raise parser.unexpected()
    if node is None:
        raise QueryError("query has no searchable terms")
    return node


def leaves(node) -> list[Term | Phrase]:
    """Distinct leaves in the order of first mention, those under NOT included."""
    if isinstance(node, Term | Phrase):
        return [node]
    children = (node.child,) if isinstance(node, Not) else node.children
    return list(dict.fromkeys(leaf for child in children for leaf in leaves(child)))


def fields_of(leaf: Term | Phrase) -> tuple[str, ...]:
    return (leaf.field,) if leaf.field else FIELDS


def query_terms(node) -> list[tuple[str, str]]:
    """Distinct (field, term) pairs, sorted."""
    return sorted(
        {
            (field, term)
            for leaf in leaves(node)
            for field in fields_of(leaf)
            for term in (leaf.terms if isinstance(leaf, Phrase) else (leaf.term,))
        }
    )
