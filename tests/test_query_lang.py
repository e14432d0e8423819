import pytest

from fathomdex.plans.query_lang import And, Not, Or, Phrase, QueryError, Term, parse, query_terms


@pytest.mark.parametrize(
    ("query", "tree"),
    [
        ("fox", Term("", "fox")),
        ("Foxes", Term("", "fox")),
        ("title:Fox", Term("title", "fox")),
        ("TITLE:fox", Term("title", "fox")),
        ('"quick brown"', Phrase("", ("quick", "brown"))),
        ('"fox"', Phrase("", ("fox",))),
        ('body:"quick the brown"', Phrase("body", ("quick", "brown"))),
        ("well-known", And((Term("", "well"), Not(Term("", "known"))))),
        ("--fox", Not(Not(Term("", "fox")))),
        ("fox the", Term("", "fox")),
        ("fox -the", Term("", "fox")),
        ("the OR fox", Term("", "fox")),
        ("a1 or b2 c3", Or((Term("", "a1"), And((Term("", "b2"), Term("", "c3")))))),
        ("(x1 OR y1) and z1", And((Or((Term("", "x1"), Term("", "y1"))), Term("", "z1")))),
        ('fox"brown"', And((Term("", "fox"), Phrase("", ("brown",))))),
        ('"say \\"hi\\""', Phrase("", ("say", "hi"))),
    ],
)
def test_tree(query, tree):
    assert parse(query) == tree


@pytest.mark.parametrize(
    ("query", "message"),
    [
        ("", "query has no searchable terms"),
        ("  \t", "query has no searchable terms"),
        ("the", "query has no searchable terms"),
        ("title:or", "query has no searchable terms"),
        ("OR fox", "unexpected OR"),
        ("fox OR", "unexpected end of query"),
        ("fox AND", "unexpected end of query"),
        ("fox AND AND dog", "unexpected AND"),
        ("()", "unexpected ')'"),
        ("(fox", "expected ')'"),
        ("fox)", "unexpected ')'"),
        ("fox,dog", "unexpected character ','"),
        ("it's", "unexpected character '''"),
        ("a_b", "unexpected character '_'"),
        ("OR:fox", 'unknown field "or" (use title or body)'),
        ("title:fox:x", "unexpected character ':'"),
        ("title: fox", "expected a term after 'title:'"),
        ('"fox', "unterminated quote"),
        ("café", "unexpected character 'é'"),
    ],
)
def test_error(query, message):
    with pytest.raises(QueryError) as e:
        parse(query)
    assert str(e.value) == message


def test_terms():
    assert query_terms(parse("title:fox -dog dog")) == [("body", "dog"), ("title", "dog"), ("title", "fox")]
