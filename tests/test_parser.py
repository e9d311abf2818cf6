import pytest

from quern.plans.parser import Clause, Filter, Page, lex, parse, parse_int


def word(w, negative=False):
    return Clause((w,), False, negative)


def phrase(text, negative=False):
    return Clause(tuple(text.split()), True, negative)


@pytest.mark.parametrize(
    "query, clauses, filters",
    [
        ("quick fox", [word("quick"), word("fox")], []),
        ("+fox -lazy", [word("fox"), word("lazy", True)], []),
        ('"quick brown"', [phrase("quick brown")], []),
        ('-"quick brown"', [phrase("quick brown")], []),
        ('"-quick brown"', [phrase("quick brown", True)], []),
        ('+"quick brown"', [phrase("quick brown")], []),
        ('"fox"', [word("fox")], []),
        ('"tags:new york"', [], [Filter("tags", "=", "new york")]),
        ('tags:"new york"', [word("tags:"), phrase("new york")], []),
        ("-tags:go", [], [Filter("tags", "=", "go")]),
        ("views>=10", [], [Filter("views", ">=", 10.0)]),
        ("views>10", [], [Filter("views", ">", 10.0)]),
        ("views>", [word("views>")], []),
        ("views>=", [], [Filter("views", ">", 0.0)]),
        ("views>abc", [], [Filter("views", ">", 0.0)]),
        ("a:b>c", [], [Filter("a:b", ">", 0.0)]),
        (">5", [word(">5")], []),
        ("rating:4-5", [], [Filter("rating", "range", None, 4.0, 5.0)]),
        ("x:5-", [], [Filter("x", "range", None, 5.0, None)]),
        ("x:-5", [], [Filter("x", "range", None, None, 5.0)]),
        ("d:2024-01-01", [], [Filter("d", "range", None, 2024.0, None)]),
        ("x:1e-5", [], [Filter("x", "range", None, None, 5.0)]),
        ("lang:en-US", [], [Filter("lang", "=", "en-US")]),
        ("12:30", [], [Filter("12", "=", 30.0)]),
        ("https://a", [], [Filter("https", "=", "//a")]),
        ("a OR b", [word("a"), word("or"), word("b")], []),
        ("--x", [word("-x", True)], []),
        ("+-x", [word("-x")], []),
        ("- + \"\" \" \"", [], []),
        ('"open phrase', [phrase("open phrase")], []),
        ("Fox,  FULL-text", [word("fox,"), word("full-text")], []),
        ("x:1e999", [], [Filter("x", "=", "1e999")]),
        ("x:0x1p3", [], [Filter("x", "=", 8.0)]),
        ("x:1_000", [], [Filter("x", "=", "1_000")]),
    ],
)
def test_golden(query, clauses, filters):
    parsed = parse(query)
    assert list(parsed.clauses) == clauses
    assert list(parsed.filters) == filters


def test_filters_are_lexed_like_the_query():
    parsed = parse("fox", "views>1 dog")
    assert [c.words for c in parsed.clauses] == [("fox",), ("dog",)]
    assert parsed.filters == (Filter("views", ">", 1.0),)


def test_lexer_ends_tokens_at_quotes():
    assert lex('a"b c"d') == ["a", "b c", "d"]


def test_scoring_words_once_each():
    assert parse('fox "quick fox" -dog').scoring == ("fox", "quick")


def test_pages():
    assert (Page(0, 0).number, Page(0, 0).size) == (1, 10)
    assert (Page(3, 1000).size, Page(3, 20).offset) == (100, 40)
    assert parse_int(" ", 7) == 7 and parse_int("12", 1) == 12
    with pytest.raises(ValueError):
        parse_int("1.5", 1)
