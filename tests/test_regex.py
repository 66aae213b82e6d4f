"""The dialect's answers, pattern by pattern."""

import pytest

from leafmill.functions.regex import translated

TABLE = [
    # classes
    ("^[[:alpha:]]$", "x", True), ("^[[:alpha:]]$", ":", False), ("^[[:alpha:]]$", "é", False), ("^[[:^alpha:]]$", "x", False), ("^[[:^alpha:]]$", "7", True), ("^[^[:space:]]+$", "ab", True),
    ("^[^[:space:]]+$", "a b", False), ("^[[:punct:]]$", "~", True), ("^[[:xdigit:][:blank:]]+$", "0f \t", True), ("^[[:word:]]+$", "a_9", True), ("^[a-z--b]$", "b", False), ("^[a-z--b]$", "c", True),
    ("^[a-z--[aeiou]]+$", "xyz", True), ("^[a-z--[aeiou]]+$", "xaz", False), ("^[a-c~~b-d]$", "a", True), ("^[a-c~~b-d]$", "b", False), ("^[a-c~~b-d]$", "d", True), ("^[a-z&&[^aeiou]]$", "e", False),
    ("^[a-z&&b-y&&[^c]]$", "c", False), ("^[a-z&&b-y&&[^c]]$", "d", True), ("^[^a-z--b]$", "b", True), ("^[^a-z--b]$", "c", False), ("^[^a-z&&[^b]]$", "b", True), ("^[]a]$", "]", True), ("^[^]a]$", "b", True),
    ("^[a-]$", "-", True), ("^[-a]$", "-", True), ("^[$^.]$", "$", True), ("^[a^]$", "^", True), ("^[\\]\\-]$", "-", True), ("^[a&b]$", "&", True), ("^[\\d\\s]+$", "1 2", True), ("^[^\\d]$", "1", False),
    ("^\\p{Greek}+$", "αβγ", True), ("^\\p{Greek}+$", "abc", False), ("^\\p{Script=Cyrillic}$", "ж", True), ("^\\p{sc:Latin}$", "é", True), ("^\\P{Greek}$", "α", False), ("^\\p{^Greek}$", "a", True),
    ("^\\pL\\pN$", "é7", True), ("^\\p{Lu}$", "É", True), ("^\\p{Uppercase_Letter}$", "e", False), ("^\\p{gc=Letter}$", "漢", True), ("^\\p{Alphabetic}$", "ß", True), ("^\\p{any}$", "x", True), ("^\\p{ascii}$", "é", False),
    ("^[\\p{Greek}&&\\p{Lu}]$", "Α", True), ("^[\\p{Greek}&&\\p{Lu}]$", "α", False), ("^[\\p{L}--\\p{Lu}]$", "a", True), ("^\\w+$", "Straße_7", True), ("^\\d$", "٣", True), ("^\\s$", " ", True), ("^\\W$", "é", False),
    # dots and ends
    ("^a.b$", "a\rb", True), ("^a.b$", "a\u0085b", True), ("^a.b$", "a b", True), ("^a.b$", "a\nb", False), ("(?s)^a.b$", "a\nb", True), ("^a$", "a\n", False), ("a\\z", "a\n", False), ("^b", "a\nb", False), ("^a$", "a\r", False),
    ("(?m)^a$", "a\nb", True), ("(?m)^b$", "a\nb", True), ("(?m)^$", "a\n", True), ("(?m)^b$", "a\rb", False), ("(?m:^b)$", "a\nb", True), ("(?m:^a)$", "a\nb", False), ("(?m)\\Ab", "a\nb", False), ("(?s-m)^a.b$", "a\nb", True),
    # boundaries
    ("\\bfür\\b", "so für dich", True), ("\\bfü\\b", "für", False), ("\\b{start}dich\\b{end}", "für dich", True), ("\\<dich\\>", "für dich!", True), ("\\<ich", "dich", False), ("\\b{start-half}ich", "dich", False), ("di\\b{end-half}", "dich", False), ("a\\Bb", "ab", True),
    # flags and groups
    ("(?i)ÉTÉ", "été", True), ("(?i:a)B", "AB", True), ("(?i:a)B", "Ab", False), ("(?i)a(?-i)B", "AB", True), ("(?i)a(?-i)B", "Ab", False), ("a(?i)b|c", "C", True), ("(?U)a+?", "aa", True), ("(?x) a  b # end\n c", "abc", True),
    ("(?x)[ a b ]", " ", False), ("(?x)a\\ b", "a b", True), ("(?P<x>a)(?P<y_1>b)", "ab", True), ("(?<x>a)", "a", True), ("(a|b)+c", "abac", True), ("(?:)", "", True), ("a||b", "zzz", True), ("(|a)b", "b", True),
    # repetition
    ("^a{2}$", "aa", True), ("^a{2,}$", "aaa", True), ("^a{1,2}$", "aaa", False), ("^a++$", "aaa", True), ("^a*+$", "aaa", True), ("^a++a$", "aaa", True), ("^a?+a$", "a", True), ("^(ab)*?$", "abab", True), ("^a{2}{3}$", "aaaaaa", True), ("^a{2}{3}$", "aaaaa", False), ("^é+$", "éé", True),
    # escapes and plain characters
    ("\\x41\\x{e9}\\u00e9\\u{1F600}\\U0001F600", "Aéé😀😀", True), ("^\\v$", "\x0b", True), ("^\\v$", "\n", False), ("^\\a\\f\\t$", "\x07\x0c\t", True), ("\\.\\*\\-\\#\\ \\/", ".*-# /", True), ("}]", "}]", True), ("a-b#c&d~", "a-b#c&d~", True), ("^😀.$", "😀😀", True),
]


def test_answers(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1).select(*(F.rlike(F.lit(text), F.lit(translated(pattern))).alias(f"a{i}") for i, (pattern, text, _) in enumerate(TABLE)))
    wrong = [(p, t, w) for (p, t, w), got in zip(TABLE, rows.first()) if got != w]
    assert not wrong


def test_ignoring_case(spark):
    from pyspark.sql import functions as F

    assert tuple(spark.range(1).select(*(F.rlike(F.lit(t), F.lit(translated(p, True))) for p, t in (("straße", "STRAßE"), ("[é-ê]", "É"), ("(?-i)a", "A")))).first()) == (True, True, False)


REFUSED = ["(?=a)", "(?!a)", "(?<=a)", "(?<!a)", "(?>a)", "(a)\\1", "\\k<x>", "(?P=x)", "(", ")", "a)", "[a", "[]", "[z-a]", "[a-\\d]", "*a", "a|*", "{2}", "a{2", "a{3,2}", "a{x}", "\\q", "\\Qa\\E", "\\", "\\x{zz}", "\\x{110000}", "\\u{d800}", "(?-u)a", "(?R)a", "(?q)a", "(?)", "(?P<1>a)", "(?P<x>a)(?P<x>b)", "\\p{Block=Greek}", "\\b{middle}", "[a&&]", "(?i-)a"]


@pytest.mark.parametrize("pattern", REFUSED)
def test_refused(pattern):
    with pytest.raises(ValueError):
        translated(pattern)


def test_unknown_scripts_are_refused_at_once(spark):
    with pytest.raises(ValueError):
        translated("\\p{Klingonese}")
