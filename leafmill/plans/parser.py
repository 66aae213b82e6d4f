"""One recursive-descent parser for queries, paths and matchers.

A parser object holds the text and a position.  ``attempt`` runs a rule and steps back if it fails, remembering how far any
rule came, which is the position that an error reports.  Beyond the languages' own grammar, parentheses nest freely in
records and subfields, and symbol operators need no white space around them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from leafmill.errors import ParseError
from leafmill.functions.regex import translated
from leafmill.plans.ast import (
    CODES, DIGITS, INDICATORS, LOWER, And, Constituent, ControlColumn, ControlTest, DataColumns, DataTest, FieldCount, FieldExists,
    Indicators, LeaderColumn, LeaderTest, Literal, Matcher, Not, Or, Range, SubfieldCount, SubfieldExists, SubfieldMatcher, SubfieldTest, Tag,
)

T = TypeVar("T")
# Fixed values of the languages: white space, names of leader parts, operators and escapes.
SPACE = " \t\r\n"
NUMBERS = ("length", "base_addr")
LETTERS = ("status", "type", "encoding")
COMPARISONS = ("==", "!=", ">=", "<=", ">", "<")
#: Operators on lists of strings, and whether they deny.
LISTED = {"=?": ("=?", False), "!?": ("=?", True), "=^": ("=^", False), "!^": ("=^", True), "=$": ("=$", False), "!$": ("=$", True), "=~": ("=~", False), "!~": ("=~", True), "=*": ("=*", False), "!*": ("=*", True)}
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "\\": "\\", "/": "/", "'": "'", '"': '"'}
DEEPEST = 256
MOST = 4294967295


class _Fail(Exception):
    pass


class Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.far, self.depth = text, 0, 0, 0

    # -- pieces ------------------------------------------------------------------

    def fail(self) -> _Fail:
        self.far = max(self.far, self.at)
        return _Fail()

    def attempt(self, rule: Callable[[], T]) -> T | None:
        start = self.at
        try:
            return rule()
        except _Fail:
            self.at = start
            return None

    def first(self, *rules: Callable[[], T]) -> T:
        start = self.at
        for rule in rules:
            try:
                return rule()
            except _Fail:
                self.at = start
        raise self.fail()

    def space(self, least: int = 0) -> None:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] in SPACE:
            self.at += 1
        if self.at - start < least:
            raise self.fail()

    def one(self, among: str) -> str:
        if self.at < len(self.text) and self.text[self.at] in among:
            self.at += 1
            return self.text[self.at - 1]
        raise self.fail()

    def word(self, *words: str) -> str:
        for word in words:
            if self.text.startswith(word, self.at):
                self.at += len(word)
                return word
        raise self.fail()

    def took(self, *words: str) -> bool:
        return self.attempt(lambda: self.word(*words)) is not None

    def whole(self, rule: Callable[[], T], what: str) -> T:
        """``rule`` over the whole text."""
        try:
            self.space()
            found = rule()
            self.space()
            if self.at < len(self.text):
                raise self.fail()
        except _Fail:
            raise ParseError(f"invalid {what}", self.far, self.text) from None
        return found

    def number(self) -> int:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] in DIGITS:
            self.at += 1
        if self.at == start or int(self.text[start : self.at]) > MOST:
            raise self.fail()
        return int(self.text[start : self.at])

    def string(self) -> str:
        quote, out = self.one("'\""), []
        while True:
            if self.at >= len(self.text):
                raise self.fail()
            c = self.text[self.at]
            self.at += 1
            if c == quote:
                return "".join(out)
            if c != "\\":
                out.append(c)
                continue
            if self.at < len(self.text) and self.text[self.at] in SPACE:
                self.space()
                continue
            mark = self.one("".join(ESCAPES))
            if mark in "'\"" and mark != quote:
                raise self.fail()
            out.append(ESCAPES[mark])

    def strings(self) -> tuple[str, ...]:
        """One string, or several in brackets."""
        if not self.took("["):
            return (self.string(),)
        return self.bracketed()

    def bracketed(self) -> tuple[str, ...]:
        out = []
        while True:
            self.space()
            out.append(self.string())
            self.space()
            comma = self.took(",")
            self.space()
            if self.took("]"):
                return tuple(out)
            if not comma:
                raise self.fail()

    def members(self, single: str, ranges: tuple[str, ...]) -> str:
        """What stands between brackets: characters of ``single`` and ranges within one of ``ranges``."""
        out = set()
        while not self.took("]"):
            c = self.one(single)
            kind = next((r for r in ranges if c in r), "")
            if kind and self.text.startswith("-", self.at):
                self.at += 1
                end = self.one(kind)
                if end <= c:
                    raise self.fail()
                out.update(kind[kind.index(c) : kind.index(end) + 1])
            else:
                out.add(" " if c == "#" else c)
        if not out:
            raise self.fail()
        return "".join(sorted(out))

    def codes(self) -> str:
        if self.took("*"):
            return CODES
        if self.took("["):
            return self.members(CODES, (DIGITS, LOWER, LOWER.upper()))
        return self.one(CODES)

    def tag(self) -> Tag:
        start = self.at

        def place() -> str:
            if self.took("."):
                return DIGITS
            if self.took("["):
                deny = self.took("^")
                found = self.members(DIGITS, (DIGITS,))
                return "".join(d for d in DIGITS if d not in found) if deny else found
            return self.one(DIGITS)

        return Tag((place(), place(), place()), self.text[start : self.at])

    def indicators(self) -> Indicators:
        if not self.took("/"):
            return Indicators(" ", " ", absent=True)
        if self.took("*"):
            return Indicators(None, None)

        def place() -> str:
            if self.took("."):
                return INDICATORS
            if self.took("["):
                deny = self.took("^")
                found = self.members("#" + DIGITS + LOWER, (DIGITS, LOWER))
                return "".join(i for i in INDICATORS if i not in found) if deny else found
            found = self.one("#" + DIGITS + LOWER)
            return " " if found == "#" else found

        return Indicators(place(), place())

    def range(self) -> Range | None:
        if not self.took("["):
            return None
        start = self.attempt(self.number)
        if self.took(":"):
            end = self.attempt(self.number)
            if start is None and end is None:
                raise self.fail()
            found = Range(start or 0, end)
        elif start is None:
            raise self.fail()
        else:
            found = Range(start, start + 1)
        self.word("]")
        return found

    # -- queries -----------------------------------------------------------------

    def query(self) -> tuple[Constituent, ...]:
        out = [self.constituent()]
        while True:
            self.space()
            if not self.took(","):
                return tuple(out)
            self.space()
            out.append(self.constituent())

    def constituent(self) -> Constituent:
        return self.first(self.data_columns, self.control_column, self.leader_column, lambda: Literal(self.string()))

    def data_columns(self) -> DataColumns:
        tag, indicators = self.tag(), self.indicators()
        if self.took("."):
            return DataColumns(tag, indicators, (self.codes(),))
        self.word("{")
        columns, where = [], None
        while True:
            self.space()
            columns.append(self.column())
            self.space()
            if not self.took(","):
                break
        if self.took("|"):
            self.space()
            where = self.subfields()
        self.space()
        self.word("}")
        return DataColumns(tag, indicators, tuple(columns), where)

    def column(self) -> str | Literal:
        if self.took("_"):
            return ""
        return self.first(self.codes, lambda: Literal(self.string()))

    def control_column(self) -> ControlColumn:
        return ControlColumn(self.tag(), self.range())

    def leader_column(self) -> LeaderColumn:
        self.word("ldr.")
        return LeaderColumn(self.word(*NUMBERS, *LETTERS))

    # -- connectives, for records and for subfields ----------------------------------

    def alternatives(self, atom: Callable[[], Matcher]) -> Matcher:
        """``||`` over ``&&`` over negated, grouped or plain atoms."""

        def joined(sign: str, part: Callable[[], Matcher], make: Callable[[tuple[Matcher, ...]], Matcher]) -> Matcher:
            parts = [part()]
            while True:
                start = self.at
                self.space()
                if not self.took(sign):
                    self.at = start
                    return parts[0] if len(parts) == 1 else make(tuple(parts))
                self.space()
                parts.append(part())

        def group() -> Matcher:
            self.word("(")
            self.depth += 1
            if self.depth > DEEPEST:
                raise self.fail()
            self.space()
            found = self.alternatives(atom)
            self.space()
            self.word(")")
            self.depth -= 1
            return found

        def denied() -> Matcher:
            self.word("!")
            self.space()
            return Not(group())

        return joined("||", lambda: joined("&&", lambda: self.first(group, denied, atom), And), Or)

    # -- subfields ---------------------------------------------------------------

    def subfields(self) -> SubfieldMatcher:
        return self.alternatives(lambda: self.subfield(short=False))

    def every(self) -> bool:
        """A quantifier, if one stands here."""
        found = self.attempt(lambda: self.word("ALL", "ANY"))
        if found:
            self.space(1)
        return found == "ALL"

    def subfield(self, short: bool) -> SubfieldMatcher:
        def count() -> SubfieldMatcher:
            if short:
                raise self.fail()
            self.word("#")
            codes = self.codes()
            return SubfieldCount(codes, self.operator(), self.number())

        def exists() -> SubfieldMatcher:
            deny = not short and self.took("!")
            codes = self.codes()
            self.word("?")
            return SubfieldExists(codes, deny)

        def test() -> SubfieldMatcher:
            every = not short and self.every()
            codes = self.codes()
            self.space()
            member = self.attempt(lambda: self.word("not in", "in"))
            if member:
                self.space()
                return SubfieldTest(codes, "in", self.strings(), member == "not in", every)
            sign = self.attempt(lambda: self.word(*LISTED))
            if sign:
                self.space()
                kind, deny = LISTED[sign]
                values = self.strings()
                if kind == "=~":
                    values = tuple(self.pattern(v) for v in values)
                return SubfieldTest(codes, kind, values, deny, every)
            operator = self.operator()
            return SubfieldTest(codes, operator, (self.string(),), False, every)

        return self.first(exists, count, test)

    def pattern(self, regex: str) -> str:
        try:
            return translated(regex)
        except ValueError:
            raise self.fail() from None

    def operator(self) -> str:
        self.space()
        found = self.word(*COMPARISONS)
        self.space()
        return found

    # -- records -----------------------------------------------------------------

    def matcher(self) -> Matcher:
        return self.alternatives(self.record_atom)

    def record_atom(self) -> Matcher:
        return self.first(self.leader_test, self.control_test, self.data_test, self.field_exists, self.field_count)

    def leader_test(self) -> LeaderTest:
        self.word("ldr.")
        name = self.word(*NUMBERS, *LETTERS)
        operator = self.operator()
        if name in NUMBERS:
            return LeaderTest(name, operator, self.number())
        value = self.string()
        if len(value) != 1 or not value.isascii():
            raise self.fail()
        return LeaderTest(name, operator, value)

    def control_test(self) -> ControlTest:
        tag, range_ = self.tag(), self.range()
        self.space()
        member = self.attempt(lambda: self.word("not in", "in"))
        if member:
            self.space()
            self.word("[")
            return ControlTest(tag, range_, "in", self.bracketed(), member == "not in")
        return ControlTest(tag, range_, self.operator(), (self.string(),))

    def data_test(self) -> DataTest:
        every = self.every()
        tag, indicators = self.tag(), self.indicators()
        if self.took("."):
            return DataTest(tag, indicators, self.subfield(short=True), every)
        return DataTest(tag, indicators, self.block(), every)

    def block(self) -> SubfieldMatcher:
        self.word("{")
        self.space()
        found = self.subfields()
        self.space()
        self.word("}")
        return found

    def field_exists(self) -> FieldExists:
        deny = self.took("!")
        tag, indicators = self.tag(), self.indicators()
        where = None
        if self.took("."):
            where = SubfieldExists(self.codes())
        self.word("?")
        return FieldExists(tag, indicators, where, deny)

    def field_count(self) -> FieldCount:
        self.word("#")
        tag, indicators = self.tag(), self.indicators()
        where = self.block() if self.text.startswith("{", self.at) else None
        return FieldCount(tag, indicators, where, self.operator(), self.number())


def parse_query(text: str) -> tuple[Constituent, ...]:
    parser = Parser(text)
    return parser.whole(parser.query, "query")


def parse_matcher(text: str) -> Matcher:
    parser = Parser(text)
    return parser.whole(parser.matcher, "matcher")
