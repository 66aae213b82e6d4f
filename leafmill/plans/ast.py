"""What queries and matchers say, as frozen values.

Sets of tags, indicators and codes are expanded when they are parsed, so the compiler only sees lists.
"""

from __future__ import annotations

from dataclasses import dataclass

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
INDICATORS = " " + DIGITS + LOWER
CODES = DIGITS + LOWER.upper() + LOWER


@dataclass(frozen=True)
class Tag:
    """The digits that each of the three positions may have."""

    places: tuple[str, str, str]
    text: str

    @property
    def literal(self) -> str | None:
        return "".join(self.places) if all(len(p) == 1 for p in self.places) else None

    def tags(self) -> list[str]:
        return [a + b + c for a in self.places[0] for b in self.places[1] for c in self.places[2]]


@dataclass(frozen=True)
class Indicators:
    """Values that each indicator may have; None: any, control fields included."""

    first: str | None
    second: str | None
    absent: bool = False  # nothing was written: both blank, or a control field


@dataclass(frozen=True)
class Range:
    """Bytes start <= i < end of a value."""

    start: int = 0
    end: int | None = None


# -- projection ------------------------------------------------------------------


@dataclass(frozen=True)
class Literal:
    value: str


@dataclass(frozen=True)
class LeaderColumn:
    name: str


@dataclass(frozen=True)
class ControlColumn:
    tag: Tag
    range: Range | None = None


@dataclass(frozen=True)
class DataColumns:
    """Columns of one field: codes (an empty string takes no room) or literals."""

    tag: Tag
    indicators: Indicators
    columns: tuple[str | Literal, ...]
    where: SubfieldMatcher | None = None


Constituent = Literal | LeaderColumn | ControlColumn | DataColumns

# -- subfield matchers -----------------------------------------------------------


@dataclass(frozen=True)
class SubfieldTest:
    """Compares values of subfields; kind is an operator such as ``==``, ``in``, ``=?``, ``=^``, ``=$``, ``=~`` or ``=*``."""

    codes: str
    kind: str
    values: tuple[str, ...]
    negated: bool = False
    every: bool = False


@dataclass(frozen=True)
class SubfieldExists:
    codes: str
    negated: bool = False


@dataclass(frozen=True)
class SubfieldCount:
    codes: str
    operator: str
    count: int


@dataclass(frozen=True)
class Not:
    inner: Matcher


@dataclass(frozen=True)
class And:
    parts: tuple[Matcher, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Matcher, ...]


SubfieldMatcher = SubfieldTest | SubfieldExists | SubfieldCount | Not | And | Or

# -- record matchers -------------------------------------------------------------


@dataclass(frozen=True)
class LeaderTest:
    name: str
    operator: str
    value: str | int


@dataclass(frozen=True)
class ControlTest:
    tag: Tag
    range: Range | None
    kind: str  # an operator or ``in``
    values: tuple[str, ...]
    negated: bool = False


@dataclass(frozen=True)
class DataTest:
    tag: Tag
    indicators: Indicators
    where: SubfieldMatcher
    every: bool = False


@dataclass(frozen=True)
class FieldExists:
    tag: Tag
    indicators: Indicators
    where: SubfieldMatcher | None = None
    negated: bool = False


@dataclass(frozen=True)
class FieldCount:
    tag: Tag
    indicators: Indicators
    where: SubfieldMatcher | None
    operator: str
    count: int


Matcher = SubfieldMatcher | LeaderTest | ControlTest | DataTest | FieldExists | FieldCount
