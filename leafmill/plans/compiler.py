"""From parsed queries and matchers to Spark columns over ``leader`` and ``fields``.

Predicates go into the lambdas that walk the fields, never behind an ``explode``, so a record that does not match is dropped
before any row is made from it.  ``mentioned`` tells which tags an expression touches; sources that build records from tables use it
to build only those fields.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import byte_slice, similarity
from leafmill.plans.ast import (
    CODES, And, Constituent, ControlColumn, ControlTest, DataColumns, DataTest, FieldCount, FieldExists, Indicators, LeaderColumn, LeaderTest,
    Literal, Matcher, Not, Or, SubfieldCount, SubfieldExists, SubfieldMatcher, SubfieldTest, Tag,
)
from leafmill.sources.model import is_control, leading_control

THRESHOLD = 0.8
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b,
}


def any_of(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def all_of(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def has_tag(tag: Tag, field: Column) -> Column:
    if tag.literal is not None:
        return field["tag"] == tag.literal
    tests = [F.substring(field["tag"], i + 1, 1).isin(*place) for i, place in enumerate(tag.places) if len(place) < 10]
    return all_of(tests) if tests else F.lit(True)


def has_indicators(ind: Indicators, field: Column) -> Column:
    if ind.first is None:
        return F.lit(True)
    both = field["ind1"].isin(*ind.first) & field["ind2"].isin(*ind.second)
    return is_control(field) | both if ind.absent else ~is_control(field) & both


def has_code(codes: str, sub: Column) -> Column:
    if codes == CODES:
        return F.lit(True)
    return sub["code"] == codes if len(codes) == 1 else sub["code"].isin(*codes)


def _value_test(test: SubfieldTest, value: Column, threshold: float) -> Column:
    if test.kind in COMPARE:
        return COMPARE[test.kind](value, F.lit(test.values[0]))
    if test.kind == "=*":
        near = [similarity(value, p) >= threshold for p in test.values]
        return any_of(~n for n in near) if test.negated else any_of(near)  # denied: any pattern is unlike
    found = {
        "in": lambda: value.isin(*test.values),
        "=?": lambda: any_of(F.contains(value, F.lit(p)) for p in test.values),
        "=^": lambda: any_of(F.startswith(value, F.lit(p)) for p in test.values),
        "=$": lambda: any_of(F.endswith(value, F.lit(p)) for p in test.values),
        "=~": lambda: any_of(F.rlike(value, F.lit(p)) for p in test.values),
    }[test.kind]()
    return ~found if test.negated else found


def subfield_column(matcher: SubfieldMatcher, subs: Column, threshold: float = THRESHOLD) -> Column:
    """Whether the subfields of one field satisfy the matcher."""
    match matcher:
        case And(parts):
            return all_of(subfield_column(p, subs, threshold) for p in parts)
        case Or(parts):
            return any_of(subfield_column(p, subs, threshold) for p in parts)
        case Not(inner):
            return ~subfield_column(inner, subs, threshold)
        case SubfieldExists(codes, negated):
            found = F.exists(subs, lambda s: has_code(codes, s))
            return ~found if negated else found
        case SubfieldCount(codes, operator, count):
            return COMPARE[operator](F.size(F.filter(subs, lambda s: has_code(codes, s))), F.lit(count))
        case SubfieldTest(codes=codes, every=True):
            return F.forall(F.filter(subs, lambda s: has_code(codes, s)), lambda s: _value_test(matcher, s["value"], threshold))
        case SubfieldTest(codes=codes):
            return F.exists(subs, lambda s: has_code(codes, s) & _value_test(matcher, s["value"], threshold))
    raise TypeError(matcher)


def _sliced(value: Column, range_) -> Column:
    return value if range_ is None else byte_slice(value, range_.start, range_.end)


def matcher_column(matcher: Matcher, threshold: float = THRESHOLD, leader: str = "leader", fields: str = "fields") -> Column:
    """Whether a record satisfies the matcher."""
    every = F.col(fields)

    def data_field(node, f: Column) -> Column:
        return ~is_control(f) & has_tag(node.tag, f) & has_indicators(node.indicators, f)

    match matcher:
        case And(parts):
            return all_of(matcher_column(p, threshold, leader, fields) for p in parts)
        case Or(parts):
            return any_of(matcher_column(p, threshold, leader, fields) for p in parts)
        case Not(inner):
            return ~matcher_column(inner, threshold, leader, fields)
        case LeaderTest(name, operator, value):
            return COMPARE[operator](F.col(leader)[name], F.lit(value))
        case ControlTest(tag, range_, kind, values, negated):

            def told(f: Column) -> Column:
                value = _sliced(f["value"], range_)
                if kind != "in":
                    return COMPARE[kind](value, F.lit(values[0]))
                return ~value.isin(*values) if negated else value.isin(*values)

            return F.exists(leading_control(every), lambda f: has_tag(tag, f) & told(f))
        case DataTest(where=where, every=True):
            return F.forall(F.filter(every, lambda f: data_field(matcher, f)), lambda f: subfield_column(where, f["subfields"], threshold))
        case DataTest(where=where):
            return F.exists(every, lambda f: data_field(matcher, f) & subfield_column(where, f["subfields"], threshold))
        case FieldExists(tag, indicators, where, negated):

            def there(f: Column) -> Column:
                plain = has_tag(tag, f) & has_indicators(indicators, f)
                return plain if where is None else plain & (is_control(f) | subfield_column(where, f["subfields"], threshold))

            found = F.exists(every, there)
            return ~found if negated else found
        case FieldCount(tag, indicators, where, operator, count):

            def counted(f: Column) -> Column:
                plain = has_tag(tag, f) & has_indicators(indicators, f)
                return plain if where is None else plain & ~is_control(f) & subfield_column(where, f["subfields"], threshold)

            return COMPARE[operator](F.size(F.filter(every, counted)), F.lit(count))
    raise TypeError(matcher)


def width(constituent: Constituent) -> int:
    return sum(1 for c in constituent.columns if c != "") if isinstance(constituent, DataColumns) else 1


def code_values(codes: str, subs: Column) -> Column:
    """Values of the subfields with these codes, in order."""
    return F.transform(F.filter(subs, lambda s: has_code(codes, s)), lambda s: s["value"])


def crossed(left: Column, right: Column) -> Column:
    """Every row of one array followed by every row of another, left first."""
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, b))))


def _field_rows(columns: tuple[str | Literal, ...], field: Column) -> Column:
    """The product of a field's columns, as an array of rows; each row is an array of cells."""
    rows = None
    for column in columns:
        if column == "":
            continue
        if isinstance(column, Literal):
            cells = F.array(F.lit(column.value))
        else:
            found = code_values(column, field["subfields"])
            cells = F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)
        if rows is None:
            rows = F.transform(cells, lambda v: F.array(v))
        else:
            rows = crossed(rows, F.transform(cells, lambda v: F.array(v)))
    return F.array().cast("array<array<string>>") if rows is None else rows


def data_fields(node: DataColumns, threshold: float = THRESHOLD, fields: str = "fields") -> Column:
    """The data fields that a block of columns reads."""

    def asked(f: Column) -> Column:
        plain = ~is_control(f) & has_tag(node.tag, f) & has_indicators(node.indicators, f)
        return plain if node.where is None else plain & subfield_column(node.where, f["subfields"], threshold)

    return F.filter(F.col(fields), asked)


def found_rows(node: Constituent, threshold: float = THRESHOLD, leader: str = "leader", fields: str = "fields") -> Column:
    """The rows that one constituent finds in a record, as array<array<string>>; perhaps none."""
    match node:
        case Literal(value):
            return F.array(F.array(F.lit(value)))
        case LeaderColumn(name):
            return F.array(F.array(F.coalesce(F.col(leader)[name].cast("string"), F.lit(""))))
        case ControlColumn(tag, range_):
            return F.transform(F.filter(leading_control(F.col(fields)), lambda f: has_tag(tag, f)), lambda f: F.array(_sliced(f["value"], range_)))
        case DataColumns(columns=columns):
            return F.flatten(F.transform(data_fields(node, threshold, fields), lambda f: _field_rows(columns, f)))
    raise TypeError(node)


def rows_column(node: Constituent, threshold: float = THRESHOLD, leader: str = "leader", fields: str = "fields") -> Column:
    """The same with one row of empty cells where nothing is found."""
    found = found_rows(node, threshold, leader, fields)
    empty = F.array(F.array(*[F.lit("")] * width(node)).cast("array<string>"))
    return found if isinstance(node, Literal | LeaderColumn) else F.when(F.size(found) == 0, empty).otherwise(found)


def mentioned(node) -> set[str]:
    """All tags that a query or a matcher touches."""
    if isinstance(node, tuple):
        return set().union(*map(mentioned, node)) if node else set()
    if isinstance(node, And | Or):
        return mentioned(node.parts)
    if isinstance(node, Not):
        return mentioned(node.inner)
    tag = getattr(node, "tag", None)
    return set(tag.tags()) if tag else set()
