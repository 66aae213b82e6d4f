"""Queries, paths and matchers as objects, and the projection of records."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.errors import HeaderLengthError, ParseError
from leafmill.functions.text import FORMS
from leafmill.plans import ast, compiler
from leafmill.plans.parser import parse_matcher, parse_query


@dataclass(frozen=True)
class Query:
    """A projection of records to string columns."""

    text: str
    constituents: tuple[ast.Constituent, ...]

    @classmethod
    def parse(cls, text: str | Query) -> Query:
        return text if isinstance(text, cls) else cls(text, parse_query(text))

    def __str__(self) -> str:
        return self.text

    @property
    def width(self) -> int:
        return sum(map(compiler.width, self.constituents))

    def names(self, header: str | list[str] | None = None) -> list[str]:
        """Column names: those of ``header`` (a list, or names between commas), or column_1, column_2, .."""
        if not header:
            return [f"column_{i + 1}" for i in range(self.width)]
        names = [n.strip() for n in header.split(",")] if isinstance(header, str) else list(header)
        if len(names) != self.width:
            raise HeaderLengthError(f"the header has {len(names)} names, the query {self.width} columns")
        return names

    def schema(self, header: str | list[str] | None = None) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in self.names(header)])

    def tags(self) -> set[str]:
        return compiler.mentioned(self.constituents)

    def dtypes(self) -> list[str]:
        """What each column is in the record: number, character or text."""
        out = []
        for node in self.constituents:
            kind = "text"
            if isinstance(node, ast.LeaderColumn):
                kind = "number" if node.name in ("length", "base_addr") else "character"
            out += [kind] * compiler.width(node)
        return out

    def rows(self, threshold: float = compiler.THRESHOLD) -> Column:
        """All rows of a record as one array of arrays, empty rows left out; for commands that need them per record."""
        out = None
        for node in self.constituents:
            own = compiler.rows_column(node, threshold)
            out = own if out is None else compiler.crossed(out, own)
        return F.filter(out, lambda r: F.exists(r, lambda v: v != ""))

    def select(self, records: DataFrame, header: str | list[str] | None = None, threshold: float = compiler.THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
        """One row for each combination of values, lhs first; rows of empty cells only are left out.

        Every constituent is exploded by itself, so a record's product is streamed, not built."""
        names = self.names(header)
        out, cells = records.select(*keep, "leader", "fields"), []
        for k, node in enumerate(self.constituents):
            if isinstance(node, ast.Literal):
                cells.append(F.lit(node.value))
                continue
            made = f"_rows_{k}"
            out = out.withColumn(made, F.explode_outer(compiler.found_rows(node, threshold)))
            cells += [F.coalesce(F.col(made)[i], F.lit("")) for i in range(compiler.width(node))]
        out = out.where(compiler.any_of(c != "" for c in cells) if cells else F.lit(False))
        return out.select(*keep, *(c.alias(n) for c, n in zip(cells, names)))


@dataclass(frozen=True)
class Path:
    """A query of one constituent and at most one column."""

    query: Query

    @classmethod
    def parse(cls, text: str | Path) -> Path:
        if isinstance(text, cls):
            return text
        query = Query.parse(text)
        if len(query.constituents) != 1 or query.width > 1:
            raise ParseError("a path has one column", 0, text)
        return cls(query)

    def __str__(self) -> str:
        return self.query.text

    @property
    def width(self) -> int:
        return self.query.width

    @property
    def codes(self) -> str:
        node = self.query.constituents[0]
        return "".join(c for c in node.columns if isinstance(c, str)) if isinstance(node, ast.DataColumns) else ""

    def values(self, threshold: float = compiler.THRESHOLD) -> Column:
        """The path's non-empty values in a record, in order."""
        if not self.width:
            return F.array().cast("array<string>")
        return F.filter(F.transform(compiler.found_rows(self.query.constituents[0], threshold), lambda r: r[0]), lambda v: v != "")

    def first(self) -> Column:
        return F.try_element_at(self.values(), F.lit(1))

    def fields(self, threshold: float = compiler.THRESHOLD) -> Column:
        """The data fields that the path reads."""
        node = self.query.constituents[0]
        if not isinstance(node, ast.DataColumns):
            return F.filter(F.col("fields"), lambda f: F.lit(False))
        return compiler.data_fields(node, threshold)


@dataclass(frozen=True)
class Matcher:
    """A predicate on records."""

    text: str
    node: ast.Matcher
    threshold: float = compiler.THRESHOLD

    @classmethod
    def parse(cls, text: str | Matcher, threshold: float = compiler.THRESHOLD, normalization: str | None = None) -> Matcher:
        """``threshold``: 0 to 1, or a whole number up to 100.  ``normalization``: a Unicode form for the text of the matcher."""
        if isinstance(text, cls):
            return text
        if normalization:
            if normalization.lower() not in FORMS:
                raise ValueError(f"unknown normal form: {normalization}")
            text = unicodedata.normalize(normalization.upper(), text)
        return cls(text, parse_matcher(text), threshold / 100 if threshold > 1 else float(threshold))

    def __str__(self) -> str:
        return self.text

    def tags(self) -> set[str]:
        return compiler.mentioned(self.node)

    def column(self) -> Column:
        return F.coalesce(compiler.matcher_column(self.node, self.threshold), F.lit(False))


def control_number() -> Column:
    """The first value of field 001 among the leading control fields, or null."""
    return F.try_element_at(F.transform(F.filter(compiler.leading_control(F.col("fields")), lambda f: f["tag"] == "001"), lambda f: f["value"]), F.lit(1))
