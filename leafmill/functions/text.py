"""Scalar functions of the engine as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

FORMS = ("nfc", "nfd", "nfkc", "nfkd")


def byte_slice(value: Column, start: int = 0, end: int | None = None) -> Column:
    """Bytes start <= i < end; the empty string unless all of them are there."""
    raw = value.cast("binary")
    size = F.octet_length(value)
    if end is not None and end < start:
        return F.lit("")
    stop = F.lit(end) if end is not None else size
    return F.when((size >= start) & (size >= stop), F.substring(raw, F.lit(start + 1), stop - start).cast("string")).otherwise(F.lit(""))


def similarity(value: Column, pattern: str) -> Column:
    """Normalised Levenshtein similarity by code points; two empty strings are alike."""
    value = F.make_valid_utf8(value)
    longest = F.greatest(F.char_length(value), F.lit(len(pattern)))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(value, F.lit(pattern)) / longest)


def normalized(text: Column, form: str) -> Column:
    """A Unicode normal form.  Spark has no such function, so this is an Arrow UDF."""
    if form.lower() not in FORMS:
        raise ValueError(f"unknown normal form: {form}")
    name = form.upper()

    @pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else unicodedata.normalize(name, v))

    return run(text)
