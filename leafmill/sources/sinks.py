"""Where results go: record files, text, CSV and TSV, chunks and partitions, reports, graphs.

Record bytes are written by Spark's text writer with the record terminator as line separator, which keeps bytes as they are.  ``single`` moves
the only part of a one-part result to an exact file name, for the command line.
"""

from __future__ import annotations

import glob
import gzip
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F


# Names of the levels of compression from 0 to 9.
LEVELS = ("NO_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")


def _writer(rows: DataFrame, mode: str, compression: str | None, level: int | None) -> DataFrameWriter:
    """compression: a codec of Spark's; level: 0 (none) to 9 (best) of gzip."""
    writer = rows.write.mode(mode)
    if compression:
        writer = writer.option("compression", compression)
    return writer if level is None else writer.option("zlib.compress.level", LEVELS[level])


def write_raw(records: DataFrame, path: str, compression: str | None = None, mode: str = "error", by: str | None = None, level: int | None = None) -> None:
    """Records' bytes, each with its terminator; ``by``: a directory for each value of a column."""
    value = F.expr("substring(raw, 1, length(raw) - 1)").cast("string").alias("value")
    rows = records.where(F.col("raw").isNotNull())
    rows = rows.repartition(F.col(by)).select(value, by) if by else rows.select(value)
    writer = _writer(rows, mode, compression, level).option("lineSep", "\x1d")
    (writer.partitionBy(by) if by else writer).text(path)


def write_text(lines: DataFrame, path: str, compression: str | None = None, mode: str = "error", separator: str = "\n", level: int | None = None) -> None:
    _writer(lines.select(F.col(lines.columns[0]).alias("value")), mode, compression, level).option("lineSep", separator).text(path)


def write_table(rows: DataFrame, path: str, header: bool = False, tsv: bool = False, compression: str | None = None, mode: str = "error", level: int | None = None) -> None:
    """CSV, or TSV; quotes are doubled and missing values are empty."""
    _writer(rows, mode, compression, level).option("sep", "\t" if tsv else ",").option("header", header).option("escape", '"').option("emptyValue", "").csv(path)


def is_tsv(path: str | None) -> bool:
    return bool(path) and path.removesuffix(".gz").endswith(".tsv")


def single(path: str, write, append: bool = False) -> None:
    """One local file of exactly this name from ``write(directory, compression)``, whose result has one part."""
    gzip = path.endswith(".gz")
    if gzip and append:
        raise ValueError("Appending to Gzip compressed output is not supported.")
    holder = tempfile.mkdtemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        write(os.path.join(holder, "out"), "gzip" if gzip else None)
        parts = sorted(glob.glob(os.path.join(holder, "out", "part-*")))
        with open(path, "ab" if append else "wb") as out:
            for part in parts:
                with open(part, "rb") as f:
                    shutil.copyfileobj(f, out)
    finally:
        shutil.rmtree(holder)


def write_document(objects: DataFrame, path: str, level: int | None = None) -> None:
    """One local JSON document with the objects (JSON text) as its ``records``, for the command line; they are streamed."""
    with gzip.open(path, "wt", 9 if level is None else level, encoding="utf-8") if path.endswith(".gz") else open(path, "w", encoding="utf-8") as out:
        out.write('{"records": [')
        for i, row in enumerate(objects.toLocalIterator()):
            out.write((",\n" if i else "\n") + row[0])
        out.write("\n]}\n")
