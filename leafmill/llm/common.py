"""Helpers that every operator of this subpackage shares.

Rules kept here once so that each operator need not restate them:

* tables are read by Spark only, so any store that Spark can read works;
* intermediate results go to the folder named by ``spark.checkpoint.dir``, which all executors and the driver share; only
  in local mode, where they share a disk, may it be unset;
* what has been written there goes when nothing reads it any more (``discard``, ``scratch``), at the latest when the
  application ends;
* a null text is an empty text.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.shared import is_local, shared_dir, store, until_end

#: One word of any text: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_ROOT = str(Path(__file__).resolve().parents[2])


def bound_batches(spark: SparkSession) -> None:
    """Bounds what goes to a Python worker at once, where the session leaves that open: rows hold whole texts."""
    for name, value in (("maxRecordsPerBatch", "1000"), ("maxBytesPerBatch", str(8 << 20))):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, and bound what they get at once.

    In local mode they read the driver's files; on a cluster Spark hands them an archive of the package."""
    bound_batches(spark)
    context = spark.sparkContext
    if is_local(spark):
        env = context.environment
        path = env.get("PYTHONPATH", "")
        if _ROOT not in path.split(":"):
            env["PYTHONPATH"] = f"{path}:{_ROOT}".strip(":")
    elif context.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="leafmill-")  # only until Spark has copied the archive
        archive = os.path.join(folder, "leafmill.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(Path(_ROOT, "leafmill").rglob("*.py")):
                out.write(path, path.relative_to(_ROOT))
        context.addPyFile(archive)
        atexit.register(shutil.rmtree, folder, True)
        _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_open: ContextVar[list[str] | None] = ContextVar("tables of the innermost scratch", default=None)
_stay: set[str] = set()


def saved(spark: SparkSession, df: DataFrame, tag: str, rows: int | None = None, per_file: int = 200_000) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there.

    rows: about how many rows its last stage works on, where that is known.  That stage then runs as one task
    for each ``per_file`` of them at most, so that a small table does not become hundreds of tiny files."""
    path = f"{shared_dir(spark)}/leafmill/{tag}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per_file)))
    df.write.parquet(path)
    until_end(spark, path)
    if (within := _open.get()) is not None:
        within.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the files of tables that ``saved`` has returned and nothing will read again."""
    _delete(spark, [t.saved_path for t in tables])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place, files = store(spark, path)
        files.delete(place, True)
        files.cancelDeleteOnExit(place)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is saved within goes at its end, but for the tables that have been given to ``kept``."""
    outer, mine = _open.get(), []
    token = _open.set(mine)
    try:
        yield
    finally:
        _open.reset(token)
    stay = [p for p in mine if p in _stay]
    _delete(spark, [p for p in mine if p not in _stay])
    _stay.difference_update(stay)
    if outer is not None:
        outer += stay


def kept(table: DataFrame) -> DataFrame:
    """``table``, which the innermost ``scratch`` leaves alone."""
    _stay.add(table.saved_path)
    return table


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_text(doc_id: Column) -> Column:
    """The id as text; a null id counts as the empty text."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: what splits training rows from held-out rows."""
    return F.pmod(F.crc32(id_text(doc_id).cast("binary")), F.lit(modulus))
