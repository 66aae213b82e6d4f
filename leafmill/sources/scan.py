"""ISO 2709 files as records.

Framing of plain files is Spark's text reader with the record terminator as line separator, so files are split between tasks.  That
reader drops the separator and so cannot tell a last record without terminator from one with it; the last byte of each plain file
is looked at for that, through the file system Spark has for it.  Gzip files are read as streams, one task a file, and dealt to all tasks
before they are decoded; those of stores that pyarrow does not reach go through the text reader, where a cut last record passes.

Decoding is done with built-in functions: bytes become Latin-1 text, in which one character is one byte, and values are turned back
into their bytes.  A record is valid if its leader, its directory and all its fields agree.
"""

from __future__ import annotations

import glob as globbing
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.project import Matcher, Query
from leafmill.operators.records import valid, where as filtered
from leafmill.plans.compiler import THRESHOLD
from leafmill.sources.model import settled
from leafmill.sources.shared import store

RECORD_END, FIELD_END, SUBFIELD = "\x1d", "\x1e", "\x1f"
_GRAPHIC, _BLANK = r"[\x21-\x7E]", r"[\x20-\x7E]"
_LEADER = rf"^[0-9]{{5}}{_GRAPHIC}{{2}}{_BLANK}{{3}}22[0-9]{{5}}{_BLANK}{{3}}4500"
_DIRECTORY = r"^(?:[0-9]{3}[0-9]{4}[0-9]{5})+$"


def expanded(sources: str | list[str]) -> list[str]:
    """Paths with the home directory filled in; patterns of local files are resolved, others are left to the reader."""
    out = []
    for path in [sources] if isinstance(sources, str | os.PathLike) else sources:
        path = os.path.expanduser(str(path))
        if "://" not in path and any(c in path for c in "*?["):
            out += sorted(globbing.glob(path))
        else:
            out.append(path)
    return out


def _latin(text: Column, plain: Column) -> Column:
    """Latin-1 text, one character a byte, as the text that the bytes are; ``plain``: whether all of them are ASCII."""
    return F.when(plain, text).otherwise(F.encode(text, "ISO-8859-1").cast("string"))


def _part(text: Column, start: int, size: int) -> Column:
    return F.substring(text, start + 1, size)


def decoded(raw: DataFrame, content: str = "content") -> DataFrame:
    """Rows with a binary column ``content`` (a record without its terminator) as records."""
    rows = settled(raw, _l=F.decode(F.col(content), "ISO-8859-1"))
    # one character is one byte; where all bytes are ASCII, values need no way back
    rows = settled(rows, _ascii=F.octet_length("_l") == F.char_length("_l"), _parts=F.split("_l", FIELD_END, -1), _good=F.rlike(_part(F.col("_l"), 0, 24), F.lit(_LEADER)))
    good_leader = F.col("_good")
    length = F.when(good_leader, _part(F.col("_l"), 0, 5).cast("int"))
    base = F.when(good_leader, _part(F.col("_l"), 12, 5).cast("int"))
    names = [("length", length), ("status", _part(F.col("_l"), 5, 1)), ("type", _part(F.col("_l"), 6, 1)), ("idef1", _part(F.col("_l"), 7, 1)), ("idef2", _part(F.col("_l"), 8, 1)), ("encoding", _part(F.col("_l"), 9, 1)), ("base_addr", base), ("idef3", _part(F.col("_l"), 17, 1)), ("idef4", _part(F.col("_l"), 18, 1)), ("idef5", _part(F.col("_l"), 19, 1))]
    rows = settled(rows, leader=F.when(good_leader, F.struct(*(c.alias(n) for n, c in names))), _dir=F.substring(F.element_at("_parts", 1), 25, 1 << 20))
    good_directory = F.rlike("_dir", F.lit(_DIRECTORY))
    rows = settled(rows, _n=F.when(good_directory, (F.length("_dir") / 12).cast("int")).otherwise(F.lit(0)))
    values = F.slice("_parts", F.lit(2), F.greatest(F.col("_n"), F.lit(0)))
    entries = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.substring(F.col("_dir"), i * 12 + 1, F.lit(12)))
    pairs = F.when(F.col("_n") > 0, F.arrays_zip(entries.alias("entry"), values.alias("text"))).otherwise(F.array().cast("array<struct<entry:string,text:string>>"))

    def is_control(p: Column) -> Column:
        return F.startswith(p["entry"], F.lit("00"))

    def good(p: Column) -> Column:
        size = F.substring(p["entry"], 4, 4).cast("int")
        body = F.rlike(p["text"], F.lit(rf"(?s)^[ a-z0-9]{{2}}(?:{SUBFIELD}[0-9A-Za-z][^{SUBFIELD}]*)*$"))
        return F.coalesce((size > 0) & F.when(is_control(p), F.length(p["text"]) == size - 1).otherwise(body), F.lit(False))

    def field(p: Column) -> Column:
        subs = F.transform(F.slice(F.split(p["text"], SUBFIELD, -1), F.lit(2), F.lit(1 << 20)), lambda s: F.struct(F.substring(s, 1, 1).alias("code"), _latin(F.substring(s, 2, 1 << 20), plain).alias("value")))
        return F.struct(
            F.substring(p["entry"], 1, 3).alias("tag"), F.when(~is_control(p), F.substring(p["text"], 1, 1)).alias("ind1"), F.when(~is_control(p), F.substring(p["text"], 2, 1)).alias("ind2"),
            F.when(is_control(p), _latin(p["text"], plain)).alias("value"), F.when(~is_control(p), subs).alias("subfields"))

    plain = F.col("_ascii")
    # one walk over the fields: what each is worth and what it holds
    rows = settled(rows, _seen=F.transform(pairs, lambda p: F.struct(good(p).alias("good"), field(p).alias("field"))))
    length, base = F.col("leader.length"), F.col("leader.base_addr")
    # what follows the directory, with the terminators between its parts
    payload = F.length("_l") - F.length(F.element_at("_parts", 1)) - 1
    checks = [
        ("leader", ~F.coalesce(good_leader, F.lit(False))),
        ("length", F.coalesce(~(length > base + 1), F.lit(True))),
        ("directory", ~F.coalesce(good_directory, F.lit(False))),
        ("size", F.coalesce((length - base - 1 != payload), F.lit(True))),
        ("fields", (F.size("_parts") < F.col("_n") + 2) | ~F.forall("_seen", lambda x: x["good"])),
        ("terminator", F.coalesce(F.col("_open"), F.lit(False)) if "_open" in raw.columns else F.lit(False)),
    ]
    err = F.coalesce(*(F.when(test, F.lit(f"invalid {name}")) for name, test in checks))
    full = F.concat(F.col(content), F.when(F.col("_open"), F.lit(b"")).otherwise(F.lit(b"\x1d")) if "_open" in raw.columns else F.lit(b"\x1d"))
    out = settled(rows, err=err).withColumn("valid", F.col("err").isNull()).withColumn("raw", full)
    out = out.withColumn("fields", F.when(F.col("valid"), F.col("_seen.field")))
    return out.select("source", "ord", "raw", "valid", "err", "leader", "fields")


def framed(spark: SparkSession, sources: str | list[str]) -> DataFrame:
    """Rows source, ord, content, _open: the records' bytes in input order.

    ord counts up within a file by where its split begins and the place in that split."""
    paths = [file for path in expanded(sources) for file in _files(spark, path)]
    if not paths:
        return spark.createDataFrame([], "source string, ord long, content binary, _open boolean")
    rounds: list[dict[str, int]] = []  # a file that is given again is read again, in its own place
    for i, name in enumerate(map(_uri, paths)):
        own = next((r for r in rounds if name not in r), None)
        if own is None:
            rounds.append(own := {})
        own[name] = i
    frames = []
    for own in rounds:
        for zipped, read in ((True, _unzipped), (False, _framed)):
            if some := {name: i for name, i in own.items() if _streamed(name) == zipped}:
                frames.append(read(spark, [paths[i] for i in some.values()], some, len(paths)))
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


SPLIT_BITS, LEAST_ROW_BITS = 18, 26
MAPPED = 1_000  # files whose places are part of the plan; those of more are joined


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files that a path stands for, in order of their names."""
    if "://" in path or path.startswith("file:"):
        return sorted(map(unquote, spark.read.text(path).inputFiles()))
    if os.path.isdir(path):
        return sorted(os.path.join(top, f) for top, _, names in os.walk(path) for f in names if not f.startswith(("_", ".")))
    return [path]


def _row_bits(count: int) -> int:
    """Bits of a position that count records within a split, which stand behind those of the file and of the split."""
    bits = 63 - max(1, count.bit_length()) - SPLIT_BITS
    if bits < LEAST_ROW_BITS:
        raise ValueError(f"too many files at once: {count}")
    return bits


def _fitting(value: Column, bits: int, what: str) -> Column:
    """``value``, or an error where it does not fit."""
    return F.when(F.shiftright(value, bits) == 0, value).otherwise(F.raise_error(F.lit(f"positions do not fit: more than 2 ** {bits} {what}")).cast("long"))


def _framed(spark: SparkSession, paths: list[str], places: dict[str, int], count: int) -> DataFrame:
    read = spark.read.option("lineSep", RECORD_END).text(paths)
    rows = read.select(F.col("value").cast("binary").alias("content"), _named(F.col("_metadata.file_path")).alias("source"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    if len(places) <= MAPPED:
        at = F.element_at(F.create_map(*(F.lit(x) for pair in places.items() for x in pair)), F.col("source"))
    else:
        # a name and a number for each file, which the driver has listed
        rows = rows.join(F.broadcast(spark.createDataFrame(list(places.items()), "_name string, _place long")), F.col("source") == F.col("_name"))
        at = F.col("_place")
    conf = spark._jsparkSession.sessionState().conf()
    step = max(1, min(conf.filesOpenCostInBytes(), conf.filesMaxPartitionBytes()))  # no split is smaller
    bits = _row_bits(count)
    split = _fitting(F.floor(F.col("_start") / F.lit(step)), SPLIT_BITS, "splits of a file")
    # the file, then where the split begins, then the place in the split
    ord_ = F.shiftleft(at.cast("long"), SPLIT_BITS + bits) + F.shiftleft(split, bits) + _fitting(F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)), bits, "records of a split")
    rows = rows.withColumn("ord", ord_).select("source", "ord", "content")
    open_files = _unterminated(spark, list(places))
    if not open_files:
        return rows.select("source", "ord", "content", F.lit(False).alias("_open"))
    last = rows.where(F.col("source").isin(*open_files)).groupBy("source").agg(F.max("ord").alias("_last")).withColumnRenamed("source", "_file")
    rows = rows.join(F.broadcast(last), (F.col("source") == F.col("_file")) & (F.col("ord") == F.col("_last")), "left")  # one row a file
    return rows.select("source", "ord", "content", F.col("_last").isNotNull().alias("_open"))


def _uri(path: str) -> str:
    """How Spark names a file."""
    return re.sub("^file:/+", "file:/", path) if path.startswith("file:") else path if "://" in path else "file:" + os.path.abspath(path)


def _named(path: Column) -> Column:
    """The same for the column that Spark has for it, in which names are escaped."""
    return F.url_decode(F.replace(F.regexp_replace(path, "^file:/+", "file:/"), F.lit("+"), F.lit("%2B")))


def _streamed(uri: str) -> bool:
    """Whether a file is gzip in a store that tasks reach by themselves."""
    return uri.endswith(".gz") and uri.partition(":")[0] in ("file", "s3", "s3a", "gs", "hdfs")


def _unterminated(spark: SparkSession, files: list[str]) -> list[str]:
    """Those of the plain files that end without a record terminator; one byte of each is read, many files at a time."""

    def is_open(file: str) -> bool:
        place, system = store(spark, file)
        size = system.getFileStatus(place).getLen()
        if not size:
            return False
        stream = system.open(place)
        try:
            stream.seek(size - 1)
            return stream.read() != ord(RECORD_END)
        finally:
            stream.close()

    plain = [f for f in files if not f.endswith((".gz", ".bz2", ".deflate", ".zst", ".lz4", ".snappy"))]
    with ThreadPoolExecutor(32) as pool:
        return [f for f, found in zip(plain, pool.map(is_open, plain)) if found]


def _unzipped(spark: SparkSession, paths: list[str], places: dict[str, int], count: int) -> DataFrame:
    """Gzip files as streams, so that a record without terminator is seen, and in tasks of their own behind that."""
    bits = _row_bits(count) + SPLIT_BITS
    files = spark.createDataFrame([(name, i << bits) for name, i in places.items()], "source string, at long").repartition(len(places), "source")
    shape = pa.schema([("source", pa.string()), ("ord", pa.int64()), ("content", pa.binary()), ("_open", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, path = (fs.LocalFileSystem(), name.removeprefix("file:")) if name.startswith("file:") else fs.FileSystem.from_uri(name.replace("s3a://", "s3://", 1))
                tail = b""
                with system.open_input_stream(path, compression="gzip", buffer_size=1 << 20) as stream:
                    while block := stream.read(4 << 20):
                        *parts, tail = (tail + block).split(b"\x1d")
                        n = len(parts)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(at, at + n), pa.int64()), pa.array(parts, pa.binary()), pa.array([False] * n)], schema=shape)
                        at += n
                if tail:
                    yield pa.RecordBatch.from_pylist([{"source": name, "ord": at, "content": tail, "_open": True}], schema=shape)

    rows = files.mapInArrow(run, "source string, ord long, content binary, _open boolean")
    tasks = spark.sparkContext.defaultParallelism
    return rows.repartition(tasks) if len(places) < tasks else rows


def read_files(spark: SparkSession, sources: str | list[str], mode: str = "FAILFAST") -> DataFrame:
    """Records of files; mode as for ``valid``."""
    return valid(decoded(framed(spark, sources)), mode)


def scan_records(spark: SparkSession, sources: str | list[str], query: str | Query, *, header: str | list[str] | None = None, where: str | Matcher | None = None, mode: str = "DROPMALFORMED", threshold: float = THRESHOLD) -> DataFrame:
    """A query over files, lazily."""
    query = Query.parse(query)
    query.names(header)
    return query.select(filtered(read_files(spark, sources, mode), where, threshold=threshold), header, threshold)


def read_records(spark: SparkSession, sources: str | list[str], query: str | Query, **options):
    """The same, collected to a pandas frame."""
    return scan_records(spark, sources, query, **options).toPandas()


def from_bytes(spark: SparkSession, data: bytes, source: str = "-") -> DataFrame:
    """Records of bytes that the driver holds, such as standard input."""
    parts = data.split(b"\x1d")
    ends = bool(parts) and parts[-1] == b""
    parts = parts[:-1] if ends else parts
    rows = [(source, i, bytearray(p), i == len(parts) - 1 and not ends) for i, p in enumerate(parts)]
    return decoded(spark.createDataFrame(rows, "source string, ord long, content binary, _open boolean"))
