"""Records as a stream: new files of a directory are decoded as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.project import Matcher, Query, control_number
from leafmill.sources.scan import RECORD_END, decoded


def stream_records(spark: SparkSession, directory: str, max_files: int | None = None) -> DataFrame:
    """A streaming frame of records, with ``arrived`` for watermarks.  Positions are not in input order across files."""
    reader = spark.readStream.format("text").option("lineSep", RECORD_END)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.load(directory).select(F.col("value").cast("binary").alias("content"), F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("ord"), F.current_timestamp().alias("arrived"))
    at = rows.withColumn("keep", F.struct("source", "arrived"))
    out = decoded(at.withColumn("source", F.to_json("keep")))
    said = F.from_json("source", "source string, arrived timestamp")
    return out.withColumn("arrived", said["arrived"]).withColumn("source", said["source"])


def stream_select(records: DataFrame, query: str | Query, where: str | Matcher | None = None, header: str | list[str] | None = None) -> DataFrame:
    rows = records.where("valid")
    if where is not None:
        rows = rows.where(Matcher.parse(where).column())
    return Query.parse(query).select(rows, header)


def stream_frequency(records: DataFrame, query: str | Query, header: str | list[str] | None = None) -> DataFrame:
    """Counts so far of each combination of values; for complete or update mode."""
    query = Query.parse(query)
    names = query.names(header)
    return stream_select(records, query, header=names).groupBy(*names).agg(F.count("*").alias("count"))


def stream_dedup(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first record of each control number that arrives within ``delay`` of another one."""
    rows = records.where("valid").withColumn("_number", control_number()).where("_number is not null")
    return rows.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["_number"]).drop("_number")
