"""Commands that summarise records: count, frequency, describe, glimpse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.operators.project import Path, Query
from leafmill.plans.compiler import THRESHOLD, width
from leafmill.sources.shared import releasing, reused


def count(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("count"))


def frequency(records: DataFrame, query: str | Query, unique: bool = False, reverse: bool = False, threshold: int = 0, num: int = 0, header: str | list[str] | None = None, strsim: float = THRESHOLD) -> DataFrame:
    """How often each combination of values stands, most frequent first (``reverse``: last), then by value.

    unique: once for each record.  threshold: at least so often.  num: only the first so many."""
    query = Query.parse(query)
    names = query.names(header)
    if unique:
        rows = records.select(F.explode(F.array_distinct(query.rows(strsim))).alias("_row"))
        rows = rows.select(*(F.col("_row")[i].alias(n) for i, n in enumerate(names)))
    else:
        rows = query.select(records, names, strsim)
    out = rows.groupBy(*names).agg(F.count("*").alias("count"))
    if threshold:
        out = out.where(F.col("count") >= threshold)
    out = out.orderBy(F.asc("count") if reverse else F.desc("count"), *names)
    return out.limit(num) if num else out


def describe(records: DataFrame) -> DataFrame:
    """Rows field, ind1, ind2 and a column for each subfield code with how often it stands there.

    One pass, when this is called, counts tags, indicators and codes with partial sums; that small table is kept as long as the result,
    whose columns are the codes in it."""
    fields = records.select(F.explode("fields").alias("f")).where("f.subfields is not null")
    keys = [F.col("f.tag").alias("field"), F.col("f.ind1").alias("ind1"), F.col("f.ind2").alias("ind2")]
    each = fields.select(*keys, F.explode_outer("f.subfields.code").alias("code"))
    counted = each.groupBy("field", "ind1", "ind2", "code").agg(F.count("*").alias("n"))
    counted = reused(counted)
    codes = sorted(r["code"] for r in counted.select("code").distinct().collect() if r["code"] is not None)
    names = [F.sum(F.when(F.col("code") == c, F.col("n")).otherwise(F.lit(0))).alias(c) for c in codes]
    if not names:
        return releasing(counted.select("field", "ind1", "ind2").distinct(), counted)
    return releasing(counted.groupBy("field", "ind1", "ind2").agg(*names).orderBy("field", "ind1", "ind2"), counted)


def glimpse(records: DataFrame, path: str | Path, max_values: int = 10) -> DataFrame:
    """The first values of each subfield code in the fields of a path, in input order: code, values.

    Each task keeps the first values of its records before anything is shuffled, so a code that every record has is no hot key."""
    path = Path.parse(path)
    wanted = set(path.codes)
    rows = records.select("ord", F.posexplode(path.fields()).alias("at", "f"), F.spark_partition_id().alias("part"))
    rows = rows.select("ord", "at", "part", F.posexplode("f.subfields").alias("pos", "s")).select("ord", "at", "pos", "part", "s.code", F.make_valid_utf8("s.value").alias("value"))
    rows = rows.where(F.col("code").isin(*wanted)) if wanted else rows
    order = F.struct("ord", "at", "pos")
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("salt", F.pmod(F.col("part"), F.lit(parts)))
    near = salted.withColumn("place", F.row_number().over(Window.partitionBy("code", "salt").orderBy(order))).where(F.col("place") <= max_values)
    last = near.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy(order))).where(F.col("place") <= max_values)
    return last.groupBy("code").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("values"))


def glimpse_lines(found: DataFrame) -> DataFrame:
    """A glimpse as text, a line for each code."""
    return found.orderBy("code").select(F.concat(F.lit("$"), F.col("code"), F.lit(" "), F.array_join("values", ", ")).alias("line"))


def query_width(query: str | Query) -> int:
    return sum(map(width, Query.parse(query).constituents))
