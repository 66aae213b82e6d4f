"""Commands that take records and return records or one row for each: filter, grep, concat, dedup, limit, sample, hash, split, partition, print."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.regex import translated
from leafmill.functions.text import normalized
from leafmill.operators.project import Matcher, Path, control_number
from leafmill.plans.compiler import THRESHOLD, any_of


def where(records: DataFrame, matcher: str | Matcher | None = None, limit: int = 0, threshold: float = THRESHOLD, normalization: str | None = None) -> DataFrame:
    """Records that satisfy the matcher, and of these the first ``limit`` (0: all).  Every command applies this first."""
    if matcher is not None:
        records = records.where(Matcher.parse(matcher, threshold, normalization).column())
    return first(records, limit)


def first(records: DataFrame, limit: int) -> DataFrame:
    """The first records by position; a top-k, not a sort of everything."""
    return records.orderBy("ord").limit(limit) if limit else records


def filter_records(records: DataFrame, matcher: str | Matcher, invert: bool = False, limit: int = 0, threshold: float = THRESHOLD, normalization: str | None = None) -> DataFrame:
    test = Matcher.parse(matcher, threshold, normalization).column()
    return first(records.where(~test if invert else test), limit)


def grep_column(patterns: Sequence[str], ignore_case: bool = False) -> Column:
    expressions = [translated(p, ignore_case) for p in patterns]

    def hit(value: Column) -> Column:
        return any_of(F.rlike(value, F.lit(e)) for e in expressions)

    return F.exists("fields", lambda f: F.when(f["subfields"].isNull(), hit(f["value"])).otherwise(F.exists(f["subfields"], lambda s: hit(s["value"]))))


def grep(records: DataFrame, pattern: str, or_: Sequence[str] = (), ignore_case: bool = False, invert: bool = False) -> DataFrame:
    """Records in which some value matches one of the expressions."""
    found = F.coalesce(grep_column([pattern, *or_], ignore_case), F.lit(False))
    return records.where(~found if invert else found)


def concat(*records: DataFrame) -> DataFrame:
    out = records[0]
    for more in records[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def dedup(records: DataFrame) -> DataFrame:
    """The first record of each control number; records without one are left out.

    The first position of each number is an aggregate with partial results, so a number that millions of records share
    costs a row a task; records then meet it in an equi-join that Spark can split."""
    numbered = records.withColumn("_number", control_number())
    firsts = numbered.where(F.col("_number").isNotNull()).groupBy("_number").agg(F.min("ord").alias("_first"))
    firsts = firsts.withColumnRenamed("_number", "_of")
    return numbered.join(firsts, (F.col("_number") == F.col("_of")) & (F.col("ord") == F.col("_first")), "left_semi").drop("_number")


def sample(records: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n records, every set of n as likely as any other."""
    return records.withColumn("_draw", F.rand(seed)).orderBy("_draw").limit(n).drop("_draw")


def hash_records(records: DataFrame) -> DataFrame:
    """cn, hash: SHA-256 of each record's bytes; no control number: an empty cn."""
    return records.select(F.make_valid_utf8(F.coalesce(control_number(), F.lit(""))).alias("cn"), F.sha2("raw", 256).alias("hash"))


def invalid(records: DataFrame) -> DataFrame:
    return records.where(~F.coalesce("valid", F.lit(True))).select("raw")


def valid(records: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Readable records: the others end the job (FAILFAST), are left out (DROPMALFORMED) or stay (PERMISSIVE)."""
    if mode == "PERMISSIVE":
        return records
    good = F.coalesce("valid", F.lit(True))
    if mode == "FAILFAST":
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid record "), F.col("ord").cast("string"), F.lit(" of "), F.coalesce("source", F.lit("?")))).cast("boolean"))
    return records.where(good)


def numbered(records: DataFrame, by: str = "ord") -> DataFrame:
    """``records`` with ``_row``, their position from 0.

    Positions of files lie in runs of one split each (the bits above the lowest 26), other positions are cut into as many ranges of
    equal width as there are partitions; ranges are sorted side by side and offset by the rows of the ranges before.  Finding the
    ranges takes a pass over the positions when this is called."""
    spark = records.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = F.shiftright(F.col(by), 26)
    low, high, runs = records.agg(F.min(by), F.max(by), F.approx_count_distinct(run)).first()
    span = max(1, -(-((high or 0) - (low or 0) + 1) // parts))
    ranged = records.withColumn("_range", run if runs > 1 else F.floor((F.col(by) - F.lit(low or 0)) / F.lit(span)))
    # one row a range: a split, or one of as many as there are partitions
    sums = ranged.groupBy("_range").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(by))
    return ranged.withColumn("_place", place).join(sums.select("_range", "_before"), "_range").withColumn("_row", F.col("_before") + F.col("_place") - 1).drop("_range", "_place", "_before")


def split(records: DataFrame, size: int) -> DataFrame:
    """Records with ``chunk``: the number of their group of ``size`` in input order."""
    if size < 1:
        raise ValueError("a chunk has at least one record")
    return numbered(records).withColumn("chunk", F.floor(F.col("_row") / size)).drop("_row")


def partition(records: DataFrame, path: str | Path) -> DataFrame:
    """A copy of each record for each of its distinct path values, in column ``value``; a path without width: nothing."""
    path = Path.parse(path)
    if not path.width:
        return records.withColumn("value", F.lit("")).where(F.lit(False))
    return records.withColumn("value", F.explode(F.sort_array(F.array_distinct(F.transform(path.values(), F.make_valid_utf8)))))


def text_column() -> Column:
    """A record as text: one line for the leader and for each field."""

    def number(name: str) -> Column:
        return F.lpad(F.coalesce(F.col("leader")[name], F.lit(0)).cast("string"), 5, "0")

    def part(name: str) -> Column:
        return F.coalesce(F.col("leader")[name], F.lit(" "))

    head = F.concat(F.lit("LDR "), number("length"), part("status"), part("type"), part("idef1"), part("idef2"), part("encoding"), F.lit("22"), number("base_addr"), part("idef3"), part("idef4"), part("idef5"), F.lit("4500"))

    def line(f: Column) -> Column:
        blank = (f["ind1"] == " ") & (f["ind2"] == " ")
        marks = F.when(blank, F.lit("")).otherwise(F.concat(F.lit("/"), F.translate(f["ind1"], " ", "#"), F.translate(f["ind2"], " ", "#")))
        subs = F.transform(f["subfields"], lambda s: F.concat(F.lit(" $"), s["code"], F.when(s["value"] == "", F.lit("")).otherwise(F.concat(F.lit(" "), s["value"]))))
        data = F.concat(f["tag"], marks, F.array_join(subs, ""))
        return F.when(f["subfields"].isNull(), F.concat(f["tag"], F.lit(" "), f["value"])).otherwise(data)

    return F.array_join(F.concat(F.array(head), F.transform("fields", line)), "\n")


def print_records(records: DataFrame, translit: str | None = None) -> DataFrame:
    text = text_column()
    return records.select("ord", (normalized(text, translit) if translit else text).alias("text"))
