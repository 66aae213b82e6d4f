"""Records built from flat tables.

``tags`` limits a record to the fields that an expression mentions; tables that only other fields need are then neither read nor joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.model import FIELDS, control, data, leader


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(rows: DataFrame, source: str, ord_: Column, head: Column, *fields: Column | tuple[Column, ...]) -> DataFrame:
    """Fields: columns of one field, or pairs of (array of fields,)."""
    parts, single = [], []
    for f in fields:
        if isinstance(f, tuple):
            if single:
                parts.append(F.array(*single))
                single = []
            parts.append(F.coalesce(f[0], F.array().cast(FIELDS)))
        else:
            single.append(f)
    if single:
        parts.append(F.array(*single))
    made = (F.concat(*parts) if len(parts) > 1 else parts[0]) if parts else F.array().cast(FIELDS)
    return rows.select(F.lit(source).alias("source"), ord_.cast("long").alias("ord"), F.lit(None).cast("binary").alias("raw"), F.lit(True).alias("valid"), F.lit(None).cast("string").alias("err"), head.alias("leader"), made.alias("fields"))


def _gathered(rows: DataFrame, key: str, order: tuple[str, ...], field: Column) -> DataFrame:
    """A row for each key with ``items``: its rows in order, each with its field.

    Narrow rows are shuffled; fields are built behind the shuffle by generated code, before they are brought together."""
    rows = rows.select(key, *order).repartition(key)
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, field.alias("field")))).alias("items"))


def orders(spark: SparkSession, sf_dir: str, tags: set[str] | None = None) -> DataFrame:
    """A record for each order: control fields 001 003 005 008, 043 nation, 100/1# customer, 490 priority, 650 for each line item."""

    def want(*asked: str) -> bool:
        return tags is None or any(t in tags for t in asked)

    rows = table(spark, sf_dir, "orders")
    if want("650"):
        item = ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
        field = data("650", "  ", ("a", F.col("l_partkey")), ("b", F.col("l_suppkey")), ("2", F.col("l_returnflag")), ("9", F.col("l_linestatus")))
        items = _gathered(table(spark, sf_dir, "lineitem"), "l_orderkey", item, field)
        rows = rows.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    if want("043", "100"):
        customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
        rows = rows.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    if want("043"):
        rows = rows.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    fields: list = []
    if want("001"):
        fields.append(control("001", F.col("o_orderkey")))
    if want("003"):
        fields.append(control("003", F.lit("TPCH")))
    if want("005"):
        fields.append(control("005", F.concat(F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit(".0"))))
    if want("008"):
        fields.append(control("008", F.concat(F.date_format("o_orderdate", "yyMMdd"), F.lower("o_orderstatus"))))
    if want("043"):
        fields.append(data("043", "  ", ("a", F.col("n_name"))))
    if want("100"):
        fields.append(data("100", "1 ", ("a", F.col("c_name")), ("d", F.col("c_mktsegment"))))
    if want("490"):
        fields.append(data("490", "  ", ("a", F.col("o_orderpriority"))))
    if want("650"):
        fields.append((F.col("items.field"),))
    return _records(rows, "orders", F.col("o_orderkey"), leader(F.lower("o_orderstatus")), *fields)


def documents(spark: SparkSession, sf_dir: str, tags: set[str] | None = None) -> DataFrame:
    """A record for each document: 001, 041 language, 300 size, 520 text, 655/#7 labels if there are any, 773 source."""

    def want(tag: str) -> bool:
        return tags is None or tag in tags

    rows = table(spark, sf_dir, "documents")
    if want("655"):
        labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("of"), "quality", "toxic")
        rows = rows.join(labels, F.col("doc_id") == F.col("of"), "left")
    fields: list = []
    if want("001"):
        fields.append(control("001", F.col("doc_id")))
    if want("041"):
        fields.append(data("041", "  ", ("a", F.col("lang"))))
    if want("300"):
        fields.append(data("300", "  ", ("a", F.col("n_chars"))))
    if want("520"):
        fields.append(data("520", "  ", ("a", F.col("text"))))
    if want("655"):
        label = F.array(data("655", " 7", ("a", F.col("quality")), ("b", F.col("toxic")), ("2", F.lit("label"))))
        fields.append((F.when(F.col("of").isNotNull(), label),))
    if want("773"):
        fields.append(data("773", "  ", ("t", F.col("source"))))
    return _records(rows, "documents", F.col("doc_id"), leader(F.lit("n")), *fields)


def events(spark: SparkSession, sf_dir: str, tags: set[str] | None = None) -> DataFrame:
    """A record for each event; 001 is the user, so it repeats."""
    rows = table(spark, sf_dir, "events")
    fields = [control("001", F.col("user_id")), control("003", F.col("event_id")), control("005", F.date_format("ts", "yyyyMMddHHmmss.SSSSSS")), data("655", "  ", ("a", F.col("event_type")), ("v", F.col("value")))]
    kept = [f for f, tag in zip(fields, ("001", "003", "005", "655")) if tags is None or tag in tags]
    return _records(rows, "events", F.col("event_id"), leader(F.lit("n")), *kept)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(table(spark, sf_dir, "pages"), "pages", F.col("page_id"), leader(F.lit("n")), control("001", F.col("page_id")), data("520", "  ", ("a", F.col("html"))), data("856", "40", ("u", F.col("url"))))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each conversation with a field 700 for each turn."""
    field = data("700", "  ", ("a", F.col("role")), ("t", F.col("text")), ("n", F.col("turn")))
    rows = _gathered(table(spark, sf_dir, "conversations"), "conv_id", ("turn", "role", "text"), field)
    return _records(rows, "conversations", F.col("conv_id"), leader(F.lit("n")), control("001", F.col("conv_id")), (F.col("items.field"),))
