"""Registered queries over records built from tables, each with its oracle in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import normalized
from leafmill.operators import aggregates, check, records as ops, skos
from leafmill.operators.project import Matcher, Query, control_number
from leafmill.sources import sinks, tables
from leafmill.sources.encode import encoded
from leafmill.sources.scan import decoded, read_files, scan_records
from leafmill.sources.shared import shared_dir, until_end

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def add(name: str, run: Run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


# -- select ----------------------------------------------------------------------


def select(name: str, build, query: str, header: str, sql: str, where: str | None = None) -> None:
    parsed = Query.parse(query)
    matcher = Matcher.parse(where) if where else None
    tags = parsed.tags() | (matcher.tags() if matcher else set())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parsed.select(ops.where(build(spark, sf_dir, tags), matcher), header)

    add(name, run, sql)


ITEMS = "orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"
select("q_select_control", tables.orders, "001, 005[0:4]", "cn, year", "SELECT o_orderkey::VARCHAR AS cn, strftime(o_orderdate, '%Y') AS year FROM orders")
select("q_select_cartesian", tables.orders, "001, 650{ a, 2 }", "cn, part, flag", f"SELECT o_orderkey::VARCHAR AS cn, coalesce(l_partkey::VARCHAR, '') AS part, coalesce(l_returnflag, '') AS flag FROM {ITEMS}")
select("q_select_predicate", tables.orders, '001, 650{ a | 2 == "R" }', "cn, part", f"SELECT o_orderkey::VARCHAR AS cn, coalesce(l_partkey::VARCHAR, '') AS part FROM {ITEMS} AND l_returnflag = 'R'")
select("q_select_multicode", tables.orders, "001, 650.[ab]", "cn, key", """
SELECT o_orderkey::VARCHAR AS cn, key FROM orders JOIN (SELECT l_orderkey, l_partkey::VARCHAR AS key FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey::VARCHAR FROM lineitem) ON l_orderkey = o_orderkey
UNION ALL SELECT o_orderkey::VARCHAR, '' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
select("q_select_literal", tables.orders, '001, "x", 490.a', "cn, x, priority", "SELECT o_orderkey::VARCHAR AS cn, 'x' AS x, o_orderpriority AS priority FROM orders")
select("q_select_leader", tables.orders, "001, ldr.status", "cn, status", "SELECT o_orderkey::VARCHAR AS cn, lower(o_orderstatus) AS status FROM orders")
select("q_select_missing", tables.documents, "001, 655/#7{ a, b }", "cn, quality, toxic", "SELECT d.doc_id::VARCHAR AS cn, coalesce(quality::VARCHAR, '') AS quality, coalesce(toxic::VARCHAR, '') AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
select("q_select_wildcard", tables.orders, "001, 100/*.*", "cn, value", """
SELECT o_orderkey::VARCHAR AS cn, unnest([c_name, c_mktsegment]) AS value FROM orders JOIN customer ON o_custkey = c_custkey""")
select("q_select_where", tables.orders, "001, 043.a, 100/1#{ a, d }", "cn, nation, name, segment", """
SELECT o_orderkey::VARCHAR AS cn, n_name AS nation, c_name AS name, c_mktsegment AS segment
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' AND o_orderdate < DATE '1997-01-01'""", where='490.a == "1-URGENT" && 005[:4] < "1997"')

# -- filter ----------------------------------------------------------------------


def matching(name: str, build, matcher: str, sql: str, invert: bool = False) -> None:
    parsed = Matcher.parse(matcher)
    tags = parsed.tags() | {"001"}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ops.filter_records(build(spark, sf_dir, tags), parsed, invert).select(control_number().alias("cn"))

    add(name, run, sql)


def orders_where(condition: str) -> str:
    return f"SELECT o_orderkey::VARCHAR AS cn FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE {condition}"


def having(condition: str) -> str:
    return orders_where(f"o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING {condition})")


SIMILAR = "1 - levenshtein(o_orderpriority, '{0}')::DOUBLE / greatest(length(o_orderpriority), length('{0}')) >= 0.8"
FILTERS = {
    "compare": ('005[:4] < "1997"', orders_where("o_orderdate < DATE '1997-01-01'")),
    "not_equal": ('490.a != "5-LOW"', orders_where("o_orderpriority <> '5-LOW'")),
    "in": ("490.a in ['1-URGENT', '2-HIGH']", orders_where("o_orderpriority IN ('1-URGENT', '2-HIGH')")),
    "not_in": ("490.a not in ['1-URGENT', '2-HIGH']", orders_where("o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")),
    "control_in": ("005[0:4] in ['1995', '1996']", orders_where("year(o_orderdate) IN (1995, 1996)")),
    "control_not_in": ("005[0:4] not in ['1995', '1996']", orders_where("year(o_orderdate) NOT IN (1995, 1996)")),
    "prefix": ('100/1#.a =^ ["Customer#00000001", "Customer#00000002"]', orders_where("starts_with(c_name, 'Customer#00000001') OR starts_with(c_name, 'Customer#00000002')")),
    "prefix_negated": ('100/1#.a !^ "Customer#0000001"', orders_where("NOT starts_with(c_name, 'Customer#0000001')")),
    "suffix": ("100/1#.a =$ '7'", orders_where("suffix(c_name, '7')")),
    "suffix_negated": ("100/1#.a !$ ['7', '3']", orders_where("NOT suffix(c_name, '7') AND NOT suffix(c_name, '3')")),
    "substr": ("490.a =? 'URG'", orders_where("contains(o_orderpriority, 'URG')")),
    "substr_negated": ("490.a !? ['URG', 'LOW']", orders_where("NOT contains(o_orderpriority, 'URG') AND NOT contains(o_orderpriority, 'LOW')")),
    "regex": ('490.a =~ "^[12]-"', orders_where("regexp_matches(o_orderpriority, '^[12]-')")),
    "regex_negated": ('490.a !~ ["^[12]-", "LOW$"]', orders_where("NOT regexp_matches(o_orderpriority, '^[12]-') AND NOT regexp_matches(o_orderpriority, 'LOW$')")),
    "regex_posix": ('490.a =~ "^[[:digit:]]-[[:upper:]--[A-L]]"', orders_where("regexp_matches(o_orderpriority, '^[0-9]-[M-Z]')")),
    "regex_multiline": ('490.a =~ "(?m)^\\\\d-(?:high|low)$(?-m)" || 490.a =~ "(?i:^5-low)\\\\z"', orders_where("regexp_matches(o_orderpriority, '^5-LOW$')")),
    "regex_script": ('043.a =~ "^\\\\p{Latin}+_\\\\p{Nd}$"', orders_where("regexp_matches(n_name, '^[A-Za-z]+_[0-9]$')")),
    "strsim": ("490.a =* '3-MEDIVM'", orders_where(SIMILAR.format("3-MEDIVM"))),
    "strsim_negated": ("490.a !* ['3-MEDIVM', '1-URGENT']", orders_where(f"NOT ({SIMILAR.format('3-MEDIVM')}) OR NOT ({SIMILAR.format('1-URGENT')})")),
    "any": ("ANY 650{ 9 == 'F' }", having("bool_or(l_linestatus = 'F')")),
    "all": ('ALL 650{ 9 == "F" } && 650?', having("bool_and(l_linestatus = 'F')")),
    "all_vacuous": ('ALL 650{ 9 == "F" }', orders_where("NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus <> 'F')")),
    "all_subfields": ("650{ ALL [29] in ['A', 'F'] && 9 == 'F' }", having("bool_or(l_linestatus = 'F' AND l_returnflag = 'A')")),
    "field_count": ('#650{ 2 == "R" } >= 2', having("sum((l_returnflag = 'R')::INT) >= 2")),
    "field_count_none": ("#650 == 0", orders_where("o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")),
    "subfield_count": ("650{ #[ab29] == 4 && 2 == 'R' }", having("bool_or(l_returnflag = 'R')")),
    "bool_group": ('(490.a == "1-URGENT") || 005[:4] == "1997" && 043.a == "NATION_1"', orders_where("o_orderpriority = '1-URGENT' OR (year(o_orderdate) = 1997 AND n_name = 'NATION_1')")),
    "bool_nested": ("!(490.a == '1-URGENT' || 650?) && ldr.status != 'p'", orders_where("NOT (o_orderpriority = '1-URGENT' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AND lower(o_orderstatus) <> 'p'")),
    "subfield_group": ("650{ (2 == 'R' || 2 == 'A') && !(9 == 'O') }", having("bool_or(l_returnflag IN ('R', 'A') AND l_linestatus <> 'O')")),
    "leader": ("ldr.status == 'f'", orders_where("o_orderstatus = 'F'")),
    "tag_pattern": ("[04][49][03].a =? '1'", orders_where("contains(n_name, '1') OR contains(o_orderpriority, '1')")),
}
for _name, (_matcher, _sql) in FILTERS.items():
    matching(f"q_filter_{_name}", tables.orders, _matcher, _sql)
matching("q_filter_invert", tables.orders, '490.a == "5-LOW"', orders_where("o_orderpriority <> '5-LOW'"), invert=True)
LABELLED = "SELECT doc_id::VARCHAR AS cn FROM documents d WHERE {} EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id {})"
matching("q_filter_exists", tables.documents, "655/#7?", LABELLED.format("", ""))
matching("q_filter_not_exists", tables.documents, "!655/#7?", LABELLED.format("NOT", ""))
matching("q_filter_subfield_exists", tables.documents, "655/#7.[ab]?", LABELLED.format("", ""))
matching("q_filter_indicator_pattern", tables.documents, '655/#[5-9].a == "1"', LABELLED.format("", "AND quality = 1"))
matching("q_filter_indicator_wildcard", tables.documents, '655/*.b == "1"', LABELLED.format("", "AND toxic = 1"))

ALL_VALUES = "o_orderkey::VARCHAR, 'TPCH', strftime(o_orderdate, '%Y%m%d%H%M%S') || '.0', strftime(o_orderdate, '%y%m%d') || lower(o_orderstatus), n_name, c_name, c_mktsegment, o_orderpriority"


def grepping(name: str, condition: str, items: str, deny: bool = False, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ops.grep(tables.orders(spark, sf_dir), **options).select(control_number().alias("cn"))

    hit = f"len(list_filter([{ALL_VALUES}], lambda v: {condition})) > 0 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND ({items}))"
    add(name, run, orders_where(f"NOT ({hit})" if deny else hit))


_ITEM = " OR ".join(f"regexp_matches({c}, '{{0}}')" for c in ("l_partkey::VARCHAR", "l_suppkey::VARCHAR", "l_returnflag", "l_linestatus"))
grepping("q_grep", "regexp_matches(v, 'AUTO')", _ITEM.format("AUTO"), pattern="AUTO")
grepping("q_grep_or", "regexp_matches(v, 'AUTO') OR regexp_matches(v, '^199$')", _ITEM.format("AUTO|^199$"), pattern="AUTO", or_=["^199$"])
grepping("q_grep_icase", "regexp_matches(v, 'urgent', 'i')", _ITEM.format("URGENT"), pattern="urgent", ignore_case=True)
grepping("q_grep_invert", "regexp_matches(v, '^NATION_[0-9]$')", _ITEM.format("^NATION_[0-9]$"), deny=True, pattern="^NATION_[0-9]$", invert=True)

# -- counting --------------------------------------------------------------------

add("q_count", lambda s, d: aggregates.count(tables.orders(s, d, set())), "SELECT count(*) AS count FROM orders")
add("q_count_where", lambda s, d: aggregates.count(ops.where(tables.orders(s, d, {"490", "650"}), '490.a == "1-URGENT" && #650 > 4')), "SELECT count(*) AS count FROM orders WHERE o_orderpriority = '1-URGENT' AND (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) > 4")
FLAGS = "SELECT coalesce(l_returnflag, '') AS flag, {} AS count FROM " + ITEMS + " WHERE l_returnflag IS NOT NULL GROUP BY 1 {}"
add("q_frequency", lambda s, d: aggregates.frequency(tables.orders(s, d, {"650"}), "650.2", header="flag"), FLAGS.format("count(*)", ""))
add("q_frequency_unique", lambda s, d: aggregates.frequency(tables.orders(s, d, {"650"}), "650.2", unique=True, header="flag"), FLAGS.format("count(DISTINCT o_orderkey)", ""))
PARTS = "SELECT l_partkey::VARCHAR AS part, l_returnflag AS flag, count(*) AS count FROM lineitem GROUP BY 1, 2"
add("q_frequency_threshold", lambda s, d: aggregates.frequency(tables.orders(s, d, {"650"}), "650{ a, 2 }", threshold=8, header="part, flag"), PARTS + " HAVING count(*) >= 8")
add("q_frequency_top", lambda s, d: aggregates.frequency(tables.orders(s, d, {"650"}), "650{ a, 2 }", num=20, header="part, flag"), PARTS + " ORDER BY count DESC, part, flag LIMIT 20")
add("q_frequency_reverse", lambda s, d: aggregates.frequency(tables.orders(s, d, {"650"}), "650{ a, 2 }", reverse=True, num=20, header="part, flag"), PARTS + " ORDER BY count, part, flag LIMIT 20")
add("q_describe", lambda s, d: aggregates.describe(tables.orders(s, d)), """
SELECT '043' AS field, ' ' AS ind1, ' ' AS ind2, 0 AS "2", 0 AS "9", count(*) AS a, 0 AS b, 0 AS d FROM orders
UNION ALL SELECT '100', '1', ' ', 0, 0, count(*), 0, count(*) FROM orders
UNION ALL SELECT '490', ' ', ' ', 0, 0, count(*), 0, 0 FROM orders
UNION ALL SELECT '650', ' ', ' ', count(*), count(*), count(*), count(*), 0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
add("q_glimpse", lambda s, d: aggregates.glimpse(tables.orders(s, d, {"490"}), "490.a", 5).select("code", F.array_join("values", "|").alias("values")), "SELECT 'a' AS code, (SELECT string_agg(o_orderpriority, '|' ORDER BY o_orderkey) FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5)) AS values")

# -- records ---------------------------------------------------------------------

add("q_dedup", lambda s, d: Query.parse("001, 003").select(ops.dedup(tables.events(s, d, {"001", "003"})), "cn, event"), "SELECT user_id::VARCHAR AS cn, min(event_id)::VARCHAR AS event FROM events GROUP BY user_id")
add("q_partition", lambda s, d: ops.partition(tables.orders(s, d, {"001", "650"}), "650.2").select("value", control_number().alias("cn")), "SELECT DISTINCT l_returnflag AS value, o_orderkey::VARCHAR AS cn FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
add("q_split", lambda s, d: ops.split(tables.orders(s, d, {"001"}), 1000).select("chunk", control_number().alias("cn")), "SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk, o_orderkey::VARCHAR AS cn FROM orders")
add("q_concat", lambda s, d: ops.concat(*(ops.filter_records(tables.orders(s, d, {"001", "005"}), '005[:4] < "1996"', invert) for invert in (False, True))).select(control_number().alias("cn")), "SELECT o_orderkey::VARCHAR AS cn FROM orders")
add("q_limit", lambda s, d: ops.where(tables.orders(s, d, {"001", "490"}), '490.a == "1-URGENT"', 100).select(control_number().alias("cn")), "SELECT o_orderkey::VARCHAR AS cn FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 100)")


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be said of any sample: its size, how many records are in it, and that all of them are records of the source."""
    drawn = ops.sample(tables.orders(spark, sf_dir, {"001"}), 50, 7).select(control_number().alias("cn"))
    source = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"))
    return drawn.join(source, F.col("cn") == F.col("key"), "left").agg(F.count("*").alias("n"), F.count_distinct("cn").alias("records"), F.bool_and(F.col("key").isNotNull()).alias("within"))


add("q_sample", _sample, "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS records, true AS within FROM (SELECT * FROM orders LIMIT 50)")
_LINES = """'LDR 00000' || lower(o_orderstatus) || 'a  a2200000   4500' || chr(10) || '001 ' || o_orderkey || chr(10) || '003 TPCH' || chr(10) || '005 ' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '.0' || chr(10)
|| '008 ' || strftime(o_orderdate, '%y%m%d') || lower(o_orderstatus) || chr(10) || '043 $a ' || n_name || chr(10) || '100/1# $a ' || c_name || ' $d ' || c_mktsegment || chr(10) || '490 $a ' || o_orderpriority
|| coalesce((SELECT string_agg(chr(10) || '650 $a ' || l_partkey || ' $b ' || l_suppkey || ' $2 ' || l_returnflag || ' $9 ' || l_linestatus, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) FROM lineitem WHERE l_orderkey = o_orderkey), '')"""
add("q_print", lambda s, d: ops.print_records(tables.orders(s, d)).drop("ord"), f"SELECT {_LINES} AS text FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
add("q_hash", lambda s, d: ops.hash_records(tables.orders(s, d).withColumn("raw", ops.text_column().cast("binary"))), f"SELECT o_orderkey::VARCHAR AS cn, sha256({_LINES}) AS hash FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
add("q_translit", lambda s, d: tables.documents(s, d, {"001", "520"}).select(control_number().alias("cn"), normalized(normalized(F.col("fields")[1]["subfields"][0]["value"], "nfd"), "nfc").alias("text")), "SELECT doc_id::VARCHAR AS cn, nfc_normalize(text) AS text FROM documents")


def _recoded(spark: SparkSession, sf_dir: str, tags: set[str] | None, damage: str | None = None) -> DataFrame:
    """Records as bytes, perhaps damaged, and back."""
    raw = encoded(tables.orders(spark, sf_dir, tags)).select("source", "ord", F.expr("substring(raw, 1, length(raw) - 1)").alias("content"))
    return decoded(raw.withColumn("content", F.expr(damage)) if damage else raw)


add("q_roundtrip", lambda s, d: Query.parse("001, 005, 650{ a, b }").select(_recoded(s, d, None), "cn, date, part, supplier"), f"SELECT o_orderkey::VARCHAR AS cn, strftime(o_orderdate, '%Y%m%d%H%M%S') || '.0' AS date, coalesce(l_partkey::VARCHAR, '') AS part, coalesce(l_suppkey::VARCHAR, '') AS supplier FROM {ITEMS}")
_BROKEN = "CASE WHEN ord % 7 = 0 THEN concat(X'78', substring(content, 2)) WHEN ord % 11 = 0 THEN concat(content, X'78') ELSE content END"
add("q_invalid", lambda s, d: _recoded(s, d, {"001", "490"}, _BROKEN).where("not valid").select("ord", "err"), "SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 7 = 0 THEN 'invalid leader' ELSE 'invalid size' END AS err FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0")

# -- record files -----------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder that all tasks share; it goes with the application."""
    return until_end(spark, f"{shared_dir(spark)}/leafmill/q-{uuid.uuid4().hex}")


def _written(spark: SparkSession, sf_dir: str, tags: set[str], compression: str | None = None, where: str | None = None) -> str:
    """A folder of record files with the orders."""
    path = _folder(spark)
    sinks.write_raw(encoded(ops.where(tables.orders(spark, sf_dir, tags | {"005"}), where)), path, compression)
    return path


def _scan(compression: str | None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan_records(spark, _written(spark, sf_dir, {"001", "650"}, compression), "001, 005[:4], 650{ a, b }", header="cn, year, part, supplier", where='005[:4] < "1997"', mode="FAILFAST")

    return run


_SCAN = f"SELECT o_orderkey::VARCHAR AS cn, strftime(o_orderdate, '%Y') AS year, coalesce(l_partkey::VARCHAR, '') AS part, coalesce(l_suppkey::VARCHAR, '') AS supplier FROM {ITEMS} WHERE o_orderdate < DATE '1997-01-01'"
add("q_scan_file", _scan(None), _SCAN)
add("q_scan_gzip", _scan("gzip"), _SCAN)


def _in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders and one of them again, in the order in which they are given."""
    late, early = (_written(spark, sf_dir, {"001"}, c, w) for c, w in ((None, '005[:4] >= "1997"'), ("gzip", '005[:4] < "1997"')))
    rows = ops.numbered(read_files(spark, [late, early, late])).select("_row", "source", control_number().alias("cn"))
    return rows.groupBy(F.when(F.col("source").contains(early.rsplit("/", 1)[1]), "early").otherwise("late").alias("which"), "cn").agg(F.min("_row").alias("low"), F.max("_row").alias("high")).groupBy("which").agg(
        F.count("*").alias("records"), F.min("low").alias("first"), F.max("low").alias("last"), F.min("high").alias("first_again"), F.max("high").alias("last_again"))


add("q_scan_in_order", _in_order, """
WITH n AS (SELECT count(*) FILTER (WHERE o_orderdate >= DATE '1997-01-01') AS late, count(*) FILTER (WHERE o_orderdate < DATE '1997-01-01') AS early FROM orders)
SELECT 'late' AS which, late AS records, 0 AS first, late - 1 AS last, late + early AS first_again, 2 * late + early - 1 AS last_again FROM n
UNION ALL SELECT 'early', early, late, late + early - 1, late, late + early - 1 FROM n""")


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose records are cut short or damaged, read with what is unreadable."""
    raw = encoded(tables.orders(spark, sf_dir, {"001", "490"})).withColumn("content", F.expr("substring(raw, 1, length(raw) - 1)"))
    broken = raw.withColumn("raw", F.concat(F.expr(_BROKEN), F.lit(b"\x1d")))
    path = _folder(spark)
    sinks.write_raw(broken, path)
    return read_files(spark, path, "PERMISSIVE").groupBy(F.coalesce("err", F.lit("")).alias("err")).agg(F.count("*").alias("n"))


add("q_scan_damaged", _cut, "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'invalid leader' WHEN o_orderkey % 11 = 0 THEN 'invalid size' ELSE '' END AS err, count(*) AS n FROM orders GROUP BY 1")


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.describe(read_files(spark, _written(spark, sf_dir, {"001", "490", "650"})))


add("q_describe_file", _described, """
SELECT '490' AS field, ' ' AS ind1, ' ' AS ind2, 0 AS "2", 0 AS "9", count(*) AS a, 0 AS b FROM orders
UNION ALL SELECT '650', ' ', ' ', count(*), count(*), count(*), count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")


def _table_sink(tsv: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        sinks.write_table(Query.parse("001, 100/1#{ a, d }").select(tables.orders(spark, sf_dir, {"001", "100"}), "cn, name, segment"), path, header=True, tsv=tsv, compression="gzip" if tsv else None)
        return spark.read.schema("cn string, name string, segment string").option("header", True).option("sep", "\t" if tsv else ",").csv(path)

    return run


_TABLE = "SELECT o_orderkey::VARCHAR AS cn, c_name AS name, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey"
add("q_sink_csv", _table_sink(False), _TABLE)
add("q_sink_tsv", _table_sink(True), _TABLE)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts over a stream of record files, after all of them have arrived."""
    from leafmill.streaming.records import stream_frequency, stream_records

    path, name = _written(spark, sf_dir, {"001", "490"}), f"q_{uuid.uuid4().hex}"
    counts = stream_frequency(stream_records(spark, path), "490.a", "priority")
    running = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)


add("q_stream_frequency", _streamed, "SELECT o_orderpriority AS priority, count(*) AS count FROM orders GROUP BY 1")

# -- rules and graphs --------------------------------------------------------------

RULES = """
scope = "ldr.encoding == 'a'"
[rule.R001]
level = "warning"
message = "urgent without items"
matcher = "490.a == '1-URGENT' && !650?"
[rule.R002]
message = "many returns"
matcher = "#650{ 2 == 'R' } > 3"
[rule.R003]
level = "info"
message = "not early"
matcher = "005[:4] < '1998'"
scope = "ldr.status == 'p'"
invert-match = true
"""
add("q_check", lambda s, d: check.check(tables.orders(s, d, {"001", "005", "490", "650"}), [RULES]), """
SELECT o_orderkey::VARCHAR AS cn, 'R001' AS rule, 'warning' AS level, 'urgent without items' AS message FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT l_orderkey::VARCHAR, 'R002', 'error', 'many returns' FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey HAVING sum((l_returnflag = 'R')::INT) > 3
UNION ALL SELECT o_orderkey::VARCHAR, 'R003', 'info', 'not early' FROM orders WHERE o_orderstatus = 'P' AND NOT strftime(o_orderdate, '%Y') < '1998'""")
GRAPH = """
scope = "ldr.type == 'a'"
uri = { base-uri = "http://example.org/order/", path = "001" }
[concept.order]
labels = [ { kind = "preferred", path = "490.a" }, { kind = "alternative", path = "100/1#.a" }, { kind = "hidden", path = "650.2" } ]
"""
SETS = GRAPH + """
[collections.part]
uri = { base-uri = "http://example.org/part/", path = "650.a" }
min = 5
max = 40
scope = "490.a == '1-URGENT'"
"""
_S = "'<http://example.org/order/' || o_orderkey || '>'"
GRAPH_SQL = f"""
SELECT {_S} AS s, '<{skos.RDF}type>' AS p, '<{skos.SKOS}Concept>' AS o FROM orders
UNION SELECT {_S}, '<{skos.SKOS}prefLabel>', '"' || o_orderpriority || '"' FROM orders
UNION SELECT {_S}, '<{skos.SKOS}altLabel>', '"' || c_name || '"' FROM orders JOIN customer ON o_custkey = c_custkey
UNION SELECT {_S}, '<{skos.SKOS}hiddenLabel>', '"' || l_returnflag || '"' FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""
_URGENT = "FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'"
_KEPT = f"SELECT l_partkey {_URGENT} GROUP BY l_partkey HAVING count(*) BETWEEN 5 AND 40"
_P = "'<http://example.org/part/' || l_partkey || '>'"
add("q_skosify", lambda s, d: skos.skosify(tables.orders(s, d, {"001", "100", "490", "650"}), GRAPH), GRAPH_SQL)
add("q_skosify_collections", lambda s, d: skos.skosify(tables.orders(s, d, {"001", "100", "490", "650"}), SETS), GRAPH_SQL + f"""
UNION SELECT {_P}, '<{skos.RDF}type>', '<{skos.SKOS}Collection>' FROM ({_KEPT})
UNION SELECT {_P}, '<{skos.RDF}member>', {_S} {_URGENT} AND l_partkey IN ({_KEPT})""")
add("q_turns", lambda s, d: Query.parse("001, 700{ n, a }").select(tables.turns(s, d), "cn, turn, role"), "SELECT conv_id::VARCHAR AS cn, turn::VARCHAR AS turn, role FROM conversations")
add("q_pages", lambda s, d: Query.parse("001, 856/40.u").select(tables.pages(s, d), "cn, url"), "SELECT page_id::VARCHAR AS cn, url FROM pages")
