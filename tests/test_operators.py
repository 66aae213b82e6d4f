import pytest
from pyspark.sql import functions as F

from leafmill.operators import aggregates, check, records as ops, skos
from leafmill.operators.project import control_number
from leafmill.sources.scan import from_bytes
from tests.records import CHART, encoded

TEXTS = [CHART, CHART.replace("MP-4471", "2"), "001 2\n110/2# $a Other\n052 $a x", "100 $a no number", "001 5"]


@pytest.fixture(scope="module")
def some(spark):
    return from_bytes(spark, b"".join(map(encoded, TEXTS))).cache()


def numbers(frame):
    return [r[0] for r in frame.orderBy("ord").select(control_number()).collect()]


def test_where_limit_filter_grep(some):
    assert numbers(ops.where(some, "001?", 2)) == ["MP-4471", "2"]
    assert numbers(ops.filter_records(some, "110/2#?", limit=2)) == ["MP-4471", "2"]
    assert numbers(ops.filter_records(some, "110/2#?", invert=True)) == [None, "5"]
    assert numbers(ops.grep(some, "^Other$", ["Bælt"])) == ["MP-4471", "2", "2"]
    assert numbers(ops.grep(some, "OTHER", ignore_case=True)) == ["2"]
    assert numbers(ops.grep(some, "a", invert=True)) == ["2", None, "5"]


def test_dedup_split_partition_concat(some):
    assert numbers(ops.dedup(some)) == ["MP-4471", "2", "5"]
    assert [r.chunk for r in ops.split(some, 2).orderBy("ord").collect()] == [0, 0, 1, 1, 2]
    parts = ops.partition(some, "052.a").select("value", "ord").collect()
    assert sorted(map(tuple, parts)) == [("6920", 0), ("6920", 1), ("6924", 0), ("6924", 1), ("x", 2)]
    assert ops.partition(some, "052{ _ }").count() == 0
    assert ops.concat(some, some).count() == 10
    assert ops.sample(some, 3, 1).count() == 3 and ops.sample(some, 30).count() == 5


def test_frequency(some):
    def rows(**options):
        return list(map(tuple, aggregates.frequency(some, "052.2", **options).collect()))

    assert rows() == [("grid", 4)] and rows(unique=True) == [("grid", 2)]
    two = aggregates.frequency(some, "052.a", reverse=True, header="v")
    assert list(map(tuple, two.collect())) == [("x", 1), ("6920", 2), ("6924", 2)]
    assert list(map(tuple, aggregates.frequency(some, "052.a", threshold=2, num=1).collect())) == [("6920", 2)]


def test_describe_and_glimpse(some):
    table = aggregates.describe(some.where("ord = 0"))
    assert table.columns == ["field", "ind1", "ind2", "2", "4", "5", "9", "a", "b", "c", "h", "i", "u", "v", "x"]
    row = table.where("field = '490'").first().asDict()
    assert (row["a"], row["v"], row["x"], row["2"]) == (1, 2, 2, 0)
    assert aggregates.describe(some.where("ord = 4")).count() == 0
    found = aggregates.glimpse(some, "041/0#.*", 1)
    assert {r.code: r["values"] for r in found.collect()} == {"a": ["dan"], "h": ["nor"]}
    assert [r.line for r in aggregates.glimpse_lines(aggregates.glimpse(some, "700/1#{ a | 4 == 'egr' }")).collect()] == ["$a Frost, Clara, Frost, Clara"]
    assert aggregates.glimpse(some, "001").count() == 0


def test_hash_print(some):
    import hashlib

    got = {r.cn: r.hash for r in ops.hash_records(some).collect()}
    assert got["5"] == hashlib.sha256(encoded("001 5")).hexdigest() and "" in got
    text = ops.print_records(some).orderBy("ord").first().text
    assert text.split("\n")[1:] == CHART.split("\n")
    assert ops.print_records(some, "nfd").count() == 5


def test_check(some):
    rules = """
    [rule.A]
    matcher = "052?"
    message = "has one"
    level = "info"
    [rule.B]
    filter = "001?"
    scope = "110/2#?"
    invert-matcher = true
    """
    assert sorted(map(tuple, check.check(some, [rules]).collect())) == [("2", "A", "info", "has one"), ("2", "A", "info", "has one"), ("MP-4471", "A", "info", "has one")]
    assert check.check(some, [""]).count() == 0
    assert '"type":"A"' in check.report_json(check.check(some, [rules])).first().line
    assert check.report_text(check.check(some, [rules])).count() == 3
    with pytest.raises(ValueError):
        check.RuleSet.parse("[rule.A]\nmatcher='001?'\nlevel='fatal'")


def test_skosify(some):
    config = """
    uri = { base-uri = "http://e/", path = "001" }
    [group.person]
    scope = "110/2#?"
    labels = [ { kind = "preferred", path = "110/2#.a" }, { kind = "alternative", path = "246/3#.a" } ]
    [collections.code]
    uri = { path = "052.a" }
    min = 1
    max = 1
    """
    graph = skos.skosify(some.where("ord in (0, 2, 4)"), config)
    triples = set(map(tuple, graph.collect()))
    assert ("<http://e/2>", f"<{skos.SKOS}prefLabel>", '"Other"') in triples and ("<x>", f"<{skos.RDF}member>", "<http://e/2>") in triples
    assert len([t for t in triples if t[2] == f"<{skos.SKOS}Concept>"]) == 3 and len([t for t in triples if t[1].endswith("altLabel>")]) == 3
    assert any(r.line.endswith('"Other" .') for r in skos.ntriples(graph).collect()) and skos.turtle(graph).count() == 6
    with pytest.raises(Exception, match="already contains"):
        skos.skosify(some, config).collect()


def test_large_subjects_in_blocks(spark):
    rows = spark.createDataFrame([("<s>", "<p>", f"<o{i}>") for i in range(100)] + [("<t>", "<p>", "<o>")], "s string, p string, o string")
    blocks = [r.block for r in skos.turtle(rows, 20).collect()]
    assert len(blocks) > 3 and sorted(o for b in blocks for o in b.removesuffix(" .").split("<p> ")[1].split(", ") if b.startswith("<s>")) == sorted(f"<o{i}>" for i in range(100))
    assert len(skos.turtle(rows).collect()) == 2


def test_escapes(spark):
    rows = spark.createDataFrame([("<s>", "<p>", '"a"b\\c\n"'), ("<s>", "<p>", "<o>")], "s string, p string, o string")
    assert sorted(r.line for r in skos.ntriples(rows).collect()) == ['<s> <p> "a\\"b\\\\c\\n" .', "<s> <p> <o> ."]


def test_similarity(spark):
    from leafmill.functions.text import byte_slice, similarity

    row = spark.sql("SELECT '' AS e, 'Äda' AS a").select(similarity(F.col("e"), ""), similarity(F.col("a"), "Ada"), byte_slice(F.col("a"), 2), byte_slice(F.col("a"), 0, 9), byte_slice(F.col("a"), 3, 1)).first()
    assert tuple(row) == (1.0, pytest.approx(2 / 3), "da", "", "")
