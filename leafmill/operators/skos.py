"""Records as SKOS: concepts with labels, and collections of concepts."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import normalized
from leafmill.operators.project import Matcher, Path
from leafmill.plans.compiler import any_of
from leafmill.sources.shared import releasing, reused

# Vocabularies and kinds of labels.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
LABELS = {"preferred": "prefLabel", "alternative": "altLabel", "hidden": "hiddenLabel"}


@dataclass(frozen=True)
class Uri:
    path: Path
    base: str = ""

    @classmethod
    def parse(cls, said: dict) -> Uri:
        return cls(Path.parse(said["path"]), said.get("base-uri", ""))

    def first(self) -> Column:
        return F.concat(F.lit(self.base), self.path.first())

    def values(self) -> Column:
        return F.transform(self.path.values(), lambda v: F.concat(F.lit(self.base), v))


@dataclass(frozen=True)
class Concept:
    labels: tuple[tuple[str, Path], ...]
    scope: Matcher | None = None


@dataclass(frozen=True)
class Collection:
    uri: Uri
    least: int = 0
    most: int = 0
    scope: Matcher | None = None


@dataclass(frozen=True)
class Graph:
    """What a configuration says about the graph."""

    uri: Uri
    concepts: dict[str, Concept] = field(default_factory=dict)
    collections: dict[str, Collection] = field(default_factory=dict)
    scope: Matcher | None = None
    translit: str | None = None
    pretty: bool = True

    @classmethod
    def parse(cls, text: str) -> Graph:
        said = tomllib.loads(text)

        def scope(own: dict) -> Matcher | None:
            return Matcher.parse(own["scope"]) if own.get("scope") else None

        concepts = {k: Concept(tuple((x["kind"], Path.parse(x["path"])) for x in own.get("labels", [])), scope(own)) for k, own in (said.get("concept", {}) | said.get("group", {})).items()}
        for own in concepts.values():
            for kind, _ in own.labels:
                if kind not in LABELS:
                    raise ValueError(f"unknown kind of label: {kind}")
        collections = {k: Collection(Uri.parse(own["uri"]), own.get("min", 0), own.get("max", 0), scope(own)) for k, own in (said.get("collections", {}) | said.get("collection", {})).items()}
        return cls(Uri.parse(said["uri"]), concepts, collections, scope(said), said.get("translit"), said.get("pretty", True))


def _label(value: Column, translit: str | None) -> Column:
    return normalized(value, translit) if translit else value


def skosify(records: DataFrame, config: str | Graph, unique: bool = True) -> DataFrame:
    """The graph as a set of triples s, p, o; o is ``<address>`` or ``"text"``.

    One pass over the records makes all labels and memberships; these rows are kept as long as the result, because collections are
    counted (with partial sums) before they are joined back to their members.  unique: two records of the same subject are an error."""
    graph = config if isinstance(config, Graph) else Graph.parse(config)
    if graph.scope is not None:
        records = records.where(graph.scope.column())

    def iri(value: Column | str) -> Column:
        return F.concat(F.lit("<"), F.lit(value) if isinstance(value, str) else value, F.lit(">"))

    def within(scope: Matcher | None, values: Column) -> Column:
        return values if scope is None else F.when(scope.column(), values).otherwise(F.array().cast("array<string>"))

    def labelled(values: Column, kind: str) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(SKOS + LABELS[kind]).alias("p"), v.alias("v")))

    def membership(values: Column, number: int) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(number).alias("c"), none.alias("p"), v.alias("v")))

    none = F.lit(None).cast("string")
    kinds = [labelled(within(own.scope, path.values()), kind) for own in graph.concepts.values() for kind, path in own.labels]
    sets = {name: within(own.scope, own.uri.values()) for name, own in graph.collections.items()}
    labels = F.concat(*kinds) if kinds else F.array().cast("array<struct<p:string,v:string>>")
    kind = F.struct(F.lit(f"{RDF}type").alias("p"), none.alias("v"))
    rows = [F.transform(F.concat(F.array(kind), labels), lambda x: F.struct(F.lit(-1).alias("c"), x["p"].alias("p"), x["v"].alias("v")))]
    rows += [membership(values, i) for i, values in enumerate(sets.values())]
    told = records.select(graph.uri.first().alias("s"), F.explode(F.concat(*rows)).alias("l")).where("s is not null").select("s", "l.*")
    told = reused(told) if sets else told
    concept, text = iri(SKOS + "Concept"), F.concat(F.lit('"'), _label(F.col("v"), graph.translit), F.lit('"'))
    out = told.where("c < 0") if sets else told
    out = out.select(iri(F.col("s")).alias("s"), iri(F.col("p")).alias("p"), F.when(F.col("v").isNull(), concept).otherwise(text).alias("o"))
    if sets:
        members = told.where("c >= 0").select("c", "v", "s")
        sizes = members.groupBy("c", "v").agg(F.count("*").alias("n"))
        bounds = [(F.col("c") == i) & (F.col("n") >= own.least) & ((F.col("n") <= own.most) if own.most else F.lit(True)) for i, own in enumerate(graph.collections.values())]
        sizes = sizes.where(any_of(bounds)).select("c", "v")
        out = out.union(sizes.select(iri(F.col("v")), F.lit(f"<{RDF}type>"), iri(SKOS + "Collection")))
        out = out.union(members.join(sizes, ["c", "v"]).select(iri(F.col("v")), F.lit(f"<{RDF}member>"), iri(F.col("s"))))
    used = [told] if sets else []
    if not unique:
        return releasing(out.toDF("s", "p", "o").distinct(), *used)
    # making the graph a set counts its triples, so a subject that stands twice shows without another pass
    counted = out.toDF("s", "p", "o").groupBy("s", "p", "o").agg(F.count("*").alias("n"))
    error = F.raise_error(F.concat(F.lit("the graph already contains a concept with address "), F.col("s"))).cast("string")
    return releasing(counted.select(F.when((F.col("o") == concept) & (F.col("n") > 1), error).otherwise(F.col("s")).alias("s"), "p", "o"), *used)


def escaped(term: Column) -> Column:
    """A literal with its quotes, backslashes and line ends escaped; addresses as they are."""
    inner = F.expr("substring(o, 2, char_length(o) - 2)")
    for raw, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        inner = F.replace(inner, F.lit(raw), F.lit(mark))
    return F.when(term.startswith('"'), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(term)


def ntriples(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat(F.concat_ws(" ", "s", "p", escaped(F.col("o"))), F.lit(" .")).alias("line"))


def turtle(triples: DataFrame, most: int = 10_000) -> DataFrame:
    """Blocks of a subject, its predicates and objects in order; a subject of more than ``most`` triples has several blocks."""
    own = triples.select("s", "p", escaped(F.col("o")).alias("o"))
    large = own.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > most).withColumnRenamed("s", "_of")
    part = F.coalesce(F.pmod(F.xxhash64("p", "o"), F.ceil(F.col("n") / most)), F.lit(0))
    own = own.join(large, F.col("s") == F.col("_of"), "left").withColumn("part", part)
    objects = own.groupBy("s", "part", "p").agg(F.array_join(F.sort_array(F.collect_set("o")), ", ").alias("objects"))
    blocks = objects.groupBy("s", "part").agg(F.sort_array(F.collect_list(F.concat_ws(" ", "p", "objects"))).alias("said"))
    return blocks.select(F.concat(F.col("s"), F.lit(" "), F.array_join("said", " ;\n    "), F.lit(" .")).alias("block"))
