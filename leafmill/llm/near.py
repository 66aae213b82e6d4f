"""MinHash near-duplicates: one-permutation hashing, optimal densification, bands, star-shaped candidates.

1. ``signatures``: every document's set of word shingles as distinct 64-bit hashes (of lower-cased words, by
   prefix sums over whole columns).  One permutation: the top bits of a hash are its bin, the smallest hash of
   a bin its value.  Empty bins borrow from a full bin that a random sequence of their own picks (optimal
   densification), so small sets keep the collision probability of MinHash.  A digest of the set stands for
   exact copies.
2. Exact copies become one class, with a number, before anything else is compared; a group of thousands costs one row.
3. Bands of the classes are counted per bucket.  Each bucket links its members to two centres, its
   most popular member (the one whose buckets are largest) and its smallest number: at most two candidates a member
   and bucket, never all pairs.  Candidates are confirmed on the full sets.
4. What stars can miss, links between two members neither of which is a centre, matters only where members of
   one bucket are still in different components.  Those members go through an exact prefix join: rarest
   shingles first, only as many as a link must share one of, with bounds on sizes and positions.  Components meet by
   shingle before their members do, so members of one component are never compared.  So no cap on
   a bucket is needed and no candidate of a bucket is lost.
5. Classes that share an id are linked.  Links are between the smallest ids of classes; components by alternating stars,
   each named by the smallest id in it.

With 32 bands of 4 bins a pair of similarity 0.8 misses all buckets with a probability of 5e-8.

Scale: sets are never shuffled but for members of candidate pairs.  Aggregates have partial sums; the joins are
plain equi-joins of two shuffled sides, whose hot keys Spark splits.  Nothing but counts comes to the driver.

Defined results.  Null or empty text, or white space only: n_shingles 0, linked with nothing, kept.  Null id: counted,
linked with nothing, component null, kept.  Repeated rows and ties: rows of one id are one document, so all of them that have words
share a component, and what is linked to one is linked to all; the smallest id of a component is kept.  Empty table: no
rows.  Very long texts: one document is worked on alone.  Input columns besides doc_id and text are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.arrays import U64, chunks, distinct_sorted, lean, mixed, shingles
from leafmill.llm.common import discard, kept, saved, scratch, ship, table
from leafmill.llm.graphs import components

BINS, BAND = 128, 4
SIMILARITY = (4, 5)  # as a fraction
_TRIES = 512


@lru_cache(maxsize=1)
def _detours() -> np.ndarray:
    """For each attempt and bin, the bin to borrow from: a fixed random function."""
    at = np.arange(_TRIES * BINS, dtype=U64).reshape(_TRIES, BINS)
    return (mixed(at + U64(0x5851F42D4C957F2D)) % U64(BINS)).astype(np.int64)


def densified(values: np.ndarray, full: np.ndarray) -> np.ndarray:
    """``values`` (documents x bins) with every empty bin filled from a full one; rows without any stay."""
    out, some = values.copy(), full.any(axis=1)
    doc, at = np.nonzero(~full & some[:, None])
    for row in _detours():
        if not len(doc):
            return out
        found = full[doc, row[at]]
        out[doc[found], at[found]] = values[doc[found], row[at[found]]]
        doc, at = doc[~found], at[~found]
    for step in range(1, BINS):  # the next full bin, for what 512 attempts have missed
        found = full[doc, (at + step) % BINS]
        out[doc[found], at[found]] = values[doc[found], (at[found] + step) % BINS]
        doc, at = doc[~found], at[~found]
    return out


def band_keys(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Bucket keys (documents x bands) of sets given one after the other in ascending order."""
    docs = len(begin) - 1
    doc = np.repeat(np.arange(docs), np.diff(begin))
    where = (sets >> U64(57)).astype(np.int64)
    first = np.ones(len(sets), bool)
    first[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    values, full = np.zeros((docs, BINS), U64), np.zeros((docs, BINS), bool)
    values[doc[first], where[first]] = sets[first]
    full[doc[first], where[first]] = True
    values = densified(values, full)
    keys = np.broadcast_to(np.arange(BINS // BAND, dtype=U64), (docs, BINS // BAND)).copy()
    for i in range(BAND):
        keys = mixed(keys * U64(0xD1342543DE82EF95) + values[:, i::BAND])
    return keys


def _digests(sets: np.ndarray, begin: np.ndarray) -> list[bytes | None]:
    """A digest of each set; sets are equal where digests are."""
    return [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Rows doc_id, n_shingles, set_key (null without shingles), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch.column(1)):
                sets, begin = distinct_sorted(*shingles(piece, k), len(piece))
                keys, count = band_keys(sets, begin).view(np.int64), np.diff(begin)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)), pa.array(count, pa.int64()), pa.array(_digests(sets, begin), pa.binary()), bands], ["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """Rows doc_id, set_key, shingles (distinct, as numbers in ascending order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch.column(1)):
                sets, begin = distinct_sorted(*shingles(piece, k), len(piece))
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)), pa.array(_digests(sets, begin), pa.binary()), lists], ["doc_id", "set_key", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, set_key binary, shingles array<long>")


def _close(a: Column, b: Column) -> Column:
    """Whether two sets of these sizes can reach the similarity at all."""
    return SIMILARITY[1] * F.least(a, b) >= SIMILARITY[0] * F.greatest(a, b)


def _needed(a: Column, b: Column) -> Column:
    """The overlap that two sets of these sizes need."""
    return F.ceil(SIMILARITY[0] * (a + b) / F.lit(float(sum(SIMILARITY))))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of classes those whose full sets reach the similarity, as pairs of their smallest ids."""
    left = sets.select(F.col("rep").alias("a"), F.col("first_id").alias("id_a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("first_id").alias("id_b"), F.col("shingles").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(SIMILARITY[1] * common >= SIMILARITY[0] * (F.size("set_a") + F.size("set_b") - common)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def _pairs(left: Column, right: Column) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def star_pairs(members: DataFrame) -> DataFrame:
    """Members (key, rep, n) of the buckets -> distinct candidate pairs (a, b) of each member with two centres."""
    sizes = members.groupBy("key").agg(F.count("*").alias("held"))
    popular = members.join(sizes, "key").groupBy("rep").agg(F.sum("held").alias("fame"))
    ranked = members.join(popular, "rep")
    centres = ranked.groupBy("key").agg(
        F.max(F.struct("fame", (-F.col("rep")).alias("order"), F.struct("rep", "n").alias("who")))["who"].alias("one"),
        F.min(F.struct("rep", "n")).alias("two"))
    linked = members.join(centres, "key").select("rep", "n", F.explode(F.array("one", "two")).alias("centre"))
    linked = linked.where((F.col("rep") != F.col("centre.rep")) & _close(F.col("n"), F.col("centre.n")))
    return linked.select(*_pairs(F.col("rep"), F.col("centre.rep"))).distinct()


def rest_pairs(spark: SparkSession, members: DataFrame, found: DataFrame, sets: DataFrame, count: int) -> DataFrame:
    """Candidate pairs in buckets that hold more than one component, by an exact prefix join over their members.

    A shingle that m members of one component and a single outsider share costs m pairs, not m * m: components meet first."""
    placed = members.join(found, "rep")
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    left_over = placed.join(split, "key").select("rep", "n", "component").distinct()
    tokens = left_over.join(sets, "rep").select("rep", "n", "component", F.explode("shingles").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("docs")).where("docs > 1")
    # a shingle of one document alone comes first in its order and pairs with nothing: only its number counts
    kept = tokens.join(common, "token")
    lists = kept.groupBy("rep", "n", "component").agg(F.sort_array(F.collect_list(F.struct("docs", "token"))).alias("kept"))
    alone = F.col("n") - F.size("kept")
    reach = F.col("n") - F.ceil(F.col("n") * SIMILARITY[0] / F.lit(float(SIMILARITY[1]))) + 1 - alone
    prefix = lists.where(reach > 0).select("rep", "n", "component", alone.alias("alone"), F.posexplode(F.slice("kept", F.lit(1), reach.cast("int"))).alias("at", "entry"))
    prefix = prefix.select("rep", "n", "component", (F.col("alone") + F.col("at")).alias("place"), F.col("entry.token").alias("token"))
    prefix = saved(spark, prefix, "near-prefix", count, 5_000)
    groups = prefix.groupBy("token", "component").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("place")).alias("room"))
    g, h = groups.alias("g"), groups.alias("h")
    # components whose sizes and positions come close enough for some of their members; for single members that is the whole test
    apart = (F.col("g.token") == F.col("h.token")) & (F.col("g.component") < F.col("h.component"))
    reaching = (SIMILARITY[1] * F.col("g.high") >= SIMILARITY[0] * F.col("h.low")) & (SIMILARITY[1] * F.col("h.high") >= SIMILARITY[0] * F.col("g.low"))
    roomy = F.least(F.col("g.room"), F.col("h.room")) >= _needed(F.col("g.low"), F.col("h.low"))
    met = g.join(h, apart & reaching & roomy).select(F.col("g.token").alias("token"), F.col("g.component").alias("one"), F.col("h.component").alias("two"))

    def side(name: str, component: str) -> DataFrame:
        return prefix.select("token", F.col("component").alias(component), F.struct("rep", "n", "place").alias(name))

    both = met.join(side("x", "one"), ["token", "one"]).join(side("y", "two"), ["token", "two"])
    able = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= _needed(F.col("x.n"), F.col("y.n"))
    return both.where(_close(F.col("x.n"), F.col("y.n")) & able).select(*_pairs(F.col("x.rep"), F.col("y.rep"))).distinct()


def same_id_links(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the smallest ids of the classes of rows that share an id."""
    rows = signed.where("set_key is not null and doc_id is not null").select("doc_id", "set_key")
    sign = F.xxhash64("set_key")  # a number, so that its extremes have partial sums without a sort
    twice = rows.groupBy("doc_id").agg(F.min(sign).alias("least"), F.max(sign).alias("most")).where("least < most").select("doc_id")
    held = rows.join(twice, "doc_id").join(classes, "set_key").select("doc_id", F.col("first_id").alias("a")).distinct()
    least = held.groupBy("doc_id").agg(F.min("a").alias("b"))
    return held.join(least, "doc_id").where("a > b").select("a", "b").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5) -> DataFrame:
    """Each row of ``docs`` as doc_id, n_shingles, component_id, kept."""
    ship(spark)
    signed = saved(spark, signatures(docs, k), "near-signed")
    count = signed.count()
    classes = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("first_id"))
    # the numbers are written down, so they stay what they are
    classes = saved(spark, classes.withColumn("rep", F.monotonically_increasing_id()), "near-classes", count)
    reps = signed.join(classes, (signed["doc_id"] == classes["first_id"]) & (signed["set_key"] == classes["set_key"]))
    rows = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key")).distinct()
    shared = rows.groupBy("key").agg(F.count("*").alias("held")).where("held > 1").select("key")
    members = saved(spark, rows.join(shared, "key").select("key", "rep", "n"), "near-members", count * BINS // BAND)
    asked = members.select("rep").distinct().join(classes, "rep").select(F.col("first_id").alias("doc_id"), "set_key", "rep")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = full_sets(texts, k).join(asked, ["doc_id", "set_key"]).groupBy("rep").agg(F.first("doc_id").alias("first_id"), F.first("shingles").alias("shingles"))
    sets = saved(spark, sets, "near-sets", count, 5_000)
    links = saved(spark, confirmed(star_pairs(members), sets), "near-links", count, 5_000)
    found = components(spark, links, links.count())

    def placed(found: DataFrame) -> DataFrame:
        return classes.join(found, classes["first_id"] == found["vertex"], "left").select("set_key", "rep", F.coalesce("component", "first_id").alias("component"))

    with scratch(spark):
        more = confirmed(rest_pairs(spark, members, placed(found).drop("set_key"), sets, count), sets).union(same_id_links(signed, classes))
        more = kept(saved(spark, more, "near-rest", count, 5_000))
    discard(spark, members, sets, links)
    if extra := more.count():
        both = found.select(F.col("vertex").alias("a"), F.col("component").alias("b")).union(more)
        found = components(spark, both, found.count() + extra)
    named = placed(found).select("set_key", F.col("component").alias("component_id"))
    out = signed.drop("bands").join(named, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), k=4)


def without_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5) -> DataFrame:
    """``docs``, all columns, with one document of each component.

    The document with the smallest id stays; of rows that repeat both id and text one stays.  An id that two different
    texts share stays if one of its rows does.  Rows without an id stay."""
    told = saved(spark, near_duplicates(spark, docs, k), "near-told")
    gone = told.groupBy("doc_id").agg(F.max(F.col("kept").cast("int")).alias("stays"), F.count("*").alias("n"))
    gone = saved(spark, gone.where("doc_id is not null and (stays = 0 or n > 1)"), "near-gone", told.count())
    discard(spark, told)
    dropped = gone.where("stays = 0").select(F.col("doc_id").alias("near_id"))
    out = docs.join(dropped, docs["doc_id"].cast("long") == dropped["near_id"], "left_anti")
    twice = gone.where("stays = 1").select(F.col("doc_id").alias("near_id"))
    if twice.isEmpty():
        return out
    same = out["doc_id"].cast("long") == twice["near_id"]
    return out.join(twice, same, "left_anti").unionByName(out.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
