"""Secret scans with corpus-wide ownership frequency.

``find`` marks candidates in whole texts.  Base kinds are assignments, access keys and runs of hexadecimal digits; further
kinds are tokens of known providers, private keys, credentials in addresses and long mixed strings.  Of every candidate
only a hash of its value travels.  ``ownership`` counts, for each hash, the distinct repositories and owners that hold it.
A value that more than ``OWNERS`` owners share, or that stands in more than ``REPOSITORIES`` repositories whoever owns them, is an
example or a template that was copied around; one that stays with an owner looks live.
``judged`` brings the verdict back to each document.  All base spans stay; a further span is reported only if it looks live and
touches no base span.  ``redact`` replaces what looks live in the text.

Here a source is an owner and each language within a source a repository.

Scale: only candidates are shuffled.  A hash that a third of all documents hold is made distinct with its owner before it
moves, and the join back is on an equi-key that Spark may split.  A document's own spans are brought together, nothing larger.

Defined results.  Null or empty text: no spans.  Null source: an owner of its own.  Rows count by themselves even if ids are null
or repeated.  Empty table: no rows.  ``redact`` keeps all columns of its input, which travel in a struct, whatever their names."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.arrays import lean
from leafmill.llm.common import saved, ship, table

BASE = ("assign", "access", "hex")
FURTHER = ("provider", "key", "address", "mixed")
KINDS = (*BASE, *FURTHER)
OWNERS, REPOSITORIES = 2, 6
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
PROVIDER = re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|[rs]k_live_[0-9A-Za-z]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]+)", re.ASCII)
KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}?-----END")
ADDRESS = re.compile(r"://[^\s/:@]+:([^\s/:@]{6,})@")
MIXED = re.compile(r"[A-Za-z0-9+/_-]{24,}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
SPAN = "struct<start:int,kind:int,stop:int,value:string>"


def _bits(text: str) -> float:
    """Shannon entropy of the characters, in bits."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) of all candidates, by start and kind."""
    found = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    more = [(m.start(), 3, m.end(), m.group()) for m in PROVIDER.finditer(text)]
    if "-----BEGIN" in text:
        more += [(m.start(), 4, m.end(), m.group()) for m in KEY.finditer(text)]
    if "://" in text:
        more += [(m.start(1), 5, m.end(1), m.group(1)) for m in ADDRESS.finditer(text)]
    more += [(m.start(), 6, m.end(), m.group()) for m in MIXED.finditer(text) if _DIGIT.search(m.group()) and _LETTER.search(m.group()) and _bits(m.group()) >= 3.5]
    if more:
        taken = Taken((start, end) for start, _, end, _ in found)
        found += [span for span in sorted(more, key=lambda x: (x[1], x[0])) if taken.free(span[0], span[2])]
    return sorted(found)


class Taken:
    """Intervals that are taken, disjoint and in order; looking one up takes a binary search."""

    def __init__(self, spans: Iterable[tuple[int, int]]) -> None:
        self.starts, self.ends = [], []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(end, self.ends[-1])
            else:
                self.starts.append(start), self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        """Whether nothing of start:end is taken; if so, it is now."""
        i = bisect_right(self.starts, start)
        if i and self.ends[i - 1] > start or i < len(self.starts) and self.starts[i] < end:
            return False
        self.starts.insert(i, start), self.ends.insert(i, end)
        return True


def find(docs: DataFrame, kept: list[str], owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Each row as ``row`` (a struct of the columns ``kept``), _sec_owner, _sec_repo, _sec_spans (start, kind, stop, hash of the value)."""
    ship(docs.sparkSession)
    owners = F.coalesce(F.concat(F.lit("="), F.col(f"`{owner}`").cast("string")), F.lit(""))
    repo = F.to_json(F.array(*(F.col(f"`{c}`").cast("string") for c in repository)))
    own = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    plan = docs.select(own, owners.alias("_sec_owner"), repo.alias("_sec_repo"), F.col("text").cast("string").alias("_sec_text"))
    rest = plan.drop("_sec_text").schema
    shape = T.StructType([*rest.fields, T.StructField("_sec_spans", T.DataType.fromDDL(f"array<{SPAN}>"))])
    spans = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py() or ""
                made.append([{"start": s, "kind": k, "stop": e, "value": hashlib.sha256(v.encode("utf-8", "replace")).hexdigest()[:32]} for s, k, e, v in candidates(text)])
            names = [f.name for f in batch.schema][:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, spans)], [*names, "_sec_spans"])

    return plan.mapInArrow(lean(run), shape)


def ownership(found: DataFrame) -> DataFrame:
    """Rows value, owners, repositories: how many distinct ones hold each candidate."""
    each = found.select("_sec_owner", "_sec_repo", F.explode("_sec_spans.value").alias("value")).distinct()
    per_owner = each.groupBy("value", "_sec_owner").agg(F.count("*").alias("n"))
    return per_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def judged(spark: SparkSession, found: DataFrame) -> DataFrame:
    """``found``, which must have a unique _sec_row, with _sec_live and _sec_copied: its spans by verdict."""
    spans = found.where(F.size("_sec_spans") > 0).select("_sec_row", F.explode("_sec_spans").alias("span"))
    told = spans.withColumn("value", F.col("span.value")).join(ownership(found), "value")
    live = (F.col("owners") <= OWNERS) & (F.col("repositories") <= REPOSITORIES)
    lists = told.groupBy("_sec_row").agg(F.collect_list(F.when(live, F.col("span"))).alias("live"), F.collect_list(F.when(~live, F.col("span"))).alias("copied"))
    lists = lists.withColumnRenamed("_sec_row", "_sec_at")
    none = F.array().cast(f"array<{SPAN}>")
    out = found.join(lists, found["_sec_row"] == lists["_sec_at"], "left")
    return out.withColumn("_sec_live", F.coalesce("live", none)).withColumn("_sec_copied", F.coalesce("copied", none)).drop("live", "copied", "_sec_at")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = saved(spark, find(docs, ["doc_id"]).withColumn("_sec_row", F.monotonically_increasing_id()), "secrets")
    told = judged(spark, found)
    base = F.filter("_sec_spans", lambda s: s["kind"] < len(BASE))
    more = F.filter("_sec_live", lambda s: s["kind"] >= len(BASE))
    counts = [_count("_sec_spans", i).alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    return told.select("row.doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.concat(base, more)).alias("spans"), F.size("_sec_live").cast("long").alias("n_live"), F.size("_sec_copied").cast("long").alias("n_copied"))


MARK = "[secret]"


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with everything that looks live replaced by a mark, n_chars set anew where it is a column."""
    names = docs.columns
    found = saved(spark, find(docs, names).withColumn("_sec_row", F.monotonically_increasing_id()), "secrets")
    clean = found.where(F.size("_sec_spans") == 0).select("row.*")
    told = judged(spark, found.where(F.size("_sec_spans") > 0)).select("row", "_sec_live")
    shape = docs.schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = batch.column(0).flatten(), []
            for text, spans in zip(columns[at].to_pylist(), batch.column(1).to_pylist()):
                out, last = [], 0
                for span in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
                    if span["stop"] > last:
                        out += [text[last : max(last, span["start"])], MARK]
                        last = span["stop"]
                texts.append("".join([*out, text[last:]]) if spans else text)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    cut = told.mapInArrow(lean(run), shape)
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(shape["n_chars"].dataType)))
    return clean.unionByName(cut)
