"""Records as ISO 2709 bytes, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.sources.model import settled

FIELD_MOST, RECORD_MOST = 9_999, 99_999


def _bytes(text: Column) -> Column:
    """A character for each byte of a text; ASCII is as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.decode(text.cast("binary"), "ISO-8859-1"))


def encoded(records: DataFrame, strict: bool = True) -> DataFrame:
    """``records`` with ``raw`` made from leader and fields.

    A field holds 9,999 bytes and a record 99,999 at most; what does not fit ends the job (strict) or gets a null."""

    def body(f: Column) -> Column:
        subs = F.array_join(F.transform(f["subfields"], lambda s: F.concat(F.lit("\x1f"), s["code"], _bytes(s["value"]))), "")
        text = F.when(f["subfields"].isNull(), _bytes(f["value"])).otherwise(F.concat(f["ind1"], f["ind2"], subs))
        return F.concat(text, F.lit("\x1e"))

    rows = settled(records, _b=F.transform("fields", body))
    rows = settled(rows, _s=F.transform(F.arrays_zip("fields.tag", "_b"), lambda e: F.struct(e["tag"].alias("tag"), F.length(e["_b"]).alias("size"))))

    def number(value: Column, width: int) -> Column:
        return F.lpad(value.cast("string"), width, "0")

    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    laid = F.aggregate("_s", none, lambda a, x: F.struct((a["at"] + x["size"]).alias("at"), F.concat(a["text"], x["tag"], number(x["size"], 4), number(a["at"], 5)).alias("text")))
    rows = settled(rows, _d=laid)
    base = F.lit(24) + 12 * F.size("fields") + 1
    size = base + F.col("_d.at") + 1

    def part(name: str) -> Column:
        return F.coalesce(F.col("leader")[name], F.lit(" "))

    head = F.concat(number(size, 5), part("status"), part("type"), part("idef1"), part("idef2"), part("encoding"), F.lit("22"), number(base, 5), part("idef3"), part("idef4"), part("idef5"), F.lit("4500"))
    text = F.concat(head, F.col("_d.text"), F.lit("\x1e"), F.array_join("_b", ""), F.lit("\x1d"))
    fits = (size <= RECORD_MOST) & F.forall("_s", lambda s: s["size"] <= FIELD_MOST)
    other = F.raise_error(F.concat(F.lit("too large for the format: record "), F.col("ord").cast("string"))).cast("string") if strict else F.lit(None).cast("string")
    return rows.withColumn("raw", F.encode(F.when(fits, text).otherwise(other), "ISO-8859-1")).drop("_b", "_s", "_d")
