"""The shape of a record as a row, and columns to build such rows from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEADER = "struct<length:int,status:string,type:string,idef1:string,idef2:string,encoding:string,base_addr:int,idef3:string,idef4:string,idef5:string>"
SUBFIELDS = "array<struct<code:string,value:string>>"
FIELD = f"struct<tag:string,ind1:string,ind2:string,value:string,subfields:{SUBFIELDS}>"
FIELDS = f"array<{FIELD}>"
#: Columns of a record.  A control field has a value and no subfields, a data field subfields and no value.
RECORD = f"source string, ord long, raw binary, valid boolean, err string, leader {LEADER}, fields {FIELDS}"


def control(tag: str, value: Column) -> Column:
    return F.struct(F.lit(tag).alias("tag"), F.lit(None).cast("string").alias("ind1"), F.lit(None).cast("string").alias("ind2"), value.cast("string").alias("value"), F.lit(None).cast(SUBFIELDS).alias("subfields"))


def data(tag: str, indicators: str, *subfields: tuple[str, Column]) -> Column:
    subs = F.array(*(F.struct(F.lit(c).alias("code"), F.coalesce(v.cast("string"), F.lit("")).alias("value")) for c, v in subfields))
    return F.struct(F.lit(tag).alias("tag"), F.lit(indicators[0]).alias("ind1"), F.lit(indicators[1]).alias("ind2"), F.lit(None).cast("string").alias("value"), subs.alias("subfields"))


def leader(status: Column, kind: str = "a", encoding: str = "a") -> Column:
    parts = {"length": F.lit(None).cast("int"), "status": status, "type": F.lit(kind), "idef1": F.lit(" "), "idef2": F.lit(" "), "encoding": F.lit(encoding), "base_addr": F.lit(None).cast("int"), "idef3": F.lit(" "), "idef4": F.lit(" "), "idef5": F.lit(" ")}
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def settled(rows: DataFrame, **made: Column) -> DataFrame:
    """``rows`` with more columns that are computed once for each row, however often they are used: a generator of one element, which
    the optimizer does not look through."""
    one = F.explode(F.array(F.struct(*(c.alias(name) for name, c in made.items())))).alias("_settled")
    return rows.select("*", one).select(*(c for c in rows.columns if c not in made), *(F.col(f"_settled.{name}").alias(name) for name in made))


def is_control(field: Column) -> Column:
    return field["subfields"].isNull()


def leading_control(fields: Column) -> Column:
    """The control fields before the first data field."""
    first = F.array_position(F.transform(fields, lambda f: f["subfields"].isNotNull()), F.lit(True))
    return F.when(first == 0, fields).otherwise(F.slice(fields, F.lit(1), F.greatest(first.cast("int") - 1, F.lit(0))))


# Fixed values of the format: record types of bibliographic records.
BIBLIOGRAPHIC = "acdefgijkmoprt"


def is_bibliographic(leader: Column) -> Column:
    return leader["type"].isin(*BIBLIOGRAPHIC)


def is_community_information(leader: Column) -> Column:
    return leader["type"] == "q"


def bibliographic_level(leader: Column) -> Column:
    return F.when(is_bibliographic(leader) & (leader["idef1"] != " "), leader["idef1"])


def kind_of_data(leader: Column) -> Column:
    return F.when(is_community_information(leader) & (leader["idef1"] != " "), leader["idef1"])


def type_of_control(leader: Column) -> Column:
    return F.when(is_bibliographic(leader) & (leader["idef2"] != " "), leader["idef2"])


def is_utf8(fields: Column) -> Column:
    """Whether every value of a record is valid UTF-8."""
    return F.forall(fields, lambda f: F.when(f["subfields"].isNull(), F.is_valid_utf8(f["value"])).otherwise(F.forall(f["subfields"], lambda s: F.is_valid_utf8(s["value"]))))
