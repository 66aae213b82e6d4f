"""Connected components of a table of links, by alternating stars.

No vertex's neighbours are ever brought together: every step is an aggregate with a partial sum in
front and an equi-join that Spark may split, so a centre with a million links is no hot spot.  Each
round writes its links to the shared folder, which ends the lineage there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import discard, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over links a > b: all go to the smallest neighbour.

    large: every vertex hands its larger neighbours to the smallest of its neighbourhood;
    small: every vertex hands its smaller neighbours and itself on."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.union(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(spark: SparkSession, links: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows vertex, component (the smallest vertex reachable) for every vertex of ``links`` (a, b) that is not
    its own component.  No links: no rows.  ``rows``: about how many links there are, if that is known."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges = saved(spark, edges, "links", rows)
    shape = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(now) == shape or not now[0]:
            return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
        shape = tuple(now)
        before, edges = edges, saved(spark, _star(_star(edges, True), False), "links", 4 * now[0])
        discard(spark, before)
