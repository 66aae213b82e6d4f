"""Mixing sources to target weights, with DataFrame functions only.

``size_documents`` counts each document's words, ``source_targets`` turns the totals of the sources
into targets, ``mix`` gives every document its number of copies and ``emit`` repeats it that often.

A source with total size S and weight w gets ``min(2 S, level * w)``.  The level is the one at which
all targets add up to 150 % of all sizes.  A document of a source with rate r = target / S is taken
floor(r) times, and once more with a probability of r - floor(r); that draw is a hash of the seed, the
id and the text, so it is the same in every run and under every partitioning.

Scale: documents are aggregated per source before they are shuffled, so a source that holds a third of
all rows costs one row per task.  Sources are ranked by a range partitioning with an offset for each
partition, not by one task.  The level is found from sums over the table of sources; only two numbers
a round come to the driver.  The join back to the documents is left to Spark, which splits a hot source.

Defined results.  Null text: size 0.  Null source: a source of its own, ranked last.  Null id: hashed as
the empty text.  Sources without words: target 0.  Empty table: no rows.  Repeated rows draw alike, as
the draw depends on their content.  ``emit`` returns all columns of the input, whatever their names, as they travel in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm.common import WORD, saved, table

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1 that depends on the seed, the id and the text only."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_totals(sized: DataFrame, source: str = "source", size: str = "mix_size") -> DataFrame:
    return sized.groupBy(F.col(source).alias("src")).agg(F.sum(size).alias("total"))


def ranked(spark: SparkSession, totals: DataFrame) -> DataFrame:
    """``totals`` with each source's position in code point order, nulls last.

    Range partitions are in order, so a position is the rows of earlier partitions plus the place in
    the own one; the partition number is written down before it is used twice."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = totals.repartitionByRange(parts, F.col("src").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    laid = saved(spark, laid, "mix-sources")
    before = laid.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("src").asc_nulls_last()))
    # one row for each range partition at most, a number fixed by the configuration
    return laid.withColumn("place", place).join(F.broadcast(before.select("part", "before")), "part").select("src", "total", (F.col("before") + F.col("place") - 1).alias("position"))


def water_level(weighted: DataFrame, share: float = SHARE, most: float = MOST) -> float:
    """The level at which ``min(most * total, level * weight)`` adds up to ``share`` of all totals."""
    row = weighted.agg(F.sum("total"), F.sum("weight")).first()
    goal, level = share * float(row[0] or 0), 0.0
    free = float(row[1] or 0)
    held = 0.0
    while free > 0:
        now = (goal - held) / free
        if now <= level:
            break
        level = now
        over = F.lit(level) * F.col("weight") > most * F.col("total")
        row = weighted.agg(F.sum(F.when(over, most * F.col("total"))), F.sum(F.when(~over, F.col("weight")))).first()
        held, free = float(row[0] or 0), float(row[1] or 0)
    return level


def source_targets(spark: SparkSession, totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows src, total, target."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    weighted = saved(spark, ranked(spark, totals).withColumn("weight", weight), "mix-weights")
    level = water_level(weighted, share, most)
    return weighted.select("src", "total", F.least(most * F.col("total").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def copies(target: Column, total: Column, chance: Column) -> Column:
    rate = F.when(total > 0, target / total).otherwise(F.lit(0.0))
    return F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, keep_all: bool = False) -> DataFrame:
    """Each document with mix_size, mix_total, mix_target (of its source) and mix_copies.

    Only doc_id and source are carried along unless ``keep_all``, which keeps every column of ``docs`` in the struct ``row``.
    The columns are written once, so that texts are read and counted a single time."""
    own = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if keep_all else []
    sized = docs.select(*own, F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("mix_size"), draw(F.col("doc_id"), F.col("text"), seed).alias("mix_draw"))
    sized = saved(spark, sized, "mix-sized")
    goals = source_targets(spark, source_totals(sized), weights, share, most)
    goals = goals.select(F.col("src").alias("mix_src"), F.col("total").alias("mix_total"), F.col("target").alias("mix_target"))
    joined = sized.join(goals, F.col("source").eqNullSafe(F.col("mix_src")))
    return joined.withColumn("mix_copies", copies(F.col("mix_target"), F.col("mix_total"), F.col("mix_draw"))).drop("mix_src", "mix_draw")


def emit(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` with ``keep_all``, as they came, each as many times as the mix takes it."""
    taken = mixed.where("mix_copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies").cast("int"))))
    return taken.select("row.*")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark, table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_total").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


#: The level in closed form: sources in the order in which a rising level meets their caps.
OP4_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{WORD}')) END::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT / {2**52}.0::DOUBLE AS chance
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS total,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
steps AS (
  SELECT *, 1.5::DOUBLE * (sum(total) OVER ())::DOUBLE AS goal,
         coalesce(sum(2 * total) OVER w, 0)::DOUBLE AS held,
         (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS free,
         2.0::DOUBLE * total / weight AS cap
  FROM totals
  WINDOW w AS (ORDER BY 2.0::DOUBLE * total / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min((goal - held) / free, held) FILTER (WHERE (goal - held) / free <= cap) AS level FROM steps),
goals AS (
  SELECT source, total, least(2.0::DOUBLE * total, level * weight) AS target
  FROM totals, level)
SELECT s.doc_id, s.size, g.total AS source_size, g.target,
       s.size * (floor(CASE WHEN g.total > 0 THEN g.target / g.total ELSE 0 END)
                 + CASE WHEN s.chance < (CASE WHEN g.total > 0 THEN g.target / g.total ELSE 0 END)
                        - floor(CASE WHEN g.total > 0 THEN g.target / g.total ELSE 0 END) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
"""
