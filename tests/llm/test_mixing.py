from pyspark.sql import functions as F

from leafmill.llm import mixing


def test_odd(spark, odd, empty):
    got = mixing.mix(spark, odd).toPandas()
    assert len(got) == odd.count() and got["mix_size"].sum() == odd.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert (got["mix_copies"] <= 2).all()
    caps = got.groupby(got["source"].fillna("?"))[["mix_total", "mix_target"]].first()
    assert (caps["mix_target"] <= 2 * caps["mix_total"] + 1e-9).all() and abs(caps["mix_target"].sum() - 1.5 * caps["mix_total"].sum()) < 1e-6
    twice = mixing.emit(mixing.mix(spark, odd, keep_all=True))
    assert twice.columns == odd.columns and twice.count() == got["mix_copies"].sum()
    again = mixing.mix(spark, odd.repartition(5)).toPandas()
    assert sorted(again["mix_copies"]) == sorted(got["mix_copies"])
    assert mixing.mix(spark, empty).count() == 0


def brute(totals: dict, weights=(3, 1, 2)) -> dict:
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, held = 1.5 * sum(totals.values()), set()
    while True:
        free = [s for s in names if s not in held]
        level = (goal - sum(2 * totals[s] for s in held)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 2 * totals[s]}
        if not over:
            return {s: 2.0 * totals[s] if s in held else level * weight[s] for s in names}
        held |= over


def test_targets(spark):
    totals = {"b": 10, "a": 1000, None: 500, "é": 3, "z": 0, "c": 700}
    frame = spark.createDataFrame(list(totals.items()), "src string, total long")
    got = {r.src: r.target for r in mixing.source_targets(spark, frame).collect()}
    expected = brute(totals)
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_shares_are_met(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    got = mixing.mix(spark, docs).groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.first("mix_target").alias("goal")).collect()
    assert all(abs(r.taken - r.goal) < 0.05 * r.goal for r in got)
