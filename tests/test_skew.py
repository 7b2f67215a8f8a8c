"""The join of hot keys against a plain one."""

import random

from pyspark.sql import functions as F

from veriloom.operators import skew


def test_heavy_join_equals_plain(spark, monkeypatch):
    rng = random.Random(2)
    left = spark.createDataFrame([(i, rng.choice(["hot"] * 5 + [f"k{rng.randint(0, 30)}", None])) for i in range(500)], "i long, k string")
    counts = left.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.when(F.col("k") != "k3", F.upper("k")))
    monkeypatch.setattr(skew, "HEAVY", 4)
    got = skew.heavy_join(left, counts.where("k <> 'k5'"), ["k"], "n", F.xxhash64("i"))
    want = left.join(counts.where("k <> 'k5'").drop("n"), "k")
    assert got.columns == ["i", "k", "v"] and sorted(str(tuple(r)) for r in got.collect()) == sorted(str((r["i"], r["k"], r["v"])) for r in want.collect())
    assert skew.heavy_join(left.limit(0), counts, ["k"], "n", F.xxhash64("i")).count() == 0
    assert skew.heavy_join(left, counts.limit(0), ["k"], "n", F.xxhash64("i")).count() == 0
