"""Claims grouped by the passages that they share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlaps(sets: DataFrame) -> DataFrame:
    """H2: (chain, idx_a, idx_b, shared) of claims of one chain that share at least half of the smaller set.

    ``sets`` is (chain, idx, pid). Only claims that have a passage in common meet.
    """
    x = sets.where("pid is not null and idx is not null").distinct()
    n = x.groupBy("chain", "idx").agg(F.count(F.lit(1)).alias("n"))
    s = x.withColumnRenamed("idx", "idx_a").join(x.withColumnRenamed("idx", "idx_b"), ["chain", "pid"]).where("idx_a < idx_b").groupBy("chain", "idx_a", "idx_b").agg(F.count(F.lit(1)).alias("shared"))
    sized = s.join(n.select("chain", F.col("idx").alias("idx_a"), F.col("n").alias("na")), ["chain", "idx_a"]).join(n.select("chain", F.col("idx").alias("idx_b"), F.col("n").alias("nb")), ["chain", "idx_b"])
    return sized.where(2 * F.col("shared") >= F.least("na", "nb")).select("chain", "idx_a", "idx_b", "shared")


def grouped(sets: DataFrame) -> DataFrame:
    """(chain, idx, seed): in the order of idx each unused claim seeds a group of the later unused ones that share half with it.

    The order decides, so the claims of one chain are walked in turn; the walk sees only pairs that
    overlap, sorted and streamed, and keeps a set of used idx. A chain is one file of claims. Claims
    without passages stand alone.
    """
    pairs = overlaps(sets)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, used = None, {}
        for b in batches:
            rows = []
            for c, i, j in zip(b["chain"], b["idx_a"], b["idx_b"]):
                if c != chain:
                    chain, used = c, {}
                if i not in used:
                    used[i] = i
                if used[i] == i and j not in used:
                    used[j] = i
                    rows.append((c, j, i))
            yield pd.DataFrame(rows, columns=["chain", "idx", "seed"])

    joined = pairs.select("chain", "idx_a", "idx_b").repartition("chain").sortWithinPartitions("chain", "idx_a", "idx_b").mapInPandas(walk, "chain string, idx int, seed int")
    return sets.select("chain", "idx").where("idx is not null").distinct().join(joined, ["chain", "idx"], "left").select("chain", "idx", F.coalesce("seed", "idx").alias("seed"))
