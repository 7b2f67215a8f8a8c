"""Joins of rows with hot keys to a side that holds each key once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it has more than one in so many of all rows, so there are fewer than this many heavy keys.
HEAVY = 10_000


def heavy_join(left: DataFrame, right: DataFrame, on: list[str], n: str, spread: Column) -> DataFrame:
    """The inner join of ``left`` with ``right``, which is unique on ``on``; the column ``n`` of right is left out.

    ``n`` counts the rows of a key on the left, or is in proportion to them. The heavy keys, fewer than ``HEAVY`` by
    definition whatever the size of the data, are broadcast; rows that met one go on under keys of their own
    (``spread``), so no task of the shuffle gets all rows of a key. ``right`` is read twice: it should be cut from its lineage.

    Defined cases: null keys meet nothing; an empty side gives an empty result; where no row has a count all keys are light.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    values = [c for c in right.columns if c not in (*on, n)]
    is_heavy = F.coalesce(F.col(n) * HEAVY > F.lit(total), F.lit(False))
    held = F.struct(F.lit(1).alias("_"), *values)
    heavy = right.where(is_heavy).select(*on, held.alias("_heavy"))
    light = right.where(~is_heavy).select(*(F.col(c).alias(f"_{c}") for c in on), F.lit(0).cast("long").alias("_salt"), held.alias("_light"))
    rows = left.join(F.broadcast(heavy), on, "left").withColumn("_own", F.when(F.col("_heavy").isNotNull(), F.pmod(spread, F.lit(1 << 20)) + 1).otherwise(F.lit(0)).cast("long"))
    met = F.col("_own") == F.col("_salt")
    for c in on:
        met = met & (F.col(c) == F.col(f"_{c}"))
    found = F.coalesce("_heavy", "_light")
    return rows.join(light, met, "left").where(found.isNotNull()).select(*left.columns, *(found[c].alias(c) for c in values))
