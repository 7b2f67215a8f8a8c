"""Chains of verdicts: last line wins, gaps, pooling of runs, stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veriloom.functions import text as T


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """the last row of each key in the order of ``order``; aggregated before the shuffle, not windowed."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest))


def gaps(rows: DataFrame) -> DataFrame:
    """For each chain the records, distinct idx, the number that there should be and how many are missing."""
    return rows.groupBy("chain").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("idx").alias("n_idx"), (F.max("idx") + 1).alias("n_expected"), F.count_distinct("mode").alias("n_modes")).withColumn("n_missing", F.col("n_expected") - F.col("n_idx"))


def samples_of(rows: DataFrame) -> Column:
    """A record's samples, or its verdict as the only one."""
    return F.when(F.coalesce(F.size("samples"), F.lit(0)) > 0, F.col("samples")).otherwise(F.array("verdict"))


def pooled(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """C11: every sample of every record of a key: (key, verdict, at), ``at`` being its place over all runs."""
    one = rows.select(key, F.struct(*order).alias("o"), F.posexplode(samples_of(rows)).alias("pos", "verdict")).where("verdict is not null and verdict <> ''")
    return one.select(key, "verdict", F.struct("o", "pos").alias("at"))


def tallied(pool: DataFrame, key: str) -> DataFrame:
    """D3-D7 and D12 of a pool of samples: verdict, k, n, spread, dissent, stability, split, tally, first.

    Counts are made first, so however many samples a key has, only its few verdicts are gathered.
    """
    counts = pool.groupBy(key, "verdict").agg(F.count(F.lit(1)).alias("k"), F.min("at").alias("first"))
    cell = F.struct((-F.col("k")).alias("less"), T.worst_rank("verdict").alias("rank"), F.col("verdict"), F.col("first"), F.col("k"), T.verdict_side("verdict").alias("side"))
    per = counts.groupBy(key).agg(F.array_sort(F.collect_list(cell)).alias("c"), F.sum("k").alias("n"))
    top = F.col("c")[0]
    tied = F.filter("c", lambda x: x["k"] == top["k"])
    seen = F.array_sort(F.transform("c", lambda x: F.struct(x["first"].alias("first"), x["verdict"].alias("verdict"), x["k"].alias("k"))))
    sides = F.size(F.array_distinct(F.transform("c", lambda x: x["side"])))
    return per.select(
        key,
        top["verdict"].alias("verdict"),
        top["k"].alias("k"),
        "n",
        F.when(F.col("n") < 2, "").otherwise(F.concat(top["k"].cast("string"), F.lit("/"), F.col("n").cast("string"))).alias("spread"),
        F.when(F.col("n") < 2, "").otherwise(F.array_join(F.transform(F.filter(seen, lambda x: x["verdict"] != top["verdict"]), lambda x: x["verdict"]), ", ")).alias("dissent"),
        F.when(F.size("c") == 1, "settled").when(F.size(tied) > 1, "contested").when(sides == 1, "wobble").otherwise("contested").alias("stability"),
        F.when(F.size(tied) > 1, F.array_join(F.transform(F.array_sort(F.transform(tied, lambda x: F.struct(x["rank"].alias("r"), x["verdict"].alias("v")))), lambda x: x["v"]), "/")).otherwise("").alias("split"),
        F.array_join(F.transform(seen, lambda x: F.concat(x["k"].cast("string"), F.lit(" "), x["verdict"])), " · ").alias("tally"),
    )


def merged(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's pooled verdict and its representative: the first record whose own verdict is the pooled one, else the first."""
    tally = tallied(pooled(rows, key, order), key)
    own = rows.select(key, F.col("verdict").alias("own"), F.struct(*order).alias("o"))
    rep = own.join(tally.select(key, "verdict"), key).groupBy(key).agg(F.min(F.struct((F.col("own") != F.col("verdict")).alias("other"), F.col("o"))).alias("r"))
    return tally.join(rep.select(key, *(F.col(f"r.o.{c}").alias(f"rep_{c}") for c in order)), key)


def unjudged(claims: DataFrame, chain: DataFrame, key: str) -> DataFrame:
    """Claims without a record in a chain."""
    return claims.join(chain.select(key).distinct(), key, "left_anti")


def first_seen(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The distinct values of each key with the place of the first: (key, value, first, n)."""
    return rows.groupBy(key, value).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))


def divergent_pairs(rows: DataFrame, key: str, cell: str, value: str) -> DataFrame:
    """For each two cells the keys in both and those that differ; counted per key from its few values, not from pairs of rows."""
    one = rows.groupBy(key, cell).agg(F.max(value).alias(value))
    a = one.select(key, F.col(cell).alias("cell_a"), F.col(value).alias("va"))
    b = one.select(key, F.col(cell).alias("cell_b"), F.col(value).alias("vb"))
    return a.join(b, key).where("cell_a < cell_b").groupBy("cell_a", "cell_b").agg(F.count(F.lit(1)).alias("n_both"), F.count_if(F.col("va") != F.col("vb")).alias("n_differ"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row (key, at, ...) with the value of the last right row (key, at, value) not after it.

    Both sides are sorted together once per key and the value is carried forward: no inequality join.
    """
    cols = [c for c in left.columns if c not in (key, at)]
    both = left.select(key, at, *cols, F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("side")).unionByName(right.select(key, at, *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols), value, F.lit(0).alias("side")))
    carried = F.last(value, ignorenulls=True).over(W.partitionBy(key).orderBy(at, "side", value).rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn(value, carried).where("side = 1").drop("side")


def overlaid(rows: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with columns of another chain's record of the same idx, where both mean the same claim; null elsewhere."""
    side = other.select("idx", F.btrim("claim").alias("other_claim"), *columns)
    joined = rows.drop(*columns).join(side, "idx", "left")
    same = F.btrim("claim") == F.col("other_claim")
    return joined.select(*[c for c in joined.columns if c not in (*columns, "other_claim")], *(F.when(same, F.col(c)).alias(c) for c in columns))


def compared(rows: DataFrame, key: str, cell: str, value: str, cells: list[str]) -> DataFrame:
    """One row per key with its value in each of the named cells; null where it has none."""
    return rows.groupBy(key).agg(*(F.max(F.when(F.col(cell) == c, F.col(value))).alias(c) for c in cells))


def routed(claims: DataFrame, reports: DataFrame) -> DataFrame:
    """C17: claims (id, ...) with the report that lists their prefix, else the last report that lists none, else null.

    reports (report, ord, prefixes); a prefix of several reports goes to the first.
    """
    by_prefix = reports.select("report", "ord", F.explode("prefixes").alias("prefix")).groupBy("prefix").agg(F.min_by("report", "ord").alias("listed"))
    rest = reports.where("prefixes is null or size(prefixes) = 0").agg(F.max_by("report", "ord").alias("fallback"))
    return claims.withColumn("prefix", T.id_prefix("id")).join(by_prefix, "prefix", "left").join(F.broadcast(rest)).withColumn("report", F.coalesce("listed", "fallback")).drop("prefix", "listed", "fallback")


def unmatched_leaves(leaves: DataFrame, rows: DataFrame, mark: str = "F") -> DataFrame:
    """C14: leaves of a tree whose id begins with the mark but has no row: each is an error of the tree."""
    return leaves.where(F.col("node").startswith(mark)).join(rows.select(F.col("id").alias("node")), "node", "left_anti")


def capped(rows: DataFrame, most: int, order: str, verdict: str = "verdict") -> DataFrame:
    """Rows with the verdict of those beyond the first ``most`` marked as skipped.

    The cut is found by a count per place, so no row is dropped and none has to be in one task.
    """
    places = rows.groupBy(order).agg(F.count(F.lit(1)).alias("n")).orderBy(order).limit(most)
    return rows.join(places.select(order, F.lit(True).alias("within")), order, "left").withColumn(verdict, F.when(F.col("within"), F.col(verdict)).otherwise("skipped (over cap)")).drop("within")
