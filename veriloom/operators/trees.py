"""Trees of claims: prefixes, metrics, and judgements from the leaves up.

Trees are adjacency tables (node, parent, ord, depth, query, own). The roll-up goes level by level
from the deepest; the number of levels is the only thing that comes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import text as T
from veriloom.functions.vocab import OPINION, SEVERITY
from veriloom.sources.tables import checkpointed


def severity(judgement: Column) -> Column:
    """The place of a judgement in the order holds, weakened, open, fails; null for opinion."""
    return reduce(lambda acc, iv: F.when(judgement == iv[1], iv[0]).otherwise(acc), list(enumerate(SEVERITY)), F.lit(None).cast("int"))


def judgement_of(level: Column) -> Column:
    """The judgement at a severity."""
    return reduce(lambda acc, iv: F.when(level == iv[0], iv[1]).otherwise(acc), list(enumerate(SEVERITY)), F.lit(None).cast("string"))


def leaf_judgement(route: str | Column, claim: str | Column, stability: str | Column, verdict: str | Column) -> Column:
    """Opinion first, contested is open, then by verdict."""
    v = F.col(verdict) if isinstance(verdict, str) else verdict
    s = F.col(stability) if isinstance(stability, str) else stability
    return (
        F.when(T.is_opinion(route, claim), OPINION).when(F.coalesce(s, F.lit("")) == "contested", "open").when(v.isin("faithful", "supported", "substantive"), "holds")
        .when(v.isin("partial", "overstated", "mixed"), "weakened").when(v.isin("absent", "contradicted", "unsupported", "refuted", "hollow"), "fails").otherwise("open")
    )


def prefixes(rows: DataFrame, key: str, path: str) -> DataFrame:
    """(key, node, parent, label, part, depth) of every prefix of every row's path ``key=Label/key=Label``."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    name = F.array_join(F.transform(F.slice("parts", 1, F.col("i")), lambda p: F.regexp_replace(p, "=.*$", "")), "/")
    up = F.array_join(F.transform(F.slice("parts", 1, F.col("i") - 1), lambda p: F.regexp_replace(p, "=.*$", "")), "/")
    part = F.element_at("parts", F.col("i"))
    exploded = rows.select(key, parts.alias("parts")).where("size(parts) > 0").select(key, "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("i"))
    return exploded.select(key, name.alias("node"), up.alias("parent"), F.when(F.contains(part, F.lit("=")), F.regexp_replace(part, "^[^=]*=", "")).otherwise("").alias("label"), F.col("i").alias("depth"))


def section_tree(rows: DataFrame, key: str, path: str) -> DataFrame:
    """(node, parent, depth, label, n_leaves): one row per prefix; the label is that of the first row, by key, that has one."""
    p = prefixes(rows, key, path)
    return p.groupBy("node", "parent", "depth").agg(F.coalesce(F.min_by(F.nullif("label", F.lit("")), F.when(F.col("label") != "", F.col(key))), F.lit("")).alias("label"), F.count_distinct(key).alias("n_leaves"))


def tree_metrics(tree: DataFrame) -> DataFrame:
    """(max_depth, max_width, mean_fan_out) of a section tree."""
    width = tree.groupBy("parent").agg(F.count(F.lit(1)).alias("w"))
    return tree.agg(F.max("depth").alias("max_depth")).join(width.agg(F.max("w").alias("max_width"), F.round(F.avg("w"), 6).alias("mean_fan_out")))


def regrouped(tree: DataFrame, most: int = 7) -> DataFrame:
    """Children of wide nodes with the group of ``most`` that they go to, in natural order; null where the node is not wide."""
    from pyspark.sql.window import Window as W

    by = W.partitionBy("parent").orderBy(T.natural_key("node"), "node")
    n = F.count(F.lit(1)).over(W.partitionBy("parent"))
    return tree.withColumn("grp", F.when(n > most, F.floor((F.row_number().over(by) - 1) / most).cast("int")))


def rolled_up(nodes: DataFrame) -> DataFrame:
    """(node, judgement, deciding) of every node of (node, parent, ord, depth, query, edge_open, own).

    ``own`` is a leaf's judgement. A child on a query edge counts as open, whatever it is; an opinion
    on a stated edge counts for nothing unless the edge is open; an open edge raises to open and never
    lowers. A node is its worst child; with only children that count for nothing it is an opinion,
    without any it is open. ``deciding`` is the first child at the node's level, a query edge with ?.
    """
    nodes = checkpointed(nodes)
    deepest = nodes.agg(F.max("depth")).first()[0]
    inner = nodes.select("parent").where("parent is not null").distinct().withColumn("has", F.lit(True))
    base = nodes.join(inner.select(F.col("parent").alias("node"), "has"), "node", "left")
    leaves = base.where("has is null").select("node", F.coalesce("own", F.lit("open")).alias("judgement"), F.lit("").alias("deciding"))
    done = leaves
    for depth in range((deepest or 0) - 1, -1, -1):
        level = base.where((F.col("depth") == depth) & F.col("has")).select("node")
        kids = nodes.where(F.col("depth") == depth + 1).join(done.select("node", "judgement"), "node")
        s = severity(F.col("judgement"))
        edge = F.when(F.col("query"), 2).when((F.col("judgement") == OPINION) & ~F.col("edge_open"), None).when(F.col("edge_open"), F.greatest(F.coalesce(s, F.lit(0)), F.lit(2))).otherwise(s)
        own = F.when(F.col("query"), 2).when(F.col("judgement") == OPINION, None).otherwise(s)
        counted = kids.select("parent", "node", "ord", "query", edge.alias("s"), own.alias("d"))
        top = counted.groupBy("parent").agg(F.max("s").alias("top"))
        # Two grouped aggregates rather than a list of children, which may be a third of all rows.
        first = counted.join(top, "parent").where("d = top").groupBy("parent").agg(F.min(F.struct("ord", "node", "query")).alias("f"))
        judged = level.join(top.join(first, "parent", "left").withColumnRenamed("parent", "node"), "node").select(
            "node", F.coalesce(judgement_of(F.col("top")), F.lit(OPINION)).alias("judgement"),
            F.when(F.coalesce(F.col("top"), F.lit(0)) == 0, "").otherwise(F.coalesce(F.concat(F.col("f.node"), F.when(F.col("f.query"), "?").otherwise("")), F.lit(""))).alias("deciding"),
        )
        done = checkpointed(done.unionByName(judged))
    return done


def opened(rows: DataFrame, key: str, path: str) -> DataFrame:
    """The nodes that have any of the selected rows below them."""
    return prefixes(rows, key, path).select("node", "depth").distinct()
