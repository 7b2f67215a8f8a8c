"""Edges of an argument and what is raised against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import text as T
from veriloom.functions.vocab import DEFEATERS


def failed_step(world: str, settles: str, kind: str, anchor: str, texts: str) -> Column:
    """The first test that an objection fails: world, settles, kind, anchor; "" if it is admitted.

    ``texts`` is an array of the finding and its quotes; the anchor must stand in one of them, normalised.
    """
    blank = lambda c: F.btrim(F.coalesce(F.col(c), F.lit(""))) == ""
    a = T.norm_quote(F.coalesce(F.col(anchor), F.lit("")))
    held = F.exists(texts, lambda t: F.contains(T.norm_quote(F.coalesce(t, F.lit(""))), a))
    return F.when(blank(world), "world").when(blank(settles), "settles").when(~F.coalesce(F.col(kind), F.lit("")).isin(*DEFEATERS), "kind").when((a == "") | ~F.coalesce(held, F.lit(False)), "anchor").otherwise("")


def modal_edges(samples: DataFrame) -> DataFrame:
    """(edge, verdict, k, n): open only if more samples say so than say unchallenged; errors don't count."""
    c = samples.groupBy("edge").agg(F.count_if(F.col("verdict") == "open").alias("o"), F.count_if(F.col("verdict") == "unchallenged").alias("u"))
    return c.select("edge", F.when(F.col("o") > F.col("u"), "open").otherwise("unchallenged").alias("verdict"), F.greatest("o", "u").alias("k"), (F.col("o") + F.col("u")).alias("n"))


def offered(samples: DataFrame) -> DataFrame:
    """Per edge the objections offered, admitted, and rejected by each test (edge, step)."""
    return samples.groupBy("edge").agg(F.count(F.lit(1)).alias("offered"), F.count_if(F.col("step") == "").alias("admitted"), *(F.count_if(F.col("step") == s).alias(f"rejected_{s}") for s in ("world", "settles", "kind", "anchor")))


def lifted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, notes): an anchor of several open edges is a note on the method, and its edges are unchallenged again.

    edges (edge, ord, verdict, anchor, world, settles); blank anchors never group. Each note has the
    world of its first edge and its number of edges; no list of edges is gathered.
    """
    keyed = edges.withColumn("key", F.when(F.col("verdict") == "open", F.nullif(T.norm_quote(F.coalesce("anchor", F.lit(""))), F.lit(""))))
    groups = keyed.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("anchor", "world", "settles"), "ord").alias("first")).where("n > 1")
    out = keyed.join(groups.select("key", F.lit(True).alias("up")), "key", "left")
    up = F.coalesce("up", F.lit(False))
    cleared = out.select("edge", "ord", F.when(up, "unchallenged").otherwise(F.col("verdict")).alias("verdict"), F.when((F.col("verdict") == "open") & ~up, F.col("world")).alias("world"))
    return cleared, groups.select("first.anchor", "first.world", "first.settles", "n")


def in_scope(nodes: DataFrame, judged: DataFrame) -> DataFrame:
    """E5: tagged, stated edges below a node, whose own finding does not fail."""
    return nodes.where("scheme <> '' and not query and parent is not null").join(judged.where("judgement <> 'fails'").select("node"), "node", "left_semi")


def all_practical(nodes: DataFrame) -> DataFrame:
    """One row: whether there are tagged edges and all are practical."""
    return nodes.where("scheme <> ''").agg((F.count(F.lit(1)) > 0).alias("some"), F.coalesce(F.bool_and(F.col("scheme") == "practical"), F.lit(False)).alias("all")).select((F.col("some") & F.col("all")).alias("all_practical"))


def edge_quotes(nodes: DataFrame, rows: DataFrame, quotes: DataFrame) -> DataFrame:
    """C20: (edge, quote): quotes of the leaves below a finding whose verdict supports it; blank ones are left out."""
    leaves = nodes.select(F.col("parent").alias("edge"), F.col("node").alias("id")).where("edge is not null")
    good = rows.where(F.col("faith").isin("faithful", "partial")).select("id")
    return leaves.join(good, "id", "left_semi").join(quotes, "id").where("trim(quote) <> ''").select("edge", "quote")


def disputed(nodes: DataFrame, judged: DataFrame, leaves: DataFrame) -> DataFrame:
    """(node, leaf): disputed leaves carried up along children that bear their node's judgement.

    A child bears it if it is on a stated edge that is not opened, is no opinion, and is as severe as
    its node. One join a level, at most the depth of the tree, and pairs only of a leaf and its own ancestors.
    """
    j = judged.select("node", "judgement")
    bearing = nodes.where("parent is not null and not query and not edge_open").join(j, "node").where("judgement <> 'opinion'").join(j.select(F.col("node").alias("parent"), F.col("judgement").alias("above")), "parent").where("judgement = above").select("node", "parent")
    found = leaves.select(F.col("leaf").alias("node"), "leaf")
    out, step = found, found
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    for _ in range(depth):
        step = step.join(bearing, "node").select(F.col("parent").alias("node"), "leaf")
        out = out.unionByName(step)
    return out.distinct()
