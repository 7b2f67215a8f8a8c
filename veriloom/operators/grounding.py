"""Checking of quotes against passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veriloom.functions import text as T


def checked(quotes: DataFrame, passages: DataFrame) -> DataFrame:
    """Quotes (key, pos, quote, pid) with ``ok``, whether each stands in the passage it cites (pid, context, text)."""
    hit = passages.select("pid", "context", F.col("text").alias("body"), F.lit(True).alias("held"))
    return quotes.join(hit, "pid", "left").select("key", "pos", "quote", "pid", (F.coalesce("held", F.lit(False)) & T.quote_in("quote", "context", "body")).alias("ok"))


def unique_source(quotes: DataFrame, own: DataFrame, passages: DataFrame) -> DataFrame:
    """(key, pos, source): the one passage among a record's own (key, pid) that holds the quote, "" if none or several."""
    held = own.distinct().join(passages.select("pid", T.norm_quote(T.visible_text("context", "text")).alias("body")), "pid")
    cand = quotes.select("key", "pos", T.norm_quote("quote").alias("q")).join(held, "key", "left")
    ok = F.coalesce((F.col("q") != "") & F.contains("body", "q"), F.lit(False))
    found = cand.groupBy("key", "pos").agg(F.count_if(ok).alias("n"), F.min(F.when(ok, F.col("pid"))).alias("pid"))
    return found.select("key", "pos", F.when(F.col("n") == 1, F.col("pid")).otherwise(F.lit("")).alias("source"))


def located(quotes: DataFrame, passages: DataFrame, words: int = 8) -> DataFrame:
    """(key, pos, pid) of every passage that holds a quote, normalised, whole.

    A quote inside a text brings its inner words with it: the first ``words`` of them that are
    complete meet the texts' runs of words by hash, and only pairs that met are compared. Quotes
    with fewer complete words take their longest one instead, and those without any the word pairs
    of the corpus that begin like them.
    """
    norm = quotes.select("key", "pos", T.norm_quote("quote").alias("q")).where("q <> ''")
    toks = F.split("q", " ")
    n = F.size(toks)
    keyed = norm.select("key", "pos", "q", F.when(n >= words + 2, F.array_join(F.slice(toks, 2, words), " ")).alias("run"), F.when(n >= 3, F.element_at(F.array_sort(F.transform(F.slice(toks, 2, n - 2), lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t")))), 1)["t"]).alias("one"))
    body = passages.select("pid", T.norm_quote(T.visible_text("context", "text")).alias("body"))
    words_of = F.split("body", " ")
    # Only ids and hashes are shuffled to find who meets; the texts join afterwards.
    hashes = T.bound(words_of, lambda w: F.when(F.size(w) >= words, F.transform(F.sequence(F.lit(1), F.size(w) - words + 1), lambda i: F.xxhash64(F.slice(w, i, words)))))
    runs = body.select("pid", F.explode(F.array_distinct(hashes)).alias("h"))
    met = runs.join(keyed.where("run is not null").select("key", "pos", F.xxhash64(F.split("run", " ")).alias("h")), "h").select("key", "pos", "pid")
    short = keyed.where("run is null and one is not null").select("key", "pos", "one")
    singles = body.select("pid", F.explode(F.array_distinct(words_of)).alias("one"))
    met_short = singles.join(short, "one").select("key", "pos", "pid")
    sure = met.unionByName(met_short).join(norm, ["key", "pos"]).join(body, "pid").where(F.contains("body", "q")).select("key", "pos", "pid")
    parts = [sure]
    tiny = keyed.where("run is null and one is null").select("key", "pos", "q")
    if not tiny.isEmpty():  # quotes of one or two words have no complete word inside
        parts.append(_located_tiny(tiny, body))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _located_tiny(tiny: DataFrame, body: DataFrame) -> DataFrame:
    """Quotes of one or two words in all texts: their first letters meet the distinct word pairs of the corpus, and these their texts."""
    words = F.split("body", " ")
    pairs = body.select("pid", F.explode(F.array_distinct(F.when(F.size(words) == 1, words).otherwise(T.shingles(words, 2)))).alias("unit"))
    starts = tiny.withColumn("gram", F.substring("q", 1, 6))
    sizes = sorted(r[0] for r in starts.select(F.char_length("gram")).distinct().collect())  # at most six

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("unit") - n + 1, F.lit(1))), lambda i: F.substring(F.col("unit"), i, F.lit(n)))

    grams = F.flatten(F.array(*(of(n) for n in sizes)))
    units = pairs.select("unit").distinct().select("unit", F.explode(F.array_distinct(grams)).alias("gram"))
    held = units.join(starts, "gram").where(F.contains("unit", "q")).select("unit", "key", "pos").distinct()
    return pairs.join(held, "unit").select("key", "pos", "pid")


def in_order(ids: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages of lists (key, ids) with their place; unknown ids are skipped and the order kept."""
    return ids.select("key", F.posexplode("ids").alias("pos", "pid")).join(passages, "pid")


def best_overlap(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Of each claim's passages (key, claim, pos, text) the one that shares most distinct words; the first wins, none without any."""
    shared = F.size(F.array_intersect(F.array_distinct(T.tokenize("claim")), F.array_distinct(T.tokenize("text"))))
    rows = claims.join(passages, "key").withColumn("shared", shared).where("shared > 0")
    return rows.withColumn("k", F.row_number().over(W.partitionBy("key").orderBy(F.desc("shared"), "pos"))).where("k = 1").drop("k")
