"""Mixing sources to target weights (problem 9), by soft membership and projected-gradient least squares.

1. Every document's size is counted in tokens of a public tokenizer, and a classifier trained on a
   bounded sample of the labelled table predicts its posterior over the sources, in the same pass.
2. A document's membership is its posterior; where its source is given, that counts ``TRUST`` and the
   posterior the rest. Documents of one source and one posterior, in steps of 1/``GRID``, have one rate
   and are one row of the fit.
3. Rates, between 0 and the repeats allowed, are fitted so that each source's expected
   tokens match its target: projected-gradient steps on the squared gaps, each a distributed sum of expected
   tokens by mix and source, a table of fixed size. A rate follows from the membership and the gaps so
   far, so none is stored. Shares are stated by given source, so the last steps go by that alone:
   they leave what the posteriors made of the rates within a source, and mend its sum.
4. Rates become whole copies: all take the whole part, and the rest goes to documents in the order
   of a hash, up to the amount wanted. The cut is found by a histogram of fixed size, then exactly
   among the documents of one bin.

Targets: weight over the sum of a mix's weights, times size_ratio, times all tokens of the corpus.
A source that cannot fill its target within its repeats gives all it can; the others keep theirs.

Defined cases: null, empty and blank texts have their own count of tokens, and those of none are
never drawn; a source without documents has a share of 0; sources of no mix are never drawn; null or
negative weights count as 0, null repeats as 1 and null ratios as 1; a repeated target row counts
once; documents without an id are never drawn; repeated documents are drawn each on its own; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veriloom.llm import bpe, langid
from veriloom.sources.tables import checkpointed

#: Distinct labelled texts of each source in the classifier's sample, at most; steps of the fit, and the relative gap that ends it.
PER_SOURCE, STEPS, CLOSE = 150, 20, 1e-4
#: What a given source counts in its document's membership, and the steps in which posteriors are kept.
TRUST, GRID = 0.5, 16
#: Bins of the histogram of hashes; sources that mixes may name.
BINS, SOURCES_MOST = 4096, 10_000


def classifier(docs: DataFrame, sources: list[str]) -> np.ndarray:
    """Weights of a classifier of sources, trained on a bounded sample of the documents (text, source)."""
    labelled = docs.where(F.col("source").isin(sources) & (F.length("text") > 0)).select("text", "source")
    sample = langid.drawn(labelled, "source", PER_SOURCE)
    y = np.array([sources.index(s) for s in sample["source"]], int)
    examples = []
    for ids in langid.part_ids(sample["text"].tolist()):
        u, c = np.unique(ids, return_counts=True)
        examples.append((np.r_[u, langid.DIM], np.r_[20 * c / max(1, c.sum()), 1.0]))
    weights = langid.ftrl(examples, y, len(sources)) if examples else np.zeros((langid.DIM + 1, len(sources)))
    weights[:-1] *= 20
    return weights.astype(np.float32)


def memberships(sized: DataFrame, weights: np.ndarray, sources: list[str]) -> DataFrame:
    """(doc_id, own, given, n_tokens, q) of documents (doc_id, source, text, n_tokens): posteriors ``q`` in GRID steps.

    ``own`` is the number of the given source, or of the likeliest where none is given; sources of no mix have no row.
    """
    shared = sized.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {s: i for i, s in enumerate(sources)}
        for b in batches:
            q = langid.softmax(langid.scores(b["text"].tolist(), shared.value), 1.0) if len(b) else np.zeros((0, len(sources)))
            given = b["source"].notna().to_numpy()
            own = np.where(given, b["source"].map(number).fillna(-1).astype(int), q.argmax(axis=1) if len(b) else 0)
            yield pd.DataFrame({"doc_id": b["doc_id"], "own": own, "given": given, "n_tokens": b["n_tokens"], "q": list(np.rint(q * GRID).astype(np.int16))})

    known = F.col("source").isNull() | F.col("source").isin(sources)
    return sized.where(known).select("doc_id", "source", "text", "n_tokens").mapInPandas(run, "doc_id long, own int, given boolean, n_tokens long, q array<short>")


def _members(own: np.ndarray, given: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(memberships, own sources as rows of zeros and a one)."""
    one = np.eye(q.shape[1])[own]
    q = q / np.maximum(q.sum(axis=1, keepdims=True), 1)
    return np.where(given[:, None], TRUST * one + (1 - TRUST) * q, q), one


def _rate(m: np.ndarray, one: np.ndarray, cap: np.ndarray, gaps: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """Rates of rows of memberships, for one mix, after the steps whose scaled gaps are given."""
    r, top = np.zeros(len(m)), one @ cap
    for by, g in gaps:
        r = np.clip(r + (m if by == "soft" else one) @ g, 0.0, top)
    return r


def mix(docs: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """The documents drawn: mix, doc_id, source, n_tokens, copies.

    ``docs`` has doc_id, text and source; ``targets`` mix, source, weight, max_repeats, size_ratio.
    """
    spark = docs.sparkSession
    named = targets.where("mix is not null and source is not null").select("mix", "source", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("cap"), F.coalesce("size_ratio", F.lit(1.0)).alias("ratio")).distinct()
    rows = named.limit(SOURCES_MOST + 1).toPandas()
    if len(rows) > SOURCES_MOST:
        raise ValueError(f"mixes name more than {SOURCES_MOST} sources")
    mixes, sources = sorted(rows["mix"].unique()), sorted(rows["source"].unique())
    drawn_schema = "mix string, source string, doc_id long, n_tokens long, rate double, cap double"
    if not mixes:
        return whole_copies(spark.createDataFrame([], drawn_schema))
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.nullif(F.btrim("source"), F.lit("")).alias("source"), "text")
    counted = bpe.token_counts(base, ["doc_id", "source", "text"], path=path).where("n_tokens > 0")
    # Documents of no mix count for the size of the corpus alone.
    others = bpe.token_counts(base.where(~F.col("source").isin(sources)), ["doc_id"], path=path).agg(F.sum("n_tokens")).first()[0] or 0
    soft = checkpointed(memberships(counted, classifier(base, sources), sources))
    groups = checkpointed(soft.groupBy("own", "given", "q").agg(F.sum("n_tokens").alias("t")))
    cap = np.zeros((len(mixes), len(sources)))
    goal = np.zeros_like(cap)
    gaps: list[list[tuple[str, np.ndarray]]] = [[] for _ in mixes]

    def expected() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens held by membership and by own source, then expected by membership and own source for each mix."""
        past, n = [list(g) for g in gaps], len(sources)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = np.zeros((2 + 2 * len(past), n))
            for b in batches:
                m, one = _members(b["own"].to_numpy(), b["given"].to_numpy(bool), np.vstack(b["q"].to_list()).astype(float))
                t = b["t"].to_numpy(float)
                acc[0] += t @ m
                acc[1] += t @ one
                for i, g in enumerate(past):
                    used = _rate(m, one, cap[i], g) * t
                    acc[2 + i] += used @ m
                    acc[2 + len(past) + i] += used @ one
            yield pd.DataFrame({"i": np.arange(acc.size), "t": acc.ravel()})

        flat = np.zeros((2 + 2 * len(past)) * n)
        sums = groups.mapInPandas(run, "i int, t double").groupBy("i").agg(F.sum("t").alias("t")).toPandas()
        flat[sums["i"]] = sums["t"]
        all_ = flat.reshape(-1, n)
        return all_[:2], all_[2 : 2 + len(past)], all_[2 + len(past) :]

    held, _, _ = expected()
    total = held[1].sum() + others
    for m, s, w, c, ratio in rows.itertuples(index=False):
        i, j = mixes.index(m), sources.index(s)
        cap[i, j] = c
        goal[i, j] = w / max(1e-12, rows.loc[rows["mix"] == m, "weight"].sum()) * ratio * total
    for by in ("soft", "own"):
        before = np.inf
        for _ in range(STEPS):
            _, by_member, by_own = expected()
            got, room = (by_member, held[0]) if by == "soft" else (by_own, held[1])
            gap = np.where(room > 0, goal - got, 0.0)
            worst = (np.abs(gap) / np.maximum(goal, 1)).max()
            # Done, or nothing moves any more, as where all that a source holds is taken.
            if worst <= CLOSE or before - np.abs(gap).sum() <= CLOSE * goal.sum() / 100:
                break
            before = np.abs(gap).sum()
            gaps = [[*g, (by, gap[i] / np.maximum(room, 1.0))] for i, g in enumerate(gaps)]
    final = gaps

    def rates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = b["own"].to_numpy()
            m, one = _members(own, b["given"].to_numpy(bool), np.vstack(b["q"].to_list()).astype(float)) if len(b) else (np.zeros((0, len(sources))),) * 2
            for i, name in enumerate(mixes):
                r = _rate(m, one, cap[i], final[i])
                yield pd.DataFrame({"mix": name, "source": [sources[j] for j in own], "doc_id": b["doc_id"], "n_tokens": b["n_tokens"], "rate": r, "cap": one @ cap[i]})[r > 0]

    return whole_copies(soft.mapInPandas(rates, drawn_schema))


def whole_copies(drawn: DataFrame) -> DataFrame:
    """Whole copies of documents with rates (mix, source, doc_id, n_tokens, rate, cap)."""
    unit: Column = F.pmod(F.xxhash64("mix", "doc_id"), F.lit(1 << 30))
    rows = drawn.withColumn("base", F.floor("rate")).withColumn("u", unit).withColumn("bin", F.floor(F.col("u") / ((1 << 30) / BINS)).cast("int")).withColumn("more", F.col("base") < F.col("cap"))
    key = ["mix", "source"]
    hist = rows.groupBy(*key, "bin").agg(F.sum(F.when(F.col("more"), F.col("n_tokens")).otherwise(0)).alias("t"), F.sum((F.col("rate") - F.col("base")) * F.col("n_tokens")).alias("part"))
    by = W.partitionBy(*key)
    up = by.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    cuts = hist.select(*key, "bin", "t", F.sum("part").over(by).alias("wanted"), F.sum("t").over(up).alias("upto")).select(*key, "bin", "wanted", (F.col("upto") - F.col("t")).alias("before"), "upto")
    # As many rows as mixes have sources, times BINS: left to the join's own choice, as that may be too many to broadcast.
    flagged = rows.join(cuts, [*key, "bin"])
    inside = W.partitionBy(*key, "bin").orderBy("u", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    whole = flagged.where("upto <= wanted").select("mix", "doc_id", "source", "n_tokens", (F.col("base") + F.col("more").cast("long")).alias("copies"))
    none = flagged.where("before >= wanted and upto > wanted").select("mix", "doc_id", "source", "n_tokens", F.col("base").alias("copies"))
    edge = flagged.where("upto > wanted and before < wanted").withColumn("own", F.col("before") + F.sum(F.when(F.col("more"), F.col("n_tokens")).otherwise(0)).over(inside))
    # A document goes in if that leaves the sum nearer to what is wanted.
    taken = edge.select("mix", "doc_id", "source", "n_tokens", (F.col("base") + (F.col("more") & (F.col("own") - F.col("n_tokens") / 2 <= F.col("wanted"))).cast("long")).alias("copies"))
    return whole.unionByName(none).unionByName(taken).where("copies > 0").select("mix", "doc_id", "source", "n_tokens", F.col("copies").cast("long").alias("copies"))


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """What became of each target: mix, source, target_share, actual_share, n_docs, n_tokens, most_copies."""
    got = drawn.groupBy("mix", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    by = W.partitionBy("mix")
    goal = targets.where("mix is not null and source is not null").select("mix", "source", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight")).distinct()
    joined = goal.join(got, ["mix", "source"], "left").select("mix", "source", "weight", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_tokens", "most_copies")))
    return joined.select("mix", "source", F.round(F.col("weight") / F.sum("weight").over(by), 6).alias("target_share"), F.round(F.col("n_tokens") / F.sum("n_tokens").over(by), 6).alias("actual_share"), "n_docs", "n_tokens", "most_copies")
