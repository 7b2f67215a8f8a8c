"""Long exact spans shared between records (problem 1).

1. Every window of ``span`` characters has one canonical phrase, the leftmost of least hash among
   the phrases of ``anchor`` characters inside it. Equal windows have equal phrases, so two records
   sharing a span of that length share a phrase: no shared span can be missed.
2. Texts are read in pieces of ``PIECE`` windows. A phrase found in the pieces of two or more
   different texts is confirmed as recurring, by a partial, then a final aggregation on its hash.
   Only which piece holds which phrase is kept, not where.
3. The phrases confirmed in one piece, their home, belong to one shard, and each piece that holds
   one of them is routed there. A shard compiles its phrases, those of several homes at a time,
   into an Aho-Corasick automaton and streams its pieces through it; the automaton alone tells
   where the phrases stand, and around each place whole windows are compared with those of other texts.
4. The windows that stand in another text are joined into intervals; their union per text gives
   the shared characters.

Exact copies are made one text first, so a text copied into a third of all rows is one row of the
heavy stages. A phrase that stands in more than ``hot`` pieces is compiled in several shards, over
which its pieces are spread; there, and where a home's pieces exceed ``HELD`` characters, the windows
around its places are not compared in the task but by their 128-bit digests, with partial aggregation.

Defined cases: null texts are no records; texts shorter than ``span``, and empty ones, share
nothing; a span repeated only within one record is not shared; repeated deliveries (same name) are
one record, the last to come holding; an empty table gives an empty result; extra columns are
ignored. Characters are Unicode code points as stored, without any normalising. Texts and windows
count as equal if two independent 64-bit hashes of them are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veriloom.sources.tables import checkpointed

SPAN, ANCHOR = 160, 64
#: Windows of one piece of a text, and pieces with one phrase beyond which they are spread over several shards.
PIECE, HOT = 4096, 20_000
#: Tasks over which the pieces of one phrase are spread while they are counted.
SALTS = 64
#: Phrases of one automaton, characters hashed at a time, and characters that a home's pieces may hold in memory.
PHRASES, CHUNK, HELD = 4_000, 1 << 21, 1 << 22
POS_BITS = np.uint64(31)
#: Odd factors of the two hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def phrase_hashes(codes: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of the ``k`` characters from each position, all positions at once."""
    up, down = _powers(len(codes) + 1, base)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(codes) + 1 - k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` values in a row, by doubling."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors_of(texts: list[str], span: int = SPAN, k: int = ANCHOR, chunk: int = CHUNK) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, hash, position, first window, last window) of every canonical anchor.

    Texts are hashed ``chunk`` characters at a time, short ones together and long ones in pieces that
    overlap by a window less one, so memory is bounded and no window is left out.
    """
    held: list[tuple[int, int, str]] = []
    size = 0
    for i, t in enumerate(texts):
        for start in range(0, max(0, len(t) - span + 1), chunk):
            piece = t[start : start + chunk + span - 1]
            if held and size + len(piece) > chunk:
                yield from _anchors(held, span, k)
                held, size = [], 0
            held.append((i, start, piece))
            size += len(piece)
    if held:
        yield from _anchors(held, span, k)


def _anchors(pieces: list[tuple[int, int, str]], span: int, k: int) -> Iterator[tuple[int, int, int, int, int]]:
    codes = np.frombuffer("".join(p for _, _, p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = phrase_hashes(codes, k)
    # The position in the low bits makes the leftmost least one the winner, alike in any buffer.
    packed = ((h >> POS_BITS) << POS_BITS) | np.arange(len(h), dtype=np.uint64)
    at = (_least(packed, span - k + 1) & np.uint64((1 << 31) - 1)).astype(np.int64)
    base = 0
    for i, start, piece in pieces:
        own = at[base : base + len(piece) - span + 1]
        cut = np.flatnonzero(np.diff(own)) + 1
        lo = np.concatenate(([0], cut))
        hi = np.concatenate((cut - 1, [len(own) - 1]))
        pos = own[lo]
        for a, b, c, x in zip(h[pos].view(np.int64).tolist(), (pos - base + start).tolist(), (lo + start).tolist(), (hi + start).tolist()):
            yield i, a, b, c, x
        base += len(piece)


def phrases_of(piece: str, wanted: set[int], span: int, k: int) -> list[str]:
    """The canonical phrases of a piece whose hashes are wanted."""
    return [piece[pos : pos + k] for _, h, pos, _, _ in anchors_of([piece], span, k) if h in wanted]


def places(auto, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(piece number, first character) of every occurrence of the automaton's phrases in the pieces."""
    rows, firsts = [], []
    for i, piece in enumerate(pieces):
        at = [end - n + 1 for end, n in auto.iter(piece)]
        rows.append(np.full(len(at), i, np.int64))
        firsts.append(np.array(at, np.int64))
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(firsts or [np.zeros(0, np.int64)])


def windows_around(phrases: list[str], pieces: list[str], span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece number, first character, two hashes) of every window that holds a phrase, as the automaton finds them."""
    import ahocorasick

    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    if not phrases:
        return none
    auto = ahocorasick.Automaton()
    for p in phrases:
        auto.add_word(p, k)
    auto.make_automaton()
    row, first = places(auto, pieces)
    if not len(row):
        return none
    size = np.array([len(p) for p in pieces])
    base = np.concatenate(([0], np.cumsum(size)))
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    open_ = np.zeros(len(codes) + 1, np.int32)
    np.add.at(open_, base[row] + np.maximum(0, first + k - span), 1)
    np.add.at(open_, base[row] + np.minimum(first, size[row] - span) + 1, -1)
    at = np.flatnonzero(np.cumsum(open_[:-1]) > 0)
    of = np.searchsorted(base, at, "right") - 1
    return of, at - base[of], *(phrase_hashes(codes, span, b)[at] for b in BASES)


def shared_windows(phrases: list[str], rows: list[tuple[int, int, int, str]], span: int, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(t1, t2, start, end) of the stretches that pieces (t1, t2, offset, text) of different texts share around the phrases."""
    of, first, h1, h2 = windows_around(phrases, [r[3] for r in rows], span, k)
    if not len(of):
        return
    number: dict[tuple[int, int], int] = {}
    text = np.array([number.setdefault(r[:2], len(number)) for r in rows])[of]
    order = np.lexsort((h2, h1))
    a, b, t = h1[order], h2[order], text[order]
    starts = np.concatenate(([0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1))
    mixed = np.minimum.reduceat(t, starts) != np.maximum.reduceat(t, starts)
    shared = np.zeros(len(of), bool)
    shared[order] = np.repeat(mixed, np.diff(np.concatenate((starts, [len(t)]))))
    of, first = of[shared], first[shared]
    if len(of):
        cut = np.flatnonzero((of[1:] != of[:-1]) | (first[1:] != first[:-1] + 1)) + 1
        for i, lo, hi in zip(of[np.concatenate(([0], cut))].tolist(), first[np.concatenate(([0], cut))].tolist(), first[np.concatenate((cut - 1, [len(of) - 1]))].tolist()):
            t1, t2, offset, _ = rows[i]
            yield t1, t2, offset + lo, offset + hi + span


def _union_length(iv: Column) -> Column:
    """The number of characters in a union of (start, end) intervals."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("upto"))
    step = lambda acc, x: F.struct(
        (acc["total"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["upto"], x["start"]))).alias("total"),
        F.greatest(acc["upto"], x["end"]).alias("upto"),
    )
    return F.aggregate(F.array_sort(iv), zero, step, lambda acc: acc["total"])


def shared_spans(texts: DataFrame, span: int = SPAN, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """For each record of ``texts`` (rec, ord, text): rec, n_chars, n_shared, n_copies."""
    a1, a2 = F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2")
    keyed = texts.where("rec is not null and text is not null").select("rec", "ord", a1, a2, "text", F.char_length("text").alias("n_chars"))
    # Names meet digests only, so each text is shuffled once, by its digest; superseded texts fall out in the join.
    recs = keyed.groupBy("rec").agg(F.max(F.struct("ord", "t1", "t2")).alias("x")).select("rec", "x.t1", "x.t2")
    copies = recs.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n_copies"))
    whole = keyed.groupBy("t1", "t2").agg(F.first("text").alias("text")).join(copies, ["t1", "t2"])
    long_ = whole.where(F.char_length("text") >= span).select("t1", "t2", "text")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = [(a, c, p, t[p * PIECE : (p + 1) * PIECE + span - 1]) for a, c, t in zip(b["t1"], b["t2"], b["text"]) for p in range((len(t) - span) // PIECE + 1)]
            held = {(i, h) for i, h, _, _, _ in anchors_of([x[3] for x in cut], span, anchor)}
            yield pd.DataFrame([(*cut[i][:3], h) for i, h in held], columns=["t1", "t2", "piece", "h"])

    # Shuffled once, for the counts and for the way back, with the pieces of a common phrase over SALTS tasks.
    found = long_.mapInPandas(find, "t1 long, t2 long, piece int, h long").withColumn("salt", F.pmod(F.xxhash64("t1", "piece"), F.lit(SALTS)))
    found = found.where("t1 is not null and t2 is not null and h is not null and salt is not null").repartition("h", "salt")
    part = found.groupBy("h", "salt").agg(F.min(F.struct("t1", "t2", "piece")).alias("least"), F.max("t1").alias("most"), F.count(F.lit(1)).alias("n"))
    every = W.partitionBy("h")  # of one phrase, SALTS rows at most
    part = part.select("h", "salt", F.min("least").over(every).alias("home"), F.max("most").over(every).alias("most"), F.sum("n").over(every).alias("n"))
    spread = F.when(F.col("n") > hot, F.ceil(F.col("n") / hot)).otherwise(1).cast("int")
    recurring = part.where("home.t1 <> most").select("h", "salt", "home", spread.alias("shards"))
    own = F.struct("t1", "t2", "piece") == F.col("home")
    # A home's piece goes to all shards of its phrases, to bring them; any other to one.
    routes = found.join(recurring, ["h", "salt"]).select("t1", "t2", "piece", "h", "home", "shards", own.alias("own"))
    routes = routes.withColumn("shard", F.explode(F.when(F.col("own"), F.sequence(F.lit(0), F.col("shards") - 1)).otherwise(F.array(F.pmod(F.xxhash64("t1", "piece"), F.col("shards")).cast("int")))))
    routes = routes.repartition("t1", "t2").groupBy("t1", "t2", "piece", "home", "shards", "shard").agg(F.collect_list(F.when(F.col("own"), F.col("h"))).alias("hs"))
    at = F.col("piece") * PIECE
    routed = long_.join(routes, ["t1", "t2"]).select("home", "shards", "shard", "t1", "t2", at.alias("offset"), F.substring("text", at + 1, F.lit(PIECE + span - 1)).alias("ctx"), "hs")
    routed = routed.withColumn("home", F.xxhash64("home")).repartition("home", "shards", "shard").sortWithinPartitions("home", "shards", "shard", F.size("hs").desc())

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["t1", "t2", "start", "end", "w1", "w2"]
        phrases: list[str] = []
        rows: list[tuple[int, int, int, str]] = []
        held, key, wide = 0, None, False

        def compared() -> pd.DataFrame:
            got = pd.DataFrame(list(shared_windows(phrases, rows, span, anchor)), columns=names[:4])
            return got.assign(w1=None, w2=None)

        def digested() -> pd.DataFrame:
            of, first, h1, h2 = windows_around(phrases, [r[3] for r in rows], span, anchor)
            t1, t2, offset = (np.array([r[j] for r in rows], np.int64)[of] for j in range(3))
            return pd.DataFrame({"t1": t1, "t2": t2, "start": offset + first, "end": offset + first + span, "w1": h1.view(np.int64), "w2": h2.view(np.int64)})

        for b in batches:
            for home, shards, shard, t1, t2, offset, ctx, hs in b.itertuples(index=False, name=None):
                if key != (home, shards, shard):
                    # Homes whose pieces are compared here share an automaton; a spread one, or one too large, has its own.
                    alone = key is not None and (wide or key[1] > 1)
                    if alone or shards > 1 or len(phrases) >= PHRASES or held >= HELD:
                        if rows:
                            yield digested() if alone else compared()
                        phrases, rows, held = [], [], 0
                    key, wide, since = (home, shards, shard), False, (len(phrases), len(rows))
                if len(hs):
                    phrases.extend(phrases_of(ctx, set(hs), span, anchor))
                rows.append((t1, t2, offset, ctx))
                held += len(ctx)
                if held >= HELD and (wide or shards > 1 or since == (0, 0)):
                    wide = True
                    yield digested()
                    rows, held = [], 0
                elif held >= 2 * HELD:  # the homes before are done with first, those of this one go on alone
                    old = phrases[: since[0]], rows[: since[1]]
                    (phrases, rows), new = old, (phrases[since[0] :], rows[since[1] :])
                    yield compared()
                    phrases, rows = new
                    held, since = sum(len(r[3]) for r in rows), (0, 0)
        if rows:
            yield digested() if wide or key[1] > 1 else compared()

    located = checkpointed(routed.mapInPandas(locate, "t1 long, t2 long, start int, end int, w1 long, w2 long"))
    usual = located.where("w1 is null").select("t1", "t2", "start", "end")
    digests = located.where("w1 is not null")
    twice = digests.groupBy("w1", "w2").agg(F.min(F.struct("t1", "t2")).alias("x"), F.max(F.struct("t1", "t2")).alias("y")).where("x <> y").select("w1", "w2")
    hot_windows = digests.join(twice, ["w1", "w2"]).select("t1", "t2", "start", "end")
    parts = usual.unionByName(hot_windows).groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "end")).alias("iv")).select("t1", "t2", _union_length(F.col("iv")).alias("part"))
    sizes = keyed.groupBy("t1", "t2").agg(F.first("n_chars").alias("n_chars")).join(copies, ["t1", "t2"])  # without the texts
    sized = sizes.join(parts, ["t1", "t2"], "left")
    amount = F.when((F.col("n_copies") > 1) & (F.col("n_chars") >= span), F.col("n_chars")).otherwise(F.coalesce("part", F.lit(0)))
    per_text = sized.select("t1", "t2", "n_chars", "n_copies", amount.alias("n_shared"))
    return recs.join(per_text, ["t1", "t2"]).select("rec", "n_chars", "n_shared", "n_copies")
