"""Chains and trees against small cases and brute force."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriloom.functions.vocab import WORST_FIRST
from veriloom.operators import chains as C
from veriloom.operators import grounding as G
from veriloom.operators import retrieval as R
from veriloom.operators import segmenting as S
from veriloom.operators import trees as E

ROW = "chain string, idx int, record_id long, claim_id string, verdict string, samples array<string>"


def brute(samples):
    n, count = len(samples), Counter(samples)
    rank = lambda v: WORST_FIRST.index(v) if v in WORST_FIRST else len(WORST_FIRST)
    best = min(count, key=lambda v: (-count[v], rank(v), v))
    side = lambda v: "y" if v in ("faithful", "partial") else "n" if v in ("overstated", "absent", "contradicted", "unsupported") else v
    tied = [v for v in count if count[v] == count[best]]
    cls = "settled" if len(count) == 1 else "contested" if len(tied) > 1 else "wobble" if len({side(v) for v in count}) == 1 else "contested"
    return best, count[best], n, "" if n < 2 else f"{count[best]}/{n}", "" if n < 2 else ", ".join(v for v in dict.fromkeys(samples) if v != best), cls, "/".join(sorted(tied, key=lambda v: (rank(v), v))) if len(tied) > 1 else ""


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["faithful", "partial", "absent", "error", "odd"]), min_size=0, max_size=5), min_size=1, max_size=4))
def test_tallied_matches_brute_force(spark, runs):
    rows = [(f"c{i}", 0, i, "x", r[0] if r else "faithful", r or None) for i, r in enumerate(runs)]
    got = C.merged(spark.createDataFrame(rows, ROW), "claim_id", ["chain", "idx", "record_id"]).first()
    flat = [v for i, r in enumerate(runs) for v in (r or ["faithful"])]
    assert (got["verdict"], got["k"], got["n"], got["spread"], got["dissent"], got["stability"], got["split"]) == brute(flat)
    own = [i for i, r in enumerate(runs) if (r[0] if r else "faithful") == got["verdict"]]
    assert got["rep_record_id"] == (own[0] if own else 0)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ROW)
    assert C.merged(none, "claim_id", ["chain"]).count() == 0
    assert C.gaps(spark.createDataFrame([], ROW + ", mode string")).count() == 0


def test_last_wins_and_gaps(spark):
    rows = spark.createDataFrame([("a", 0, 1, "x", "v1", None, "m"), ("a", 0, 2, "x", "v2", None, "m"), ("a", 3, 3, "y", "v3", None, "m")], ROW + ", mode string")
    assert C.last_wins(rows, ["chain", "idx"], ["record_id"]).where("idx = 0").first()["verdict"] == "v2"
    assert C.gaps(rows).first()["n_missing"] == 2


def test_as_of(spark):
    left = spark.createDataFrame([("k", 5, "a"), ("k", 1, "b"), ("z", 9, "c")], "key string, at int, tag string")
    right = spark.createDataFrame([("k", 2, 20), ("k", 5, 50), ("k", 9, 90)], "key string, at int, v int")
    assert {r["tag"]: r["v"] for r in C.as_of(left, right, "key", "at", "v").collect()} == {"a": 50, "b": None, "c": None}


def node(n, p, o, d, q=False, own=None, e=False):
    return (n, p, o, d, q, e, own)


@pytest.mark.parametrize("kids,want", [
    ([("a", False, "holds", False), ("b", False, "fails", False)], ("fails", "b")),
    ([("a", True, "fails", False), ("b", False, "weakened", False)], ("open", "a?")),
    ([("a", False, "opinion", False)], ("opinion", "")),
    ([("a", False, "opinion", True)], ("open", "")),
    ([("a", False, "fails", True)], ("fails", "a")),
    ([("a", False, "holds", False)], ("holds", "")),
    ([("a", False, "holds", True)], ("open", "")),
])
def test_rolled_up(spark, kids, want):
    rows = [node("r", None, 0, 0)] + [node(n, "r", i, 1, q, own, e) for i, (n, q, own, e) in enumerate(kids)]
    df = spark.createDataFrame(rows, "node string, parent string, ord long, depth int, query boolean, edge_open boolean, own string")
    got = {r["node"]: (r["judgement"], r["deciding"]) for r in E.rolled_up(df).collect()}
    assert got["r"] == want


def test_regroup_wide(spark):
    tree = spark.createDataFrame([(f"s{i}", "r", 1) for i in range(1, 10)], "node string, parent string, depth int")
    got = {r["node"]: r["grp"] for r in E.regrouped(tree).collect()}
    assert got["s1"] == 0 and got["s8"] == 1


def test_bm25_by_hand(spark):
    p = spark.createDataFrame([("a", "cat cat dog"), ("b", "dog"), ("c", "")], "pid string, text string")
    got = {r["pid"]: r["score"] for r in R.bm25(spark.createDataFrame([("q", "cat cat")], "qid string, text string"), p).collect()}
    import math
    n, df, tf, dl, avg = 3, 1, 2, 3, 4 / 3
    want = 2 * math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == {"a": pytest.approx(want, abs=1e-6)}


def test_budget_keeps_first(spark):
    rows = spark.createDataFrame([("q", "a", 1, 50), ("q", "b", 2, 10), ("q", "c", 3, 1)], "qid string, pid string, rk int, dl int")
    assert [r["pid"] for r in R.within_budget(rows, 20).collect()] == ["a"]
    assert sorted(r["pid"] for r in R.within_budget(rows, 60).collect()) == ["a", "b"]


def test_fused_by_best_rank(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "qid string, pid string, rk int")
    b = spark.createDataFrame([("q", "z", 1), ("q", "y", 3)], "qid string, pid string, rk int")
    assert [r["pid"] for r in R.fused(a, b).orderBy("rk").collect()] == ["x", "z", "y"]


def test_located_equals_containment(spark):
    texts = ["The old house by the river was sold again.", "A river. The old house by", "x", ""]
    quotes = ["old house by the river was sold", "river", "The old house by", "", "old", "ld house b", "house by the"]
    p = spark.createDataFrame([(str(i), None, t) for i, t in enumerate(texts)], "pid string, context string, text string")
    q = spark.createDataFrame([(1, i, t) for i, t in enumerate(quotes)], "key long, pos int, quote string")
    got = {(r["pos"], r["pid"]) for r in G.located(q, p).collect()}
    assert got == {(i, str(j)) for i, a in enumerate(quotes) for j, b in enumerate(texts) if a and " ".join(a.lower().split()) in " ".join(b.lower().split())}


def test_segmenters(spark):
    long_ = "x" * 200
    d = spark.createDataFrame([("d", f"short\n\n{long_}\n\ntail\f{'y' * 45}")], "doc string, text string")
    assert [r["passage"][:5] for r in S.merged_fragments(d).orderBy("no").collect()] == ["short", "tail\f"]
    assert [(r["page"], r["no"]) for r in S.pages(d).orderBy("page", "no").collect()] == [(1, 0), (2, 0)]
    assert S.paragraphs(d).count() == 2
    t = spark.createDataFrame([("d", "lost\nMs SMITH: one\ntwo\nThe CHAIR:\nMr LEE: three")], "doc string, text string")
    got = [(r["no"], r["speaker"], r["speech"]) for r in S.speaker_turns(t).orderBy("no").collect()]
    assert got == [(0, "Ms SMITH", "one\ntwo\nThe CHAIR:"), (1, "Mr LEE", "three")]
    t = spark.createDataFrame([("d", "Ms McDONALD: a\nDr Jane MacLEAN: b\n   The CHAIR: c\nNOTE:yes\nSo he said: d\n         Mr FAR: e")], "doc string, text string")
    got = [(r["speaker"], r["speech"]) for r in S.speaker_turns(t).orderBy("no").collect()]
    assert got == [("Ms McDONALD", "a"), ("Dr Jane MacLEAN", "b"), ("The CHAIR", "c\nNOTE:yes\nSo he said: d\n         Mr FAR: e")]
    head = spark.createDataFrame([("MEMBERS\nAda Lorne   Ben McVay\nchair\nMs SMITH: I am Cy Marr",), (None,)], "t string")
    assert [r[0] for r in head.select(S.roster_names(F.col("t"))).collect()] == [["LORNE", "MCVAY"], None]


def test_roles(spark):
    df = spark.createDataFrame([("The CHAIR",), ("Ms SMITH",), ("Mr LEE",)], "s string")
    assert [r[0] for r in df.select(S.role_of(F.col("s"), F.array(F.lit("SMITH")))).collect()] == ["chair", "questioner", "witness"]
