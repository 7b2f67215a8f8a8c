"""Column functions against tables of cases."""

import pytest
from pyspark.sql import functions as F

from veriloom.functions import text as T


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} string" for k in cols) or "x string"
    return spark.createDataFrame([tuple(cols.values()) or ("",)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("raw,want", [("Café 12-b", ["caf", "12", "b"]), ("", []), (None, None), ("ÀB", ["b"])])
def test_tokenize(spark, raw, want):
    assert one(spark, T.tokenize("a"), a=raw) == want


@pytest.mark.parametrize("raw,want", [("  “A”\t\n B ", '"a" b'), ("—x–", "-x-"), ("", ""), (None, None)])
def test_norm_quote(spark, raw, want):
    assert one(spark, T.norm_quote("a"), a=raw) == want


@pytest.mark.parametrize("q,c,t,want", [("b c", None, "A B  C", True), ("", None, "x", False), ("ctx", "CTX", "x", True), (None, None, "x", False), ("x y", "x", "y", True)])
def test_quote_in(spark, q, c, t, want):
    assert one(spark, T.quote_in("q", "c", "t"), q=q, c=c, t=t) is want


@pytest.mark.parametrize("v,n,want", [("faithful", 1, "faithful"), ("faithful", 0, "unsupported"), ("contradicted", 0, "absent"), ("absent", 0, "absent")])
def test_ground_verdict(spark, v, n, want):
    assert one(spark, T.ground_verdict("v", F.lit(n)), v=v) == want


@pytest.mark.parametrize("u,want", [("HTTP://Ex.org:80/A/b//?q#f", "ex.org:80/A/b"), ("https://u@h/", "u@h"), ("nothing", "")])
def test_normalize_url(spark, u, want):
    assert one(spark, T.normalize_url("u"), u=u) == want


@pytest.mark.parametrize("w,want", [("make", 1), ("the", 1), ("superannuation", 5), ("rhythm", 1), ("queue", 1)])
def test_syllables(spark, w, want):
    assert one(spark, T.syllables("w"), w=w) == want


@pytest.mark.parametrize("i,want", [("F12a", ("F", 12, "a")), ("abc", ("abc", -1, "abc")), ("7", ("", 7, ""))])
def test_ids(spark, i, want):
    assert (one(spark, T.id_prefix("i"), i=i), one(spark, T.id_number("i"), i=i), one(spark, T.id_suffix("i"), i=i)) == want


def test_natural_key_sorts(spark):
    ids = ["a10", "a9", "a010", "b1", "a"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ids], "i string").orderBy(T.natural_key("i"), "i").collect()]
    assert got == ["a", "a9", "a010", "a10", "b1"]


@pytest.mark.parametrize("s,want", [("2/4", 0.5), ("floor", 0.0), ("1/0", 0.0), (None, 0.0)])
def test_spread_ratio(spark, s, want):
    assert one(spark, T.spread_ratio("s"), s=s) == want


def test_verbatim_run(spark):
    assert one(spark, T.verbatim_run("a", F.array("b"), 3), a="we saw The Old House there", b="in the old house") == "the old house"
    assert one(spark, T.verbatim_run("a", F.array("b"), 3), a="two words", b="two words") == ""


@pytest.mark.parametrize("s,want", [("2024-05-31", "2024-05-31"), ("31/05/2024", "2024-05-31"), ("20240531", "2024-05-31"), ("31 May 2024", "2024-05-31"), ("99/99/2024", None), (None, None)])
def test_iso_date(spark, s, want):
    assert one(spark, T.iso_date("s").cast("string"), s=s) == want


@pytest.mark.parametrize("t,want", [("In 2004 it fell", True), ("We met in Lorwick", True), ("Only the first", False), ("an anti-American view", False), ("the pre-Budget vote", False), ("by USAid now", True), ("in (York), then", True), ("the ABC", False), ("a", False), (None, False)])
def test_number_or_place(spark, t, want):
    assert one(spark, T.has_number_or_place("t"), t=t) is want


def test_unit_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(T.unit_vector("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


@pytest.mark.parametrize("p,want", [("2024-02-14/1_x#t9", "hearing:2024-02-14/1_x"), ("submission-3#p1", "submission:3"), ("submission-03.2#p1", "submission:3/attachment-2"), ("submission-x#p1", ""), ("qon-a-b-2024-02-14#p2", "qon:a-b/2024-02-14"), ("qon-a-b#p2", ""), ("leaderboards/x#p1", "leaderboards/x.txt"), ("report-1-x#p2#1", "report-1-x.pdf"), ("a/b#p1", ""), ("no", ""), (None, "")])
def test_canonical_doc(spark, p, want):
    assert one(spark, T.canonical_doc("p"), p=p) == want


@pytest.mark.parametrize("t,c,want", [("A reader may look", "", "reader"), ("The superannuation plan", "superannuation", ""), ("The superannuation plan", "plan", "superannuation"), ("It is so", "", "")])
def test_plain_bad_word(spark, t, c, want):
    assert one(spark, T.plain_bad_word("t", T.run_tokens("c", digits=False)), t=t, c=c) == want


@pytest.mark.parametrize("t,want", [("It is not so", "not"), ("rather than that", "rather than"), ("a knot", ""), ("", "")])
def test_contrast_word(spark, t, want):
    assert one(spark, T.contrast_word("t"), t=t) == want
