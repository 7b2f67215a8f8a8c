"""Readers, sinks, parsing, edges, grouping, judge and stream on small files and cases."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriloom import judge as J
from veriloom.functions import verdicts as V
from veriloom.operators import chains as CH
from veriloom.operators import edges as E
from veriloom.operators import grouping as O
from veriloom.operators import parsing as X
from veriloom.sources import files as S
from veriloom.streaming import chain_stream as C


@pytest.mark.parametrize("text,want", [
    ('```json\n{"a": [1, 2,],}\n``` done', {"a": [1, 2]}), ('so {not json} but [1]', [1]), ('{"a": ",}"}', {"a": ",}"}), ('{"a": 1', None), ("", None), (None, None), ("none", None), ('{"q": "a \\" } b"} tail }', {"q": 'a " } b'}),
])
def test_loose_json(text, want):
    assert X.loose_json(text) == want


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8).filter(lambda x: isinstance(x, (dict, list))))
def test_loose_json_round_trip(value):
    if "```" not in json.dumps(value):
        assert X.loose_json("Sure: " + json.dumps(value) + " .") == value


@pytest.mark.parametrize("text,want", [
    ("# title: x\n1. One\n\n- Two\n", ["One", "Two"]), ("1. One thing. 2. Another thing", ["One thing.", "Another thing"]), ("Just one", ["Just one"]), ("", []), (None, []), ("10) ten", ["10) ten"]),
])
def test_summary_claims(spark, text, want):
    df = spark.createDataFrame([(1, text)], "k int, t string")
    assert [r["claim"] for r in X.summary_claims(df, "k", "t").orderBy("no").collect()] == want


def test_prose_and_cites(spark):
    df = spark.createDataFrame([("The committee heard that the roof was old and unsafe for years.",), ("TABLE OF CONTENTS 4",), ("See Submission 12 Attachment 3, submission 4 and Submission 12 Attachment 3",)], "t string")
    assert [r[0] for r in df.select(X.is_prose("t")).collect()] == [True, False, True]
    assert [r[0] for r in df.select(X.cited_documents("t")).collect()][2] == ["submission:12/attachment-3", "submission:4"]
    assert [r[0] for r in df.select(X.kinds_of("t")).collect()][0] == "testimony"


def test_nearest_note(spark):
    marks = spark.createDataFrame([("d", 1, 10), ("d", 1, 40), ("d", 2, 5)], "doc string, number int, line int")
    notes = spark.createDataFrame([("d", 1, 7), ("d", 1, 9), ("d", 1, 30), ("e", 2, 6)], "doc string, number int, note_line int")
    assert {(r["line"], r["note_line"]) for r in X.nearest_note(marks, notes).collect()} == {(10, 7), (40, 30)}


def test_claims_file(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# Title: A report\n# date: 2024\n\nF1\tp3=Part\tThe claim\tsub-1, qon\tsource\nbare claim\nx\ty\n")
    got = S.claims(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r["idx"], r["id"], r["text"], list(r["cites"]), r["route"]) for r in got] == [(0, "F1", "The claim", ["sub-1", "qon"], "source"), (1, "", "bare claim", [], ""), (2, "", "x\ty", [], "")]
    assert S.headers(spark, str(tmp_path)).select("title", "date").first()[:] == ("A report", "2024")


def test_views_file(spark, tmp_path):
    (tmp_path / "v.txt").write_text("# who\nF1 | absent | a quote | p12 | AB | why\nF2|faithful||7|CD|\n")
    assert [(r["id"], r["page"]) for r in S.views(spark, str(tmp_path)).orderBy("no").collect()] == [("F1", 12), ("F2", 7)]
    (tmp_path / "v.txt").write_text("F1 | absent\n")
    with pytest.raises(Exception, match="six fields"):
        S.views(spark, str(tmp_path)).collect()


def test_references_and_map(spark, tmp_path):
    (tmp_path / "r.txt").write_text("F1 | route=x | ref=§2.1 p3 | c\nF2 | c\n")
    assert [r[:] for r in S.references(spark, str(tmp_path / "r.txt")).collect()] == [("F1", "§2.1 p3")]
    (tmp_path / "m.json").write_text('{"F1": ["a", "b"]}')
    assert [r[:] for r in S.oracle_map(spark, str(tmp_path / "m.json")).orderBy("pos").collect()] == [("F1", 0, "a"), ("F1", 1, "b")]
    (tmp_path / "m.json").write_text("{}")
    with pytest.raises(Exception, match="empty"):
        S.oracle_map(spark, str(tmp_path / "m.json")).collect()


def test_chain_files(spark, tmp_path):
    rec = lambda i, v, m="faithfulness": json.dumps({"idx": i, "mode": m, "verdict": v, "detail": {"quotes": ["q"]}})
    p = tmp_path / "c.jsonl"
    p.write_text("\n".join([rec(0, "a"), rec(1, "b"), rec(0, "c"), ""]))
    assert {(r["idx"], r["verdict"]) for r in S.chain_strict(spark, str(p)).collect()} == {(0, "c"), (1, "b")}
    p.write_text("\n".join([rec(0, "a"), '{"idx": 2, "mo', rec(3, "b"), rec(1, "s", "substance")]))
    assert {(r["idx"], r["verdict"]) for r in S.chain_sparse(spark, str(p)).collect()} == {(0, "a"), (3, "b")}
    assert {(r["idx"], r["verdict"]) for r in S.chain_sparse(spark, str(p), "substance").collect()} == {(1, "s")}
    with pytest.raises(Exception, match="not whole"):
        S.chain_strict(spark, str(p)).collect()


def test_append_chain(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", None), (1, None, "x")], "idx int, verdict string, route string")
    S.append_chain(df, str(tmp_path / "out"))
    S.append_chain(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def test_trees_and_manifests(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# c\nOLD\nR | root | \n  A ? | a | scheme=trend; n\n    F1\n  B | b\n")
    got = {(r["node"], r["parent"], r["depth"], r["query"], r["scheme"]) for r in S.argument_trees(spark, str(tmp_path / "t.txt")).collect()}
    assert got == {("R", None, 0, False, ""), ("A", "R", 1, True, "trend"), ("F1", "A", 2, False, ""), ("B", "R", 1, False, "")}
    with pytest.raises(ValueError, match="unknown scheme"):
        S.parse_tree("R | r | scheme=bad")
    paths = spark.createDataFrame([("/s/hearings/2024-01-02/3_a-b.txt",), ("/s/submissions/12.2-some-body.txt",), ("/s/submissions/7-x.txt",), ("/s/qon/dept-2024-05-06.txt",), ("/s/qon/odd.txt",)], "path string")
    m = S.manifest_of(paths)
    assert {r["doc"]: r["label"] for r in m.collect()} == {"hearing:2024-01-02/3_a-b": "Hearing 2024-01-02 — A B", "submission:12/attachment-2": "Submission 12 Attachment 2 — Some Body", "submission:7": "Submission 7 — X", "qon:dept/2024-05-06": "QoN response — DEPT, 2024-05-06"}
    (tmp_path / "M.md").write_text("\n".join(r["text"] for r in S.manifest_lines(m).collect()))
    back = {r["doc"]: r["label"] for r in S.manifest(spark, str(tmp_path / "M.md")).collect()}
    assert back["hearing:2024-01-02/3_a-b"] == "A B" and len(back) == 4


def test_corpus_routes(spark, tmp_path):
    for p in ("submissions/1-a.txt", "qon/b.txt", "hearings/x/c.txt", "hearings/x/no.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("text")
    assert sorted(r["route"] for r in S.corpus(spark, str(tmp_path)).collect()) == ["hearing", "qon", "submission"]


def test_responses(spark):
    df = spark.createDataFrame([(1, 'Here: {"verdict": "absent", "n": 2,}'), (2, "sorry"), (3, None)], "k long, t string")
    got = {r["k"]: r["r"] for r in S.responses(df, "k", "t", "verdict string, n int").collect()}
    assert (got[1]["verdict"], got[1]["n"]) == ("absent", 2) and got[2] is None and got[3] is None


@pytest.mark.parametrize("row,want", [(("", "s", "condition", "a b"), "world"), (("w", " ", "condition", "a b"), "settles"), (("w", "s", "odd", "a b"), "kind"), (("w", "s", "condition", "zz"), "anchor"), (("w", "s", "condition", None), "anchor"), (("w", "s", "condition", "A  b"), "")])
def test_failed_step(spark, row, want):
    df = spark.createDataFrame([(*row, ["x a b y", None])], "w string, s string, k string, a string, t array<string>")
    assert df.select(E.failed_step("w", "s", "k", "a", "t")).first()[0] == want


def test_edges(spark):
    s = spark.createDataFrame([("e", "open"), ("e", "unchallenged"), ("f", "open"), ("f", "open"), ("f", "error")], "edge string, verdict string")
    assert {(r["edge"], r["verdict"], r["k"], r["n"]) for r in E.modal_edges(s).collect()} == {("e", "unchallenged", 1, 2), ("f", "open", 2, 2)}
    e = spark.createDataFrame([("a", 0, "open", "X y", "w1", "s1"), ("b", 1, "open", "x  Y", "w2", "s2"), ("c", 2, "open", "", "w3", "s3"), ("d", 3, "unchallenged", "x y", "w4", "s4")], "edge string, ord int, verdict string, anchor string, world string, settles string")
    cleared, notes = E.lifted(e)
    assert {r["edge"]: (r["verdict"], r["world"]) for r in cleared.collect()} == {"a": ("unchallenged", None), "b": ("unchallenged", None), "c": ("open", "w3"), "d": ("unchallenged", None)}
    assert [r[:] for r in notes.collect()] == [("X y", "w1", "s1", 2)]


def test_disputed(spark):
    n = spark.createDataFrame([("r", None, 0, False, False), ("a", "r", 1, False, False), ("b", "r", 1, True, False), ("x", "a", 2, False, False), ("y", "b", 2, False, False)], "node string, parent string, depth int, query boolean, edge_open boolean")
    j = spark.createDataFrame([("r", "fails"), ("a", "fails"), ("b", "fails"), ("x", "fails"), ("y", "fails")], "node string, judgement string")
    got = {r[:] for r in E.disputed(n, j, spark.createDataFrame([("x",), ("y",)], "leaf string")).collect()}
    assert got == {("x", "x"), ("a", "x"), ("r", "x"), ("y", "y"), ("b", "y")}


def test_grouping_matches_brute_force(spark):
    import random

    rng = random.Random(4)
    sets = {(c, i): {rng.choice("abcdefg") for _ in range(rng.randint(0, 4))} for c in "xy" for i in range(12)}
    rows = [(c, i, p) for (c, i), s in sets.items() for p in (s or [None])]
    want = {}
    for c in "xy":
        used = set()
        for i in range(12):
            if i in used:
                continue
            used.add(i)
            want[c, i] = i
            for j in range(i + 1, 12):
                a, b = sets[c, i], sets[c, j]
                if j not in used and a and b and 2 * len(a & b) >= min(len(a), len(b)):
                    used.add(j)
                    want[c, j] = i
    got = {(r["chain"], r["idx"]): r["seed"] for r in O.grouped(spark.createDataFrame(rows, "chain string, idx int, pid string")).collect()}
    assert got == want


def test_judge(spark):
    class Odd:
        name = "odd"

        def judge(self, claim, passages, sample):
            if claim == "bad":
                raise ValueError(claim)
            return {"verdict": "absent"} if sample else {}

    c = spark.createDataFrame([(1, "The council funded the library in March"), (2, "bad")], "key long, claim string")
    p = spark.createDataFrame([(1, 0, "p1", "It rained. The council funded the library in March.")], "key long, pos int, pid string, text string")
    got = {r["key"]: r for r in J.judged(c, p, J.OverlapJudge()).collect()}
    assert got[1]["verdict"] == "faithful" and got[1]["quotes"][0]["pid"] == "p1" and got[2]["verdict"] == "absent"
    odd = {(r["key"], r["sample"]): (r["verdict"], r["calls"]) for r in J.judged(c, p, Odd(), 2).collect()}
    assert odd == {(1, 0): ("error", 2), (1, 1): ("absent", 1), (2, 0): ("error", 2), (2, 1): ("error", 2)}
    assert J.passages_block(p).first()["block"].startswith("[p1] It rained.")


def test_stream_resumes(spark, tmp_path):
    src, out, ck = (tmp_path / x for x in ("in", "out", "ck"))
    src.mkdir()
    rec = lambda i, v: json.dumps({"record_id": i, "chain": "c", "idx": i, "verdict": v, "written_at": "2024-01-01T00:00:00Z"})
    (src / "a.json").write_text(rec(1, "absent") + "\n" + rec(1, "absent") + "\n" + rec(2, "partial"))
    C.drain(C.records(spark, str(src)), str(out), str(ck))
    (src / "b.json").write_text(rec(2, "partial") + "\n" + rec(3, "partial"))
    C.drain(C.records(spark, str(src)), str(out), str(ck))
    assert sorted(r["record_id"] for r in spark.read.parquet(str(out)).collect()) == [1, 2, 3]
    tallied = spark.read.parquet(str(out)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    assert {r[:] for r in tallied.collect()} == {("absent", 1), ("partial", 2)}


def one(spark, expr, schema, *values):
    return spark.createDataFrame([values], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("v,h,cited,got,want", [
    ("supported", "past", ["http://a.org/x/"], ["https://A.org/x?q"], ("supported", None, "", 1)),
    ("supported", "future", ["http://a.org/x"], ["http://a.org/x"], ("unverifiable", "supported", "forecast — projections are not evidence", 0)),
    ("supported", "past", [], ["http://a.org"], ("unverifiable", "supported", "no URLs cited in response", 0)),
    ("refuted", None, ["http://b.org"], None, ("unverifiable", "refuted", "no sources retrieved; verdict is model self-report", 0)),
    ("mixed", "past", ["http://b.org"], ["http://a.org"], ("unverifiable", "mixed", "claimed sources not present in retrieval", 0)),
    ("error", "future", None, None, ("error", None, "", 0)),
])
def test_cross_checked(spark, v, h, cited, got, want):
    r = one(spark, V.cross_checked("v", "h", "c", "g"), "v string, h string, c array<string>, g array<string>", v, h, cited, got)
    assert (r["verdict"], r["original"], r["reason"], r["matched"]) == want


@pytest.mark.parametrize("t,want", [("According to Ada Lorne it fell", "Lorne"), ("Ben de Marr said so", ""), ("As Cy Van Marr told us", "Marr"), ("Nobody said", ""), ("Ada Lorne said that according to Ben Marr it fell", "Lorne"), ("as Ada Lorne often did", "Lorne")])
def test_named_witness(spark, t, want):
    assert one(spark, V.named_witness("t"), "t string", t) == want


def test_verdict_wording(spark):
    s = "v string, r string, s string, c string"
    assert one(spark, V.stakes("v", "r", "s"), s, "partial", "A", "B", "C") == "The report says A. The source only says B."
    assert one(spark, V.stakes("v", "r", "s"), s, "partial", "A", " ", "C") == "" and one(spark, V.stakes("v", "r", "s"), s, "absent", "A", None, "C").endswith("No held source says this.")
    assert one(spark, V.intended("v", "c", "s"), s, "overstated", "A", "B", "C") == "B" and one(spark, V.intended("v", "c", "s"), s, "faithful", "A", "B", "C") == "C"
    assert one(spark, V.hit_rate(F.lit(3), F.lit(1)), s, "", "", "", "") == 0.75 and one(spark, V.hit_rate(F.lit(0), F.lit(0)), s, "", "", "", "") == 0
    assert one(spark, V.cited_bases("v"), s, "paper:x, report-1.txt a.txt", "", "", "") == ["papers/x", "a"]


def test_joins_with_fallback(spark):
    rows = spark.createDataFrame([(0, "A ", "x"), (1, "B", "y")], "idx int, claim string, v string")
    other = spark.createDataFrame([(0, "A", "s0"), (1, "other", "s1")], "idx int, claim string, sub string")
    assert {r["idx"]: r["sub"] for r in CH.overlaid(rows, other, ["sub"]).collect()} == {0: "s0", 1: None}
    claims = spark.createDataFrame([("F1",), ("M2",), ("3",)], "id string")
    reports = spark.createDataFrame([("r0", 0, ["F"]), ("r1", 1, []), ("r2", 2, ["F", "G"])], "report string, ord int, prefixes array<string>")
    assert {r["id"]: r["report"] for r in CH.routed(claims, reports).collect()} == {"F1": "r0", "M2": "r1", "3": "r1"}
    assert {r["idx"]: r["v"] for r in CH.capped(rows, 1, "idx", "v").collect()} == {0: "x", 1: "skipped (over cap)"}
    leaves = spark.createDataFrame([("F1",), ("F9",), ("x",)], "node string")
    assert [r["node"] for r in CH.unmatched_leaves(leaves, claims).collect()] == ["F9"]


def test_footnotes(spark):
    text = "Prose here.12 More:3 and 40% of 2004.\n\n12\n\nJones, Report, 2019,\np. 4.\n\n7\n\nnot a note\n\n3\nIbid.\n"
    df = spark.createDataFrame([("d", text)], "k string, t string")
    assert [(r["number"], r["note"]) for r in X.footnotes(df, "k", "t").orderBy("no").collect()] == [(12, "Jones, Report, 2019, p. 4."), (3, "Ibid.")]
    assert df.select(X.note_marks("t")).first()[0] == [12, 3]
