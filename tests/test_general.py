"""Schema drift and nested records on small cases."""

import json

from veriloom.operators import drift, nested

LINES = "series string, file_name string, line_no int, line_id long, written_at timestamp, raw string, kind string"


def lines(spark, *rows):
    import datetime as dt

    return spark.createDataFrame([("s", f, n, i, dt.datetime(2024, 1, day), raw if isinstance(raw, (str, type(None))) else json.dumps(raw), "x") for i, (f, n, day, raw) in enumerate(rows)], LINES)


def found(df):
    return {(r["file_name"], r["change_kind"], r["field"], r["new_field"]) for r in drift.schema_changes(df).collect()}


def test_rename_add_remove_retype(spark):
    df = lines(
        spark,
        ("a", 0, 1, {"idx": 0, "route": "x", "n": 1, "gone": True, "detail": {"q": "1"}}), ("a", 1, 1, {"idx": 1, "route": "y", "n": 2, "detail": {"q": "2"}}), ("a", 2, 1, '{"idx": 2, "cut'),
        ("b", 0, 2, {"idx": "0", "settles": "x", "n": "1", "q": "1", "fresh": [1]}), ("b", 1, 2, {"idx": 1, "settles": "z", "n": None, "q": "2"}), ("b", 2, 2, None), ("b", 3, 2, "[1]"),
    )
    assert found(df) == {("b", "renamed", "route", "settles"), ("b", "renamed", "detail.q", "q"), ("b", "removed", "gone", ""), ("b", "added", "fresh", ""), ("b", "retyped", "idx", ""), ("b", "retyped", "n", "")}


def test_last_line_holds_and_order_by_time(spark):
    df = lines(spark, ("z", 0, 1, {"idx": 0, "a": 1}), ("z", 1, 1, {"idx": 0, "a": 5}), ("b", 0, 3, {"idx": 0, "b": 5}))
    assert found(df) == {("b", "renamed", "a", "b")}
    assert found(lines(spark, ("z", 0, 1, {"idx": 0, "a": 5}), ("z", 1, 1, {"idx": 0, "a": 1}), ("b", 0, 3, {"idx": 0, "b": 5}))) == {("b", "removed", "a", ""), ("b", "added", "b", "")}


def test_drift_empty_and_unified(spark):
    assert found(spark.createDataFrame([], LINES)) == set()
    df = lines(spark, ("a", 0, 1, {"idx": 0, "x": "v"}), ("b", 0, 2, {"idx": 0, "y": "v"}))
    assert {tuple(sorted(r["fields"])) for r in drift.unified(df, drift.schema_changes(df)).collect()} == {("idx", "y")}


def typed(df):
    return drift.typed(drift.unified(df, drift.schema_changes(df)))


def test_unified_casts_to_one_type(spark):
    recs = [
        {"idx": 0, "samples": ["a", "b"], "elapsed_s": 13.89, "spread": "3/5", "backend": "x", "passages": [{"id": "p1", "rank": 1}, "p2"], "quotes": ["one, two"], "n": 3, "bad": 1, "line_id": "q", "detail": {"on": True}},
        {"idx": "1", "samples": "a, b", "elapsed_s": "10.3s", "spread": {"k": 3, "n": 5}, "backend": {"name": "x", "local": False}, "passages": "p1,p2", "quotes": "three, four", "n": "3", "bad": 2, "detail": {"on": "false"}},
        {"idx": 2, "samples": "", "bad": "two", "detail": None},
    ]
    t = typed(lines(spark, *(("a", i, 1, r) for i, r in enumerate(recs))))
    kinds = dict(t.dtypes)
    a, b, c = sorted(t.collect(), key=lambda r: r["line_no"])
    assert (kinds["idx"], kinds["samples"], kinds["elapsed_s"], kinds["spread"], kinds["n"], kinds["detail.on"]) == ("bigint", "array<string>", "double", "string", "bigint", "boolean")
    assert a["samples"] == b["samples"] == ["a", "b"] and c["samples"] == [] and (a["elapsed_s"], b["elapsed_s"]) == (13.89, 10.3) and a["n"] == b["n"] == 3
    assert a["spread"] == b["spread"] == "3/5" and a["backend"] == b["backend"] == "x" and json.loads(b["backend.rest"]) == {"local": False}
    assert a["passages"] == b["passages"] == ["p1", "p2"] and a["passages.rest"] == ['{"rank": 1}', None] and b["quotes"] == ["three, four"]
    assert (a["detail.on"], b["detail.on"], a["field.line_id"], a["line_id"]) == (True, False, "q", 0)
    assert c["bad"] is None and [tuple(x) for x in c["uncast"]] == [("bad", '"two"', "no bigint")] and a["uncast"] == b["uncast"] == []


def test_unified_renames_in_file_order(spark):
    df = lines(spark, ("z", 0, 1, {"idx": 0, "zz": "v"}), ("y", 0, 2, {"idx": 0, "aa": "v"}), ("x", 0, 3, {"idx": 0, "zz": "v"}))
    assert [set(r["fields"]) for r in drift.unified(df, drift.schema_changes(df)).collect()] == [{"idx", "zz"}] * 3
    # A name used again for another field: neither value is lost.
    df = lines(spark, ("a", 0, 1, {"idx": 0, "x": "v", "y": "w"}), ("b", 0, 2, {"idx": 0, "y": "w", "n": "v"}), ("c", 0, 3, {"idx": 0, "y": "w"}), ("d", 0, 4, {"idx": 0, "n": "w"}))
    got = {r["file_name"]: r for r in typed(df).collect()}
    assert got["b"]["n"] == "v" and [x["value"] for x in got["b"]["uncast"]] == ['"w"'] and got["c"]["n"] == got["d"]["n"] == "w"
    # Series that end with different names share one.
    two = df.sparkSession.createDataFrame([("t", "e", 0, 9, None, '{"idx": 0, "zz": "v"}', "x")], LINES)
    df = lines(spark, ("a", 0, 1, {"idx": 0, "zz": "v"}), ("b", 0, 2, {"idx": 0, "aa": "v"})).unionByName(two)
    assert len({frozenset(r["fields"]) for r in drift.unified(df, drift.schema_changes(df)).collect()}) == 1


def test_typed_empty(spark):
    assert typed(spark.createDataFrame([], LINES)).count() == 0


def test_nested_children(spark):
    rows = [
        {"passages": ["p1", {"id": "p2", "rank": 1}], "detail": {"quotes": ["t0", {"text": "t1", "passage": "p2"}, {"text": "t2", "cite": {"passage": {"id": "p1"}}}, {"text": "t3", "cite": None}], "quote_passages": ["p9"]}},
        {"passages": "p1, p2", "detail": {"quotes": []}},
        {"passages": "", "detail": None},
        {"passages": None},
    ]
    df = lines(spark, *((f, 0, 1, r) for f, r in zip("abcd", rows)), ("e", 0, 1, '{"passages": ["p1"'), ("f", 0, 1, None), ("g", 0, 1, "7"))
    got = {(r["line_id"], r["child"], r["num"], r["ref_id"]) for r in nested.chain_children(nested.flat_rows(df, "chain_lines")).collect()}
    assert got == {(0, "passages", 0, "p1"), (0, "passages", 1, "p2"), (0, "quotes", 0, "p9"), (0, "quotes", 1, "p2"), (0, "quotes", 2, "p1"), (0, "quotes", 3, ""), (1, "passages", 0, "p1"), (1, "passages", 1, "p2")}


def test_nested_counts(spark):
    rows = [
        {"verdict_counts": {"a": 1, "b": "2", "c": {"n": 3, "by_run": [1, 2]}}},
        {"verdict_counts": [{"verdict": "a", "count": 4}]},
        {"result": {"passes": [{"no": 1, "verdict_counts": {"a": 5}}, {"no": 2, "verdict_counts": {"a": 6}}]}},
        {"verdict_counts": {}, "other": {"a": 9}},
    ]
    df = lines(spark, *((f, 0, 1, r) for f, r in zip("abcd", rows)))
    got = sorted((r["line_id"], r["num"], r["ref_id"]) for r in nested.count_children(nested.flat_rows(df, "x")).collect())
    assert got == [(0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (1, 4, "a"), (2, 5, "a"), (2, 6, "a")]


def test_tables_of_any_shape(spark):
    rows = [{"a": 1, "xs": [{"b": "p", "ys": [10, {"c": None}], "PLACE": True}, {"deep": [{"only": ["q"]}]}], "e": [], "m": {"n": [[1, 2], [3]]}}, {"a": "z", "xs": "w"}]
    flat = nested.flat_rows(lines(spark, *((f, 0, 1, r) for f, r in zip("ab", rows))), "s")
    got = {g: sorted(tuple(r)[1:] for r in t.collect()) for g, t in nested.tables(flat).items()}
    assert got == {
        "": [(0, [], None, "1", None), (1, [], None, "z", "w")], "xs[]": [(0, [0], None, "true", "p"), (0, [1], None, None, None)], "xs[].ys[]": [(0, [0, 0], None, "10"), (0, [0, 1], None, None)],
        "xs[].deep[]": [(0, [1, 0], None)], "xs[].deep[].only[]": [(0, [1, 0, 0], None, "q")], "m.n[]": [(0, [0], None), (0, [1], None)], "m.n[][]": [(0, [0, 0], None, "1"), (0, [0, 1], None, "2"), (0, [1, 0], None, "3")],
    }
    assert "field.PLACE" in nested.tables(flat)["xs[]"].columns
    keys = {(r["line_id"], r["grp"], tuple(r["place"])) for r in flat.collect()}
    assert all((r["line_id"], r["parent"], tuple(r["place"][:-1])) in keys for r in flat.collect() if r["grp"])


def test_flooding_settles_on_structure():
    was = {"idx": ["number"], "spot": ["array"], "spot[]": ["object"], "spot[].page": ["number"], "tag": ["array"], "tag[]": ["string"]}
    now = {"idx": ["number"], "uses": ["array"], "uses[]": ["object"], "uses[].page": ["number"], "mark": ["array"], "mark[]": ["string"]}
    score = drift.flood(was, now, {})
    assert score["spot", "uses"] > score["spot", "mark"] and score["tag", "mark"] > score["tag", "uses"]
    # Between pairs that all pass the value rule, what lies inside decides.
    facts = {(a, b): (4, 4) for a in ("spot", "tag") for b in ("uses", "mark")}
    top = lambda k: {f: v for f, v in k.items() if "[" not in f}
    inside = lambda k: [f"{f}|{v[0]}" for f, v in k.items() if "[" in f]
    got = {c[1:3] for c in drift.changes(top(was), top(now), facts, inside(was), inside(now))}
    assert got == {("spot", "uses"), ("tag", "mark")}


def test_deep_and_empty(spark):
    deep = "[" * 100_000
    df = lines(spark, ("a", 0, 1, '{"x": ' + deep))
    assert nested.record_triples(df, "x").count() == 0 and nested.flat_rows(df, "x").count() == 0
    assert nested.chain_children(nested.flat_rows(spark.createDataFrame([], LINES), "x")).count() == 0


def test_nulls_in_any_column(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(None, "a", 0, 1, t, '{"idx": 0}', "x"), ("s", None, 0, 1, t, '{"idx": 0}', "x"), ("s", "a", None, None, None, '{"idx": 0, "a": 1}', None), ("s", "b", 0, 9007199254740993, t, '{"idx": 0, "b": 1, "passages": ["p"]}', "x"), ("s", "b", 1, None, t, '{"idx": 1}', "x")]
    df = spark.createDataFrame(rows, LINES)
    assert {r["change_kind"] for r in drift.schema_changes(df).collect()} <= {"renamed", "added", "removed"}
    assert [(r["line_id"], r["ref_id"]) for r in nested.chain_children(nested.flat_rows(df, "x")).collect()] == [(9007199254740993, "p")]
