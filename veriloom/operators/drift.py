"""Schemas that drift between files (problem 3): one consistent table and a list of every change.

Every line is parsed once. Per file, a schema graph is built: a node for every path at any depth,
for every kind and for every word of a name, with edges from a parent to its member, from a path to its
kinds and to the words of its name. For each file and the one before it in its series, similarity
flooding starts from names, kinds and equal values and spreads match scores over all pairs of nodes, along edges of one
sort that both graphs have, until they settle. One-to-one correspondences between the fields that
went and those that came are chosen by falling score. The statement of renames is exact, so a
chosen pair is then checked by it: at least ``RENAME_SHARE`` of the idx with both values have them
equal; a pair that fails gives way to the next.

Defined cases: null, blank, cut-off and non-object lines are skipped, as are lines without a series
or a file; null line numbers are the least; a file without a complete
line has no fields and does not stand between its neighbours; of lines with the same idx the
one with the greatest (line_no, line_id) holds for values, while all complete lines count for
fields and kinds; an idx written as text equals the number; a line without idx counts for fields
but not for values. Files tie by name when written at the same time. An empty table gives an
empty result. Input columns beyond those read are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

from veriloom.operators.nested import kind_of, parse_object
from veriloom.sources.tables import checkpointed

#: Share of the idx with both values for which these must be equal in a rename.
RENAME_SHARE = 0.5
PARSED = "series string, file_name string, line_no int, line_id long, written_at timestamp, idx string, ok boolean, fields map<string,string>, kinds map<string,string>, below array<string>"
#: Similarity flooding: rounds at most, and the change that ends them.
FLOOD_ROUNDS, SETTLED = 100, 1e-4


def _digest(value: object) -> str:
    """A 128-bit digest of a value, the same for numbers that are equal."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return hashlib.md5(json.dumps(value, sort_keys=True).encode()).hexdigest()


def split_fields(rec: dict) -> dict[str, object]:
    """The fields of a record: the top-level ones but detail, and those under it as detail.<name>."""
    out = {k: v for k, v in rec.items() if k != "detail" and v is not None}
    detail = rec.get("detail")
    if isinstance(detail, dict):
        out |= {f"detail.{k}": v for k, v in detail.items() if v is not None}
    elif detail is not None:
        out["detail"] = detail
    return out


def paths_below(fields: dict[str, object]) -> list[str]:
    """``path|kind`` of everything inside the fields' lists and objects, each once, whatever its depth."""
    seen: dict[str, None] = {}
    stack = [(f, v) for f, v in fields.items() if isinstance(v, (list, dict))]
    while stack:
        path, v = stack.pop()
        for p, x in ((f"{path}[]", x) for x in v) if isinstance(v, list) else ((f"{path}.{k}", x) for k, x in v.items()):
            if x is not None:
                seen[f"{p}|{kind_of(x)}"] = None
                if isinstance(x, (list, dict)):
                    stack.append((p, x))
    return list(seen)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """One row per line with the digests and kinds of its non-null fields; no shuffle."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            oks, idxs, fields, kinds, below = [], [], [], [], []
            for raw in b["raw"]:
                rec = parse_object(raw)
                got = split_fields(rec) if rec is not None else {}
                idx = got.get("idx")
                oks.append(rec is not None)
                idxs.append(None if idx is None or isinstance(idx, (list, dict)) else str(int(idx)) if isinstance(idx, float) and idx.is_integer() else str(idx).strip())
                fields.append({k: _digest(v) for k, v in got.items()})
                kinds.append({k: kind_of(v) for k, v in got.items()})
                below.append(paths_below(got))
            yield b[["series", "file_name", "line_no", "line_id", "written_at"]].assign(idx=idxs, ok=oks, fields=fields, kinds=kinds, below=below)

    cols = ["series", "file_name", F.coalesce(F.col("line_no").cast("int"), F.lit(-1)).alias("line_no"), F.coalesce(F.col("line_id").cast("long"), F.lit(-1)).alias("line_id"), F.col("written_at").cast("timestamp").alias("written_at"), F.col("raw").cast("string").alias("raw")]
    return lines.where("series is not null and file_name is not null").select(*cols).mapInPandas(run, PARSED)


def _parent(path: str) -> str:
    return path[:-2] if path.endswith("[]") else path.rpartition(".")[0]


def _words(path: str) -> list[str]:
    return re.findall(r"[a-z]+|[0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", path.rpartition(".")[2]).lower()) or [path]


def graph_of(kinds: dict[str, list[str]]) -> tuple[list[str], dict[str, list[tuple[int, int]]]]:
    """(nodes, edges by sort) of a schema graph; kinds are given for the paths that have values."""
    paths: dict[str, None] = {"": None}
    for p in sorted(kinds):
        up = [p]
        while up[-1]:
            up.append(_parent(up[-1]))
        paths.update(dict.fromkeys(reversed(up)))
    nodes = [f"p:{p}" for p in paths]
    nodes += sorted({f"k:{k}" for ks in kinds.values() for k in ks}) + sorted({f"w:{w}" for p in paths if p for w in _words(p)})
    no = {n: i for i, n in enumerate(nodes)}
    edges: dict[str, list[tuple[int, int]]] = {"member": [], "item": [], "kind": [], "word": []}
    for p in paths:
        if p:
            edges["item" if p.endswith("[]") else "member"].append((no[f"p:{_parent(p)}"], no[f"p:{p}"]))
            edges["word"] += [(no[f"p:{p}"], no[f"w:{w}"]) for w in dict.fromkeys(_words(p))]
        edges["kind"] += [(no[f"p:{p}"], no[f"k:{k}"]) for k in kinds.get(p, [])]
    return nodes, edges


def _shares(edges: list[tuple[int, int]], n: int) -> np.ndarray:
    """The adjacency of edges, each node's outgoing weight shared among them."""
    m = np.zeros((n, n))
    for a, b in edges:
        m[a, b] = 1.0
    return m / np.maximum(m.sum(axis=1, keepdims=True), 1.0)


def _overlap(left: list[set[str]], right: list[set[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(members in common, sizes as a column, sizes as a row) of two lists of sets."""
    no = {x: i for i, x in enumerate(sorted(set().union(*left, *right)))}
    m, k = np.zeros((len(left), len(no))), np.zeros((len(right), len(no)))
    for one, sets in ((m, left), (k, right)):
        for i, x in enumerate(sets):
            one[i, [no[y] for y in x]] = 1.0
    return m @ k.T, m.sum(axis=1)[:, None], k.sum(axis=1)[None, :]


def flood(was: dict[str, list[str]], is_: dict[str, list[str]], value: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
    """Similarity flooding between two schema graphs, given by path and kinds; the scores of all pairs of paths.

    A pair starts from the likeness of its names and kinds, its agreement in values if known, and
    wholly alike if it is one path. In each round it sends its score to the pairs that both its nodes
    point to by edges of one sort, and those that point to it, shared among them; the scores are
    scaled to 1 and the rounds end when none moves by more than ``SETTLED``.
    """
    a, ea = graph_of(was)
    b, eb = graph_of(is_)
    start = np.zeros((len(a), len(b)))
    # Paths stand first among the nodes; that of the whole record, the first of them, is like no field.
    pa, pb = ([n[2:] for n in nodes if n.startswith("p:")] for nodes in (a, b))
    names = [[{x[i : i + 2] for i in range(len(x) - 1)} for x in (f"^{p.rpartition('.')[2]}$" for p in ps)] for ps in (pa, pb)]
    sorts = [[set(k.get(p, ())) for p in ps] for k, ps in ((was, pa), (is_, pb))]
    (both, size_a, size_b), (alike, kinds_a, kinds_b) = _overlap(*names), _overlap(*sorts)
    like = 0.25 * 2 * both / np.maximum(1, size_a + size_b) + 0.15 * alike / np.maximum(1, kinds_a + kinds_b - alike)
    like[0, :] = like[:, 0] = 0.0
    start[: len(pa), : len(pb)] = like
    at = {n: j for j, n in enumerate(b)}
    no = {p: i for i, p in enumerate(pa)}
    for (p, q), v in value.items():
        if p in no and f"p:{q}" in at:
            start[no[p], at[f"p:{q}"]] += 0.6 * v
    for i, n in enumerate(a):
        if n in at:
            start[i, at[n]] = 1.0
    ways = []
    for sort in ea:
        to_a, to_b = _shares(ea[sort], len(a)), _shares(eb[sort], len(b))
        from_a, from_b = _shares([(y, x) for x, y in ea[sort]], len(a)), _shares([(y, x) for x, y in eb[sort]], len(b))
        ways += [(to_a, to_b), (from_a, from_b)]
    score = start
    for _ in range(FLOOD_ROUNDS):
        sent = start + score
        new = sent + sum(x.T @ sent @ y for x, y in ways)
        new /= max(new.max(), 1e-12)
        moved = np.abs(new - score).max()
        score = new
        if moved < SETTLED:
            break
    found = score[: len(pa), : len(pb)].tolist()
    return {(p, q): x for p, row in zip(pa, found) for q, x in zip(pb, row)}


def schema_changes(lines: DataFrame) -> DataFrame:
    """Every change between one file of a series and the next: series, file_name, change_kind, field, new_field, old_kinds, new_kinds."""
    parsed = parsed_lines(lines)
    complete = parsed.where("ok")
    first = lines.where("series is not null and file_name is not null").groupBy("series", "file_name").agg(F.min(F.col("written_at").cast("timestamp")).alias("began"))
    # Fields with their kinds and what lies inside them are counted in one pass, so that lines are parsed once for the schemas.
    held = F.transform(F.map_entries("kinds"), lambda e: F.struct(F.lit(True).alias("top"), e["key"].alias("path"), e["value"].alias("kind")))
    inside = F.transform("below", lambda x: F.struct(F.lit(False).alias("top"), x.alias("path"), F.lit("").alias("kind")))
    seen = complete.select("series", "file_name", F.explode(F.concat(held, inside)).alias("x")).select("series", "file_name", "x.*").groupBy("series", "file_name", "top", "path").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.count(F.lit(1)).alias("n"))
    field = F.when(F.col("top"), F.struct(F.col("path").alias("field"), "kinds", "n"))
    files = seen.groupBy("series", "file_name").agg(F.sort_array(F.collect_list(field)).alias("schema"), F.sort_array(F.collect_list(F.when(~F.col("top"), F.col("path")))).alias("below")).join(first, ["series", "file_name"])
    order = W.partitionBy("series").orderBy("began", "file_name")
    steps = files.select("series", "file_name", "schema", "below", *(F.lag(c).over(order).alias(f"old_{n}") for c, n in (("file_name", "file"), ("schema", "schema"), ("below", "below")))).where("old_file is not null")
    had, has = F.transform("old_schema", lambda s: s["field"]), F.transform("schema", lambda s: s["field"])
    steps = steps.select("*", F.array_except(had, has).alias("gone"), F.array_except(has, had).alias("new"))
    # Values are compared only for the fields that went or came, per idx; the last line of an idx holds.
    last = complete.where("idx is not null").groupBy("series", "file_name", "idx").agg(F.max_by("fields", F.struct("line_no", "line_id")).alias("fields"))
    moving = steps.where((F.size("gone") > 0) & (F.size("new") > 0)).select("series", "file_name", "old_file", "gone", "new")
    pick = lambda side, names: F.map_filter(side, lambda k, _: F.array_contains(names, k))
    after = moving.join(last, ["series", "file_name"]).select("series", "file_name", "idx", "old_file", pick("fields", F.col("new")).alias("after"))
    before = moving.select("series", "file_name", "old_file", "gone").join(last.withColumnRenamed("file_name", "old_file"), ["series", "old_file"]).select("series", "file_name", "idx", pick("fields", F.col("gone")).alias("before"))
    agree = (
        after.join(before, ["series", "file_name", "idx"])
        .select("series", "file_name", F.explode("before").alias("field", "va"), "after")
        .select("series", "file_name", "field", "va", F.explode("after").alias("new_field", "vb"))
        .groupBy("series", "file_name", "field", "new_field")
        .agg(F.count(F.lit(1)).alias("both"), F.count_if(F.col("va") == F.col("vb")).alias("same"))
    )
    facts = agree.groupBy("series", "file_name").agg(F.collect_list(F.struct("field", "new_field", "both", "same")).alias("agree"))
    joined = steps.join(facts, ["series", "file_name"], "left").select("series", "file_name", "old_schema", "schema", "old_below", "below", "agree")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for series, name, old, now, old_below, below, agree_ in b.itertuples(index=False, name=None):
                was = {s["field"]: sorted(s["kinds"]) for s in old}
                is_ = {s["field"]: sorted(s["kinds"]) for s in now}
                facts_ = {(x["field"], x["new_field"]): (x["both"], x["same"]) for x in (agree_ if agree_ is not None else [])}
                rows.extend((series, name, *c) for c in changes(was, is_, facts_, *(() if x is None else x for x in (old_below, below))))
            yield pd.DataFrame(rows, columns=["series", "file_name", "change_kind", "field", "new_field", "old_kinds", "new_kinds"])

    return joined.mapInPandas(run, "series string, file_name string, change_kind string, field string, new_field string, old_kinds array<string>, new_kinds array<string>")


def changes(was: dict[str, list[str]], is_: dict[str, list[str]], facts: dict[tuple[str, str], tuple[int, int]], old_below: Iterable[str] = (), below: Iterable[str] = ()) -> list[tuple[str, str, str, list[str], list[str]]]:
    """The changes between two schemas, given for pairs of gone and new fields (both valued, equal), and ``path|kind`` of what lies inside the fields."""
    gone, new = sorted(set(was) - set(is_)), sorted(set(is_) - set(was))
    score = {}
    if gone and new:
        whole = []
        for fields, inside in ((was, old_below), (is_, below)):
            kinds = {f: list(k) for f, k in fields.items()}
            for x in inside:
                path, _, kind = x.rpartition("|")
                kinds.setdefault(path, []).append(kind)
            whole.append(kinds)
        every = flood(*whole, {p: s / b for p, (b, s) in facts.items() if b})
        score = {(a, b): every[a, b] for a in gone for b in new}
    out, used_a, used_b = [], set(), set()
    for (a, b), _ in sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0])):
        both, same = facts.get((a, b), (0, 0))
        if a not in used_a and b not in used_b and both and same >= RENAME_SHARE * both:
            used_a.add(a)
            used_b.add(b)
            out.append(("renamed", a, b, was[a], is_[b]))
    out += [("removed", f, "", was[f], []) for f in gone if f not in used_a]
    out += [("added", f, "", [], is_[f]) for f in new if f not in used_b]
    out += [("retyped", f, "", was[f], is_[f]) for f in sorted(set(was) & set(is_)) if was[f] != is_[f]]
    return out


def unified(lines: DataFrame, found: DataFrame) -> DataFrame:
    """All complete records under one set of names: series, file_name, line_no, line_id, fields (name to JSON text), uncast.

    ``found`` is the result of :func:`schema_changes`. A name is carried forward along the renames of
    its series in the order of the files, so one that is reversed later ends as it is in the last
    file. Series that ended with different names for one field (linked by a rename of any series, never
    both in one record) get the name that most series have. Of two fields of a record that end
    under one name the one already called so holds, else the first by name; the other is in ``uncast``.
    """
    found = checkpointed(found.where("change_kind = 'renamed'").select("series", "file_name", "field", "new_field"))
    files = lines.where("series is not null and file_name is not null").groupBy("series", "file_name").agg(F.min(F.col("written_at").cast("timestamp")).alias("began"))
    files = files.select("series", "file_name", F.row_number().over(W.partitionBy("series").orderBy("began", "file_name")).alias("pos"))
    renames = found.join(files, ["series", "file_name"]).groupBy("series").agg(F.sort_array(F.collect_list(F.struct("pos", "field", "new_field"))).alias("renames"))
    base = lines.select("series", "file_name", "line_no", "line_id", "raw").join(files, ["series", "file_name"], "left").join(renames, "series", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s, f, no, key, raw, pos, ren in zip(b["series"], b["file_name"], b["line_no"], b["line_id"], b["raw"], b["pos"], b["renames"]):
                rec = parse_object(raw)
                if rec is None:
                    continue
                later = [(r["field"], r["new_field"]) for r in (ren if ren is not None else []) if r["pos"] > pos]
                got = []
                for k, v in split_fields(rec).items():
                    name = k
                    for old, new in later:
                        name = new if name == old else name
                    got.append((name != k, k, name, json.dumps(v, sort_keys=True)))
                values, lost = {}, []
                for _, k, name, v in sorted(got):
                    if name in values:
                        lost.append({"field": name, "value": v, "why": f"{k} under a name in use"})
                    else:
                        values[name] = v
                rows.append((s, f, no, key, values, lost))
            yield pd.DataFrame(rows, columns=["series", "file_name", "line_no", "line_id", "fields", "uncast"])

    named = checkpointed(base.mapInPandas(run, f"series string, file_name string, line_no int, line_id long, fields map<string,string>, uncast {UNCAST}"))
    to = common_names(named, found)
    if not to:
        return named
    names = F.create_map(*(F.lit(x) for p in sorted(to.items()) for x in p))
    return named.withColumn("fields", F.transform_keys("fields", lambda k, _: F.coalesce(F.try_element_at(names, k), k)))


def common_names(named: DataFrame, found: DataFrame) -> dict[str, str]:
    """The name over all series of each name that has another; only names and pairs of names reach the driver."""
    pairs = sorted(((r["n"], r["field"], r["new_field"]) for r in found.groupBy("field", "new_field").agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda x: (-x[0], x[1:]))
    linked = {x for p in pairs for x in p[1:]}
    if not linked:
        return {}
    keys = named.select("series", F.array_intersect(F.map_keys("fields"), F.array(*(F.lit(x) for x in sorted(linked)))).alias("keys"))
    held = {r["name"]: (r["n_series"], r["n"]) for r in keys.select("series", F.explode("keys").alias("name")).groupBy("name").agg(F.count_distinct("series").alias("n_series"), F.count(F.lit(1)).alias("n")).collect()}
    both = keys.select("keys", F.explode("keys").alias("a")).select("a", F.explode("keys").alias("b")).where("a < b").distinct().collect()
    apart = {(r["a"], r["b"]) for r in both}
    group = {x: {x} for x in linked}
    for _, a, b in pairs:
        x, y = group[a], group[b]
        if x is not y and not any((min(m, o), max(m, o)) in apart for m in x for o in y):
            x |= y
            for m in y:
                group[m] = x
    best = {x: min(group[x], key=lambda m: (*(-n for n in held.get(m, (0, 0))), m)) for x in linked}
    return {x: m for x, m in best.items() if x != m}


UNCAST = "array<struct<field:string,value:string,why:string>>"
#: Numbers written as text, with or without seconds as their unit; members that name an object, the best first.
NUMBER = re.compile(r"\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*(?:s|secs?|seconds?)?\s*", re.ASCII)
MAIN = ("id", "text", "name")
STATS = ("number", "whole", "like", "likewhole", "string", "boolean", "truth", "array", "object", "marks", "rest", "bare")


def number_of(value: object) -> int | float | None:
    """The number that a number or a text means, null if none or not finite."""
    if isinstance(value, bool):
        return None
    if isinstance(value, str):
        m = NUMBER.fullmatch(value)
        if not m:
            return None
        value = int(m[1]) if m[1].lstrip("+-").isdigit() and len(m[1]) < 400 else float(m[1])
    if isinstance(value, float) and math.isfinite(value) and value.is_integer() and abs(value) < 2**53:
        return int(value)
    return value if isinstance(value, int) or isinstance(value, float) and math.isfinite(value) else None


def text_of(value: object) -> tuple[str | None, dict | None]:
    """The text of a value and what it leaves of an object; (null, null) if an object or list has none."""
    if isinstance(value, dict):
        if set(value) == {"k", "n"} and all(isinstance(number_of(x), int) for x in value.values()):
            return f"{number_of(value['k'])}/{number_of(value['n'])}", None
        m = next((m for m in MAIN if isinstance(value.get(m), str)), None)
        return (None, None) if m is None else (value[m], {k: v for k, v in value.items() if k != m} or None)
    if isinstance(value, list):
        return None, None
    return (value if isinstance(value, str) else json.dumps(value)), None


def stats_of(value: object) -> list[int]:
    """What one value tells of the type of its field, in the order of STATS."""
    kind, n = kind_of(value), number_of(value)
    whole = isinstance(n, int) and -(2**63) <= n < 2**63
    items = value if isinstance(value, list) else [value]
    rest = any(text_of(x)[1] for x in items if isinstance(x, dict))
    marks = kind == "array" and any("," in (text_of(x)[0] or "") or ";" in (text_of(x)[0] or "") for x in items)
    return [int(x) for x in (kind == "number", kind == "number" and whole, kind == "string" and n is not None, kind == "string" and whole, kind == "string", kind == "boolean", kind == "string" and value.strip().lower() in ("true", "false"), kind == "array", kind == "object", marks, rest, kind == "object" and text_of(value)[0] is None)]


def type_of(n: dict[str, int]) -> str:
    """The one type of a field from its summed stats: a list if any is one, the number or truth value that most mean, else text."""
    plain = n["number"] + n["string"] + n["boolean"]
    if n["array"]:
        return "array<string>"
    if n["number"] and not n["object"] and 2 * (n["number"] + n["like"]) >= plain:
        return "bigint" if n["whole"] + n["likewhole"] == n["number"] + n["like"] else "double"
    if n["boolean"] and not n["object"] and 2 * (n["boolean"] + n["truth"]) >= plain:
        return "boolean"
    return "json" if n["object"] and n["bare"] == n["object"] and not plain else "string"


def cast(value: object, to: str, marks: bool) -> tuple[object, object]:
    """(value in the type, rest of its objects); (null, null) if it cannot be cast without loss. ``marks``: commas do not separate."""
    if to == "json":
        return json.dumps(value, sort_keys=True), None
    if to == "array<string>":
        items = value if isinstance(value, list) else [value] if marks or not isinstance(value, str) else [x.strip() for x in re.split("[,;]", value)]
        items = [x for x in items if x != ""] if isinstance(value, str) else items
        got = [(None, None) if x is None else text_of(x) for x in items]
        if any(t is None and x is not None for x, (t, _) in zip(items, got)):
            return None, None
        return [t for t, _ in got], ([r and json.dumps(r, sort_keys=True) for _, r in got] if any(r for _, r in got) else None)
    if to == "boolean":
        return (value if isinstance(value, bool) else {"true": True, "false": False}.get(value.strip().lower()) if isinstance(value, str) else None), None
    if to in ("bigint", "double"):
        n = number_of(value)
        if n is None or to == "bigint":
            return (n if isinstance(n, int) and -(2**63) <= n < 2**63 else None), None
        return (float(n) if isinstance(n, float) or abs(n) < 2**1000 and int(float(n)) == n else None), None
    text, rest = text_of(value)
    return text, rest and json.dumps(rest, sort_keys=True)


def typed(records: DataFrame) -> DataFrame:
    """The records of :func:`unified` as typed columns, one for each field: bigint, double, boolean, string or array<string>.

    Text with commas becomes a list where others are lists (unless the items of these hold
    commas), text such as ``10.3s`` a number where others are numbers, {k, n} ``k/n``. An object becomes its id,
    text or name, and its other members stay as JSON text in ``<field>.rest``, in a list at the same place.
    What cannot be cast is null in its column and stands in ``uncast`` with its JSON text. Only one row of
    counts for each field reaches the driver. A field called like a key column gets ``field.`` before its name.
    """
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums: dict[str, list[int]] = {}
            for fields in b["fields"]:
                for k, v in dict(fields).items():
                    sums[k] = [x + y for x, y in zip(sums.get(k, [0] * len(STATS)), stats_of(json.loads(v)))]
            yield pd.DataFrame([(k, *v) for k, v in sums.items()], columns=["field", *STATS])

    seen = records.select("fields").mapInPandas(look, "field string, " + ", ".join(f"{s} long" for s in STATS)).groupBy("field").agg(*(F.sum(s).alias(s) for s in STATS))
    stats = {r["field"]: r.asDict() for r in seen.collect()}
    keys = ("series", "file_name", "line_no", "line_id", "uncast")
    name = {f: f"field.{f}" if f.lower() in keys else f for f in stats}
    types = {f: (type_of(n), bool(n["marks"])) for f, n in sorted(stats.items())}
    rests = {f: "array<string>" if types[f][0] == "array<string>" else "string" for f in types if stats[f]["rest"] and types[f][0] in ("array<string>", "string")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, lost = [], []
            for fields, before in zip(b["fields"], b["uncast"]):
                row, bad = {}, [dict(x) for x in before]
                for f, raw in dict(fields).items():
                    got, rest = cast(json.loads(raw), *types[f])
                    if got is None:
                        bad.append({"field": f, "value": raw, "why": f"no {types[f][0]}"})
                    else:
                        row[name[f]] = got
                        if rest is not None:
                            row[f"{name[f]}.rest"] = rest
                out.append(json.dumps(row))
                lost.append(bad)
            yield b[["series", "file_name", "line_no", "line_id"]].assign(row=out, uncast=lost)

    kinds = {"json": StringType(), "string": StringType(), "bigint": LongType(), "double": DoubleType(), "boolean": BooleanType(), "array<string>": ArrayType(StringType())}
    columns = [x for f, (t, _) in types.items() for x in [StructField(name[f], kinds[t]), *([StructField(f"{name[f]}.rest", kinds[rests[f]])] if f in rests else [])]]
    cast_rows = records.mapInPandas(run, f"series string, file_name string, line_no int, line_id long, row string, uncast {UNCAST}")
    if not columns:
        return cast_rows.drop("row")
    return cast_rows.select("series", "file_name", "line_no", "line_id", F.from_json("row", StructType(columns)).alias("x"), "uncast").select("series", "file_name", "line_no", "line_id", "x.*", "uncast")
