"""Deeply nested JSON records into related flat tables with parent keys (problem 7).

Each record is parsed once into path-value-ordinal triples. Paths are grouped by their repeated
ancestor, the innermost list or counted map they lie in, whatever its name, and each group is
pivoted into one table: a row for each place of that ancestor, with the columns of all paths below
it, its own place and that of its parent. The tables and their columns come from the data; none is
named beforehand. All of it is one narrow pass, as all triples of a record are where it is read.

:func:`flat_rows` holds the rows of all tables, :func:`tables` splits them into one DataFrame each,
and :func:`chain_children` and :func:`count_children` view some of them under the names of one task.

Defined cases: a null, empty, blank or cut-off line, or one without a line_id, gives no triples and no rows; a line whose
JSON is not an object gives none; a null list, an absent list and an empty list give no child
rows; a scalar where a list is expected counts as a list of that one element (passages in one text
with commas as several), and an empty string as none; repeated lines give their own rows; columns of the input other than the named ones are
ignored, so clashing names do no harm. A value nested deeper than ``json`` allows counts as cut off.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tables and columns that the records may come to, beyond which the schema is no schema.
COLUMNS_MOST = 20_000
FLAT = "src string, line_id long, grp string, place array<long>, parent string, key string, fields map<string,string>"
TRIPLES = "src string, line_id long, path string, ord array<long>, keys array<string>, kind string, value string"


def parse_object(raw: str | None) -> dict | None:
    """The JSON object of a line, or None if the line is null, cut off or another kind of JSON."""
    if not raw:
        return None
    try:
        got = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def kind_of(value: object) -> str:
    """The JSON kind of a parsed value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def triples(value: object, open_maps: frozenset[str]) -> Iterator[tuple[str, list[int], list[str], str, str | None]]:
    """Path, list positions, open-map keys, kind and text of each leaf below ``value``.

    ``[]`` in a path stands for a list position and ``{}`` for a key of a map whose keys are data
    (a path of ``open_maps``). Walks with a stack of its own, so depth is not bounded by Python's.
    """
    stack: list[tuple[str, list[int], list[str], object]] = [("", [], [], value)]
    while stack:
        path, at, keys, node = stack.pop()
        kind = kind_of(node)
        if kind == "object" and node:
            if path.rsplit(".", 1)[-1] in open_maps:
                stack.extend((path + "{}", [*at, i], [*keys, k], v) for i, (k, v) in reversed(list(enumerate(node.items()))))
            else:
                stack.extend((f"{path}.{k}" if path else k, at, keys, v) for k, v in reversed(list(node.items())))
        elif kind == "array" and node:
            stack.extend((path + "[]", [*at, i], keys, v) for i, v in reversed(list(enumerate(node))))
        elif kind in ("object", "array"):
            yield path, at, keys, kind, None
        else:
            yield path, at, keys, kind, node if kind == "string" else None if node is None else json.dumps(node)


def record_triples(lines: DataFrame, src: str, line_id: str = "line_id", raw: str = "raw", open_maps: tuple[str, ...] = ("verdict_counts",)) -> DataFrame:
    """All path-value-ordinal triples of the lines, one narrow pass without a shuffle."""
    maps = frozenset(open_maps)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["line_id"], batch["raw"]):
                got = parse_object(text)
                if got is not None:
                    rows.extend((src, key, *t) for t in triples(got, maps))
            yield pd.DataFrame(rows, columns=["src", "line_id", "path", "ord", "keys", "kind", "value"])

    return lines.where(F.col(line_id).isNotNull()).select(F.col(line_id).cast("long").alias("line_id"), F.col(raw).cast("string").alias("raw")).mapInPandas(run, TRIPLES)


ANCESTOR = re.compile(r".*(?:\[\]|\{\})")


def ancestor_of(path: str) -> str:
    """The repeated ancestor of a path, empty if it lies in none."""
    m = ANCESTOR.match(path)
    return m[0] if m else ""


def grouped(value: object, open_maps: frozenset[str]) -> list[tuple[str, list[int], str, str | None, dict[str, str]]]:
    """(group, place, parent group, key of the innermost counted map, columns) of each row of one record's tables.

    Every ancestor has its row, so each child finds its parent; the record itself is the row of the
    group ``""``. A column is named by its path below the ancestor, ``value`` if it is the ancestor itself.
    """
    rows: dict[tuple[str, tuple[int, ...]], tuple[list[str], dict[str, str]]] = {("", ()): ([], {})}
    for path, at, keys, _, text in triples(value, open_maps):
        grp, place = ancestor_of(path), tuple(at)
        while (grp, place) not in rows:
            n = grp.count("{}")
            rows[grp, place] = (keys[:n], {})
            grp, place = ancestor_of(grp[:-2]), place[:-1]
        if text is not None:
            grp = ancestor_of(path)
            rows[grp, tuple(at)][1][path[len(grp) :].lstrip(".") or "value"] = text
    return [(g, list(p), ancestor_of(g[:-2]), (k[-1] if g.endswith("{}") else None), f) for (g, p), (k, f) in rows.items()]


def flat_rows(lines: DataFrame, src: str, line_id: str = "line_id", raw: str = "raw", open_maps: tuple[str, ...] = ("verdict_counts",)) -> DataFrame:
    """The rows of all tables of the lines: src, line_id, grp, place, parent, key, fields.

    A row's key is (src, line_id, grp, place); that of its parent (src, line_id, parent, place but its last).
    """
    maps = frozenset(open_maps)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["line_id"], batch["raw"]):
                got = parse_object(text)
                if got is not None:
                    rows.extend((src, key, *r) for r in grouped(got, maps))
            yield pd.DataFrame(rows, columns=["src", "line_id", "grp", "place", "parent", "key", "fields"])

    return lines.where(F.col(line_id).isNotNull()).select(F.col(line_id).cast("long").alias("line_id"), F.col(raw).cast("string").alias("raw")).mapInPandas(run, FLAT)


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """One DataFrame for each group of :func:`flat_rows`: src, line_id, place, key and a column for each path seen.

    Only the names of groups and columns reach the driver. A column called like a key, in any case, gets ``field.`` before its name.
    """
    named = rows.select("grp", F.explode_outer(F.map_keys("fields")).alias("column")).distinct().limit(COLUMNS_MOST + 1).collect()
    if len(named) > COLUMNS_MOST:
        raise ValueError(f"the records have more than {COLUMNS_MOST} columns")
    columns: dict[str, list[str]] = {}
    for g, c in sorted((r["grp"], r["column"] or "") for r in named):
        columns.setdefault(g, []).extend([c] if c else [])
    out = {}
    for g, cs in columns.items():
        taken = {"src", "line_id", "place", "key"}
        picked = []
        for c in cs:
            name = c
            while name.lower() in taken:
                name = f"field.{name}"
            taken.add(name.lower())
            picked.append(F.try_element_at("fields", F.lit(c)).alias(name))
        out[g] = rows.where(F.col("grp") == g).select("src", "line_id", "place", "key", *picked)
    return out


def _field(*names: str) -> Column:
    return F.coalesce(*(F.try_element_at("fields", F.lit(n)) for n in names))


def chain_children(rows: DataFrame) -> DataFrame:
    """Child rows ``passages`` and ``quotes`` of chain records, from :func:`flat_rows`: src, line_id, child, num, ref_id, text.

    A list written as one text with commas, or as its single element, counts as the list; the parallel
    list ``detail.quote_passages`` meets ``detail.quotes`` by position.
    """
    root, num = F.col("grp") == "", F.element_at("place", -1)
    cell = lambda child, n, pid=None, text=None, qid=None: F.struct(F.lit(child).alias("child"), n.cast("long").alias("num"), *((F.lit(None).cast("string") if x is None else x).alias(c) for c, x in (("pid", pid), ("text", text), ("qid", qid))))
    inner = ("passage", "passage.id", "passage_id", "cite", "cite.passage", "cite.passage.id")
    parts = F.split(F.trim(_field("passages")), r"\s*[,;]\s*")
    single = F.array(
        cell("passages", F.lit(0), _field("passages.id")),
        cell("quotes", F.lit(0), None, _field("detail.quotes", "detail.quotes.text", "quotes", "quotes.text"), _field("detail.quote_passages", "quote_passages", *(f"detail.quotes.{x}" for x in inner))),
    )
    cells = (
        F.when(F.col("grp") == "passages[]", F.array(cell("passages", num, _field("value", "id"))))
        .when(F.col("grp").isin("detail.quotes[]", "quotes[]"), F.array(cell("quotes", num, None, _field("value", "text"), _field(*inner))))
        .when(F.col("grp").isin("detail.quote_passages[]", "quote_passages[]"), F.array(cell("quotes", num, None, None, _field("value"))))
        .when(root, F.concat(single, F.coalesce(F.transform(parts, lambda x, i: cell("passages", i, x)), F.array().cast("array<struct<child:string,num:bigint,pid:string,text:string,qid:string>>"))))
    )
    seen = rows.select("src", "line_id", F.explode(cells).alias("c")).select("src", "line_id", "c.*").where("pid is not null or text is not null or qid is not null")
    met = seen.groupBy("src", "line_id", "child", "num").agg(F.max("pid").alias("pid"), F.max("text").alias("text"), F.max("qid").alias("qid"))
    known = F.when(F.col("child") == "passages", F.coalesce("pid", F.lit("")) != "").otherwise(F.col("text").isNotNull())
    return met.where(known).select("src", "line_id", "child", "num", F.coalesce("pid", "qid", F.lit("")).alias("ref_id"), "text")


def count_children(rows: DataFrame) -> DataFrame:
    """Child rows ``verdict_counts`` of calibration records, from :func:`flat_rows`: num is the count, ref_id the verdict.

    Reads counts kept as a map of numbers, of strings or of objects with ``n``, and as a list of
    verdict and count, at the top or below any other object or list. The text column is null.
    """
    counts = rows.where(F.col("grp").rlike(r"(^|\.)verdict_counts(\{\}|\[\])$"))
    verdict, n = F.coalesce("key", _field("verdict")), _field("value", "n", "count").try_cast("double").cast("long")
    return counts.where(verdict.isNotNull() & n.isNotNull()).select("src", "line_id", F.lit("verdict_counts").alias("child"), n.alias("num"), verdict.alias("ref_id"), F.lit(None).cast("string").alias("text"))


def flat_records(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The parent table, from :func:`flat_rows`: one row per parsed record with its scalar ``fields`` as strings."""
    return rows.where("grp = ''").select("src", "line_id", *(_field(f).alias(f.replace(".", "_")) for f in fields))
