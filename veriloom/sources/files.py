"""Readers of corpora, claims, chains, views, trees and manifests from files, and their sinks.

Every reader is a lazy plan over ``spark.read``; nothing is read on the driver but manifests of one
report, which are a page long.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions.vocab import SCHEMES
from veriloom.operators.chains import last_wins
from veriloom.operators.parsing import loose_json
from veriloom.operators.segmenting import route_of, trimmed

CHAIN = (
    "idx int, total int, mode string, backend string, claim string, verdict string, route string, spread string, samples array<string>, passages array<string>, elapsed_s double, "
    "detail struct<quotes:array<string>,quote_sources:array<string>,quote_passages:array<string>,critic_finding:string,report_says:string,source_says:string,gap:string,so_what:string>, _bad string"
)


def corpus(spark: SparkSession, *roots: str) -> DataFrame:
    """A1-A3: (root_ord, path, route, text) of every .txt file under the roots; read whole, ordered by root and path only when asked."""
    parts = []
    for i, root in enumerate(roots):
        files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
        parts.append(files.select(F.lit(i).alias("root_ord"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("route", route_of(F.col("path")))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, no, line) of the lines of text files; blank ones are kept, so numbers are those of the file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), "\n")).alias("no", "line"))


def claims(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, id, section, text, cites, route) of claims files: comments dropped, tab fields, fewer than three fields being text alone."""
    rows = lines(spark, path).withColumn("line", trimmed(F.col("line"))).where("line <> '' and not startswith(line, '#')")
    f = F.split("line", "\t", 5)
    at = lambda i: F.when(F.size(f) >= 3, F.btrim(F.coalesce(F.try_element_at(f, F.lit(i)), F.lit("")))).otherwise("")
    text = F.when(F.size(f) >= 3, at(3)).otherwise(F.col("line"))
    from pyspark.sql.window import Window as W

    numbered = rows.select("path", (F.row_number().over(W.partitionBy("path").orderBy("no")) - 1).alias("idx"), at(1).alias("id"), at(2).alias("section"), text.alias("text"), at(4).alias("cites"), at(5).alias("route"))
    return numbered.withColumn("cites", F.filter(F.split("cites", r"[,\s]+"), lambda x: x != ""))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, date) from the ``# key: value`` lines of claims files; "" where there are none."""
    rows = lines(spark, path).select("path", "no", F.regexp_extract("line", r"(?i)^\s*#\s*(title|date)\s*:\s*(.*?)\s*$", 1).alias("key"), F.regexp_extract("line", r"(?i)^\s*#\s*(title|date)\s*:\s*(.*?)\s*$", 2).alias("value"))
    of = lambda k: F.coalesce(F.max_by(F.when(F.lower("key") == k, F.col("value")), F.when(F.lower("key") == k, F.col("no"))), F.lit("")).alias(k)
    return rows.groupBy("path").agg(of("title"), of("date"))


def views(spark: SparkSession, path: str) -> DataFrame:
    """people's views from files of six fields between pipes; any other number of fields, or a page that is no number, is an error."""
    rows = lines(spark, path).withColumn("line", trimmed(F.col("line"))).where("line <> '' and not startswith(line, '#')")
    f = F.transform(F.split("line", r"\|"), lambda x: F.btrim(x))
    page = F.regexp_replace(f[3], "^p", "")
    where = F.concat(F.col("path"), F.lit(" line "), (F.col("no") + 1).cast("string"))
    checked = rows.select("path", "no", F.when(F.size(f) != 6, F.raise_error(F.concat(where, F.lit(": six fields are wanted")))).when((page != "") & ~page.rlike(r"^\d+$"), F.raise_error(F.concat(where, F.lit(": the page is no number")))).otherwise(f).alias("f"))
    return checked.select("path", "no", F.col("f")[0].alias("id"), F.col("f")[1].alias("verdict"), F.col("f")[2].alias("quote"), F.coalesce(F.regexp_replace(F.col("f")[3], "^p", "").try_cast("int"), F.lit(0)).alias("page"), F.col("f")[4].alias("initials"), F.col("f")[5].alias("reason"))


def references(spark: SparkSession, path: str) -> DataFrame:
    """(id, ref) of files between pipes: the first field and the value of the first field ``ref=``."""
    f = F.transform(F.split("line", r"\|"), lambda x: F.btrim(x))
    ref = F.try_element_at(F.filter(f, lambda x: x.startswith("ref=")), F.lit(1))
    return lines(spark, path).where("trim(line) <> '' and not startswith(trim(line), '#')").select(f[0].alias("id"), F.btrim(F.regexp_replace(ref, "^ref=", "")).alias("ref")).where("ref is not null")


def oracle_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, pos, pid) of a JSON map from claim to passages; an empty map is an error."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return m.select(F.when(F.coalesce(F.size("m"), F.lit(0)) > 0, F.col("m")).otherwise(F.raise_error(F.lit("the map of passages is empty"))).alias("m")).select(F.explode("m").alias("id", "pids")).select("id", F.posexplode("pids").alias("pos", "pid"))


def chain(spark: SparkSession, path: str) -> DataFrame:
    """The lines of chain files as records with their file and line; lines that are no JSON keep only ``_bad``."""
    rows = lines(spark, path).where("trim(line) <> ''")
    got = F.from_json("line", CHAIN, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return rows.select("path", "no", got.alias("r")).select("path", "no", "r.*")


def chain_strict(spark: SparkSession, path: str) -> DataFrame:
    """A chain of one mode whose idx run from 0 without gaps, the last of each holding; anything else is an error."""
    rows = chain(spark, path)
    held = last_wins(rows.where("_bad is null and idx is not null"), ["path", "idx"], ["no"])
    facts = rows.groupBy("path").agg(F.count_if(F.col("_bad").isNotNull() | F.col("idx").isNull()).alias("bad"), F.count_distinct("idx").alias("n"), F.max("idx").alias("top"), F.min("idx").alias("low"), F.count_distinct("mode").alias("modes"))
    ok = (F.col("bad") == 0) & (F.col("low") == 0) & (F.col("top") + 1 == F.col("n")) & (F.col("modes") == 1)
    judged = facts.select("path", F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("the chain is not whole: "), "path"))).alias("ok"))
    return held.join(judged, "path").where("ok").drop("ok", "_bad")


def chain_sparse(spark: SparkSession, path: str, mode: str = "faithfulness") -> DataFrame:
    """What can be read of a chain of one mode, the last record of each idx holding. The mode is a parameter, so other modes resume as well."""
    return last_wins(chain(spark, path).where((F.col("mode") == mode) & F.col("_bad").isNull() & F.col("idx").isNotNull()), ["path", "idx"], ["no"]).drop("_bad")


TREE = "path string, node string, parent string, ord int, depth int, query boolean, scheme string, content string"


def argument_trees(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of argument files: an indented line's parent is the nearest line above it that is indented less.

    A line reads ``id [?] | content | note``; a note may begin with ``scheme=`` up to a semicolon, and
    an unknown scheme is an error. Of several roots the last counts, with what is below it.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, text in zip(b["path"], b["value"]):
                rows += [(name, *r) for r in parse_tree(text)]
            yield pd.DataFrame(rows, columns=["path", "node", "parent", "ord", "depth", "query", "scheme", "content"])

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(run, TREE)


def parse_tree(text: str) -> list[tuple]:
    """The nodes of one argument file: node, parent, ord, depth, query, scheme, content."""
    nodes: list[list] = []
    open_: list[tuple[int, int]] = []
    for no, line in enumerate(text.splitlines()):
        body = line.strip()
        if not body or body[0] == "#":
            continue
        head, content, note = (*(p.strip() for p in body.split("|", 2)), "", "")[:3]
        if not head.split():
            continue
        name, *flags = head.split()
        found = re.match(r"scheme=([^;]*)", note)
        scheme = found[1].strip() if found else ""
        if found and scheme not in SCHEMES:
            raise ValueError(f"{name}: unknown scheme {scheme!r}")
        indent = len(line) - len(line.lstrip(" "))
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        up = open_[-1][1] if open_ else None
        nodes.append([name, None if up is None else nodes[up][0], no, 0 if up is None else nodes[up][3] + 1, "?" in flags, scheme, content])
        open_.append((indent, len(nodes) - 1))
    last = max((i for i, n in enumerate(nodes) if n[1] is None), default=0)
    return [tuple(n) for n in nodes[last:]]


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(doc, label) of a manifest's bullets; the label is the last part after a long dash, "" without one."""
    rows = lines(spark, path).select(F.regexp_extract("line", r"^\s*- `([^`]+)`", 1).alias("doc"), F.element_at(F.split("line", " — "), -1).alias("tail"), F.size(F.split("line", " — ")).alias("n")).where("doc <> ''")
    return rows.select("doc", F.when(F.col("n") >= 2, F.btrim("tail")).otherwise("").alias("label"))


def manifest_of(paths: DataFrame) -> DataFrame:
    """(doc, label) from the layout of a corpus: hearings by date and session, submissions by number and attachment, answers by body and date; other names are left out."""
    p = F.col("path")
    stem = F.regexp_extract(p, r"([^/]+)\.txt$", 1)
    pretty = lambda s: F.array_join(F.transform(F.split(F.replace(s, F.lit("_"), F.lit("-")), "-+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))), " ")
    day, session = F.regexp_extract(p, r"/hearings/(?:.*/)?(\d{4}-\d{2}-\d{2})/[^/]+\.txt$", 1), F.regexp_replace(stem, r"^\d+_", "")
    num, att, org = (F.regexp_extract(stem, r"^(\d+)(?:\.(\d+))?-(.+)$", i) for i in (1, 2, 3))
    body, when = F.regexp_extract(stem, r"^(.+)-(\d{4}-\d{2}-\d{2})$", 1), F.regexp_extract(stem, r"^(.+)-(\d{4}-\d{2}-\d{2})$", 2)
    is_sub, is_qon = p.rlike(r"/submissions/[^/]+\.txt$") & (num != ""), p.rlike(r"/qon/[^/]+\.txt$") & (body != "")
    n, k = num.try_cast("int").cast("string"), att.try_cast("int").cast("string")
    doc = F.when(day != "", F.concat(F.lit("hearing:"), day, F.lit("/"), stem)).when(is_sub & (att != ""), F.concat(F.lit("submission:"), n, F.lit("/attachment-"), k)).when(is_sub, F.concat(F.lit("submission:"), n)).when(is_qon, F.concat(F.lit("qon:"), body, F.lit("/"), when))
    label = (
        F.when(day != "", F.concat(F.lit("Hearing "), day, F.lit(" — "), pretty(session))).when(is_sub & (att != ""), F.concat(F.lit("Submission "), n, F.lit(" Attachment "), k, F.lit(" — "), pretty(org)))
        .when(is_sub, F.concat(F.lit("Submission "), n, F.lit(" — "), pretty(org))).when(is_qon, F.concat(F.lit("QoN response — "), F.upper(body), F.lit(", "), when))
    )
    return paths.select(doc.alias("doc"), label.alias("label")).where("doc is not null")


def manifest_lines(docs: DataFrame) -> DataFrame:
    """The bullets of a manifest: (kind, n, text), one row per kind that has documents."""
    kind = F.substring_index("doc", ":", 1)
    return docs.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- `"), "doc", F.lit("` — "), "label"))), "\n").alias("text"))


def append_chain(records: DataFrame, path: str) -> None:
    """Records appended as JSON lines; null fields are left out."""
    records.write.mode("append").option("ignoreNullFields", "true").json(path)


def responses(rows: DataFrame, key: str, text: str, schema: str) -> DataFrame:
    """Model responses (key, text) as structs of ``schema``: fences, talk around the JSON and trailing commas are let pass; null if nothing can be read."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "json": [None if (got := loose_json(t)) is None else json.dumps(got) for t in b[text]]})

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, json string").select(key, F.from_json("json", schema).alias("r"))
