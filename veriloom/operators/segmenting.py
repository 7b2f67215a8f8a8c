"""Sources cut into passages: paragraphs, pages, merged fragments, speaker turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veriloom.functions.text import passage_base

#: The least characters of a paragraph that is kept, and of a fragment that stands alone.
LEAST, ALONE = 40, 200
TRIM = r"^[\s\u0085  -     　]+|[\s\u0085  -     　]+$"
# A speaker's label, up to eight spaces in, with two capitals in a row in its last name and white space
# after the colon; and a full name of two words or more on the roster.
LABEL = r"^ {0,8}(The CHAIR|[A-Z][A-Za-z.'’-]*(?: [A-Z][A-Za-z.'’-]*)*[A-Z]{2}[A-Za-z.'’-]*):\s"
FULL_NAME = r"[A-Z][a-zA-Z]+(?: [A-Z][a-zA-Z]+)+"
TURN = LABEL + "(.*)$"


def trimmed(text: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(text, TRIM, "")


def _numbered(parts: Column, least: int) -> Column:
    """Kept parts with their place among the kept ones."""
    kept = F.filter(F.transform(parts, trimmed), lambda p: F.char_length(p) >= least)
    return kept


def paragraphs(docs: DataFrame, key: str = "doc", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, no, paragraph): parts between blank lines of at least ``least`` characters, numbered from 0 among those kept; form feeds count as blank lines."""
    parts = F.split(F.regexp_replace(text, "\f", "\n\n"), r"\n\s*\n")
    return docs.select(key, F.posexplode(_numbered(parts, least)).alias("no", "paragraph"))


def pages(docs: DataFrame, key: str = "doc", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, page, no, paragraph): pages between form feeds from 1, paragraphs within each from 0."""
    each = docs.select(key, F.posexplode(F.split(text, "\f")).alias("page", "body"))
    return each.select(key, (F.col("page") + 1).alias("page"), F.posexplode(_numbered(F.split("body", r"\n\s*\n"), least)).alias("no", "paragraph"))


def merged_fragments(docs: DataFrame, key: str = "doc", text: str = "text", alone: int = ALONE) -> DataFrame:
    """(key, no, passage): a part shorter than ``alone`` is joined to the next that is not; what is left at the end is one more passage.

    Done within each text by folding over its parts, so no shuffle is needed.
    """
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), trimmed), lambda p: p != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("held"))

    def step(acc: Column, p: Column) -> Column:
        both = F.concat(acc["held"], F.array(p))
        full = F.char_length(p) >= alone
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(both, "\n\n")))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array().cast("array<string>")).otherwise(both).alias("held"),
        )

    folded = F.aggregate(parts, zero, step, lambda a: F.when(F.size(a["held"]) > 0, F.concat(a["done"], F.array(F.array_join(a["held"], "\n\n")))).otherwise(a["done"]))
    return docs.select(key, F.posexplode(folded).alias("no", "passage"))


def speaker_turns(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """(key, no, speaker, speech): a line with a speaker's label opens a turn; lines before the first are dropped, and turns without speech take no number."""
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r", ""), "\n")).alias("at", "line"))
    by = W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    opened = lines.withColumn("open", F.col("line").rlike(TURN)).withColumn("turn", F.sum(F.col("open").cast("int")).over(by)).where("turn > 0")
    said = F.when(F.col("open"), F.regexp_extract("line", TURN, 2)).otherwise(F.col("line"))
    turns = opened.groupBy(key, "turn").agg(
        F.max(F.when(F.col("open"), F.regexp_extract("line", TURN, 1))).alias("speaker"),
        trimmed(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", said.alias("s")))), lambda x: x["s"]), "\n")).alias("speech"),
    ).where("speech <> ''")
    return turns.select(key, (F.row_number().over(W.partitionBy(key).orderBy("turn")) - 1).alias("no"), "speaker", "speech")


def role_of(speaker: Column, roster: Column) -> Column:
    """Chair for a label with CHAIR, questioner for a surname on the roster (upper case), else witness."""
    name = F.upper(F.element_at(F.split(F.btrim(speaker), r"\s+"), -1))
    return F.when(F.contains(F.upper(speaker), F.lit("CHAIR")), "chair").when(F.array_contains(roster, name), "questioner").otherwise("witness")


def roster_names(head: Column) -> Column:
    """A10: upper-case surnames of the full names between MEMBERS and the first label or WITNESS of a transcript's head."""
    body = F.regexp_replace(F.regexp_extract(head, r"(?s)MEMBERS(.*)", 1), f"(?ms)(?:{LABEL}|WITNESS).*", "")
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(f"({FULL_NAME})"), 1), lambda x: F.upper(F.element_at(F.split(x, " "), -1))))


def with_context(turns: DataFrame, key: str = "doc", order: str = "no") -> DataFrame:
    """A witness's turn takes the turn right before it as context if that was a questioner's or the chair's."""
    by = W.partitionBy(key).orderBy(order)
    asked = (F.col("role") == "witness") & F.lag("role").over(by).isin("questioner", "chair")
    return turns.select("*", *(F.when(asked, F.lag(c).over(by)).alias(f"context_{c}") for c in ("speaker", "role", "speech")))


def route_of(path: Column) -> Column:
    """A3: the parser for a file path, first match: submission, qon, leaderboard, cited, report excerpt, else hearing."""
    return (
        F.when(F.contains(path, F.lit("/submissions/")), "submission").when(F.contains(path, F.lit("/qon/")), "qon").when(F.contains(path, F.lit("/leaderboards/")), "leaderboard")
        .when(F.contains(path, F.lit("/cited/")), "cited").when(path.rlike(r"(?i)/report[^/]*\.txt$"), "report").otherwise("hearing")
    )


def speakers(passages: DataFrame) -> DataFrame:
    """(speaker, role, turns): every speaker with the role of the first passage by ``ord``."""
    return passages.where("speaker is not null").groupBy("speaker").agg(F.min_by("role", "ord").alias("role"), F.count(F.lit(1)).alias("turns"))


def source_counts(passages: DataFrame) -> DataFrame:
    """(source_kind, n_docs, n_passages)."""
    return passages.groupBy("source_kind").agg(F.count_distinct(passage_base("id")).alias("n_docs"), F.count(F.lit(1)).alias("n_passages"))
