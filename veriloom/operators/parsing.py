"""Loose texts into parts: model responses, summaries, footnotes."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veriloom.functions import text as T

STRINGS_OR_COMMAS = re.compile(r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])', re.S)


def loose_json(text: str | None) -> object | None:
    """The first JSON object or array in a text, whatever stands around it; None if there is none.

    Commas before a closing bracket are dropped, outside strings only. A value that is cut off gives None.
    """
    if not text:
        return None
    plain = STRINGS_OR_COMMAS.sub(lambda m: m[0] if m[0][0] == '"' else "", re.sub(r"```\w*", "", text))
    reader = json.JSONDecoder(strict=False)
    for m in re.finditer(r"[{\[]", plain):
        try:
            return reader.raw_decode(plain, m.start())[0]
        except (ValueError, RecursionError):
            continue
    return None


# Fixed value: what marks an item of a list.
MARKER = r"^\s*(?:\d{1,2}[.)]|[-*•])\s+"


def summary_claims(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, claim): the lines of a summary without their list markers; of one run-on line the parts between numbered markers, if there are two or more; else the whole.

    Comment and blank lines are no claims. An empty text has none.
    """
    parts = F.filter(F.transform(F.split(F.btrim(text, F.lit(" \t\r\n")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: (x != "") & ~x.startswith("#"))
    listed = F.filter(F.transform(parts, lambda x: F.btrim(F.regexp_replace(x, MARKER, ""))), lambda x: x != "")
    # A control character takes the place of each run-on marker, so the markers themselves are cut away.
    cut = F.split(F.regexp_replace(text, r"(^|[\s.?!\")”])\d{1,2}[.)]\s+", "$1\u0001"), "\u0001")
    run_on = F.filter(F.transform(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    whole = F.filter(F.array(F.btrim(text, F.lit(" \t\r\n"))), lambda x: x != "")
    chosen = F.when(F.size(listed) >= 2, listed).when(F.size(run_on) >= 2, run_on).otherwise(whole)
    return rows.where(F.col(text).isNotNull()).select(key, F.posexplode(chosen).alias("no", "claim"))


# Phrases that tell what a paragraph rests on, and those of a footnote's source; case does not matter.
KINDS = {
    "testimony": r"the Committee heard|told the Committee|\bwitnesses\b|submitted that|evidence to the inquiry",
    "opinion": r"the Committee believes|the Committee considers|notes with concern|is disappointed|it is disappointing|the Committee calls (for|on)|\brecommends\b|\bshould\b",
}
WORLD = (
    r"Annual Report|\bdataset\b|\bdata\b|Australian Bureau of Statistics|\bABS\b|\bAct\s+\d{4}|\bCensus\b|Audience Atlas|OzTAM|\bVOZ\b|Productivity Commission|"
    r"Enterprise Agreement|Budget Office|cultural funding by government|Government cultural funding|Artists as Workers|\bsurvey\b|\bReport\b|<https?://|accessed \d{1,2}"
)
NAMED = r"Transcript of evidence|Submission\s+\d+"
# What prose has (case does not matter in the first), and a speaker's tag, which it has not.
ATTRIBUTED = r"the Committee|told|stated|said|submission|emphasi[sz]ed|noted|explained|highlighted|argued|according to|witness|submitted"
RUN, TAG = r"(?:\b[a-z][a-z]+\b[ ,]+){5,}", r"[A-Z]{3,}:|\b[A-Z][a-z]+ [A-Z]{3,}\b"
# Words that carry no content.
STOP = tuple(
    "the a an of to in and or for with is are was were be been that this these those on at by from as it its their they them our we us have has had can could may might "
    "not do does no more most all any into over per such other which who whom".split()
)


def kinds_of(text: str | Column, notes: str | Column | None = None) -> Column:
    """What a paragraph rests on: the one kind it has signs of, ``mixed`` for several, ``unclear`` for none.

    ``notes``, an array, are its footnotes: one that names data, a report, a law or a page, and no witness, is a sign of ``world``.
    """
    t = F.col(text) if isinstance(text, str) else text
    hits = [F.when(t.rlike(f"(?i){rx}"), F.lit(k)) for k, rx in KINDS.items()]
    if notes is not None:
        hits.append(F.when(F.exists(F.col(notes) if isinstance(notes, str) else notes, lambda x: x.rlike(f"(?i){WORLD}") & ~x.rlike(f"(?i){NAMED}")), F.lit("world")))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).when(F.size(found) > 1, "mixed").otherwise("unclear")


def is_prose(text: str | Column, least: int = 6) -> Column:
    """At least ``least`` words with content, a verb of attribution or a run of five lower-case words, no speaker's tag, at most half of the words with a capital."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return (F.size(T.content_words(t, STOP)) >= least) & (t.rlike(f"(?i){ATTRIBUTED}") | t.rlike(RUN)) & ~t.rlike(TAG) & (2 * capital <= F.size(words))


def cited_documents(text: str | Column) -> Column:
    """Documents that a sentence names, in order, each once: submissions with attachments."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    found = F.regexp_extract_all(t, F.lit(r"(submission \d+(?: attachment \d+)?)"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"^submission (\d+)", "submission:$1"), r" attachment (\d+)$", "/attachment-$1")))


def with_default(rows: DataFrame, names: DataFrame, key: str, name: str, mark: str = "§") -> DataFrame:
    """Rows with the name of their key, or the key itself behind a mark where it has none."""
    return rows.join(names, key, "left").withColumn(name, F.coalesce(name, F.concat(F.lit(mark), F.col(key).cast("string"))))


def nearest_note(marks: DataFrame, notes: DataFrame, slack: int = 3) -> DataFrame:
    """For each mark (doc, number, line) the note (doc, number, note_line) of its number: the first at or after ``line - slack``, else the last before.

    Candidates share document and number, and are ranked, never paired with notes of another number.
    """
    near = F.col("note_line") >= F.col("line") - slack
    rank = W.partitionBy("doc", "number", "line").orderBy(F.when(near, 0).otherwise(1), F.when(near, F.col("note_line")).otherwise(-F.col("note_line")))
    return marks.join(notes, ["doc", "number"]).withColumn("k", F.row_number().over(rank)).where("k = 1").drop("k")


def footnotes(docs: DataFrame, key: str, text: str, highest: int = 250) -> DataFrame:
    """(key, line, number, note): a line of a number alone, followed, blank lines apart, by lines of a citation up to the next blank one.

    A citation has a year, an address, or a word that sources are cited with. Done within each text by
    a pattern, so no line leaves its document.
    """
    block = r"(?m)(?:^|\n)[ \t]*(\d{1,3})[ \t]*\n(?:[ \t]*\n)*((?:[ \t]*\S[^\n]*(?:\n|$))+)"
    found = docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(block), F.lit(0))).alias("no", "b"))
    n, note = F.regexp_extract("b", r"^\s*(\d{1,3})", 1).try_cast("int"), F.btrim(F.regexp_replace(F.regexp_replace("b", r"^\s*\d{1,3}[ \t]*\n", ""), r"\s+", " "))
    cites = F.col("note").rlike(r"(?i)\b(19|20)\d{2}\b|https?://|\b(submission|p\.|pp\.|ibid|evidence|hansard|report)\b")
    return found.select(key, "no", n.alias("number"), note.alias("note")).where(F.col("number").between(1, highest) & cites)


def note_marks(text: str | Column) -> Column:
    """The numbers of notes glued to a letter, a closing quote or bracket, with or without a full stop or colon between; numbers and shares are left alone."""
    t = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(t, F.lit(r"(?<=[A-Za-z’”)?!]|[A-Za-z’”)?!]\.|[A-Za-z’”]:)(\d{1,3})(?![\d%])"), 1), lambda x: x.cast("int"))
