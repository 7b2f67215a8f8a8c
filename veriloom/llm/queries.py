"""Queries of the problems on texts and labels, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import bpe, consensus, langid, lookalike, mixing, records, scans, spans, turns
from veriloom.sources.tables import table


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(records.passage_texts(spark, d).unionByName(records.quote_texts(spark, d)))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each passage or quote with a span of at least 160 characters found in another."""
    return _spans(spark, d).where("n_shared > 0").select("rec")


def p1_shared(spark: SparkSession, d: str) -> DataFrame:
    """How many characters of each passage and quote are shared."""
    return _spans(spark, d)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return records.passage_texts(spark, d).unionByName(records.quote_texts(spark, d)).unionByName(records.route_texts(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of passages, quotes and route paragraphs that look the same but differ."""
    return lookalike.equal_looking_pairs(_texts(spark, d))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of every passage, quote and route paragraph that looks like another but differs."""
    return lookalike.equal_looking_classes(_texts(spark, d))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """The one form of every passage, quote and route paragraph."""
    return lookalike.canonical(_texts(spark, d)).select("rec", "canonical")


def _adjudicated(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "adjudications")
    return a.select(F.col("id").alias("item"), F.upper(F.btrim("initials")).alias("annotator"), consensus.verdict_of(F.col("verdict")).alias("label"), F.col("judged_at").alias("at"), F.col("adj_id").alias("row_id"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Every sample of the judge runs, with the brief rows for what the runs leave open."""
    runs = table(spark, d, "chains").select(F.col("claim_id").alias("item"), F.concat(F.lit("run:"), "chain").alias("annotator"), "verdict", "spread", "samples", F.col("written_at").alias("at"), F.col("record_id").alias("row_id"))
    return consensus.judge_votes(runs, table(spark, d, "brief_rows").select(F.col("id").alias("item"), "faith", "spread", "dissent"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The consensus verdict of each claim that at least three adjudicators judged."""
    items, _ = consensus.fit(consensus.latest_labels(_adjudicated(spark, d)))
    return items.where("n_labels >= 3").select(F.col("item").alias("claim_id"), F.col("label").alias("verdict"))


def p4_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Consensus, confidence and agreement of every claim over adjudicators and judge runs."""
    people = consensus.latest_labels(_adjudicated(spark, d)).withColumns({"n": F.lit(1.0), "alike": F.lit(1.0)})
    items = consensus.fit(people.unionByName(_judged(spark, d)))[0]
    return items.withColumns({c: F.round(c, 6) for c in ("votes", "n_labels")}).withColumnRenamed("item", "claim_id").withColumnRenamed("label", "verdict")


def p4_reliability(spark: SparkSession, d: str) -> DataFrame:
    """The reliability and guesses of every adjudicator."""
    return consensus.fit(consensus.latest_labels(_adjudicated(spark, d)))[1]


def _fragments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    people = table(spark, d, "speakers")
    hearings = table(spark, d, "passages").where("source_kind = 'hearing'")
    return turns.fragments(hearings, turns.roster_of(people)), people


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The turns of every hearing with their people."""
    return turns.turns(*_fragments(spark, d)).select("session_key", "first_t", "last_t", "person_id")


def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    """The clean speech of every turn, fragment by fragment in order."""
    return turns.turn_texts(*_fragments(spark, d))


def _scan_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All texts with a flag for those that were scanned, and the scanned pages with their document."""
    p = table(spark, d, "passages").select(F.concat(F.lit("p:"), "id").alias("rec"), F.col("passage_no").cast("long").alias("ord"), "text", (F.col("source_kind") == "report").alias("scanned"))
    r = records.route_texts(spark, d).withColumn("scanned", F.lit(True))
    pages = p.where("scanned").select("rec", "ord", scans.doc_of(F.col("rec")).alias("doc"), "text").unionByName(r.select("rec", "ord", F.lit(None).cast("string").alias("doc"), "text"))
    return p.unionByName(r).select("text", F.coalesce("scanned", F.lit(False)).alias("scanned")), pages


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Noise lines, broken words and misrecognised words of every scanned page and paragraph."""
    texts, pages = _scan_inputs(spark, d)
    return scans.repairs(texts, pages).select("rec", "noise", "item").distinct()


def p6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Every scanned page and route paragraph as a continuous paragraph."""
    return scans.paragraphs(*_scan_inputs(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return bpe.encoded(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every mix with their number of copies."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each source's target share and actual share of every mix."""
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages with a full sentence in a document that its label does not name."""
    return langid.unnamed_languages(table(spark, d, "documents"))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    """The language of every document with a confidence."""
    return langid.document_languages(table(spark, d, "documents"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """The language of every stretch of every document with a confidence."""
    return langid.segments(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_shared, p2_found, p2_classes, p2_forms, p4_found, p4_consensus, p4_reliability, p5_found, p5_turns, p6_found, p6_paragraphs, p8_ids, p9_mix, p9_shares, p10_found, p10_documents, p10_segments)}


# The records of problems 1 and 2 in SQL: one row per name, the last delivery.
_Q = """SELECT 'q:' || record_id || '#' || pos AS rec, text, came FROM (SELECT record_id, written_at AS came, unnest(range(len(detail.quotes))) AS pos, unnest(detail.quotes) AS text FROM chains)"""
_RECS = f"""p AS (SELECT 'p:' || id AS rec, text FROM passages WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY passage_no DESC) = 1),
q AS (SELECT rec, text FROM ({_Q}) WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rec ORDER BY came DESC, text DESC) = 1)"""
_WINDOWS = f"""WITH {_RECS}, t AS (SELECT * FROM p UNION ALL SELECT * FROM q), w AS (SELECT rec, s, substr(text, s, 160) AS g FROM (SELECT rec, text, unnest(range(1, length(text) - 158)) AS s FROM t WHERE length(text) >= 160)),
sh AS (SELECT g FROM w GROUP BY g HAVING count(DISTINCT rec) > 1)"""


# The canonical form in SQL, from letters and ranges of its own: only texts with other than plain characters are taken apart.
_SQL_LETTERS = (
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιρυκχγτη",
    "ABESIJKMHOPCTYXaesijopcyxhdqwlABEZHIKMNOPTYXovaipukxytn",
)
_SQL_FORM = f"""CASE WHEN regexp_matches(text, '[^\\x20-\\x7e\\n]') THEN array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c:
 CASE WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248)
 WHEN unicode(c) IN (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8232, 8233, 8239, 8287, 12288) OR unicode(c) BETWEEN 8192 AND 8202 THEN ' '
 WHEN unicode(c) < 32 OR unicode(c) BETWEEN 127 AND 159 OR unicode(c) IN (173, 847, 1564, 6158, 65279) OR unicode(c) BETWEEN 8203 AND 8207 OR unicode(c) BETWEEN 8234 AND 8238 OR unicode(c) BETWEEN 8288 AND 8303 OR unicode(c) BETWEEN 65024 AND 65039 THEN ''
 WHEN c = 'ﬁ' THEN 'fi' WHEN c = 'ﬂ' THEN 'fl' WHEN c = 'ﬀ' THEN 'ff' WHEN c = 'ﬃ' THEN 'ffi' WHEN c = 'ﬄ' THEN 'ffl' WHEN unicode(c) IN (8208, 8209) THEN '-'
 ELSE translate(c, '{_SQL_LETTERS[0]}', '{_SQL_LETTERS[1]}') END), '') ELSE text END"""
_FORMS = f"""WITH {_RECS}, r AS (SELECT 'r:' || route_no AS rec, paragraph AS text FROM routes_input WHERE paragraph IS NOT NULL),
x AS (SELECT rec, text, {_SQL_FORM} AS form FROM (SELECT * FROM p UNION ALL SELECT * FROM q UNION ALL SELECT * FROM r)),
f AS (SELECT rec, text, trim(regexp_replace(nfc_normalize(form), '[ \\n]+', ' ', 'g'), ' ') AS form FROM x)"""


SQL: dict[str, str] = {
    "p1_found": f"{_WINDOWS} SELECT DISTINCT rec FROM w SEMI JOIN sh USING (g)",
    "p1_shared": f"""{_WINDOWS}, c AS (SELECT rec, count(*) AS n FROM (SELECT DISTINCT rec, unnest(range(s, s + 160)) AS place FROM w SEMI JOIN sh USING (g)) GROUP BY rec), k AS (SELECT text, count(*) AS n_copies FROM t GROUP BY text)
SELECT rec, length(text)::INTEGER AS n_chars, coalesce(c.n, 0)::INTEGER AS n_shared, n_copies FROM t LEFT JOIN c USING (rec) JOIN k USING (text)""",
    "p2_found": f"{_FORMS} SELECT a.rec AS rec_a, b.rec AS rec_b FROM f a JOIN f b ON a.form = b.form AND a.rec < b.rec AND a.text <> b.text",
    "p2_classes": f"""{_FORMS}, v AS (SELECT form, text, min(rec) AS variant, count(*) AS n FROM f GROUP BY ALL), k AS (SELECT form, min(variant) AS class_id, count(*) AS n_variants, sum(n)::BIGINT AS n_members FROM v GROUP BY form HAVING count(*) > 1)
SELECT rec, class_id, variant, n_variants, n_members FROM f JOIN v USING (form, text) JOIN k USING (form)""",
    "p2_forms": f"{_FORMS} SELECT rec, form AS canonical FROM f",
}
