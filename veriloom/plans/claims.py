"""Queries of the claim-checking operators over the project's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veriloom.functions import text as T
from veriloom.operators import edges as D
from veriloom.operators import chains as C
from veriloom.operators import grounding as G
from veriloom.operators import grouping as O  # noqa: N812
from veriloom.operators import retrieval as R
from veriloom.operators import segmenting as S
from veriloom.operators import trees as E
from veriloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# One row per passage id and per record id, the last to come; and the last record of each idx of a chain.
P_ = "P AS (SELECT * FROM passages QUALIFY row_number() OVER (PARTITION BY id ORDER BY passage_no DESC) = 1)"
R_ = "R AS (SELECT * FROM chains QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY written_at DESC) = 1)"
L_ = R_ + ", L AS (SELECT * FROM R QUALIFY row_number() OVER (PARTITION BY chain, idx ORDER BY record_id DESC) = 1)"
B_ = "B AS (SELECT * FROM brief_rows QUALIFY row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws('|', text, faith, dissent)) DESC) = 1)"
TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
VISIBLE = "CASE WHEN coalesce(context, '') <> '' THEN context || chr(10) || chr(10) || text ELSE text END"
NORM = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(lower({}), '’', ''''), '‘', ''''), '“', '\"'), '”', '\"'), '—', '-'), '–', '-'), '[\\t\\n\\f\\r ]+', ' ', 'g'), ' ')"
CLEAN = "nullif(CASE WHEN regexp_replace(lower({0}), '[^a-z]', '', 'g') LIKE 'partial%' THEN 'partial' WHEN regexp_replace(lower({0}), '[^a-z]', '', 'g') LIKE 'contradict%' THEN 'contradicted' WHEN regexp_replace(lower({0}), '[^a-z]', '', 'g') LIKE 'notpresent%' THEN 'absent' ELSE regexp_replace(lower({0}), '[^a-z]', '', 'g') END, '')"
RANK = "coalesce(list_position(['unsupported','contradicted','absent','unverifiable','overstated','partial','faithful','error'], {}), 9)"
SIDE = "CASE WHEN {0} IN ('faithful','partial') THEN 'supported' WHEN {0} IN ('overstated','absent','contradicted','unsupported') THEN 'not-supported' ELSE {0} END"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return keep


def passages(spark: SparkSession, d: str) -> DataFrame:
    """One row per passage id."""
    return C.last_wins(table(spark, d, "passages"), ["id"], ["passage_no"])


def records(spark: SparkSession, d: str) -> DataFrame:
    """One row per record id."""
    return C.last_wins(table(spark, d, "chains"), ["record_id"], ["written_at"])


def held_records(spark: SparkSession, d: str) -> DataFrame:
    """The last record of each idx of each chain."""
    return C.last_wins(records(spark, d), ["chain", "idx"], ["record_id"])


def brief(spark: SparkSession, d: str) -> DataFrame:
    """One row per claim of the brief."""
    rows = table(spark, d, "brief_rows")
    return C.last_wins(rows.withColumn("h", F.md5(F.concat_ws("|", "text", "faith", "dissent").cast("binary"))), ["id"], ["h"]).drop("h")


def bodies(p: DataFrame) -> DataFrame:
    """Passages as (pid, text), the text being all that ranking sees."""
    return p.where("text is not null").select(F.col("id").alias("pid"), T.visible_text("context", "text").alias("text"))


def claim_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: claims of records whose id is divisible by 50."""
    return records(spark, d).where("record_id % 50 = 0 and claim is not null").select(F.col("record_id").alias("qid"), F.col("claim").alias("text"))


def quotes(rows: DataFrame) -> DataFrame:
    """Quotes of records: (key, pos, quote, pid), pid being the passage named at the same place."""
    zipped = rows.select(F.col("record_id").alias("key"), F.posexplode("detail.quotes").alias("pos", "quote"), F.col("detail.quote_passages").alias("qp"))
    return zipped.where("quote is not null").select("key", "pos", "quote", F.coalesce(F.try_element_at("qp", F.col("pos") + 1), F.lit("")).alias("pid"))


@query(f"WITH {P_}, tok AS (SELECT id, unnest({TOK.format('text')}) AS term FROM P) SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM tok GROUP BY term")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    """Passages and uses of every term."""
    return R.term_stats(passages(spark, d).select(F.col("id").alias("pid"), "text"))


@query(f"WITH {P_}, dl AS (SELECT id, len({TOK.format('text')}) AS dl FROM P WHERE text IS NOT NULL) SELECT count(*) AS n_docs, sum(dl)::BIGINT AS n_tokens, round(avg(dl), 6) AS avg_len, max(dl) AS max_len FROM dl")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """The size of the corpus in passages and tokens."""
    dl = R.lengths(passages(spark, d).where("text is not null").select(F.col("id").alias("pid"), "text"))
    return dl.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("n_tokens"), F.round(F.avg("dl"), 6).alias("avg_len"), F.max("dl").cast("long").alias("max_len"))


BM25_ = f"""{P_}, {R_}, D AS (SELECT id AS pid, {VISIBLE} AS body FROM P WHERE text IS NOT NULL),
tf AS (SELECT pid, term, count(*) AS tf FROM (SELECT pid, unnest({TOK.format('body')}) AS term FROM D) GROUP BY ALL),
dl AS (SELECT pid, len({TOK.format('body')}) AS dl FROM D), st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT record_id AS qid, unnest({TOK.format('claim')}) AS term FROM R WHERE record_id % 50 = 0 AND claim IS NOT NULL) GROUP BY ALL),
sc AS (SELECT qid, pid, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a)))), 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (pid), st GROUP BY qid, pid),
rk AS (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rk FROM sc WHERE score > 0)"""


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(R.bm25(claim_queries(spark, d), bodies(passages(spark, d))))


@query(f"WITH {BM25_} SELECT qid, pid, score, rk FROM rk WHERE rk <= 10")
def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    """The ten best passages of each claim of the query set."""
    return R.ranked(R.best(claim_queries(spark, d), bodies(passages(spark, d)), 10)).where("rk <= 10")


@query(f"WITH {BM25_}, u AS (SELECT qid, pid, rk, sum(dl) OVER (PARTITION BY qid ORDER BY rk) AS used FROM rk JOIN dl USING (pid)) SELECT qid, pid, rk, used::BIGINT AS used FROM u WHERE used <= 1000 OR rk = 1")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """what of each claim's ranking goes into a budget of 1,000 tokens."""
    return R.within_budget(_bm25(spark, d).join(R.lengths(bodies(passages(spark, d))), "pid"), 1000).select("qid", "pid", "rk", "used")


@query(f"WITH {BM25_}, c AS (SELECT DISTINCT record_id AS qid, split_part(p, '#', 1) AS base FROM (SELECT record_id, unnest(passages) AS p FROM R)) SELECT qid, pid, score, rk FROM rk SEMI JOIN c ON rk.qid = c.qid AND split_part(rk.pid, '#', 1) = c.base")
def cite_scoped(spark: SparkSession, d: str) -> DataFrame:
    """C4: ranked passages of the documents that the claim's record cites."""
    cites = records(spark, d).select(F.col("record_id").alias("qid"), F.explode("passages").alias("pid")).select("qid", T.passage_base("pid").alias("base"))
    return R.scoped(_bm25(spark, d), cites).select("qid", "pid", "score", "rk")


@query(f"WITH {BM25_}, f AS (SELECT qid, pid, rk AS r0, pid IN (SELECT id FROM P WHERE source_kind = 'hearing') AS named FROM rk) SELECT qid, pid, named, row_number() OVER (PARTITION BY qid ORDER BY named DESC, r0, pid) AS rk FROM f QUALIFY rk <= 20")
def named_first(spark: SparkSession, d: str) -> DataFrame:
    """rankings with hearings before all else."""
    p = passages(spark, d)
    flagged = p.where("text is not null").select(F.col("id").alias("pid"), T.visible_text("context", "text").alias("text"), F.coalesce(F.col("source_kind") == "hearing", F.lit(False)).alias("named"))
    # A hearing among the first twenty of all is among the first twenty hearings, and so for the others.
    return R.named_first(R.ranked(R.best(claim_queries(spark, d), flagged, 20, "named"))).where("rk <= 20").select("qid", "pid", "named", "rk")


COS_ = "cs AS (SELECT q.vec_id AS qid, v.vec_id AS pid, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 5) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)"


def _cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return R.cosine(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("pid"), F.col("embedding").alias("vec")))


@query(f"WITH {COS_}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rk FROM cs) SELECT qid, pid, score, rk FROM r WHERE rk <= 10")
def cosine_top10(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of each vector of the query set."""
    e = table(spark, d, "embeddings")
    return R.nearest(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("pid"), F.col("embedding").alias("vec")), 10)


@query(f"WITH {COS_}, b AS (SELECT qid, max(score) AS best FROM cs GROUP BY qid) SELECT qid, pid, score FROM cs WHERE score >= 0.25 AND qid IN (SELECT qid FROM b WHERE best >= 0.4)")
def cosine_floor(spark: SparkSession, d: str) -> DataFrame:
    """F8: near vectors of those queries whose best reaches the floor."""
    return R.above_floor(_cosine(spark, d), 0.4).where("score >= 0.25")


@query(f"""WITH {COS_}, dd AS (SELECT doc_id AS pid, text AS body FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT vec_id FROM embeddings)),
tf AS (SELECT pid, term, count(*) AS tf FROM (SELECT pid, unnest({TOK.format('body')}) AS term FROM dd) GROUP BY ALL), dl AS (SELECT pid, len({TOK.format('body')}) AS dl FROM dd),
st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), qt AS (SELECT pid AS qid, term, tf AS qtf FROM tf WHERE pid % 50 = 0),
sc AS (SELECT qid, pid, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a)))), 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (pid), st WHERE qid <> pid GROUP BY qid, pid),
ra AS (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS ra FROM sc WHERE score > 0), rb AS (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rb FROM cs),
fu AS (SELECT qid, pid, least(ra, rb) AS best FROM ra FULL JOIN rb USING (qid, pid)) SELECT qid, pid, best, row_number() OVER (PARTITION BY qid ORDER BY best, pid) AS rk FROM fu QUALIFY rk <= 20""")
def fused_top20(spark: SparkSession, d: str) -> DataFrame:
    """Word and vector rankings of documents fused by the better rank."""
    e = table(spark, d, "embeddings")
    docs = table(spark, d, "documents").where("text is not null").join(e.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("pid"), "text")
    words = R.bm25(docs.where("pid % 50 = 0").select(F.col("pid").alias("qid"), "text"), docs).where("qid <> pid")
    return R.fused(R.ranked(words), R.ranked(_cosine(spark, d), keep_zero=True)).where("rk <= 20")


@query(f"WITH {P_}, {R_} SELECT DISTINCT record_id, pid FROM (SELECT record_id, unnest(passages) AS pid FROM R) WHERE pid NOT IN (SELECT id FROM P WHERE source_kind = 'hearing')")
def missing_cites(spark: SparkSession, d: str) -> DataFrame:
    """Passages that records name but that a corpus of hearings alone does not hold."""
    cites = records(spark, d).select("record_id", F.explode("passages").alias("pid")).where("pid is not null").distinct()
    return R.missing(cites, passages(spark, d).where("source_kind = 'hearing'").select(F.col("id").alias("pid")), "pid").select("record_id", "pid")


QUO_ = "Q AS (SELECT record_id AS key, unnest(range(len(detail.quotes))) AS pos, unnest(detail.quotes) AS quote, detail.quote_passages AS qp FROM R), QQ AS (SELECT key, pos, quote, coalesce(qp[pos + 1], '') AS pid FROM Q WHERE quote IS NOT NULL)"
CHECK_ = f"{P_}, {R_}, {QUO_}, CK AS (SELECT key, pos, pid, coalesce({NORM.format('quote')} <> '' AND contains({NORM.format('body')}, {NORM.format('quote')}), false) AS ok FROM QQ LEFT JOIN (SELECT id, {VISIBLE} AS body FROM P) X ON X.id = QQ.pid)"


@query(f"WITH {CHECK_} SELECT key AS record_id, pos, pid, ok FROM CK")
def quote_checked(spark: SparkSession, d: str) -> DataFrame:
    """Whether each quote stands in the passage it cites."""
    p = passages(spark, d).select(F.col("id").alias("pid"), "context", "text")
    return G.checked(quotes(records(spark, d)), p).select(F.col("key").alias("record_id"), "pos", "pid", "ok")


@query(f"WITH {CHECK_}, g AS (SELECT key, count(*) AS n_quotes, count(*) FILTER (ok) AS n_ok FROM CK GROUP BY key) SELECT record_id, verdict, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_ok, 0) AS n_ok, CASE WHEN coalesce(n_ok, 0) >= 1 THEN verdict WHEN verdict = 'contradicted' THEN 'absent' WHEN verdict IN ('faithful','partial','overstated') THEN 'unsupported' ELSE verdict END AS grounded FROM R LEFT JOIN g ON g.key = R.record_id")
def grounded_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every record's verdict after its quotes have been checked."""
    r = records(spark, d)
    checks = G.checked(quotes(r), passages(spark, d).select(F.col("id").alias("pid"), "context", "text")).groupBy(F.col("key").alias("record_id")).agg(F.count(F.lit(1)).alias("n_quotes"), F.count_if("ok").alias("n_ok"))
    z = F.lit(0).cast("long")
    return r.select("record_id", "verdict").join(checks, "record_id", "left").select("record_id", "verdict", F.coalesce("n_quotes", z).alias("n_quotes"), F.coalesce("n_ok", z).alias("n_ok"), T.ground_verdict("verdict", F.coalesce("n_ok", z)).alias("grounded"))


@query(f"WITH {P_}, {R_}, {QUO_}, own AS (SELECT DISTINCT record_id AS key, unnest(passages) AS id FROM R), h AS (SELECT own.key, P.id, {NORM.format(VISIBLE)} AS body FROM own JOIN P USING (id)), m AS (SELECT QQ.key, QQ.pos, h.id FROM QQ JOIN h ON h.key = QQ.key AND {NORM.format('quote')} <> '' AND contains(h.body, {NORM.format('quote')})), n AS (SELECT key, pos, count(*) AS n, min(id) AS id FROM m GROUP BY key, pos) SELECT QQ.key AS record_id, QQ.pos, CASE WHEN n = 1 THEN n.id ELSE '' END AS source FROM QQ LEFT JOIN n ON n.key = QQ.key AND n.pos = QQ.pos")
def quote_unique_source(spark: SparkSession, d: str) -> DataFrame:
    """The one passage of a record that holds each of its quotes."""
    r = records(spark, d)
    own = r.select(F.col("record_id").alias("key"), F.explode("passages").alias("pid"))
    found = G.unique_source(quotes(r), own, passages(spark, d).select(F.col("id").alias("pid"), "context", "text"))
    return found.select(F.col("key").alias("record_id"), "pos", "source")


@query(f"WITH {P_}, {R_}, {QUO_}, b AS (SELECT id AS pid, {NORM.format(VISIBLE)} AS body FROM P WHERE text IS NOT NULL), n AS (SELECT key, pos, {NORM.format('quote')} AS q FROM QQ) SELECT key AS record_id, pos, b.pid FROM n JOIN b ON q <> '' AND contains(body, q)")
def quote_located(spark: SparkSession, d: str) -> DataFrame:
    """Every passage that holds a quote, whichever it cites."""
    p = passages(spark, d).where("text is not null").select(F.col("id").alias("pid"), "context", "text")
    return G.located(quotes(records(spark, d)).select("key", "pos", "quote"), p).select(F.col("key").alias("record_id"), "pos", "pid")


@query(f"WITH {P_}, {R_}, x AS (SELECT record_id, unnest(range(len(passages))) AS pos, unnest(passages) AS id FROM R) SELECT record_id, pos, id AS pid, source_kind, len(text) AS n_chars FROM x JOIN P USING (id)")
def passages_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The passages of each record in the order named."""
    ids = records(spark, d).select(F.col("record_id").alias("key"), F.col("passages").alias("ids"))
    p = passages(spark, d).select(F.col("id").alias("pid"), "source_kind", F.char_length("text").cast("long").alias("n_chars"))
    return G.in_order(ids, p).select(F.col("key").alias("record_id"), "pos", "pid", "source_kind", "n_chars")


@query(f"WITH {P_}, {R_}, x AS (SELECT record_id, claim, unnest(range(len(passages))) AS pos, unnest(passages) AS id FROM R), s AS (SELECT record_id, pos, id AS pid, len(list_intersect(list_distinct({TOK.format('claim')}), list_distinct({TOK.format('text')}))) AS shared FROM x JOIN P USING (id)) SELECT record_id, pos, pid, shared FROM s WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY shared DESC, pos) = 1")
def best_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The passage of each record that shares most distinct words with its claim."""
    r = records(spark, d)
    own = G.in_order(r.select(F.col("record_id").alias("key"), F.col("passages").alias("ids")), passages(spark, d).select(F.col("id").alias("pid"), "text"))
    best = G.best_overlap(r.select(F.col("record_id").alias("key"), "claim"), own)
    return best.select(F.col("key").alias("record_id"), "pos", "pid", F.col("shared").cast("long").alias("shared"))


@query(f"WITH {L_} SELECT chain, idx, record_id, verdict FROM L")
def chain_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The record that holds for each idx of each chain."""
    return held_records(spark, d).select("chain", "idx", "record_id", "verdict")


@query(f"WITH {R_} SELECT chain, count(*) AS n_records, count(DISTINCT idx) AS n_idx, (max(idx) + 1)::BIGINT AS n_expected, count(DISTINCT mode) AS n_modes, (max(idx) + 1 - count(DISTINCT idx))::BIGINT AS n_missing FROM R GROUP BY chain")
def chain_gaps(spark: SparkSession, d: str) -> DataFrame:
    """How complete each chain is."""
    return C.gaps(records(spark, d)).select("chain", "n_records", "n_idx", F.col("n_expected").cast("long").alias("n_expected"), "n_modes", F.col("n_missing").cast("long").alias("n_missing"))


POOL_ = f"""{L_}, O AS (SELECT *, row_number() OVER (ORDER BY chain, idx, record_id) AS o FROM L WHERE claim_id IS NOT NULL),
S AS (SELECT claim_id, v AS verdict, o * 1000 + pos AS place FROM (SELECT claim_id, o, unnest(CASE WHEN len(coalesce(samples, [])) > 0 THEN samples ELSE [verdict] END) AS v, unnest(range(len(CASE WHEN len(coalesce(samples, [])) > 0 THEN samples ELSE [verdict] END))) AS pos FROM O) WHERE v IS NOT NULL AND v <> ''),
K AS (SELECT claim_id, verdict, count(*) AS k, min(place) AS first, {RANK.format('verdict')} AS rk, {SIDE.format('verdict')} AS side FROM S GROUP BY claim_id, verdict),
M AS (SELECT *, sum(k) OVER (PARTITION BY claim_id) AS n, max(k) OVER (PARTITION BY claim_id) AS top, row_number() OVER (PARTITION BY claim_id ORDER BY k DESC, rk, verdict) AS pl FROM K),
T AS (SELECT claim_id, max(verdict) FILTER (pl = 1) AS verdict, max(top)::BIGINT AS k, max(n)::BIGINT AS n,
 CASE WHEN max(n) < 2 THEN '' ELSE max(top) || '/' || max(n)::BIGINT END AS spread,
 CASE WHEN max(n) < 2 THEN '' ELSE coalesce(string_agg(verdict, ', ' ORDER BY first) FILTER (pl > 1), '') END AS dissent,
 CASE WHEN count(*) = 1 THEN 'settled' WHEN count(*) FILTER (k = top) > 1 THEN 'contested' WHEN count(DISTINCT side) = 1 THEN 'wobble' ELSE 'contested' END AS stability,
 CASE WHEN count(*) FILTER (k = top) > 1 THEN string_agg(verdict, '/' ORDER BY rk, verdict) FILTER (k = top) ELSE '' END AS split,
 string_agg(k || ' ' || verdict, ' · ' ORDER BY first) AS tally FROM M GROUP BY claim_id)"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    rows = held_records(spark, d).where("claim_id is not null")
    return C.merged(rows, "claim_id", ["chain", "idx", "record_id"])


@query(f"WITH {POOL_} SELECT * FROM T")
def pooled_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdict, spread, dissent, stability, split and tally of each claim over all runs."""
    return _merged(spark, d).drop("rep_chain", "rep_idx", "rep_record_id")


@query(f"WITH {POOL_} SELECT O.claim_id, O.record_id FROM O JOIN T USING (claim_id) QUALIFY row_number() OVER (PARTITION BY O.claim_id ORDER BY coalesce(O.verdict <> T.verdict, true), O.o) = 1")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    """The record that stands for each claim's pooled verdict."""
    return _merged(spark, d).select("claim_id", F.col("rep_record_id").alias("record_id"))


@query(f"WITH {POOL_} SELECT stability, count(*) AS n_claims, sum(n)::BIGINT AS n_samples FROM T GROUP BY stability")
def stability_counts(spark: SparkSession, d: str) -> DataFrame:
    """Claims and samples of each class of stability."""
    return _merged(spark, d).groupBy("stability").agg(F.count(F.lit(1)).alias("n_claims"), F.sum("n").alias("n_samples"))


@query(f"WITH {R_}, c AS (SELECT DISTINCT id AS claim_id FROM brief_rows WHERE id IS NOT NULL) SELECT claim_id FROM c WHERE claim_id NOT IN (SELECT claim_id FROM R WHERE claim_id IS NOT NULL AND chain LIKE '%/run-4')")
def unjudged_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims that the fourth runs have yet to judge."""
    claims = table(spark, d, "brief_rows").select(F.col("id").alias("claim_id")).where("claim_id is not null").distinct()
    return C.unjudged(claims, records(spark, d).where("chain like '%/run-4'"), "claim_id")


@query(f"WITH {R_} SELECT claim_id, record_id, verdict FROM R WHERE claim_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY written_at DESC, record_id DESC) = 1")
def newest_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The newest record of each claim."""
    rows = records(spark, d).where("claim_id is not null").select("claim_id", "written_at", "record_id", "verdict")
    return C.last_wins(rows, ["claim_id"], ["written_at", "record_id"]).select("claim_id", "record_id", "verdict")


@query(f"WITH {L_}, v AS (SELECT claim_id, split_part(chain, '/', 2) AS cell, max(verdict) AS verdict FROM L WHERE claim_id IS NOT NULL AND verdict IS NOT NULL GROUP BY ALL) SELECT a.cell AS cell_a, b.cell AS cell_b, count(*) AS n_both, count(*) FILTER (a.verdict <> b.verdict) AS n_differ FROM v a JOIN v b ON a.claim_id = b.claim_id AND a.cell < b.cell GROUP BY ALL")
def divergent_runs(spark: SparkSession, d: str) -> DataFrame:
    """For each two runs, the claims that both judged and those they judged differently."""
    rows = held_records(spark, d).where("claim_id is not null and verdict is not null").withColumn("cell", F.split_part("chain", F.lit("/"), F.lit(2)))
    return C.divergent_pairs(rows, "claim_id", "cell", "verdict")


@query(f"WITH {R_} SELECT backend, verdict, n, round(n / sum(n) OVER (PARTITION BY backend), 6) AS share FROM (SELECT coalesce(backend, '') AS backend, verdict, count(*) AS n FROM R GROUP BY ALL)")
def verdict_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of each backend with their shares."""
    counts = records(spark, d).groupBy(F.coalesce("backend", F.lit("")).alias("backend"), "verdict").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("backend", "verdict", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy("backend")), 6).alias("share"))


@query(f"WITH {R_}, v AS (SELECT chain, verdict, {RANK.format('verdict')} AS rk, count(*) AS n FROM R WHERE verdict IS NOT NULL GROUP BY ALL) SELECT chain, sum(n)::BIGINT AS total, sum(n) FILTER (verdict <> 'error')::BIGINT AS verified, string_agg(n || ' ' || verdict, ' · ' ORDER BY rk, verdict) AS summary FROM v GROUP BY chain")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Totals of each run and its verdicts in a fixed order."""
    v = records(spark, d).where("verdict is not null").groupBy("chain", "verdict").agg(F.count(F.lit(1)).alias("n"))
    cell = F.array_sort(F.collect_list(F.struct(T.worst_rank("verdict").alias("rk"), F.col("verdict").alias("v"), F.col("n").alias("n"))))
    return v.groupBy("chain").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("verdict") != "error", F.col("n"))).alias("verified"), F.array_join(F.transform(cell, lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["v"])), " · ").alias("summary"))


@query(f"WITH {R_} SELECT coalesce(backend, '') AS backend, count(*) AS n_records, round(sum(elapsed_s), 3) AS seconds, round(avg(elapsed_s), 4) AS seconds_each, count(DISTINCT claim_id) AS n_claims FROM R GROUP BY ALL")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """Records and seconds of each backend."""
    return records(spark, d).groupBy(F.coalesce("backend", F.lit("")).alias("backend")).agg(F.count(F.lit(1)).alias("n_records"), F.round(F.sum("elapsed_s"), 3).alias("seconds"), F.round(F.avg("elapsed_s"), 4).alias("seconds_each"), F.count_distinct("claim_id").alias("n_claims"))


@query(f"WITH {R_}, x AS (SELECT claim_id, unnest(passages) AS pid, unnest(range(len(passages))) AS pos, record_id FROM R WHERE claim_id IS NOT NULL) SELECT claim_id, pid, min(record_id * 1000 + pos) AS first, count(*) AS n FROM x WHERE pid IS NOT NULL GROUP BY ALL")
def first_seen_passages(spark: SparkSession, d: str) -> DataFrame:
    """The distinct passages of each claim with the place where each was first seen."""
    rows = records(spark, d).where("claim_id is not null").select("claim_id", "record_id", F.posexplode("passages").alias("pos", "pid")).where("pid is not null")
    return C.first_seen(rows.withColumn("at", F.col("record_id") * 1000 + F.col("pos")), "claim_id", "pid", "at")


@query(f"WITH {P_}, {R_} SELECT id AS pid FROM P WHERE id NOT IN (SELECT unnest(passages) AS p FROM R WHERE passages IS NOT NULL)")
def never_cited(spark: SparkSession, d: str) -> DataFrame:
    """H3: passages that no record names."""
    cited = records(spark, d).select(F.explode("passages").alias("pid"))
    return R.missing(passages(spark, d).select(F.col("id").alias("pid")), cited, "pid")


ADJ_ = f"A AS (SELECT id AS claim_id, upper(trim(initials, ' ')) AS who, {CLEAN.format('verdict')} AS human, judged_at FROM adjudications WHERE id IS NOT NULL AND initials IS NOT NULL AND {CLEAN.format('verdict')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, upper(trim(initials, ' ')) ORDER BY judged_at DESC, adj_id DESC) = 1)"


def adjudicated(spark: SparkSession, d: str) -> DataFrame:
    """The view that each adjudicator holds of each claim: (claim_id, who, human, judged_at)."""
    rows = table(spark, d, "adjudications").select(F.col("id").alias("claim_id"), F.upper(F.btrim("initials")).alias("who"), T.clean_verdict("verdict").alias("human"), "judged_at", "adj_id")
    return C.last_wins(rows.where("claim_id is not null and who is not null and human is not null"), ["claim_id", "who"], ["judged_at", "adj_id"]).drop("adj_id")


@query(f"WITH {POOL_}, {ADJ_} SELECT who, count(*) AS n, count(*) FILTER (human = T.verdict) AS agreed FROM A JOIN T USING (claim_id) GROUP BY who")
def human_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often each adjudicator agrees with the pooled verdict."""
    both = adjudicated(spark, d).join(_merged(spark, d).select("claim_id", "verdict"), "claim_id")
    return both.groupBy("who").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("human") == F.col("verdict")).alias("agreed"))


@query(f"WITH {POOL_}, {ADJ_}, g AS (SELECT claim_id, count(*) AS n_views, count(DISTINCT human) AS n_different FROM A GROUP BY claim_id) SELECT claim_id, T.verdict, coalesce(n_views, 0) AS n_views, coalesce(n_different, 0) AS n_different FROM T LEFT JOIN g USING (claim_id)")
def adjudication_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Every claim with the number of views that people hold of it."""
    g = adjudicated(spark, d).groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_views"), F.count_distinct("human").alias("n_different"))
    z = F.lit(0).cast("long")
    return _merged(spark, d).select("claim_id", "verdict").join(g, "claim_id", "left").select("claim_id", "verdict", F.coalesce("n_views", z).alias("n_views"), F.coalesce("n_different", z).alias("n_different"))


@query(f"WITH {R_}, {ADJ_}, c AS (SELECT claim_id, written_at, max(record_id) AS record_id FROM R WHERE claim_id IS NOT NULL GROUP BY ALL) SELECT A.claim_id, A.who, coalesce(c.record_id, 0) AS record_id FROM A ASOF LEFT JOIN c ON A.claim_id = c.claim_id AND A.judged_at >= c.written_at")
def record_seen(spark: SparkSession, d: str) -> DataFrame:
    """The last record of a claim that an adjudicator can have seen."""
    right = records(spark, d).where("claim_id is not null").groupBy("claim_id", F.col("written_at").alias("at")).agg(F.max("record_id").alias("record_id"))
    left = adjudicated(spark, d).select("claim_id", F.col("judged_at").alias("at"), "who")
    return C.as_of(left, right, "claim_id", "at", "record_id").select("claim_id", "who", F.coalesce("record_id", F.lit(0).cast("long")).alias("record_id"))


LEAF = f"CASE WHEN lower(trim(coalesce(route, ''))) = 'evaluative' OR regexp_matches(id, '^[Rr][0-9]') THEN 'opinion' WHEN coalesce(stability, '') = 'contested' THEN 'open' WHEN v IN ('faithful') THEN 'holds' WHEN v IN ('partial', 'overstated') THEN 'weakened' WHEN v IN ('absent', 'contradicted', 'unsupported') THEN 'fails' ELSE 'open' END"
TREE_ = f"""{B_}, LV AS (SELECT *, {CLEAN.format('faith')} AS v FROM B WHERE id IS NOT NULL AND path IS NOT NULL), LJ AS (SELECT id, split_part(id, ':', 1) AS series, regexp_extract(path, '^(c[0-9]+)', 1) AS ch, coalesce(gap, '') = 'scope' AS q, {LEAF} AS j, TRY_CAST(regexp_extract(id, '[^0-9]*([0-9]+)$', 1) AS BIGINT) AS ord FROM LV),
L1 AS (SELECT series || '/' || ch AS node, series, max(CASE WHEN q THEN 2 WHEN j = 'opinion' THEN NULL ELSE list_position(['holds','weakened','open','fails'], j) - 1 END) AS top FROM LJ GROUP BY ALL), L2 AS (SELECT series AS node, max(top) AS top FROM L1 GROUP BY ALL),
NJ AS (SELECT node, top FROM L1 UNION ALL SELECT node, top FROM L2)"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """A tree of the brief: series, chapters, claims; a gap of scope makes a claim's edge a query."""
    rows = brief(spark, d).where("id is not null and path is not null")
    series, chapter = F.split_part("id", F.lit(":"), F.lit(1)), F.regexp_extract("path", "^(c[0-9]+)", 1)
    leaf = rows.select(F.col("id").alias("node"), F.concat_ws("/", series, chapter).alias("parent"), T.id_number(F.split_part("id", F.lit(":"), F.lit(-1))).alias("ord"), F.lit(2).alias("depth"), (F.coalesce("gap", F.lit("")) == "scope").alias("query"), E.leaf_judgement("route", "id", "stability", T.clean_verdict("faith")).alias("own"))
    mid = leaf.select(F.col("parent").alias("node")).distinct().select("node", F.split_part("node", F.lit("/"), F.lit(1)).alias("parent"), T.id_number(F.split_part("node", F.lit("/"), F.lit(2))).alias("ord"), F.lit(1).alias("depth"), F.lit(False).alias("query"), F.lit(None).cast("string").alias("own"))
    top = mid.select(F.col("parent").alias("node")).distinct().select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("ord"), F.lit(0).alias("depth"), F.lit(False).alias("query"), F.lit(None).cast("string").alias("own"))
    return leaf.unionByName(mid).unionByName(top).withColumn("edge_open", F.lit(False))


@query(f"WITH {TREE_} SELECT node, coalesce(['holds','weakened','open','fails'][top + 1], 'opinion') AS judgement FROM NJ")
def judgements(spark: SparkSession, d: str) -> DataFrame:
    """The judgement of every inner node of the brief's tree."""
    nodes = _nodes(spark, d)
    return E.rolled_up(nodes).join(nodes.where("depth < 2").select("node"), "node", "left_semi").select("node", "judgement")


@query(f"WITH {TREE_} SELECT L1.node, CASE WHEN coalesce(L1.top, 0) = 0 THEN '' ELSE coalesce((SELECT arg_min(LJ.id || CASE WHEN LJ.q THEN '?' ELSE '' END, (LJ.ord, LJ.id)) FROM LJ WHERE LJ.series || '/' || LJ.ch = L1.node AND (CASE WHEN LJ.q THEN 2 WHEN LJ.j = 'opinion' THEN NULL ELSE list_position(['holds','weakened','open','fails'], LJ.j) - 1 END) = L1.top), '') END AS deciding FROM L1")
def deciding_children(spark: SparkSession, d: str) -> DataFrame:
    """The claim that decides each chapter."""
    nodes = _nodes(spark, d)
    return E.rolled_up(nodes).join(nodes.where("depth = 1").select("node"), "node", "left_semi").select("node", "deciding")


SEC_ = f"{B_}, PP AS (SELECT id, list_filter(string_split(path, '/'), lambda p: p <> '') AS parts FROM B WHERE path IS NOT NULL), PX AS (SELECT id, parts, unnest(range(1, len(parts) + 1)) AS i FROM PP WHERE len(parts) > 0), PR AS (SELECT id, i AS depth, array_to_string(list_transform(parts[1:i], lambda p: regexp_replace(p, '=.*$', '')), '/') AS node, coalesce(array_to_string(list_transform(parts[1:i-1], lambda p: regexp_replace(p, '=.*$', '')), '/'), '') AS parent, CASE WHEN contains(parts[i], '=') THEN regexp_replace(parts[i], '^[^=]*=', '') ELSE '' END AS label FROM PX)"
ST_ = SEC_ + ", ST AS (SELECT node, parent, depth::INTEGER AS depth, coalesce(arg_min(label, id) FILTER (label <> ''), '') AS label, count(DISTINCT id) AS n_leaves FROM PR GROUP BY node, parent, depth)"


@query(f"WITH {ST_} SELECT * FROM ST")
def section_tree(spark: SparkSession, d: str) -> DataFrame:
    """The sections of the brief."""
    return E.section_tree(brief(spark, d), "id", "path")


@query(f"WITH {ST_}, w AS (SELECT parent, count(*) AS w FROM ST GROUP BY parent) SELECT (SELECT max(depth) FROM ST) AS max_depth, max(w) AS max_width, round(avg(w), 6) AS mean_fan_out FROM w")
def tree_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Depth, width and fan-out of the sections."""
    return E.tree_metrics(E.section_tree(brief(spark, d), "id", "path"))


@query(f"WITH {SEC_} SELECT DISTINCT node, depth::INTEGER AS depth FROM PR WHERE id IN (SELECT id FROM B WHERE stability = 'contested')")
def opened_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections with a contested claim below them."""
    return E.opened(brief(spark, d).where("stability = 'contested'"), "id", "path")


@query(f"WITH {B_}, x AS (SELECT id, {CLEAN.format('faith')} AS f, nullif(grounding, '') AS g, nullif(substance, '') AS s, route, spread, dissent FROM B) SELECT id, CASE WHEN lower(trim(coalesce(route, ''))) = 'evaluative' OR regexp_matches(id, '^[Rr][0-9]') THEN 'opinion' ELSE coalesce(f, g, s, '') || CASE WHEN coalesce(spread, '') <> '' THEN ' ' || spread ELSE '' END || CASE WHEN coalesce(dissent, '') <> '' THEN ' ≠ ' || dissent ELSE '' END END AS leaf FROM x")
def leaf_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """How each claim is shown: verdict, spread and dissent."""
    v = F.coalesce(T.clean_verdict("faith"), F.nullif("grounding", F.lit("")), F.nullif("substance", F.lit("")), F.lit(""))
    extra = lambda c, mark: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(mark), F.col(c))).otherwise("")
    return brief(spark, d).select("id", F.when(T.is_opinion("route", "id"), "opinion").otherwise(F.concat(v, extra("spread", " "), extra("dissent", " ≠ "))).alias("leaf"))


@query(f"WITH {B_}, x AS (SELECT id, {CLEAN.format('faith')} AS cls, coalesce(TRY_CAST(regexp_extract(spread, '^([0-9]+)/([0-9]+)$', 1) AS DOUBLE) / nullif(TRY_CAST(regexp_extract(spread, '^([0-9]+)/([0-9]+)$', 2) AS DOUBLE), 0), 0) AS ratio, coalesce(TRY_CAST(regexp_extract(split_part(id, ':', 2), '^[^0-9]*([0-9]+)', 1) AS BIGINT), -1) AS num FROM B) SELECT cls, id, round(ratio, 6) AS ratio, row_number() OVER (PARTITION BY cls ORDER BY round(ratio, 6) DESC, num, id) AS rk FROM x WHERE cls IS NOT NULL QUALIFY rk <= 3")
def top3_per_class(spark: SparkSession, d: str) -> DataFrame:
    """The three claims of each verdict with the greatest share of samples, ids in numeric order."""
    rows = brief(spark, d).select("id", T.clean_verdict("faith").alias("cls"), F.round(T.spread_ratio("spread"), 6).alias("ratio"), T.id_number(F.split_part("id", F.lit(":"), F.lit(2))).alias("num")).where("cls is not null")
    return rows.withColumn("rk", F.row_number().over(W.partitionBy("cls").orderBy(F.desc("ratio"), "num", "id"))).where("rk <= 3").select("cls", "id", "ratio", "rk")


@query(f"WITH {B_}, x AS (SELECT id, text, list_transform(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+')[2:], lambda w: regexp_replace(regexp_replace(w, '^[^A-Za-z]+', ''), '[^A-Za-z]+$', '')) AS ws FROM B WHERE text IS NOT NULL) SELECT id, regexp_matches(text, '[0-9]') OR len(list_filter(ws, lambda w: regexp_matches(w, '^[A-Z].*[a-z]'))) > 0 AS concrete FROM x")
def number_or_place(spark: SparkSession, d: str) -> DataFrame:
    """Whether a claim names a number or a place."""
    return brief(spark, d).where("text is not null").select("id", T.has_number_or_place("text").alias("concrete"))


@query(f"WITH {P_}, h AS (SELECT id, split_part(id, '#', 1) AS base, TRY_CAST(regexp_extract(id, '#t([0-9]+)$', 1) AS BIGINT) AS t, lower(role_text) AS role FROM P WHERE source_kind = 'hearing') SELECT id, CASE WHEN role = 'witness' AND lag(role) OVER w IN ('questioner', 'chair') THEN lag(id) OVER w END AS context_id FROM h WINDOW w AS (PARTITION BY base ORDER BY t)")
def context_attached(spark: SparkSession, d: str) -> DataFrame:
    """The question that each witness's fragment answers."""
    h = passages(spark, d).where("source_kind = 'hearing'").select("id", T.passage_base("id").alias("doc"), F.regexp_extract("id", "#t([0-9]+)$", 1).try_cast("long").alias("no"), F.lower("role_text").alias("role"), F.lit(None).cast("string").alias("speaker"), F.col("id").alias("speech"))
    return S.with_context(h).select("id", F.col("context_speech").alias("context_id"))


@query(f"WITH {P_}, s AS (SELECT speaker, role_text, passage_no FROM P WHERE speaker IS NOT NULL) SELECT speaker, arg_min(coalesce(role_text, ''), passage_no) AS role, count(*) AS turns FROM s GROUP BY speaker")
def speakers(spark: SparkSession, d: str) -> DataFrame:
    """Every speaker with a first role and a number of turns."""
    return S.speakers(passages(spark, d).select("speaker", F.coalesce("role_text", F.lit("")).alias("role"), F.col("passage_no").alias("ord")))


@query(f"WITH {P_} SELECT source_kind, count(DISTINCT split_part(id, '#', 1)) AS n_docs, count(*) AS n_passages FROM P GROUP BY source_kind")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents and passages of each kind."""
    return S.source_counts(passages(spark, d))


@query(f"""WITH {P_}, b AS (SELECT id, split_part(id, '#', 1) AS base, CASE WHEN contains(id, '#') THEN substr(id, strpos(id, '#') + 1) ELSE '' END AS frag FROM P),
c AS (SELECT *, CASE WHEN base = '' OR frag = '' THEN NULL
 WHEN base LIKE 'submission-%' THEN CASE WHEN regexp_full_match(base, 'submission-[0-9]+\\.?') THEN 'submission:' || regexp_extract(base, '([0-9]+)', 1)::BIGINT WHEN regexp_full_match(base, 'submission-[0-9]+\\.[0-9]+') THEN 'submission:' || regexp_extract(base, '-([0-9]+)', 1)::BIGINT || '/attachment-' || regexp_extract(base, '\\.([0-9]+)', 1)::BIGINT END
 WHEN base LIKE 'qon-%' THEN CASE WHEN regexp_matches(base, '^qon-.+-[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'qon:' || substr(base, 5, length(base) - 15) || '/' || right(base, 10) END
 WHEN base LIKE 'leaderboards/%' THEN base || '.txt' WHEN contains(frag, '#') THEN base || '.pdf' WHEN contains(base, '/') AND frag LIKE 't%' THEN 'hearing:' || base END AS doc FROM b)
SELECT coalesce(doc, '') AS doc, count(*) AS n, count(DISTINCT CASE WHEN doc LIKE 'hearing:%' THEN 'line ' || substr(frag, 2) WHEN doc IS NOT NULL THEN 'p.' || regexp_replace(split_part(frag, '#', 1), '^p', '') ELSE '' END) AS n_places FROM c GROUP BY ALL""")
def canonical_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents by their canonical ids, with their passages and places."""
    x = passages(spark, d).select(T.canonical("id").alias("c"))
    return x.groupBy("c.doc").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c.locator").alias("n_places"))


@query("WITH x AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS body, unnest(range(len(string_split(text, chr(12))))) + 1 AS page FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, page, list_filter(list_transform(string_split_regex(body, '\\n\\s*\\n'), lambda p: regexp_replace(regexp_replace(p, '^[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ''), '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '')), lambda p: length(p) >= 40) AS kept FROM x) SELECT doc_id, page::INTEGER AS page, (unnest(range(len(kept))))::INTEGER AS no, unnest(kept) AS paragraph FROM y")
def document_pages(spark: SparkSession, d: str) -> DataFrame:
    """The paragraphs of every page of every document."""
    return S.pages(table(spark, d, "documents").where("text is not null"), "doc_id")


@query("WITH x AS (SELECT doc_id, string_split_regex(replace(text, chr(12), chr(10) || chr(10)), '\\n\\s*\\n') AS parts FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: regexp_replace(regexp_replace(p, '^[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ''), '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '')), lambda p: length(p) >= 40) AS kept FROM x) SELECT doc_id, (unnest(range(len(kept))))::INTEGER AS no, unnest(kept) AS paragraph FROM y")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The paragraphs of every document."""
    return S.paragraphs(table(spark, d, "documents").where("text is not null"), "doc_id")


@query()
def merged_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Every document in passages no shorter than the floor."""
    return S.merged_fragments(table(spark, d, "documents").where("text is not null"), "doc_id")


_LABEL = "^ {0,8}(The CHAIR|[A-Z][A-Za-z.''’-]*(?: [A-Z][A-Za-z.''’-]*)*[A-Z]{2}[A-Za-z.''’-]*):\\s"


@query(f"""WITH l AS (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS pos FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS p FROM documents WHERE source = 'hansard' AND text IS NOT NULL)),
o AS (SELECT *, regexp_matches(line, '{_LABEL}') AS opens FROM l), t AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS turn FROM o),
g AS (SELECT doc_id, turn, max(CASE WHEN opens THEN regexp_extract(line, '{_LABEL}', 1) END) AS speaker, string_agg(CASE WHEN opens THEN regexp_replace(line, '{_LABEL}', '') ELSE line END, chr(10) ORDER BY pos) AS said FROM t WHERE turn > 0 GROUP BY ALL),
s AS (SELECT doc_id, turn, speaker, regexp_replace(regexp_replace(said, '^[\\s\\x{{0b}}\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+', ''), '[\\s\\x{{0b}}\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+$', '') AS speech FROM g)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY turn) - 1)::INTEGER AS no, speaker, speech FROM s WHERE speech <> ''""")
def document_turns(spark: SparkSession, d: str) -> DataFrame:
    """The speaker turns of every transcript among the documents."""
    return S.speaker_turns(table(spark, d, "documents").where("source = 'hansard' and text is not null"), "doc_id")


@query(f"WITH {P_} SELECT id, CASE WHEN regexp_matches(date_text, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_strptime(date_text, '%Y-%m-%d')::DATE WHEN regexp_matches(date_text, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') THEN try_strptime(date_text, '%d/%m/%Y')::DATE WHEN regexp_matches(date_text, '^\\d{{8}}$') THEN try_strptime(date_text, '%Y%m%d')::DATE WHEN regexp_matches(date_text, '^\\d{{1,2}} [A-Za-z]+ \\d{{4}}$') THEN coalesce(try_strptime(date_text, '%d %B %Y'), try_strptime(date_text, '%d %b %Y'))::DATE END::VARCHAR AS held FROM (SELECT id, trim(date_text, ' ') AS date_text FROM P)")
def passage_dates(spark: SparkSession, d: str) -> DataFrame:
    """The date of every passage, however it was written."""
    return passages(spark, d).select("id", T.iso_date("date_text").cast("string").alias("held"))


@query()
def verbatim_runs(spark: SparkSession, d: str) -> DataFrame:
    """The first run of three words of what a report says that stands in its claim."""
    r = records(spark, d).where("claim is not null")
    return r.select("record_id", T.verbatim_run(F.coalesce("detail.report_says", F.lit("")), F.array("claim"), 3).alias("run"))


@query()
def plain_words(spark: SparkSession, d: str) -> DataFrame:
    """The first hard word and the first contrasting word of what a source says."""
    r = records(spark, d).select("record_id", F.coalesce("detail.source_says", F.lit("")).alias("said"), F.coalesce("claim", F.lit("")).alias("claim"))
    return r.select("record_id", T.plain_bad_word("said", T.run_tokens("claim", digits=False)).alias("hard"), T.contrast_word("said").alias("contrast"))


@query("WITH x AS (SELECT raw::JSON AS j FROM calibration_lines WHERE json_valid(raw)) SELECT j->>'$.fixture' AS fixture, count(*) AS n_runs, sum((j->>'$.false_pass')::BIGINT)::BIGINT AS false_pass, sum(list_sum((j->'$.claims_per_run')::BIGINT[]))::BIGINT AS n_valid, round(sum((j->>'$.false_pass')::BIGINT) * 1.0 / sum(list_sum((j->'$.claims_per_run')::BIGINT[])), 6) AS rate FROM x WHERE json_exists(j, '$.false_pass') GROUP BY ALL")
def false_pass_rates(spark: SparkSession, d: str) -> DataFrame:
    """False passes over valid claims for each fixture of the calibration log."""
    j = F.from_json("raw", "fixture string, false_pass long, claims_per_run array<long>")
    rows = table(spark, d, "calibration_lines").select(j.alias("j")).select("j.fixture", "j.false_pass", F.aggregate("j.claims_per_run", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).where("false_pass is not null")
    return rows.groupBy("fixture").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("false_pass").alias("false_pass"), F.sum("n").alias("n_valid"), F.round(F.sum("false_pass") / F.sum("n"), 6).alias("rate"))


@query(f"WITH x AS (SELECT route_no, {NORM.format('finding')} AS f, {NORM.format('regex_phrase')} AS anchor FROM routes_input), g AS (SELECT anchor, count(*) AS n, min(route_no) AS first FROM x WHERE anchor <> '' GROUP BY anchor HAVING count(*) > 1) SELECT x.route_no, coalesce(g.n, 1) AS n_alike, coalesce(g.first, x.route_no) AS stands_for FROM x LEFT JOIN g USING (anchor)")
def lifted_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Rows with one anchor, normalised, stand under the first of them; rows without an anchor stand alone."""
    x = table(spark, d, "routes_input").select("route_no", T.norm_quote("regex_phrase").alias("anchor"))
    g = x.where("anchor <> ''").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("route_no").alias("first")).where("n > 1")
    return x.join(g, "anchor", "left").select("route_no", F.coalesce("n", F.lit(1).cast("long")).alias("n_alike"), F.coalesce("first", "route_no").alias("stands_for"))


@query(f"WITH {R_}, x AS (SELECT DISTINCT claim_id, record_id, unnest(passages) AS pid FROM R WHERE claim_id IS NOT NULL), n AS (SELECT record_id, count(*) AS n FROM x WHERE pid IS NOT NULL GROUP BY ALL), s AS (SELECT a.claim_id, a.record_id AS record_a, b.record_id AS record_b, count(*) AS shared FROM x a JOIN x b ON a.claim_id = b.claim_id AND a.pid = b.pid AND a.record_id < b.record_id GROUP BY ALL) SELECT s.claim_id, record_a, record_b, shared FROM s JOIN n na ON na.record_id = record_a JOIN n nb ON nb.record_id = record_b WHERE 2 * shared >= least(na.n, nb.n)")
def shared_at_least_half(spark: SparkSession, d: str) -> DataFrame:
    """Records of one claim that share at least half of the smaller set of passages."""
    rows = records(spark, d).where("claim_id is not null").select(F.col("claim_id").alias("chain"), F.col("record_id").alias("idx"), F.explode("passages").alias("pid"))
    return O.overlaps(rows).select(F.col("chain").alias("claim_id"), F.col("idx_a").alias("record_a"), F.col("idx_b").alias("record_b"), "shared")


@query(f"WITH x AS (SELECT route_no, section, finding, regex_phrase, {NORM.format('regex_phrase')} AS anchor FROM routes_input), g AS (SELECT anchor AS k, arg_min(regex_phrase, route_no) AS anchor, arg_min(coalesce(section, ''), route_no) AS world, arg_min(coalesce(finding, ''), route_no) AS settles, count(*) AS n FROM x WHERE anchor <> '' GROUP BY x.anchor HAVING count(*) > 1) SELECT anchor, world, settles, n FROM g")
def method_notes(spark: SparkSession, d: str) -> DataFrame:
    """Open edges of one anchor lifted to one note, with what the first of them says."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    edges = table(spark, d, "routes_input").select(F.col("route_no").alias("edge"), F.col("route_no").alias("ord"), F.lit("open").alias("verdict"), F.col("regex_phrase").alias("anchor"), blank("section").alias("world"), blank("finding").alias("settles"))
    return D.lifted(edges)[1]


@query()
def claim_groups(spark: SparkSession, d: str) -> DataFrame:
    """The claims of each chain grouped by the passages that they share."""
    return O.grouped(records(spark, d).select("chain", F.col("idx").cast("int").alias("idx"), F.explode_outer("passages").alias("pid")))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Claims to passages, ranked and budgeted; quotes checked; verdicts grounded and tallied by chain."""
    g = grounded_verdicts(spark, d).join(records(spark, d).select("record_id", "chain"), "record_id")
    b = budget_prefix(spark, d).join(records(spark, d).select(F.col("record_id").alias("qid"), "chain"), "qid").groupBy("chain").agg(F.count(F.lit(1)).alias("n_retrieved"))
    t = g.groupBy("chain", "grounded").agg(F.count(F.lit(1)).alias("n"), F.sum("n_ok").alias("n_quotes_ok"))
    return t.join(b, "chain", "left")
