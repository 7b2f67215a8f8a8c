"""Further queries of the claim-checking operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veriloom.functions import text as T
from veriloom.functions import verdicts as V
from veriloom.operators import grounding as G
from veriloom.operators import parsing as X
from veriloom.operators import retrieval as R
from veriloom.operators import trees as E
from veriloom.operators.chains import compared, samples_of
from veriloom.plans.claims import B_, BM25_, CHECK_, CLEAN, L_, LEAF, NORM, P_, R_, SIDE, TOK, bodies, brief, claim_queries, held_records, passages, query, quotes, records
from veriloom.sources.tables import table


@query(f"WITH {P_}, w AS (SELECT id, trim(unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}'']+')), '''') AS word FROM P) SELECT word, count(DISTINCT id) AS n_passages, count(*) AS n FROM w WHERE word <> '' GROUP BY word")
def word_stats(spark: SparkSession, d: str) -> DataFrame:
    """B2: words of letters and digits of every script over all passages."""
    words = passages(spark, d).select("id", F.explode(T.run_tokens("text")).alias("word")).groupBy("word", "id").agg(F.count(F.lit(1)).alias("k"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n_passages"), F.sum("k").alias("n"))


@query(f"WITH {R_} SELECT record_id, len(list_filter(regexp_extract_all(lower(claim), '[a-z0-9$%]+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'our', 'that')))::INTEGER AS n_words FROM R WHERE claim IS NOT NULL")
def content_words(spark: SparkSession, d: str) -> DataFrame:
    """How many content words each claim has."""
    return records(spark, d).where("claim is not null").select("record_id", F.size(T.content_words("claim", ("the", "and", "our", "that"))).alias("n_words"))


@query(f"WITH {R_} SELECT record_id, CASE WHEN length(claim) > 60 THEN substr(claim, 1, 59) || '…' ELSE claim END AS label, CASE WHEN len(string_split_regex(claim, '\\s+')) > 8 THEN array_to_string(string_split_regex(claim, '\\s+')[1:8], ' ') || '…' ELSE array_to_string(string_split_regex(claim, '\\s+'), ' ') END AS words FROM R WHERE claim IS NOT NULL")
def claim_labels(spark: SparkSession, d: str) -> DataFrame:
    """Each claim cut to 60 characters, and to eight words."""
    return records(spark, d).where("claim is not null").select("record_id", T.truncate_chars("claim", 60).alias("label"), T.truncate_words("claim", 8).alias("words"))


@query(f"WITH {R_}, s AS (SELECT chain, unnest(CASE WHEN len(coalesce(samples, [])) > 0 THEN samples ELSE [verdict] END) AS v FROM R) SELECT chain, {SIDE.format('v')} AS side, count(*) AS n FROM s WHERE v IS NOT NULL GROUP BY ALL")
def sample_sides(spark: SparkSession, d: str) -> DataFrame:
    """Samples of each chain by the side that they stand on."""
    r = records(spark, d)
    return r.select("chain", F.explode(samples_of(r)).alias("v")).where("v is not null").groupBy("chain", T.verdict_side("v").alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {B_} SELECT id, coalesce(trim(faith_reason, ' ') = '' OR regexp_matches(faith_reason, '</?[A-Za-z][^>]*>'), true) AS failed, lower(trim(coalesce(route, ''), ' ')) = 'evaluative' OR regexp_matches(id, '^[Rr][0-9]') AS opinion FROM B")
def schema_gate(spark: SparkSession, d: str) -> DataFrame:
    """Claims whose reason fails, and opinions, which are let pass."""
    return brief(spark, d).select("id", T.schema_failed("faith_reason").alias("failed"), T.is_opinion("route", "id").alias("opinion"))


@query(f"WITH {P_}, x AS (SELECT split_part(id, '#', 1) AS doc, TRY_CAST(regexp_extract(id, '^[^#]+#p([0-9]+)#[0-9]+$', 1) AS INTEGER) AS page FROM P) SELECT doc, count(DISTINCT page) AS n_pages, min(page) AS first, max(page) AS last, count(*) AS n FROM x WHERE page IS NOT NULL GROUP BY doc")
def excerpt_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages that each report's passages come from."""
    x = passages(spark, d).select(T.passage_base("id").alias("doc"), T.excerpt_page("id").alias("page")).where("page is not null")
    return x.groupBy("doc").agg(F.count_distinct("page").alias("n_pages"), F.min("page").alias("first"), F.max("page").alias("last"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {B_} SELECT id, trim(concat_ws(' ', text, array_to_string(list_transform(list_filter(string_split(path, '/'), lambda p: p <> ''), lambda p: CASE WHEN contains(p, '=') THEN regexp_replace(p, '^[^=]*=', '') ELSE p END), ' ')), ' ') AS asked FROM B WHERE text IS NOT NULL AND path IS NOT NULL")
def claim_searches(spark: SparkSession, d: str) -> DataFrame:
    """What each claim of the brief is searched with."""
    return brief(spark, d).where("text is not null and path is not null").select("id", T.claim_query("text", "path").alias("asked"))


@query(f"WITH {B_}, x AS (SELECT id, split_part(id, ':', 1) AS series, split_part(id, ':', 2) AS own FROM B WHERE id IS NOT NULL) SELECT id, row_number() OVER (PARTITION BY series ORDER BY coalesce(TRY_CAST(regexp_extract(own, '^[^0-9]*([0-9]+)', 1) AS BIGINT), -1), CASE WHEN regexp_matches(own, '[0-9]') THEN regexp_extract(own, '^[^0-9]*[0-9]+(.*)$', 1) ELSE own END, id) AS place FROM x")
def claim_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of each claim in its series, ids in numeric order."""
    own = F.split_part("id", F.lit(":"), F.lit(2))
    by = W.partitionBy("series").orderBy(T.id_number(own), T.id_suffix(own), "id")
    rows = brief(spark, d).where("id is not null").withColumn("series", F.split_part("id", F.lit(":"), F.lit(1)))
    return rows.select("id", F.row_number().over(by).alias("place"))


@query(f"WITH {B_}, x AS (SELECT split_part(id, ':', 1) AS series, CASE WHEN coalesce(gap, '') = 'scope' THEN 'open' ELSE {LEAF} END AS j FROM (SELECT *, {CLEAN.format('faith')} AS v FROM B WHERE id IS NOT NULL)) SELECT series, count(*) AS n, count(*) FILTER (j = 'holds') AS holds, count(*) FILTER (j = 'weakened') AS weakened, count(*) FILTER (j = 'open') AS open, count(*) FILTER (j = 'fails') AS fails, count(*) FILTER (j = 'opinion') AS opinion FROM x GROUP BY series")
def root_tally(spark: SparkSession, d: str) -> DataFrame:
    """The claims of each series by judgement."""
    j = F.when(F.coalesce("gap", F.lit("")) == "scope", "open").otherwise(E.leaf_judgement("route", "id", "stability", T.clean_verdict("faith")))
    rows = brief(spark, d).where("id is not null").select(F.split_part("id", F.lit(":"), F.lit(1)).alias("series"), j.alias("j"))
    return rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("j") == x).alias(x) for x in ("holds", "weakened", "open", "fails", "opinion")))


@query(f"WITH {BM25_}, c AS (SELECT DISTINCT record_id AS qid, unnest(passages) AS pid FROM R WHERE record_id % 50 = 0) SELECT qid, pid, rk FROM rk SEMI JOIN c USING (qid, pid)")
def cited_ranks(spark: SparkSession, d: str) -> DataFrame:
    """where the passages that a record names stand in the full ranking of its claim."""
    cites = records(spark, d).where("record_id % 50 = 0").select(F.col("record_id").alias("qid"), F.explode("passages").alias("pid")).distinct()
    return R.ranks_of(cites, claim_queries(spark, d), bodies(passages(spark, d)))


@query(f"WITH {CHECK_} SELECT chain, count(*) AS n_quotes, count(*) FILTER (NOT ok) AS n_rejected, round(count(*) FILTER (NOT ok) * 1.0 / count(*), 6) AS share FROM CK JOIN R ON R.record_id = CK.key GROUP BY chain")
def rejected_quotes(spark: SparkSession, d: str) -> DataFrame:
    """How many quotes of each chain are not verbatim."""
    r = records(spark, d)
    checks = G.checked(quotes(r), passages(spark, d).select(F.col("id").alias("pid"), "context", "text")).join(r.select(F.col("record_id").alias("key"), "chain"), "key")
    return checks.groupBy("chain").agg(F.count(F.lit(1)).alias("n_quotes"), F.count_if(~F.col("ok")).alias("n_rejected"), F.round(F.count_if(~F.col("ok")) / F.count(F.lit(1)), 6).alias("share"))


@query(f"WITH {L_}, {B_} SELECT chain, count(*) AS n, count(*) FILTER (trim(L.claim, ' ') = trim(B.text, ' ')) AS n_same FROM L JOIN B ON L.claim_id = B.id GROUP BY chain")
def claim_texts_agree(spark: SparkSession, d: str) -> DataFrame:
    """Whether records and the brief mean the same claims."""
    both = held_records(spark, d).join(brief(spark, d).select(F.col("id").alias("claim_id"), "text"), "claim_id")
    return both.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.btrim("claim") == F.btrim("text")).alias("n_same"))


@query(f"WITH {P_}, {R_}, lb AS (SELECT split_part(id, '#', 1) AS doc, arg_min(speaker, passage_no) AS label FROM P WHERE source_kind IN ('submission', 'qon') AND coalesce(speaker, '') <> '' GROUP BY doc), x AS (SELECT record_id, unnest(range(len(detail.quote_passages))) AS pos, split_part(unnest(detail.quote_passages), '#', 1) AS doc FROM R) SELECT record_id, pos, coalesce(label, '') AS label FROM x LEFT JOIN lb USING (doc) WHERE doc <> ''")
def quote_labels(spark: SparkSession, d: str) -> DataFrame:
    """Whom each cited passage comes from; "" where nobody is named."""
    labels = passages(spark, d).where("source_kind in ('submission', 'qon') and coalesce(speaker, '') <> ''").groupBy(T.passage_base("id").alias("doc")).agg(F.min_by("speaker", "passage_no").alias("label"))
    x = records(spark, d).select("record_id", F.posexplode("detail.quote_passages").alias("pos", "pid")).select("record_id", "pos", T.passage_base("pid").alias("doc")).where("doc <> ''")
    return x.join(labels, "doc", "left").select("record_id", "pos", F.coalesce("label", F.lit("")).alias("label"))


_STOP = "'the','a','an','of','to','in','and','or','for','with','is','are','was','were','be','been','that','this','these','those','on','at','by','from','as','it','its','their','they','them','our','we','us','have','has','had','can','could','may','might','not','do','does','no','more','most','all','any','into','over','per','such','other','which','who','whom'"


@query(f"""WITH x AS (SELECT route_no, paragraph AS p, list_filter(regexp_extract_all(lower(paragraph), '[a-z0-9$%]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})) AS w, list_filter(regexp_split_to_array(paragraph, '\\s+'), lambda w: w <> '') AS t FROM routes_input WHERE paragraph IS NOT NULL)
SELECT route_no, len(w) >= 6 AND (regexp_matches(p, '(?i)the committee|told|stated|said|submission|emphasi[sz]ed|noted|explained|highlighted|argued|according to|witness|submitted') OR regexp_matches(p, '(?:\\b[a-z][a-z]+\\b[ ,]+){{5,}}')) AND NOT regexp_matches(p, '[A-Z]{{3,}}:|\\b[A-Z][a-z]+ [A-Z]{{3,}}\\b') AND 2 * len(list_filter(t, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) <= len(t) AS prose FROM x""")
def prose_findings(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that are prose."""
    return table(spark, d, "routes_input").where("paragraph is not null").select("route_no", X.is_prose("paragraph").alias("prose"))


@query("""WITH h AS (SELECT route_no, regexp_matches(p, '(?i)the committee heard|told the committee|\\bwitnesses\\b|submitted that|evidence to the inquiry') AS a, regexp_matches(p, '(?i)the committee (believes|considers|calls (for|on))|notes with concern|is disappointed|it is disappointing|\\brecommends\\b|\\bshould\\b') AS b,
regexp_matches(n, '(?i)annual report|\\bdataset\\b|\\bdata\\b|australian bureau of statistics|\\babs\\b|\\bact\\s+\\d{4}|\\bcensus\\b|audience atlas|oztam|\\bvoz\\b|productivity commission|enterprise agreement|budget office|cultural funding by government|government cultural funding|artists as workers|\\bsurvey\\b|\\breport\\b|<https?://|accessed \\d{1,2}') AND NOT regexp_matches(n, '(?i)transcript of evidence|submission\\s+\\d+') AS c
FROM (SELECT route_no, paragraph AS p, coalesce(finding, '') AS n FROM routes_input WHERE paragraph IS NOT NULL))
SELECT route_no, CASE WHEN a::INTEGER + b::INTEGER + c::INTEGER > 1 THEN 'mixed' WHEN a THEN 'testimony' WHEN b THEN 'opinion' WHEN c THEN 'world' ELSE 'unclear' END AS kind FROM h""")
def finding_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What each paragraph rests on, its finding read as its note."""
    rows = table(spark, d, "routes_input").where("paragraph is not null")
    return rows.select("route_no", X.kinds_of("paragraph", F.array(F.coalesce("finding", F.lit("")))).alias("kind"))


@query(f"WITH {P_}, {B_}, x AS (SELECT id, {CLEAN.format('faith')} AS v, (SELECT count(DISTINCT source_kind) FROM P WHERE source_kind = 'report') = 1 AS single FROM B) SELECT id, CASE WHEN single AND v = 'absent' THEN 'uncorroborated' ELSE v END AS shown, CASE WHEN v = 'uncorroborated' THEN 'absent' ELSE v END AS kept FROM x WHERE id IS NOT NULL")
def single_source_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Each claim's verdict as shown where the reports are the only source, and as chains name it."""
    v = T.clean_verdict("faith")
    shown = T.single_source_verdict(v, F.lit(True))
    return brief(spark, d).where("id is not null").select("id", shown.alias("shown"), T.canonical_verdict(shown).alias("kept"))


@query(f"WITH {B_}, x AS (SELECT id, regexp_extract(text, '[Aa]ccording to ([A-Z][a-z]+(?: [A-Z][a-z]+){{1,2}})|([A-Z][a-z]+(?: [A-Z][a-z]+){{1,2}}) (?:of|said|told|argued|noted|stated)', ['a', 'b']) AS m FROM B WHERE text IS NOT NULL) SELECT id, split_part(m.a || m.b, ' ', -1) AS witness FROM x")
def named_witnesses(spark: SparkSession, d: str) -> DataFrame:
    """Whom each claim attributes itself to."""
    return brief(spark, d).where("text is not null").select("id", V.named_witness("text").alias("witness"))


@query(f"WITH {P_} SELECT 'passages' AS corpus, source_kind AS source, count(*) AS n, sum(len({TOK.format('text')}))::BIGINT AS n_tokens FROM P WHERE text IS NOT NULL GROUP BY ALL UNION ALL SELECT 'documents', source, count(*), sum(len({TOK.format('text')}))::BIGINT FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def united_corpora(spark: SparkSession, d: str) -> DataFrame:
    """H1, A2: passages and documents as one corpus, by source."""
    p = passages(spark, d).select(F.lit("passages").alias("corpus"), F.col("source_kind").alias("source"), "text")
    both = p.unionByName(table(spark, d, "documents").select(F.lit("documents").alias("corpus"), "source", "text")).where("text is not null")
    return both.groupBy("corpus", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(T.tokenize("text"))).alias("n_tokens"))


@query(f"WITH {R_}, x AS (SELECT claim_id, unnest(detail.quotes) AS q FROM R WHERE claim_id IS NOT NULL), y AS (SELECT claim_id, {NORM.format('q')} AS q FROM x WHERE q IS NOT NULL) SELECT claim_id, count(*) AS n_quotes, count(DISTINCT q) AS n_different, max(length(q)) AS longest FROM y WHERE q <> '' GROUP BY claim_id")
def quote_forms(spark: SparkSession, d: str) -> DataFrame:
    """The different quotes of each claim, normalised."""
    q = records(spark, d).where("claim_id is not null").select("claim_id", F.explode("detail.quotes").alias("q")).where("q is not null").select("claim_id", T.norm_quote("q").alias("q")).where("q <> ''")
    return q.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_quotes"), F.count_distinct("q").alias("n_different"), F.max(F.char_length("q")).cast("long").alias("longest"))


@query(f"WITH {B_}, s AS (SELECT id, stability, row_number() OVER (PARTITION BY stability ORDER BY coalesce(TRY_CAST(regexp_extract(split_part(id, ':', 2), '^[^0-9]*([0-9]+)', 1) AS BIGINT), -1), id) AS rk, count(*) OVER (PARTITION BY stability) AS n FROM B WHERE stability IS NOT NULL) SELECT id, stability, rk, n - 10 AS n_more FROM s WHERE rk <= 10")
def first_ten_per_class(spark: SparkSession, d: str) -> DataFrame:
    """The first ten claims of each class of stability, with how many more there are."""
    own = F.split_part("id", F.lit(":"), F.lit(2))
    rows = brief(spark, d).where("stability is not null").select("id", "stability", T.id_number(own).alias("num"))
    ranked = rows.withColumn("rk", F.row_number().over(W.partitionBy("stability").orderBy("num", "id")))
    n = rows.groupBy("stability").agg((F.count(F.lit(1)) - 10).alias("n_more"))
    return ranked.where("rk <= 10").join(n, "stability").select("id", "stability", "rk", "n_more")


@query(f"WITH {R_}, x AS (SELECT record_id, verdict, claim, nullif(trim(coalesce(detail.report_says, ''), ' '), '') AS r, nullif(trim(coalesce(detail.source_says, ''), ' '), '') AS s FROM R) SELECT record_id, coalesce(CASE WHEN verdict IN ('partial','overstated','contradicted') THEN 'The report says ' || r || '. The source only says ' || s || '.' WHEN verdict IN ('absent','unsupported') THEN 'The report says ' || r || '. No held source says this.' END, '') AS stakes, CASE WHEN verdict IN ('partial','overstated') THEN coalesce(s, claim) ELSE claim END AS intended FROM x")
def record_stakes(spark: SparkSession, d: str) -> DataFrame:
    """What is at stake in each record, and what it means to say."""
    return records(spark, d).select("record_id", V.stakes("verdict", "detail.report_says", "detail.source_says").alias("stakes"), V.intended("verdict", "claim", "detail.source_says").alias("intended"))


@query(f"WITH {B_}, x AS (SELECT CASE WHEN lower(trim(coalesce(route, ''), ' ')) = 'evaluative' OR regexp_matches(id, '^[Rr][0-9]') THEN 'opinion' WHEN coalesce(stability, '') = 'contested' THEN 'contested' WHEN coalesce(schema_fail, false) THEN 'schema-fail' WHEN {CLEAN.format('faith')} = 'faithful' THEN 'holds' WHEN {CLEAN.format('faith')} IN ('contradicted','overstated','unverifiable') THEN {CLEAN.format('faith')} WHEN {CLEAN.format('faith')} = 'partial' THEN 'generalised' ELSE 'unsupported' END AS cls FROM B WHERE id IS NOT NULL) SELECT cls, count(*) AS n FROM x GROUP BY cls")
def class_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Claims of the brief by the class that lists them."""
    rows = brief(spark, d).where("id is not null")
    return rows.groupBy(V.page_class("route", "id", "stability", "schema_fail", T.clean_verdict("faith")).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {L_}, v AS (SELECT claim_id, split_part(chain, '/', 2) AS cell, verdict FROM L WHERE claim_id IS NOT NULL) SELECT claim_id, max(verdict) FILTER (cell = 'run-1') AS \"run-1\", max(verdict) FILTER (cell = 'run-2') AS \"run-2\", max(verdict) FILTER (cell = 'run-3') AS \"run-3\" FROM v GROUP BY claim_id")
def runs_compared(spark: SparkSession, d: str) -> DataFrame:
    """Each claim's verdict in the first three runs side by side."""
    rows = held_records(spark, d).where("claim_id is not null").withColumn("cell", F.split_part("chain", F.lit("/"), F.lit(2)))
    return compared(rows, "claim_id", "cell", "verdict", ["run-1", "run-2", "run-3"])


@query(f"WITH {R_}, {B_} SELECT coalesce(nullif(trim(coalesce(R.route, ''), ' '), ''), B.route, '') AS route, count(*) AS n FROM R LEFT JOIN B ON B.id = R.claim_id GROUP BY ALL")
def record_routes(spark: SparkSession, d: str) -> DataFrame:
    """Records by route, from the brief where the record has none."""
    other = brief(spark, d).select(F.col("id").alias("claim_id"), F.col("route").alias("other"))
    return records(spark, d).join(other, "claim_id", "left").groupBy(F.coalesce(V.route_or("route", "other"), F.lit("")).alias("route")).agg(F.count(F.lit(1)).alias("n"))
