"""Queries of the general problems 3 and 7."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.operators import drift, nested
from veriloom.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each change of fields from one file of a series to the next."""
    return drift.schema_changes(table(spark, d, "chain_lines")).select("file_name", "change_kind", "field", "new_field").distinct()


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    """The same list with the series and the kinds before and after."""
    return drift.schema_changes(table(spark, d, "chain_lines"))


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    """All complete records in one table of typed columns, each field under one name, with what could not be cast."""
    lines = table(spark, d, "chain_lines")
    return drift.typed(drift.unified(lines, drift.schema_changes(lines)))


def _rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(nested.flat_rows(table(spark, d, n), n) for n in ("chain_lines", "calibration_lines"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Child rows of passages, quotes and counts with their parent's key and place."""
    chains, logs = _rows(spark, d)
    return nested.chain_children(chains).unionByName(nested.count_children(logs)).select("src", "line_id", "child", "num", "ref_id").distinct()


def p7_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every cell of every table that the records come to: group, place, key of a counted map, column, value."""
    chains, logs = _rows(spark, d)
    cells = chains.unionByName(logs).select("src", "line_id", "grp", F.array_join(F.col("place").cast("array<string>"), ".").alias("place"), "key", F.explode("fields").alias("column_name", "value"))
    return cells.distinct()


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    """The parent tables of p7_found, one row per complete record."""
    chains, logs = _rows(spark, d)
    fields = ("mode", "idx", "claim", "verdict", "backend", "route", "date", "model", "fixture", "runs")
    return nested.flat_records(chains, fields).unionByName(nested.flat_records(logs, fields))


def p7_quotes(spark: SparkSession, d: str) -> DataFrame:
    """The table of quotes: parent key, place, text and cited passage."""
    return nested.chain_children(_rows(spark, d)[0]).where(F.col("child") == "quotes").select("line_id", "num", "text", "ref_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_changes, p3_unified, p7_found, p7_tables, p7_records, p7_quotes)}

_P7 = """WITH c AS (SELECT line_id, raw::JSON AS j FROM chain_lines WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'),
pa AS (SELECT line_id, unnest(range(json_array_length(j, '$.passages')::BIGINT)) AS num, unnest(from_json(j->'$.passages', '["JSON"]')) AS x FROM c WHERE json_type(j, '$.passages') = 'ARRAY'),
ps AS (SELECT line_id, string_split_regex(trim(j->>'$.passages'), '\\s*[,;]\\s*') AS l FROM c WHERE json_type(j, '$.passages') = 'VARCHAR'),
passages AS (SELECT line_id, num, CASE json_type(x) WHEN 'VARCHAR' THEN x->>'$' WHEN 'OBJECT' THEN x->>'$.id' END AS ref FROM pa UNION ALL SELECT line_id, unnest(range(len(l))) AS num, unnest(l) AS ref FROM ps),
qu AS (SELECT line_id, j->'$.detail.quote_passages' AS qp, unnest(range(json_array_length(j, '$.detail.quotes')::BIGINT)) AS num, unnest(from_json(j->'$.detail.quotes', '["JSON"]')) AS x FROM c WHERE json_type(j, '$.detail.quotes') = 'ARRAY'),
quotes AS (SELECT line_id, num, CASE json_type(x) WHEN 'VARCHAR' THEN x->>'$' ELSE x->>'$.text' END AS body,
 coalesce(CASE WHEN json_type(x) = 'OBJECT' AND json_type(x, '$.passage') = 'VARCHAR' THEN x->>'$.passage' WHEN json_type(x) = 'OBJECT' AND json_type(x, '$.cite.passage.id') = 'VARCHAR' THEN x->>'$.cite.passage.id' END, qp->>('$[' || num || ']'), '') AS ref FROM qu),
k AS (SELECT line_id, raw::JSON AS j FROM calibration_lines WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'),
vc AS (SELECT line_id, j->'$.verdict_counts' AS v, 0 AS place FROM k WHERE json_exists(j, '$.verdict_counts') UNION ALL
 SELECT line_id, p->'$.verdict_counts', 1 + n FROM (SELECT line_id, unnest(from_json(j->'$.result.passes', '["JSON"]')) AS p, unnest(range(json_array_length(j, '$.result.passes')::BIGINT)) AS n FROM k WHERE json_type(j, '$.result.passes') = 'ARRAY')),
counts AS (SELECT line_id, key AS ref, CASE json_type(v, '$."' || key || '"') WHEN 'OBJECT' THEN v->>('$."' || key || '".n') ELSE v->>('$."' || key || '"') END AS n FROM (SELECT line_id, v, unnest(json_keys(v)) AS key FROM vc WHERE json_type(v) = 'OBJECT')
 UNION ALL SELECT line_id, x->>'$.verdict', x->>'$.count' FROM (SELECT line_id, unnest(from_json(v, '["JSON"]')) AS x FROM vc WHERE json_type(v) = 'ARRAY'))
SELECT DISTINCT 'chain_lines' AS src, line_id, 'passages' AS child, num::BIGINT AS num, ref AS ref_id FROM passages WHERE coalesce(ref, '') <> ''
UNION ALL SELECT DISTINCT 'chain_lines', line_id, 'quotes', num::BIGINT, ref FROM quotes WHERE body IS NOT NULL
UNION ALL SELECT DISTINCT 'calibration_lines', line_id, 'verdict_counts', n::BIGINT, ref FROM counts WHERE ref IS NOT NULL AND n IS NOT NULL"""
# Every leaf of every record; the list or counted map it lies in names its table.
_P7_LEAVES = """WITH r AS (SELECT 'chain_lines' AS src, line_id, raw FROM chain_lines UNION ALL SELECT 'calibration_lines', line_id, raw FROM calibration_lines),
j AS (SELECT src, line_id, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw END AS raw FROM r WHERE line_id IS NOT NULL),
t AS (SELECT src, line_id, raw, regexp_replace(regexp_replace(e.fullkey, '^\\$\\.?', ''), '"', '', 'g') AS k, e.type AS kind, e.atom FROM j, json_tree(j.raw) e WHERE j.raw IS NOT NULL AND e.type NOT IN ('OBJECT', 'ARRAY', 'NULL')),
m AS (SELECT *, regexp_extract(k, 'verdict_counts\\.([^.\\[]+)', 1) AS in_map, json_keys(raw, '$' || CASE WHEN contains(k, 'verdict_counts.') THEN '.' || regexp_extract(k, '^(.*verdict_counts)\\.', 1) ELSE '' END) AS names FROM t),
p AS (SELECT *, CASE WHEN in_map <> '' THEN regexp_replace(regexp_replace(k, 'verdict_counts\\.[^.\\[]+', 'verdict_counts{}'), '\\[\\d+\\]', '[]', 'g') ELSE regexp_replace(k, '\\[\\d+\\]', '[]', 'g') END AS path,
 CASE WHEN in_map <> '' THEN regexp_replace(k, 'verdict_counts\\.[^.\\[]+', 'verdict_counts[' || (list_position(names, in_map) - 1) || ']') ELSE k END AS spot FROM m),
g AS (SELECT *, regexp_extract(path, '^(.*(\\[\\]|\\{\\}))', 1) AS grp FROM p)
SELECT DISTINCT src, line_id, grp, array_to_string(regexp_extract_all(spot, '\\[(\\d+)\\]', 1), '.') AS place, CASE WHEN grp LIKE '%{}' THEN in_map END AS key,
 CASE WHEN ltrim(substr(path, length(grp) + 1), '.') = '' THEN 'value' ELSE ltrim(substr(path, length(grp) + 1), '.') END AS column_name, CASE WHEN kind = 'VARCHAR' THEN atom->>'$' ELSE atom::VARCHAR END AS value FROM g"""
_OF = lambda f: f"CASE WHEN json_type(j, '$.{f}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN j->>'$.{f}' END AS {f}"
_P7_RECORDS = " UNION ALL ".join(
    f"SELECT '{t}' AS src, line_id, {', '.join(map(_OF, ('mode', 'idx', 'claim', 'verdict', 'backend', 'route', 'date', 'model', 'fixture', 'runs')))} FROM (SELECT line_id, raw::JSON AS j FROM {t} WHERE json_valid(raw) AND json_type(raw) = 'OBJECT')"
    for t in ("chain_lines", "calibration_lines")
)
_P3 = """WITH c AS (SELECT series, file_name, line_no, line_id, raw::JSON AS j FROM chain_lines WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'),
f0 AS (SELECT series, file_name, line_no, line_id, k AS field, j->('$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(j)) AS k FROM c) WHERE k <> 'detail'
 UNION ALL SELECT series, file_name, line_no, line_id, 'detail.' || k, j->('$.detail."' || k || '"') FROM (SELECT *, unnest(json_keys(j, '$.detail')) AS k FROM c WHERE json_type(j, '$.detail') = 'OBJECT')),
f AS (SELECT *, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind, json_type(v) || ':' || CASE json_type(v) WHEN 'VARCHAR' THEN v->>'$' ELSE json(v)::VARCHAR END AS val FROM f0 WHERE json_type(v) <> 'NULL'),
ff AS (SELECT series, file_name, field, list_sort(list(DISTINCT kind)) AS kinds FROM f GROUP BY ALL),
o AS (SELECT series, file_name, row_number() OVER (PARTITION BY series ORDER BY min(written_at), file_name) AS no FROM chain_lines SEMI JOIN ff USING (series, file_name) GROUP BY series, file_name),
st AS (SELECT b.series, b.file_name AS now, a.file_name AS was FROM o a JOIN o b ON a.series = b.series AND b.no = a.no + 1),
gone AS (SELECT st.*, x.field FROM st JOIN ff x ON x.series = st.series AND x.file_name = st.was ANTI JOIN ff y ON y.series = st.series AND y.file_name = st.now AND y.field = x.field),
fresh AS (SELECT st.*, x.field FROM st JOIN ff x ON x.series = st.series AND x.file_name = st.now ANTI JOIN ff y ON y.series = st.series AND y.file_name = st.was AND y.field = x.field),
ix AS (SELECT series, file_name, line_id, trim(j->>'$.idx', ' ') AS idx FROM c WHERE json_type(j, '$.idx') NOT IN ('NULL', 'ARRAY', 'OBJECT') QUALIFY row_number() OVER (PARTITION BY series, file_name, trim(j->>'$.idx', ' ') ORDER BY line_no DESC, line_id DESC) = 1),
vals AS (SELECT f.series, f.file_name, ix.idx, f.field, f.val FROM f JOIN ix USING (series, file_name, line_id)),
rn AS (SELECT g.now, g.field, h.field AS new_field FROM gone g JOIN fresh h ON g.series = h.series AND g.now = h.now JOIN vals a ON a.series = g.series AND a.file_name = g.was AND a.field = g.field JOIN vals b ON b.series = h.series AND b.file_name = h.now AND b.field = h.field AND b.idx = a.idx GROUP BY ALL HAVING 2 * count(*) FILTER (a.val = b.val) >= count(*))
SELECT now AS file_name, 'renamed' AS change_kind, field, new_field FROM rn
UNION SELECT now, 'removed', field, '' FROM gone ANTI JOIN rn USING (now, field)
UNION SELECT h.now, 'added', h.field, '' FROM fresh h ANTI JOIN rn ON rn.now = h.now AND rn.new_field = h.field
UNION SELECT st.now, 'retyped', x.field, '' FROM st JOIN ff x ON x.series = st.series AND x.file_name = st.was JOIN ff y ON y.series = st.series AND y.file_name = st.now AND y.field = x.field AND y.kinds <> x.kinds"""
# The list of p3_found with its series and the kinds before and after.
_P3_LIST = _P3[: _P3.index("SELECT now AS file_name")] + """SELECT a.series, a.now AS file_name, a.change_kind, a.field, a.new_field, coalesce(x.kinds, []) AS old_kinds, coalesce(y.kinds, []) AS new_kinds FROM (
SELECT series, now, was, 'renamed' AS change_kind, field, new_field FROM rn JOIN st USING (now) UNION SELECT series, now, was, 'removed', field, '' FROM gone ANTI JOIN rn USING (now, field)
UNION SELECT h.series, h.now, h.was, 'added', h.field, '' FROM fresh h ANTI JOIN rn ON rn.now = h.now AND rn.new_field = h.field
UNION SELECT st.series, st.now, st.was, 'retyped', x.field, '' FROM st JOIN ff x ON x.series = st.series AND x.file_name = st.was JOIN ff y ON y.series = st.series AND y.file_name = st.now AND y.field = x.field AND y.kinds <> x.kinds) a
LEFT JOIN ff x ON x.series = a.series AND x.file_name = a.was AND x.field = a.field AND a.change_kind <> 'added'
LEFT JOIN ff y ON y.series = a.series AND y.file_name = a.now AND y.field = CASE WHEN a.new_field <> '' THEN a.new_field ELSE a.field END AND a.change_kind <> 'removed'"""
_P7_QUOTES = _P7[: _P7.index("SELECT DISTINCT 'chain_lines'")] + "SELECT line_id, num::BIGINT AS num, body AS text, ref AS ref_id FROM quotes WHERE body IS NOT NULL"
SQL: dict[str, str] = {"p3_found": _P3, "p3_changes": _P3_LIST, "p7_found": _P7, "p7_tables": _P7_LEAVES, "p7_records": _P7_RECORDS, "p7_quotes": _P7_QUOTES}
