"""Queries: functions of a source tree, the calls between them, handlers that reach unchecked queries, and episodes of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import calls, detect
from siltstone.plans import samples
from siltstone.plans.analyses import _HAS
from siltstone.plans.catalogue import as_sql, findings, query
from siltstone.scratch import settle
from siltstone.streaming import episodes

_KINDS = ((samples.CALLER_PATH, samples.CALLER), (samples.CALLED_PATH, samples.CALLED), (samples.INNER_PATH, samples.INNER))
_TREE = "c AS (" + " UNION ALL ".join(f"SELECT p.value AS path, t.value AS text FROM {samples.duck(p)} p JOIN {samples.duck(t)} t USING (event_id)" for p, t in _KINDS) + ")"
#: fn: functions, each from its head to the first line that is a brace alone, or its own line.
_FN = f"""{_TREE}, cl AS (SELECT path, i::INT AS line, ls[i] AS text FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, string_split(text, chr(10)) AS ls FROM c))),
    hd AS (SELECT path, line, text, regexp_extract(text, '^(?:export )?(?:async )?(?:function|const) (\\w+)(?:\\(| = async)', 1) AS name FROM cl WHERE regexp_matches(text, '^(?:export )?(?:async )?(?:function|const) \\w+(?:\\(| = async)')),
    ex AS (SELECT hd.path, name, hd.line AS first, CASE WHEN hd.text LIKE '%}}' THEN hd.line ELSE min(e.line) END AS last FROM hd LEFT JOIN (SELECT path, line FROM cl WHERE text = '}}') e ON e.path = hd.path AND e.line > hd.line GROUP BY hd.path, name, hd.line, hd.text),
    fb AS (SELECT ex.path, name, first, last, string_agg(text, chr(10) ORDER BY line) AS body FROM ex JOIN cl ON cl.path = ex.path AND line BETWEEN first AND last GROUP BY ex.path, name, first, last),
    fn AS (SELECT *, regexp_replace(path, '(/index)?[.]ts$', '') AS module, {_HAS(detect.AUTHZ, 'body')} AS has_check, {_HAS(detect.DATABASE, 'body')} AS has_query FROM fb)"""
_ED = """im AS (SELECT path, unnest(CASE WHEN text LIKE '%* as rows%' THEN [{'local': 'rows', 'name': '*'}] WHEN text LIKE 'import rows%' THEN [{'local': 'rows', 'name': 'default'}] ELSE [{'local': 'fetchPart', 'name': 'loadPart'}, {'local': 'dropPart', 'name': 'dropPart'}] END, recursive := true),
      CASE WHEN text NOT LIKE '%from ''stock/%' THEN regexp_replace(regexp_extract(text, 'from ''([^'']+)''', 1), '^(@/|([.][.]/)+)', '') END AS target FROM cl WHERE line = 1 AND text LIKE 'import %'),
    fc AS (SELECT path, name, unnest(regexp_extract_all(regexp_replace(body, 'function \\w+', '', 'g'), '(?:^|[^\\w.])((?:\\w+[.])?\\w+)\\(', 1)) AS call FROM fn),
    ed AS (SELECT fc.path, fc.name, t.path AS to_path, t.name AS to_name FROM fc JOIN im ON im.path = fc.path AND im.local = fc.call JOIN fn t ON t.module = im.target AND t.name = im.name
      UNION SELECT fc.path, fc.name, t.path, t.name FROM fc JOIN im ON im.path = fc.path AND im.name = '*' JOIN fn t ON t.module = im.target AND fc.call = im.local || '.' || t.name
      UNION SELECT fc.path, fc.name, t.path, t.name FROM fc JOIN fn t ON t.path = fc.path AND t.name = fc.call WHERE NOT EXISTS (SELECT 1 FROM im WHERE im.path = fc.path AND im.local = fc.call))"""


def tree(spark, sf_dir) -> DataFrame:
    """(path, text) of three files for each finding."""
    rows = findings(spark, sf_dir)
    return reduce(DataFrame.unionByName, [samples.made(rows, path=p, text=t) for p, t in _KINDS])


@query(f"WITH {_FN} SELECT path, name, first, last, has_check, has_query FROM fn")
def function_bodies(spark, sf_dir):
    return calls.bodies(tree(spark, sf_dir)).select("path", "name", "first", "last", "has_check", "has_query")


@query(f"WITH {_FN}, {_ED} SELECT path, name, to_path, to_name FROM ed")
def call_edges(spark, sf_dir):
    rows = tree(spark, sf_dir)
    return calls.edges(settle(calls.bodies(rows), "functions"), calls.imports(rows))


@query(
    f"""WITH RECURSIVE {_FN}, {_ED},
    r AS (SELECT path AS root, name AS method, path, name, 0 AS calls, [{{'path': path, 'name': name}}] AS trail FROM fn WHERE path LIKE '%/route.ts' AND name IN ({', '.join(as_sql(m) for m in calls.METHODS)}) AND NOT has_check
      UNION ALL SELECT root, method, fn.path, fn.name, calls + 1, list_append(trail, {{'path': fn.path, 'name': fn.name}}) FROM r JOIN ed ON ed.path = r.path AND ed.name = r.name JOIN fn ON fn.path = ed.to_path AND fn.name = ed.to_name WHERE NOT fn.has_check AND NOT list_contains(trail, {{'path': fn.path, 'name': fn.name}})),
    b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY root, method, path, name ORDER BY calls, trail) = 1)
    SELECT root AS path, method, path AS to_path, name AS to_name, calls, array_to_string([t.path || ' ' || t.name FOR t IN trail], ', ') AS trail, 'CWE-862' AS cwe FROM b JOIN fn USING (path, name) WHERE calls > 0 AND has_query"""
)
def unchecked_queries(spark, sf_dir):
    """Handlers, and the database queries they reach over any number of calls without a check."""
    found = calls.missing_authorization(tree(spark, sf_dir))
    return found.withColumn("trail", F.array_join(F.transform("trail", lambda t: F.concat_ws(" ", t["path"], t["name"])), ", "))


@query(
    """WITH d AS (SELECT DISTINCT coarse AS fingerprint, scan_date AS day FROM f),
    i AS (SELECT *, day - row_number() OVER (PARTITION BY fingerprint ORDER BY day)::INT AS island FROM d)
    SELECT fingerprint, min(day)::TIMESTAMP AS first_seen, max(day)::TIMESTAMP AS last_seen, (max(day) + 1)::TIMESTAMP AS fixed_at, count(*) AS scans, count(*)::DOUBLE AS days_open FROM i GROUP BY fingerprint, island"""
)
def finding_episodes(spark, sf_dir):
    """The episodes of the stream over all findings as a batch."""
    rows = findings(spark, sf_dir).select("coarse", F.col("scan_date").cast("timestamp").alias("ts"))
    return episodes.episodes(rows, key="coarse")
