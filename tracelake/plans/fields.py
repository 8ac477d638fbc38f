"""Queries over single fields of observations, tool calls and messages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fields

QUERIES = {
    "observation_fields": ("events", None, fields.observation_fields),
    "argv_command": ("events", fields.derived_argv, fields.argv_commands),
    "line_types": ("documents", fields.derived_code, fields.line_type_shares),
    "keep_growth": ("events", None, fields.keep_growth),
    "top_sites": ("lineitem", lambda d: d.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("/r/f"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("path")), fields.first_sites),
    "conv_identity": ("conversations", None, fields.identities),
}

_V = "CAST(floor(value) AS BIGINT)"
_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, CASE i % 5 WHEN 0 THEN 'def f(a):' WHEN 1 THEN 'from x import ' || substr(x, 1, 10) WHEN 2 THEN '# ' || x WHEN 3 THEN '' ELSE '    ' || x END AS line, i FROM l)"
SQL = {
    "observation_fields": f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN {_V} - 50 WHEN 1 THEN {_V} END AS rc, CASE WHEN {_V} % 10 < 6 THEN true ELSE false END AS covered FROM events",
    "argv_command": f"SELECT event_id, event_type || ' ' || {_V} AS cmd FROM events",
    "line_types": f"WITH {_LINES} SELECT doc_id, round(count(*) FILTER (i % 5 = 0) / CAST(count(*) AS DOUBLE), 9) AS signature, round(count(*) FILTER (i % 5 = 1) / CAST(count(*) AS DOUBLE), 9) AS import, round(count(*) FILTER (i % 5 = 2) / CAST(count(*) AS DOUBLE), 9) AS comment, round(count(*) FILTER (i % 5 = 4) / CAST(count(*) AS DOUBLE), 9) AS body FROM c WHERE trim(line) <> '' GROUP BY 1",
    "keep_growth": "SELECT user_id, event_id, (SELECT count(DISTINCT event_type) FROM events b WHERE b.user_id = a.user_id AND (b.ts < a.ts OR b.ts = a.ts AND b.event_id <= a.event_id)) AS kept FROM events a",
    "top_sites": "SELECT file, id FROM (SELECT DISTINCT 'f' || l_partkey || '.py' AS file, l_orderkey AS id FROM lineitem) QUALIFY row_number() OVER (PARTITION BY file ORDER BY id) <= 3",
    "conv_identity": "WITH f AS (SELECT conv_id, coalesce(min(text) FILTER (k = 1 AND role = 'user'), '') AS first FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) GROUP BY 1) SELECT conv_id, substr(sha256('s' || chr(10) || first), 1, 24) AS ident FROM f",
}
