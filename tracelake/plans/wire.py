"""Queries over requests, usage, digests and task matches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import wire

_v = lambda: F.floor("value").cast("long")


def _usage(e):
    u = wire.billed_usage(F.when(F.col("event_id") % 7 != 0, _v()), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 90 - 10), F.when(F.col("event_id") % 5 != 0, _v() + 1))
    return e.select("event_id", u.alias("u")).select("event_id", "u.*")


def _sessions(e):
    n, h = F.col("event_id") % 4, F.hex("event_id")
    uid = F.when(n == 0, F.concat(F.lit('{"session_id":"'), h, F.lit('"}'))).when(n == 1, F.concat(F.lit("user_1_session_"), h)).when(n == 2, F.concat(F.lit("a_session_not an id "), h)).otherwise(h)
    return e.select("event_id", wire.session_id(uid).alias("session"))


def _arguments(e):
    value = lambda k: F.when(F.col("event_id") % k == 0, F.concat(F.lit(" "), "event_type")).otherwise(F.lit(" \t"))
    return e.select("event_id", wire.query_argument(F.create_map(F.lit("search"), value(2), F.lit("pattern"), value(3), F.lit("query"), value(5))).alias("query"))


def _splits(e):
    text = lambda v: F.concat("event_type", v.cast("string"), F.lit("é end"))
    s = wire.split_texts(text(_v()), text(F.when(F.col("event_id") % 4 == 0, _v()).otherwise(F.col("event_id") % 50)))
    return e.select("event_id", s.alias("s")).select("event_id", "s.*")


def _digests(m):
    code = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("ReturnCode: 1 \n"), "text")).otherwise(F.concat("text", F.lit("\n\nx\ny\nlast")))
    return m.filter("text IS NOT NULL").select("conv_id", "turn", wire.digest(code).alias("digest"))


QUERIES = {
    "usage_billed": ("events", None, _usage),
    "session_ids": ("events", None, _sessions),
    "query_argument": ("events", None, _arguments),
    "text_split": ("events", None, _splits),
    "digest": ("conversations", None, _digests),
    "issuematch": ("conversations", None, lambda m: wire.issue_match(wire.derived_matches(m), wire.derived_tasks(m))),
}

_V = "CAST(floor(value) AS BIGINT)"
_FIRST = "coalesce(nullif(list_position(list_transform(range(1, least(length({0}), length({1})) + 1), lambda i: {0}[i] <> {1}[i]), true), 0) - 1, least(length({0}), length({1})))"
SQL = {
    "usage_billed": f"WITH u AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN {_V} ELSE 0 END AS i, CASE WHEN event_id % 3 <> 0 THEN event_id % 90 - 10 ELSE 0 END AS c, CASE WHEN event_id % 5 <> 0 THEN {_V} + 1 ELSE 0 END AS o FROM events) SELECT event_id, i - least(greatest(c, 0), i) AS input, least(greatest(c, 0), i) AS cache_read, 0 AS cache_creation, o AS output FROM u",
    "session_ids": "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN upper(to_hex(event_id)) END AS session FROM events",
    "query_argument": "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 3 = 0 OR event_id % 2 = 0 THEN ' ' || event_type ELSE '' END AS query FROM events",
    "text_split": f"WITH t AS (SELECT event_id, event_type || {_V} || 'é end' AS a, event_type || CASE WHEN event_id % 4 = 0 THEN {_V} ELSE event_id % 50 END || 'é end' AS b FROM events), p AS (SELECT *, {_FIRST.format('a', 'b')} AS p FROM t), r AS (SELECT *, reverse(a[p + 1:]) AS ra, reverse(b[p + 1:]) AS rb FROM p), s AS (SELECT *, {_FIRST.format('ra', 'rb')} AS s FROM r) SELECT event_id, left(a, p) AS front, reverse(ra[s + 1:]) AS removed, reverse(rb[s + 1:]) AS inserted, reverse(left(ra, s)) AS back FROM s",
    "digest": """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'ReturnCode: 1 ' || chr(10) || text ELSE text || chr(10) || chr(10) || 'x' || chr(10) || 'y' || chr(10) || 'last' END AS text, turn % 3 = 0 AS code, string_split(text, chr(10)) AS l FROM conversations WHERE text IS NOT NULL)
, b AS (SELECT *, list_transform(list_filter(CASE WHEN code THEN l ELSE list_concat(l, ['', 'x', 'y', 'last']) END, lambda x: trim(x) <> ''), lambda x: left(x, 300)) AS body FROM t)
, h AS (SELECT *, list_concat(CASE WHEN code THEN ['ReturnCode: 1'] ELSE [] END, body[1:2]) AS head, CASE WHEN len(body) >= 3 THEN body[-1:] ELSE [] END AS tail FROM b)
, m AS (SELECT *, greatest(len(body) - 3, 0) AS n, greatest(length(text) // 4 - length(array_to_string(list_concat(head, tail), chr(10))) // 4, 0) AS k FROM h)
SELECT conv_id, turn, CASE WHEN n = 0 AND k = 0 THEN text ELSE array_to_string(list_concat(head, [CASE WHEN n > 0 THEN '[... ' || n || ' lines (~' || k || ' tokens) left out ...]' ELSE '[... ~' || k || ' tokens left out ...]' END], tail), chr(10)) END AS digest FROM m""",
    "issuematch": r"""WITH k AS (SELECT conv_id AS conv, coalesce(text, '') || CASE WHEN conv_id % 2 = 1 THEN ' symbol_one.part' ELSE ' symbol_two' END AS task FROM conversations WHERE turn = 1 AND conv_id % 5 <> 0)
, w AS (SELECT conv, list_distinct(regexp_extract_all(task, '[A-Za-z_][A-Za-z0-9_]{5,}(?:\.[A-Za-z_][A-Za-z0-9_]*)*')) AS words FROM k)
, c AS (SELECT conv_id AS conv, turn AS gi, text || CASE turn % 4 WHEN 0 THEN chr(10) || '  def symbol_two(a):' WHEN 1 THEN ' see /w/f1.py' WHEN 2 THEN 'symbol_one.part' ELSE '' END AS text FROM conversations WHERE text IS NOT NULL)
, n AS (SELECT c.*, words, coalesce(len(list_filter(words, lambda x: contains(text, x))), 0) AS n FROM c LEFT JOIN w ON w.conv = c.conv)
SELECT conv, gi, CAST(n > 0 AS INT) AS any, round(ln(1 + n), 9) AS logn, CAST(words IS NOT NULL AND gi % 4 = 0 AND list_contains(words, 'symbol_two') AS INT) AS defines, round(n / greatest(coalesce(len(words), 1), 1), 9) AS share, CAST(words IS NOT NULL AND (gi % 3 = 0 OR gi % 4 = 1) AS INT) AS framed FROM n""",
}
