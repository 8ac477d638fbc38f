"""Queries over runs, their signals and calls, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calls
from ..functions.text import one_of
from ..operators import adjudicate as A


def derived_calls(lineitem: DataFrame) -> DataFrame:
    """Structured calls with their input as JSON: aliases of tools and fields, numbers as text, values of the wrong kind."""
    s = lambda c: F.col(c).cast("string")
    d = lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), s("l_partkey").alias("p"), F.col("l_quantity").cast("long").cast("string").alias("q"), ((F.col("l_partkey") + F.col("l_linenumber")) % 12).cast("int").alias("form"))
    forms = [
        ("Read", '{"file_path":"/r/f%p.py","offset":%q}'), (" View ", '{"path":"/r/f%p.py","offset":"%q","limit":" 1_0"}'), ("Edit", '{"filename":"a/b/f%p.py"}'), ("Grep", '{"pattern":"it\'s \'%p\'","path":"/r","q":"z"}'),
        ("RG", '{"query":5,"glob":"*.py"}'), ("bash", '{"command":"make t%p"}'), ("Read", '{"file":"/r/f%p.py","offset":"x","limit":%q}'), ("cat", '{"file_path":%p,"path":"/r"}'),
        ("read", '{"file_path":"","path":"/r/f%p.py","offset":0,"limit":%q}'), ("Task", '{"z":%q,"a":"text %p","c":true}'), ("Read", '{"path":"/r/f%p.py","offset":%q.7,"limit":-3}'), ("run", '{"command":" ","q":"  "}'),
    ]
    filled = lambda x: F.replace(F.replace(F.lit(x), F.lit("%p"), F.col("p")), F.lit("%q"), F.col("q"))
    tool = one_of(F.col("form"), [F.lit(t) for t, _ in forms])
    return d.select("id", "k", "p", tool.alias("tool"), one_of(F.col("form"), [filled(a) for _, a in forms]).alias("input"))


def twins(d: DataFrame) -> DataFrame:
    """Input and twin are columns of their own, so each is made once a row."""
    d = d.withColumn("v", F.parse_json("input"))
    t, v = F.col("tool"), F.col("v")
    d = d.withColumn("twin", calls.twin_command(t, v))
    return d.select("id", "k", "p", "twin", calls.call_command(t, v, F.col("twin")).alias("cmd"), calls.call_query(v).alias("query"), calls.shown_action(t, v).alias("shown"), calls.edited_source(t, v).alias("edited"))


QUERIES = {
    "bash_twin": ("lineitem", derived_calls, twins),
    "find_diff": ("events", A.derived_runs, lambda d: A.shown_diffs(d).select("conv", "seq", F.sha2("diff", 256).alias("sha"))),
    "edit_on_disk": ("events", A.derived_runs, A.disk_diffs),
    "adjudicate": ("events", A.derived_runs, A.verdicts),
    "budget_signals": ("events", A.derived_signals, A.signals),
    "cache_guard": ("conversations", None, lambda d: A.cache_guard(A.derived_lanes(d), 60)),
}

_EXT = r"\.(?:py|pyx|pyi|js|jsx|ts|tsx|java|go|rb|rs|c|cc|cpp|cxx|h|hpp|php|cs|scala|kt|swift|m|mm|sh|pl|lua|r|jl|ex|exs|clj|erl|hs|ml|vue|svelte|sql)$"
_VALUE = "CASE WHEN json_type(input, '$.{0}') IN ('NULL') OR input->>'$.{0}' IN ('', '0', 'false') THEN NULL ELSE json_extract(input, '$.{0}') END"


def _first(*keys: str) -> str:
    return "coalesce(" + ", ".join(_VALUE.format(k) for k in keys) + ")"


def _whole(key: str) -> str:
    """A whole number, -1e18 for what is none, null for nothing."""
    x = f"(input->>'$.{key}')"
    return f"""CASE WHEN {x} IS NULL THEN NULL WHEN json_type(input, '$.{key}') = 'VARCHAR' THEN CASE WHEN regexp_matches(trim({x}), '^[+-]?[0-9]+(_[0-9]+)*$') THEN CAST(replace(trim({x}), '_', '') AS BIGINT) ELSE -1000000000000000000 END ELSE CAST(trunc(CAST({x} AS DOUBLE)) AS BIGINT) END"""


_TWIN = f"""WITH d AS (SELECT l_orderkey AS id, l_linenumber AS k, CAST(l_partkey AS VARCHAR) AS p, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, (l_partkey + l_linenumber) % 12 AS form FROM lineitem),
c AS (SELECT id, k, p, ['Read', ' View ', 'Edit', 'Grep', 'RG', 'bash', 'Read', 'cat', 'read', 'Task', 'Read', 'run'][form + 1] AS tool, replace(replace(['{{"file_path":"/r/f%p.py","offset":%q}}', '{{"path":"/r/f%p.py","offset":"%q","limit":" 1_0"}}', '{{"filename":"a/b/f%p.py"}}', '{{"pattern":"it''s ''%p''","path":"/r","q":"z"}}',
  '{{"query":5,"glob":"*.py"}}', '{{"command":"make t%p"}}', '{{"file":"/r/f%p.py","offset":"x","limit":%q}}', '{{"file_path":%p,"path":"/r"}}', '{{"file_path":"","path":"/r/f%p.py","offset":0,"limit":%q}}', '{{"z":%q,"a":"text %p","c":true}}', '{{"path":"/r/f%p.py","offset":%q.7,"limit":-3}}', '{{"command":" ","q":"  "}}'][form + 1], '%p', p), '%q', q) AS input FROM d),
v AS (SELECT *, lower(trim(tool)) AS name, {_first("file_path", "path", "filename", "file")} AS f, {_first("pattern", "query", "q")} ->> '$' AS pat, {_first("path", "glob", "include")} ->> '$' AS place, {_whole("offset")} AS o0, {_whole("limit")} AS l0 FROM c),
w AS (SELECT *, CASE WHEN json_type(f) = 'VARCHAR' THEN f ->> '$' END AS file, coalesce(o0 = -1000000000000000000 OR l0 = -1000000000000000000, false) OR (o0 = -1000000000000000000 OR l0 = -1000000000000000000) IS TRUE AS bad FROM v),
x AS (SELECT *, CASE WHEN NOT bad THEN nullif(o0, 0) END AS o, CASE WHEN NOT bad THEN nullif(l0, 0) END AS l FROM w),
t AS (SELECT *, CASE WHEN name IN ('bash', 'shell', 'run', 'execute', 'bashoutput', 'bash_output') THEN CASE WHEN trim(input->>'$.command') <> '' THEN input->>'$.command' END
  WHEN name IN ('read', 'notebookread', 'notebook_read', 'view', 'cat', 'openfile', 'open_file') THEN CASE WHEN file IS NOT NULL THEN CASE WHEN o IS NOT NULL THEN 'sed -n ''' || o || ',' || o + CASE WHEN l IS NULL THEN 2000 ELSE greatest(1, l) END - 1 || 'p'' ' || file ELSE 'cat ' || file END END
  WHEN name IN ('edit', 'multiedit', 'write') THEN 'edit ' || string_split(file, '/')[-1] WHEN name IN ('grep', 'glob', 'search', 'find', 'rg') THEN trim('grep ''' || replace(substr(coalesce(pat, ''), 1, 200), '''', ' ') || ''' ' || coalesce(place, '')) END AS twin FROM x)
SELECT id, k, p, twin, coalesce(nullif(twin, ''), CASE WHEN name IN ('bash', 'shell', 'run', 'execute') AND json_type(input, '$.command') = 'VARCHAR' THEN input->>'$.command' ELSE substr(trim(trim(tool) || ' ' || array_to_string(list_transform(list_sort(json_keys(input)), lambda y: y || '=' || (input ->> ('$.' || y))), ' ')), 1, 400) END) AS cmd,
coalesce(CASE WHEN json_type(input, '$.query') = 'VARCHAR' AND trim(input->>'$.query') <> '' THEN input->>'$.query' END, CASE WHEN json_type(input, '$.pattern') = 'VARCHAR' AND trim(input->>'$.pattern') <> '' THEN input->>'$.pattern' END, CASE WHEN json_type(input, '$.q') = 'VARCHAR' AND trim(input->>'$.q') <> '' THEN input->>'$.q' END, '') AS query,
CASE WHEN tool IN ('Bash', 'bash') THEN coalesce({_first("command")} ->> '$', '') WHEN tool IN ('Read', 'Edit', 'Write', 'MultiEdit', 'NotebookEdit') THEN trim(tool || ' ' || coalesce({_first("file_path", "notebook_path")} ->> '$', '')) WHEN tool IN ('Grep', 'Glob') THEN trim(tool || ' ' || coalesce({_first("pattern")} ->> '$', '')) ELSE tool END AS shown,
CASE WHEN name IN ('edit', 'multiedit', 'write') AND regexp_matches(lower(file), '{_EXT}') THEN lower(file) END AS edited FROM t"""

_RUNS = """e AS (SELECT user_id AS conv, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(floor(value) AS BIGINT) AS v, user_id % 5 AS u, event_type FROM events),
m AS (SELECT conv, seq * 2 AS seq, 'assistant' AS role, 'diff --git mine' AS text, CASE WHEN v % 11 = 0 AND u <> 1 THEN 'git  diff HEAD' ELSE event_type || ' -k ' || v % 3 END AS action, event_type = 'purchase' AND u <> 2 AND v % 2 = 0 AS made FROM e
UNION ALL SELECT conv, seq * 2 + 1, 'tool', CASE WHEN u <= 2 THEN 'plain @@ ' WHEN (v + u) % 6 = 0 THEN 'ok' || chr(10) || 'diff --git a/x b/x' || chr(10) || '@@ -1 +1 @@' WHEN (v + u) % 6 = 1 THEN '--- a' || chr(10) || '+++ b' || chr(10) || '@@ -1 @@' WHEN (v + u) % 6 = 2 THEN ' ' || chr(10) || '[SUPERVISOR diff --git' ELSE 'plain @@ ' END, NULL, false FROM e),
n AS (SELECT *, CASE WHEN contains(text, 'diff --git') THEN instr(text, 'diff --git') WHEN contains(text, '@@ ') AND (contains(text, '+++ ') OR contains(text, '--- ')) THEN least(nullif(instr(text, '@@ '), 0), nullif(instr(text, '--- '), 0)) END AS start FROM m WHERE role IN ('tool', 'user') AND NOT regexp_matches(text, '^\\s*\\[SUPERVISOR')),
shown AS (SELECT conv, seq, substr(text, start, 3000) AS diff FROM n WHERE start IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv ORDER BY seq DESC) = 1),
asked AS (SELECT conv, max(seq) AS seq FROM m WHERE role = 'assistant' AND regexp_matches(action, '\\bgit\\s+diff\\b') GROUP BY conv),
after AS (SELECT a.conv, a.seq, coalesce(string_agg(text, ' ' ORDER BY m.seq) FILTER (role IN ('tool', 'user')), '') AS t FROM asked a LEFT JOIN m ON m.conv = a.conv AND m.seq > a.seq AND m.seq <= a.seq + 3 GROUP BY ALL),
disk AS (SELECT conv, seq, contains(t, 'diff --git') OR contains(t, '@@ ') AND (contains(t, '+++ ') OR contains(t, '--- ')) AS there FROM after)"""
_STALL = """c AS (SELECT conv, seq, action, list_distinct(list_filter(string_split(action, ' '), lambda x: x <> '')) AS w FROM m WHERE role = 'assistant'),
first AS (SELECT conv, action, any_value(w) AS w, min(seq) AS f FROM c GROUP BY ALL),
old AS (SELECT a.conv, a.action, bool_or(b.f IS NOT NULL) AS like_old FROM first a LEFT JOIN first b ON b.conv = a.conv AND b.f < a.f AND len(list_intersect(a.w, b.w)) >= CAST(0.6 AS DOUBLE) * len(list_distinct(list_concat(a.w, b.w))) GROUP BY ALL),
g AS (SELECT c.conv, c.seq, CASE WHEN c.seq > first.f OR like_old THEN 1.0::DOUBLE ELSE 0.0 END AS dup FROM c JOIN first ON first.conv = c.conv AND first.action = c.action JOIN old ON old.conv = c.conv AND old.action = c.action),
lf AS (SELECT conv, seq, round(avg(dup) OVER (PARTITION BY conv ORDER BY seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 9) AS lf, row_number() OVER (PARTITION BY conv ORDER BY seq DESC) AS back FROM g),
stall AS (SELECT conv, count(*) >= 6 AND max(lf) FILTER (back = 1) >= 0.5 AND min(lf) FILTER (back <= 3) >= 0.34 AS stalled FROM lf GROUP BY conv)"""
SQL = {
    "bash_twin": _TWIN,
    "find_diff": f"WITH {_RUNS} SELECT conv, seq, sha256(diff) AS sha FROM shown",
    "edit_on_disk": f"WITH {_RUNS} SELECT conv, seq, there FROM disk",
    "adjudicate": f"""WITH {_RUNS}, {_STALL},
d AS (SELECT i.conv, made, coalesce(trim(diff) <> '', false) AS shown, there, coalesce(stalled, false) AS stalled FROM (SELECT conv, bool_or(made) AS made FROM m GROUP BY conv) i LEFT JOIN shown ON shown.conv = i.conv LEFT JOIN disk ON disk.conv = i.conv LEFT JOIN stall ON stall.conv = i.conv),
r AS (SELECT *, CASE WHEN there THEN 'disk_true' WHEN there IS NOT NULL THEN 'disk_false' WHEN shown THEN 'shown_diff' WHEN made THEN 'struct_edit' ELSE 'none' END AS rung FROM d)
SELECT conv, CASE WHEN rung NOT IN ('disk_false', 'none') AND stalled THEN 'SUBMIT' ELSE 'CONTINUE' END AS verdict, rung, rung IN ('disk_false', 'none') AND (shown OR made) AS reverted, stalled FROM r""",
    "budget_signals": """WITH e AS (SELECT *, user_id AS session, CAST(floor(value) AS BIGINT) AS v FROM events),
r AS (SELECT session, v, count(*) OVER w AS seq, sum(v) OVER w * count(*) OVER w * 6 / 1.0 AS cum, count(*) FILTER (event_type = 'purchase') OVER w AS src, sum(v * 800) OVER w AS spent, CASE WHEN user_id % 3 <> 0 THEN CAST(user_id % 7 * 100000 AS DOUBLE) END AS med, min(v / 100.0) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS low FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, CASE WHEN med > 0 THEN spent / med ELSE 0.0 END AS factor FROM r)
SELECT session, seq, CAST(spent AS BIGINT) AS billed_so_far, round(factor, 9) AS runaway_factor, seq >= 3 AND low >= 0.5 AS high, cum >= 230168 AND seq > 48 AS budget, src >= 1 AND cum > 140701 AND cum <= 1835088 AS bank, factor > 3.25 AS runaway, factor > 2 AND v % 4 = 0 AS doomed, spent >= 750000 AS floor_ok FROM f""",
    "cache_guard": """WITH m AS (SELECT conv_id AS session, turn AS seq, list(sha256(concat_ws(':', role, text))) OVER w AS h, list(length(coalesce(text, '')) // 4) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT session, seq, t, list_transform(h, lambda x, i: CASE WHEN seq % 5 = 4 AND i = session % 4 + 1 THEN 'edited' ELSE x END) AS h FROM m),
b AS (SELECT *, lag(h) OVER (PARTITION BY session ORDER BY seq) AS p FROM r),
c AS (SELECT *, least(len(h), coalesce(len(p), 0)) AS covered FROM b),
x AS (SELECT *, coalesce(list_min(list_filter(range(1, covered + 1), lambda i: h[i] <> p[i])) - 1, covered) AS frozen FROM c),
y AS (SELECT session, seq, CAST(coalesce(list_sum(t[frozen + 1:covered]), 0) AS BIGINT) AS rewritten FROM x)
SELECT session, seq, rewritten, bool_or(rewritten > 60) OVER (PARTITION BY session ORDER BY seq) AS tripped FROM y""",
}
