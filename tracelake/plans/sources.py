"""Queries over the readers, on lines made from the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranges, steps
from ..operators.wire import billed_usage
from ..sources import derived, lines



def _billed(rows):
    d = lines.response_usage(rows)
    return d.select("request", billed_usage(*[F.col(c) for c in ("given", "cached", "out")]).alias("u"), F.array_join("types", ",").alias("types"), F.col("given").isNotNull().alias("seen")).select("request", "u.input", "u.cache_read", "u.output", "seen", "types")


QUERIES = {
    "parse_transcript": ("conversations", derived.transcript_lines, lambda d: lines.transcript(d, most=5).select("conv", "pos", "part", "role", F.array_join("commands", ";").alias("commands"), _sha())),
    "parse_transcript_full": ("conversations", derived.transcript_lines, lambda d: lines.full_transcript(d).select("conv", "pos", "part", "role", "reasoning", F.array_join("commands", ";").alias("commands"), _sha())),
    "parse_rollout": ("conversations", derived.rollout_lines, lambda d: lines.rollout(d).select("conv", "pos", "role", _sha())),
    "to_internal": ("conversations", derived.bodies, lambda d: lines.wire_messages(d).select("conv", "idx", "role", "n_calls", F.array_join("commands", "; ").alias("commands"), F.array_join("queries", ";").alias("queries"), _sha())),
    "paired_steps": ("conversations", derived.transcript_lines, lambda d: steps.paired(lines.full_transcript(d)).select("conv", "step", "cmd", "reasoning", *[F.sha2(c, 256).alias(c) for c in ("obs", "said")])),
    "observed_steps": ("conversations", derived.transcript_lines, lambda d: steps.observed(lines.full_transcript(d)).select("conv", "step", "cmd", F.sha2("obs", 256).alias("obs"))),
    "protected_mask": ("conversations", derived.bodies, lambda d: lines.wire_messages(d).select("conv", "idx", "protected")),
    "response_usage": ("events", derived.response_lines, _billed),
    "ledger_scan": ("events", derived.ledger_lines, lines.ledger),
    "score_memo": ("events", derived.memo_rows, lambda d: lines.trailing_scores(d, cap=7)),
    "visibility_merge": ("lineitem", ranges.derived_ranges, lambda d: lines.merged_exports(d.select((F.col("conv") % 10).alias("session"), F.col("file").alias("base"), "lo", "hi")).select("session", "base", F.size("ranges").cast("long").alias("n"), F.element_at("ranges", -1)["lo"].alias("last_lo"))),
    "sse_usage": ("events", derived.usage_frames, lambda d: lines.stream_usage(d).withColumn("types", F.array_join("types", ","))),
}


def _sha():
    return F.sha2("text", 256).alias("sha")


_BLOCKS = """j AS (SELECT conv_id AS conv, turn AS pos, role, turn % 5 = 4 AS side, '{"content":' || CASE
    WHEN role = 'assistant' THEN CASE WHEN turn % 3 = 1 THEN '[' ELSE '[{"type":"thinking","thinking":"why ' || turn || '"},{"type":"text","text":' || to_json(coalesce(text, '')) || '},{"type":"text","text":" and ' || turn || '"},' END
      || CASE WHEN turn % 2 = 0 THEN '{"type":"tool_use","name":"Read","input":{"file_path":"/r/' || turn || '.py","offset":"' || turn || '","limit":5}}]' ELSE '{"type":"tool_use","name":"Bash","input":{"command":"run ' || turn || '"}}]' END
    WHEN role = 'user' AND turn % 4 <> 0 THEN '[{"type":"tool_result","content":[{"type":"text","text":' || to_json(coalesce(text, '')) || '},{"type":"image"},"x",{"text":"end"}]},{"type":"text","text":"note ' || turn || '"},{"type":"tool_result","content":' || turn || '},{"type":"tool_result","content":true}]'
    ELSE CAST(to_json(coalesce(text, '')) AS VARCHAR) END || '}' AS line FROM conversations WHERE role IN ('user', 'assistant')),
l AS (SELECT conv, pos, role, side, json_extract(line, '$.content') AS content FROM j),
x AS (SELECT conv, pos, role, side, k, json_extract(content, '$[' || k || ']') AS o FROM (SELECT *, unnest(range(CAST(json_array_length(content) AS BIGINT))) AS k FROM l WHERE json_type(content) = 'ARRAY')),
y AS (SELECT *, o ->> '$.type' AS kind, json_extract(o, '$.content') AS c, json_extract(o, '$.input') AS i, o ->> '$.name' AS name FROM x WHERE json_type(o) = 'OBJECT'),
z AS (SELECT *, CASE WHEN json_type(c) = 'ARRAY' THEN list_transform(list_filter(list_transform(range(CAST(json_array_length(c) AS BIGINT)), lambda n: json_extract(c, '$[' || n || ']')), lambda p: json_type(p) = 'OBJECT'), lambda p: coalesce(p ->> '$.text', '')) END AS parts,
  CASE json_type(c) WHEN 'BOOLEAN' THEN CASE WHEN (c ->> '$') = 'true' THEN 'True' ELSE 'False' END ELSE coalesce(c ->> '$', '') END AS plain FROM y),
b AS (SELECT conv, pos, role, side, k, kind, CASE kind WHEN 'thinking' THEN coalesce(o ->> '$.thinking', '') WHEN 'text' THEN coalesce(o ->> '$.text', '') END AS said, coalesce(array_to_string(parts, ' '), plain) AS spaced, coalesce(array_to_string(parts, ''), plain) AS joined,
  CASE name WHEN 'Bash' THEN i ->> '$.command' ELSE name || ' ' || coalesce(i ->> '$.file_path', '') END AS shown, CASE name WHEN 'Bash' THEN i ->> '$.command' ELSE CASE WHEN CAST(i ->> '$.offset' AS BIGINT) <> 0 THEN 'sed -n ''' || (i ->> '$.offset') || ',' || CAST(i ->> '$.offset' AS BIGINT) + CAST(i ->> '$.limit' AS BIGINT) - 1 || 'p'' ' ELSE 'cat ' END || (i ->> '$.file_path') END AS twin FROM z)"""

_FULL = f"""{_BLOCKS},
m AS (
  SELECT conv, pos, 0 AS part, 'assistant' AS role, coalesce(string_agg(said, '' ORDER BY k) FILTER (kind = 'text'), '') AS text, coalesce(string_agg(said, '' ORDER BY k) FILTER (kind = 'thinking'), '') AS reasoning, coalesce(string_agg(twin, ';' ORDER BY k) FILTER (kind = 'tool_use'), '') AS commands
  FROM b WHERE role = 'assistant' AND NOT side GROUP BY conv, pos
  UNION ALL SELECT conv, pos, row_number() OVER (PARTITION BY conv, pos ORDER BY k) - 1, CASE kind WHEN 'text' THEN 'user' ELSE 'tool' END, CASE kind WHEN 'text' THEN said ELSE joined END, '', '' FROM b WHERE role = 'user' AND NOT side AND kind IN ('text', 'tool_result')
  UNION ALL SELECT conv, pos, 0, role, content ->> '$', '', '' FROM l WHERE json_type(content) = 'VARCHAR' AND NOT side
)"""
_V = "CAST(floor(value * 100) AS BIGINT)"
SQL = {
    # The last messages of each conversation, walked block by block.
    "parse_transcript": f"""WITH {_BLOCKS},
m AS (
  SELECT conv, pos, 0 AS part, 'user' AS role, content ->> '$' AS text, '' AS commands FROM l WHERE json_type(content) = 'VARCHAR' AND role = 'user' AND trim(content ->> '$') <> ''
  UNION ALL SELECT conv, pos, 0, 'assistant', trim(coalesce(string_agg(said, chr(10) ORDER BY k) FILTER (said <> ''), ''), chr(10) || ' '), coalesce(string_agg(shown, ';' ORDER BY k) FILTER (kind = 'tool_use'), '') FROM b WHERE role = 'assistant' GROUP BY conv, pos
  UNION ALL SELECT conv, pos, row_number() OVER (PARTITION BY conv, pos ORDER BY k) - 1, 'tool', substr(spaced, 1, 2000), '' FROM b WHERE role <> 'assistant' AND kind = 'tool_result'
)
SELECT conv, pos, CAST(part AS INTEGER) AS part, role, commands, sha256(text) AS sha FROM m QUALIFY row_number() OVER (PARTITION BY conv ORDER BY pos DESC, part DESC) <= 5""",
    "parse_transcript_full": f"""WITH {_FULL}
SELECT conv, pos, CAST(part AS INTEGER) AS part, role, reasoning, commands, sha256(text) AS sha FROM m""",
    # The pending assistant, carried from message to message by recursion.
    "paired_steps": f"""WITH RECURSIVE {_FULL},
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY pos, part) AS n FROM m WHERE role IN ('assistant', 'user', 'tool')),
w AS (SELECT conv, 0::BIGINT AS n, false AS hit, false AS held, '' AS cmd, '' AS said, '' AS reasoning, '' AS cmd2, '' AS said2, '' AS reasoning2, '' AS obs FROM o WHERE n = 1
  UNION ALL SELECT o.conv, o.n, o.role <> 'assistant' AND w.held, o.role = 'assistant', CASE o.role WHEN 'assistant' THEN replace(o.commands, ';', ' ; ') END, CASE o.role WHEN 'assistant' THEN o.text END, CASE o.role WHEN 'assistant' THEN o.reasoning END, w.cmd, w.said, w.reasoning, o.text FROM w JOIN o ON o.conv = w.conv AND o.n = w.n + 1)
SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY n) - 1 AS step, cmd2 AS cmd, reasoning2 AS reasoning, sha256(obs) AS obs, sha256(said2) AS said FROM w WHERE hit""",
    "observed_steps": f"""WITH {_FULL},
o AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN replace(commands, ';', ' ; ') END IGNORE NULLS) OVER (PARTITION BY conv ORDER BY pos, part) AS cmd FROM m WHERE role IN ('assistant', 'user', 'tool')),
n AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY pos, part) - 1 AS step FROM o WHERE role <> 'assistant')
SELECT conv, step, CASE WHEN step > 0 THEN coalesce(cmd, '') ELSE '' END AS cmd, sha256(CASE WHEN step > 0 THEN text ELSE '' END) AS obs FROM n""",
    "parse_rollout": "SELECT conv_id AS conv, turn AS pos, CASE WHEN turn % 4 = 3 THEN 'assistant' WHEN turn % 4 = 2 THEN 'tool' ELSE role END AS role, sha256(CASE WHEN turn % 4 = 3 THEN 'shell {\"n\":' || turn || '}' ELSE text END) AS sha FROM conversations WHERE turn <> 5 AND (turn % 4 IN (2, 3) OR role <> 'system')",
    "to_internal": "WITH m AS (SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, turn, role, text FROM conversations WHERE role <> 'system') SELECT conv, CAST(k + conv % 2 AS INTEGER) AS idx, CASE WHEN turn = 2 THEN 'user' ELSE role END AS role, CASE WHEN role <> 'assistant' THEN 0 WHEN turn % 4 = 3 THEN 2 ELSE 1 END AS n_calls, CASE WHEN role = 'assistant' THEN CASE WHEN turn = 0 THEN 'cat /r/0' ELSE 'sed -n ''' || turn || ',' || turn + 1999 || 'p'' /r/' || turn END || CASE WHEN turn % 4 = 3 THEN '; grep ''it s ' || turn || '''' ELSE '' END ELSE '' END AS commands, CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN 'it''s ' || turn ELSE '' END AS queries, sha256(coalesce(text, '')) AS sha FROM m UNION ALL SELECT DISTINCT conv, 0, 'system', 0, '', '', sha256('be brief') FROM m WHERE conv % 2 = 1",
    "protected_mask": "WITH m AS (SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, turn, role FROM conversations WHERE role <> 'system') SELECT conv, CAST(k + conv % 2 AS INTEGER) AS idx, role = 'assistant' OR turn % 4 <> 1 AS protected FROM m UNION ALL SELECT DISTINCT conv, 0, false FROM m WHERE conv % 2 = 1",
    "response_usage": f"""WITH e AS (SELECT user_id AS request, event_id AS seq, {_V} AS v, event_id % 5 AS n, event_type FROM events),
l AS (SELECT request, seq, CASE n WHEN 0 THEN ' data: {{"type":"response.completed","response":{{"usage":' || CASE WHEN v % 4 = 0 THEN 'null' ELSE '{{"input_tokens":' || v || ',"input_tokens_details":{{"cached_tokens":' || v % 7000 - 50 || '}},"output_tokens":' || v % 13 || '}}' END || '}}}} ' WHEN 1 THEN 'data: [DONE]' WHEN 2 THEN 'data:{{"type":"response.' || event_type || '"}}' WHEN 3 THEN 'event: x' ELSE 'data: {{broken' END AS line FROM e),
p AS (SELECT *, CASE WHEN starts_with(trim(line), 'data:') AND json_valid(trim(substr(trim(line), 6))) THEN trim(substr(trim(line), 6)) END AS j FROM l),
t AS (SELECT *, CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.type') = 'VARCHAR' THEN j->>'$.type' END AS type FROM p),
u AS (SELECT request, json_extract(j, '$.response.usage') AS u FROM t WHERE type = 'response.completed' AND json_type(j, '$.response.usage') = 'OBJECT' QUALIFY row_number() OVER (PARTITION BY request ORDER BY seq DESC) = 1),
k AS (SELECT request, CAST(u->>'$.input_tokens' AS BIGINT) AS given, CAST(u->>'$.input_tokens_details.cached_tokens' AS BIGINT) AS cached, CAST(u->>'$.output_tokens' AS BIGINT) AS out FROM u),
y AS (SELECT request, string_agg(type, ',' ORDER BY f) AS types FROM (SELECT request, type, min(seq) AS f FROM t WHERE type IS NOT NULL GROUP BY request, type QUALIFY row_number() OVER (PARTITION BY request ORDER BY min(seq)) <= 24) GROUP BY 1),
r AS (SELECT DISTINCT request FROM l), b AS (SELECT r.request, given, out, types, least(greatest(coalesce(cached, 0), 0), greatest(coalesce(given, 0), 0)) AS hit FROM r LEFT JOIN k ON k.request = r.request LEFT JOIN y ON y.request = r.request)
SELECT request, coalesce(given, 0) - hit AS input, hit AS cache_read, coalesce(out, 0) AS output, given IS NOT NULL AS seen, coalesce(types, '') AS types FROM b""",
    "ledger_scan": f"SELECT CAST(event_id AS VARCHAR) AS request_id, user_id AS session_id, CASE WHEN event_id % 7 <> 0 THEN {_V} END AS cf, {_V} % 1000 AS billed FROM events WHERE event_id % 4 <> 0 AND event_id % 9 <> 0",
    "score_memo": "WITH m AS (SELECT user_id AS conv, event_id AS seq, CASE WHEN event_id % 40 < 20 THEN 'a' ELSE 'b' END AS checkpoint, CAST(floor(value) AS BIGINT) AS score FROM events WHERE CAST(floor(value) AS BIGINT) % 6 <> 0), l AS (SELECT conv, arg_max(checkpoint, seq) AS c FROM m GROUP BY 1), b AS (SELECT m.conv, max(seq) AS brk FROM m JOIN l ON l.conv = m.conv AND l.c <> m.checkpoint GROUP BY 1) SELECT m.* FROM m LEFT JOIN b ON b.conv = m.conv WHERE seq > coalesce(brk, -1) QUALIFY row_number() OVER (PARTITION BY m.conv ORDER BY seq DESC) <= 7",
    "visibility_merge": "WITH r AS (SELECT DISTINCT l_suppkey % 10 AS session, 'f' || CAST(l_partkey % 50 AS VARCHAR) || '.py' AS base, CAST(l_quantity AS BIGINT) AS lo FROM lineitem) SELECT session, base, count(*) AS n, max(lo) AS last_lo FROM r GROUP BY 1, 2",
    "sse_usage": f"WITH f AS (SELECT user_id AS request, event_id AS seq, event_type AS type, {_V} AS v, event_id % 10 <> 0 AS ok FROM events) SELECT request, arg_max(v, seq) FILTER (ok AND seq % 2 = 0) AS input_tokens, arg_max(v + 1, seq) FILTER (ok) AS output_tokens, arg_max(v % 50, seq) FILTER (ok AND v % 3 = 0) AS cache_read_input_tokens, arg_max(v % 70, seq) FILTER (ok AND v % 5 = 0) AS cache_creation_input_tokens, array_to_string(list_sort(list(DISTINCT type))[1:24], ',') AS types FROM f GROUP BY 1",
}
