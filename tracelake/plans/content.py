"""Queries over message content, tool lists, reads and answers, on shapes made from the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import content as c
from ..operators import content as ops
from ..operators import ranges
from ..sources import derived
from .sql import _RANGES

_text = lambda: F.coalesce(F.col("text"), F.lit(""))
_n = lambda: F.col("turn").cast("string")


def _v(json):
    return F.try_parse_json(json)


def _json(text):
    """A text as a JSON string."""
    held = F.to_json(F.struct(text.alias("t")))
    return F.substring(held, F.lit(6), F.char_length(held) - 6)


def _pick(n, *cases):
    out = F.when(n == 0, cases[0])
    for i, case in enumerate(cases[1:], 1):
        out = out.when(n == i, case)
    return out


def _filled(template: str, *values):
    """The template with each `@` replaced by the next value."""
    first, *rest = template.split("@")
    return F.concat(F.lit(first), *[x for v, r in zip(values, rest) for x in (v, F.lit(r))])


def _content(marked: bool = True):
    t = _json(_text())
    mark = ',"cache_control":{"ttl":"1h"}' if marked else ""
    order = '{"text":@,"type":"text"' if marked else '{"type":"text","text":@'
    return _pick(
        F.col("turn") % 4, t, _filled("[" + order + mark + '},{"type":"image"},{"type":"text","text":"end"}]', t),
        _filled('[{"type":"tool_result","content":[{"type":"text","text":@' + mark + '},{"type":"text","text":"x"}]},{"type":"text","text":""}]', t), _filled('[{"type":"tool_result","content":@},7]', t),
    )


def _sha(text, name):
    return F.sha2(text, 256).alias(name)


def _content_texts(m: DataFrame) -> DataFrame:
    kind = _pick(F.col("turn") % 4, F.lit('"type":"message",'), F.lit(""), F.lit('"type":"function_call_output",'), F.lit('"type":"reasoning",'))
    item = _filled('{@"role":@,"content":[{"type":"input_text","text":@},{"type":"refusal","text":"no"}],"output":@}', kind, _json(F.col("role")), _json(_text()), _json(F.concat(_text(), F.lit("o"))))
    d = m.select("conv_id", "turn", _v(_content()).alias("v"), _v(item).alias("item"))
    return d.select("conv_id", "turn", _sha(c.content_text(F.col("v")), "content"), _sha(c.system_text(F.col("v")), "system"), _sha(c.item_text(F.col("item")), "item"), c.protected_item(F.col("item")).alias("protected"))


def _content_keys(m: DataFrame) -> DataFrame:
    d = m.select("conv_id", "turn", _v(_content()).alias("v"), _v(_content(marked=False)).alias("w"))
    return d.select("conv_id", "turn", c.content_key(F.col("v")).alias("key"), (c.content_key(F.col("v")) == c.content_key(F.col("w"))).alias("same"))


def _actions(m: DataFrame) -> DataFrame:
    t = _json(_text())
    message = _pick(
        F.col("turn") % 5, _filled('{"content":@,"extra":{"actions":[{"command":"run @"},{"command":"","query":"q"},{}]}}', t, _n()),
        _filled('{"content":@,"tool_calls":[{"function":{"arguments":"{\\"command\\":\\"ls @\\"}"}},{"function":{"arguments":"not json"}},{"function":{"arguments":[1]}},{}]}', t, _n()),
        _filled('{"content":"see\\n```bash\\nmake @\\n```"}', _n()), _filled('{"content":@,"extra":{"actions":[{"command":5}]}}', t), _filled('{"content":@}', t),
    )
    return m.select("conv_id", "turn", _sha(c.action_text(_v(message)), "action"))


def _reasoning(m: DataFrame) -> DataFrame:
    message = _pick(
        F.col("turn") % 3, _filled('{"reasoning_content":@}', _json(_text())),
        F.lit('{"thinking_blocks":[{"t":"abcdefgh"}],"extra":{"actions":[{"command":"a"},{"command":""},{"query":"b"}]},"tool_calls":[{"provider_specific_fields":{"k":"v12345"}},{"provider_specific_fields":null}]}'), F.lit("{}"),
    )
    d = m.select("conv_id", "turn", _v(message).alias("v"))
    return d.select("conv_id", "turn", c.blob_tokens(F.col("v")).alias("tokens"), _sha(c.reasoning_text(F.col("v")), "sha")).filter("tokens > 0")


def _faults(m: DataFrame) -> DataFrame:
    message = _pick(F.col("turn") % 4, F.lit('{"content":[{"type":"text","text":5}]}'), F.lit('{"extra":{"actions":["x"]}}'), F.lit('{"extra":{"actions":[{"command":[1]}]}}'), _filled('{"content":[{"text":@}],"extra":{"actions":[{"command":0}]}}', _json(_text())))
    return m.select("conv_id", "turn", c.fault(_v(message)).alias("fault"))


def _requests(m: DataFrame) -> DataFrame:
    d = m.select(F.col("conv_id").alias("conv")).distinct()
    system = _pick(F.col("conv") % 3, F.lit('[{"type":"text","text":"a","cache_control":{"ttl":"1h"}}]'), F.lit('"Generate a CONCISE session Title"'), F.lit('"b"'))
    body = _filled('{"stream":true,"system":@,"model":"m@","max_tokens":1,"messages":[{"role":"user","content":[{"type":"text","text":"a","cache_control":{"ttl":"5m"}}]}]}', system, F.col("conv").cast("string"))
    v = F.col("v")
    none = F.array().cast("array<variant>")
    blocks = F.concat(F.coalesce(c.get(v, "$.system", "array<variant>"), none), F.flatten(F.transform(c.get(v, "$.messages", "array<variant>"), lambda x: F.coalesce(c.get(x, "$.content", "array<variant>"), none))))
    d = d.select("conv", _v(body).alias("v"))
    return d.select("conv", c.metadata_call(c.system_text(c.get(v, "$.system", "variant"))).alias("metadata"), c.cache_ttl(blocks).alias("ttl"), c.counted_body(v).alias("counted"))


def _rosters(m: DataFrame) -> DataFrame:
    d = m.select(F.col("conv_id").alias("conv")).distinct()
    tools = _filled('[{"name":"a","description":"d1","input_schema":{"z":1,"b":2}},{"function":{"name":"b","parameters":{"y":@,"c":0}}},{"name":"a","description":"d@"},{"name":""},7,{"type":"web","name":"w","input_schema":{}}]', F.col("conv").cast("string"), F.col("conv").cast("string"))
    return d.select("conv", c.get(_v(tools), "$", "array<variant>").alias("tools"))


def _read_inputs(e: DataFrame) -> DataFrame:
    n = (F.col("event_id") % 10).cast("string")
    path = _pick(F.col("event_id") % 5, _filled("../a/./b@.py", n), _filled("'C:\\\\q\\\\r@.py'", n), F.lit("/tmp/x.py"), F.lit("m.patch"), _filled(" /s//../t@.py", n))
    args = _filled('{"file_path":"@"@@}', path, F.when(F.col("event_id") % 2 == 0, _filled(',"offset":@', n)).otherwise(""), F.when(F.col("event_id") % 3 == 0, F.lit(',"limit":20')).otherwise(""))
    r = c.read_range(_v(args), F.lit("/w/x/"))
    return e.select("event_id", r.alias("r")).filter("r IS NOT NULL").select("event_id", "r.*")


def _reads(d: DataFrame) -> DataFrame:
    g = F.col("gi") % 40
    n = lambda x: F.when(g != 7, x)
    return ranges.derived_ranges(d).select("conv", "file", n(F.when(g == 9, 1).otherwise(F.col("lo"))).cast("long").alias("lo"), n(F.when(g == 9, 1_000_000_000).otherwise(F.col("hi"))).cast("long").alias("hi"), F.when(g == 7, F.col("tokens") % 3).cast("long").alias("tail"))


_f = lambda: F.floor("value").cast("long")
_conv = lambda: F.floor(F.col("vec_id") / 40).cast("long").alias("conv")


def _pooled(e: DataFrame) -> DataFrame:
    d = ops.pooled(e.select(_conv(), F.col("embedding").cast("array<double>").alias("v"), F.array(*[F.lit(float(x)) for x in range(4)]).alias("state")))
    return d.select("conv", F.size("pooled").alias("n"), F.round(F.get("pooled", 0), 6).alias("first"), F.get("pooled", F.size("pooled") - 1).alias("last"))


def _parity(e: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    moved = F.transform(v, lambda x, i: F.when((F.col("vec_id") % 10 == 0) & (i == 0), x + 1).otherwise(x))
    return ops.parity(e.select(F.col("vec_id").alias("id"), v.alias("v")), e.filter("vec_id % 7 <> 0").select(F.col("vec_id").alias("id"), moved.alias("v")))


def _rule_answers(e: DataFrame) -> DataFrame:
    asked = e.select(F.col("user_id").alias("conv"), (F.col("event_id") % 3).alias("fire_step"), F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("eid"), _f().alias("p_q"))
    d = ops.rule_answers(asked, e.filter("event_id % 2 = 0").select(F.col("event_id").alias("eid"), F.col("event_type").alias("text")))
    return d.select("conv", "fire_step", "n_scores", F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["eid"], r["text"], r["p_q"])), ",").alias("rules"))


def _folded(e: DataFrame) -> DataFrame:
    tau = F.when(F.col("event_type") != "click", F.length("event_type") * 50_000)
    q = c.on_grid(_f() / 100)
    return e.select("event_id", c.folded_score(q, tau, F.lit(500_000)).alias("score_q"))


def _trace_faults(e: DataFrame) -> DataFrame:
    n = F.col("event_id")
    d = e.select(
        n.alias("conv"), F.when(n % 11 != 0, "k").alias("checkpoint"), F.lit(5).alias("n_nodes"), F.array(n % 6, F.lit(2)).alias("mask"),
        F.when(n % 7 == 0, F.array(F.lit(49))).otherwise(F.array(F.lit(49), F.when(n % 5 == 0, 48).otherwise(49))).alias("widths"), F.array(F.struct(F.lit(0).alias("a"), (n % 4 * 2).alias("b"))).alias("edges"),
    )
    return ops.trace_faults(d, 49, "k")


def _payloads(e: DataFrame) -> DataFrame:
    d = e.select((F.col("user_id") % 20).alias("project"), F.when(F.col("event_id") % 2 == 0, "x").otherwise("y").alias("tool"), F.col("event_id").alias("id"), (F.col("event_id") * 10).alias("at"), F.when(F.col("event_id") % 5 == 0, "v0").otherwise("v1").alias("version"), (_f() % 2).alias("ask"))
    return ops.taken_payloads(d.filter("ask = 0"), d.filter("ask = 1").drop("version"), "v1", 600)


def _paths(p: DataFrame) -> DataFrame:
    return p.select((F.col("page_id") % 5).alias("repo"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1).alias("path"))


QUERIES = {
    "content_text": ("conversations", None, _content_texts),
    "content_key": ("conversations", None, _content_keys),
    "action_text": ("conversations", None, _actions),
    "reasoning_chunks": ("conversations", None, _reasoning),
    "message_faults": ("conversations", None, _faults),
    "request_kinds": ("conversations", None, _requests),
    "tool_schemas": ("conversations", _rosters, ops.tool_schemas),
    "tool_stubs": ("conversations", _rosters, lambda d: ops.tool_stubs(d).join(ops.roster_keys(d), "conv")),
    "read_inputs": ("events", None, _read_inputs),
    "described_reads": ("lineitem", _reads, ops.described_reads),
    "detect_package": ("pages", _paths, ops.package),
    "doom_pool": ("embeddings", None, _pooled),
    "parity_gate": ("embeddings", None, _parity),
    "rule_answers": ("events", None, _rule_answers),
    "gate_answers": ("events", None, lambda e: ops.gate_answers(e.select(F.col("event_id").alias("conv"), F.when(F.col("event_id") % 6 != 0, _f() * 10_000).alias("score_q")))),
    "fold_kind_tau": ("events", None, _folded),
    "trace_faults": ("events", None, _trace_faults),
    "lifetime": ("events", None, lambda e: ops.lifetime(e.select(F.when(F.col("event_id") % 3 == 0, _f()).alias("blocked"), _f().alias("tokens"), (_f() % 2).alias("loops")))),
    "memo_compact": ("events", derived.memo_rows, lambda d: ops.compacted(d, cap=2)),
    "unexpired": ("events", None, lambda e: ops.unexpired(e.select("event_id", F.col("event_id").alias("touched")), F.lit(1000), 300)),
    "taken_payloads": ("events", None, _payloads),
}

_T = "coalesce(text, '')"
_F = "CAST(floor(value) AS BIGINT)"
_MEMO = f"(SELECT user_id AS conv, event_id AS seq, CASE WHEN event_id % 40 < 20 THEN 'a' ELSE 'b' END AS checkpoint, CASE WHEN {_F} % 6 <> 0 THEN {_F} END AS score FROM events)"
_J = f"to_json({_T})"
SQL = {
    "content_text": f"""SELECT conv_id, turn, sha256(CASE turn % 4 WHEN 1 THEN CASE WHEN {_T} = '' THEN 'end' ELSE text || ' end' END WHEN 2 THEN {_T} || ' x' ELSE {_T} END) AS content,
sha256(CASE turn % 4 WHEN 0 THEN {_T} WHEN 1 THEN {_T} || chr(10) || 'end' ELSE '' END) AS system, sha256(CASE turn % 4 WHEN 2 THEN {_T} || 'o' WHEN 3 THEN '' ELSE {_T} END) AS item, turn % 4 < 2 AND coalesce(role, '') <> 'system' AS protected FROM conversations""",
    "content_key": f"""SELECT conv_id, turn, true AS same, sha256(CASE turn % 4 WHEN 0 THEN {_J} WHEN 1 THEN '[{{"text":' || {_J} || ',"type":"text"}},{{"type":"image"}},{{"text":"end","type":"text"}}]'
WHEN 2 THEN '[{{"content":[{{"text":' || {_J} || ',"type":"text"}},{{"text":"x","type":"text"}}],"type":"tool_result"}},{{"text":"","type":"text"}}]' ELSE '[{{"content":' || {_J} || ',"type":"tool_result"}},7]' END) AS key FROM conversations""",
    "action_text": f"SELECT conv_id, turn, sha256(CASE turn % 5 WHEN 0 THEN 'run ' || turn || ' ; q ; ' WHEN 1 THEN 'ls ' || turn || ' ; not json ; ' WHEN 2 THEN 'make ' || turn ELSE {_T} END) AS action FROM conversations",
    "reasoning_chunks": f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN length({_T}) // 4 ELSE 7 END AS tokens, sha256(CASE WHEN turn % 3 = 1 THEN 'a ; b' WHEN trim({_T}) = '' THEN 'reasoning' ELSE left(text, 2000) END) AS sha FROM conversations WHERE turn % 3 = 1 OR (turn % 3 = 0 AND length({_T}) >= 4)",
    "message_faults": "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'action' WHEN 2 THEN 'command' END AS fault FROM conversations",
    "request_kinds": """SELECT conv_id AS conv, conv_id % 3 = 1 AS metadata, CASE WHEN conv_id % 3 = 0 THEN '1h' ELSE '5m' END AS ttl, '{"messages":[{"content":[{"cache_control":{"ttl":"5m"},"text":"a","type":"text"}],"role":"user"}],"model":"m' || conv_id || '","system":' || CASE conv_id % 3 WHEN 0 THEN '[{"cache_control":{"ttl":"1h"},"text":"a","type":"text"}]' WHEN 1 THEN '"Generate a CONCISE session Title"' ELSE '"b"' END || '}' AS counted FROM (SELECT DISTINCT conv_id FROM conversations)""",
    "tool_schemas": """WITH t AS (SELECT DISTINCT conv_id AS conv FROM conversations), r AS (SELECT conv, 0 AS pos, 'a' AS name, '{"description":"d' || conv || '","name":"a","parameters":{}}' AS text FROM t UNION ALL SELECT conv, 1, 'b', '{"description":"","name":"b","parameters":{"c":0,"y":' || conv || '}}' FROM t UNION ALL SELECT conv, 5, 'w', '{"description":"","name":"w","parameters":{}}' FROM t) SELECT *, length(text) // 4 AS tokens FROM r""",
    "tool_stubs": f"SELECT DISTINCT conv_id AS conv, 0 AS pos, 'a' AS name, 'd1' || chr(10) || chr(10) || '{c.STUB_NOTE}' AS description, left(sha256(array_to_string(['', 'a', 'a', 'w'], chr(10))), 8) AS roster FROM conversations",
    "read_inputs": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '/w/a/b' WHEN 1 THEN '/C:/q/r' ELSE '/t' END || event_id % 10 || '.py' AS path, lo, CASE WHEN event_id % 3 = 0 THEN lo + 19 ELSE 1000000000 END AS hi FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id % 10 ELSE 1 END AS lo FROM events) WHERE event_id % 5 NOT IN (2, 3)",
    "described_reads": f"""WITH {_RANGES}, q AS (SELECT conv, file, CASE WHEN gi % 40 = 9 THEN 1 WHEN gi % 40 <> 7 THEN lo END AS lo, CASE WHEN gi % 40 = 9 THEN 1000000000 WHEN gi % 40 <> 7 THEN hi END AS hi, CASE WHEN gi % 40 = 7 THEN tokens % 3 END AS tail FROM r)
, o AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY conv, file ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM q WHERE hi < 1000000000)
, i AS (SELECT *, sum(fresh) OVER (PARTITION BY conv, file ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM o), m AS (SELECT conv, file, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY conv, file, island)
, l AS (SELECT conv, file, string_agg('L' || lo || '-' || hi, ', ' ORDER BY lo) AS ls FROM m GROUP BY 1, 2), t AS (SELECT conv, file, string_agg('last ' || tail || ' lines', ', ' ORDER BY tail) AS ts FROM (SELECT DISTINCT conv, file, tail FROM q WHERE tail IS NOT NULL) GROUP BY 1, 2)
, w AS (SELECT conv, file, bool_or(coalesce(hi = 1000000000, false)) AS whole FROM q GROUP BY 1, 2)
SELECT w.conv, w.file, whole, CASE WHEN whole THEN 'the entire file' ELSE coalesce(nullif(concat_ws(', ', ls, ts), ''), '(read)') END AS text FROM w LEFT JOIN l ON l.conv = w.conv AND l.file = w.file LEFT JOIN t ON t.conv = w.conv AND t.file = w.file""",
    "detect_package": "WITH p AS (SELECT page_id % 5 AS repo, string_split(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/') AS s FROM pages), n AS (SELECT repo, s[1] AS top, count(*) AS n FROM p WHERE len(s) > 1 AND s[1] NOT IN (" + ", ".join(f"'{d}'" for d in ops.NO_PACKAGE) + ") GROUP BY 1, 2), b AS (SELECT repo, top FROM n QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, top DESC) = 1) SELECT p.repo, coalesce(any_value(top), '.') AS package FROM p LEFT JOIN b ON b.repo = p.repo GROUP BY 1",
    "doom_pool": "SELECT vec_id // 40 AS conv, max(len(embedding)) + 4 AS n, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS first, CAST(3 AS DOUBLE) AS last FROM embeddings GROUP BY 1",
    "parity_gate": "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), k AS (SELECT id, CASE WHEN id % 7 <> 0 THEN list_cosine_similarity(v, CASE WHEN id % 10 = 0 THEN list_concat([v[1] + 1], v[2:]) ELSE v END) END AS s FROM e) SELECT id, round(s, 9) AS cosine, coalesce(s >= 0.9999, false) AS passed FROM k",
    "rule_answers": f"SELECT user_id AS conv, event_id % 3 AS fire_step, count(*) FILTER (event_id % 4 <> 0) AS n_scores, coalesce(string_agg(event_id || ':' || event_type || ':' || {_F}, ',' ORDER BY event_id) FILTER (event_id % 4 = 2), '') AS rules FROM events GROUP BY 1, 2",
    "gate_answers": f"SELECT event_id AS conv, CASE WHEN event_id % 6 <> 0 THEN {_F} * 10000 ELSE 1000000 END AS score_q, event_id % 6 = 0 OR {_F} * 10000 >= 500000 AS fire, event_id % 6 = 0 AS fail_open FROM events",
    "fold_kind_tau": f"SELECT event_id, CASE WHEN event_type = 'click' THEN 1000000 ELSE greatest(0, least(1000000, {_F} * 10000 - length(event_type) * 50000 + 500000)) END AS score_q FROM events",
    "trace_faults": "SELECT event_id AS conv, CASE WHEN event_id % 11 = 0 THEN 409 WHEN event_id % 6 = 5 OR event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 4 = 3 THEN 422 ELSE 200 END AS status FROM events",
    "lifetime": f"SELECT sum(CASE WHEN event_id % 3 = 0 THEN {_F} ELSE 0 END)::BIGINT AS blocked, sum({_F})::BIGINT AS tokens, sum({_F} % 2)::BIGINT AS loops FROM events",
    "memo_compact": f"SELECT * FROM {_MEMO} QUALIFY count(*) OVER (PARTITION BY conv) <= 8 OR row_number() OVER (PARTITION BY conv ORDER BY seq DESC) <= 2",
    "unexpired": "SELECT event_id, event_id AS touched FROM events WHERE event_id >= 700",
    "taken_payloads": f"""WITH p AS (SELECT user_id % 20 AS project, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE 'y' END AS tool, event_id AS id, {_F} % 2 AS ask FROM events), n AS (SELECT a.*, (SELECT arg_min({{'id': b.id, 'ask': b.ask}}, b.id) FROM p b WHERE b.project = a.project AND b.tool = a.tool AND b.id > a.id) AS nx FROM p a WHERE a.ask = 0)
SELECT project, tool, id, CASE WHEN nx.ask = 1 AND id % 5 <> 0 AND (nx.id - id) * 10 <= 600 THEN nx.id END AS ask FROM n""",
}
