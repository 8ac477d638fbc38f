"""DuckDB SQL that gives the rows of the queries in registry.py."""

_STEPS = """steps AS (SELECT conv_id, turn, role, text, step, n_obs, coalesce(role IN ('user', 'tool') AND step = 0, false) AS is_task, max(CASE WHEN role = 'assistant' THEN step END) OVER (PARTITION BY conv_id) AS tail_lo
FROM (SELECT *, CAST(count(*) FILTER (role IN ('user', 'tool')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS step, count(*) FILTER (role IN ('user', 'tool')) OVER (PARTITION BY conv_id) AS n_obs FROM conversations))"""

_CHUNKS = _STEPS + """, lines AS (SELECT conv_id, turn, step, tail_lo, CASE WHEN role = 'assistant' THEN 'asst' ELSE 'other' END AS kind, unnest(ls) AS line, unnest(range(len(ls))) AS line_no
FROM (SELECT *, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS ls FROM (SELECT *, string_split(text, chr(10)) AS p FROM steps WHERE role <> 'system' AND NOT is_task AND step < n_obs)))
, chunks AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY step, kind = 'asst', turn, win) - 1 AS BIGINT) AS gi, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens
FROM (SELECT conv_id, turn, step, tail_lo, kind, CAST(line_no // 40 AS BIGINT) AS win, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY ALL) WHERE trim(text) <> '')
"""


def _grid(step: str, kind: str) -> str:
    return f"CAST(CAST(('0x' || substr(sha256(CAST({step} AS VARCHAR) || ':' || {kind} || ':' || text), 1, 16)) AS UBIGINT) % 1000000 AS BIGINT)"


_CUT = _CHUNKS + f""", scored AS (SELECT *, {_grid("step", "kind")} AS score_q FROM chunks)
, marked AS (SELECT *, bool_or(score_q < 700000 AND step < coalesce(tail_lo, 0)) OVER (PARTITION BY conv_id, turn, kind, text) AS cut FROM scored)
, runs AS (SELECT *, gi - row_number() OVER (PARTITION BY conv_id, turn ORDER BY gi) AS run FROM marked WHERE cut)
, cuts AS (SELECT * FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id, turn, run) AS BIGINT) AS run_tokens FROM runs) WHERE run_tokens >= 10)
"""

_RANGES = """r AS (SELECT conv, step, file, lo, hi, tokens, CAST(row_number() OVER (PARTITION BY conv ORDER BY step, ln, lo, file) - 1 AS BIGINT) AS gi FROM (
SELECT l_suppkey AS conv, l_orderkey AS step, CAST(l_linenumber AS BIGINT) AS ln, 'f' || CAST(l_partkey % 50 AS VARCHAR) || '.py' AS file, CAST(l_quantity AS BIGINT) AS lo, CAST(l_quantity AS BIGINT) + 9 AS hi, CAST(trunc(l_extendedprice) AS BIGINT) % 200 AS tokens FROM lineitem))
, met AS (SELECT a.*, b.gi AS gi2, b.step AS step2, (least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1) / CAST(a.hi - a.lo + 1 AS DOUBLE) AS share FROM r a JOIN r b ON a.conv = b.conv AND a.file = b.file AND a.gi <> b.gi AND a.lo <= b.hi AND b.lo <= a.hi)
"""

_LEDGER = """led AS (SELECT event_id, ts, user_id AS session_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS tool, CASE WHEN event_id % 5 <> 0 THEN 'm' || CAST(event_id % 3 AS VARCHAR) END AS model,
CASE WHEN event_id % 7 <> 0 THEN v END AS cf, CAST(floor(v * 3 / CAST(4 AS DOUBLE) + event_id % 13) AS BIGINT) AS billed, v % 97 AS cache_read, v % 31 AS cache_write, event_id % 17 = 0 AS fail_open, user_id * 10 + event_id % 3 AS conv_id, CASE WHEN event_id % 9 <> 0 THEN v % 53 END AS freeze_cut
FROM (SELECT *, CAST(floor(value * 100) AS BIGINT) AS v FROM events))
"""

_COMMANDS = """c AS (SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS BIGINT) AS seq FROM (
SELECT user_id AS session, event_id, ts, event_type || ' ' || CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) AS cmd, event_type = 'purchase' AS edit FROM events))
, d AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY session, cmd ORDER BY seq) > 1 THEN 1.0 ELSE 0.0 END AS dup FROM c)
, l AS (SELECT *, avg(CAST(dup AS DOUBLE)) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS lf FROM d)
, f AS (SELECT session, seq, lf, avg(lf) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean3, lf - coalesce(lag(lf, 3) OVER (PARTITION BY session ORDER BY seq), first_value(lf) OVER (PARTITION BY session ORDER BY seq)) AS delta,
avg(CASE WHEN lf >= 0.34 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS low6, seq >= 6 AND lf >= 0.5 AND min(lf) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 0.34 AS mech FROM l)
"""

_NEAR = """u AS (SELECT vec_id, label, list_transform(v, lambda x: x / n) AS v FROM (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)) WHERE n > 0)
, n AS (SELECT q.vec_id AS query, u.vec_id AS neighbour, u.label, round(list_sum(list_transform(range(1, len(u.v) + 1), lambda i: q.v[i] * u.v[i])), 9) AS score FROM u JOIN u q ON q.vec_id <> u.vec_id)
, k AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour DESC) AS INTEGER) AS rank FROM n) WHERE rank <= 16)
"""

_TAU = """t AS (SELECT lang AS kind, doc_id AS id, doc_id * 7919 % 1000000 AS score, quality AS needed, CAST(n_chars // 4 AS BIGINT) AS tokens FROM documents JOIN labels USING (doc_id))
"""

_PRE = "ROWS BETWEEN UNBOUNDED PRECEDING AND"

SQL: dict[str, str] = {
    "hourly_ledger": f"WITH {_LEDGER} SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n, CAST(sum(cf) AS BIGINT) AS cf, CAST(sum(billed) AS BIGINT) AS billed FROM led GROUP BY 1",
    "cut_summary": f"WITH {_CUT} SELECT m.conv_id, m.n_messages, m.mass, CAST(coalesce(t, 0) AS BIGINT) AS cut_tokens, CAST(coalesce(k, 0) AS BIGINT) AS cut_chunks FROM (SELECT conv_id, count(*) AS n_messages, CAST(sum(length(text) // 4) AS BIGINT) AS mass FROM conversations GROUP BY 1) m LEFT JOIN (SELECT conv_id, sum(tokens) AS t, count(*) AS k FROM cuts GROUP BY 1) USING (conv_id)",
    "trace_steps": f"WITH {_STEPS} SELECT conv_id, turn, step, is_task, tail_lo FROM steps",
    "chunk_other": f"WITH {_CHUNKS} SELECT conv_id, gi, turn, step, kind, win, tokens, sha256(text) AS sha FROM chunks",
    "chunk_checksum": f"WITH {_CHUNKS} SELECT conv_id, count(*) AS n_chunks, sha256(string_agg(CAST(step AS VARCHAR) || ':' || kind || ':' || CAST(tokens AS VARCHAR), chr(10) ORDER BY gi)) AS checksum FROM chunks GROUP BY 1",
    "stub_score": f"SELECT conv_id, turn, {_grid('turn', 'role')} AS score_q FROM conversations",
    "budget_cut": f"WITH {_CUT} SELECT conv_id, gi, score_q, tokens, run_tokens FROM cuts",
    "internal_mass": "SELECT conv_id, CAST(sum(length(text) // 4) AS BIGINT) AS mass, count(*) AS n_messages FROM conversations GROUP BY 1",
    "struct_features": f"""WITH {_CHUNKS}, w AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id, step) AS obs, sum(tokens) OVER (PARTITION BY conv_id) AS total, max(step) OVER (PARTITION BY conv_id) AS last, max(step) OVER (PARTITION BY conv_id, text) AS newest, count(*) OVER (PARTITION BY conv_id, text ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS copies FROM chunks)
SELECT conv_id, gi, round(ln(1 + CAST(obs AS DOUBLE)) / 8, 9) AS log_obs, round(tokens / CAST(obs AS DOUBLE), 9) AS obs_share, last - step AS age, round(ln(1 + CAST(tokens AS DOUBLE)) / 8, 9) AS log_tokens, CASE WHEN kind = 'asst' THEN 1 ELSE 0 END AS is_asst, CASE WHEN newest > step THEN 1 ELSE 0 END AS superseded, round(least(CAST(1 AS DOUBLE), copies / CAST(5 AS DOUBLE)), 9) AS dup, round(tokens / CAST(total AS DOUBLE), 9) AS token_share, round(CASE WHEN last > 0 THEN step / CAST(last AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 9) AS step_pos, CASE WHEN step = last THEN 1 ELSE 0 END AS is_current FROM w""",
    "struct_causal": f"WITH {_CHUNKS} SELECT conv_id, gi, round(tokens / CAST(sum(tokens) OVER p AS DOUBLE), 9) AS prefix_share, count(*) OVER p AS prefix_chunks, count(*) OVER (PARTITION BY conv_id, text ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_copies, CASE WHEN step > 0 THEN 1 ELSE 0 END AS step_pos FROM chunks WINDOW p AS (PARTITION BY conv_id ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "budget_cum_tok": "WITH a AS (SELECT conv_id, CAST(s AS BIGINT) AS s, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) WHERE s > 0 GROUP BY 1, 2) SELECT conv_id, s, chars, CAST(CASE WHEN count(*) OVER (PARTITION BY conv_id) < 6 THEN 0 ELSE CAST(sum(chars) OVER (PARTITION BY conv_id ORDER BY s) AS BIGINT) // 4 END AS BIGINT) AS cum_tok FROM a",
    "cut_by_role": f"WITH {_CUT} SELECT CASE WHEN role IS NULL THEN '(unrecorded)' WHEN role IN ('user', 'assistant', 'system', 'tool') THEN role ELSE '(other)' END AS role, CAST(sum(t) AS BIGINT) AS cut_tokens, count(*) AS messages FROM conversations JOIN (SELECT conv_id, turn, sum(tokens) AS t FROM cuts GROUP BY 1, 2) USING (conv_id, turn) GROUP BY 1",
    "prefix_len": "WITH p AS (SELECT a.conv_id, a.turn, b.turn IS NULL OR a.role || ':' || a.text <> b.role || ':' || b.text AS differs FROM conversations a JOIN (SELECT DISTINCT conv_id FROM conversations) n ON n.conv_id = a.conv_id + 1 LEFT JOIN conversations b ON b.conv_id = a.conv_id + 1 AND b.turn = a.turn) SELECT conv_id, CAST(coalesce(min(CASE WHEN differs THEN turn END), count(*)) AS BIGINT) AS prefix_len FROM p GROUP BY 1",
    "dup_range": f"WITH {_RANGES} SELECT conv, gi, round(coalesce(s, 0), 9) AS sup, CAST(coalesce(d, 0) AS BIGINT) AS dup FROM r LEFT JOIN (SELECT conv, gi, max(CASE WHEN step2 > step THEN share END) AS s, sum(CASE WHEN step2 < step AND share >= 0.6 THEN 1 ELSE 0 END) AS d FROM met GROUP BY 1, 2) USING (conv, gi)",
    "supersession_edges": f"WITH {_RANGES} SELECT conv, count(*) AS edges, CAST(sum(gi) AS BIGINT) AS src, CAST(sum(gi2) AS BIGINT) AS dst FROM met WHERE step2 > step AND share >= 0.6 GROUP BY 1",
    "rereq_base": f"WITH {_RANGES}, e AS (SELECT *, row_number() OVER (PARTITION BY conv, gi ORDER BY step2 DESC, gi2) AS rn, count(*) OVER (PARTITION BY conv, gi) AS n FROM met WHERE step2 < step) SELECT r.conv, r.gi, CAST(coalesce(n, 0) AS BIGINT) AS prior, e.step2 AS last_step, e.gi2 AS last_gi FROM r LEFT JOIN e ON e.conv = r.conv AND e.gi = r.gi AND e.rn = 1",
    "rereq_events": f"WITH {_RANGES}, e AS (SELECT *, row_number() OVER (PARTITION BY conv, gi ORDER BY step2 DESC, gi2) AS rn, count(*) OVER (PARTITION BY conv, gi) AS n FROM met WHERE step2 < step), p AS (SELECT r.*, coalesce(e.n, 0) AS prior, e.gi2 AS last_gi FROM r LEFT JOIN e ON e.conv = r.conv AND e.gi = r.gi AND e.rn = 1), v AS (SELECT *, CASE WHEN prior > 0 THEN 1 ELSE 0 END AS event FROM p) SELECT v.conv, v.gi, CAST(prior AS BIGINT) AS prior, event, CAST(coalesce(sum(event) OVER f, 0) AS BIGINT) AS same_file, round(ln(1 + CAST(coalesce(sum(event) OVER a, 0) AS DOUBLE)), 9) AS all_events, CASE WHEN c.tokens % 3 = 0 THEN 1 ELSE 0 END AS last_cut FROM v LEFT JOIN r c ON c.conv = v.conv AND c.gi = v.last_gi WINDOW a AS (PARTITION BY v.conv ORDER BY v.step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY v.conv, v.file ORDER BY v.step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "merge_ranges": f"WITH {_RANGES}, n AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY conv, file ORDER BY lo, hi {_PRE} 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM r), i AS (SELECT *, sum(new) OVER (PARTITION BY conv, file ORDER BY lo, hi {_PRE} CURRENT ROW) AS island FROM n) SELECT conv, file, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM i GROUP BY conv, file, island",
    "neighbour_chains": f"WITH {_RANGES} SELECT conv, gi, lead(gi) OVER (PARTITION BY conv, file ORDER BY lo, gi) AS next_in_file, lead(gi) OVER (PARTITION BY conv ORDER BY gi) AS next_in_time FROM r",
    "tool_prune": f"WITH {_RANGES}, p AS (SELECT conv, tokens, coalesce(sum(tokens) OVER (PARTITION BY conv ORDER BY lo, gi {_PRE} 1 PRECEDING), 0) < CAST(0.7 AS DOUBLE) * sum(tokens) OVER (PARTITION BY conv) AS cut FROM r) SELECT conv, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) AS BIGINT) AS pruned, CAST(sum(CASE WHEN cut THEN tokens ELSE 0 END) AS BIGINT) AS pruned_tokens FROM p GROUP BY 1",
    "ledger_totals": f"WITH {_LEDGER} SELECT count(*) AS n_rows, count(cf) AS probed, CAST(sum(CASE WHEN cf IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_probes, CAST(sum(CASE WHEN fail_open THEN 1 ELSE 0 END) AS BIGINT) AS fail_opens, CAST(sum(cf) AS BIGINT) AS cf, CAST(sum(CASE WHEN cf IS NOT NULL THEN billed END) AS BIGINT) AS billed_probed, CAST(sum(cf - billed) AS BIGINT) AS saved, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, count(DISTINCT session_id) AS sessions, count(DISTINCT conv_id) AS conversations, CAST(sum(freeze_cut) AS BIGINT) AS freeze_cut FROM led",
    "ledger_by_model": f"WITH {_LEDGER} SELECT coalesce(model, '(unrecorded)') AS model, count(*) AS n, CAST(sum(cf) AS BIGINT) AS cf, CAST(sum(cf - billed) AS BIGINT) AS saved FROM led WHERE cf IS NOT NULL GROUP BY 1",
    "ledger_by_tool": f"WITH {_LEDGER} SELECT coalesce(tool, '(default)') AS tool, count(*) AS n, count(cf) AS probed, CAST(sum(cf - billed) AS BIGINT) AS saved FROM led GROUP BY 1",
    "session_saved": f"WITH {_LEDGER} SELECT session_id, CAST(sum(cf - billed) AS BIGINT) AS saved, count(*) AS n FROM led GROUP BY 1",
    "savings_report": f"WITH {_LEDGER} SELECT count(*) AS n_rows, count(cf) AS probed, round(sum(cf - billed) * CAST(100 AS DOUBLE) / sum(cf), 6) AS saved_pct, round(sum(cache_read) * CAST(1 AS DOUBLE) / sum(cache_write), 6) AS cache_ratio FROM led",
    "billed_so_far": f"WITH {_LEDGER} SELECT event_id, session_id, CAST(sum(billed) OVER (PARTITION BY session_id ORDER BY ts, event_id {_PRE} CURRENT ROW) AS BIGINT) AS billed_so_far FROM led",
    "inspector_ring": f"WITH {_LEDGER} SELECT session_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS rn FROM led) WHERE rn = 1 ORDER BY ts DESC, event_id DESC LIMIT 20",
    "evict_ttl": f"WITH {_LEDGER}, s AS (SELECT session_id, max(ts) AS touched FROM led GROUP BY 1) SELECT session_id, CAST(floor(epoch(touched)) AS BIGINT) AS touched_s FROM s WHERE touched > (SELECT max(touched) FROM s) - INTERVAL 3600 SECOND ORDER BY touched DESC, session_id LIMIT 512",
    "loop_feats": f"WITH {_COMMANDS} SELECT session, seq, round(lf, 9) AS lf, round(mean3, 9) AS mean3, round(delta, 9) AS delta, round(low6, 9) AS low6, mech FROM f",
    "loop_breaker": f"WITH {_COMMANDS}, e AS (SELECT *, CAST(coalesce(sum(CASE WHEN edit THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS epoch FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY session, epoch, cmd ORDER BY seq) AS run FROM e), t AS (SELECT *, sum((run > 3)::INT) OVER (PARTITION BY session, cmd ORDER BY seq) AS turn FROM n) SELECT session, seq, epoch, CAST(run AS BIGINT) AS run, run > 3 AND turn % 2 = 1 AS blocked FROM t",
    "governor_latch": f"WITH {_COMMANDS}, g AS (SELECT *, sum(CASE WHEN mech THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS n FROM f) SELECT session, seq, n > 0 AS stopped, mech AND n = 1 AS set_here FROM g",
    "neighbors_topk": f"WITH {_NEAR} SELECT query, rank, neighbour, score FROM k",
    "cost_median": f"WITH {_NEAR} SELECT query, CASE WHEN count(*) >= 4 THEN median(CAST(label AS DOUBLE)) END AS cost_median FROM k GROUP BY 1",
    "splitlines": "WITH p AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS ls FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS p FROM documents)) SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(list_filter(ls, lambda x: trim(x) <> '')) AS BIGINT) AS n_full FROM p",
    "window_rare": "WITH t AS (SELECT source, token, count(*) AS df FROM (SELECT source, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) >= 8))) AS token FROM documents) GROUP BY 1, 2), n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, count(*) AS n_rare, CAST(sum(df) AS BIGINT) AS occurrences FROM t JOIN n USING (source) WHERE df <= greatest(CAST(2 AS DOUBLE), n * CAST(0.001 AS DOUBLE)) GROUP BY 1",
    "dup_exact": "SELECT doc_id, count(*) OVER (PARTITION BY text ORDER BY doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier, CASE WHEN max(doc_id) OVER (PARTITION BY text) > doc_id THEN 1 ELSE 0 END AS superseded FROM documents",
    "url_paths": "WITH s AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages) SELECT page_id, CAST(len(s) AS BIGINT) AS depth, coalesce(s[len(s)], '') AS leaf FROM s",
    "tau_quantile": f"WITH {_TAU}, c AS (SELECT kind, score, row_number() OVER w AS rank, sum(tokens) OVER w AS cum, sum(tokens) OVER (PARTITION BY kind) AS total FROM t WHERE needed = 1 WINDOW w AS (PARTITION BY kind ORDER BY score DESC, id)), f AS (SELECT kind, coalesce(min(CASE WHEN cum >= CAST(0.9 AS DOUBLE) * total THEN rank END), max(rank)) AS rank, count(*) AS n FROM c GROUP BY 1) SELECT f.kind, c.score AS tau, f.n FROM f JOIN c ON c.kind = f.kind AND c.rank = f.rank",
    "tau_report": f"WITH {_TAU} SELECT CASE WHEN grouping(kind) = 1 THEN '(overall)' ELSE kind END AS kind, round(sum(CASE WHEN score < 500000 THEN tokens ELSE 0 END) / CAST(sum(tokens) AS DOUBLE), 9) AS cut, round(sum(CASE WHEN needed = 1 AND score >= 500000 THEN tokens ELSE 0 END) / CAST(nullif(sum(CASE WHEN needed = 1 THEN tokens ELSE 0 END), 0) AS DOUBLE), 9) AS needed_cov, count(*) AS n FROM t GROUP BY GROUPING SETS ((kind), ())",
    "message_diff": "WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations), d AS (SELECT a.*, b.turn IS NULL OR a.role <> b.role OR a.text <> b.text AS changed, length(coalesce(b.text, '')) - length(a.text) AS g FROM m a LEFT JOIN m b ON b.conv_id = a.conv_id + 1 AND b.turn = a.turn) SELECT conv_id, count(*) AS messages, count(*) FILTER (changed) AS changed, CAST(sum(g) AS BIGINT) AS chars_gained, CAST(greatest(0, -sum(g)) AS BIGINT) AS chars_saved FROM d GROUP BY 1",
    "last_views": "SELECT conv_id, turn, CAST(back AS INTEGER) AS back, sha256(substr(coalesce(text, ''), 1, 160)) AS view_sha FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role = 'assistant') WHERE back <= 14",
    "step_nodes": f"WITH {_CHUNKS} SELECT conv_id, step, count(*) AS n_chunks, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY step) - 1 AS BIGINT) AS node FROM chunks GROUP BY 1, 2",
    "step_edges": f"WITH {_CHUNKS} SELECT conv_id, count(*) AS task_edges, count(DISTINCT step) - 1 AS step_edges FROM chunks GROUP BY 1",
    "edited_files": f"WITH {_RANGES} SELECT conv, n_files, file AS top_file, n AS top_rows FROM (SELECT *, count(*) OVER (PARTITION BY conv) AS n_files, row_number() OVER (PARTITION BY conv ORDER BY n DESC, file DESC) AS k FROM (SELECT conv, file, count(*) AS n FROM r GROUP BY 1, 2)) WHERE k = 1",
    "file_hubs": f"WITH {_RANGES} SELECT file, count(DISTINCT conv) AS n_conv, count(*) AS n_rows, CAST(sum(tokens) AS BIGINT) AS tokens FROM r GROUP BY 1",
    "first_seen": f"WITH {_COMMANDS} SELECT session, cmd, min(seq) AS first_seq, CAST(row_number() OVER (PARTITION BY session ORDER BY min(seq)) AS BIGINT) AS pos FROM c GROUP BY 1, 2",
    "stop_blocks": f"WITH {_COMMANDS} SELECT session, seq, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS nth FROM c WHERE edit) WHERE nth <= 2",
    "reads_by_epoch": f"WITH {_COMMANDS} SELECT session, epoch, count(*) AS n, count(DISTINCT cmd) AS n_cmd FROM (SELECT *, CAST(sum(CASE WHEN edit THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS BIGINT) AS epoch FROM c) GROUP BY 1, 2",
    "held_high": "SELECT user_id, event_id FROM (SELECT *, count(value) OVER w AS n, min(value) OVER w AS low FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE n >= 3 AND low >= 50",
    "keep_sets": "SELECT user_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS both, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS either FROM (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (event_id % 2 = 1), []) AS a, coalesce(list(DISTINCT event_type) FILTER (event_id % 2 <> 1), []) AS b FROM events GROUP BY 1)",
    "value_stats": "SELECT event_type, count(value) AS n, min(value) AS least, max(value) AS greatest FROM events GROUP BY 1",
}
