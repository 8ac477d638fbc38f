"""Queries over similar chunks, cuts, latches and views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, ranges, trace
from ..operators.documents import page_paths
from .sql import _CHUNKS, _CUT, _RANGES, _grid

TAUS = {"asst": 300_000, "other": 800_000}


def _clamp(events):
    rules = decisions.derived_rules(events)
    steps = events.select(F.col("user_id").alias("conv"), (F.col("event_id") % 5 * 2 + 1).alias("step"))
    return decisions.step_clamp(rules, steps)


QUERIES = {
    "spans": ("documents", None, decisions.span_counts),
    "similar_chunks": ("conversations", trace.chunks, decisions.similar_chunks),
    "similar_counts": ("conversations", trace.chunks, decisions.similar_counts),
    "budget_cut_kind": ("conversations", None, lambda d: decisions.kind_cut(d, TAUS)),
    "fold_cuts": ("conversations", None, decisions.fold_cuts),
    "purity_resets": ("conversations", decisions.derived_requests, decisions.purity_resets),
    "governor": ("events", decisions.derived_signals, decisions.governor),
    "rule_fires": ("events", decisions.derived_rules, lambda d: decisions.rule_fires(d, 250_000)),
    "recent_commands": ("events", decisions.derived_phrases, lambda d: decisions.recent_commands(d).select("session", "step", F.sha2("text", 256).alias("sha"))),
    "repo_map": ("pages", page_paths, decisions.ranked_files),
    "group_spans": ("lineitem", ranges.derived_ranges, decisions.group_spans),
    "render_message": ("conversations", None, lambda d: decisions.rendered_cuts(d).select("conv_id", "turn", F.sha2("text", 256).alias("sha"))),
    "dupcos": ("embeddings", decisions.derived_vectors, lambda d: decisions.near_vectors(d, 1).select("conv", "step", "step2", "score")),
    "causal_knn": ("embeddings", decisions.derived_vectors, lambda d: decisions.near_vectors(d, 3).select("conv", "step", "rank", "step2")),
    "budget_double": ("conversations", None, decisions.double_budget),
    "loop_fracs": ("events", None, decisions.loop_shares),
    "responses_delta": ("conversations", None, decisions.request_delta),
    "memo_lookup": ("conversations", None, decisions.memo_lookup),
    "readmit": ("lineitem", ranges.derived_ranges, decisions.readmissions),
    "step_clamp": ("events", None, _clamp),
}

_STOP = ", ".join(f"'{w}'" for w in decisions.STOP_WORDS)
_SPAN = decisions.SPAN.replace("'", "''")


def _spans(text: str, least: int) -> str:
    found = f"list_transform(regexp_extract_all(coalesce({text}, ''), '{_SPAN}'), lambda s: lower(regexp_replace(regexp_replace(s, '^[''\"]+', ''), '[''\"]+$', '')))"
    return f"list_distinct(list_filter({found}, lambda s: length(s) >= {least} AND s NOT IN ({_STOP}) AND (NOT regexp_matches(s, '^[0-9]+$') OR length(s) >= 3)))"


_SIMILAR = f"""{_CHUNKS}, e AS (SELECT conv_id, gi, step, {_spans("text", 5)} AS s FROM chunks)
, sim AS (SELECT a.conv_id, a.gi AS src, b.gi AS dst, a.step AS s1, b.step AS s2 FROM e a JOIN e b ON a.conv_id = b.conv_id AND b.step > a.step WHERE len(a.s) > 0 AND len(b.s) > 0 AND len(list_intersect(a.s, b.s)) >= CAST(0.6 AS DOUBLE) * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))))"""
_PHRASES = """c AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, concat_ws(' ', event_type, '-q', 'f' || CAST(floor(value) AS BIGINT) % 3, CASE WHEN CAST(floor(value) AS BIGINT) % 2 = 0 THEN '--all' END, CASE WHEN CAST(floor(value) AS BIGINT) % 5 = 0 THEN 'x' || CAST(floor(value) AS BIGINT) % 4 END) AS cmd FROM events)"""
_VEC = """v AS (SELECT vec_id // 40 AS conv, vec_id AS step, label AS file, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
, p AS (SELECT a.conv, a.step, b.step AS step2, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM v a JOIN v b ON a.conv = b.conv AND b.step < a.step AND a.file <> b.file)
, k AS (SELECT *, row_number() OVER (PARTITION BY conv, step ORDER BY score DESC, step2) AS rank FROM p)"""
_V = "CAST(floor(value) AS BIGINT)"

SQL = {
    "spans": f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_spans, sha256(array_to_string(list_sort(s), chr(10))) AS spans_sha FROM (SELECT doc_id, {_spans('text', 5)} AS s FROM documents)",
    "similar_chunks": f"WITH {_SIMILAR} SELECT conv_id, src, dst FROM sim",
    "similar_counts": f"WITH {_SIMILAR} SELECT conv_id, gi, (SELECT count(*) FROM sim WHERE sim.conv_id = e.conv_id AND src = e.gi) AS later, (SELECT count(*) FROM sim WHERE sim.conv_id = e.conv_id AND dst = e.gi) AS earlier, round(least(CAST(3 AS DOUBLE), coalesce((SELECT sum(CAST(1 AS DOUBLE) / (1 + s2 - s1)) FROM sim WHERE sim.conv_id = e.conv_id AND dst = e.gi), 0)), 9) AS recency FROM e",
    "budget_cut_kind": f"WITH {_CHUNKS}, b AS (SELECT *, {_grid('step', 'kind')} < CASE kind WHEN 'asst' THEN 300000 WHEN 'other' THEN 800000 END AND count(*) OVER (PARTITION BY conv_id, kind, text ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 AS cut FROM chunks), r AS (SELECT *, gi - row_number() OVER (PARTITION BY conv_id, turn ORDER BY gi) AS run FROM b WHERE cut) SELECT conv_id, gi, kind, run_tokens FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id, turn, run) AS BIGINT) AS run_tokens FROM r) WHERE run_tokens >= 10",
    # The valve by recursion over each command's steps: what was cut before is served now.
    "fold_cuts": f"""WITH RECURSIVE {_CHUNKS}, b AS (SELECT conv_id AS conv, gi, step, turn AS owner, tokens, CASE WHEN kind = 'other' THEN 'run ' || step % 2 END AS cmd, {_grid("step", "kind")} < 700000 AS below FROM chunks),
r AS (SELECT *, gi - row_number() OVER (PARTITION BY conv, owner ORDER BY gi) AS run FROM b WHERE below), w AS (SELECT conv, gi FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv, owner, run) AS m FROM r) WHERE m >= 10),
d AS (SELECT b.*, w.gi IS NOT NULL AS would FROM b LEFT JOIN w ON w.conv = b.conv AND w.gi = b.gi),
s AS (SELECT *, row_number() OVER (PARTITION BY conv, cmd ORDER BY step, owner) AS n FROM (SELECT conv, cmd, step, owner, bool_or(would) AS w FROM d WHERE cmd IS NOT NULL GROUP BY ALL)),
v AS (SELECT conv, cmd, step, owner, n, w AS held, false AS insisted FROM s WHERE n = 1 UNION ALL SELECT s.conv, s.cmd, s.step, s.owner, s.n, NOT v.held AND s.w, v.held FROM v JOIN s ON s.conv = v.conv AND s.cmd = v.cmd AND s.n = v.n + 1)
SELECT d.conv, d.gi, d.step, coalesce(insisted, false) AS insisted, would AND NOT coalesce(insisted, false) AS cut FROM d LEFT JOIN v ON v.conv = d.conv AND v.step = d.step AND v.owner = d.owner AND v.cmd = d.cmd""",
    "purity_resets": "SELECT conv_id AS conv, turn AS seq, coalesce((turn % 5 = 4) <> (lag(turn % 5 = 4) OVER (PARTITION BY conv_id ORDER BY turn)), false) AS reset FROM conversations",
    "governor": f"WITH s AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, {_V} AS v FROM events), k AS (SELECT *, bool_or(v > 95) OVER (PARTITION BY session ORDER BY seq) AS killed FROM s), f AS (SELECT session, min(seq) FILTER (v % 7 = 3 AND NOT killed) AS c, min(seq) FILTER (v BETWEEN 20 AND 30 AND NOT killed) AS b, min(seq) FILTER (seq >= 8 AND NOT killed) AS h FROM k GROUP BY 1) SELECT k.session, seq, killed, coalesce(seq = c, false) AS coach_fires, coalesce(seq = b, false) AS bank_fires, coalesce(seq = h, false) AS horizon_fires FROM k JOIN f USING (session)",
    "rule_fires": f"SELECT user_id AS conv, event_type AS eid, {_V} % 6 AS fire_step, min(event_id) AS at FROM events WHERE CAST(floor(value * 10000) AS BIGINT) % 1000000 >= 250000 GROUP BY 1, 2, 3",
    "recent_commands": f"WITH {_PHRASES}, s AS (SELECT *, (seq - 1) // 4 AS step FROM c) SELECT a.session, a.step, sha256(substr(string_agg(b.cmd, chr(10) ORDER BY b.seq), 1, 4000)) AS sha FROM (SELECT DISTINCT session, step FROM s) a JOIN s b ON b.session = a.session AND b.step BETWEEN a.step - 1 AND a.step GROUP BY 1, 2",
    "repo_map": "WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages) SELECT row_number() OVER (ORDER BY len(string_split(path, '/')), length(path), path) AS pos, path, greatest(0, count(*) OVER () - 20) AS more FROM p QUALIFY pos <= 20",
    "group_spans": f"WITH {_RANGES}, f AS (SELECT conv, step, arg_min(file, gi) AS file FROM r GROUP BY 1, 2) SELECT r.conv, r.step, r.file, min(lo) AS lo, max(hi) AS hi FROM r JOIN f ON f.conv = r.conv AND f.step = r.step AND f.file = r.file GROUP BY 1, 2, 3",
    "render_message": f"WITH {_CUT}, p AS (SELECT c.conv_id, c.turn, c.gi, c.text, k.run, k.run_tokens, min(CASE WHEN k.run IS NOT NULL THEN c.gi END) OVER (PARTITION BY c.conv_id, c.turn, k.run) AS first FROM chunks c LEFT JOIN cuts k ON k.conv_id = c.conv_id AND k.gi = c.gi) SELECT conv_id, turn, sha256(string_agg(CASE WHEN run IS NULL THEN text ELSE '[cut: ' || run_tokens || ' tokens]' END, chr(10) ORDER BY gi) FILTER (run IS NULL OR gi = first)) AS sha FROM p GROUP BY 1, 2 HAVING bool_or(run IS NOT NULL)",
    "dupcos": f"WITH {_VEC} SELECT conv, step, step2, score FROM k WHERE rank = 1",
    "causal_knn": f"WITH {_VEC} SELECT conv, step, CAST(rank AS INTEGER) AS rank, step2 FROM k WHERE rank <= 3",
    "budget_double": "WITH a AS (SELECT conv_id, CAST(s AS BIGINT) AS s, CAST(sum(CASE WHEN contains(text, '[SUPERVISOR') OR contains(text, '[CONTEXT RESET') THEN 0 ELSE length(coalesce(text, '')) END) AS BIGINT) AS chars FROM (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) WHERE s > 0 GROUP BY 1, 2), b AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY s) AS run, count(*) OVER (PARTITION BY conv_id) AS n FROM a) SELECT conv_id, s, chars, CASE WHEN n < 6 THEN CAST(0 AS DOUBLE) ELSE CAST(sum(run) OVER (PARTITION BY conv_id ORDER BY s) AS DOUBLE) / 4 END AS cum_tok FROM b",
    "loop_fracs": f"WITH {_PHRASES}, w AS (SELECT *, list_distinct(string_split(cmd, ' ')) AS w FROM c), f AS (SELECT a.session, a.seq, CASE WHEN EXISTS (SELECT 1 FROM w b WHERE b.session = a.session AND b.seq < a.seq AND len(list_intersect(a.w, b.w)) >= CAST(0.6 AS DOUBLE) * len(list_distinct(list_concat(a.w, b.w)))) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS flag FROM w a) SELECT session, seq, round(avg(flag) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 9) AS lf FROM f",
    "responses_delta": "SELECT conv_id, orig, served, greatest(0, orig - served) AS saved FROM (SELECT conv_id, CAST(sum(length(text) // 4) AS BIGINT) AS orig, CAST(coalesce(sum(length(text) // 4) FILTER (role <> 'system'), 0) AS BIGINT) AS served FROM conversations GROUP BY 1)",
    "memo_lookup": "SELECT a.conv_id, a.turn, max(b.turn) AS memo_turn FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn < a.turn AND b.role = a.role AND length(b.text) % 5 = length(a.text) % 5 GROUP BY 1, 2",
    "readmit": f"WITH {_RANGES}, l AS (SELECT *, max(step) OVER (PARTITION BY conv) AS last FROM r) SELECT conv, gi, step AS t, round(step / CAST(greatest(1, last) AS DOUBLE), 9) AS share, CASE WHEN max(step) OVER (PARTITION BY conv, file) = last THEN 1 ELSE 0 END AS resident, count(*) OVER (PARTITION BY conv, file ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM l",
    "step_clamp": f"WITH s AS (SELECT DISTINCT user_id AS conv, event_id % 5 * 2 + 1 AS step FROM events) SELECT e.user_id AS conv, e.event_id AS seq, coalesce(max(CASE WHEN s.step <= {_V} % 6 THEN s.step END), min(s.step)) AS node_step FROM events e JOIN s ON s.conv = e.user_id GROUP BY 1, 2",
}
