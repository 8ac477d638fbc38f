"""Queries over the context fold, with SQL that replays it by recursion over steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import fold, keyed
from .sql import _CHUNKS


def folded(messages: DataFrame) -> DataFrame:
    return keyed.over_table(fold.births(fold.conversation_chunks(messages)), "conv", "step", fold.fold_step(), fold.FOLD)


def live_newborns(messages: DataFrame) -> DataFrame:
    return fold.live_sets(fold.conversation_chunks(messages).select("conv", "gi", "step"), fold.decisions(folded(messages)))


def registry(messages: DataFrame) -> DataFrame:
    """(conv, insists, dropped, cmds, dropped_ranges, served_ranges): what the fold holds of each conversation after its last step, sorted."""
    r = F.from_json("registry", "dropped array<string>, cmds array<string>, dropped_ranges map<string,array<array<bigint>>>, served_ranges map<string,array<array<bigint>>>, insists bigint")
    d = folded(messages).filter("registry IS NOT NULL").select("conv", r.alias("r"))
    spans = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(F.col(f"r.{c}"))), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], lambda x: F.concat_ws("-", x)), ","))), ";").alias(c)
    return d.select("conv", F.col("r.insists").alias("insists"), F.sha2(F.array_join("r.dropped", "\n"), 256).alias("dropped"), F.array_join("r.cmds", ";").alias("cmds"), spans("dropped_ranges"), spans("served_ranges"))


QUERIES = {
    "fold_births": ("conversations", None, lambda d: fold.decisions(folded(d))),
    "live_newborns": ("conversations", None, live_newborns),
    "fold_registry": ("conversations", None, registry),
}

_GRID = "CAST(CAST(('0x' || substr(sha256({}), 1, 16)) AS UBIGINT) % 1000000 AS BIGINT)"
_FOLD = f"""WITH RECURSIVE {_CHUNKS},
m AS (SELECT conv_id, turn, lag(role) OVER w = 'assistant' AS fresh, last_value(CASE WHEN role = 'assistant' THEN string_split(trim(text), ' ')[1] END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT c.conv_id AS conv, gi, step, c.turn AS owner, kind, text, tokens, {_GRID.format("CAST(step AS VARCHAR) || ':' || kind || ':' || text")} AS score, CASE WHEN kind = 'other' THEN said END AS cmd, kind = 'other' AND coalesce(fresh, false) AS direct, win * 40 + 1 AS lo, win * 40 + 40 AS hi,
  c.turn || ':' || kind || ':' || substr(text, 1, 60) || ':' || substr(sha256(text), 1, 16) AS key FROM chunks c JOIN m ON m.conv_id = c.conv_id AND m.turn = c.turn WHERE step < coalesce(tail_lo, 0)),
t AS (SELECT conv, owner, {_GRID.format("'qhat:' || string_agg(text, chr(0) ORDER BY gi)")} AS tau FROM a GROUP BY ALL),
b AS (SELECT a.*, gi - row_number() OVER (PARTITION BY a.conv, a.owner ORDER BY gi) AS run FROM a JOIN t ON t.conv = a.conv AND t.owner = a.owner WHERE score < tau),
r AS (SELECT conv, gi, key FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv, owner, run) AS mass FROM b) WHERE mass >= 10),
c AS (SELECT a.*, (conv, gi) IN (SELECT (conv, gi) FROM r) AS picked, (conv, key) IN (SELECT (conv, key) FROM r) AS would FROM a),
s AS (SELECT conv, step, row_number() OVER (PARTITION BY conv ORDER BY step) AS n, max(cmd) FILTER (direct AND cmd <> '') AS cmd, coalesce(bool_or(picked) FILTER (direct), false) AS w FROM c GROUP BY conv, step),
v AS (
  SELECT conv, 0::BIGINT AS n, -1::BIGINT AS step, []::VARCHAR[] AS held, false AS again FROM (SELECT DISTINCT conv FROM s)
  UNION ALL SELECT s.conv, s.n, s.step, CASE WHEN s.cmd IS NULL THEN v.held ELSE list_concat(list_filter(v.held, lambda x: x <> s.cmd), CASE WHEN s.w AND NOT list_contains(v.held, s.cmd) THEN [s.cmd] ELSE [] END) END, s.cmd IS NOT NULL AND list_contains(v.held, s.cmd)
  FROM v JOIN s ON s.conv = v.conv AND s.n = v.n + 1
),
d AS (SELECT c.*, direct AND cmd <> '' AND again AS insisted FROM c JOIN v ON v.conv = c.conv AND v.step = c.step),
e AS (SELECT *, would AND NOT coalesce(insisted, false) AS cut FROM d)
"""
_SPANS = """(SELECT string_agg(f || '=' || rs, ';' ORDER BY f) FROM (SELECT cmd AS f, string_agg(lo || '-' || hi, ',' ORDER BY step, gi) AS rs FROM e x WHERE x.conv = y.conv AND kind = 'other' AND coalesce(cmd, '') <> '' AND {} GROUP BY cmd))"""
SQL = {
    "fold_births": _FOLD + "SELECT conv, gi, cut, coalesce(insisted, false) AS insisted FROM e",
    "live_newborns": _FOLD + """, g AS (SELECT conv, step, count(*) AS born, count(*) FILTER (insisted) AS insisted, count(*) FILTER (cut) AS cut FROM e GROUP BY ALL)
SELECT conv, step, CAST(sum(born) OVER w - coalesce(sum(cut) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS live, born - insisted AS undecided, insisted, cut FROM g WINDOW w AS (PARTITION BY conv ORDER BY step)""",
    "fold_registry": _FOLD + f"""SELECT conv, count(*) FILTER (insisted) AS insists, sha256(coalesce((SELECT string_agg(key, chr(10) ORDER BY key) FROM (SELECT DISTINCT key FROM e x WHERE x.conv = y.conv AND cut)), '')) AS dropped,
coalesce((SELECT string_agg(h, ';' ORDER BY h) FROM (SELECT unnest(held) AS h FROM v WHERE v.conv = y.conv QUALIFY n = max(n) OVER ())), '') AS cmds, coalesce({_SPANS.format("cut AND picked")}, '') AS dropped_ranges, coalesce({_SPANS.format("NOT cut")}, '') AS served_ranges FROM e y GROUP BY conv""",
}
