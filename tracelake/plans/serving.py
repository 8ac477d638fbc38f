"""Queries over serving, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import serving
from .sql import _CUT

_v = lambda: F.floor("value").cast("long")


def _tools(events):
    calls = events.select(F.col("user_id").alias("conv"), F.col("event_type").alias("tool"))
    keep = events.filter("event_id % 3 = 0").select(F.col("user_id").alias("conv"), F.col("event_type").alias("tool"))
    return serving.unfrozen_tools(calls, keep)


def _edges(lineitem):
    e = lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_linenumber") % 5).cast("long").alias("rel"))
    return serving.replaced_relation(e, lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


QUERIES = {
    "cut_tally": ("conversations", None, serving.cut_tally),
    "cut_deltas": ("events", lambda e: e.select(F.col("user_id").alias("conv"), F.col("event_id").alias("seq"), (F.col("event_id") % 400).alias("n")), serving.snapshot_deltas),
    "fold_lookup": ("conversations", None, lambda m: serving.fold_lookup(m, serving.derived_folds(m)).select("conv_id", "turn", F.substring("served", 1, 5).alias("served"), "known")),
    "unfrozen_tools": ("events", None, _tools),
    "override_cmds": ("events", lambda e: e.select(F.col("user_id").alias("session"), F.concat_ws(" ", "event_type", (_v() % 4).cast("string")).alias("cmd")), serving.override_commands),
    "replaced_relation": ("lineitem", None, _edges),
}

SQL = {
    "cut_tally": f"WITH {_CUT} SELECT c.conv_id, c.kind, CAST(coalesce(sum(c.tokens) FILTER (k.gi IS NULL), 0) AS BIGINT) AS kept, CAST(coalesce(sum(c.tokens) FILTER (k.gi IS NOT NULL), 0) AS BIGINT) AS cut FROM chunks c LEFT JOIN cuts k ON k.conv_id = c.conv_id AND k.gi = c.gi GROUP BY 1, 2",
    "cut_deltas": "SELECT conv, seq, CASE WHEN b IS NULL OR b > n THEN n ELSE n - b END AS new FROM (SELECT user_id AS conv, event_id AS seq, event_id % 400 AS n, lag(event_id % 400) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)",
    "fold_lookup": "SELECT conv_id, turn, CASE WHEN k THEN 'held:' ELSE 'fold:' END AS served, k AS known FROM (SELECT conv_id, turn, EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id % 3 = 0 AND b.turn = a.turn AND b.role = a.role AND b.text = a.text) AS k FROM conversations a)",
    "unfrozen_tools": "SELECT DISTINCT user_id AS conv, event_type AS tool FROM events EXCEPT SELECT user_id, event_type FROM events WHERE event_id % 3 = 0",
    "override_cmds": "SELECT user_id AS session, array_to_string(list_sort(list(DISTINCT event_type || ' ' || CAST(floor(value) AS BIGINT) % 4)), ',') AS cmds FROM events GROUP BY 1",
    "replaced_relation": "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, CAST(l_linenumber % 5 AS BIGINT) AS rel FROM lineitem WHERE l_linenumber % 5 <> 4 UNION SELECT l_partkey, l_suppkey, 4 FROM lineitem WHERE l_quantity > 45",
}
