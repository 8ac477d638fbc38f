"""Queries over what is needed later, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import needed as N
from ..operators.dealt import parts
from ..operators.ranges import derived_ranges
from .sql import _RANGES


def _targets(lineitem):
    chunks, reads, _, hunks = N.derived(derived_ranges(lineitem))
    return N.targets_after(chunks.select("conv", "gi", "step", "file"), reads, hunks, 12, parts(lineitem)).select("conv", "gi", "precise", "whole", "patched")


def _rendered(lineitem):
    tables = N.derived(derived_ranges(lineitem))
    n = parts(lineitem)
    return N.rendered(tables[0], N.needed(*tables, n=n), n).select("conv", F.sha2("text", 256).alias("sha"), F.char_length("text").cast("long").alias("chars"))


def _acting(lineitem):
    return N.needed(*N.derived(derived_ranges(lineitem)), N.LEVELS[2], F.lit(100), n=parts(lineitem))


QUERIES = {
    "targets_after": ("lineitem", None, _targets),
    "is_needed": ("lineitem", None, lambda d: N.needed(*N.derived(derived_ranges(d)), n=parts(d))),
    "is_needed_now": ("lineitem", None, _acting),
    "trim_levels": ("lineitem", None, lambda d: N.kept_by_level(*N.derived(derived_ranges(d)), n=parts(d))),
    "render_kept": ("lineitem", None, _rendered),
    "keep_set": ("lineitem", None, lambda d: N.keep_set(*N.derived(derived_ranges(d)), n=parts(d))),
}

_TABLES = (
    _RANGES
    + """, d AS (SELECT conv, gi, gi // 4 AS step, file, lo, hi, tokens FROM r)
, c AS (SELECT conv, gi, step, gi % 11 = 0 AS reasoning, gi % 13 = 0 AS plan, CASE WHEN gi % 13 = 0 THEN 'docs/my-plan.md' WHEN gi % 7 <> 1 THEN file END AS file, CASE WHEN gi % 5 <> 2 THEN lo END AS lo, CASE WHEN gi % 5 <> 2 THEN hi END AS hi, tokens % 100 / 100 AS sup, tokens % 90 / 100 AS sup_next,
['symbol_' || tokens % 40, 'longer_symbol_' || gi % 50, 'short'] AS spans, file || ' ' || lo AS text FROM d WHERE gi % 3 <> 0)
, q AS (SELECT conv, step, file, CASE WHEN gi % 9 <> 0 THEN lo END AS lo, CASE WHEN gi % 9 <> 0 THEN lo + 2 END AS hi, ['symbol_' || tokens % 60, 'longer_symbol_' || gi % 60] AS spans FROM d WHERE gi % 3 = 0)
, h AS (SELECT conv, file, lo, hi FROM d WHERE gi % 97 = 5)
"""
)


def _needed(k: int, near: int, sup: float, rare: float, chars: int, refetch: float, whole: bool, horizon: int = 10**9, now: int | None = None, of: str = "c") -> str:
    """Common tables that end in n{k} (conv, gi, needed) of the chunks in `of`, which has its own s{k} if it is not c."""
    soon = f"q.step > c.step AND q.step <= c.step + {horizon}"
    at = "q.conv = c.conv AND q.file = c.file"
    patch = f"EXISTS (SELECT 1 FROM h WHERE h.conv = c.conv AND h.file = c.file AND c.lo <= h.hi + {near} AND h.lo - {near} <= c.hi)"
    use = f"EXISTS (SELECT 1 FROM q WHERE {at} AND {soon} AND q.lo IS NULL)" if whole else "false"
    words = f"""w{k} AS (SELECT conv, span FROM (SELECT conv, unnest(spans) AS span FROM c) JOIN (SELECT conv, count(*) AS n FROM c GROUP BY 1) USING (conv) WHERE length(span) >= {chars} GROUP BY conv, span, n HAVING count(*) <= greatest(2, n * {rare}))
, s{k} AS (SELECT DISTINCT c.conv, c.gi FROM (SELECT conv, gi, step, unnest(spans) AS span FROM c) c JOIN w{k} USING (conv, span) JOIN (SELECT conv, step, unnest(spans) AS span FROM q) q USING (conv, span) WHERE {soon})
, """
    return (words if of == "c" else "") + f"""n{k} AS (SELECT conv, gi, CASE {"" if now is None else f"WHEN step >= {now} THEN true WHEN reasoning THEN {now} - step < 2"} WHEN reasoning THEN true WHEN plan THEN true WHEN sup >= {sup} THEN false
WHEN file IS NULL THEN EXISTS (SELECT 1 FROM s{k} WHERE s{k}.conv = c.conv AND s{k}.gi = c.gi)
WHEN lo IS NULL THEN {use} OR EXISTS (SELECT 1 FROM q WHERE {at} AND {soon} AND q.lo IS NOT NULL) OR EXISTS (SELECT 1 FROM h WHERE h.conv = c.conv AND h.file = c.file)
WHEN coalesce((SELECT sum(greatest(0, least(c.hi, q.hi) - greatest(c.lo, q.lo) + 1)) FROM q WHERE {at} AND q.step > c.step AND q.lo IS NOT NULL), 0) >= {refetch} * (hi - lo + 1) AND NOT {patch} THEN false
ELSE {use} OR {patch} OR EXISTS (SELECT 1 FROM q WHERE {at} AND {soon} AND c.lo <= q.hi + {near} AND q.lo - {near} <= c.hi) END AS needed FROM {of} c)"""


_LEVELS = {1: (20, 0.95, 0.15, 6, 1.0, True), 2: (10, 0.9, 0.1, 8, 0.9, True), 3: (0, 0.8, 0.05, 8, 0.8, False), 4: (0, 0.7, 0.03, 10, 0.6, False, 40), 5: (0, 0.6, 0.02, 12, 0.5, False, 15)}
_KEEP = f"""WITH {_TABLES}, {_needed(3, *_LEVELS[3])},
a AS (SELECT c.*, needed AS admitted FROM c JOIN n3 USING (conv, gi)),
z AS (SELECT conv, max(step) + 1 AS steps FROM (SELECT conv, step FROM c UNION ALL SELECT conv, step FROM q) GROUP BY 1 HAVING max(step) + 1 >= 6 AND (SELECT count(*) FROM c WHERE c.conv = conv) >= 6),
v AS (SELECT a.*, age, step + age AS t FROM a JOIN z USING (conv) CROSS JOIN (VALUES (0), (1)) g(age) WHERE NOT reasoning AND step >= 1 AND step + age < steps - 1),
views AS (SELECT DISTINCT conv, age, t FROM v),
alive AS (SELECT views.conv, age, t, a.gi, a.spans FROM views JOIN a ON a.conv = views.conv AND a.step <= t AND (a.step = t OR age = 1 AND a.step = t - 1 OR admitted)),
n AS (SELECT conv, age, t, count(*) AS n FROM alive GROUP BY ALL HAVING count(*) >= 6),
df AS (SELECT conv, age, t, span, count(*) AS df FROM (SELECT conv, age, t, unnest(list_distinct(spans)) AS span FROM alive) GROUP BY ALL),
p AS (SELECT conv, gi * 2 + age AS gi, t AS step, reasoning, plan, file, lo, hi, CASE age WHEN 1 THEN sup_next ELSE 0 END AS sup, spans, age, n FROM v JOIN n USING (conv, age, t)),
s9 AS (SELECT DISTINCT c.conv, c.gi FROM (SELECT *, unnest(list_distinct(spans)) AS span FROM p) c JOIN df ON df.conv = c.conv AND df.age = c.age AND df.t = c.step AND df.span = c.span AND df.df <= greatest(2, n * 0.05)
  JOIN (SELECT conv, step, unnest(spans) AS span FROM q) q ON q.conv = c.conv AND q.span = c.span AND q.step > c.step WHERE length(c.span) >= 8),
{_needed(9, *_LEVELS[3], of="p")}
SELECT conv, gi, (conv, gi) IN (SELECT (conv, gi // 2) FROM n9 WHERE needed) AS keep FROM c"""
_AT = "q.conv = c.conv AND q.file = c.file AND q.step > c.step AND q.step <= c.step + 12"
SQL = {
    "keep_set": _KEEP,
    "targets_after": f"WITH {_TABLES} SELECT conv, gi, (SELECT count(*) FROM q WHERE {_AT} AND q.lo IS NOT NULL) AS precise, (SELECT count(*) FROM q WHERE {_AT} AND q.lo IS NULL) AS whole, (SELECT count(*) FROM h WHERE h.conv = c.conv AND h.file = c.file) AS patched FROM c WHERE file IS NOT NULL",
    "is_needed": f"WITH {_TABLES}, {_needed(3, *_LEVELS[3])} SELECT * FROM n3",
    "is_needed_now": f"WITH {_TABLES}, {_needed(2, *_LEVELS[2], now=100)} SELECT * FROM n2",
    "trim_levels": f"WITH {_TABLES}, {', '.join(_needed(k, *v) for k, v in _LEVELS.items())} {' UNION ALL '.join(f'SELECT conv, {k} AS level, count(*) FILTER (needed) AS kept FROM n{k} GROUP BY 1' for k in _LEVELS)}",
    "render_kept": f"WITH {_TABLES}, {_needed(3, *_LEVELS[3])}, t AS (SELECT conv, string_agg(text, chr(10) ORDER BY gi) AS text FROM c JOIN n3 USING (conv, gi) WHERE needed GROUP BY 1) SELECT conv, sha256(text) AS sha, length(text) AS chars FROM t",
}
