"""Queries over what commands read and edit, with SQL that walks a command character by character."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexer as X
from ..operators import reads


def derived_inputs(events: DataFrame) -> DataFrame:
    """Calls with an argument array, a JSON object, a snippet of code, or nothing to run."""
    v, n = F.floor("value").cast("long").cast("string"), F.col("event_id") % 7
    word = F.concat(F.col("event_type"), F.lit(" "), v)
    forms = [
        F.concat(F.lit('{"command": "'), word, F.lit('"}')), F.concat(F.lit('{"cmd": "'), word, F.lit('", "command": ""}')), F.concat(F.lit('run({cmd : "'), word, F.lit('\\n\\"x\\" \\\\n", n: 1})')),
        F.concat(F.lit('exec({command:"'), word, F.lit('"})')), F.concat(F.lit('{"command": '), v, F.lit("}")), F.concat(F.lit("no command "), word), F.lit(None).cast("string"),
    ]
    argv = F.when(F.col("event_id") % 5 == 0, F.array(F.col("event_type"), F.lit("-x"), v))
    return events.select("event_id", argv.alias("argv"), F.get(F.array(*forms), n.cast("int")).alias("input"))


QUERIES = {
    "shell_reads": ("lineitem", reads.derived_calls, reads.shell_reads),
    "shell_edits": ("lineitem", reads.derived_calls, reads.shell_edits),
    "action_edits": ("lineitem", reads.derived_actions, reads.action_edits),
    "elided_ranges": ("lineitem", None, reads.elisions),
    "scraped_commands": ("events", derived_inputs, lambda d: d.select("event_id", X.scraped_command(F.col("argv"), F.col("input")).alias("cmd"))),
}

_EXT = "['py', 'ts', 'md', 'Rs', 'gz']"
_CALLS = f"""v AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, row_number() OVER () AS rid, (l_partkey + l_linenumber) % 14 AS form, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS n, CAST(CAST(l_quantity AS BIGINT) + 9 AS VARCHAR) AS m,
    'src/f' || l_partkey % 40 || '.' || {_EXT}[l_partkey % 5 + 1] AS p, '../tests/g' || l_suppkey % 40 || '.' || {_EXT}[l_suppkey % 5 + 1] AS q
  FROM lineitem
),
s AS (
  SELECT id, rid, CASE form WHEN 0 THEN 'cat ' || p || '; head -n ' || n || ' ' || q WHEN 1 THEN 'cat ' || p || ' | sed -n ''' || n || ',' || m || 'p'' | nl' WHEN 2 THEN 'cat "' || p || '" && tail -' || n || ' ' || q
    WHEN 3 THEN 'cat ' || p || ' | grep -n foo' WHEN 4 THEN 'sed -n ''' || n || ',' || m || 'p'' ' || p || ' > /repo/out.md' WHEN 5 THEN 'awk ''NR>=' || n || ' && NR<=' || m || ''' ' || p WHEN 6 THEN 'awk ''NR==' || n || ''' ./' || p
    WHEN 7 THEN 'echo ''a; cat ' || q || ''' ; nl ' || p || ' 2>&1 | tail -n ' || n WHEN 8 THEN 'python -m pytest ' || p || ' | tail -40' WHEN 9 THEN 'cat ' || p || ' <<EOF' || chr(10) || 'cat ' || q || chr(10) || 'EOF'
    WHEN 10 THEN 'sed -i ''s/a/b/'' ' || p || ' && git checkout -- ' || q WHEN 11 THEN 'tee ' || q || ' < ' || p || ' | cat' WHEN 12 THEN 'less ' || p || ' ' || q || ' | head -' || n || '; more ' || p ELSE 'cat ''it | ' || p || ''' /tmp/' || q || ' >> ' || p END AS cmd
  FROM v
)"""


def _walk(name: str, source: str, text: str, cut: str, double: bool) -> str:
    """A recursive table (name, r, i, ch, part): the characters outside the separators with the number of the part they stand in."""
    two = f"AND substr({text}, i + 2, 1) = '&'" if double else ""
    amp = f"OR (c = '&' {two})" if double else ""
    return f"""{name}(r, t, i, q, part, skip, ch) AS (
  SELECT r, {text}, 0, '', 0, false, '' FROM {source}
  UNION ALL
  SELECT r, t, i + 1, CASE WHEN skip THEN q WHEN q <> '' THEN CASE WHEN c = q THEN '' ELSE q END WHEN c IN ('''', '"') THEN c ELSE '' END,
    part + CASE WHEN NOT skip AND q = '' AND (c IN ({cut}) {amp}) THEN 1 ELSE 0 END, NOT skip AND q = '' AND {"c = '&' " + two if double else "false"},
    CASE WHEN skip OR q = '' AND (c IN ({cut}) {amp}) THEN '' ELSE c END
  FROM (SELECT *, substr(t, i + 1, 1) AS c FROM {name}) WHERE i < length(t)
)""".replace(f"substr({text}, i + 2, 1)", "substr(t, i + 2, 1)")


_SOURCE = "|".join(X.SOURCE)
_READABLE = "|".join(X.READABLE)
_SCRATCH = X.SCRATCH
_q = lambda pattern: pattern.replace("'", "''")
_hit = lambda pattern: f"regexp_matches(stage, '{_q(pattern)}')"
_num = lambda pattern, k=1: f"TRY_CAST(nullif(regexp_extract(stage, '{_q(pattern)}', {k}), '') AS BIGINT)"
_BIG = "1000000000"

_READS = rf"""WITH RECURSIVE {_CALLS},
texts AS (SELECT row_number() OVER () AS r, cmd FROM (SELECT DISTINCT cmd FROM s)),
{_walk("a", "texts", "cmd", "';', chr(10)", True)},
statement AS (SELECT row_number() OVER () AS r, r AS text, part AS st, whole FROM (SELECT r, part, string_agg(ch, '' ORDER BY i) AS whole FROM a GROUP BY r, part) WHERE NOT regexp_matches(whole, '{X.SEARCH_PIPE}')),
piped AS (SELECT r, text, st, split_part(whole, '<<', 1) AS seg FROM statement),
{_walk("b", "piped", "seg", "'|'", False)},
stage AS (SELECT r, part AS sg, string_agg(ch, '' ORDER BY i) AS stage FROM b GROUP BY r, part),
named AS (SELECT r, sg, stage, list_filter(regexp_extract_all(stage, '{X.PATH}'), lambda t: NOT list_contains(regexp_extract_all(stage, '{X.REDIRECT}', 1), t) AND regexp_matches(lower(t), '\.(?:{_READABLE})$')) AS ts FROM stage),
rooted AS (SELECT r, sg, stage, list_filter(list_transform(ts, lambda t: list_reduce(list_filter(string_split(CASE WHEN t[1] = '/' THEN t ELSE '{reads.CWD}/' || t END, '/'), lambda x: x NOT IN ('', '.')),
  lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END, '')), lambda p: NOT regexp_matches(lower(p), '{_SCRATCH}')) AS ps FROM named),
ranged AS (SELECT *, CASE WHEN {_hit(X.SED_LINES)} THEN {_num(X.SED_LINES)} WHEN {_hit(X.HEAD)} THEN 1 WHEN {_hit(X.TAIL)} THEN 1 WHEN {_hit(X.AWK)} THEN CASE WHEN {_hit(X.AWK_ONE)} THEN {_num(X.AWK_ONE)} ELSE {_num(X.AWK_FROM)} END WHEN {_hit(X.READERS)} THEN 1 END AS lo,
  CASE WHEN {_hit(X.SED_LINES)} THEN {_num(X.SED_LINES, 2)} WHEN {_hit(X.HEAD)} THEN {_num(X.HEAD)} WHEN {_hit(X.TAIL)} THEN {_BIG} WHEN {_hit(X.AWK)} THEN CASE WHEN {_hit(X.AWK_ONE)} THEN {_num(X.AWK_ONE)} ELSE {_num(X.AWK_TO)} END WHEN {_hit(X.READERS)} THEN {_BIG} END AS hi,
  CASE WHEN NOT {_hit(X.SED_LINES)} AND NOT {_hit(X.HEAD)} THEN {_num(X.TAIL)} END AS tail FROM rooted),
kept AS (SELECT *, lo = 1 AND hi = {_BIG} AND tail IS NULL AS whole FROM ranged WHERE lo IS NOT NULL AND hi IS NOT NULL),
narrow AS (SELECT x.r, x.sg, max(y.sg) AS by FROM kept x JOIN kept y ON y.r = x.r AND y.sg > x.sg AND x.whole AND NOT y.whole AND len(y.ps) = 0 GROUP BY ALL),
final AS (SELECT x.r, x.sg, x.ps, coalesce(z.lo, x.lo) AS lo, coalesce(z.hi, x.hi) AS hi, CASE WHEN z.r IS NOT NULL THEN z.tail ELSE x.tail END AS tail FROM kept x LEFT JOIN narrow n ON n.r = x.r AND n.sg = x.sg LEFT JOIN kept z ON z.r = n.r AND z.sg = n.by),
rows AS (SELECT text, unnest(ps) AS path, generate_subscripts(ps, 1) AS k, st, sg, lo, hi, tail FROM final JOIN statement ON statement.r = final.r),
last AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY text, path ORDER BY st DESC, sg DESC, k DESC) = 1)
SELECT id, path, lo, hi, tail FROM s JOIN texts ON texts.cmd = s.cmd JOIN last ON last.text = texts.r"""

_EDITS = rf"""WITH {_CALLS},
n AS (SELECT id, cmd, list_concat(CASE WHEN regexp_matches(cmd, '{_q(X.EDITS)}') THEN regexp_extract_all(cmd, '{X.PATH}') ELSE [] END, regexp_extract_all(cmd, '{X.REDIRECT}', 1)) AS ps FROM s),
f AS (SELECT id, cmd, list_filter(list_transform(ps, lambda p: lower(p)), lambda p: regexp_matches(p, '\.(?:{_SOURCE})$') AND NOT regexp_matches(p, '{X.SCRATCH_EDIT}') AND NOT regexp_matches('/' || p, '/(test|tests|testing)/')
  AND NOT regexp_matches(string_split(p, '/')[-1], '^(test_|tests_|conftest)|_tests?\.|reproduce|^(repro|repro_bug|bug)(\.|$)')) AS ps FROM n),
b AS (SELECT id, cmd, list_transform(ps, lambda p: string_split(p, '/')[-1]) AS bs FROM f),
e AS (SELECT id, array_to_string(list_filter(bs, lambda x, i: list_position(bs, x) = i), ',') AS edited, regexp_matches(cmd, '{_q(X.MUTATES_ALL)}') AS mutates FROM b)
SELECT id, coalesce(edited, '') AS edited, mutates FROM e WHERE edited <> '' OR mutates"""

_ELIDED = """WITH d AS (SELECT l_suppkey AS key, l_orderkey * 10 + l_linenumber AS id, l_partkey * 7 % 5000 AS lo, l_orderkey % 6 AS kind, CAST(l_quantity AS BIGINT) AS n FROM lineitem),
x AS (SELECT key, id, lo, lo + CASE WHEN kind = 2 THEN n * 6 ELSE n END - 3 AS hi, kind, row_number() OVER () AS r FROM d),
cut AS (SELECT q.r, greatest(q.lo, c.lo) AS lo, least(q.hi, c.hi) AS hi, q.key FROM x q JOIN x c ON c.key = q.key AND c.kind = 0 AND c.lo <= q.hi AND q.lo <= c.hi AND greatest(q.lo, c.lo) <= least(q.hi, c.hi) WHERE q.kind NOT IN (0, 2)),
gone AS (SELECT DISTINCT r FROM cut WHERE NOT EXISTS (SELECT 1 FROM x v WHERE v.key = cut.key AND v.kind = 2 AND v.lo <= cut.lo AND v.hi >= cut.hi))
SELECT key, id, r IN (SELECT r FROM gone) AS elided FROM x WHERE kind NOT IN (0, 2)"""

_FIELD = r"""{}(?:\s*):(?:\s*)"((?:[^"\\]|\\.)*)\""""
_SCRAPED = rf"""WITH e AS (SELECT event_id, event_type, event_id % 7 AS n, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS v FROM events),
c AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN [event_type, '-x', v] END AS argv, CASE n WHEN 0 THEN '{{"command": "' || event_type || ' ' || v || '"}}' WHEN 1 THEN '{{"cmd": "' || event_type || ' ' || v || '", "command": ""}}'
  WHEN 2 THEN 'run({{cmd : "' || event_type || ' ' || v || '\n\"x\" \\n", n: 1}})' WHEN 3 THEN 'exec({{command:"' || event_type || ' ' || v || '"}})' WHEN 4 THEN '{{"command": ' || v || '}}' WHEN 5 THEN 'no command ' || event_type || ' ' || v END AS input FROM e),
j AS (SELECT *, CASE WHEN json_valid(input) AND json_type(input) = 'OBJECT' THEN input END AS obj, coalesce(nullif(regexp_extract(input, '{_FIELD.format("cmd")}', 1), ''), regexp_extract(input, '{_FIELD.format("command")}', 1)) AS raw FROM c),
u AS (SELECT *, list_reduce([{{'out': '', 'esc': false}}] || list_transform(string_split(raw, ''), lambda x: {{'out': x, 'esc': false}}), lambda a, x: CASE WHEN a.esc THEN {{'out': a.out || CASE x.out WHEN 'n' THEN chr(10) WHEN 't' THEN chr(9) WHEN 'r' THEN chr(13) ELSE x.out END, 'esc': false}}
  WHEN x.out = '\' THEN {{'out': a.out, 'esc': true}} ELSE {{'out': a.out || x.out, 'esc': false}} END).out AS plain FROM j)
SELECT event_id, coalesce(nullif(array_to_string(argv, ' '), ''), CASE WHEN json_type(obj, '$.command') = 'VARCHAR' THEN nullif(json_extract_string(obj, '$.command'), '') END,
  CASE WHEN json_type(obj, '$.cmd') = 'VARCHAR' THEN nullif(json_extract_string(obj, '$.cmd'), '') END, nullif(plain, '')) AS cmd FROM u"""

# Line by line: a line that opens a scratch here-document drops what follows, until its mark begins a line; then the rest of that line counts.
_ACTIONS = rf"""WITH RECURSIVE d AS (SELECT l_orderkey * 10 + l_linenumber AS id, row_number() OVER () AS rid, (l_partkey + l_linenumber) % 7 AS form, CAST(l_partkey AS VARCHAR) AS p, CAST(l_suppkey AS VARCHAR) AS q FROM lineitem),
a AS (SELECT id, rid, replace(replace(['cat > /tmp/fix.py <<''EOF''' || chr(10) || 'open(''src/A%p.py'', ''w'')' || chr(10) || '  EOF ; tee lib/b%q.py', 'cat > src/new%p.py <<EOF' || chr(10) || 'open(''src/c%q.py'',''w'')' || chr(10) || 'EOF', 'python /tmp/x.py >> /tmp/log%p.py > "tests/d%q.py"', 'echo 1 > tmp/e%p.py; sed -i s/x/y/ pkg/F%q.PY other/f%q.rs',
  'cat >> "/tmp/run" <<-END' || chr(10) || 'str_replace src/g%p.py' || chr(10) || 'no end', 'ls src/h%p.py > out%q.txt > k/l%p.go', 'apply_patch conftest.py src/m%p.c lib/test_n%q.py lib/m%p.c'][form + 1], '%p', p), '%q', q) AS action FROM d),
l AS (SELECT rid, string_split(action, chr(10)) AS ls FROM a),
w(rid, ls, k, mark, kept) AS (
  SELECT rid, ls, 0::BIGINT, NULL::VARCHAR, ''::VARCHAR FROM l
  UNION ALL SELECT rid, ls, k + 1, CASE WHEN mark IS NOT NULL AND NOT regexp_matches(x, '^\s*' || mark || '\b') THEN mark ELSE nullif(regexp_extract(x || chr(10), '(?i){X.SCRATCH_SCRIPT.replace("'", "''")}', 1), '') END,
    kept || CASE WHEN mark IS NOT NULL AND NOT regexp_matches(x, '^\s*' || mark || '\b') THEN '' ELSE x || chr(10) END
  FROM (SELECT *, ls[k + 1] AS x FROM w) WHERE k < len(ls)
),
f AS (SELECT a.id, a.rid, w.kept FROM a JOIN w ON w.rid = a.rid AND w.k = len(w.ls)),
n AS (SELECT id, rid, list_concat(CASE WHEN regexp_matches(kept, '{X.ACTION_EDITS.replace("'", "''")}') THEN regexp_extract_all(kept, '{X.ACTION_PATH}') ELSE [] END, list_filter(regexp_extract_all(kept, '>>?\s*({X.ACTION_PATH})', 1), lambda t: NOT regexp_matches(t, '{X.SCRATCH_TARGET.replace("'", "''")}'))) AS ps FROM f),
s AS (SELECT DISTINCT id, rid, unnest(list_transform(ps, lambda p: lower(p))) AS file FROM n),
e AS (SELECT id, rid, file FROM s WHERE regexp_matches(file, '\.(?:{_SOURCE})$') AND NOT regexp_matches(file, '{X.SCRATCH_EDIT}') AND NOT regexp_matches('/' || file, '/(test|tests|testing)/') AND NOT regexp_matches(string_split(file, '/')[-1], '^(test_|tests_|conftest)|_tests?\.|reproduce|^(repro|repro_bug|bug)(\.|$)'))
SELECT id, CAST(row_number() OVER (PARTITION BY rid ORDER BY file) - 1 AS INTEGER) AS n, file FROM e"""

SQL = {"action_edits": _ACTIONS, "shell_reads": _READS, "shell_edits": _EDITS, "elided_ranges": _ELIDED, "scraped_commands": _SCRAPED}
