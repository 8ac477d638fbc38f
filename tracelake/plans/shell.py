"""Queries over commands and observations, with their SQL."""

from __future__ import annotations

from ..operators import shell

QUERIES = {
    "command_fields": ("lineitem", shell.derived_shell, shell.command_fields),
    "command_targets": ("lineitem", shell.derived_shell, shell.command_targets),
    "command_reads": ("lineitem", shell.derived_shell, shell.command_reads),
    "patch_hunks": ("lineitem", shell.derived_patch, shell.patch_hunks),
    "chunk_observation": ("documents", None, shell.observation_chunks),
    "chunk_reads": ("documents", None, lambda d: shell.observation_chunks(d.filter("doc_id % 3 = 0"), atom=None)),
}

_SHELL = """s AS (SELECT *, CASE form WHEN 0 THEN 'sed -n ''' || lo || ',' || lo + 9 || 'p'' ' || path || ' | head -5' WHEN 1 THEN 'cat  ' || path || ';' || chr(9) || 'ls' WHEN 2 THEN 'head -n ' || lo || ' ' || path || ' && tail -3 "' || path || '"'
WHEN 3 THEN 'grep -n foo ' || path WHEN 4 THEN 'awk ''NR>=' || lo || ' && NR<=' || lo + 9 || ''' ' || path WHEN 5 THEN 'sed -n ' || lo || 'p ' || path ELSE 'python -m pytest tests' END AS cmd FROM (
SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS conv, CAST(l_quantity AS BIGINT) AS lo, CAST(trunc(l_extendedprice) AS BIGINT) % 50 * 100000 + 100 AS tokens, row_number() OVER () AS rid, CAST(l_linenumber % 7 AS BIGINT) AS form,
'/Repo/' || ['src', 'tests', 'Docs', 'lib'][l_partkey % 4 + 1] || '/plan-' || l_partkey % 50 || ['.py', '.ts', '.md', '.Txt', '', '.tar.gz', '_test.py'][l_suppkey % 7 + 1] AS path FROM lineitem))
"""
_TOKENS = r"""list_filter(list_transform(regexp_extract_all({}, '''[^'']+''|"[^"]+"|\S+'), lambda t: trim(CASE WHEN (t[1] = '''' OR t[1] = '"') AND t[1] = t[-1] AND length(t) > 2 THEN t[2:length(t) - 1] ELSE t END)),
lambda t: t[1] <> '-' AND length(t) >= 4 AND contains(t, '/') AND contains(string_split(t, '/')[-1], '.'))"""
_EXT = ", ".join(f"'{x}'" for x in "gml ps1 md txt json py png log yy jsonl sh diff html yyp patch js ts tsx rs go java c h cpp yaml yml toml rb cs css".split())
_NUM = r"CAST(nullif(regexp_extract({}, '{}', {}), '') AS BIGINT)"


def _num(text: str, pattern: str, group: int = 1) -> str:
    return _NUM.format(text, pattern, group)


_READS = r"(?i)^(?:cat|head|tail|grep|egrep|fgrep|awk|type|more|less|Get-Content)\b(.*)"
_WINDOW = r"""sed\s+(?:-[a-zA-Z]+\s+)*-n\s+[''"]?(\d+),(\d+)p[''"]?\s+(.+)"""
_LOWER_BASE = "lower(string_split(path, '/')[-1])"

SQL = {
    # Reads in windows of 40 lines, blank ones too; a text without any line is one chunk.
    "chunk_reads": """WITH p AS (SELECT doc_id AS id, text, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0),
l AS (SELECT id, text, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS ls FROM p),
w AS (SELECT id, ls, unnest(range((len(ls) + 39) // 40)) AS n FROM l)
SELECT id, n, 'read' AS kind, 'doc.py' AS file, id + n * 40 AS lo, id + least(n * 40 + 40, len(ls)) - 1 AS hi, CAST(greatest(1, length(array_to_string(ls[n * 40 + 1:n * 40 + 40], chr(10))) // 4) AS BIGINT) AS tokens, sha256(array_to_string(ls[n * 40 + 1:n * 40 + 40], chr(10))) AS sha FROM w
UNION ALL SELECT id, 0, 'read', 'doc.py', NULL, NULL, greatest(1, length(text) // 4), sha256(text) FROM l WHERE len(ls) = 0""",
    "command_fields": rf"""WITH {_SHELL}, f AS (SELECT *, list_filter(list_transform(list_filter(regexp_split_to_array(translate(cmd, '''"', '  '), '\s+'), lambda w: w <> ''), lambda w: string_split(w, '/')[-1]), lambda b: regexp_matches(b, '\.[A-Za-z]{{1,5}}'))[1] AS first_file, string_split(lower(path), '/') AS parts FROM s)
SELECT id, first_file, coalesce({_num("cmd", r"\b(\d+),(\d+)p")}, {_num("cmd", r"\bsed\s+-n\s+(\d+)p")}, 1) AS base,
regexp_matches(cmd, '\b\d+,\d+p') OR regexp_matches(cmd, '\bsed\s+-n\s+\d+p') OR (regexp_matches(cmd, '\b(cat|sed|head|tail|less|more|nl|awk|view|open)\b') AND NOT contains(cmd, '|') AND NOT regexp_matches(cmd, '\b(tail|awk|nl|sed|less|more|view|open)\b')) AS trusted,
trim(regexp_replace(cmd, '\s+', ' ', 'g')) AS norm, lower(path) AS path,
CASE WHEN NOT contains(parts[-1], '.') OR parts[-1][1] = '.' OR string_split(parts[-1], '.')[-1] = '' THEN 'none' WHEN string_split(parts[-1], '.')[-1] IN ({_EXT}) THEN string_split(parts[-1], '.')[-1] ELSE 'other' END AS ext,
len(list_filter(parts[1:len(parts) - 1], lambda p: p IN ('test', 'tests', 'testing'))) > 0 OR regexp_matches(parts[-1], '^(test_|tests_|conftest)') OR regexp_matches(parts[-1], '_tests?[.]') OR contains(parts[-1], 'reproduce') OR string_split(parts[-1], '.')[1] IN ('repro', 'repro_bug', 'bug') AS is_test,
contains(parts[-1], 'handoff') OR len(list_filter(regexp_split_to_array(parts[-1], '[^a-z]'), lambda t: t IN ('plan', 'plans', 'planning'))) > 0 AS planning,
CAST(len({_TOKENS.format("cmd")}) AS INTEGER) AS n_paths, CASE WHEN tokens >= 1000000 THEN printf('%.1f', tokens / 1e6) || 'M' WHEN tokens >= 1000 THEN printf('%.1f', tokens / 1e3) || 'k' ELSE CAST(tokens AS VARCHAR) END AS label,
substr(trim(regexp_replace(cmd, '\s+', ' ', 'g')), 1, 120) AS fp, conv || ':read:' || substr(cmd, 1, 60) || ':' || substr(sha256(cmd), 1, 16) AS key, substr(sha256('salt' || cmd), 1, 16) AS salted FROM f""",
    "command_targets": rf"""WITH {_SHELL}, g AS (SELECT id, rid, unnest(list_transform(regexp_split_to_array(cmd, '[|;&]+'), lambda x: trim(x))) AS seg, generate_subscripts(regexp_split_to_array(cmd, '[|;&]+'), 1) AS k FROM s),
t AS (SELECT id, rid, k, {_num("seg", _WINDOW)} AS a, {_num("seg", _WINDOW, 2)} AS b, CASE WHEN regexp_matches(seg, '{_WINDOW}') THEN {_TOKENS.format(f"regexp_extract(seg, '{_WINDOW}', 3)")} ELSE {_TOKENS.format(f"regexp_extract(seg, '{_READS}', 1)")} END AS ps FROM g),
u AS (SELECT id, rid, k, a, b, unnest(ps) AS path, generate_subscripts(ps, 1) AS j FROM t)
SELECT id, CAST(row_number() OVER (PARTITION BY rid ORDER BY k, j) - 1 AS INTEGER) AS n, path, coalesce(a, 1) AS lo, CASE WHEN a IS NULL THEN 1000000000 ELSE greatest(a, b) END AS hi FROM u""",
    "command_reads": rf"""WITH {_SHELL}, f AS (SELECT id, cmd, list_filter(list_transform(list_filter(regexp_split_to_array(translate(cmd, '''"', '  '), '\s+'), lambda w: w <> ''), lambda w: string_split(w, '/')[-1]), lambda b: regexp_matches(b, '[A-Za-z0-9_./+-]*\.[A-Za-z]{{1,5}}$')) AS fs FROM s),
r AS (SELECT id, fs, coalesce({_num("cmd", r"\b(\d+),(\d+)p")}, {_num("cmd", r"NR\s*>=\s*(\d+)\s*&&\s*NR\s*<=\s*(\d+)")}, {_num("cmd", r"\bsed\s+-n\s+(\d+)p")}, CASE WHEN regexp_matches(cmd, '\bhead\s+(?:-n\s*)?\d+') THEN 1 END) AS lo,
coalesce({_num("cmd", r"\b(\d+),(\d+)p", 2)}, {_num("cmd", r"NR\s*>=\s*(\d+)\s*&&\s*NR\s*<=\s*(\d+)", 2)}, {_num("cmd", r"\bsed\s+-n\s+(\d+)p")}, {_num("cmd", r"\bhead\s+(?:-n\s*)?(\d+)")}) AS hi FROM f)
SELECT id, CAST(generate_subscripts(fs, 1) - 1 AS INTEGER) AS n, unnest(fs) AS file, lo, hi FROM r""",
    "patch_hunks": "SELECT l_orderkey AS id, 'f' || l_partkey || '.py' AS file, CAST(l_quantity AS BIGINT) AS lo, CAST(l_quantity AS BIGINT) + greatest(1, l_partkey % 3) - 1 AS hi FROM lineitem UNION ALL SELECT l_orderkey, f, q, q FROM (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, lag('f' || l_partkey || '.py') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS f FROM lineitem) WHERE f IS NOT NULL",
    "chunk_observation": r"""WITH p AS (SELECT doc_id AS id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
l AS (SELECT id, unnest(CASE WHEN p[len(p)] = '' AND (id % 3 <> 1 OR (len(p) - 1) % 3 <> 0) THEN p[1:len(p) - 1] ELSE p END) AS x, generate_subscripts(CASE WHEN p[len(p)] = '' AND (id % 3 <> 1 OR (len(p) - 1) % 3 <> 0) THEN p[1:len(p) - 1] ELSE p END, 1) - 1 AS i FROM p),
o AS (SELECT id, i, CASE WHEN id % 3 = 1 AND i % 3 = 0 THEN 'src/f' || i || '.py:' || (i + 5) || ': ' || x ELSE x END AS line FROM l),
c AS (SELECT *, regexp_matches(line, '\S') AS has, id % 3 = 1 AND (i % 3 = 0) AS marked, regexp_split_to_array(trim(line), '\s+')[1] AS word, string_split(trim(line), ':') AS parts FROM o),
k AS (SELECT *, CASE WHEN marked THEN 'f' || i || '.py' WHEN id % 3 <> 1 OR NOT has THEN NULL WHEN len(parts) >= 2 AND parts[1] <> '' AND (contains(parts[1], '/') OR regexp_matches(parts[1], '\.[A-Za-z][A-Za-z0-9]{0,4}$')) THEN string_split(parts[1], '/')[-1]
  WHEN regexp_replace(word, ':+$', '') <> '' AND (contains(regexp_replace(word, ':+$', ''), '/') OR regexp_matches(regexp_replace(word, ':+$', ''), '\.[A-Za-z][A-Za-z0-9]{0,4}$')) THEN string_split(regexp_replace(word, ':+$', ''), '/')[-1] END AS file,
  CASE WHEN marked THEN i + 5 WHEN id % 3 = 1 AND len(parts) >= 3 AND regexp_matches(trim(parts[2]), '^[0-9]{1,18}$') AND (contains(parts[1], '/') OR regexp_matches(parts[1], '\.[A-Za-z][A-Za-z0-9]{0,4}$')) THEN CAST(trim(parts[2]) AS BIGINT) END AS num FROM c),
a AS (SELECT id, 'read' AS kind, 'doc.py' AS file, min(id + i) AS lo, max(id + i) AS hi, string_agg(line, chr(10) ORDER BY i) AS text, min(i) AS pos FROM (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY i) - 1) // 10 AS g FROM k WHERE id % 3 = 0 AND has) GROUP BY id, g),
r AS (SELECT *, count(file) OVER (PARTITION BY id ORDER BY i) AS run FROM k WHERE id % 3 = 1),
v AS (SELECT *, (row_number() OVER (PARTITION BY id, run ORDER BY i) - 1) // 40 AS g FROM r WHERE file IS NULL UNION ALL SELECT *, -1, i // 40 FROM k WHERE id % 3 = 2),
w AS (SELECT id, 'other' AS kind, NULL AS file, NULL AS lo, NULL AS hi, string_agg(line, chr(10) ORDER BY i) AS text, min(i) AS pos FROM v GROUP BY id, run, g HAVING bool_or(has)),
u AS (SELECT * FROM a UNION ALL SELECT * FROM w UNION ALL SELECT id, 'grep', file, num, num, line, i FROM r WHERE file IS NOT NULL),
b AS (SELECT * FROM u UNION ALL SELECT id, CASE WHEN id % 3 = 0 THEN 'read' ELSE 'other' END, CASE WHEN id % 3 = 0 THEN 'doc.py' END, NULL, NULL, array_to_string(p, chr(10)), 0 FROM p WHERE id NOT IN (SELECT id FROM u))
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS BIGINT) AS n, kind, file, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens, sha256(text) AS sha FROM b""",
}
