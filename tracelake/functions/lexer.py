"""Shell commands as reads and edits of files: a quote-aware split to statements and stages, line ranges and paths of each stage.

Everything is a column function: a command is cut into tokens (a quoted stretch, a separator, or what lies between), separators become
one mark, and the text is split at the mark. Null commands read and edit nothing. Word classes and blanks are those of Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .commands import WHOLE, is_test_path

# Fixed values, equal to what existing clients are judged by: stages that read, with their lines; paths; searches; redirections; edits.
READERS = r"\b(cat|tac|nl|less|more|bat)\b"
SED_LINES = r"""\bsed\s+-n\b[^|;&]*?['"]?(\d+)\s*,\s*(\d+)\s*p"""
HEAD = r"\bhead\b\s+(?:-n?\s*)?(\d+)"
TAIL = r"\btail\b\s+(?:-n?\s*)?(\d+)"
AWK = r"\bawk\b[^|]*\bNR\b"
AWK_ONE, AWK_FROM, AWK_TO = r"NR\s*==\s*(\d+)", r"NR\s*>=?\s*(\d+)", r"NR\s*<=?\s*(\d+)"
PATH = r"/?(?:[\w.\-]+/)*[\w.\-]+\.[A-Za-z][A-Za-z0-9]*"
SEARCH_PIPE = r"\|\s*(?:grep|egrep|fgrep|rg|ack|ag|findstr)\b"
REDIRECT = r">>?\s*(/?[\w.\-/]+\.[A-Za-z][A-Za-z0-9]*)"
EDITS = (
    r"(?i)\bsed\s+-i\b|\bperl\s+-[a-z]*i|\btee\b|\bpatch\b|git\s+apply|apply_patch|str_replace|replace_in_file|edit_file|write_file|create_file|multi_edit|"
    r"\btruncate\b|\bdd\b[^|]*\bof=|\.write\(|\.write_text\b|\.writelines\b|open\([^)]*['\"]w['\"]|open\([^)]*,\s*['\"][wa]"
)
MUTATES_ALL = r"(?i)\bgit\s+(?:apply|checkout|stash|reset|restore|revert)\b|\bpatch\b[^|;&\n]*(?:-p\d|<)"
SOURCE = "py pyx pyi js jsx ts tsx java go rb rs c cc cpp cxx h hpp php cs scala kt swift m mm sh pl lua r jl ex exs clj erl hs ml vue svelte sql".split()
READABLE = [*SOURCE, *"txt rst md cfg ini toml yaml yml json xml html htm css rest text cnf conf".split()]
SCRATCH = r"^/dev/null$|\.pyc$|/__pycache__/|^/tmp/|^/private/tmp/|/appdata/local/temp/|/windows/temp/|\.diff$|\.patch$"
SCRATCH_EDIT = r"/tmp/|^tmp/|/appdata/local/temp/|/windows/temp/|^/dev/null$"

# Edits by the words of an agent's own action, scratch scripts in here-documents, and what a redirection may hit freely.
ACTION_EDITS = (
    r"(?i)\bsed\s+-i\b|\btee\b|\bpatch\b|git\s+apply|apply_patch|str_replace|replace_in_file|edit_file|write_file|create_file|\.write\(|"
    r"open\([^)]*['\"]w['\"]|open\([^)]*,\s*['\"]w"
)
ACTION_PATH = r"/?[\w.\-/]+\.[A-Za-z][A-Za-z0-9]*"
SCRATCH_SCRIPT = r""">>?\s*['"]?/tmp/[\w.\-/]*['"]?[^\n]*<<-?\s*['"]?(\w+)['"]?\n"""
SCRATCH_TARGET = r"""(?i)^['"]?(?:/tmp/|tmp/|/dev/null)"""

_QUOTED = r"""'[^']*(?:'|\z)|"[^"]*(?:"|\z)"""
_MARK = "\x01"
RANGE = "struct<lo:bigint,hi:bigint,tail:bigint>"


def let(value: Column, body) -> Column:
    """`body(value)`, with `value` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _wide(pattern: str) -> str:
    """Word classes, digits and blanks of Unicode."""
    return "(?U)" + pattern


def _fast(text: Column, way) -> Column:
    """`way(mode)` with the mode `_wide`; where the text is ASCII, for which that changes nothing but costs much, without it."""
    return F.when(F.octet_length(text) == F.length(text), way(lambda pattern: pattern)).otherwise(way(_wide))


def _like(text: Column, pattern: str) -> Column:
    return _fast(text, lambda mode: text.rlike(mode(pattern)))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return _fast(text, lambda mode: F.regexp_extract_all(text, F.lit(mode(pattern)), group))


def _split(text: Column, separators: list[str], rest: str) -> Column:
    """`text` split at the separators that stand outside quotes; an open quote holds all that follows."""
    tokens = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _MARK, "\x02"), F.lit(f"{_QUOTED}|{rest}"), 0)
    marked = F.transform(tokens, lambda t: F.when(t.isin(separators), _MARK).otherwise(t))
    return F.split(F.array_join(marked, ""), _MARK, -1)


def statements(cmd: Column) -> Column:
    """The statements of a command: it is cut at ; line ends and && outside quotes; pipelines stay whole."""
    return _split(cmd, ["&&", ";", "\n"], r"""&&|[;\n]|[^'"&;\n]+|&""")


def stages(statement: Column) -> Column:
    """The stages of a pipeline, cut at | outside quotes."""
    return _split(statement, ["|"], r"""\||[^'"|]+""")


def _int(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(_fast(text, lambda mode: F.regexp_extract(text, mode(pattern), group)), F.lit("")).try_cast("long")


def _range(lo: Column, hi: Column) -> Column:
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(None).cast("long").alias("tail")))


def line_range(stage: Column) -> Column:
    """struct<lo, hi, tail>: the lines that a reading stage shows; null for any other stage. `tail`: so many lines at the end, wherever
    that is, so lo and hi are the whole file's."""
    one, whole = F.lit(1).cast("long"), F.lit(WHOLE).cast("long")
    last = _int(stage, TAIL)
    single = _int(stage, AWK_ONE)
    awk = F.when(_like(stage, AWK_ONE), _range(single, single)).otherwise(_range(_int(stage, AWK_FROM), _int(stage, AWK_TO)))
    return (
        F.when(_like(stage, SED_LINES), _range(_int(stage, SED_LINES, 1), _int(stage, SED_LINES, 2)))
        .when(_like(stage, HEAD), _range(one, _int(stage, HEAD)))
        .when(_like(stage, TAIL), F.when(last.isNotNull(), F.struct(one.alias("lo"), whole.alias("hi"), last.alias("tail"))))
        .when(_like(stage, AWK), awk)
        .when(_like(stage, READERS), _range(one, whole))
    )


def _bare(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"(?U)^\s+|\s+$", ""), "^['\"]+|['\"]+$", "")


def absolute(path: Column, cwd: Column) -> Column:
    """The path from the root, with forward slashes, `.` and `..` resolved; a drive letter counts as a root."""
    p = F.translate(_bare(path), "\\", "/")
    joined = F.when(p.startswith("/") | p.rlike("^[A-Za-z]:/"), p).otherwise(F.concat(F.regexp_replace(F.translate(cwd, "\\", "/"), "/+$", ""), F.lit("/"), p))
    parts = F.filter(F.split(joined, "/", -1), lambda s: ~s.isin("", "."))
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", up(acc)).otherwise(F.array_append(acc, s))), "/"))


def _ends(names: list[str]) -> str:
    return rf"\.(?:{'|'.join(names)})$"


def stage_paths(stage: Column, cwd: Column) -> Column:
    """The readable files that a stage names, from the root; what it redirects to is not read, scratch files do not count."""
    written = _all(stage, REDIRECT, 1)
    named = F.filter(_all(stage, PATH, 0), lambda t: ~F.array_contains(written, t) & F.lower(t).rlike(_ends(READABLE)))
    return F.filter(F.transform(named, lambda t: absolute(t, cwd)), lambda p: ~F.lower(p).rlike(SCRATCH))


def _is_whole(r: Column) -> Column:
    return (r["lo"] == 1) & (r["hi"] >= WHOLE) & r["tail"].isNull()


def _statement_reads(statement: Column, cwd: Column) -> Column:
    """array<struct<path, lo, hi, tail>> of one statement. A whole read takes the lines of the last stage behind it that narrows its input."""
    found = F.transform(stages(F.substring_index(statement, "<<", 1)), lambda s: F.struct(line_range(s).alias("r"), stage_paths(s, cwd).alias("p")))

    def reads(all_stages: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            after = F.filter(F.slice(all_stages, i + 2, F.size(all_stages)), lambda y: (F.size(y["p"]) == 0) & y["r"].isNotNull() & ~_is_whole(y["r"]))
            own = F.when(_is_whole(x["r"]), F.coalesce(F.get(after, F.size(after) - 1)["r"], x["r"])).otherwise(x["r"])
            rows = let(own, lambda r: F.transform(x["p"], lambda p: F.struct(p.alias("path"), r["lo"].alias("lo"), r["hi"].alias("hi"), r["tail"].alias("tail"))))
            return F.when(x["r"].isNotNull(), rows).otherwise(F.array())

        return F.flatten(F.transform(all_stages, of))

    return F.when(_like(statement, SEARCH_PIPE), F.array()).otherwise(let(found, reads))


def shell_reads(cmd: Column, cwd: Column) -> Column:
    """array<struct<path, lo, hi, tail>> by path: what a command brings into context. A stage reads if its verb and a file stand in it;
    pipes into a search are no reads; of several reads of a file the last counts."""
    rows = F.flatten(F.transform(statements(cmd), lambda s: _statement_reads(s, cwd)))
    last = let(rows, lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda y: y["path"] == x["path"])))
    return F.array_sort(last)


def is_source(path: Column) -> Column:
    """Whether a path, lower case with forward slashes, is a source file that is no test and no scratch file."""
    return path.rlike(_ends(SOURCE)) & ~is_test_path(path) & ~path.rlike(SCRATCH_EDIT)


def shell_edits(cmd: Column) -> Column:
    """The base names, lower case, of the source files that a command edits: all it names if it has an editing word, and what it redirects to."""
    named = F.when(_like(cmd, EDITS), _all(cmd, PATH, 0)).otherwise(F.array())
    low = F.transform(F.concat(named, _all(cmd, REDIRECT, 1)), lambda p: F.translate(F.lower(p), "\\", "/"))
    own = F.filter(low, is_source)
    return F.coalesce(F.array_distinct(F.transform(own, lambda p: F.substring_index(p, "/", -1))), F.array())


def without_scratch_scripts(action: Column) -> Column:
    """An action without the bodies of here-documents that go to scratch files; a body ends at its mark at a line's start, or at the end."""
    body = f"((?i:{SCRATCH_SCRIPT}))(?s:.*?)((?m:^\\s*\\2\\b)|\\z)"
    return F.when(action.contains("<<"), _fast(action, lambda mode: F.regexp_replace(action, mode(body), "$1$3"))).otherwise(action)


def action_edits(action: Column) -> Column:
    """The source files, lower case and in order, that an action edits: all it names if it has an editing word, and what it redirects to."""

    def found(scan: Column) -> Column:
        named = F.when(_like(scan, ACTION_EDITS), _all(scan, ACTION_PATH, 0)).otherwise(F.array())
        written = F.filter(_all(scan, rf">>?\s*({ACTION_PATH})", 1), lambda t: ~t.rlike(SCRATCH_TARGET))
        low = F.array_distinct(F.transform(F.concat(named, written), F.lower))
        return F.array_sort(F.filter(low, is_source))

    return F.coalesce(let(without_scratch_scripts(action), found), F.array())


def mutates_all(cmd: Column) -> Column:
    """Whether a command may change any file of a working copy."""
    return F.coalesce(_like(cmd, MUTATES_ALL), F.lit(False))


def tool_range(path: Column, offset: Column, limit: Column, cwd: Column) -> Column:
    """struct<path, lo, hi, tail> of a structured read: from `offset`, `limit` lines; null for scratch files and without a path."""
    lo, hi = F.coalesce(offset, F.lit(1)), F.when(limit.isNotNull(), F.coalesce(offset, F.lit(1)) + limit - 1).otherwise(F.lit(WHOLE))
    full = absolute(path, cwd)
    row = F.struct(full.alias("path"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.lit(None).cast("long").alias("tail"))
    return F.when(path.isNotNull() & ~F.lower(full).rlike(SCRATCH), row)


def scraped_command(argv: Column, text: Column) -> Column:
    """A call's command: the words of its argument array, else the command or cmd field of a JSON object, else the first quoted value
    of such a field in a snippet of code, its escapes undone."""

    def field(key: str) -> Column:
        hit = F.regexp_extract(text, rf'(?s){key}(?U:\s*):(?U:\s*)"((?:[^"\\]++|\\.)*+)"', 1)
        # the mark stands for an escaped backslash while the other escapes are undone
        plain = F.regexp_replace(hit, r"\\\\", _MARK)
        for escape, char in (("n", "\n"), ("t", "\t"), ("r", "\r")):
            plain = F.regexp_replace(plain, rf"\\{escape}", char)
        plain = F.regexp_replace(plain, r"(?s)\\(.)", "$1")
        return F.when(text.rlike(rf'(?s){key}(?U:\s*):(?U:\s*)"(?:[^"\\]++|\\.)*+"'), F.translate(plain, _MARK, "\\"))

    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    is_text = lambda k: F.try_variant_get(F.try_parse_json(text), f"$.{k}", "variant")
    own = lambda k: F.when(is_object & (F.schema_of_variant(is_text(k)) == "STRING"), F.nullif(F.try_variant_get(F.try_parse_json(text), f"$.{k}", "string"), F.lit("")))
    words = F.nullif(F.array_join(argv, " "), F.lit(""))
    return F.coalesce(words, own("command"), own("cmd"), F.nullif(F.coalesce(field("cmd"), field("command")), F.lit("")))
