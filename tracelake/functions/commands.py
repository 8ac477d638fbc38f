"""Column functions over shell commands, paths and command output. Null arguments give null, or the empty array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_space

#: The last line of a read without an end.
WHOLE = 1_000_000_000
# What counts as a search, as a read, and as a read whose output lines are not file lines.
SEARCH_VERBS = r"\b(grep|rg|egrep|fgrep|ag|ack|find|git grep)\b"
READ_VERBS = r"\b(cat|sed|head|tail|less|more|nl|awk|view|open)\b"
RENUMBERING_VERBS = r"\b(tail|awk|nl|sed|less|more|view|open)\b"
WINDOW_READ = r"""sed\s+(?:-[a-zA-Z]+\s+)*-n\s+['"]?(\d+),(\d+)p['"]?\s+(.+)"""
WHOLE_READ = r"^(?i:cat|head|tail|grep|egrep|fgrep|awk|type|more|less|Get-Content)\b(.*)"
# Line windows in commands, words that name files, and where an output names its exit code.
WINDOW, ONE_LINE, HEAD_LINES, AWK_WINDOW = r"\b(\d+),(\d+)p", r"\bsed\s+-n\s+(\d+)p", r"\bhead\s+(?:-n\s*)?(\d+)", r"NR\s*>=\s*(\d+)\s*&&\s*NR\s*<=\s*(\d+)"
FILE_WORD, TOKEN = r"[A-Za-z0-9_./+-]*\.[A-Za-z]{1,5}$", r"""'[^']+'|"[^"]+"|\S+"""
EXIT_CODES = (r"(?i)<returncode>\s*(-?\d+)\s*</returncode>", r"(?i)\breturncode[:=]\s*(-?\d+)")
# The extension classes, in the order of their columns.
EXTENSIONS = "gml ps1 md txt json py png log yy jsonl sh diff html yyp patch js ts tsx rs go java c h cpp yaml yml toml rb cs css".split()
TEST_DIRS = ("test", "tests", "testing")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_norm(path: Column) -> Column:
    """Slashes forward, quotes off both ends, lower case."""
    return F.lower(F.regexp_replace(F.translate(path, "\\", "/"), "^['\"]+|['\"]+$", ""))


def norm_cmd(cmd: Column) -> Column:
    return collapse_space(cmd)


def _words(cmd: Column) -> Column:
    return F.filter(F.split(F.translate(cmd, "'\"", "  "), r"\s+"), lambda w: w != "")


def first_file(cmd: Column) -> Column:
    """The base name of the first word that looks like a file."""
    return F.get(F.filter(F.transform(_words(cmd), basename), lambda b: b.rlike(r"\.[A-Za-z]{1,5}")), 0)


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")), F.lit("9" * 18)).cast("long")


def sed_base(cmd: Column) -> Column:
    """The file line that the output's first line is: from a line window, else 1."""
    return F.coalesce(_number(cmd, WINDOW), _number(cmd, ONE_LINE), F.lit(1).cast("long"))


def coords_trusted(cmd: Column) -> Column:
    """Whether output lines can be named by file lines."""
    window = cmd.rlike(WINDOW) | cmd.rlike(ONE_LINE)
    return window | (cmd.rlike(READ_VERBS) & ~cmd.contains("|") & ~cmd.rlike(RENUMBERING_VERBS))


def ext_class(file: Column) -> Column:
    """The extension's class, `other`, or `none` for no file, no dot or a leading dot."""
    b = F.lower(file)
    ext = F.substring_index(b, ".", -1)
    nothing = F.coalesce(file, F.lit("")) == ""
    return F.when(nothing | ~b.contains(".") | b.startswith(".") | (ext == ""), "none").when(ext.isin(EXTENSIONS), ext).otherwise("other")


def is_test_path(path: Column) -> Column:
    """Judged by path components, never by substring of the whole."""
    parts = F.split(path_norm(path), "/")
    base = F.element_at(parts, -1)
    in_dir = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*TEST_DIRS))
    named = base.rlike("^(test_|tests_|conftest)") | base.rlike("_tests?[.]") | base.contains("reproduce") | F.substring_index(base, ".", 1).isin("repro", "repro_bug", "bug")
    return in_dir | named


def planning_doc(path: Column) -> Column:
    """A base name with `handoff`, or with plan, plans or planning as a word of letters."""
    b = F.lower(F.substring_index(F.translate(path, "\\", "/"), "/", -1))
    return b.contains("handoff") | b.contains("plan") & F.arrays_overlap(F.split(b, "[^a-z]"), F.array(F.lit("plan"), F.lit("plans"), F.lit("planning")))


def path_tokens(text: Column) -> Column:
    """Quoted or bare words that name a file: no flag, four characters or more, a separator, and a dot in the base name."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), lambda t: F.trim(F.when(t.rlike("""^(['"]).+\\1$"""), F.substring(t, 2, F.length(t) - 2)).otherwise(t)))
    return F.filter(raw, lambda t: ~t.startswith("-") & (F.length(t) >= 4) & t.rlike(r"[/\\]") & F.substring_index(F.translate(t, "\\", "/"), "/", -1).contains("."))


def read_targets(cmd: Column) -> Column:
    """array<struct<path, lo, hi>>: a line window of each windowed read, the whole file for other readers; segments end at | ; and &."""

    def targets(seg: Column) -> Column:
        lo, hi = _number(seg, WINDOW_READ, 1), _number(seg, WINDOW_READ, 2)
        window = F.transform(path_tokens(F.regexp_extract(seg, WINDOW_READ, 3)), lambda p: F.struct(p.alias("path"), lo.alias("lo"), F.greatest(lo, hi).alias("hi")))
        whole = F.transform(path_tokens(F.regexp_extract(seg, WHOLE_READ, 1)), lambda p: F.struct(p.alias("path"), F.lit(1).cast("long").alias("lo"), F.lit(WHOLE).cast("long").alias("hi")))
        return F.when(seg.rlike(WINDOW_READ), window).otherwise(whole)

    return F.flatten(F.transform(F.split(cmd, "[|;&]+"), lambda s: targets(F.trim(s))))


def parse_reads(cmd: Column) -> Column:
    """array<struct<file, lo, hi>>: every file word of the command with its line range; null bounds are the whole file."""
    files = F.filter(F.transform(_words(cmd), basename), lambda b: b.rlike(FILE_WORD))
    one, head = _number(cmd, ONE_LINE), _number(cmd, HEAD_LINES)
    lo = F.coalesce(_number(cmd, WINDOW, 1), _number(cmd, AWK_WINDOW, 1), one, F.when(head.isNotNull(), 1))
    hi = F.coalesce(_number(cmd, WINDOW, 2), _number(cmd, AWK_WINDOW, 2), one, head)
    return F.transform(files, lambda f: F.struct(f.alias("file"), lo.alias("lo"), hi.alias("hi")))


def _is_path(token: Column) -> Column:
    return (token != "") & (token.contains("/") | token.rlike(r"\.[A-Za-z][A-Za-z0-9]{0,4}$"))


def grep_candidate(line: Column) -> Column:
    """struct<file, line> of a search result line `path:n:..`, `path:..` or a bare path; null for any other line."""
    t = F.trim(line)
    parts = F.split(t, ":", 3)
    path, n = parts[0], F.trim(F.get(parts, 1))
    word = F.regexp_replace(F.split(t, r"\s+")[0], ":+$", "")

    def found(file: Column, number: Column | None = None) -> Column:
        return F.struct(basename(file).alias("file"), (F.lit(None) if number is None else number).cast("long").alias("line"))

    numbered = (F.size(parts) >= 3) & n.rlike("^[0-9]{1,18}$") & _is_path(path)
    return (
        F.when((t == "") | t.startswith("[reranked"), F.lit(None))
        .when(numbered, found(path, F.when(numbered, n)))
        .when((F.size(parts) >= 2) & _is_path(path), found(path))
        .when(_is_path(word), found(word))
    )


def obs_rc(observation: Column) -> Column:
    """The exit code named in the first 400 characters."""
    head = F.substring(observation, 1, 400)
    return F.coalesce(*[_signed(head, p) for p in EXIT_CODES])


def _signed(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("long")


def covered(lo: Column, hi: Column, ranges: Column, share: float) -> Column:
    """Whether the common lines with each of `ranges` (struct<lo, hi>), summed unclipped, reach `share` of lo..hi."""
    common = F.aggregate(ranges, F.lit(0).cast("long"), lambda a, r: a + F.greatest(F.lit(0), F.least(hi, r["hi"]) - F.greatest(lo, r["lo"]) + 1))
    return (hi >= lo) & (common >= F.lit(share) * (hi - lo + 1))
