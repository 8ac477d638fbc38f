"""Structured tool calls as commands: column functions over a call's name and its input, a variant.

A value counts if it is true in the sense of the clients that wrote it: no null, false, zero, empty text, list or object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexer import is_source, let
from .text import strip

# Tool names by what they do, lower case, and the keys that name files, patterns and queries.
SHELL_NAMES = "bash shell run execute bashoutput bash_output".split()
READ_NAMES = "read notebookread notebook_read view cat openfile open_file".split()
EDIT_NAMES = "edit multiedit write str_replace str_replace_editor str_replace_based_edit_tool notebookedit notebook_edit create createfile".split()
SEARCH_NAMES = "grep glob search search_code searchcode find ripgrep rg".split()
EDIT_TOOLS = "edit multiedit multi_edit write str_replace str_replace_editor str_replace_based_edit_tool notebookedit notebook_edit create createfile create_file write_file edit_file apply_patch replace_in_file fsedit fswrite".split()
LITERAL_NAMES = "bash shell run execute".split()
FILE_KEYS = "file_path path filename file".split()
PATTERN_KEYS, PLACE_KEYS, QUERY_KEYS = "pattern query q".split(), "path glob include".split(), "query pattern q search".split()
FILE_TOOLS, PATTERN_TOOLS = ("Read", "Edit", "Write", "MultiEdit", "NotebookEdit"), ("Grep", "Glob")
#: Lines of a read that names its first line alone.
DEFAULT_LINES = 2000


def _json(args: Column, key: str) -> Column:
    return F.to_json(F.try_variant_get(args, f"$.{key}", "variant"))


def _text(args: Column, key: str) -> Column:
    return F.try_variant_get(args, f"$.{key}", "string")


def _kind(args: Column, key: str) -> Column:
    """The type of a field, null if it is missing; far cheaper than its JSON, which is made only for what is neither text nor a whole number."""
    return F.schema_of_variant(F.try_variant_get(args, f"$.{key}", "variant"))


def _value(args: Column, key: str) -> Column:
    """struct<is_text, text> of a field that counts, else null; `text` is what a string holds, True and False, or a number or JSON."""
    of = lambda is_text, text: F.struct(F.lit(is_text).alias("is_text"), text.alias("text"))
    text = lambda x: F.when(x == "true", "True").otherwise(F.coalesce(_text(args, key), x))
    empty = r'^(?:null|false|""|\[\]|\{\}|-?0(?:\.0+)?(?:[eE].*)?)$'
    other = let(_json(args, key), lambda x: F.when(x.isNotNull() & ~x.rlike(empty), of(False, text(x))))
    short = lambda s: F.when(s != "", of(True, s))
    whole = lambda s: F.when(s != "0", of(False, s))
    by_kind = lambda k: F.when(k == "STRING", let(_text(args, key), short)).when(k == "BIGINT", let(_text(args, key), whole)).when(k != "VOID", other)
    return let(_kind(args, key), by_kind)


def _first(args: Column, keys: list[str]) -> Column:
    return F.coalesce(*[_value(args, k) for k in keys])


def _is_text(args: Column, key: str) -> Column:
    return F.coalesce(_kind(args, key) == "STRING", F.lit(False))


def _number(args: Column, key: str) -> Column:
    """struct<fine, n>: a whole number from a number (cut toward zero), a truth value or a literal in text; missing is fine and null."""
    s = strip(_text(args, key))
    literal = let(s, lambda x: F.when(x.rlike(r"^[+-]?[0-9]+(?:_[0-9]+)*$"), F.translate(x, "_+", "").try_cast("long")))
    number = lambda j: F.coalesce(j.try_cast("long"), let(j.try_cast("double"), lambda x: F.when(F.abs(x) < 9.2e18, x.cast("long"))))
    other = let(_json(args, key), lambda j: F.when(j == "true", 1).when(j == "false", 0).otherwise(number(j)).cast("long"))
    whole = lambda k: F.when(k == "BIGINT", F.try_variant_get(args, f"$.{key}", "long")).when(k == "STRING", literal).when(k != "VOID", other)
    return let(_kind(args, key), lambda k: let(whole(k), lambda n: F.struct((k.isNull() | (k == "VOID") | n.isNotNull()).alias("fine"), n.alias("n"))))


def twin_command(tool: Column, args: Column) -> Column:
    """The shell command that does what a call does: a shell tool's own command, reads as line windows (2,000 lines from a first line
    alone) or cat, edits by base name, searches by a pattern of at most 200 characters without quotes; null for other calls.

    An offset or limit that is no whole number makes the whole file read; 0 counts as none.
    """
    def window(x: Column) -> Column:
        good = x["off"]["fine"] & x["lim"]["fine"]
        first, most = (F.when(good & (x[c]["n"] != 0), x[c]["n"]) for c in ("off", "lim"))
        last = first + F.when(most.isNotNull(), F.greatest(F.lit(1), most)).otherwise(F.lit(DEFAULT_LINES)) - 1
        return F.concat(F.lit("sed -n '"), first.cast("string"), F.lit(","), last.cast("string"), F.lit("p' "))

    # fields are looked up only for the names that use them
    own = F.when(_is_text(args, "command"), _text(args, "command"))
    path = let(_first(args, FILE_KEYS), lambda f: F.when(f["is_text"], f["text"]))
    lines = F.struct(_number(args, "offset").alias("off"), _number(args, "limit").alias("lim"))
    read = let(path, lambda p: F.when(p.isNotNull(), F.concat(F.coalesce(let(lines, window), F.lit("cat ")), p)))
    pattern = F.translate(F.substring(F.coalesce(_first(args, PATTERN_KEYS)["text"], F.lit("")), 1, 200), "'", " ")
    search = F.concat(F.lit("grep '"), pattern, F.lit("' "), F.coalesce(_first(args, PLACE_KEYS)["text"], F.lit("")))

    def twin(name: Column) -> Column:
        return (
            F.when(name.isin(SHELL_NAMES), let(own, lambda o: F.when(strip(o) != "", o))).when(name.isin(READ_NAMES), read)
            .when(name.isin(EDIT_NAMES), F.concat(F.lit("edit "), F.substring_index(path, "/", -1))).when(name.isin(SEARCH_NAMES), strip(search))
        )

    return let(F.lower(strip(tool)), twin)


def rendered_command(tool: Column, args: Column) -> Column:
    """A shell tool's command as it is; any other call as its name and key=value, keys in order, values of at most 160 characters
    (then an ellipsis), 400 in all. Values other than text are JSON."""
    fields = F.from_json(F.to_json(args), "map<string,string>")
    clipped = lambda v: F.when(F.length(v) > 160, F.concat(F.substring(v, 1, 160), F.lit("…"))).otherwise(v)
    parts = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), clipped(F.coalesce(e["value"], F.lit("null")))))
    shown = F.substring(strip(F.concat(tool, F.lit(" "), F.array_join(F.coalesce(parts, F.array().cast("array<string>")), " "))), 1, 400)
    return F.when(F.lower(tool).isin(LITERAL_NAMES) & _is_text(args, "command"), _text(args, "command")).otherwise(shown)


def call_query(args: Column) -> Column:
    """The first text with content among a call's query fields, as it is; empty if there is none."""
    texts = [F.when(_text(args, k).isNotNull() & _is_text(args, k), _text(args, k)) for k in QUERY_KEYS]
    return F.coalesce(*[F.when(strip(t) != "", t) for t in texts], F.lit(""))


def call_command(tool: Column, args: Column, twin: Column | None = None) -> Column:
    """What a call counts as in a trace: its shell twin (`twin`, where that is known), else its rendering."""
    name = strip(F.coalesce(tool, F.lit("")))
    return let(twin_command(name, args) if twin is None else twin, lambda t: F.when(t != "", t).otherwise(rendered_command(name, args)))


def shown_action(tool: Column, args: Column) -> Column:
    """A readable line for any call: a shell command, a file tool with its file, a search with its pattern, else the name."""
    name = F.coalesce(F.nullif(tool, F.lit("")), F.lit("tool"))
    get = lambda *keys: F.coalesce(_first(args, list(keys))["text"], F.lit(""))
    return (
        F.when(name.isin("Bash", "bash"), get("command")).when(name.isin(*FILE_TOOLS), strip(F.concat(name, F.lit(" "), get("file_path", "notebook_path"))))
        .when(name.isin(*PATTERN_TOOLS), strip(F.concat(name, F.lit(" "), get("pattern")))).otherwise(name)
    )


def edited_source(tool: Column, args: Column) -> Column:
    """The source file, lower case, that a structured edit names; null for other tools, tests and scratch files."""
    low = let(_first(args, FILE_KEYS), lambda f: F.regexp_replace(F.lower(F.when(f["is_text"], f["text"])), "^['\"]+|['\"]+$", ""))
    return F.when(F.lower(strip(tool)).isin(EDIT_TOOLS), let(low, lambda x: F.when(is_source(F.translate(x, "\\", "/")), x)))
