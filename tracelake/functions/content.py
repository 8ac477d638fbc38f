"""Column functions over message content, tool lists and read inputs held as variants. A missing value gives the empty text or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .commands import WHOLE

# Parts that carry text, items that carry a tool's output, fields that carry reasoning, and a fenced command.
MESSAGE_PARTS = ("input_text", "output_text", "text")
TOOL_OUTPUTS = ("function_call_output", "custom_tool_call_output", "local_shell_call_output")
REASONING_FIELDS = ("provider_specific_fields", "thinking_blocks", "reasoning_content")
COMMAND_BLOCK = r"(?s)```(?:bash|sh)?\n(.*?)```"
# The fields of a request that its token count depends on.
COUNTED_FIELDS = ("model", "messages", "system", "tools", "tool_choice", "thinking")
REASONING_CHARS = 2000
STUB_CHARS = 200
STUB_NOTE = "[Schema left out. Call the tool by name; the full schema follows from the next turn on.]"


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def plain(v: Column, path: str = "$") -> Column:
    """The string at `path`; null for anything but a string."""
    return F.when(F.schema_of_variant(get(v, path, "variant")) == "STRING", get(v, path))


def truthy(v: Column) -> Column:
    """Neither missing nor null, false, zero or empty."""
    return F.coalesce(~F.to_json(v).isin("null", "false", '""', "[]", "{}", "0", "0.0", "-0.0", "0E0"), F.lit(False))


def _joined(texts: Column, sep: str) -> Column:
    return F.array_join(F.filter(texts, lambda t: t != ""), sep)


def _parts(v: Column, path: str, kinds: tuple[str, ...]) -> Column:
    kept = F.filter(get(v, path, "array<variant>"), lambda p: get(p, "$.type").isin(*kinds))
    return F.transform(kept, lambda p: F.coalesce(plain(p, "$.text"), F.lit("")))


def system_text(v: Column) -> Column:
    """A string as it is, or text blocks (empty ones too) joined by line ends."""
    return F.coalesce(plain(v), F.array_join(_parts(v, "$", ("text",)), "\n"), F.lit(""))


def content_text(v: Column) -> Column:
    """A string as it is, or the text blocks and the text in tool results, empty ones dropped, joined by spaces."""
    result = lambda b: F.coalesce(plain(b, "$.content"), F.array_join(_parts(b, "$.content", ("text",)), " "), F.lit(""))
    kind = lambda b: get(b, "$.type")
    texts = F.transform(get(v, "$", "array<variant>"), lambda b: F.when(kind(b) == "text", F.coalesce(plain(b, "$.text"), F.lit(""))).when(kind(b) == "tool_result", result(b)).otherwise(""))
    return F.coalesce(plain(v), _joined(texts, " "), F.lit(""))


def is_message(item: Column) -> Column:
    """Typed as a message, or without type but with a role."""
    return F.when(get(item, "$.type").isNull(), get(item, "$.role", "variant").isNotNull()).otherwise(get(item, "$.type") == "message")


def item_text(item: Column) -> Column:
    """A message's or a tool output's text, parts joined by spaces; empty for every other item."""
    at = lambda path: F.coalesce(plain(item, path), _joined(_parts(item, path, MESSAGE_PARTS), " "), F.lit(""))
    return F.when(is_message(item), at("$.content")).when(get(item, "$.type").isin(*TOOL_OUTPUTS), at("$.output")).otherwise("")


def protected_item(item: Column) -> Column:
    return F.coalesce(is_message(item), F.lit(False)) & ~F.coalesce(get(item, "$.role").isin("system", "developer"), F.lit(False))


def _first_truthy(v: Column, paths: tuple[str, ...]) -> Column:
    found = [F.when(truthy(get(v, p, "variant")), get(v, p, "variant")) for p in paths]
    return F.coalesce(*found)


def action_text(message: Column) -> Column:
    """What a message does: its actions joined by ` ; `, else its calls' commands or raw arguments, else its first fenced command, else its
    text. A command that is no string makes the whole of it the text."""
    keys = ("$.command", "$.query")
    text = content_text(get(message, "$.content", "variant"))
    acts = get(message, "$.extra.actions", "array<variant>")
    word = lambda v: F.when(v.isNull(), "").otherwise(plain(v))
    done = F.transform(acts, lambda a: word(_first_truthy(a, keys)))
    calls = F.transform(F.coalesce(get(message, "$.tool_calls", "array<variant>"), F.array().cast("array<variant>")), lambda c: _first_truthy(c, ("$.function.arguments",)))
    calls = F.filter(calls, lambda a: a.isNull() | plain(a).isNotNull())

    def call(args: Column) -> Column:
        raw = F.coalesce(plain(args), F.lit(""))
        held = _first_truthy(F.try_parse_json(raw), keys)
        return F.when(held.isNull(), raw).otherwise(plain(held))

    called = F.transform(calls, call)
    joined = lambda xs: F.when(F.exists(xs, lambda x: x.isNull()), text).otherwise(F.array_join(xs, " ; "))
    fenced = F.when(text.rlike(COMMAND_BLOCK), F.trim(F.regexp_extract(text, COMMAND_BLOCK, 1), F.lit(" \t\r\n"))).otherwise(text)
    return F.when(F.size(acts) > 0, joined(done)).when(F.size(called) > 0, joined(called)).otherwise(fenced)


def blob_tokens(message: Column) -> Column:
    """A quarter of the characters (each floored) of every reasoning field, of the calls' too; what is no string counts as compact JSON."""
    quarter = lambda v: F.when(truthy(v), F.floor(F.char_length(F.coalesce(plain(v), F.to_json(v))) / 4)).otherwise(0)
    inner = F.transform(F.coalesce(get(message, "$.tool_calls", "array<variant>"), F.array().cast("array<variant>")), lambda c: get(c, "$.provider_specific_fields", "variant"))
    size = F.aggregate(inner, F.lit(0).cast("long"), lambda s, v: s + F.when(truthy(v), F.floor(F.char_length(F.to_json(v)) / 4)).otherwise(0))
    for k in REASONING_FIELDS:
        size = size + quarter(get(message, f"$.{k}", "variant"))
    return size


def reasoning_text(message: Column) -> Column:
    """The reasoning, else the commands joined by ` ; `, at most 2000 characters; else the word `reasoning`."""
    own = plain(message, "$.reasoning_content")
    acts = F.transform(get(message, "$.extra.actions", "array<variant>"), lambda a: F.coalesce(plain(_first_truthy(a, ("$.command", "$.query"))), F.lit("")))
    done = F.nullif(_joined(acts, " ; "), F.lit(""))
    return F.substring(F.coalesce(F.when(F.trim(own, F.lit(" \t\r\n")) != "", own), done, F.lit("reasoning")), 1, REASONING_CHARS)


def without_marks(block: Column) -> Column:
    """A block as a map without its `cache_control`; null for what is no object."""
    return F.map_filter(get(block, "$", "map<string,variant>"), lambda k, _: k != "cache_control")


def _object(m: Column, value) -> Column:
    keys = F.array_sort(F.map_keys(m))
    return F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(F.lit('"'), k, F.lit('":'), value(F.element_at(m, k)))), ","), F.lit("}"))


def content_key(content: Column) -> Column:
    """A SHA-256 of content as it came, alike with and without cache marks (of blocks and of the parts in them) and in any order of keys."""
    json = lambda v: F.coalesce(F.to_json(v), F.lit("null"))

    def array(v: Column, value) -> Column:
        blocks = F.transform(get(v, "$", "array<variant>"), lambda x: F.coalesce(_object(without_marks(x), value), json(x)))
        return F.coalesce(F.concat(F.lit("["), F.array_join(blocks, ","), F.lit("]")), json(v))

    return F.sha2(array(content, lambda v: array(v, json)), 256)


def cache_ttl(blocks: Column) -> Column:
    """Of an array of blocks the lifetime its marks ask for: 1h if any does, else the first; null where none does."""
    asked = F.filter(F.transform(blocks, lambda b: plain(b, "$.cache_control.ttl")), lambda t: t != "")
    return F.when(F.array_contains(asked, "1h"), "1h").otherwise(F.get(asked, 0))


def metadata_call(system: Column) -> Column:
    """Whether the system text asks for a title or a topic only."""
    s = F.lower(system)
    return (s.contains("generate a concise") & s.contains("title")) | s.contains("main topic or goal of this coding session")


def counted_body(body: Column) -> Column:
    """The request's JSON narrowed to the fields that count; null for what is no object."""
    kept = F.map_filter(get(body, "$", "map<string,variant>"), lambda k, _: k.isin(*COUNTED_FIELDS))
    return _object(kept, lambda v: F.coalesce(F.to_json(v), F.lit("null")))


def fault(message: Column) -> Column:
    """Why a message must not reach the fold; null for a good one."""
    odd_text = lambda p: get(p, "$.text", "variant").isNotNull() & plain(p, "$.text").isNull()
    odd = lambda a, k: truthy(get(a, k, "variant")) & plain(a, k).isNull()
    parts, acts = get(message, "$.content", "array<variant>"), get(message, "$.extra.actions", "array<variant>")
    no_object = lambda a: get(a, "$", "map<string,variant>").isNull()
    return (
        F.when(F.exists(parts, odd_text), "text")
        .when(F.exists(acts, no_object), "action")
        .when(F.exists(acts, lambda a: odd(a, "$.command") | odd(a, "$.query")), "command")
    )


def absolute(path: Column, cwd: Column) -> Column:
    """A path from the root: slashes forward, quotes off, `.` and `..` resolved; a drive letter stays a first directory."""
    p = F.translate(F.regexp_replace(F.trim(path), "^['\"]+|['\"]+$", ""), "\\", "/")
    whole = F.when(p.startswith("/") | p.rlike("^[A-Za-z]:/"), p).otherwise(F.concat(F.regexp_replace(F.translate(cwd, "\\", "/"), "/+$", ""), F.lit("/"), p))
    none = F.array().cast("array<string>")
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), none, step), "/"))


def scratch_path(path: Column) -> Column:
    """Files whose reads never count: devices, compiled files, patches and temporary folders."""
    p = F.lower(path)
    inside = p.contains("/__pycache__/") | p.contains("/appdata/local/temp/") | p.contains("/windows/temp/")
    return (p == "/dev/null") | inside | p.startswith("/tmp/") | p.startswith("/private/tmp/") | p.rlike(r"\.(pyc|diff|patch)$")


def read_range(args: Column, cwd: Column) -> Column:
    """struct<path, lo, hi> of a read tool's input; null without a path or for a scratch file."""
    path = absolute(plain(args, "$.file_path"), cwd)
    offset, limit = get(args, "$.offset", "bigint"), get(args, "$.limit", "bigint")
    lo = F.coalesce(offset, F.lit(1).cast("long"))
    hi = F.when(limit.isNull(), F.lit(WHOLE)).otherwise(lo + limit - 1).cast("long")
    return F.when(~scratch_path(path), F.struct(path.alias("path"), lo.alias("lo"), hi.alias("hi")))


def on_grid(score: Column) -> Column:
    """A share as an integer of the grid, ties to even."""
    return F.bround(score * 1_000_000).cast("long")


def folded_score(score_q: Column, tau_q: Column, t: Column) -> Column:
    """A score moved so that its kind's threshold falls on `t`, held to the grid; a kind without threshold is never cut."""
    return F.when(tau_q.isNull(), 1_000_000).otherwise(F.greatest(F.lit(0), F.least(F.lit(1_000_000), score_q - tau_q + t))).cast("long")
