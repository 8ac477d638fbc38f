"""Readers of JSON lines: transcripts, rollouts, request bodies, ledgers, score memos and usage streams.

Each takes rows with a text column and gives typed rows; a line that is not JSON, or lacks what the reader asks for, gives none.
`text_lines` reads files; the readers do not care where rows come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calls
from ..functions.text import strip

LEDGER_VERSION = "savings-ledger/v0"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(conv, line_no, line) of text files, one conversation a file; lines are read in splits and numbered by their place in the file."""
    d = spark.read.text(path).select(F.col("_metadata.file_name").alias("conv"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    return d.withColumn("line_no", F.row_number().over(Window.partitionBy("conv").orderBy("block", "id")).cast("long") - 1).filter("line <> ''").select("conv", "line_no", "line")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _joined(parts: Column, sep: str) -> Column:
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), sep)


def _content(v: Column, path: str, sep: str) -> Column:
    """Text of a string, or of the text parts of an array."""
    parts = _get(v, path, "array<variant>")
    return F.coalesce(_joined(F.transform(parts, lambda p: _get(p, "$.text")), sep), _get(v, path))


def _of(blocks: Column, kind: str) -> Column:
    return F.filter(blocks, lambda b: _get(b, "$.type") == kind)


def _parsed(lines: DataFrame) -> DataFrame:
    d = lines.select("conv", "line_no", F.try_parse_json("line").alias("v"))
    blocks = _get(F.col("v"), "$.message.content", "array<variant>")
    text = F.schema_of_variant(_get(F.col("v"), "$.message.content", "variant")) == "STRING"
    d = d.withColumns({"type": _get(F.col("v"), "$.type"), "role": _get(F.col("v"), "$.message.role"), "side": F.coalesce(_get(F.col("v"), "$.isSidechain", "boolean"), F.lit(False)), "blocks": F.filter(blocks, _is_object)})
    return d.withColumn("plain", F.when(text, _get(F.col("v"), "$.message.content"))).filter(F.col("type").isin("user", "assistant"))


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _text(v: Column, path: str) -> Column:
    """A field's text; empty where it is missing or no text."""
    return F.when(F.coalesce(F.schema_of_variant(_get(v, path, "variant")) == "STRING", F.lit(False)), _get(v, path)).otherwise("")


def _result(block: Column, sep: str) -> Column:
    """A tool result's text: the texts of its parts joined, empty ones too; other content as text, True and False as such, null as nothing."""
    content = _get(block, "$.content", "variant")
    parts = F.transform(F.filter(_get(block, "$.content", "array<variant>"), _is_object), lambda p: _text(p, "$.text"))
    j = F.to_json(content)
    plain = F.when(j.isNull() | (j == "null"), "").when(j.isin("true", "false"), F.initcap(j)).otherwise(F.coalesce(_get(block, "$.content"), j))
    return F.coalesce(F.array_join(parts, sep), plain)


def _message(role: str, text: Column, reasoning: Column | None = None, commands: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(F.lit(role).alias("role"), text.alias("text"), (F.lit("") if reasoning is None else reasoning).alias("reasoning"), (none if commands is None else F.coalesce(commands, none)).alias("commands"))


def _commands(blocks: Column, shown) -> Column:
    return F.transform(_of(blocks, "tool_use"), lambda x: shown(_get(x, "$.name"), _get(x, "$.input", "variant")))


def _texts(blocks: Column, *kinds: str) -> Column:
    """The texts of the blocks of those kinds, in order: each kind's field has its own name."""
    return F.transform(F.filter(blocks, lambda x: _get(x, "$.type").isin(*kinds)), lambda x: F.when(_get(x, "$.type") == "thinking", _text(x, "$.thinking")).otherwise(_text(x, "$.text")))


def transcript(lines: DataFrame, most: int = 80, chars: int = 2000) -> DataFrame:
    """(conv, pos, part, role, text, commands) of the last `most` messages.

    A user's plain text with content; an assistant's blocks as one message, thinking and text joined by line ends, with a readable line
    for each call, whether it says anything or not; every tool result as a message of its own, at most `chars` characters each.
    """
    d = _parsed(lines)
    b = F.col("blocks")
    said = _message("assistant", strip(F.array_join(F.filter(_texts(b, "text", "thinking"), lambda t: t != ""), "\n")), commands=_commands(b, calls.shown_action))
    results = F.transform(_of(b, "tool_result"), lambda x: _message("tool", F.substring(_result(x, " "), 1, chars)))
    plain = F.when((F.col("role") == "user") & (strip(F.col("plain")) != ""), F.array(_message("user", F.col("plain"))))
    own = F.when(F.col("plain").isNotNull(), plain).when(F.col("role") == "assistant", F.when(b.isNotNull(), F.array(said))).otherwise(results)
    d = d.select("conv", F.col("line_no").alias("pos"), F.posexplode(own).alias("part", "m")).select("conv", "pos", "part", "m.role", "m.text", "m.commands")
    back = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("pos"), F.desc("part")))
    return d.withColumn("back", back).filter(F.col("back") <= most).drop("back")


def full_transcript(lines: DataFrame) -> DataFrame:
    """(conv, pos, part, role, text, reasoning, commands) of every message outside side chains, uncut.

    An assistant's texts follow each other with nothing between, its thinking likewise beside them, and its calls count as commands; a
    user's results and text blocks are messages of their own, in their order.
    """
    d = _parsed(lines).filter("NOT side")
    block = F.to_json(F.struct(F.lit("text").alias("type"), F.col("plain").alias("text")))
    d = d.withColumn("blocks", F.coalesce(F.when(F.col("plain").isNotNull(), F.array(F.parse_json(block))), F.col("blocks")))
    b = F.col("blocks")
    joined = lambda kind: F.coalesce(F.array_join(_texts(b, kind), ""), F.lit(""))
    own = F.array(_message("assistant", joined("text"), joined("thinking"), _commands(b, calls.call_command)))
    user = F.transform(F.filter(b, lambda x: _get(x, "$.type").isin("tool_result", "text")), lambda x: F.when(_get(x, "$.type") == "text", _message("user", _text(x, "$.text"))).otherwise(_message("tool", _result(x, ""))))
    d = d.select("conv", F.col("line_no").alias("pos"), F.posexplode(F.when(F.col("type") == "assistant", own).otherwise(user)).alias("part", "m"))
    return d.select("conv", "pos", "part", "m.role", "m.text", "m.reasoning", "m.commands")


def rollout(lines: DataFrame) -> DataFrame:
    """(conv, pos, role, text) of a rollout's response items: messages, tool calls as `name arguments`, tool outputs; system and opaque items go."""
    d = lines.select("conv", "line_no", F.try_parse_json("line").alias("v")).filter(_get(F.col("v"), "$.type") == "response_item")
    v = F.col("v")
    kind, role = _get(v, "$.payload.type"), F.coalesce(_get(v, "$.payload.role"), F.lit("user"))
    d = d.select(
        "conv", F.col("line_no").alias("pos"),
        F.when(kind == "message", role).when(kind == "function_call", "assistant").when(kind == "function_call_output", "tool").alias("role"),
        F.when(kind == "message", _content(v, "$.payload.content", " ")).when(kind == "function_call", F.concat_ws(" ", _get(v, "$.payload.name"), _get(v, "$.payload.arguments"))).otherwise(_content(v, "$.payload.output", " ")).alias("text"),
    )
    return d.filter("role NOT IN ('system', 'developer')")


def wire_messages(bodies: DataFrame) -> DataFrame:
    """(conv, idx, role, text, n_calls, commands, queries, protected) of request bodies (conv, body): the system text first if there is one,
    then each message with its text parts joined by a space, and what each of its calls counts as and asks for. Protected is what no cut
    may touch: assistant prose, and user messages (also those without a role) that bring no tool result."""
    d = bodies.select("conv", F.try_parse_json("body").alias("v"))
    m = _get(F.col("v"), "$.messages", "array<variant>")
    texts = F.array().cast("array<string>")

    def message(x: Column) -> Column:
        uses = F.filter(_get(x, "$.content", "array<variant>"), lambda b: _is_object(b) & (_get(b, "$.type") == "tool_use"))
        queries = F.filter(F.transform(uses, lambda u: calls.call_query(_get(u, "$.input", "variant"))), lambda q: q != "")
        role = F.coalesce(_get(x, "$.role"), F.lit("user"))
        result = F.coalesce(F.exists(_get(x, "$.content", "array<variant>"), lambda b: _is_object(b) & (_get(b, "$.type") == "tool_result")), F.lit(False))
        return F.struct(
            role.alias("role"), F.coalesce(_content(x, "$.content", " "), F.lit("")).alias("text"), F.coalesce(F.size(uses), F.lit(0)).alias("n_calls"),
            F.coalesce(F.transform(uses, lambda u: calls.call_command(_get(u, "$.name"), _get(u, "$.input", "variant"))), texts).alias("commands"), F.coalesce(queries, texts).alias("queries"),
            ((role == "assistant") | (role == "user") & ~result).alias("protected"),
        )

    system = F.coalesce(_content(F.col("v"), "$.system", "\n"), F.lit(""))
    none = F.struct(F.lit("system").alias("role"), system.alias("text"), F.lit(0).alias("n_calls"), texts.alias("commands"), texts.alias("queries"), F.lit(False).alias("protected"))
    first = F.when(system != "", F.array(none)).otherwise(F.array().cast("array<struct<role:string,text:string,n_calls:int,commands:array<string>,queries:array<string>,protected:boolean>>"))
    return d.select("conv", F.posexplode(F.concat(first, F.transform(m, message))).alias("idx", "m")).select("conv", "idx", "m.role", "m.text", "m.n_calls", "m.commands", "m.queries", "m.protected")


def ledger(lines: DataFrame) -> DataFrame:
    """(request_id, session_id, cf, billed) of ledger lines (line) of the version read here."""
    v = F.col("v")
    d = lines.select(F.try_parse_json("line").alias("v")).filter(_get(v, "$.contract_version") == LEDGER_VERSION)
    return d.select(*[_get(v, f"$.{k}", t).alias(n) for k, t, n in (("request_id", "string", "request_id"), ("session_id", "bigint", "session_id"), ("counterfactual_input_tokens", "bigint", "cf"), ("billed_input_tokens", "bigint", "billed"))])


def trailing_scores(memo: DataFrame, cap: int = 512) -> DataFrame:
    """Of memo rows (conv, seq, checkpoint, score) the newest `cap` of the trailing run that has one checkpoint; rows without a score do not count."""
    w = Window.partitionBy("conv").orderBy(F.desc("seq"))
    changed = F.when(F.col("checkpoint") != F.lag("checkpoint").over(w), 1).otherwise(0)
    d = memo.filter("score IS NOT NULL").withColumn("changed", changed).withColumn("runs", F.sum("changed").over(w)).withColumn("back", F.row_number().over(w))
    return d.filter((F.col("runs") == 0) & (F.col("back") <= cap)).select("conv", "seq", "checkpoint", "score")


def merged_exports(exports: DataFrame) -> DataFrame:
    """(session, base, ranges): the distinct ranges of all of a session's exports (session, base, lo, hi), in order."""
    return exports.groupBy("session", "base").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))


USAGE = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def stream_usage(frames: DataFrame) -> DataFrame:
    """(request, *USAGE, types): of usage frames (request, seq, type, data) the last value of each key that is not null, and the event
    types met (24 by name at most)."""
    v = F.try_parse_json("data")
    d = frames.select("request", "seq", "type", *[_get(v, f"$.usage.{k}", "bigint").alias(k) for k in USAGE])
    last = [F.max_by(F.col(k), F.when(F.col(k).isNotNull(), F.col("seq"))).alias(k) for k in USAGE]
    return d.groupBy("request").agg(*last, F.slice(F.array_sort(F.collect_set("type")), 1, 24).alias("types"))


def response_usage(lines: DataFrame) -> DataFrame:
    """(request, given, cached, out, types) of the lines (request, seq, line) of response streams: the usage of the last completed response
    that names one, and the event types in the order they were met, 24 at most. Lines that are no data, or no JSON, say nothing."""
    payload = F.regexp_extract(strip(F.col("line")), r"(?s)^data:(.*)$", 1)
    v = F.try_parse_json(strip(payload))
    d = lines.select("request", "seq", v.alias("v")).withColumn("type", F.when(F.schema_of_variant(_get(F.col("v"), "$.type", "variant")) == "STRING", _get(F.col("v"), "$.type")))
    usage = _get(F.col("v"), "$.response.usage", "variant")
    there = (F.col("type") == "response.completed") & usage.isNotNull() & (F.to_json(usage) != "null")
    fields = F.struct(*[_get(usage, f"$.{k}", "bigint").alias(n) for k, n in (("input_tokens", "given"), ("input_tokens_details.cached_tokens", "cached"), ("output_tokens", "out"))])
    last = d.groupBy("request").agg(F.max_by(F.when(there, fields), F.when(there, F.col("seq"))).alias("u"))
    met = d.filter("type IS NOT NULL").groupBy("request", "type").agg(F.min(F.struct("seq", "type")).alias("m")).groupBy("request").agg(F.slice(F.array_sort(F.collect_list("m")), 1, 24).alias("m"))
    none = F.array().cast("array<string>")
    return last.join(met, "request", "left").select("request", "u.given", "u.cached", "u.out", F.coalesce(F.transform("m", lambda x: x["type"]), none).alias("types"))
