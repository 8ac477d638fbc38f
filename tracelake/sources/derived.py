"""Lines in the shapes of the readers, made from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(kind: str, value):
    return F.struct(F.lit(kind).alias("type"), value.alias("text"))


def transcript_lines(messages: DataFrame) -> DataFrame:
    """One line for each message, a broken line for each conversation; every fifth turn is in a side chain.

    Users bring plain text, or results around a note; assistants think, speak in two blocks and call a tool, or call one without a word.
    """
    n = F.col("turn").cast("string")
    text = F.regexp_replace(F.to_json(F.array(F.coalesce("text", F.lit("")))), r"^\[|\]$", "")
    join = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    results = join('[{"type":"tool_result","content":[{"type":"text","text":', text, '},{"type":"image"},"x",{"text":"end"}]},{"type":"text","text":"note ', n, '"},{"type":"tool_result","content":', n, '},{"type":"tool_result","content":true}]')
    read = join('{"type":"tool_use","name":"Read","input":{"file_path":"/r/', n, '.py","offset":"', n, '","limit":5}}')
    call = F.when(F.col("turn") % 2 == 0, read).otherwise(join('{"type":"tool_use","name":"Bash","input":{"command":"run ', n, '"}}'))
    own = F.when(F.col("turn") % 3 == 1, join("[", call, "]")).otherwise(join('[{"type":"thinking","thinking":"why ', n, '"},{"type":"text","text":', text, '},{"type":"text","text":" and ', n, '"},', call, "]"))
    content = F.when(F.col("role") == "assistant", own).when((F.col("role") == "user") & (F.col("turn") % 4 != 0), results).otherwise(text)
    line = join('{"type":"', F.col("role"), '","isSidechain":', F.when(F.col("turn") % 5 == 4, "true").otherwise("false"), ',"message":{"role":"', F.col("role"), '","content":', content, "}}")
    d = messages.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("line_no"), line.alias("line"))
    return d.unionByName(d.select("conv", F.lit(1000).cast("long").alias("line_no"), F.lit('{"type": "user", broken').alias("line")).distinct())


def rollout_lines(messages: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    item = lambda payload: F.to_json(F.struct(F.lit("response_item").alias("type"), payload.alias("payload")))
    message = item(F.struct(F.lit("message").alias("type"), "role", F.array(_text("input_text", text)).alias("content")))
    call = item(F.struct(F.lit("function_call").alias("type"), F.lit("shell").alias("name"), F.concat(F.lit('{"n":'), F.col("turn").cast("string"), F.lit("}")).alias("arguments")))
    output = item(F.struct(F.lit("function_call_output").alias("type"), text.alias("output")))
    other = F.to_json(F.struct(F.lit("event_msg").alias("type"), text.alias("payload")))
    line = F.when(F.col("turn") % 4 == 3, call).when(F.col("turn") % 4 == 2, output).when(F.col("turn") == 5, other).otherwise(message)
    return messages.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("line_no"), line.alias("line"))


def bodies(messages: DataFrame) -> DataFrame:
    """One request body for each conversation: system text where the id is odd, assistants with one call or two, users with a result at
    every fourth turn, and without a role where the turn is 2."""
    text, n = F.coalesce("text", F.lit("")), F.col("turn").cast("string")
    null = lambda kind="string": F.lit(None).cast(kind)
    fields = "struct<offset:string,file:string,pattern:string>"

    def block(kind: str, text: Column, name: Column, input: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), name.alias("name"), input.alias("input"))

    read = block("tool_use", null(), F.lit("Read"), F.struct(n.alias("offset"), F.concat(F.lit("/r/"), n).alias("file"), null().alias("pattern")))
    search = block("tool_use", null(), F.lit("Grep"), F.struct(null().alias("offset"), null().alias("file"), F.concat(F.lit("it's "), n).alias("pattern")))
    said = block("text", text, null(), null(fields))
    own = F.when(F.col("turn") % 4 == 3, F.array(said, read, search)).otherwise(F.array(said, read))
    given = F.when(F.col("turn") % 4 == 1, F.array(said, block("tool_result", null(), null(), null(fields)))).otherwise(F.array(said))
    m = F.struct("turn", F.when(F.col("turn") != 2, F.col("role")).alias("role"), F.when(F.col("role") == "assistant", own).otherwise(given).alias("content"))
    d = messages.filter("role <> 'system'").groupBy(F.col("conv_id").alias("conv")).agg(F.array_sort(F.collect_list(m), lambda a, b: (a["turn"] - b["turn"]).cast("int")).alias("m"))
    own = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return d.select("conv", F.to_json(F.struct(F.when(F.col("conv") % 2 == 1, "be brief").alias("system"), own.alias("messages"))).alias("body"))


def ledger_lines(events: DataFrame) -> DataFrame:
    v = F.floor(F.col("value") * 100).cast("long")
    row = F.struct(
        F.when(F.col("event_id") % 4 != 0, "savings-ledger/v0").otherwise("savings-ledger/v9").alias("contract_version"), F.col("event_id").cast("string").alias("request_id"), F.col("user_id").alias("session_id"),
        F.when(F.col("event_id") % 7 != 0, v).alias("counterfactual_input_tokens"), (v % 1000).alias("billed_input_tokens"),
    )
    line = F.to_json(row)
    return events.select(F.when(F.col("event_id") % 9 == 0, F.substring(line, 1, 40)).otherwise(line).alias("line"))


def memo_rows(events: DataFrame) -> DataFrame:
    v = F.floor(F.col("value")).cast("long")
    return events.select(F.col("user_id").alias("conv"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 40 < 20, "a").otherwise("b").alias("checkpoint"), F.when(v % 6 != 0, v).alias("score"))


def usage_frames(events: DataFrame) -> DataFrame:
    v = F.floor(F.col("value") * 100).cast("long")
    usage = F.struct(F.when(F.col("event_id") % 2 == 0, v).alias("input_tokens"), (v + 1).alias("output_tokens"), F.when(v % 3 == 0, v % 50).alias("cache_read_input_tokens"), F.when(v % 5 == 0, v % 70).alias("cache_creation_input_tokens"))
    return events.select(F.col("user_id").alias("request"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.when(F.col("event_id") % 10 == 0, "data: [broken").otherwise(F.to_json(F.struct(usage.alias("usage")))).alias("data"))


def response_lines(events: DataFrame) -> DataFrame:
    """Lines of a response stream for each user: completed responses with and without usage, other events, what is no data or no JSON."""
    v = F.floor(F.col("value") * 100).cast("long")
    t = lambda c: c.cast("string")
    usage = F.concat(F.lit('{"input_tokens":'), t(v), F.lit(',"input_tokens_details":{"cached_tokens":'), t(v % 7000 - 50), F.lit('},"output_tokens":'), t(v % 13), F.lit("}"))
    done = F.concat(F.lit(' data: {"type":"response.completed","response":{"usage":'), F.when(v % 4 == 0, "null").otherwise(usage), F.lit("}} "))
    n = F.col("event_id") % 5
    other = F.concat(F.lit('data:{"type":"response.'), F.col("event_type"), F.lit('"}'))
    line = F.when(n == 0, done).when(n == 1, "data: [DONE]").when(n == 2, other).when(n == 3, "event: x").otherwise("data: {broken")
    return events.select(F.col("user_id").alias("request"), F.col("event_id").alias("seq"), line.alias("line"))
