"""Fields of requests and usage, text splits, digests of cut messages, and how chunks match the words of a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, splitlines, strip

QUERY_KEYS = ("query", "pattern", "q", "search")
DIGEST_CHARS = 300
# What names code, files and edits in a task's text and a chunk.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{5,}(?:\.[A-Za-z_][A-Za-z0-9_]*)*"
DEFINITION = r"(?:^|\n)\s*(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)"
FRAME = r'File "([^"]+)"'
EDITED = r"The file (\S+) has been updated"
PATH = r"([\w./\-]+\.(?:py|rst|txt|cfg|ini|toml|md|json|yaml|yml|c|h|cpp|js|ts))"


def billed_usage(given: Column, cached: Column, out: Column) -> Column:
    """Usage whose input holds the cached part, as parts that add up: the cached part is clamped to 0 and the input; nulls count 0."""
    total = F.coalesce(given, F.lit(0))
    hit = F.least(F.greatest(F.coalesce(cached, F.lit(0)), F.lit(0)), F.greatest(total, F.lit(0)))
    return F.struct((total - hit).alias("input"), hit.alias("cache_read"), F.lit(0).cast("long").alias("cache_creation"), F.coalesce(out, F.lit(0)).alias("output"))


def session_id(user_id: Column) -> Column:
    """A session id from a user id, which is JSON that holds one, or text that ends in one; null unless it has the form of an id."""
    held = F.when(F.try_parse_json(user_id).isNull(), F.when(user_id.contains("_session_"), F.substring_index(user_id, "_session_", -1))).otherwise(F.get_json_object(user_id, "$.session_id"))
    return F.when(held.rlike(r"\A[0-9a-fA-F-]{1,64}\z"), held)


def query_argument(args: Column) -> Column:
    """The first argument with content of those that name a query, as it is; empty where there is none."""
    found = [F.when(strip(args[k]) != "", args[k]) for k in QUERY_KEYS]
    return F.coalesce(*found, F.lit(""))


def split_texts(a: Column, b: Column) -> Column:
    """What two texts share in front, what the first has alone, what the second has alone, what they share behind."""
    same = lambda x, y: F.coalesce(F.nullif(F.array_position(F.zip_with(F.split(x, ""), F.split(y, ""), lambda c, d: ~c.eqNullSafe(d)), True), F.lit(0)) - 1, F.char_length(x).cast("long")).cast("int")
    p = F.when((a == "") | (b == ""), 0).otherwise(same(a, b))
    ra, rb = F.substring(a, p + 1, F.char_length(a)), F.substring(b, p + 1, F.char_length(b))
    s = F.when((ra == "") | (rb == ""), 0).otherwise(same(F.reverse(ra), F.reverse(rb)))
    return F.struct(F.substring(a, F.lit(1), p).alias("front"), F.substring(ra, F.lit(1), F.char_length(ra) - s).alias("removed"), F.substring(rb, F.lit(1), F.char_length(rb) - s).alias("inserted"), F.substring(ra, F.char_length(ra) - s + 1, s).alias("back"))


def digest(text: Column) -> Column:
    """A cut message in short: the line that names the exit code among the first four, the first two lines with content and, of three
    or more, the last one, each up to 300 characters, and between them how many lines and tokens (characters / 4) are left out. A text
    of which nothing would be left out stays."""
    lines = splitlines(text)
    code = F.array_position(F.transform(F.slice(lines, 1, 4), lambda x: F.lower(x).contains("returncode")), True)
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))
    body = F.transform(F.filter(numbered, lambda r: (strip(r["x"]) != "") & (r["i"] != code)), lambda r: F.substring(r["x"], 1, DIGEST_CHARS))
    named = F.when(code > 0, F.array(strip(F.get(lines, (code - 1).cast("int"))))).otherwise(F.array().cast("array<string>"))
    head = F.concat(named, F.slice(body, 1, 2))
    tail = F.when(F.size(body) >= 3, F.slice(body, -1, 1)).otherwise(F.array().cast("array<string>"))
    left = F.greatest(F.size(body) - 3, F.lit(0))
    tokens = F.greatest(F.floor(F.char_length(text) / 4) - F.floor(F.char_length(F.array_join(F.concat(head, tail), "\n")) / 4), F.lit(0))
    mark = F.when(left > 0, F.concat(F.lit("[... "), left.cast("string"), F.lit(" lines (~"), tokens.cast("string"), F.lit(" tokens) left out ...]"))).when(tokens > 0, F.concat(F.lit("[... ~"), tokens.cast("string"), F.lit(" tokens left out ...]")))
    return F.when(mark.isNull(), text).otherwise(F.array_join(F.concat(head, F.array(mark), tail), "\n"))


def chunk_file(file: Column, text: Column) -> Column:
    """A chunk's file by base name: its own, else the one it says was updated, else the first path in it; null where there is none."""
    found = [F.nullif(c, F.lit("")) for c in (file, F.regexp_extract(text, EDITED, 1), F.regexp_extract(text, PATH, 1))]
    return F.substring_index(F.coalesce(*found), "/", -1)


def issue_match(chunks: DataFrame, tasks: DataFrame) -> DataFrame:
    """(conv, gi, any, logn, defines, share, framed) of chunks (conv, gi, file, text) against tasks (conv, task), one a conversation.

    Whether a chunk holds an identifier of its task, ln(1 + how many), whether it defines one, the share held, and whether its file is
    in a traceback of the task; all 0 where the task is missing or has no identifier. A task's identifiers are one array in its row.
    """
    words = F.array_distinct(F.regexp_extract_all("task", F.lit(IDENTIFIER), F.lit(0)))
    frames = F.transform(F.regexp_extract_all("task", F.lit(FRAME), F.lit(1)), lambda f: F.substring_index(f, "/", -1))
    d = chunks.join(tasks.select("conv", words.alias("words"), frames.alias("frames")), "conv", "left")
    n = F.size(F.filter("words", lambda w: F.col("text").contains(w)))
    some = F.size(F.coalesce("words", F.array().cast("array<string>"))) > 0
    flag = lambda c: F.when(some & F.coalesce(c, F.lit(False)), 1).otherwise(0)
    d = d.withColumn("n", F.when(some, F.coalesce(n, F.lit(0))).otherwise(0))
    return d.select(
        "conv", "gi", F.when(F.col("n") > 0, 1).otherwise(0).alias("any"), F.round(F.log1p(F.col("n").cast("double")), 9).alias("logn"),
        flag(F.arrays_overlap(F.regexp_extract_all("text", F.lit(DEFINITION), F.lit(1)), F.col("words"))).alias("defines"),
        F.round(F.col("n") / F.greatest(F.size("words"), F.lit(1)), 9).alias("share"), flag(F.array_contains("frames", chunk_file(F.col("file"), F.col("text")))).alias("framed"),
    ).fillna(0, ["share"])


def derived_tasks(messages: DataFrame) -> DataFrame:
    word = F.when(F.col("conv_id") % 2 == 1, " symbol_one.part").otherwise(" symbol_two")
    return messages.filter("turn = 1").select(F.col("conv_id").alias("conv"), F.when(F.col("conv_id") % 5 != 0, F.concat(F.coalesce("text", F.lit("")), word, F.lit(' File "/r/x/f1.py"'))).alias("task"))


def derived_matches(messages: DataFrame) -> DataFrame:
    t = F.col("turn") % 4
    more = F.when(t == 0, "\n  def symbol_two(a):").when(t == 1, " see /w/f1.py").when(t == 2, "symbol_one.part").otherwise("")
    return messages.filter("text IS NOT NULL").select(F.col("conv_id").alias("conv"), F.col("turn").alias("gi"), F.when(F.col("turn") % 3 == 0, "q/f1.py").alias("file"), F.concat("text", more).alias("text"))
