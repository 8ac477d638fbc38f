"""Tool rosters, range descriptions, pooled vectors, responses and trim payloads as grouped tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import content
from ..functions.commands import WHOLE
from ..functions.content import get, plain
from .ranges import merge_ranges

#: Seconds in which a staged payload may be taken.
PAYLOAD_SECONDS = 1800
# Directories that are never the package.
NO_PACKAGE = (
    "tests", "test", "testing", "docs", "doc", "examples", "example", "benchmarks", "asv_benchmarks", "maint_tools", "build_tools", "utils", "scripts", "ext", "tools",
)


def _named(t: Column, *paths: str) -> Column:
    return F.coalesce(*[F.when(content.truthy(get(t, p, "variant")), get(t, p, "variant")) for p in paths])


def tool_schemas(requests: DataFrame) -> DataFrame:
    """(conv, pos, name, text, tokens) of the tools of `requests` (conv, tools: array<variant>): of one name the last schema, at the first
    one's place; a tool without a name is none. text is JSON with keys in order."""
    d = requests.select("conv", F.posexplode("tools").alias("pos", "t"))
    t = F.col("t")
    name = plain(_named(t, "$.function.name", "$.name"))
    described = F.coalesce(F.to_json(_named(t, "$.function.description", "$.description")), F.lit('""'))
    given = _named(t, "$.function.parameters", "$.function.input_schema", "$.parameters", "$.input_schema")
    params = F.when(get(given, "$", "map<string,variant>").isNotNull(), F.to_json(given)).otherwise("{}")
    quoted = F.to_json(_named(t, "$.function.name", "$.name"))
    text = F.concat(F.lit('{"description":'), described, F.lit(',"name":'), quoted, F.lit(',"parameters":'), params, F.lit("}"))
    d = d.select("conv", "pos", name.alias("name"), text.alias("text")).filter("name <> ''")
    d = d.groupBy("conv", "name").agg(F.min("pos").alias("pos"), F.max_by("text", "pos").alias("text"))
    return d.select("conv", "pos", "name", "text", F.floor(F.char_length("text") / 4).cast("long").alias("tokens"))


def tool_stubs(requests: DataFrame) -> DataFrame:
    """(conv, pos, name, description) of the tools that may be served as stubs: those of the caller's own with an input schema."""
    d = requests.select("conv", F.posexplode("tools").alias("pos", "t"))
    t = F.col("t")
    d = d.filter((get(t, "$.type").isNull() | (get(t, "$.type") == "custom")) & get(t, "$.input_schema", "variant").isNotNull())
    head = F.nullif(F.substring(plain(t, "$.description"), 1, content.STUB_CHARS), F.lit(""))
    return d.select("conv", "pos", plain(t, "$.name").alias("name"), F.concat_ws("\n\n", head, F.lit(content.STUB_NOTE)).alias("description")).filter("name IS NOT NULL")


def roster_keys(requests: DataFrame) -> DataFrame:
    """(conv, roster): eight hex digits that depend on the set of tool names alone."""
    names = F.filter(F.transform("tools", lambda t: plain(t, "$.name")), lambda n: n.isNotNull())
    return requests.select("conv", F.substring(F.sha2(F.array_join(F.array_sort(names), "\n"), 256), 1, 8).alias("roster"))


def described_reads(reads: DataFrame) -> DataFrame:
    """(conv, file, whole, text) of reads (conv, file, lo, hi, tail; a read of the last lines has only `tail`): the entire file where a read
    from line 1 has no end, else the merged ranges in order and then the distinct tails."""
    ranged = merge_ranges(reads.filter(F.col("tail").isNull() & (F.col("hi") < WHOLE)).select("conv", "file", "lo", "hi"))
    merged = ranged.groupBy("conv", "file").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))
    d = reads.groupBy("conv", "file").agg(F.bool_or(F.coalesce((F.col("lo") == 1) & (F.col("hi") >= WHOLE), F.lit(False))).alias("whole"), F.array_sort(F.collect_set("tail")).alias("tails"))
    d = d.join(merged, ["conv", "file"], "left")
    lines = F.transform(F.coalesce("ranges", F.array().cast("array<struct<lo:bigint,hi:bigint>>")), lambda r: F.concat(F.lit("L"), r["lo"].cast("string"), F.lit("-"), r["hi"].cast("string")))
    tails = F.transform("tails", lambda n: F.concat(F.lit("last "), n.cast("string"), F.lit(" lines")))
    text = F.coalesce(F.nullif(F.array_join(F.concat(lines, tails), ", "), F.lit("")), F.lit("(read)"))
    return d.select("conv", "file", "whole", F.when(F.col("whole"), "the entire file").otherwise(text).alias("text"))


def package(paths: DataFrame) -> DataFrame:
    """(repo, package) of source files (repo, path from the root): the top directory with most files, the last by name of equals; `.` where
    no file lies in a directory that may be one."""
    top = F.split("path", "/")
    d = paths.withColumn("top", F.when((F.size(top) > 1) & ~F.get(top, 0).isin(*NO_PACKAGE), F.get(top, 0)))
    d = d.groupBy("repo", "top").agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("top").isNotNull(), F.struct("n", "top")))
    return d.groupBy("repo").agg(F.coalesce(best["top"], F.lit(".")).alias("package"))


def pooled(rows: DataFrame) -> DataFrame:
    """(conv, pooled) of own rows (conv, v: array<double>, state: the conversation's array<double>): the mean of each place, then the state."""
    d = rows.select("conv", "state", F.posexplode("v").alias("i", "x"))
    d = d.groupBy("conv", "i").agg(F.avg("x").alias("x"), F.any_value("state").alias("state"))
    d = d.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m"), F.any_value("state").alias("state"))
    return d.select("conv", F.concat(F.transform("m", lambda r: r["x"]), "state").alias("pooled"))


def parity(left: DataFrame, right: DataFrame, least: float = 0.9999) -> DataFrame:
    """(id, cosine, passed) of vectors (id, v) of two encoders. What only one has does not pass."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    d = left.select("id", F.col("v").alias("a")).join(right.select("id", F.col("v").alias("b")), "id", "full")
    cosine = F.try_divide(dot("a", "b"), F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")))
    return d.select("id", F.round(cosine, 9).alias("cosine"), F.coalesce(cosine >= least, F.lit(False)).alias("passed"))


def rule_answers(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """(conv, fire_step, n_scores, rules) of scored rules (conv, fire_step, eid, p_q; a null eid: nothing was scored) against the rule texts
    (eid, text): known rules in order of eid; a request without scores is answered with none."""
    d = asked.join(rules.select("eid", "text"), "eid", "left")
    known = F.collect_list(F.when(F.col("text").isNotNull(), F.struct("eid", "text", "p_q")))
    return d.groupBy("conv", "fire_step").agg(F.count("eid").alias("n_scores"), F.array_sort(known).alias("rules"))


def gate_answers(scores: DataFrame, tau_q: int = 500_000) -> DataFrame:
    """(conv, score_q, fire, fail_open): a missing score fires, at the top of the grid."""
    q = F.coalesce(F.col("score_q"), F.lit(1_000_000)).cast("long")
    return scores.select("conv", q.alias("score_q"), (q >= tau_q).alias("fire"), F.col("score_q").isNull().alias("fail_open"))


def trace_faults(traces: DataFrame, width: int, checkpoint: str) -> DataFrame:
    """(conv, status) of score requests (conv, checkpoint, n_nodes, mask, widths, edges: array<struct<a, b>>): 409 for another checkpoint;
    422 for a mask or edge out of range, rows that are not one for each mask entry, or a row of another width; else 200."""
    out = lambda j: (j < 0) | (j >= F.col("n_nodes"))
    bad = F.exists("mask", out) | (F.size("mask") != F.size("widths")) | F.exists("widths", lambda w: w != width) | F.exists("edges", lambda e: out(e["a"]) | out(e["b"]))
    return traces.select("conv", F.when(~F.col("checkpoint").eqNullSafe(checkpoint), 409).when(bad, 422).otherwise(200).alias("status"))


def lifetime(sessions: DataFrame) -> DataFrame:
    """Re-reads blocked, tokens saved and loops broken over all sessions; nulls count 0."""
    return sessions.agg(*[F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in ("blocked", "tokens", "loops")])


def compacted(memo: DataFrame, cap: int = 512) -> DataFrame:
    """Memo rows (conv, seq, ..): a conversation of more than 4 * cap keeps its newest `cap` rows, others keep all."""
    n = F.count("*").over(Window.partitionBy("conv"))
    back = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("seq")))
    return memo.withColumns({"_n": n, "_back": back}).filter((F.col("_n") <= 4 * cap) | (F.col("_back") <= cap)).drop("_n", "_back")


def unexpired(rows: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Rows touched (`touched`, seconds) at most `seconds` before `now`."""
    return rows.filter(F.col("touched") >= now - seconds)


def taken_payloads(staged: DataFrame, asks: DataFrame, version: str, seconds: int = PAYLOAD_SECONDS) -> DataFrame:
    """(project, tool, id, ask): for each staged payload (project, tool, id, version, at) the first ask (project, tool, id, at) at or after it
    that takes it; null where none comes within `seconds` or its version is another. One payload a place: a later one replaces it."""
    s = staged.select("project", "tool", "at", F.lit(0).alias("kind"), "id", "version")
    a = asks.select("project", "tool", "at", F.lit(1).alias("kind"), "id", F.lit(None).cast("string").alias("version"))
    nxt = F.struct(F.lead("kind").over(w := Window.partitionBy("project", "tool").orderBy("at", "kind", "id")).alias("kind"), F.lead("id").over(w).alias("id"), F.lead("at").over(w).alias("at"))
    d = s.unionByName(a).withColumn("next", nxt).filter("kind = 0")
    good = (F.col("next.kind") == 1) & (F.col("version") == version) & (F.col("next.at") - F.col("at") <= seconds)
    return d.select("project", "tool", "id", F.when(good, F.col("next.id")).alias("ask"))
