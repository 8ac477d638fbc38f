"""Single fields of observations, tool calls and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import commands as C



def observation_fields(events: DataFrame) -> DataFrame:
    """Exit codes named in outputs, and whether earlier ranges cover six tenths of a range."""
    v = F.floor("value").cast("long")
    n = F.col("event_id") % 3
    obs = F.when(n == 0, F.concat(F.lit("x <returncode> "), (v - 50).cast("string"), F.lit(" </returncode>"))).when(n == 1, F.concat(F.lit("ReturnCode: "), v.cast("string"))).otherwise(F.concat(F.repeat(F.lit("."), 400), F.lit("returncode: 1")))
    lo = v % 10
    seen = F.array(F.struct(F.lit(1).cast("long").alias("lo"), F.lit(8).cast("long").alias("hi")), F.struct(F.lit(9).cast("long").alias("lo"), F.lit(10).cast("long").alias("hi")))
    return events.select("event_id", C.obs_rc(obs).alias("rc"), C.covered(lo, lo + 9, seen, 0.6).alias("covered"))


def argv_command(argv: Column) -> Column:
    """A command array as text: what a shell is told to run where it is wrapped in one, else its words."""
    shell = (F.size(argv) >= 3) & F.get(argv, 0).rlike("(^|/)(ba|z|da)?sh$") & F.get(argv, 1).rlike("^-[a-z]*c$")
    return F.when(shell, F.get(argv, 2)).otherwise(F.array_join(argv, " "))


def derived_argv(events: DataFrame) -> DataFrame:
    v = F.floor("value").cast("long").cast("string")
    plain = F.array(F.col("event_type"), v)
    wrapped = F.array(F.when(F.col("event_id") % 4 == 0, "bash").otherwise("/bin/sh"), F.lit("-lc"), F.concat_ws(" ", F.col("event_type"), v))
    return events.select("event_id", F.when(F.col("event_id") % 2 == 0, wrapped).otherwise(plain).alias("argv"))


def argv_commands(d: DataFrame) -> DataFrame:
    return d.select("event_id", argv_command(F.col("argv")).alias("cmd"))


def line_type(line: Column) -> Column:
    """signature, import, comment or body; the tests go in this order, and blank lines have none."""
    t = F.trim(line)
    return (
        F.when(t == "", F.lit(None).cast("string")).when(t.rlike(r"^(async\s+def|def|class|func|fn|function)\s+\w+"), "signature").when(t.rlike(r"^(import|from|#include|use|require)\b"), "import").when(t.rlike(r"^(#|//|/\*|\*|--)"), "comment").otherwise("body")
    )


def derived_code(documents: DataFrame) -> DataFrame:
    """A document's lines in the shapes of code, by position."""
    d = documents.filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    n = F.col("i") % 5
    line = F.when(n == 0, "def f(a):").when(n == 1, F.concat(F.lit("from x import "), F.substring("x", 1, 10))).when(n == 2, F.concat(F.lit("# "), F.col("x"))).when(n == 3, "").otherwise(F.concat(F.lit("    "), F.col("x")))
    return d.select("doc_id", line.alias("line"))


def line_type_shares(lines: DataFrame) -> DataFrame:
    """The share of each line type among a document's lines with content."""
    d = lines.withColumn("t", line_type(F.col("line"))).filter("t IS NOT NULL")
    return d.groupBy("doc_id").agg(*[F.round(F.count_if(F.col("t") == k) / F.count("*"), 9).alias(k) for k in ("signature", "import", "comment", "body")])


def keep_growth(events: DataFrame) -> DataFrame:
    """How many distinct types a user's keep set holds after each event: a type counts at its first event."""
    first = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) == 1
    grown = F.sum(F.when(F.col("first"), 1).otherwise(0)).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.withColumn("first", first).select("user_id", "event_id", grown.cast("long").alias("kept"))


def first_sites(calls: DataFrame, most: int = 3) -> DataFrame:
    """(file, id): the first `most` places of each file."""
    d = calls.select(C.basename(F.col("path")).alias("file"), "id").distinct()
    return d.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("id"))).filter(F.col("r") <= most).select("file", "id")


def identities(messages: DataFrame, salt: str = "s") -> DataFrame:
    """(conv_id, ident): 24 hex digits of a digest over the salt and the first user text."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    d = messages.groupBy("conv_id").agg(F.coalesce(first, F.lit("")).alias("first"))
    return d.select("conv_id", F.substring(F.sha2(F.concat(F.lit(salt), F.lit("\n"), F.col("first")), 256), 1, 24).alias("ident"))
