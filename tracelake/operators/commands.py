"""Command streams: loops, breakers and latches. A row is (session, seq, cmd)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRAILING = 6
LOW = 0.34


def derived_commands(events: DataFrame) -> DataFrame:
    """Commands from events: user as session, type and a coarse value as the command; purchases are edits."""
    d = events.select(F.col("user_id").alias("session"), "event_id", "ts", F.concat_ws(" ", "event_type", (F.floor(F.col("value")) % 3).cast("long").cast("string")).alias("cmd"), (F.col("event_type") == "purchase").alias("edit"))
    return d.withColumn("seq", F.row_number().over(Window.partitionBy("session").orderBy("ts", "event_id")).cast("long"))


def loop_shares(commands: DataFrame) -> DataFrame:
    """lf: share of the trailing commands that occurred before, over what the window holds; its short mean, change and low share."""
    w = Window.partitionBy("session").orderBy("seq")
    seen = F.row_number().over(Window.partitionBy("session", "cmd").orderBy("seq")) > 1
    d = commands.withColumn("dup", F.when(seen, 1.0).otherwise(0.0))
    d = d.withColumn("lf", F.avg("dup").over(w.rowsBetween(1 - TRAILING, 0)))
    first = F.first("lf").over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumns({"mean3": F.avg("lf").over(w.rowsBetween(-2, 0)), "delta": F.col("lf") - F.coalesce(F.lag("lf", 3).over(w), first), "low6": F.avg(F.when(F.col("lf") >= LOW, 1.0).otherwise(0.0)).over(w.rowsBetween(1 - TRAILING, 0)), "least3": F.min("lf").over(w.rowsBetween(-2, 0))})
    mech = (F.col("seq") >= 6) & (F.col("lf") >= 0.5) & (F.col("least3") >= LOW)
    return d.select("session", "seq", *[F.round(c, 9).alias(c) for c in ("lf", "mean3", "delta", "low6")], mech.alias("mech"))


def loop_breaker(commands: DataFrame, limit: int = 3) -> DataFrame:
    """The breaker's decision on each attempt: once a command has completed `limit` times since the last edit, attempts are refused and
    let pass in turn, refused first.

    A refused attempt completes nothing, so from attempt `limit` + 1 of an epoch on all are in turn; whose turn it is goes on over
    edits. An edit ends its epoch and leaves no count of its own.
    """
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    d = commands.withColumn("epoch", F.coalesce(F.sum(F.when(F.col("edit"), 1).otherwise(0)).over(before), F.lit(0)).cast("long"))
    d = d.withColumn("run", F.row_number().over(Window.partitionBy("session", "epoch", "cmd").orderBy("seq")).cast("long"))
    turn = F.sum(F.when(F.col("run") > limit, 1).otherwise(0)).over(Window.partitionBy("session", "cmd").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return d.select("session", "seq", "epoch", "run", ((F.col("run") > limit) & (turn % 2 == 1)).alias("blocked"))


def latches(commands: DataFrame) -> DataFrame:
    """A sticky stop once a session loops, and the one row on which it was set."""
    d = loop_shares(commands)
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.when(F.col("mech"), 1).otherwise(0)).over(w)
    return d.select("session", "seq", (n > 0).alias("stopped"), (F.col("mech") & (n == 1)).alias("set_here"))


def first_fires(commands: DataFrame) -> DataFrame:
    """Each (session, command) once, at its first place."""
    return commands.groupBy("session", "cmd").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
