"""Views, budgets, nodes and set operations over conversations, ranges and commands; null texts count as empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def message_diff(messages: DataFrame) -> DataFrame:
    """Each conversation against the next one by id, message by message: how many there are, how many differ, characters gained."""
    a = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    b = a.select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("role").alias("role2"), F.col("text").alias("text2"))
    changed = F.col("role2").isNull() | (F.col("role") != F.col("role2")) | (F.col("text") != F.col("text2"))
    d = a.join(b, ["conv_id", "turn"], "left").groupBy("conv_id")
    gained = F.sum(F.length(F.coalesce("text2", F.lit(""))) - F.length("text"))
    return d.agg(F.count("*").alias("messages"), F.count_if(changed).alias("changed"), gained.alias("chars_gained"), F.greatest(F.lit(0), -gained).alias("chars_saved"))


def last_views(messages: DataFrame, n: int = 14, chars: int = 160) -> DataFrame:
    """The last `n` assistant messages of each conversation, newest first, cut to `chars` characters."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    d = messages.filter("role = 'assistant'").withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)
    return d.select("conv_id", "turn", "back", F.sha2(F.substring(F.coalesce("text", F.lit("")), 1, chars), 256).alias("view_sha"))


def step_nodes(chunked: DataFrame) -> DataFrame:
    """One node for each step of a conversation, numbered in order, with the chunks and tokens it holds."""
    d = chunked.groupBy("conv_id", "step").agg(F.count("*").alias("n_chunks"), F.sum("tokens").alias("tokens"))
    return d.withColumn("node", F.row_number().over(Window.partitionBy("conv_id").orderBy("step")).cast("long") - 1)


def step_edges(chunked: DataFrame) -> DataFrame:
    """How many chunks hang on each conversation's task node, and how many pairs of consecutive steps have an edge."""
    steps = chunked.groupBy("conv_id", "step").agg(F.count("*").alias("n"))
    nxt = F.lead("step").over(Window.partitionBy("conv_id").orderBy("step"))
    d = steps.withColumn("edge", F.when(nxt.isNotNull(), 1).otherwise(0))
    return d.groupBy("conv_id").agg(F.sum("n").alias("task_edges"), F.sum("edge").alias("step_edges"))


def edited_files(ranges: DataFrame) -> DataFrame:
    """Distinct files of each conversation, and the one with the most rows (ties: the last by name)."""
    d = ranges.groupBy("conv", "file").agg(F.count("*").alias("n"))
    return d.groupBy("conv").agg(F.count("*").alias("n_files"), F.max(F.struct("n", "file")).alias("top")).select("conv", "n_files", F.col("top.file").alias("top_file"), F.col("top.n").alias("top_rows"))


def file_hubs(ranges: DataFrame) -> DataFrame:
    """Hub nodes: each file with its conversations, rows and tokens; summed within tasks, so a hub of any size is one small row."""
    return ranges.groupBy("file").agg(F.countDistinct("conv").alias("n_conv"), F.count("*").alias("n_rows"), F.sum("tokens").alias("tokens"))


def first_seen(commands: DataFrame) -> DataFrame:
    """Distinct commands of each session in the order of their first use."""
    d = commands.groupBy("session", "cmd").agg(F.min("seq").alias("first_seq"))
    return d.withColumn("pos", F.row_number().over(Window.partitionBy("session").orderBy("first_seq")).cast("long"))


def stop_blocks(commands: DataFrame, most: int = 2) -> DataFrame:
    """Of each session's edits, the first `most`: what a stop budget lets through."""
    w = Window.partitionBy("session").orderBy("seq")
    return commands.filter("edit").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).select("session", "seq", "nth")


def reads_by_epoch(commands: DataFrame) -> DataFrame:
    """Commands between edits: every edit begins a new epoch of its session."""
    w = Window.partitionBy("session").orderBy("seq")
    d = commands.withColumn("epoch", F.sum(F.when(F.col("edit"), 1).otherwise(0)).over(w).cast("long"))
    return d.groupBy("session", "epoch").agg(F.count("*").alias("n"), F.countDistinct("cmd").alias("n_cmd"))


def held_high(events: DataFrame, k: int = 3, threshold: float = 50.0) -> DataFrame:
    """Events whose last `k` values of the user all reach the threshold; fewer than `k` values never do."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1 - k, 0)
    d = events.withColumns({"n": F.count("value").over(w), "low": F.min("value").over(w)})
    return d.filter((F.col("n") >= k) & (F.col("low") >= threshold)).select("user_id", "event_id")


def keep_sets(events: DataFrame) -> DataFrame:
    """The event types of each user's even and odd events: how many both have, and how many either has."""
    odd = F.col("event_id") % 2 == 1
    d = events.groupBy("user_id").agg(F.collect_set(F.when(odd, F.col("event_type"))).alias("a"), F.collect_set(F.when(~odd, F.col("event_type"))).alias("b"))
    return d.select("user_id", F.size(F.array_intersect("a", "b")).cast("long").alias("both"), F.size(F.array_union("a", "b")).cast("long").alias("either"))


def value_stats(events: DataFrame) -> DataFrame:
    """Count, least and greatest value of each event type."""
    return events.groupBy("event_type").agg(F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"))
