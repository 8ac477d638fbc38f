"""Conversations to steps and chunks, and what a threshold cuts from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import floor_tokens, splitlines, stub_score, token_estimate

WINDOW_LINES = 40
MIN_RUN_TOKENS = 10


def steps(messages: DataFrame) -> DataFrame:
    """Messages with step, is_task (the first observation), tail_lo (step of the last assistant turn) and n_obs.

    User and tool messages are observations; a step is an assistant turn and the observation that answers it: the number of
    observations before the message.
    """
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("conv_id")
    obs = F.when(F.col("role").isin("user", "tool"), 1).otherwise(0)
    d = messages.withColumns({"step": F.coalesce(F.sum(obs).over(before), F.lit(0)).cast("long"), "n_obs": F.sum(obs).over(all_).cast("long")})
    d = d.withColumn("is_task", F.coalesce(F.col("role").isin("user", "tool") & (F.col("step") == 0), F.lit(False)))
    return d.withColumn("tail_lo", F.max(F.when(F.col("role") == "assistant", F.col("step"))).over(all_))


def chunks(messages: DataFrame, window: int = WINDOW_LINES) -> DataFrame:
    """Windows of lines of every message but system text, the task and what no observation answers yet; blank windows go. gi numbers
    them by step, observations before assistant text, then by turn and window."""
    d = steps(messages).filter("role <> 'system' AND NOT is_task AND step < n_obs").withColumn("kind", F.when(F.col("role") == "assistant", "asst").otherwise("other"))
    lines = splitlines(F.col("text"))
    d = d.select("conv_id", "turn", "step", "tail_lo", "kind", lines.alias("ls")).filter(F.size("ls") > 0)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("ls") - 1) / window).cast("int")), lambda k: F.array_join(F.slice("ls", k * window + 1, F.lit(window)), "\n"))
    d = d.select("conv_id", "turn", "step", "tail_lo", "kind", F.posexplode(parts).alias("win", "text")).withColumn("win", F.col("win").cast("long")).filter(F.trim("text") != "")
    d = d.withColumn("tokens", token_estimate(F.col("text")))
    return d.withColumn("gi", F.row_number().over(Window.partitionBy("conv_id").orderBy("step", F.col("kind") == "asst", "turn", "win")).cast("long") - 1)


def scored(messages: DataFrame) -> DataFrame:
    return chunks(messages).withColumn("score_q", stub_score(F.col("step"), F.col("kind"), F.col("text")))


def checksum(chunked: DataFrame) -> DataFrame:
    """A digest of each conversation's chunks in order."""
    line = F.concat_ws(":", "step", "kind", "tokens")
    d = chunked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("gi", line.alias("line")))).alias("ls"), F.count("*").alias("n_chunks"))
    return d.select("conv_id", "n_chunks", F.sha2(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), 256).alias("checksum"))


def long_runs(marked: DataFrame, min_tokens: int = MIN_RUN_TOKENS) -> DataFrame:
    """Of the rows with `cut`, those in runs of neighbouring gi with one owner (turn) and enough tokens: gaps and islands."""
    w = Window.partitionBy("conv_id", "turn").orderBy("gi")
    run = marked.filter("cut").withColumn("run", F.col("gi") - F.row_number().over(w))
    mass = F.sum("tokens").over(Window.partitionBy("conv_id", "turn", "run"))
    return run.withColumn("run_tokens", mass).filter(F.col("run_tokens") >= min_tokens)


def threshold_cut(messages: DataFrame, tau_q: int) -> DataFrame:
    """Chunks below the threshold in steps before the current turn's tail, in long runs only; equal chunks of one message fall together."""
    d = scored(messages).withColumn("cut", (F.col("score_q") < tau_q) & (F.col("step") < F.coalesce(F.col("tail_lo"), F.lit(0))))
    d = d.withColumn("cut", F.max("cut").over(Window.partitionBy("conv_id", "turn", "kind", F.sha2("text", 256))))
    return long_runs(d)


def mass(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.sum(floor_tokens(F.col("text"))).alias("mass"), F.count("*").alias("n_messages"))


def cut_summary(messages: DataFrame, tau_q: int = 700_000) -> DataFrame:
    cut = threshold_cut(messages, tau_q).groupBy("conv_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"))
    d = mass(messages).join(cut, "conv_id", "left")
    return d.select("conv_id", "n_messages", "mass", F.coalesce("t", F.lit(0)).cast("long").alias("cut_tokens"), F.coalesce("k", F.lit(0)).cast("long").alias("cut_chunks"))


def struct_features(chunked: DataFrame) -> DataFrame:
    """Shares, age and position of each chunk in its conversation."""
    all_ = Window.partitionBy("conv_id")
    obs = F.sum("tokens").over(Window.partitionBy("conv_id", "step"))
    total, last = F.sum("tokens").over(all_), F.max("step").over(all_)
    copies = F.count("*").over(Window.partitionBy("conv_id", F.sha2("text", 256)).orderBy("step").rangeBetween(Window.unboundedPreceding, -1))
    newer = F.max("step").over(Window.partitionBy("conv_id", F.sha2("text", 256))) > F.col("step")
    return chunked.select(
        "conv_id", "gi",
        F.round(F.log1p(obs.cast("double")) / 8, 9).alias("log_obs"), F.round(F.col("tokens") / obs, 9).alias("obs_share"), (last - F.col("step")).alias("age"),
        F.round(F.log1p(F.col("tokens").cast("double")) / 8, 9).alias("log_tokens"), F.when(F.col("kind") == "asst", 1).otherwise(0).alias("is_asst"),
        F.when(newer, 1).otherwise(0).alias("superseded"), F.round(F.least(F.lit(1.0), copies / 5), 9).alias("dup"), F.round(F.col("tokens") / total, 9).alias("token_share"),
        F.round(F.when(last > 0, F.col("step") / last).otherwise(0.0), 9).alias("step_pos"), F.when(F.col("step") == last, 1).otherwise(0).alias("is_current"),
    )


def causal_features(chunked: DataFrame) -> DataFrame:
    """The same shares as each step saw them: prefix sums by step, no replay."""
    before = Window.partitionBy("conv_id").orderBy("step").rangeBetween(Window.unboundedPreceding, 0)
    copies = F.count("*").over(Window.partitionBy("conv_id", F.sha2("text", 256)).orderBy("step").rangeBetween(Window.unboundedPreceding, -1))
    return chunked.select("conv_id", "gi", F.round(F.col("tokens") / F.sum("tokens").over(before), 9).alias("prefix_share"), F.count("*").over(before).alias("prefix_chunks"), copies.alias("earlier_copies"), F.when(F.col("step") > 0, 1).otherwise(0).alias("step_pos"))


def budget(messages: DataFrame) -> DataFrame:
    """Per assistant step its characters and those of what follows, and their running token sum (0 under six steps)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = messages.withColumn("s", F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(w)).filter("s > 0")
    d = d.groupBy("conv_id", F.col("s").cast("long").alias("s")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    run = F.sum("chars").over(Window.partitionBy("conv_id").orderBy("s"))
    n = F.count("*").over(Window.partitionBy("conv_id"))
    return d.select("conv_id", "s", "chars", F.when(n < 6, 0).otherwise(F.floor(run / 4)).cast("long").alias("cum_tok"))


def role_cuts(messages: DataFrame, tau_q: int = 700_000) -> DataFrame:
    """Tokens cut by role; roles outside the known set count as (other), missing ones as (unrecorded)."""
    cut = threshold_cut(messages, tau_q).groupBy("conv_id", "turn").agg(F.sum("tokens").alias("t"))
    role = F.when(F.col("role").isNull(), "(unrecorded)").when(F.col("role").isin("user", "assistant", "system", "tool"), F.col("role")).otherwise("(other)")
    return messages.join(cut, ["conv_id", "turn"]).groupBy(role.alias("role")).agg(F.sum("t").alias("cut_tokens"), F.count("*").alias("messages"))


def prefix_lengths(messages: DataFrame) -> DataFrame:
    """For each conversation and the next one by id: how many leading messages have equal role and text."""
    a = messages.select("conv_id", "turn", F.sha2(F.to_json(F.struct("role", "text")), 256).alias("fp"))
    ids = messages.select("conv_id").distinct()
    nxt = ids.withColumn("nxt", F.col("conv_id") + 1).join(ids.withColumnRenamed("conv_id", "nxt"), "nxt", "left_semi")
    left = a.join(nxt, "conv_id")
    right = a.select(F.col("conv_id").alias("nxt"), "turn", F.col("fp").alias("fp2"))
    d = left.join(right, ["nxt", "turn"], "left").groupBy("conv_id").agg(F.min(F.when(F.col("fp2").isNull() | (F.col("fp") != F.col("fp2")), F.col("turn"))).alias("diff"), F.count("*").alias("n"))
    return d.select("conv_id", F.coalesce("diff", "n").cast("long").alias("prefix_len"))
