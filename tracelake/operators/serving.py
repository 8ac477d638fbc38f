"""What serving a conversation keeps, cuts and remembers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import trace


def cut_tally(messages: DataFrame, tau_q: int = 700_000) -> DataFrame:
    """(conv_id, kind, kept, cut): tokens of kept and of cut chunks."""
    cut = trace.threshold_cut(messages, tau_q).select("conv_id", "gi", F.lit(True).alias("cut"))
    d = trace.chunks(messages).join(cut, ["conv_id", "gi"], "left")
    return d.groupBy("conv_id", "kind").agg(F.coalesce(F.sum(F.when(F.col("cut").isNull(), F.col("tokens"))), F.lit(0)).alias("kept"), F.coalesce(F.sum(F.when(F.col("cut"), F.col("tokens"))), F.lit(0)).alias("cut"))


def snapshot_deltas(snapshots: DataFrame) -> DataFrame:
    """(conv, seq, new): what each serve's registry sizes, (conv, seq, n), add to the serve before; a smaller one began anew and counts whole."""
    before = F.lag("n").over(Window.partitionBy("conv").orderBy("seq"))
    return snapshots.select("conv", "seq", F.when(before.isNull() | (before > F.col("n")), F.col("n")).otherwise(F.col("n") - before).alias("new"))


def fold_lookup(messages: DataFrame, folds: DataFrame) -> DataFrame:
    """(conv_id, turn, served, known): each message with its fold by (turn, fingerprint), or folded now where there is none."""
    d = messages.withColumn("fp", F.sha2(F.to_json(F.struct("role", "text")), 256)).join(folds, ["turn", "fp"], "left")
    own = F.concat(F.lit("fold:"), F.substring("fp", 1, 8))
    return d.select("conv_id", "turn", F.coalesce("fold", own).alias("served"), F.col("fold").isNotNull().alias("known"))


def derived_folds(messages: DataFrame) -> DataFrame:
    """Folds of the messages of every third conversation, one for each (turn, fingerprint)."""
    d = messages.filter("conv_id % 3 = 0").select("turn", F.sha2(F.to_json(F.struct("role", "text")), 256).alias("fp"))
    return d.distinct().withColumn("fold", F.concat(F.lit("held:"), F.substring("fp", 1, 8)))


def unfrozen_tools(calls: DataFrame, keep: DataFrame) -> DataFrame:
    """(conv, tool): tools called in a conversation's history that its keep set lacks, so that they come back into the roster."""
    return calls.select("conv", "tool").distinct().join(keep, ["conv", "tool"], "left_anti")


def override_commands(exports: DataFrame) -> DataFrame:
    """(session, cmds): the commands of all of a session's exports, each once, in order."""
    return exports.groupBy("session").agg(F.array_join(F.array_sort(F.collect_set("cmd")), ",").alias("cmds"))


def replaced_relation(edges: DataFrame, pairs: DataFrame, rel: int = 4) -> DataFrame:
    """(src, dst, rel): the edges of every other relation, and the client's pairs in place of those of `rel`."""
    return edges.filter(F.col("rel") != rel).select("src", "dst", "rel").unionByName(pairs.select("src", "dst", F.lit(rel).cast("long").alias("rel"))).distinct()
