"""Usage ledgers: honest savings, totals by model and tool, calibration, expiry. Null counterfactuals are unmeasured, never zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def derived_ledger(events: DataFrame) -> DataFrame:
    """A ledger from the event stream: user as session, type as tool; every seventh event is unprobed, every fifth names no model."""
    v = F.floor(F.col("value") * 100).cast("long")
    return events.select(
        "event_id", "ts", F.col("user_id").alias("session_id"), F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("tool"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string"))).alias("model"),
        F.when(F.col("event_id") % 7 != 0, v).alias("cf"), F.floor(v * 3 / 4 + F.col("event_id") % 13).cast("long").alias("billed"),
        (v % 97).alias("cache_read"), (v % 31).alias("cache_write"), (F.col("event_id") % 17 == 0).alias("fail_open"),
        (F.col("user_id") * 10 + F.col("event_id") % 3).alias("conv_id"), F.when(F.col("event_id") % 9 != 0, v % 53).alias("freeze_cut"),
    )


def totals(ledger: DataFrame) -> DataFrame:
    probed = F.col("cf").isNotNull()
    return ledger.agg(
        F.count("*").alias("n_rows"), F.count("cf").alias("probed"), F.sum(F.when(probed, 0).otherwise(1)).cast("long").alias("null_probes"),
        F.sum(F.when(F.col("fail_open"), 1).otherwise(0)).cast("long").alias("fail_opens"), F.sum("cf").alias("cf"), F.sum(F.when(probed, F.col("billed"))).alias("billed_probed"),
        F.sum(F.col("cf") - F.col("billed")).alias("saved"), F.sum("cache_read").alias("cache_read"), F.sum("cache_write").alias("cache_write"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("conv_id").alias("conversations"),
        F.sum("freeze_cut").alias("freeze_cut"),
    )


def by_model(ledger: DataFrame) -> DataFrame:
    return ledger.filter("cf IS NOT NULL").groupBy(F.coalesce("model", F.lit("(unrecorded)")).alias("model")).agg(F.count("*").alias("n"), F.sum("cf").alias("cf"), F.sum(F.col("cf") - F.col("billed")).alias("saved"))


def by_tool(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.coalesce("tool", F.lit("(default)")).alias("tool")).agg(F.count("*").alias("n"), F.count("cf").alias("probed"), F.sum(F.col("cf") - F.col("billed")).alias("saved"))


def by_session(ledger: DataFrame) -> DataFrame:
    """Signed savings; null where nothing was probed."""
    return ledger.groupBy("session_id").agg(F.sum(F.col("cf") - F.col("billed")).alias("saved"), F.count("*").alias("n"))


def report(ledger: DataFrame) -> DataFrame:
    t = totals(ledger)
    return t.select("n_rows", "probed", F.round(F.try_divide(F.col("saved") * 100.0, F.col("cf")), 6).alias("saved_pct"), F.round(F.try_divide(F.col("cache_read") * 1.0, F.col("cache_write")), 6).alias("cache_ratio"))


def billed_so_far(ledger: DataFrame) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return ledger.select("event_id", "session_id", F.sum("billed").over(w).alias("billed_so_far"))


def latest_per_session(ledger: DataFrame, cap: int = 20) -> DataFrame:
    """The newest request of each session, the most recent `cap` of them."""
    d = ledger.groupBy("session_id").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return d.select("session_id", F.col("m.event_id").alias("event_id")).orderBy(F.col("m.ts").desc(), F.col("m.event_id").desc()).limit(cap)


def evict(ledger: DataFrame, ttl_seconds: int = 3600, cap: int = 512) -> DataFrame:
    """Sessions that stay: touched within the time to live before the newest row, the newest `cap`."""
    s = ledger.groupBy("session_id").agg(F.max("ts").alias("touched"))
    now = s.agg(F.max("touched").alias("now"))
    live = s.join(F.broadcast(now), F.col("touched") > F.col("now") - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))
    return live.orderBy(F.col("touched").desc(), "session_id").limit(cap).select("session_id", F.unix_timestamp("touched").alias("touched_s"))


def tau_for_coverage(rows: DataFrame, coverage: float) -> DataFrame:
    """By kind: the score at which the needed tokens, from the highest score down, reach the coverage, else the lowest. Rows are (kind,
    score, needed, tokens).

    Tokens are summed by score first, so a kind has as many rows as the grid has scores, whatever number it had before.
    """
    d = rows.filter("needed = 1").groupBy("kind", "score").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    total = d.groupBy("kind").agg(F.sum("t").alias("total"), F.sum("n").alias("n"), F.min("score").alias("least"))
    cum = F.sum("t").over(Window.partitionBy("kind").orderBy(F.desc("score")))
    first = d.select("kind", "score", cum.alias("cum")).join(total.select("kind", "total"), "kind").filter(F.col("cum") >= F.col("total") * coverage).groupBy("kind").agg(F.max("score").alias("tau"))
    return total.join(first, "kind", "left").select("kind", F.coalesce("tau", "least").alias("tau"), "n")


def tau_report(rows: DataFrame, tau: int) -> DataFrame:
    """Cut share, coverage of needed tokens and row count by kind and over all."""
    cut = F.sum(F.when(F.col("score") < tau, F.col("tokens")).otherwise(0))
    kept = F.sum(F.when((F.col("needed") == 1) & (F.col("score") >= tau), F.col("tokens")).otherwise(0))
    d = rows.groupingSets([["kind"], []], "kind").agg(F.grouping("kind").alias("g"), F.sum("tokens").alias("t"), cut.alias("c"), F.sum(F.when(F.col("needed") == 1, F.col("tokens")).otherwise(0)).alias("nt"), kept.alias("k"), F.count("*").alias("n"))
    return d.select(F.when(F.col("g") == 1, "(overall)").otherwise(F.col("kind")).alias("kind"), F.round(F.col("c") / F.col("t"), 9).alias("cut"), F.round(F.try_divide(F.col("k"), F.col("nt")), 9).alias("needed_cov"), "n")
