"""Whether a run may stop, the signals that steer it, and the guard of its cache.

Messages are (conv, seq, role, text, action, edited): an action and the source files edited by structured tools belong to assistants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calls
from ..functions.text import SPACE, strip
from .decisions import similar_commands

DIFF_CHARS = 3000
# When a run has stalled, its cost or score is a sign, and the bands of its budget.
STALLED_LAST, STALLED_LEAST, STALLED_FROM = 0.5, 0.34, 6
DOOM, DOOM_ROWS, RUNAWAY, DOOMED, KILL_FLOOR = 0.5, 3, 3.25, 2.0, 750_000
COACH_TOKENS, COACH_STEPS, BANK_FLOOR, BANK_CEIL = 230_168.0, 48, 140_701.0, 1_835_088.0


def _is_observation() -> Column:
    return F.col("role").isin("tool", "user")


def _headed(text: Column) -> Column:
    return text.contains("@@ ") & (text.contains("+++ ") | text.contains("--- "))


def shown_diffs(messages: DataFrame) -> DataFrame:
    """(conv, seq, diff): the last observation that shows a diff, from the diff's start; supervisor messages do not count."""
    t = F.coalesce("text", F.lit(""))
    start = F.least(*[F.when(F.locate(x, t) > 0, F.locate(x, t)) for x in ("@@ ", "--- ")])
    at = F.when(F.locate("diff --git", t) > 0, F.locate("diff --git", t)).when(_headed(t), start)
    d = messages.filter(_is_observation() & ~t.rlike(rf"^[{SPACE}]*\[SUPERVISOR")).withColumn("at", at).filter("at IS NOT NULL")
    last = d.groupBy("conv").agg(F.max_by(F.struct("seq", "text", "at"), "seq").alias("m"))
    return last.select("conv", "m.seq", F.col("m.text").substr(F.col("m.at"), F.lit(DIFF_CHARS)).alias("diff"))


def disk_diffs(messages: DataFrame) -> DataFrame:
    """(conv, seq, there): the last assistant that ran `git diff`, and whether the observations among the three messages after it hold one."""
    w = Window.partitionBy("conv").orderBy("seq").rowsBetween(1, 3)
    after = F.array_join(F.collect_list(F.when(_is_observation(), F.coalesce("text", F.lit("")))).over(w), " ")
    d = messages.withColumn("after", after).filter((F.col("role") == "assistant") & F.col("action").rlike(r"(?U)\bgit\s+diff\b"))
    d = d.groupBy("conv").agg(F.max_by(F.struct("seq", "after"), "seq").alias("m"))
    return d.select("conv", "m.seq", (F.col("m.after").contains("diff --git") | _headed(F.col("m.after"))).alias("there"))


def stalls(messages: DataFrame) -> DataFrame:
    """(conv, n_cmds, stalled): from six commands on, whether the last loop share is 0.5 or more and the last three 0.34 or more."""
    c = messages.filter("role = 'assistant'").select(F.col("conv").alias("session"), "seq", F.coalesce("action", F.lit("")).alias("cmd"))
    w = Window.partitionBy("session").orderBy(F.desc("seq"))
    d = similar_commands(c).withColumn("back", F.row_number().over(w)).groupBy(F.col("session").alias("conv"))
    d = d.agg(F.count("*").alias("n_cmds"), F.max(F.when(F.col("back") == 1, F.col("lf"))).alias("last"), F.min(F.when(F.col("back") <= 3, F.col("lf"))).alias("least"))
    return d.select("conv", "n_cmds", ((F.col("n_cmds") >= STALLED_FROM) & (F.col("last") >= STALLED_LAST) & (F.col("least") >= STALLED_LEAST)).alias("stalled"))


def verdicts(messages: DataFrame) -> DataFrame:
    """(conv, verdict, rung, reverted, stalled): SUBMIT where an edit is there and the run has stalled, else CONTINUE.

    Whether an edit is there is read from the agent's own last `git diff`; without one from the last diff shown, else from structured
    edits of source files. `reverted`: an edit was seen, but the last `git diff` is empty.
    """
    no = F.lit(False)
    ids = messages.groupBy("conv").agg(F.coalesce(F.max((F.col("role") == "assistant") & (F.size(F.coalesce("edited", F.array())) > 0)), no).alias("made"))
    shown = shown_diffs(messages).select("conv", (strip(F.col("diff")) != "").alias("shown"))
    d = ids.join(shown, "conv", "left").join(disk_diffs(messages).select("conv", "there"), "conv", "left").join(stalls(messages).select("conv", "stalled"), "conv", "left")
    shown, made, stalled = F.coalesce("shown", no), F.col("made"), F.coalesce("stalled", no)
    rung = F.when(F.col("there"), "disk_true").when(~F.col("there"), "disk_false").when(shown, "shown_diff").when(made, "struct_edit").otherwise("none")
    has = ~rung.isin("disk_false", "none")
    return d.select("conv", F.when(has & stalled, "SUBMIT").otherwise("CONTINUE").alias("verdict"), rung.alias("rung"), (~has & (shown | made)).alias("reverted"), stalled.alias("stalled"))


def derived_runs(events: DataFrame) -> DataFrame:
    """A run for each user: every event is an assistant's call and what came of it; some calls are `git diff`, some edit files."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    v = F.floor("value").cast("long")
    d = events.select(F.col("user_id").alias("conv"), seq.alias("seq"), v.alias("v"), (F.col("user_id") % 5).alias("u"), "event_type")
    action = F.when((F.col("v") % 11 == 0) & (F.col("u") != 1), "git  diff HEAD").otherwise(F.concat(F.col("event_type"), F.lit(" -k "), (F.col("v") % 3).cast("string")))
    args = F.concat(F.lit('{"file_path": "src/F'), (F.col("v") % 9).cast("string"), F.when(F.col("v") % 2 == 0, '.py"}').otherwise('.md"}'))
    edited = F.when((F.col("event_type") == "purchase") & (F.col("u") != 2), calls.edited_source(F.lit("Edit"), F.parse_json(args)))
    call = d.select("conv", (F.col("seq") * 2).alias("seq"), F.lit("assistant").alias("role"), F.lit("diff --git mine").alias("text"), action.alias("action"), F.array_compact(F.array(edited)).alias("edited"))
    k = (F.col("v") + F.col("u")) % 6
    text = F.when(F.col("u") <= 2, "plain @@ ").when(k == 0, "ok\ndiff --git a/x b/x\n@@ -1 +1 @@").when(k == 1, "--- a\n+++ b\n@@ -1 @@").when(k == 2, " \n[SUPERVISOR diff --git").otherwise("plain @@ ")
    obs = d.select("conv", (F.col("seq") * 2 + 1).alias("seq"), F.lit("tool").alias("role"), text.alias("text"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("array<string>").alias("edited"))
    return call.unionByName(obs)


def signals(requests: DataFrame) -> DataFrame:
    """The flags of each request of (session, seq, billed, cum_tok, n_steps, n_src, stalled, doom, median).

    `median` is what neighbours' runs cost; without one, or with 0, nothing runs away. head: the last three scores (all rows so far count)
    are 0.5 or more; budget, bank: the tokens carried, from so many steps or edited files on; runaway, doomed: what was billed so far is
    many times the median, the second only in a stalled run; floor_ok: enough was billed for a run to be ended.
    """
    w = Window.partitionBy("session").orderBy("seq")
    so_far = F.sum("billed").over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = w.rowsBetween(1 - DOOM_ROWS, 0)
    d = requests.withColumns({"billed_so_far": so_far, "high": (F.count("*").over(last) == DOOM_ROWS) & (F.min("doom").over(last) >= DOOM)})
    factor = F.when(F.col("median") > 0, F.col("billed_so_far") / F.col("median")).otherwise(0.0)
    cum = F.col("cum_tok")
    return d.select(
        "session", "seq", "billed_so_far", F.round(factor, 9).alias("runaway_factor"), "high", ((cum >= COACH_TOKENS) & (F.col("n_steps") > COACH_STEPS)).alias("budget"),
        ((F.col("n_src") >= 1) & (cum > BANK_FLOOR) & (cum <= BANK_CEIL)).alias("bank"), (factor > RUNAWAY).alias("runaway"), ((factor > DOOMED) & F.col("stalled")).alias("doomed"), (F.col("billed_so_far") >= KILL_FLOOR).alias("floor_ok"),
    )


def derived_signals(events: DataFrame) -> DataFrame:
    """A request for each event: a user's events so far as steps, purchases as edited files; a third of users have no neighbours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    v = F.floor("value").cast("long")
    n = F.count("*").over(w)
    return events.select(
        F.col("user_id").alias("session"), n.alias("seq"), (v * 800).alias("billed"), (F.sum(v).over(w) * n * 6 / 1.0).alias("cum_tok"), n.alias("n_steps"), F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(w).alias("n_src"),
        (v % 4 == 0).alias("stalled"), (v / 100.0).alias("doom"), F.when(F.col("user_id") % 3 != 0, (F.col("user_id") % 7 * 100_000).cast("double")).alias("median"),
    )


def cache_guard(requests: DataFrame, limit: int) -> DataFrame:
    """(session, seq, rewritten, tripped) of requests (session, seq, hashes, tokens), one hash and size for each message.

    A warm lane, one with a request before, would write again what both requests cover beyond the messages that they begin with alike:
    `rewritten` tokens. From the first request on that would write more than `limit` the lane stays tripped.
    """
    w = Window.partitionBy("session").orderBy("seq")
    before = F.lag("hashes").over(w)
    d = requests.withColumn("before", before).withColumn("covered", F.least(F.size("hashes"), F.coalesce(F.size("before"), F.lit(0))))
    same = F.zip_with("hashes", F.coalesce("before", F.array().cast("array<string>")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    alike = F.array_position(same, False) - 1
    frozen = F.when(alike < 0, F.size("hashes")).otherwise(alike)
    d = d.withColumn("frozen", F.least(frozen, F.col("covered")).cast("int"))
    rewritten = F.aggregate(F.slice("tokens", F.col("frozen") + 1, F.col("covered") - F.col("frozen")), F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("rewritten", rewritten)
    return d.select("session", "seq", "rewritten", F.max(F.col("rewritten") > limit).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("tripped"))


def derived_lanes(messages: DataFrame) -> DataFrame:
    """One request for each message with all before it; every fifth turn the client has changed one of its first messages."""
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    one = F.struct(F.sha2(F.concat_ws(":", "role", "text"), 256).alias("h"), F.floor(F.length(F.coalesce("text", F.lit(""))) / 4).cast("long").alias("t"))
    d = messages.select("conv_id", "turn", F.collect_list(one).over(so_far).alias("m"))
    h = F.transform("m", lambda x, i: F.when((F.col("turn") % 5 == 4) & (i == F.col("conv_id") % 4), F.lit("edited")).otherwise(x["h"]))
    return d.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), h.alias("hashes"), F.transform("m", lambda x: x["t"]).alias("tokens"))
