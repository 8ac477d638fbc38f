"""Similar chunks, threshold cuts by kind, the context fold, latches and views. Ties are broken by the columns named in each order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import floor_tokens
from . import trace
from .dealt import dealt, parts
from .shell import fold

SIMILAR = 0.6
# Distinctive spans and the words that never are.
SPAN = r"""[A-Za-z_][A-Za-z0-9_]*(?:[./-][A-Za-z0-9_]+)+|[A-Za-z_][A-Za-z0-9_]{3,}|"[^"\n]{2,}"|'[^'\n]{2,}'|\b\d{2,}\b"""
STOP_WORDS = "self true false none null return import from class value string result object the and for with that this your def function print test tests file code line name".split()


def spans(text: Column, least: int) -> Column:
    """The set of distinctive spans of `least` characters or more: lower case, no quotes, no stop words; digits alone from three on."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPAN), 0), lambda s: F.lower(F.regexp_replace(s, "^['\"]+|['\"]+$", "")))
    return F.array_distinct(F.filter(found, lambda s: (F.length(s) >= least) & ~s.isin(STOP_WORDS) & (~s.rlike("^[0-9]+$") | (F.length(s) >= 3))))


def similar_chunks(chunked: DataFrame, least: int = 5, share: float = SIMILAR) -> DataFrame:
    """(conv_id, src, dst): chunks and those of later steps whose span sets have a Jaccard similarity of `share` or more.

    Candidates meet on a span of the conversation, and only on one of each set's first n - ceil(share * n) + 1 spans in an order
    of rising frequency: similar sets share one of those. The check is on whole sets.
    """
    sets = chunked.select("conv_id", "gi", "step", spans(F.col("text"), least).alias("s")).filter(F.size("s") > 0)
    words = sets.select("conv_id", "gi", "step", F.size("s").alias("n"), F.explode("s").alias("w"))
    often = words.groupBy("conv_id", "w").agg(F.count("*").alias("f"))
    place = F.row_number().over(Window.partitionBy("conv_id", "gi").orderBy("f", "w"))
    first = words.join(often, ["conv_id", "w"]).withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * share) + 1)
    old = first.select("conv_id", "w", F.col("gi").alias("src"), F.col("step").alias("s1"), F.col("n").alias("n1"))
    new = first.select("conv_id", "w", F.col("gi").alias("dst"), F.col("step").alias("s2"), F.col("n").alias("n2"))
    may = (F.col("s2") > F.col("s1")) & (F.least("n1", "n2") >= share * F.greatest("n1", "n2"))
    pairs = old.join(new, ["conv_id", "w"]).filter(may).select("conv_id", "src", "dst").distinct()
    a, b = sets.select("conv_id", F.col("gi").alias("src"), F.col("s").alias("a")), sets.select("conv_id", F.col("gi").alias("dst"), F.col("s").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, ["conv_id", "src"]).join(b, ["conv_id", "dst"]).filter(both >= share * (F.size("a") + F.size("b") - both)).select("conv_id", "src", "dst")


def similar_counts(chunked: DataFrame) -> DataFrame:
    """Of each chunk: how many later and earlier chunks are similar to it, and the sum of 1 / (1 + steps between) over the earlier ones, at most 3."""
    e = similar_chunks(chunked)
    step = chunked.select("conv_id", F.col("gi").alias("src"), F.col("step").alias("s1"))
    e = e.join(step, ["conv_id", "src"]).join(step.withColumnsRenamed({"src": "dst", "s1": "s2"}), ["conv_id", "dst"])
    later = e.groupBy("conv_id", F.col("src").alias("gi")).agg(F.count("*").alias("later"))
    earlier = e.groupBy("conv_id", F.col("dst").alias("gi")).agg(F.count("*").alias("earlier"), F.least(F.lit(3.0), F.sum(1 / (1 + F.col("s2") - F.col("s1")))).alias("recency"))
    d = chunked.select("conv_id", "gi").join(later, ["conv_id", "gi"], "left").join(earlier, ["conv_id", "gi"], "left")
    return d.select("conv_id", "gi", F.coalesce("later", F.lit(0)).cast("long").alias("later"), F.coalesce("earlier", F.lit(0)).cast("long").alias("earlier"), F.round(F.coalesce("recency", F.lit(0.0)), 9).alias("recency"))


def span_counts(documents: DataFrame) -> DataFrame:
    s = spans(F.col("text"), 5)
    return documents.select("doc_id", F.size(s).cast("long").alias("n_spans"), F.sha2(F.array_join(F.array_sort(s), "\n"), 256).alias("spans_sha"))


def kind_cut(messages: DataFrame, taus: dict[str, int]) -> DataFrame:
    """Chunks below their kind's threshold, in long runs; a kind without a threshold is never cut, nor a chunk that was asked for again."""
    rows = [F.when(F.col("kind") == k, t) for k, t in sorted(taus.items())]
    copies = F.count("*").over(Window.partitionBy("conv_id", "kind", F.sha2("text", 256)).orderBy("step").rangeBetween(Window.unboundedPreceding, -1))
    d = trace.scored(messages).withColumn("fought", copies > 0).withColumn("cut", F.coalesce(F.col("score_q") < F.coalesce(*rows), F.lit(False)) & ~F.col("fought"))
    return trace.long_runs(d).select("conv_id", "gi", "kind", "run_tokens")


def derived_calls(messages: DataFrame) -> DataFrame:
    """Chunks as calls: a user message is the output of one of two commands, by step."""
    d = trace.scored(messages)
    cmd = F.when(F.col("kind") == "other", F.concat(F.lit("run "), (F.col("step") % 2).cast("string")))
    return d.select(F.col("conv_id").alias("conv"), "gi", "step", F.col("turn").alias("owner"), cmd.alias("cmd"), "tokens", "score_q")


def fold_cuts(messages: DataFrame, tau_q: int = 700_000) -> DataFrame:
    return fold(derived_calls(messages), tau_q)


def purity_resets(requests: DataFrame) -> DataFrame:
    """(conv, seq, reset): whether a request's history, (conv, seq, hashes), no longer begins with the request before it."""
    before = F.lag("hashes").over(Window.partitionBy("conv").orderBy("seq"))
    shrunk = F.size("hashes") < F.size("before")
    d = requests.withColumn("before", before)
    return d.select("conv", "seq", F.coalesce(shrunk | (F.slice("hashes", 1, F.size("before")) != F.col("before")), F.lit(False)).alias("reset"))


def derived_requests(messages: DataFrame) -> DataFrame:
    """One request for each message, with the hashes of all messages so far; every fifth turn the client has rewritten its first message."""
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    d = messages.select("conv_id", "turn", F.collect_list(F.sha2(F.to_json(F.struct("role", "text")), 256)).over(so_far).alias("h"))
    h = F.when(F.col("turn") % 5 == 4, F.transform("h", lambda x, i: F.when(i == 0, F.lit("edited")).otherwise(x))).otherwise(F.col("h"))
    return d.select(F.col("conv_id").alias("conv"), F.col("turn").alias("seq"), h.alias("hashes"))


def governor(signals: DataFrame) -> DataFrame:
    """From (session, seq, kill, coach, bank, horizon): kill stays on once it is; each other fires once, at its first row before any kill."""
    w = Window.partitionBy("session").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = signals.withColumn("killed", F.max("kill").over(upto))
    once = [((F.col(c) & ~F.col("killed")) & (F.sum(F.when(F.col(c) & ~F.col("killed"), 1).otherwise(0)).over(upto) == 1)).alias(f"{c}_fires") for c in ("coach", "bank", "horizon")]
    return d.select("session", "seq", "killed", *once)


def derived_signals(events: DataFrame) -> DataFrame:
    v = F.floor(F.col("value"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return events.select(F.col("user_id").alias("session"), seq.alias("seq"), (v > 95).alias("kill"), (v % 7 == 3).alias("coach"), v.between(20, 30).alias("bank")).withColumn("horizon", F.col("seq") >= 8)


def rule_fires(rules: DataFrame, tau_q: int) -> DataFrame:
    """(conv, eid, fire_step, at) once for each rule and step whose score reached the threshold, at its first row."""
    return rules.filter(F.col("p_q") >= tau_q).groupBy("conv", "eid", "fire_step").agg(F.min("seq").alias("at"))


def derived_rules(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("conv"), F.col("event_type").alias("eid"), (F.floor(F.col("value")) % 6).cast("long").alias("fire_step"), F.col("event_id").alias("seq"), (F.floor(F.col("value") * 10_000) % 1_000_000).cast("long").alias("p_q"))


def recent_commands(commands: DataFrame, chars: int = 4000) -> DataFrame:
    """(session, step, text): the commands of a step and the one before it, in order, at most `chars` characters."""
    w = Window.partitionBy("session").orderBy("step").rangeBetween(-1, 0)
    d = commands.groupBy("session", "step").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "cmd"))), lambda x: x["cmd"]).alias("c"))
    d = d.withColumn("near", F.transform(F.array_sort(F.collect_list(F.struct("step", "c")).over(w)), lambda x: x["c"]))
    return d.select("session", "step", F.substring(F.array_join(F.flatten("near"), "\n"), 1, chars).alias("text"))


def ranked_files(paths: DataFrame, cap: int = 20) -> DataFrame:
    """(pos, path, more): the first `cap` of (path) by depth, length and name, and how many there are beyond them."""
    d = paths.select("path").distinct().select("path", F.size(F.split("path", "/")).alias("depth"), F.length("path").alias("n"))
    total = d.agg(F.count("*").alias("total")).scalar()
    top = d.orderBy("depth", "n", "path").limit(cap).withColumn("pos", F.row_number().over(Window.orderBy("depth", "n", "path")).cast("long"))
    return top.select("pos", "path", F.greatest(F.lit(0), total - cap).cast("long").alias("more"))


def group_spans(ranges: DataFrame) -> DataFrame:
    """(conv, step, file, lo, hi): of each step its first file and the lines it has of that file."""
    first = F.min_by("file", "gi")
    d = ranges.join(ranges.groupBy("conv", "step").agg(first.alias("first")), ["conv", "step"]).filter("file = first")
    return d.groupBy("conv", "step", "file").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def rendered_cuts(messages: DataFrame, tau_q: int = 700_000) -> DataFrame:
    """(conv_id, turn, text): each message with cut chunks as it is served: its kept chunks and one marker for each run of cut ones."""
    d = trace.scored(messages)
    cut = trace.threshold_cut(messages, tau_q).select("conv_id", "gi", "run", "run_tokens")
    d = d.join(cut, ["conv_id", "gi"], "left")
    first = F.min("gi").over(Window.partitionBy("conv_id", "turn", "run"))
    part = F.when(F.col("run").isNull(), F.col("text")).when(F.col("gi") == first, F.concat(F.lit("[cut: "), F.col("run_tokens").cast("string"), F.lit(" tokens]")))
    d = d.withColumn("part", part).groupBy("conv_id", "turn").agg(F.max(F.col("run").isNotNull()).alias("any"), F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("gi", "part")))).alias("p")).filter("any")
    return d.select("conv_id", "turn", F.array_join(F.transform("p", lambda x: x["part"]), "\n").alias("text"))


def near_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """Of (conv, step, file, v) each row's `k` most similar rows of earlier steps and other files, by cosine; ties to the earlier one."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    d = vectors.withColumn("norm", norm).filter("norm > 0").select("conv", "step", "file", F.transform("v", lambda x: x / F.col("norm")).alias("v"))
    e = d.select("conv", F.col("step").alias("step2"), F.col("file").alias("file2"), F.col("v").alias("v2"))
    dot = F.aggregate(F.zip_with("v", "v2", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    pairs = d.join(e, "conv").filter("step2 < step AND file2 <> file").select("conv", "step", "step2", F.round(dot, 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("conv", "step").orderBy(F.desc("score"), "step2"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def derived_vectors(embeddings: DataFrame) -> DataFrame:
    """Blocks of 40 vectors as conversations, so pairs stay within a block of fixed size."""
    return embeddings.select(F.floor(F.col("vec_id") / 40).cast("long").alias("conv"), F.col("vec_id").alias("step"), F.col("label").alias("file"), F.col("embedding").cast("array<double>").alias("v"))


def double_budget(messages: DataFrame) -> DataFrame:
    """Per assistant step its characters and those up to the next, supervisor messages left out, and the running sum of the running
    sums' quarters: what each call has carried so far. Conversations of under six steps have 0."""
    text = F.coalesce("text", F.lit(""))
    kept = F.when(text.contains("[SUPERVISOR") | text.contains("[CONTEXT RESET"), 0).otherwise(F.length(text))
    d = messages.withColumn("s", F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn"))).filter("s > 0")
    d = d.groupBy("conv_id", F.col("s").cast("long").alias("s")).agg(F.sum(kept).alias("chars"))
    w = Window.partitionBy("conv_id").orderBy("s")
    d = d.withColumn("run", F.sum("chars").over(w)).withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    return d.select("conv_id", "s", "chars", F.when(F.col("n") < 6, 0.0).otherwise(F.sum(F.col("run") / 4).over(w)).alias("cum_tok"))


def similar_commands(commands: DataFrame, window: int = 6, share: float = SIMILAR, n: int | None = None) -> DataFrame:
    """(session, seq, lf): the share of the trailing `window` commands that are like an earlier command of the session (Jaccard of words).

    A command is like an earlier one if its first use follows the first use of a similar one, or if it is not its first use. Distinct
    commands meet on one of their first n - ceil(share * n) + 1 words in an order of rising frequency, as similar sets share one of
    those; the check is on whole sets, the first match ends the search of a word, and no pairs leave the join. `n`: partitions.
    """
    first = commands.groupBy("session", "cmd").agg(F.min("seq").alias("first"))
    words = first.withColumn("w", F.array_distinct(F.filter(F.split("cmd", r"\s+"), lambda x: x != ""))).withColumn("x", F.explode("w"))
    words = words.withColumn("often", F.count("*").over(Window.partitionBy("session", "x")))
    place = F.row_number().over(Window.partitionBy("session", "cmd").orderBy("often", "x"))
    words = words.withColumn("place", place).filter(F.col("place") <= F.size("w") - F.ceil(F.size("w") * share - 1e-9) + 1)
    side = dealt(words.select("session", "x", "cmd", "first", "w"), n, "session", "x")
    new, old = (lambda c: F.col(f"new.{c}")), (lambda c: F.col(f"old.{c}"))
    both = F.size(F.array_intersect(new("w"), old("w")))
    similar = (old("first") < new("first")) & (both >= share * (F.size(new("w")) + F.size(old("w")) - both))
    like = side.alias("new").join(side.alias("old"), (new("session") == old("session")) & (new("x") == old("x")) & similar, "left_semi")
    like = dealt(like.select("session", "cmd"), n, "session", "cmd").distinct().withColumn("like", F.lit(True))
    again = F.col("session").isNotNull() & F.col("cmd").isNotNull() & (F.col("seq") > F.min("seq").over(Window.partitionBy("session", "cmd")))
    d = dealt(commands.select("session", "seq", "cmd"), n, "session", "cmd").withColumn("again", again).join(like, ["session", "cmd"], "left")
    d = dealt(d.select("session", "seq", F.when(F.col("again") | F.col("like"), 1.0).otherwise(0.0).alias("flag")), n, "session")
    lf = F.avg("flag").over(Window.partitionBy("session").orderBy("seq").rowsBetween(1 - window, 0))
    return d.select("session", "seq", F.round(lf, 9).alias("lf"))


def derived_phrases(events: DataFrame, n: int | None = None) -> DataFrame:
    """Commands of three to five words, few of them, so that many are alike but not equal. `n`: partitions of the sessions."""
    events = dealt(events, n, "user_id")
    v = F.floor(F.col("value")).cast("long")
    cmd = F.concat_ws(" ", F.col("event_type"), F.lit("-q"), F.concat(F.lit("f"), (v % 3).cast("string")), F.when(v % 2 == 0, F.lit("--all")), F.when(v % 5 == 0, F.concat(F.lit("x"), (v % 4).cast("string"))))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return events.select(F.col("user_id").alias("session"), seq.alias("seq"), cmd.alias("cmd"), F.floor((seq - 1) / 4).cast("long").alias("step"))


def loop_shares(events: DataFrame) -> DataFrame:
    n = parts(events)
    return similar_commands(derived_phrases(events, n), n=n)


def request_delta(messages: DataFrame) -> DataFrame:
    """Per conversation the tokens of the original and of what is served (system text left out), and the difference, never below 0."""
    t = floor_tokens(F.col("text"))
    d = messages.groupBy("conv_id").agg(F.sum(t).alias("orig"), F.coalesce(F.sum(F.when(F.col("role") != "system", t)), F.lit(0)).alias("served"))
    return d.withColumn("saved", F.greatest(F.lit(0), F.col("orig") - F.col("served")))


def memo_lookup(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, memo_turn): each message and the newest earlier message of its conversation that has the same score memo key (role and length class)."""
    key = F.concat_ws(":", "role", (F.length(F.coalesce("text", F.lit(""))) % 5).cast("string"))
    d = messages.select("conv_id", "turn", key.alias("k"))
    return d.select("conv_id", "turn", F.max("turn").over(Window.partitionBy("conv_id", "k").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)).alias("memo_turn"))


def readmissions(ranges: DataFrame) -> DataFrame:
    """(conv, gi, t, share, resident, earlier): step, its share of the last one, whether the last step has the file too, earlier rows of the file."""
    last = F.max("step").over(Window.partitionBy("conv"))
    of_file = Window.partitionBy("conv", "file")
    earlier = F.count("*").over(of_file.orderBy("step").rangeBetween(Window.unboundedPreceding, -1))
    return ranges.select("conv", "gi", F.col("step").alias("t"), F.round(F.col("step") / F.greatest(F.lit(1), last), 9).alias("share"), F.when(F.max("step").over(of_file) == last, 1).otherwise(0).alias("resident"), earlier.alias("earlier"))


def step_clamp(rules: DataFrame, steps: DataFrame) -> DataFrame:
    """As-of: (conv, seq, node_step) with the latest step (conv, step) that is not after the rule's fire_step, else the conversation's first."""
    s = steps.groupBy("conv").agg(F.array_sort(F.collect_set("step")).alias("all"))
    upto = F.filter("all", lambda x: x <= F.col("fire_step"))
    return rules.join(s, "conv").select("conv", "seq", F.when(F.size(upto) > 0, F.element_at(upto, -1)).otherwise(F.element_at("all", 1)).alias("node_step"))
