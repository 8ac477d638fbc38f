"""The context fold as a step function: what is cut of each step when it is born, and the registries that later steps are judged by.

A row is (conv, step, chunks, failed, snapshot): `chunks` are JSON, one object for each chunk of the step in order, with gi, owner (the
message), key (what tells it from others of its owner), kind, tokens, score, tau (its owner's threshold), cmd, direct (whether its message
answers cmd directly), own (its file and lines, if any), reads (file ranges it brought) and held (provider content, never cut here).

Steps are decided once, in order, and whole: where the scorer failed (`failed`), the step leaves no trace and waits; the next row decides
it first. So a stream and a table give equal rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import GRID, chunk_key
from ..operators import trace

MIN_RUN_TOKENS = 10
FOLD = "conv long, step long, decided array<long>, cut array<long>, insisted array<long>, insists long, fail_opens long, registry string"


def _contiguous(rows: list[dict], least: int) -> list[dict]:
    """Of the candidates those in runs of neighbours of one owner that hold `least` tokens."""
    runs: list[list[dict]] = []
    for c in sorted(rows, key=lambda c: c["gi"]):
        if runs and c["gi"] == runs[-1][-1]["gi"] + 1 and c["owner"] == runs[-1][-1]["owner"]:
            runs[-1].append(c)
        else:
            runs.append([c])
    return [c for r in runs if sum(c["tokens"] for c in r) >= least for c in r]


def _fought(state: dict, c: dict, step: int) -> bool:
    """Whether the latest earlier copy of any lines that the chunk brings is cut."""
    latest, last = None, -1
    for r in c["reads"]:
        for at, key, lo, hi in state["served_at"].get(r["file"], ()):
            if at < step and r["lo"] <= hi and lo <= r["hi"] and at > last:
                latest, last = key, at
    return latest is not None and latest in state["dropped"]


def _birth(state: dict, step: int, chunks: list[dict], taus: dict[str, int] | None, least: int) -> tuple[list[int], list[int]]:
    dropped, cmds = state["dropped"], state["cmds"]
    insisted: list[int] = []
    pools: dict[int, list[dict]] = {}
    for c in chunks:
        if c["held"] or c["key"] in dropped:
            continue
        if c["direct"] and c["cmd"] and c["cmd"] in cmds:
            insisted.append(c["gi"])
        else:
            pools.setdefault(c["owner"], []).append(c)
    cut: list[dict] = []
    for pool in pools.values():
        if taus is None:
            low = [c for c in pool if c["score"] < c["tau"]]
        else:
            low = [c for c in pool if c["score"] < taus.get(c["kind"], 0) and not _fought(state, c, step)]
        cut += _contiguous(low, least)
    # Nothing was changed so far; from here on the step is decided.
    state["insists"] += len(insisted)
    for c in cut:
        dropped[c["key"]] = 1
        if c["own"]:
            state["dropped_ranges"].setdefault(c["own"]["file"], []).append([c["own"]["lo"], c["own"]["hi"]])
    gone = {c["cmd"] for c in cut if c["direct"] and c["cmd"]}
    cmds.update(dict.fromkeys(gone, 1))
    for c in chunks:
        for r in c["reads"]:
            state["served_at"].setdefault(r["file"], []).append([step, c["key"], r["lo"], r["hi"]])
        if c["held"] or c["key"] in dropped:
            continue
        if c["own"]:
            state["served_ranges"].setdefault(c["own"]["file"], []).append([c["own"]["lo"], c["own"]["hi"]])
        if c["direct"] and c["cmd"] and c["cmd"] not in gone:
            cmds.pop(c["cmd"], None)
    return [c["gi"] for c in chunks if not c["held"] and c["key"] in dropped], insisted


def _registry(state: dict) -> str:
    """All registries, sorted."""
    return json.dumps({"dropped": sorted(state["dropped"]), "cmds": sorted(state["cmds"]), "dropped_ranges": state["dropped_ranges"], "served_ranges": state["served_ranges"], "insists": state["insists"]}, sort_keys=True)


def fold_step(taus: dict[str, int] | None = None, least: int = MIN_RUN_TOKENS) -> Callable[[dict, dict], tuple]:
    """The step function. `taus`: thresholds by kind; a kind without one is never cut, nor a chunk whose latest earlier copy is cut.
    Without it each chunk's own `tau` holds.

    A call that was cut is served in full when the very same call comes again, and then counts as never cut. Of all other newborns
    those below the threshold are cut, if their run of neighbours is long enough.
    """

    def step(state: dict, row: dict) -> tuple:
        for name in ("dropped", "cmds", "dropped_ranges", "served_ranges", "served_at"):
            state.setdefault(name, {})
        for name in ("insists", "fails"):
            state.setdefault(name, 0)
        waiting = state.setdefault("waiting", [])
        waiting.append([int(row["step"]), row["chunks"]])
        decided: list[int] = []
        cut: list[int] = []
        insisted: list[int] = []
        if row["failed"]:
            state["fails"] += 1
        else:
            for at, chunks in waiting:
                chunks = json.loads(chunks)
                gone, again = _birth(state, at, chunks, taus, least)
                decided += [c["gi"] for c in chunks]
                cut += gone
                insisted += again
            waiting.clear()
        return row["conv"], row["step"], decided, cut, insisted, state["insists"], state["fails"], _registry(state) if row["snapshot"] else None

    return step


def births(chunked: DataFrame, failed=None) -> DataFrame:
    """The rows of the fold from chunks (conv, gi, step, owner, kind, text, tokens, score, tau, cmd, direct, own, reads, held)."""
    key = chunk_key(F.col("owner"), F.col("kind"), F.col("text")).alias("key")
    c = F.struct("gi", "owner", key, "kind", "tokens", "score", "tau", F.coalesce("cmd", F.lit("")).alias("cmd"), "direct", "own", F.coalesce("reads", F.array()).alias("reads"), "held")
    d = chunked.groupBy("conv", "step").agg(F.array_sort(F.collect_list(c)).alias("c"))
    d = d.withColumn("last", F.max("step").over(Window.partitionBy("conv")))
    return d.select("conv", "step", F.to_json("c", {"ignoreNullFields": "false"}).alias("chunks"), (F.lit(False) if failed is None else failed).alias("failed"), (F.col("step") == F.col("last")).alias("snapshot"))


def pool_tau(texts):
    """A threshold on the grid that depends on a pool's texts alone, for tests and queries without a model: leading 64 bits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit("qhat:"), F.array_join(texts, "\x00")), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % GRID).cast("long")


def conversation_chunks(messages: DataFrame) -> DataFrame:
    """Chunks of plain conversations before the current turn, as the fold takes them. An observation's call is the first word of the
    assistant turn before it, and its lines count as lines of a file of that name."""
    d = trace.scored(messages).filter(F.col("step") < F.coalesce(F.col("tail_lo"), F.lit(0)))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = F.when(F.col("role") == "assistant", F.struct(F.substring_index(F.trim("text"), " ", 1).alias("cmd")))
    m = messages.select("conv_id", "turn", F.last(said, ignorenulls=True).over(before)["cmd"].alias("cmd"), (F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")) == "assistant").alias("fresh"))
    pool = F.transform(F.array_sort(F.collect_list(F.struct("gi", "text")).over(Window.partitionBy("conv_id", "turn"))), lambda x: x["text"])
    d = d.withColumn("tau", pool_tau(pool)).join(m, ["conv_id", "turn"])
    obs = F.col("kind") != "asst"
    lo = F.col("win") * trace.WINDOW_LINES + 1
    own = F.when(obs & (F.coalesce("cmd", F.lit("")) != ""), F.struct(F.col("cmd").alias("file"), lo.alias("lo"), (lo + trace.WINDOW_LINES - 1).alias("hi")))
    return d.select(
        F.col("conv_id").alias("conv"), "gi", "step", F.col("turn").alias("owner"), "kind", "text", "tokens", F.col("score_q").alias("score"), "tau", F.when(obs, F.col("cmd")).alias("cmd"),
        (obs & F.coalesce("fresh", F.lit(False))).alias("direct"), own.alias("own"), F.when(own.isNotNull(), F.array(own)).alias("reads"), F.lit(False).alias("held"),
    )


def decisions(folded: DataFrame) -> DataFrame:
    """(conv, gi, cut, insisted) of every decided chunk."""
    d = folded.select("conv", F.explode("decided").alias("gi"), "cut", "insisted")
    return d.select("conv", "gi", F.array_contains("cut", F.col("gi")).alias("cut"), F.array_contains("insisted", F.col("gi")).alias("insisted"))


def live_sets(chunked: DataFrame, decided: DataFrame) -> DataFrame:
    """(conv, step, live, undecided, insisted, cut): at each step, the chunks born so far that no earlier step cut, and what becomes of the newborns."""
    d = chunked.join(decided, ["conv", "gi"]).groupBy("conv", "step").agg(
        F.count("*").alias("born"), F.count_if("insisted").alias("insisted"), F.count_if("cut").alias("cut")
    )
    w = Window.partitionBy("conv").orderBy("step")
    gone = F.coalesce(F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.select("conv", "step", (F.sum("born").over(w) - gone).alias("live"), (F.col("born") - F.col("insisted")).alias("undecided"), "insisted", "cut")
