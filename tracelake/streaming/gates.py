"""Step functions of the re-read gate and the override valve, and a windowed ledger stream.

The gate's rows are those of `operators.reads.gate_rows`: one for each call, with what it would read and edit.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A read is let pass if it would save fewer tokens than the denial costs.
LEAST_TOKENS = 150
#: Completed runs of a command without an edit between, after which it is refused.
LOOP = 3
GATE = "session long, seq long, tool string, allowed boolean, reason string, path string, tokens long, blocked_rereads long, tokens_saved long, loops_broken long"
VALVE = "conv long, step long, owner long, insisted boolean"


def _refund(state: dict, path: str) -> bool:
    """Takes a file's grant; what its denial was booked as saving is given back."""
    if path not in state["grants"]:
        return False
    tokens = state["grants"].pop(path)
    if tokens:
        state["saved"] = max(0, state["saved"] - tokens)
        state["blocked"] = max(0, state["blocked"] - 1)
    return True


def _known(state: dict, t: dict) -> bool:
    """Whether a read would bring back what is in context: some of its lines were read, the file is the same, nothing of it is elided."""
    record = state["reads"].get(t["path"])
    if not record:
        return False
    if t["identity"] < 0 or t["identity"] != record["identity"]:
        del state["reads"][t["path"]]
        state["counts"].clear()
        return False
    met = any(lo <= t["hi"] and t["lo"] <= hi for lo, hi, _ in record["ranges"])
    return met and not t["elided"] and t["tokens"] >= LEAST_TOKENS


def _judged(state: dict, row: dict, targets: list[dict]) -> tuple[str, dict | None]:
    if row["tool"] == "bash" and row["norm"] and not row["override"] and state["counts"].get(row["norm"], 0) >= LOOP:
        turn = state["loops"][row["norm"]] = state["loops"].get(row["norm"], 0) + 1
        if turn % 2:
            state["broken"] += 1
            return "loop", None
    known = [t for t in targets if _known(state, t)] if row["tool"] != "edit" else []
    if known and not all(t["path"] in state["grants"] for t in known):
        first = known[0]
        state["blocked"] += 1
        state["saved"] += first["tokens"]
        state["grants"][first["path"]] = first["tokens"]
        for t in known[1:]:
            state["grants"].setdefault(t["path"], 0)
        return "read before", first
    for t in known:
        _refund(state, t["path"])
    return "", None


def _completed(state: dict, row: dict, targets: list[dict]) -> None:
    reads, counts = state["reads"], state["counts"]
    if row["tool"] == "bash" and row["norm"] and not row["override"]:
        counts[row["norm"]] = counts.get(row["norm"], 0) + 1
    for t in targets if row["tool"] != "edit" else []:
        _refund(state, t["path"])
        record = reads.setdefault(t["path"], {"identity": t["identity"], "ranges": []})
        if record["identity"] != t["identity"]:
            record |= {"identity": t["identity"], "ranges": []}
        own = [t["lo"], t["hi"], t["tail"]]
        if own not in record["ranges"]:
            record["ranges"].append(own)
    edits = json.loads(row["edits"])
    if row["mutates"]:
        reads.clear()
        counts.clear()
    elif row["tool"] == "edit":
        for path in edits:
            reads.pop(path, None)
        counts.clear()
    elif edits:
        for path in [p for p in reads if p.rsplit("/", 1)[-1].lower() in edits]:
            del reads[path]
        counts.clear()


def gate_step(state: dict, row: dict) -> tuple:
    """Judges a call, and if it is let pass records what it does.

    A command that has completed `LOOP` times since the last edit is refused and let pass in turn; a refused run does not count, a
    repeat that the curator asked for neither. Then all files that the call reads are judged together: if some are known and not all of
    those hold a grant, the call is refused, the first is booked, and all get a grant, so that the same call passes next time. The next
    read of a file takes its grant, whatever the call, and gives back what was booked. A changed file, an edit and a command that may
    change any file forget what was read, and every run.
    """
    for name in ("reads", "counts", "loops", "grants"):
        state.setdefault(name, {})
    for name in ("blocked", "saved", "broken"):
        state.setdefault(name, 0)
    targets = json.loads(row["targets"])
    reason, first = _judged(state, row, targets)
    if not reason:
        _completed(state, row, targets)
    shown = (first["path"], first["tokens"]) if first else (None, 0)
    return row["session"], row["seq"], row["tool"], not reason, reason, *shown, state["blocked"], state["saved"], state["broken"]


def valve_step(state: dict, row: dict) -> tuple:
    """Rows (conv, seq, step, owner, cmd, would), one for each observation: a call that was cut before is served in full once."""
    cmd = row["cmd"]
    insisted = state.get(cmd, False)
    state[cmd] = bool(row["would"]) and not insisted
    return row["conv"], row["step"], row["owner"], insisted


def hourly_ledger(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Sums of (ts, cf, billed) by hour of event time, for a table or a stream; rows later than `delay` are dropped by a stream alone."""
    return rows.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("cf").alias("cf"), F.sum("billed").alias("billed")).select(F.col("w.start").alias("hour"), "n", "cf", "billed")
