"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import conversation_scores
from ..operators import commands, documents, graph, ledger, ranges, reads, sessions, trace, vectors
from ..streaming import gates, keyed
from . import adjudicate as adjudicate_plans
from . import content as content_plans
from . import decisions as decision_plans
from . import fields as field_plans
from . import folds as fold_plans
from . import needed as needed_plans
from . import reads as read_plans
from . import serving as serving_plans
from . import shell as shell_plans
from . import sources as source_plans
from . import wire as wire_plans
from .sql import SQL

#: What each query reads, how the table is prepared, and the operator.
_QUERIES = {
    "cut_summary": ("conversations", None, trace.cut_summary),
    "trace_steps": ("conversations", None, lambda d: trace.steps(d).select("conv_id", "turn", "step", "is_task", "tail_lo")),
    "chunk_other": ("conversations", None, lambda d: trace.chunks(d).select("conv_id", "gi", "turn", "step", "kind", "win", "tokens", F.sha2("text", 256).alias("sha"))),
    "chunk_checksum": ("conversations", trace.chunks, trace.checksum),
    "stub_score": ("conversations", None, conversation_scores),
    "budget_cut": ("conversations", None, lambda d: trace.threshold_cut(d, 700_000).select("conv_id", "gi", "score_q", "tokens", "run_tokens")),
    "internal_mass": ("conversations", None, trace.mass),
    "struct_features": ("conversations", trace.chunks, trace.struct_features),
    "struct_causal": ("conversations", trace.chunks, trace.causal_features),
    "budget_cum_tok": ("conversations", None, trace.budget),
    "cut_by_role": ("conversations", None, trace.role_cuts),
    "prefix_len": ("conversations", None, trace.prefix_lengths),
    "dup_range": ("lineitem", ranges.derived_ranges, ranges.range_duplicates),
    "supersession_edges": ("lineitem", ranges.derived_ranges, lambda d: ranges.supersession(d).groupBy("conv").agg(F.count("*").alias("edges"), F.sum("src").alias("src"), F.sum("dst").alias("dst"))),
    "rereq_base": ("lineitem", None, ranges.rerequest_base),
    "rereq_events": ("lineitem", None, ranges.rerequest_events),
    "merge_ranges": ("lineitem", ranges.derived_ranges, ranges.merge_ranges),
    "neighbour_chains": ("lineitem", ranges.derived_ranges, ranges.chains),
    "tool_prune": ("lineitem", ranges.derived_ranges, ranges.prune),
    "ledger_totals": ("events", ledger.derived_ledger, ledger.totals),
    "ledger_by_model": ("events", ledger.derived_ledger, ledger.by_model),
    "ledger_by_tool": ("events", ledger.derived_ledger, ledger.by_tool),
    "session_saved": ("events", ledger.derived_ledger, ledger.by_session),
    "savings_report": ("events", ledger.derived_ledger, ledger.report),
    "billed_so_far": ("events", ledger.derived_ledger, ledger.billed_so_far),
    "inspector_ring": ("events", ledger.derived_ledger, ledger.latest_per_session),
    "evict_ttl": ("events", ledger.derived_ledger, ledger.evict),
    "loop_feats": ("events", commands.derived_commands, commands.loop_shares),
    "loop_breaker": ("events", commands.derived_commands, commands.loop_breaker),
    "governor_latch": ("events", commands.derived_commands, commands.latches),
    "neighbors_topk": ("embeddings", None, lambda d: vectors.nearest_of_all(d).select("query", "rank", "neighbour", "score")),
    "cost_median": ("embeddings", None, vectors.cost_median),
    "splitlines": ("documents", None, documents.line_counts),
    "window_rare": ("documents", None, documents.rare_tokens),
    "dup_exact": ("documents", None, documents.exact_copies),
    "message_diff": ("conversations", None, sessions.message_diff),
    "last_views": ("conversations", None, sessions.last_views),
    "step_nodes": ("conversations", trace.chunks, sessions.step_nodes),
    "step_edges": ("conversations", trace.chunks, sessions.step_edges),
    "edited_files": ("lineitem", ranges.derived_ranges, sessions.edited_files),
    "file_hubs": ("lineitem", ranges.derived_ranges, sessions.file_hubs),
    "first_seen": ("events", commands.derived_commands, sessions.first_seen),
    "stop_blocks": ("events", commands.derived_commands, sessions.stop_blocks),
    "reads_by_epoch": ("events", commands.derived_commands, sessions.reads_by_epoch),
    "held_high": ("events", None, sessions.held_high),
    "keep_sets": ("events", None, sessions.keep_sets),
    "value_stats": ("events", None, sessions.value_stats),
    "url_paths": ("pages", None, documents.path_depths),
    "hourly_ledger": ("events", ledger.derived_ledger, gates.hourly_ledger),
}
#: Folds without SQL; tests hold them against brute force, and streams against tables.
_FOLDS = {
    "reread_gate": ("lineitem", None, lambda d: keyed.over_table(reads.gate_rows(*reads.derived_session(d)), "session", "seq", gates.gate_step, gates.GATE)),
    "pagerank": ("lineitem", graph.derived_edges, graph.pagerank),
}

_QUERIES |= shell_plans.QUERIES | decision_plans.QUERIES | source_plans.QUERIES | field_plans.QUERIES | serving_plans.QUERIES | needed_plans.QUERIES | wire_plans.QUERIES | content_plans.QUERIES | read_plans.QUERIES | fold_plans.QUERIES | adjudicate_plans.QUERIES


def _tau_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars")
    y = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return d.join(y, "doc_id").select(F.col("lang").alias("kind"), F.col("doc_id").alias("id"), (F.col("doc_id") * 7919 % 1_000_000).alias("score"), F.col("quality").alias("needed"), F.floor(F.col("n_chars") / 4).cast("long").alias("tokens"))


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    table, prepare, operator = (_QUERIES | _FOLDS)[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return operator(prepare(d) if prepare else d)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _query(name) for name in _QUERIES | _FOLDS}
    out["tau_quantile"] = lambda spark, sf_dir: ledger.tau_for_coverage(_tau_rows(spark, sf_dir), 0.9)
    out["tau_report"] = lambda spark, sf_dir: ledger.tau_report(_tau_rows(spark, sf_dir), 500_000)
    return out


def oracle_sql() -> dict[str, str]:
    return SQL | shell_plans.SQL | decision_plans.SQL | source_plans.SQL | field_plans.SQL | serving_plans.SQL | needed_plans.SQL | wire_plans.SQL | content_plans.SQL | read_plans.SQL | fold_plans.SQL | adjudicate_plans.SQL
