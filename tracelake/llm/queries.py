"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, html_text, langid, lines, lm, neardup, quality, repeats, runs, shards, sql, trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": langid.op1_langid,
        "op2_html": html_text.op2_html,
        "op3_neardup": neardup.op3_neardup,
        "op4_repeats": repeats.op4_repeats,
        "op5_lm": lm.op5_lm,
        "op6_chat_format": chat.op6_chat_format,
        "op7_line_dedup": lines.op7_line_dedup,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_quality": quality.op9_quality,
        "op10_bpe": bpe.op10_bpe,
        "op11_shards": shards.op11_shards,
        "op12_trie": trie.op12_trie,
        "op13_runs": runs.op13_runs,
    }


def oracle_sql() -> dict[str, str]:
    """Language models, radix passes, byte merges, page structure and hashed ratios are beyond SQL; tests hold those against brute force."""
    return {"op3_neardup": sql.NEAR_DUPLICATES, "op6_chat_format": sql.CHAT_FORMAT, "op7_line_dedup": sql.LINE_DEDUP, "op8_decontaminate": sql.DECONTAMINATE, "op12_trie": sql.PREFIX_TRIE}
