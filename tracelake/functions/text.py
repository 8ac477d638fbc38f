"""Column functions over text: line splitting, fingerprints, deterministic scores, distinctive tokens, line and path classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Size of the integer grid on which scores and thresholds are compared.
GRID = 1_000_000
#: Python's white space, as a class without brackets.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The characters that end a line.
LINE_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def one_of(n: Column, cases: list[Column]) -> Column:
    """The case of number `n`, from 0 on, null beyond them; only that one is computed, where an array would hold them all."""
    return reduce(lambda out, i: out.when(n == i, cases[i]), range(1, len(cases)), F.when(n == 0, cases[0]))


def splitlines(text: Column) -> Column:
    """Lines without their ends; no empty last line."""
    parts = F.split(text, LINE_BREAKS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def floor_tokens(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def fingerprint(text: Column) -> Column:
    """The first 120 characters with white space collapsed."""
    return F.substring(collapse_space(text), 1, 120)


def chunk_key(owner: Column, kind: Column, text: Column) -> Column:
    return F.concat_ws(":", owner.cast("string"), kind, F.substring(text, 1, 60), F.substring(F.sha2(text, 256), 1, 16))


def stub_score(step: Column, kind: Column, text: Column) -> Column:
    """A score on the grid that depends on content only: leading 64 bits of a SHA-256."""
    digest = F.sha2(F.concat(step.cast("string"), F.lit(":"), kind, F.lit(":"), text), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % GRID).cast("long")


def salted_id(salt: Column, value: Column) -> Column:
    return F.substring(F.sha2(F.concat(salt, value), 256), 1, 16)


def distinctive_tokens(text: Column, min_chars: int) -> Column:
    """The set of lower-cased words of letters, digits and underscores with at least `min_chars` characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), 1), lambda w: F.length(w) >= min_chars))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def human_tokens(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1e6), F.lit("M"))).when(n >= 1000, F.concat(F.format_string("%.1f", n / 1e3), F.lit("k"))).otherwise(n.cast("string"))


def url_path_segments(url: Column) -> Column:
    path = F.regexp_extract(url, "^[a-z]+://[^/]+(/[^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def conversation_scores(messages):
    """Each message's deterministic score, with its turn as step and its role as kind."""
    return messages.select("conv_id", "turn", stub_score(F.col("turn"), F.col("role"), F.col("text")).alias("score_q"))
