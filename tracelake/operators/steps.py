"""Assistant turns paired with what answers them. Messages are (conv, pos, part, role, text, reasoning, commands), in order of pos and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def _order():
    return Window.partitionBy("conv").orderBy("pos", "part")


def _spoken(messages: DataFrame) -> DataFrame:
    """Assistants and observations (users and tools); other roles are no part of a step."""
    d = messages.filter(F.col("role").isin("assistant", "user", "tool"))
    return d.withColumns({"obs": F.col("role") != "assistant", "cmd": F.when(F.col("role") == "assistant", F.array_join(F.coalesce("commands", F.array()), " ; "))})


def paired(messages: DataFrame) -> DataFrame:
    """(conv, step, cmd, obs, said, reasoning): each observation right after an assistant, with what that assistant called and said.

    Of assistants in a row the last counts, of observations in a row the first; nulls count as empty. Steps are numbered from 0.
    """
    before = lambda c: F.coalesce(F.lag(c).over(_order()), F.lit(""))
    d = _spoken(messages).withColumns({"answers": F.lag("obs").over(_order()), "_cmd": before("cmd"), "_said": before("text"), "_reasoning": before("reasoning")})
    d = d.filter("obs AND NOT answers")
    step = F.row_number().over(_order()).cast("long") - 1
    return d.select("conv", step.alias("step"), F.col("_cmd").alias("cmd"), F.coalesce("text", F.lit("")).alias("obs"), F.col("_said").alias("said"), F.col("_reasoning").alias("reasoning"))


def observed(messages: DataFrame) -> DataFrame:
    """(conv, step, cmd, obs) of every observation: the call of the last assistant before it, which later observations inherit; the first
    observation of all is the task, step 0, and counts as empty."""
    d = _spoken(messages).withColumn("last", F.last("cmd", ignorenulls=True).over(_order())).filter("obs")
    d = d.withColumn("step", F.row_number().over(_order()).cast("long") - 1)
    own = lambda c: F.when(F.col("step") > 0, F.coalesce(c, F.lit(""))).otherwise("")
    return d.select("conv", "step", own("last").alias("cmd"), own("text").alias("obs"))
