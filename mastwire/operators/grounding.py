"""Batch audit of assistant conversations: numbers stated without a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mastwire.functions.text import numbers_claimed, numbers_in


def ungrounded_numbers(turns: DataFrame) -> DataFrame:
    """One row per assistant turn and number that no other turn said before it.

    Numbers become rows, so a long conversation is joined on (conversation, number) instead
    of being gathered: each number needs only the first non-assistant turn that said it.
    """
    said = turns.where(F.col("role") != "assistant").select(
        "conv_id", "turn", F.explode(numbers_in(F.col("text"))).alias("number")
    )
    first = said.groupBy("conv_id", "number").agg(F.min("turn").alias("first_said"))
    claims = turns.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.explode(numbers_claimed(F.col("text"))).alias("number")
    )
    joined = claims.join(first, ["conv_id", "number"], "left")
    return joined.where(F.col("first_said").isNull() | (F.col("first_said") > F.col("turn"))).select(
        "conv_id", "turn", "number"
    )
