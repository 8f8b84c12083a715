"""Operators on the order of turns within a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repeats(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Adds ``seen_before``: whether the session has the same role and text earlier."""
    w = Window.partitionBy(conv, role, text).orderBy(order)
    return turns.withColumn("seen_before", F.row_number().over(w) > 1)


def loops(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Adds ``loop``: the last two turns repeat the two before them, role and text."""
    w = Window.partitionBy(conv).orderBy(order)
    own = F.struct(F.col(role), F.col(text))
    same = own.eqNullSafe(F.lag(own, 2).over(w)) & F.lag(own, 1).over(w).eqNullSafe(F.lag(own, 3).over(w)) & F.lag(F.lit(True), 3).over(w).isNotNull()
    return turns.withColumn("loop", same)


def first_end(turns: DataFrame, conv: str = "conv_id", order: str = "turn", text: str = "text", hard_stop: int = 33) -> DataFrame:
    """Turns up to the first with an end marker, or up to ``hard_stop``."""
    end = F.min(F.when(F.contains(F.col(text), F.lit("[/END]")), F.col(order))).over(Window.partitionBy(conv))
    return turns.withColumn("_end", F.least(F.coalesce(end, F.lit(hard_stop)), F.lit(hard_stop))).where(F.col(order) <= F.col("_end")).drop("_end")


def session_lengths(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Turns per session."""
    return turns.groupBy(conv).agg(F.count(F.lit(1)).alias("n_turns"))
