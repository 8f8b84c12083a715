"""Judge replies and scores: parsing, row averages, group means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import judge as J
from colloquy.schemas import CRITERIA
from colloquy.session import small


def parsed(replies: DataFrame, text: str) -> DataFrame:
    """Adds the scores, justification and error of a reply column."""
    return replies.withColumn("_s", J.parsed_scores(F.col(text))).select("*", "_s.*").drop("_s")


def with_average(rows: DataFrame) -> DataFrame:
    """Adds ``average``: all six criteria, missing ones as 0."""
    return rows.withColumn("average", J.row_average(*[F.col(c) for c in CRITERIA]))


def group_means(rows: DataFrame, language: str = "language", dialogue: str = "dialogue_id") -> DataFrame:
    """Criterion means by language, by dialogue and overall over valid rows.

    Missing scores are skipped, a criterion without any counts 0; ``overall`` is the mean of the six; ``n`` the valid
    rows. ``level`` names the grouping; without valid rows nothing comes out.
    """
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in CRITERIA]
    valid = rows.where("error is null")
    level = F.when(F.grouping_id() == 3, "overall").when(F.grouping_id() == 1, "language").otherwise("dialogue").alias("level")
    sets = valid.groupingSets([[F.col(language)], [F.col(dialogue)], []], F.col(language), F.col(dialogue))
    out = sets.agg(level, F.count(F.lit(1)).alias("n"), *means)
    overall = sum((F.col(c) for c in CRITERIA), F.lit(0.0)) / len(CRITERIA)
    return out.withColumn("overall", overall).where("n > 0")


def manifest(dialogues: DataFrame, languages: DataFrame, language: str = "language") -> DataFrame:
    """Every dialogue in every language of a small list (J7); a narrow explode, no join."""
    values = [r[0] for r in small(languages.select(language).distinct())]
    return dialogues.withColumn(language, F.explode(F.array(*[F.lit(v) for v in values]).cast("array<string>")))
