"""Multi-label benchmark: gold labels, predictions, confusion counts and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import labels as L
from colloquy.functions.text import normalise
from colloquy.session import fixed


def gold_labels(items: DataFrame, dimension: DataFrame, key: str = "idx", gold: str = "gold") -> DataFrame:
    """``key``, ``task_id``, ``label_en``: canonical labels of each item, once each; unknown ones vanish.

    ``dimension`` holds the labels of all languages (task_id, label_en, label); its English names count as aliases too.
    """
    names = dimension.select("task_id", "label_en", F.col("label").alias("alias")).unionByName(dimension.select("task_id", "label_en", F.col("label_en").alias("alias")))
    names = names.select("task_id", "label_en", normalise(F.col("alias")).alias("alias")).dropDuplicates(["task_id", "alias"])
    raw = items.select(key, "task_id", F.explode(gold).alias("g")).select(key, "task_id", normalise(F.col("g")).alias("alias"))
    return raw.join(fixed(names), ["task_id", "alias"]).select(key, "task_id", "label_en").distinct()


def truth_table(predictions: DataFrame, items: DataFrame, dimension: DataFrame, key: str = "idx", run: list[str] | None = None) -> DataFrame:
    """A row for each prediction and each label of its task with ``y_true`` and ``y_pred``.

    The label dimension drives, so labels never seen count. Predictions are numbered by their ``run`` columns.
    """
    run = run or []
    canonical = dimension.select("task_id", "label_en", "letter").distinct()
    tasks = items.select(key, "task_id").dropDuplicates([key])
    wide = predictions.join(tasks, key).join(fixed(canonical), "task_id")
    gold = gold_labels(items, dimension, key).select(key, "label_en", F.lit(1).alias("t"))
    marked = wide.join(gold, [key, "label_en"], "left")
    hit = F.coalesce(F.array_contains("pred_letters", F.col("letter")), F.lit(False)).cast("int")
    return marked.select(key, "task_id", *run, "label_en", F.coalesce("t", F.lit(0)).alias("y_true"), hit.alias("y_pred"))


def scores(table: DataFrame, by: list[str]) -> DataFrame:
    """Macro F1, support-weighted F1 and macro recall over all labels, each 0 on a zero denominator."""
    per = table.groupBy(*by, "label_en").agg(
        F.sum(F.col("y_true") * F.col("y_pred")).alias("tp"), F.sum((1 - F.col("y_true")) * F.col("y_pred")).alias("fp"), F.sum(F.col("y_true") * (1 - F.col("y_pred"))).alias("fn")
    )
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    support = F.col("tp") + F.col("fn")
    weighted = F.coalesce(F.sum(f1 * support) / F.nullif(F.sum(support), F.lit(0)), F.lit(0.0))
    return per.groupBy(*by).agg(F.avg(f1).alias("macro_f1"), weighted.alias("weighted_f1"), F.avg(recall).alias("macro_recall"))


def format_and_cost(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Answers in the asked format, their ratio, and mean tokens and seconds, 0 where there are none."""
    return predictions.groupBy(*by).agg(
        F.count_if("follow_format").alias("n_format"),
        F.coalesce(F.avg(F.col("follow_format").cast("int")), F.lit(0.0)).alias("format_ratio"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in ("prompt_tokens", "generated_tokens", "elapsed_sec")],
    )


def reparsed(predictions: DataFrame, items: DataFrame, dimension: DataFrame, key: str = "idx", text: str = "raw_output") -> DataFrame:
    """Letters read anew from the raw answers, with the labels they stand for."""
    allowed = dimension.select("task_id", "letter").distinct().groupBy("task_id").agg(F.array_sort(F.collect_set("letter")).alias("allowed"))
    joined = predictions.join(items.select(key, "task_id").dropDuplicates([key]), key).join(fixed(allowed), "task_id")
    found = F.coalesce(L.letters(F.col(text), F.col("allowed")), F.array().cast("array<string>"))
    return joined.withColumn("letters", found).withColumn("in_format", F.size("letters") > 0)
