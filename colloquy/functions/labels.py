"""Column functions on labels, letters and choices of the multi-label benchmark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import squeeze

# Introductions of an answer that are dropped.
ANSWER_WORDS = ("answer:", "réponse:", "antwort:")


def as_list(text: Column) -> Column:
    """A text as list: split at commas, trimmed, without blanks; null and blank give an empty list."""
    parts = F.filter(F.transform(F.split(text, ","), squeeze), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def first_filled(*columns: Column) -> Column:
    """The first list that is neither null nor empty, else an empty one."""
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in columns], F.array().cast("array<string>"))


def letters(text: Column, allowed: Column) -> Column:
    """Allowed letters of an answer in order of first appearance."""
    low = F.lower(text)
    for mark in ("\n", ";", "，"):
        low = F.replace(low, F.lit(mark), F.lit(","))
    for word in ANSWER_WORDS:
        low = F.replace(low, F.lit(word), F.lit(""))
    return F.array_distinct(F.filter(F.split(low, r"[,\s]+"), lambda x: F.array_contains(allowed, x)))


def choices(letter: Column, label: Column) -> Column:
    """``letter: label`` lines of two parallel arrays."""
    return F.array_join(F.transform(F.arrays_zip(letter.alias("a"), label.alias("b")), lambda x: F.concat(x["a"], F.lit(": "), x["b"])), "\n")
