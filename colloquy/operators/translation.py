"""Operators on source texts and their translations: pairing, line zips, chunks, macro means."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_POSITIONS = 512


def paired(src: DataFrame, mt: DataFrame, key: str = "basename", text: str = "text") -> DataFrame:
    """Texts of both corpora with the same name and neither side empty."""
    return src.withColumnRenamed(text, "src").where("src <> ''").join(mt.withColumnRenamed(text, "mt").where("mt <> ''"), key)


def untranslated(src: DataFrame, mt: DataFrame, key: str = "basename") -> DataFrame:
    """Source texts without a translation."""
    return src.join(mt.select(key), key, "left_anti")


def zipped_lines(pairs: DataFrame, key: str, src: str = "src", mt: str = "mt") -> DataFrame:
    """``key``, ``line_no`` from 0, ``src``, ``mt``: lines side by side, the shorter side filled with empty lines.

    Both sides are columns of a row, so the outer join by position is an array zip without a shuffle. A null side has
    no lines.
    """
    left, right = (F.coalesce(F.split(c, r"\r?\n"), F.array().cast("array<string>")) for c in (src, mt))
    lines = F.arrays_zip(left.alias("src"), right.alias("mt"))
    out = pairs.select(key, F.posexplode(lines).alias("line_no", "z"))
    return out.select(key, "line_no", F.coalesce("z.src", F.lit("")).alias("src"), F.coalesce("z.mt", F.lit("")).alias("mt"))


def words_of_pair(src: str, mt: str) -> int:
    """Default size of a pair: white-space separated words of both sides."""
    return len(src.split()) + len(mt.split())


def chunks_of(src: str | None, mt: str | None, budget: int, size: Callable[[str, str], int] = words_of_pair) -> list[tuple[str, str]]:
    """Line pairs packed in order while they fit ``budget``; one that does not fit closes the open chunk and forms a
    chunk of its own (W5). Blank lines fall away, as each step trims what it holds."""
    left, right = (src or "").splitlines(), (mt or "").splitlines()
    count = max(len(left), len(right))
    left += [""] * (count - len(left))
    right += [""] * (count - len(right))
    out: list[tuple[str, str]] = []
    a = b = ""
    for x, y in zip(left, right):
        wide_a, wide_b = f"{a}\n{x}".strip() if a else x.strip(), f"{b}\n{y}".strip() if b else y.strip()
        if size(wide_a, wide_b) <= budget:
            a, b = wide_a, wide_b
            continue
        if a or b:
            out.append((a, b))
        out.append((x.strip(), y.strip()))
        a = b = ""
    if a or b:
        out.append((a, b))
    return out


def chunks(pairs: DataFrame, key: str, src: str = "src", mt: str = "mt", max_positions: int = MAX_POSITIONS, budget: int | None = None, size: Callable[[str, str], int] = words_of_pair) -> DataFrame:
    """``key``, ``chunk_no`` from 0, ``src``, ``mt`` of every row (W5): a narrow Arrow map over whole texts."""
    limit = budget if budget is not None else max(64, max_positions - 50)
    kind = dict(pairs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, a, b) for k, s, m in zip(pdf[key], pdf["src"], pdf["mt"]) for n, (a, b) in enumerate(chunks_of(s, m, limit, size))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "src", "mt"])

    return pairs.select(key, F.col(src).alias("src"), F.col(mt).alias("mt")).mapInPandas(run, f"`{key}` {kind}, chunk_no int, src string, mt string")


def macro_mean(scored: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Mean over documents of each document's mean over its chunks (A10)."""
    return scored.groupBy(key).agg(F.avg(score).alias("_mean")).agg(F.count("_mean").alias("documents"), F.avg("_mean").alias("score"))
