"""Plug-in surface for models: text generators, generators with metadata, pair scorers; with deterministic stand-ins.

A plug-in is a function of lists, called once per Arrow batch. Task retries may call it again, so results should be
kept by a hash of the prompt where calls cost.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import dialogue as D
from colloquy.schemas import GENERATED


def generator(run: Callable[[list[str]], list[str]]):
    """Column function from prompts to texts."""

    @F.pandas_udf("string")
    def batched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(run(s.tolist()), dtype="object")

    return batched


def generator_with_metadata(run: Callable[[list[str]], list[dict]]):
    """Column function from prompts to ``{text, prompt_tokens, generated_tokens, elapsed_sec}``."""

    @F.pandas_udf(GENERATED)
    def batched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame(run(s.tolist()), columns=GENERATED.names)

    return batched


def pair_scorer(run: Callable[[list[str], list[str]], list[float]]):
    """Column function from source and translation to a score."""

    @F.pandas_udf("double")
    def batched(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(run(a.tolist(), b.tolist()), dtype="float64")

    return batched


def counter(run: Callable[[list[str]], list[int]]):
    """Column function from texts to token counts."""

    @F.pandas_udf("int")
    def batched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(run(s.tolist()), dtype="Int32")

    return batched


def with_retries(call: Callable[[str], str], tries: int = 3, pause: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[dict]]:
    """A plug-in of lists from a call per prompt (S10, F32): up to ``tries`` attempts, with 2, 4, 8 ... seconds between
    them and ``pause`` after each prompt. Results are ``{text, error}``; the error of the last attempt is cut at 200
    characters. Null prompts are not sent."""

    def one(prompt: str | None) -> dict:
        if prompt is None:
            return {"text": None, "error": None}
        for attempt in range(tries):
            try:
                return {"text": call(prompt), "error": None}
            except Exception as e:  # noqa: BLE001 - whatever the endpoint raises is reported
                if attempt == tries - 1:
                    return {"text": None, "error": str(e)[:200]}
                sleep(2.0 ** (attempt + 1))
        return {"text": None, "error": "no attempt"}

    def run(prompts: list[str]) -> list[dict]:
        out = []
        for p in prompts:
            out.append(one(p))
            if pause:
                sleep(pause)
        return out

    return run


def endpoint(run: Callable[[list[str]], list[dict]]):
    """Column function from prompts to ``{text, error}``."""

    @F.pandas_udf("text string, error string")
    def batched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame(run(s.tolist()), columns=["text", "error"])

    return batched


def generated_once(df: DataFrame, prompt: str, generate, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds ``generated``: every distinct prompt is sent once, however many rows have it.

    ``keep`` materialises the answers (such as ``lambda d: session.materialise(d, "answers")``), so later stages and
    retries read them instead of calling the model again. Null prompts get no call and null.
    """
    asked = df.select(F.col(prompt).alias("_p")).where("_p is not null").distinct()
    answers = keep(asked.select(F.md5("_p").alias("_key"), generate(F.col("_p")).alias("generated")))
    return df.withColumn("_key", F.md5(prompt)).join(answers, "_key", "left").drop("_key")


def stub_texts(prompts: list[str]) -> list[str]:
    """A generator for tests: a short answer that depends on the prompt only."""
    return ["" if p is None else "Client: " + hashlib.md5(p.encode()).hexdigest()[:8] for p in prompts]


def stub_scores(src: list[str], mt: list[str]) -> list[float]:
    """A scorer for tests: share of equal lengths."""
    return [0.0 if not a or not b else min(len(a), len(b)) / max(len(a), len(b)) for a, b in zip(src, mt)]


def next_turns(sessions: DataFrame, template: Column, generate, role: str, turn: str = "turn", style: str = "style") -> DataFrame:
    """One more turn of every open session at once: prompt from the history, one batched call, cleaning.

    ``sessions`` has ``history`` (array of texts), ``turn`` and ``style``; the new turn is appended. From turn 22 on the
    prompt's ``{ending}`` says how many turns are left; therapist turns before turn 15 keep no end marker. Sessions run
    side by side in lock step; callers cut lineage every few rounds with ``session.materialise``, generate again where
    ``dialogue.needs_another`` says so, and end sessions with ``sessions.first_end``.
    """
    prompt = D.filled(template, history=D.history_text(F.col("history")), turns=F.col(turn).cast("string"), ending=D.wind_down(F.col(turn)))
    said = D.cleaned(generate(prompt), role, F.col(turn), F.col(style))
    if role == "therapist":
        said = D.late_end(said, F.col(turn))
    return sessions.withColumn("_said", said).withColumn("history", F.concat("history", F.array("_said"))).drop("_said")
