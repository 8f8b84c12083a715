"""Utterances of arbitrary JSON trees."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys whose texts are utterances.
UTTERANCE_KEYS = frozenset({"text", "content", "utterance", "message", "response", "prompt"})


def utterances_of(tree) -> list[str]:
    """Texts of a tree in order: an object with non-blank texts under utterance keys gives those only, any other
    object or list the texts of all its values; numbers, flags and nulls give none (F24)."""
    out: list[str] = []
    stack = [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            if node.strip():
                out.append(node.strip())
        elif isinstance(node, list):
            stack.extend(reversed(node))
        elif isinstance(node, dict):
            direct = [v for k, v in node.items() if k.lower() in UTTERANCE_KEYS and isinstance(v, str) and v.strip()]
            stack.extend(reversed(direct or list(node.values())))
    return out


def utterances(docs: DataFrame, key: str, text: str, lines: bool = False) -> DataFrame:
    """``key``, ``no`` from 0, ``utterance`` of JSON texts (see ``utterance_lists``)."""
    return utterance_lists(docs, key, text, lines).select(key, F.posexplode("utterances").alias("no", "utterance"))


def utterance_lists(docs: DataFrame, key: str, text: str, lines: bool = False) -> DataFrame:
    """``key`` and ``utterances`` of JSON texts, or of JSON Lines texts (X7, U3). Null texts give none; an unreadable
    document gives none, an unreadable line fails the job. A narrow map."""
    kind = dict(docs.dtypes)[key]

    def trees(value: str):
        if not lines:
            try:
                return [json.loads(value)]
            except ValueError:
                return []
        return [json.loads(line) for line in value.splitlines() if line.strip()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [[] if value is None else [u for tree in trees(value) for u in utterances_of(tree)] for value in pdf["_t"]]
            yield pd.DataFrame({key: pdf[key], "utterances": found})

    return docs.select(key, F.col(text).alias("_t")).mapInPandas(run, f"`{key}` {kind}, utterances array<string>")
