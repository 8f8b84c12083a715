"""Corpus statistics: utterances, tokens, vocabulary, lexical diversity, Self-BLEU."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.session import fixed


def tagged_lines(lines: DataFrame, key: str = "path", line: str = "line", tags: tuple[str, ...] = ("Therapist:", "Client:")) -> DataFrame:
    """Trimmed lines with a speaker tag; of files without any, all non-blank lines (P10)."""
    trimmed = lines.withColumn(line, X.squeeze(F.col(line))).where(F.col(line) != "")
    flag = F.lit(False)
    for t in tags:
        flag = flag | F.startswith(F.col(line), F.lit(t))
    flagged = trimmed.withColumn("_t", flag)
    return flagged.withColumn("_any", F.max("_t").over(Window.partitionBy(key))).where("_t or not _any").drop("_t", "_any")


def dialogue_totals(utterances: DataFrame, by: str, key: str, text: str, counter=X.whitespace_count) -> DataFrame:
    """Dialogues, utterances, tokens and utterances per dialogue of each group (A2, A3, P11); groups of null keys stay.

    Dialogues without utterances are no rows here and so in no total.
    """
    per = utterances.groupBy(by, key).agg(F.count(F.lit(1)).alias("u"), F.sum(counter(F.col(text)).cast("long")).alias("t"))
    out = per.groupBy(by).agg(F.count(F.lit(1)).alias("dialogues"), F.sum("u").alias("utterances"), F.sum("t").alias("tokens"))
    return out.withColumn("avg_utterances", F.coalesce(F.col("utterances") / F.nullif(F.col("dialogues"), F.lit(0)), F.lit(0.0)))


def vocabulary(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Tokens, distinct tokens and their ratio, marks included (A4, U4). Counts per token first, so that a group of
    any size is summed from partial rows and no set of words meets in one task."""
    counted = df.select(*by, F.explode(X.tokens(F.col(text))).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))
    out = counted.groupBy(*by).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"))
    return out.withColumn("ttr", F.col("types") / F.col("tokens"))


def summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum over defined values."""
    c = F.col(value)
    return df.groupBy(*(by or [])).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))


def _factors(tokens: list[str], threshold: float) -> float | None:
    seen: set[str] = set()
    length, factors = 0, 0.0
    for t in tokens:
        length += 1
        seen.add(t)
        if len(seen) / length < threshold:
            factors += 1.0
            seen.clear()
            length = 0
    if length:
        factors += (1.0 - len(seen) / length) / (1.0 - threshold)
    return len(tokens) / factors if factors else None


def mtld_of(tokens, threshold: float = 0.72, least: int = 10) -> float | None:
    """Mean of both directions; undefined under ``least`` tokens or where a direction has no factor."""
    if tokens is None or len(tokens) < least:
        return None
    words = list(tokens)
    forward, backward = _factors(words, threshold), _factors(words[::-1], threshold)
    return None if forward is None or backward is None else (forward + backward) / 2


def mtld(tokens: Column, threshold: float = 0.72, least: int = 10) -> Column:
    """MTLD of a token array (X6). Tokens are numbered within a batch in Arrow; Python sees numbers only."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arrays in batches:
            numbers = arrays.flatten().dictionary_encode().indices.to_pylist()
            ends = np.cumsum(arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            yield pa.array([mtld_of(numbers[a:b], threshold, least) for a, b in zip([0, *ends], ends)], pa.float64())

    return run(tokens)


def text_totals(corpus: DataFrame, kind: str = "kind", text: str = "text", counters: dict | None = None) -> DataFrame:
    """Adds ``utterances`` and ``tokens`` of every file by its kind, 0 for kinds without a counter.

    ``counters`` maps a kind to a function from the text to an array of utterances; by default ``txt`` files are taken
    line by line.
    """
    counters = counters or {"txt": lambda t: F.filter(F.transform(F.split(t, r"\r?\n"), X.squeeze), lambda x: x != "")}
    listed = F.array().cast("array<string>")
    for name, run in counters.items():
        listed = F.when(F.lower(kind) == name, F.coalesce(run(F.col(text)), F.array().cast("array<string>"))).otherwise(listed)
    tokens = F.aggregate(F.transform("_u", X.whitespace_count), F.lit(0), lambda a, n: a + n)
    return corpus.withColumn("_u", listed).select("*", F.size("_u").cast("long").alias("utterances"), tokens.cast("long").alias("tokens")).drop("_u")


#: Grams of more documents than this are joined by broadcast (if they are few), the others by a shuffle.
HOT_DOCUMENTS = 2_000


def self_bleu(docs: DataFrame, key: str, words: str = "words", n: int = 4) -> DataFrame:
    """Self-BLEU of each document with words against all others (A8, A9, W7, W8): ``key``, ``self_bleu``.

    The largest count of an n-gram among all other documents comes from its two largest counts, so no pair of
    documents is ever formed: grams, as 64-bit codes, are counted per document, the top two counts per gram are a
    partial aggregate (which a hot gram passes with one row per partition), and joined back. Grams of very many
    documents are few and joined by broadcast, so no gram sends all its documents to one task. The closest other
    length is found on the table of distinct lengths.
    """
    base = docs.where(F.size(words) > 0).select(F.col(key), F.col(words).alias("_w"), F.size(words).alias("_len"))
    orders = F.sequence(F.lit(1), F.lit(n))
    grams = F.flatten(F.transform(orders, lambda k: F.when(F.col("_len") >= k, F.transform(F.sequence(F.lit(1), F.col("_len") - k + 1), lambda i: F.struct(k.alias("n"), F.xxhash64(F.slice("_w", i, k)).alias("g")))).otherwise(F.array().cast("array<struct<n: int, g: bigint>>"))))
    counts = base.select(key, F.explode(grams).alias("x")).groupBy(key, "x.n", "x.g").agg(F.count(F.lit(1)).alias("c"))
    # largest count, how many documents have it, and the largest count below it
    by_count = counts.groupBy("n", "g", "c").agg(F.count(F.lit(1)).alias("docs"))
    top = by_count.groupBy("n", "g").agg(F.sum("docs").alias("all"), F.max_by("docs", "c").alias("holders"), F.max("c").alias("first"), F.slice(F.sort_array(F.collect_set("c"), asc=False), 1, 2).alias("two"))
    hot = fixed(top.where(F.col("all") > HOT_DOCUMENTS).drop("all"), 100_000)
    often = counts.join(hot, ["n", "g"])
    seldom = counts.join(hot.select("n", "g"), ["n", "g"], "left_anti").join(top.where(F.col("all") <= HOT_DOCUMENTS).drop("all"), ["n", "g"])
    joined = often.unionByName(seldom)
    others = F.when((F.col("c") == F.col("first")) & (F.col("holders") == 1), F.coalesce(F.get("two", F.lit(1)), F.lit(0))).otherwise(F.col("first"))
    clipped = joined.select(key, "n", F.least("c", others).alias("clip")).groupBy(key, "n").agg(F.sum("clip").alias("clip"))
    wide = clipped.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("n") == k, F.col("clip"))), F.lit(0)).alias(f"m{k}") for k in range(1, n + 1)])
    sizes = base.groupBy("_len").agg(F.count(F.lit(1)).alias("same"))
    # one row per distinct length: bounded by the longest document, not by their number
    w = Window.partitionBy().orderBy("_len")
    near = sizes.select("_len", "same", F.lag("_len").over(w).alias("lo"), F.lead("_len").over(w).alias("hi"))
    ref = F.when(F.col("same") > 1, F.col("_len")).when(F.col("lo").isNull(), F.col("hi")).when(F.col("hi").isNull(), F.col("lo")).when(F.col("_len") - F.col("lo") <= F.col("hi") - F.col("_len"), F.col("lo")).otherwise(F.col("hi"))
    full = base.select(key, "_len").join(near.select("_len", ref.alias("ref")), "_len").join(wide, key)
    total = F.lit(0.0)
    for k in range(1, n + 1):
        size = F.greatest(F.lit(1), F.col("_len") - k + 1)
        total = total + F.log(F.when(F.col(f"m{k}") > 0, F.col(f"m{k}")).otherwise(F.lit(0.1)) / size) / n
    brevity = F.when(F.col("_len") > F.col("ref"), F.lit(1.0)).otherwise(F.exp(1 - F.col("ref") / F.col("_len")))
    score = F.when(F.col("ref").isNull(), F.lit(None)).when(F.col("m1") == 0, F.lit(0.0)).otherwise(brevity * F.exp(total))
    return full.select(key, score.alias("self_bleu"))
