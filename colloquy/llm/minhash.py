"""Verified MinHash links of short texts on five-word shingles.

The sketch of a text with ``n`` shingles is the ``n - ceil(0.8 n) + 1`` of them that come first in one order for all
texts (a bottom-k MinHash). Two texts of similarity 0.8 or more leave out at most that many less one, so their sketches
always meet and no link is lost. The order takes rare shingles first, by powers of two, and hashes within; texts that
differ in one detail of a common pattern meet in the detail only, not in the pattern.
"""

from __future__ import annotations

import uuid
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.session import shared_dir

SHINGLE = 5
SIMILARITY = 0.8


def word_codes(words: list[str], memo: dict[str, int]) -> list[int]:
    """Codes of words above 0, with a memo."""
    out = list(map(memo.get, words))
    if None in out:
        for i, w in enumerate(words):
            if out[i] is None:
                out[i] = memo[w] = (xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) >> 1) + 1
    return out


def shingles(codes: np.ndarray) -> np.ndarray:
    """A 64-bit code of every run of five words; a shorter text is one shingle of its own kind."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    size = min(n, SHINGLE)
    out = np.full(n - size + 1, size, np.uint64)
    wide = codes.astype(np.uint64)
    for k in range(size):
        out = (out ^ wide[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def shingle_lists(texts: list[list[int]]) -> list[np.ndarray]:
    """``shingles`` of many texts at once."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return shingle_runs(np.fromiter(chain.from_iterable(texts), np.uint64, int(size.sum())), size)


def shingle_runs(codes: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """``shingles`` of texts of ``size`` words that stand one after another."""
    wide = codes.astype(np.uint64)
    out = np.full(max(0, len(wide) - SHINGLE + 1), SHINGLE, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ wide[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    found, ends = out.view(np.int64), np.cumsum(size)
    return [found[e - n : e - SHINGLE + 1] if n >= SHINGLE else shingles(wide[e - n : e]) for n, e in zip(size.tolist(), ends.tolist())]


def similar(a: Column, b: Column) -> Column:
    """Whether two sets (arrays without repeats) have a Jaccard similarity of ``SIMILARITY`` or more."""
    na, nb = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    # sets this unlike in size cannot be similar
    return (F.least(na, nb) >= SIMILARITY * F.greatest(na, nb)) & (common >= SIMILARITY * (na + nb - common) - 1e-9)


def links(texts: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: codes of texts linked by verified similarity. Any two similar texts are connected by these links,
    directly or through others.

    ``texts`` has ``code bigint``, distinct, and ``shingles array<bigint>`` without repeats; an empty or null array links
    with nothing. Every text that holds a sketch value is compared with the least text that holds it (a star); only
    texts not similar to that one are compared with the others. Values are rare by their order, so stars are small
    unless texts are alike; hot ones are split by the join.
    """
    spark = texts.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/minhash-{uuid.uuid4().hex}"
    sets = texts.where(F.size("shingles") > 0).select("code", "shingles")
    spread = sets.select("code", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    common = spread.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    rare = F.floor(F.log2(F.col("k"))).cast("int")
    held = spread.join(common, "s").groupBy("code", "n").agg(F.sort_array(F.collect_list(F.struct(rare.alias("c"), F.col("s")))).alias("order"))
    # shingles of one text alone come first and take their places in the sketch
    width = F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-9).cast("int") + 1 - (F.col("n") - F.size("order"))
    sketch = held.where(width > 0).select("code", F.explode(F.slice("order", F.lit(1), width)).alias("x")).select("code", F.col("x.s").alias("s"))
    sketch.join(sets, "code").write.parquet(f"{path}/sketch")
    members = spark.read.parquet(f"{path}/sketch")
    least = members.groupBy("s").agg(F.min("code").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("s", "first")
    stars = least.join(sets.select(F.col("code").alias("first"), F.col("shingles").alias("theirs")), "first")
    met = members.join(stars, "s").where("code <> first")
    met.select("s", "first", "code", similar(F.col("shingles"), F.col("theirs")).alias("near")).write.parquet(f"{path}/stars")
    checked = spark.read.parquet(f"{path}/stars")
    left = checked.where("not near").select("s", "first", F.col("code").alias("other"))
    others = left.join(sets.select(F.col("code").alias("other"), F.col("shingles").alias("theirs")), "other")
    rest = members.join(others, "s").where("code <> other and code <> first").where(similar(F.col("shingles"), F.col("theirs")))
    found = checked.where("near").select(F.col("first").alias("x"), F.col("code").alias("y")).unionByName(rest.select(F.col("other").alias("x"), F.col("code").alias("y")))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
