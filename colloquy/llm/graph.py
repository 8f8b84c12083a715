"""Connected components of verified links."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import shared_dir


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of the links ``(a, b)``.

    Large-star and small-star rounds in turn: every node points its greater neighbours, then its smaller ones, to the
    least of them. Rounds grow with the logarithm of the number of nodes and end when the links no longer change. A
    hub of many links costs a partial minimum per task and one row of a join. Each round is written to the shared
    folder, so a lost executor costs its tasks only.
    """
    spark = links.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/components-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # every link points from its greater to its smaller end
    edges = kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "0")
    before, number = mark(edges), 0
    while before[0]:
        number += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(lower.select("a", F.col("m").alias("b")))
        edges = kept(small.distinct(), str(number))
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
