"""Readers of transcripts, JSON and manifests; every schema is explicit."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import squeeze


def required(spark: SparkSession, *paths: str) -> None:
    """Raise where a file or folder is missing or holds nothing (P20)."""
    for path in paths:
        try:
            found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").limit(1).count()
        except AnalysisException as e:
            raise FileNotFoundError(path) from e
        if not found:
            raise FileNotFoundError(path)


def whole_texts(spark: SparkSession, path: str | list[str], glob: str = "*.txt", strip: bool = False) -> DataFrame:
    """``path`` and ``text`` of every file below ``path`` that matches ``glob``."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    text = squeeze(F.col("value")) if strip else F.col("value")
    return read.select(F.col("_metadata.file_path").alias("path"), text.alias("text"))


def text_lines(spark: SparkSession, path: str | list[str], glob: str = "*.txt") -> DataFrame:
    """``path``, ``line_no`` from 0 and ``line`` of text files; malformed bytes are dropped (S5). Lines are numbered
    within their file's text, so a file is read as one value."""
    whole = whole_texts(spark, path, glob)
    return whole.select("path", F.posexplode(F.split(F.replace(F.make_valid_utf8("text"), F.lit("\ufffd"), F.lit("")), r"\r?\n")).alias("line_no", "line"))


def json_documents(spark: SparkSession, path: str | list[str], schema: T.StructType, glob: str = "*.json") -> DataFrame:
    """JSON documents of a known schema, one or an array per file."""
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(path)


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType, glob: str = "*.jsonl") -> DataFrame:
    """JSON Lines; blank lines are skipped, a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(path)


def mixed_corpus(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("json", "jsonl", "txt")) -> DataFrame:
    """``path``, ``kind`` (suffix) and ``text`` of all files of these suffixes (S3); dispatch on ``kind``."""
    glob = "*.{" + ",".join(suffixes) + "}"
    return whole_texts(spark, path, glob).withColumn("kind", F.regexp_extract(F.lower("path"), r"\.([^./]+)$", 1))


def dataset(spark: SparkSession, path: str, split: str | None = None, schema: str | None = None) -> DataFrame:
    """A written sample set, pruned to one split."""
    found = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return found.where(F.col("split") == split) if split else found


def manifest_texts(manifest: DataFrame, texts: DataFrame, key: str = "path") -> DataFrame:
    """Manifest rows with the text of their file; ``error`` says which are missing."""
    joined = manifest.join(texts.select(key, "text"), key, "left")
    return joined.withColumn("error", F.when(F.col("text").isNull(), F.concat(F.lit("file not found: "), F.coalesce(F.col(key), F.lit("")))))


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small configuration table."""
    return spark.createDataFrame(rows, schema)
