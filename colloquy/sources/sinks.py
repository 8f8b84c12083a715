"""Writers of transcripts, sample sets, score tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transcripts(turns: DataFrame, by: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """One text per dialogue, its turns in order, each ended by a line break (K1)."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("t"))))
    return turns.groupBy(by).agg(F.concat(F.array_join(F.transform(listed, lambda x: x["t"]), "\n"), F.lit("\n")).alias("value"))


def write_texts(df: DataFrame, path: str, by: str, mode: str = "errorifexists") -> None:
    """Text files below one folder per value of ``by`` (K1, K2)."""
    df.select(by, "value").write.mode(mode).partitionBy(by).option("lineSep", "\n").text(path)


def write_dataset(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Samples by language and split; languages without training rows are left out."""
    langs = samples.where("split = 'train'").select("lang").distinct()
    samples.join(langs, "lang", "left_semi").write.mode(mode).partitionBy("lang", "split").parquet(path)


def score_table(df: DataFrame, digits: int = 6, undefined: str = "") -> DataFrame:
    """Doubles as fixed decimals, undefined ones as ``undefined`` (K4)."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(F.col(c).isNull() | F.isnan(c), undefined).otherwise(F.format_string(f"%.{digits}f", F.col(c))).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated with header (K4)."""
    score_table(df).write.mode(mode).csv(path, sep="\t", header=True, nullValue="", emptyValue="")


def write_report(summary: DataFrame, rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Summary and rows of a report as JSON below one folder (K5); rows stay distributed."""
    summary.write.mode(mode).json(f"{path}/summary")
    rows.write.mode(mode).json(f"{path}/rows")
