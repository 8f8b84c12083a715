"""Queries of the training-text operators over the project's tables; each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import align, bpe, fitting, language, lookalike, overlap, packing, pairing, splitting
from colloquy.session import held, materialise, spread
from colloquy.sources import table


def samples_of(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "processed_dataset"))


_MODELS: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, d: str, name: str, fit):
    """A model of a folder's samples, fitted once per application."""
    key = spark.sparkContext.applicationId, d, name
    if key not in _MODELS:
        _MODELS[key] = fit()
    return _MODELS[key]


def models_of(spark: SparkSession, d: str) -> tuple:
    """Language field and sentence endings, fitted on all rows, and the rows as they were read for it until a cleaning."""
    found = _once(spark, d, "models", lambda: fitting.fit_pairs(samples_of(spark, d), table(spark, d, "lang_alias"), table(spark, d, "glossary")))
    return found if held(found[2]) else found[:2]


def field_of(spark: SparkSession, d: str) -> language.Field:
    return _once(spark, d, "field", lambda: language.fit_field(samples_of(spark, d), table(spark, d, "lang_alias"), table(spark, d, "glossary")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return language.unstated_languages(samples_of(spark, d), table(spark, d, "lang_alias"), field=field_of(spark, d))


def p1_documents(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(samples_of(spark, d), field_of(spark, d)).select("sample_id", "language", "confidence")


def p1_stretches(spark: SparkSession, d: str) -> DataFrame:
    return language.language_stretches(samples_of(spark, d), field_of(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairing.pair_defects(samples_of(spark, d), table(spark, d, "lang_alias"), models=models_of(spark, d), keep=lambda df: materialise(df, "pair-checks"))


def p2_templates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates for refusals with the figures that decide: recurrence, dependence on prompts, histories."""
    field, endings, *packs = models_of(spark, d)
    checked = materialise(pairing.row_checks(samples_of(spark, d), field, endings, "sample_id", "messages", *packs), "pair-checks")
    found = pairing.opening_clusters(checked, lambda df: materialise(df, "pair-checks"))
    return found.select("opening", "cluster", "rows", "prompts", "own", "other", "answered", "expected", "refuses")


def p3_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_budget(table(spark, d, "processed_dataset"), table(spark, d, "lang_alias"))


def p3_sample_tokens(spark: SparkSession, d: str) -> DataFrame:
    return bpe.count_tokens(table(spark, d, "processed_dataset"), ["sample_id"], "messages", messages=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return align.sentence_pairs(spread(table(spark, d, "pairs"))).select("pair_id", "src_no", "mt_no")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = overlap.cross_split_overlaps(samples_of(spark, d))
    return found.select(F.least("train_id", "eval_id").alias("sample_id_lo"), F.greatest("train_id", "eval_id").alias("sample_id_hi"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps by split, source and spelled language of the evaluation row: pairs, rows concerned, and all rows."""
    samples, alias = table(spark, d, "processed_dataset"), table(spark, d, "lang_alias")
    found = overlap.cross_split_overlaps(samples).groupBy("eval_id").agg(F.count(F.lit(1)).alias("pairs"))
    held = samples.where("split <> 'train'").select("sample_id", "split", "source", bpe.spelled(F.col("lang")).alias("alias"))
    rows = held.join(found, held["sample_id"] == found["eval_id"], "left")
    partial = rows.groupBy("split", "source", "alias").agg(F.count(F.lit(1)).alias("n"), F.count("eval_id").alias("hit"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("p"))
    named = partial.join(alias.select("alias", F.col("lang").alias("lang")).dropDuplicates(["alias"]), "alias", "left")
    return named.groupBy("split", "source", "lang").agg(F.sum("n").alias("n_rows"), F.sum("hit").alias("n_overlapping"), F.sum("p").alias("n_pairs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_sides(table(spark, d, "pairs"), "pair_id").where("piece_no = 0").select("pair_id", "side")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_sides(table(spark, d, "pairs"), "pair_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return packing.pack(bpe.count_tokens(documents, ["doc_id"], "text"), rows=documents.count())


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "documents"))


def p9_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normal_forms(table(spark, d, "documents")).select("doc_id", "canonical")


QUERIES = {
    "p1_found": p1_found,
    "p1_documents": p1_documents,
    "p1_stretches": p1_stretches,
    "p2_found": p2_found,
    "p2_templates": p2_templates,
    "p3_token_budget": p3_token_budget,
    "p3_sample_tokens": p3_sample_tokens,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p9_normal_forms": p9_normal_forms,
}

ORACLES = {
    "p6_found": """
        SELECT pair_id, 'src' AS side FROM pairs WHERE length(src) > 1800
        UNION ALL
        SELECT pair_id, 'mt' AS side FROM pairs WHERE length(mt) > 1800
    """,
}
