"""Properties of operators that hold on any input."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions import dialogue as D
from colloquy.functions import text as X
from colloquy.operators import samples, statistics
from colloquy.plans import catalogue
from colloquy.sources import table


def test_end_spellings_are_idempotent(spark):
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choices(["[", "]", "/END", "END", "**", "a", " "], k=8)) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts if "[[" not in t and "]]" not in t], "t string").select(D.canonical_end(F.col("t")).alias("t"))
    assert df.where(D.canonical_end(F.col("t")) != F.col("t")).where("t not like '%[[%' and t not like '%]]%'").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=60))
def test_mtld_is_symmetric(words):
    assert statistics.mtld_of(words) == statistics.mtld_of(words[::-1])


def test_self_bleu_range_and_partitions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.words(F.col("text")).alias("words"))
    found = {n: {r["doc_id"]: r["self_bleu"] for r in statistics.self_bleu(docs.repartition(n), "doc_id").collect()} for n in (1, 5)}
    assert found[1].keys() == found[5].keys()
    assert all(abs(found[1][k] - found[5][k]) < 1e-9 and 0 <= found[1][k] <= 1 + 1e-9 for k in found[1])
    copies = docs.where(F.size("words") >= 4).limit(1)
    doubled = copies.unionByName(copies.withColumn("doc_id", -F.col("doc_id") - 1))
    assert all(abs(r["self_bleu"] - 1) < 1e-9 for r in statistics.self_bleu(doubled, "doc_id").collect())


def test_samples_are_the_targets(spark, sf_dir):
    turns = catalogue.turns(spark, sf_dir)
    windows = samples.context_windows(turns, conv="sample_id")
    assert windows.count() == turns.where("role = 'assistant' and text <> ''").count()
    assert windows.where(F.size("messages") > samples.CONTEXT_TURNS + 1).count() == 0


def test_scans_read_what_they_need(spark, sf_dir):
    def columns(name):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        return {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan) for c in s.split(",") if c}

    assert columns("sample_counts") == {"lang", "path"}
    assert columns("vocabulary_by_language") == {"lang", "text"}
    assert columns("context_windows") == {"sample_id", "messages"}


def test_dialogues_in_a_row_are_not_shuffled(spark, sf_dir):
    for name in ("context_windows", "message_roles", "flattened_messages", "rendered_transcripts", "chat_texts", "cleaned_client_turns", "cleaned_therapist_turns", "early_ends", "end_markers", "wind_down_messages", "zipped_lines", "greedy_chunks", "mtld_per_document", "thought_and_quoted_turns"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan, name
