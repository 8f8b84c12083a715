"""Plans read only what they need, shuffle where stated, and results do not depend on partitions."""

import re

from colloquy.llm import bpe, lookalike, overlap, packing, splitting
from colloquy.llm import queries as Q
from colloquy.sources import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(df):
    return {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan(df)) for c in s.split(",")}


def test_narrow_operators_have_no_shuffle(spark, sf_dir):
    assert read_columns(Q.p7_ids(spark, sf_dir)) == {"doc_id", "text"} and "Exchange" not in plan(Q.p7_ids(spark, sf_dir))
    assert read_columns(Q.p6_pieces(spark, sf_dir)) == {"pair_id", "src", "mt"} and "Exchange" not in plan(Q.p6_pieces(spark, sf_dir))
    assert read_columns(Q.p3_sample_tokens(spark, sf_dir)) == {"sample_id", "messages"}
    assert read_columns(Q.p9_normal_forms(spark, sf_dir)) == {"doc_id", "text"}


def rows(df):
    return sorted(map(str, df.collect()))


def test_partitions_change_nothing(spark, sf_dir):
    docs, samples, pairs = (table(spark, sf_dir, n) for n in ("documents", "processed_dataset", "pairs"))
    alias = table(spark, sf_dir, "lang_alias")
    for build in (
        lambda n: lookalike.lookalike_pairs(docs.repartition(n)),
        lambda n: packing.pack(bpe.count_tokens(docs.repartition(n), ["doc_id"], "text"), block_rows=60),
        lambda n: bpe.token_budget(samples.repartition(n), alias),
        lambda n: splitting.split_sides(pairs.repartition(n), "pair_id"),
        lambda n: overlap.cross_split_overlaps(samples.repartition(n)),
    ):
        assert rows(build(1)) == rows(build(7))


def test_found_queries_have_the_stated_columns(spark, sf_dir):
    wanted = {
        "p1_found": [("sample_id", "bigint"), ("lang", "string")],
        "p2_found": [("sample_id", "bigint"), ("defect", "string")],
        "p4_found": [("pair_id", "bigint"), ("src_no", "int"), ("mt_no", "int")],
        "p5_found": [("sample_id_lo", "bigint"), ("sample_id_hi", "bigint")],
        "p6_found": [("pair_id", "bigint"), ("side", "string")],
        "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p9_found": [("doc_id_lo", "bigint"), ("doc_id_hi", "bigint")],
    }
    for name, columns in wanted.items():
        df = Q.QUERIES[name](spark, sf_dir)
        assert df.dtypes == columns, name
        assert df.count() == df.distinct().count() > 0, name
