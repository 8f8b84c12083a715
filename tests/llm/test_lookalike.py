"""Skeletons: what looks the same is equal, what a reader can tell apart is not."""

import pytest

from colloquy.llm import lookalike as K

SAME = [("abc", "ａｂｃ"), ("é", "é"), ("a b", "a b"), ("a b", "a b"), ("ab", "a​b"), ("ab", "a­b"), ("Maria", "Маriа"), ("office", "oﬃce"), ("لا", "ﻻ"), ("أ", "أ"), ("كي", "کی"), ("well-known", "well‑known"), ("x ", "x"), ("‏ab", "ab")]
DIFFERENT = [("e", "é"), ("A", "a"), ("2", "²"), ("1", "①"), ("a b", "ab"), ("a\nb", "a b"), ("٣", "3"), ("u", "ü"), ("™", "TM"), ("½", "1/2"), ("👩‍⚕️", "👩⚕️"), ("a", "b"), ("a  b", "a b")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert K.skeleton(a) == K.skeleton(b)
    assert K.canonical(K.canonical(a)) == K.canonical(a)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert K.skeleton(a) != K.skeleton(b)


def test_public_table(spark):
    letters = K.confusables(spark)
    table = K.Table(letters)
    assert 200 < len(letters) < 5000
    for a, b in (("ⅼ", "l"), ("Ꭺ", "A"), ("ᴏ", "o"), ("Ⅵ", "VI"), ("І", "I"), ("ӏ", "l"), ("𝐀", "A"), ("ı", "i"), *SAME):
        assert K.skeleton(a, table) == K.skeleton(b, table), (a, b)
    for a, b in (("l", "I"), ("1", "l"), ("0", "O"), ("m", "rn"), ("œ", "oe"), ("æ", "ae"), ("ø", "o"), ("’", "'"), *DIFFERENT):
        assert K.skeleton(a, table) != K.skeleton(b, table), (a, b)


def test_many_copies_and_one_variant(spark):
    from pyspark.sql import functions as F

    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "ａbc").otherwise("abc").alias("text"))
    found = K.lookalike_pairs(df)
    assert found.agg(F.count("*"), F.sum(F.when(F.col("doc_id_lo") == 7, 1).when(F.col("doc_id_hi") == 7, 1))).first() == (59_999, 59_999)


def test_pairs(spark):
    rows = [(1, "abc"), (2, "ａbc"), (3, "abc"), (4, None), (5, ""), (6, " ​"), (7, " "), (8, "xyz"), (9, "xyz"), (2, "ａbc"), (10, "a" * 5000 + "е"), (11, "a" * 5000 + "e")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, skeleton_key string")
    assert sorted(map(tuple, K.lookalike_pairs(df).collect())) == [(1, 2), (2, 3), (10, 11)]
    assert K.lookalike_pairs(df.limit(0)).count() == 0
    forms = {r["doc_id"]: r["canonical"] for r in K.normal_forms(df).collect()}
    assert forms[1] == forms[2] == "abc" and forms[4] is None and forms[6] == ""


def test_brute_force(spark, sf_dir):
    from colloquy.sources import table

    docs = table(spark, sf_dir, "documents")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["text"]]
    want = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(texts) for b, y in texts[i + 1 :] if x != y and K.skeleton(x) and K.skeleton(x) == K.skeleton(y)}
    assert set(map(tuple, K.lookalike_pairs(docs).collect())) == want
