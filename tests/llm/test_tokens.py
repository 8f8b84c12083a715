"""Token counts and ids against a public implementation and a merge loop by definition."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
VOCABULARY = bpe.Vocabulary.load(bpe.vocabulary_path())
PUBLIC = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
PUBLIC.encode_special_tokens = True

TEXTS = ["", " ", "a", "  a  b ", "aaaaaaaaa aaaa", "\n\n x\t\n", "<|endoftext|> hi", "don't we'll  \n  x ", "Größe l'été 12½ ²", "مرحبا بالعالم، كيف", "👩‍⚕️ ok 🌱", "a  b c", "x" * 5000, "word " * 3000]


def wanted(text):
    return PUBLIC.encode(text, add_special_tokens=False).ids if text else []


@pytest.mark.parametrize("text", TEXTS)
def test_both_engines_equal_the_public_tokenizer(text):
    assert bpe.Encoder(VOCABULARY, counting=False).batch([text]) == [wanted(text)]
    assert bpe.Encoder(VOCABULARY, counting=True).batch([text]) == [len(wanted(text))]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert bpe.Encoder(VOCABULARY, counting=False).batch([text, None]) == [wanted(text), []]
    assert bpe.Encoder(VOCABULARY, counting=True).batch([text, None]) == [len(wanted(text)), 0]


def test_frames(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (2, "", "y"), (1, "hello world", "x")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in bpe.encode_texts(df, "doc_id", "text").collect())
    assert got == [(1, wanted("hello world"))] * 2 + [(2, [])] * 2
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_budget_groups(spark):
    raw = '[{"role": "user", "content": "hello world"}, {"role": "assistant", "response": "hi"}, {"role": "assistant"}]'
    rows = [("s", " DE ", "d", raw), ("s", "de", "d", raw), (None, "??", None, None), (None, None, None, "no json"), ("s", "de", "d", raw)]
    df = spark.createDataFrame(rows, "source string, lang string, domain string, messages string")
    alias = spark.createDataFrame([("de", "de"), ("deutsch", "de")], "alias string, lang string")
    got = {(r["source"], r["lang"], r["domain"]): (r["n_samples"], r["n_tokens"]) for r in bpe.token_budget(df, alias).collect()}
    each = len(wanted("hello world")) + len(wanted("hi"))
    assert got == {("s", "de", "d"): (3, 3 * each), (None, None, None): (2, 0)}


def test_ids_of_the_table(spark, sf_dir):
    from colloquy.sources import table

    docs = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in bpe.encode_texts(docs, "doc_id", "text").collect():
        assert list(r["ids"]) == wanted(texts[r["doc_id"]])


def by_library(name):
    if name == "byte_bpe_multi_50k":
        import base64

        tiktoken = pytest.importorskip("tiktoken")
        with open(bpe.vocabulary_path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=bpe.PRE_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    public = tokenizers.Tokenizer.from_file(bpe.vocabulary_path(name))
    public.encode_special_tokens = True
    return lambda text: public.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k", "word_bpe_49k", "byte_bpe_multi_50k"])
def test_every_public_vocabulary(name, sf_dir):
    import duckdb

    encode, vocabulary = by_library(name), bpe.Vocabulary.load(bpe.vocabulary_path(name))
    rows = [r[0] for r in duckdb.sql(f"select text from '{sf_dir}/documents.parquet' where text is not null").fetchall()]
    texts = [*TEXTS, *rows, "Hello world, how are you?", "ΟΔΥΣΣΕΥΣ İstanbul", "aaa aaaa aaaaa aaaaaaa\x1c b\u2028c"]
    ids, counts = bpe.Encoder(vocabulary, counting=False), bpe.Encoder(vocabulary, counting=True)
    for text, got, n in zip(texts, ids.batch(texts), counts.batch(texts)):
        want = encode(text) if text else []
        assert got == want and n == len(want), text[:80]


def test_what_is_not_followed_is_refused(tmp_path):
    import json

    with pytest.raises(ValueError):
        bpe.Vocabulary.load(bpe.vocabulary_path("piece_bpe_32k"))
    with open(bpe.vocabulary_path()) as f:
        whole = json.load(f)
    for part, value in (("normalizer", {"type": "StripAccents"}), ("pre_tokenizer", {"type": "Whitespace"}), ("model", whole["model"] | {"byte_fallback": True})):
        (tmp_path / "odd.json").write_text(json.dumps(whole | {part: value}))
        with pytest.raises(ValueError):
            bpe.Vocabulary.load(str(tmp_path / "odd.json"))
