"""Hand-written cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import dialogue as D
from colloquy.functions import judge as J
from colloquy.functions import labels as L
from colloquy.functions import text as X


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, "L'été — Größe_1", X.tokens) == ["l", "'", "été", "—", "größe_1"]
    assert one(spark, "L'été — Größe_1", X.words) == ["l", "été", "größe_1"]
    assert one(spark, None, X.tokens) is None
    assert one(spark, "", X.tokens) == []


@pytest.mark.parametrize("name,short", [("Mdd_notactive12.txt", "notactive12"), ("Mdd_active_684.txt", "Mdd_active_684"), ("Control7.x", "control7")])
def test_short_id(spark, name, short):
    assert one(spark, name, X.short_id) == short


def test_normalise_and_shorten(spark):
    assert one(spark, "  “Ich’m”  —\n a ", X.normalise) == "\"ich'm\" - a"
    assert one(spark, "ab\ncd", lambda c: X.shorten(c, 3)) == "ab\\...[TRUNCATED]"
    assert one(spark, "ab", X.shorten) == "ab"


def test_paths(spark):
    p = "de\\x\\train\\mdd\\mdd_active1.v2.txt"
    assert one(spark, p, X.split_of) == "train"
    assert one(spark, "a/dev/b/train/c", X.split_of) == "train"
    assert one(spark, "none", X.split_of) == "train"
    assert one(spark, p, X.subset_of) == "mdd"
    assert one(spark, p, X.path_name) == "mdd_active1"
    assert one(spark, p, X.path_style) == "train"
    assert one(spark, "a/b.JSON", X.path_suffix) == ".json"


def test_elapsed(spark):
    assert one(spark, "3725.9", lambda c: X.elapsed(c.cast("double"))) == "1:2:5"


def test_turn_split(spark):
    labels = D.LABELS["de"]
    assert one(spark, "intro Therapeut: A Klient: B", lambda c: D.turns(c, labels)) == ["intro", "Therapeut: A", "Klient: B"]
    assert one(spark, " ", lambda c: D.turns(c, labels)) == []


@pytest.mark.parametrize("raw,end", [("[END]", "[/END]"), ("[**END**]", "[/END]"), ("/END", "[/END]"), ("[]", "[/END]"), ("[/END]", "[/END]"), ("[[END]]", "[[/END]]")])
def test_end_spellings(spark, raw, end):
    assert one(spark, raw, D.canonical_end) == end


def test_own_turn(spark):
    assert one(spark, "x\nTherapist: a\nb", lambda c: D.own_turn(c, D.THERAPIST_TAGS, whole=False)) == "Therapist: a"
    assert one(spark, "x\nClient: a\nb", lambda c: D.own_turn(c, D.CLIENT_TAGS, whole=True)) == "Client: a\nb"
    assert one(spark, "a", lambda c: D.own_turn(c, D.CLIENT_TAGS, whole=True)) == "a"


def test_cut_takes_the_first_tag_of_the_list(spark):
    assert one(spark, "Client: a Therapist: b Therapeut: c", lambda c: D.cut_at_tags(c, D.THERAPIST_TAGS)) == "Client: a Therapist: b "


def test_cleaned(spark):
    clean = lambda c: D.cleaned(c, "client", F.lit(3), F.lit("control"))
    assert one(spark, "bla **Client:** hello [END]<|END_RESPONSE|> Therapist: no", clean) == "Client: hello"
    late = lambda c: D.cleaned(c, "client", F.lit(8), F.lit("control"))
    assert one(spark, "Client: bye [END]", late) == "Client: bye [/END]"
    assert one(spark, "<think>x</think> Client: a (12 words)", lambda c: D.cleaned(c, "client", F.lit(8), F.lit("x"), thinking=True)) == "Client: a"


def test_client_reply(spark):
    reply = lambda c: D.client_reply(c, "en", F.lit(1))
    assert one(spark, "Client: hi", reply) == "Client: hi"
    for bad in ("", "Client:", "hi", None):
        assert one(spark, bad, reply) in D.CLIENT_REPLIES["en"]


def test_prompts(spark):
    assert one(spark, "q {history} {history}", lambda c: D.filled(c, history=F.lit("h"))) == "q h h"
    assert one(spark, "a[T]b[T]c", lambda c: D.commented(c, F.lit("x"), "[T]")) == "a\nx\n[T]"
    assert one(spark, "a[T]b[T]c", lambda c: D.commented(c, F.lit("x"), "[T]", last=True)) == "a[T]bc\nx\n[T]"
    assert one(spark, "a", lambda c: D.commented(c, F.lit(""), "[T]")) == "a"


def test_messages(spark):
    raw = '[{"role": "Therapist", "response": "a"}, {"role": "user", "content": "b"}, {"role": "system"}]'
    assert [tuple(m) for m in one(spark, raw, D.decoded)] == [("assistant", "a"), ("user", "b"), ("system", None)]
    assert one(spark, raw, lambda c: D.decoded(D.encoded(D.decoded(c)))) == one(spark, raw, D.decoded)
    assert one(spark, "no json", D.decoded) is None and one(spark, None, D.decoded) is None
    assert one(spark, raw, lambda c: D.chat_text(D.decoded(c))) == "assistant: a\nuser: b\nsystem: "


@pytest.mark.parametrize("raw,found", [("Answer: a; C, a", ["a", "c"]), ("a.", []), ("", []), ("Réponse: b\nc", ["b", "c"])])
def test_letters(spark, raw, found):
    assert one(spark, raw, lambda c: L.letters(c, F.array(*[F.lit(x) for x in "abc"]))) == found


def test_lists(spark):
    assert one(spark, " a, ,b ", L.as_list) == ["a", "b"]
    assert one(spark, None, L.as_list) == []
    assert one(spark, "a", lambda c: L.first_filled(F.array().cast("array<string>"), F.array(c))) == ["a"]
    assert one(spark, "x", lambda c: L.choices(F.array(F.lit("a"), F.lit("b")), F.array(c, F.lit("y")))) == "a: x\nb: y"


def test_judge_replies(spark):
    s = one(spark, '```json\n{"Context_Fit": 9, "empathy": 3.7, " Fluency ": 0}\n```', J.parsed_scores)
    assert (s["coherence"], s["empathy"], s["fluency"], s["brief_justification"], s["error"]) == (5, 3, 1, "", None)
    for bad in ('{"empathy": "4.9"}', '{"empathy": null}', '{"empathy": "x"}', "no json", ""):
        assert one(spark, bad, J.parsed_scores)["error"] is not None
    assert one(spark, '{"empathy": "4"}', J.parsed_scores)["empathy"] == 4
