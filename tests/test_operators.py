"""Operators on small fixtures, against direct computations."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.functions import dialogue as D
from colloquy.operators import benchmark, generation, jsontree, judging, samples, sessions, statistics, translation
from colloquy.sources import sinks
from colloquy.sources import text as readers


def test_windows_frame_then_drop(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", "" if i == 5 else f"t{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r["turn"]: [m["content"] for m in r["messages"]] for r in samples.context_windows(df, first=F.lit("sys")).collect()}
    assert got[0] == ["sys", "t0"]
    assert got[8] == ["sys", "t2", "t3", "t4", "t6", "t7", "t8"]


def test_transcripts_to_samples(spark):
    text = "intro Therapeut: A [END] Klient: B [END]\nTherapeut: [END] Therapeut: C"
    df = spark.createDataFrame([("p", text), ("q", ""), ("r", None)], "path string, text string")
    turns = samples.transcript_turns(df, D.LABELS["de"])
    assert [(r["turn"], r["role"], r["text"]) for r in turns.orderBy("turn").collect()] == [(0, None, ""), (1, "assistant", "A"), (2, "user", "B [END]"), (3, "assistant", ""), (4, "assistant", "C")]
    found = samples.transcript_samples(df, D.LABELS["de"], "s").orderBy("turn").collect()
    assert [[m["content"] for m in r["messages"]] for r in found] == [["s", "A"], ["s", "A", "B [END]", "C"]]
    windows = samples.context_windows(turns, conv="path", first=F.lit("s")).orderBy("turn").collect()
    assert [r["messages"] for r in windows] == [r["messages"] for r in found]


def test_repeats_and_loops(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("a", "x"), ("b", "y"), ("a", "x"), ("b", "y"), ("a", "z")])]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert [r["seen_before"] for r in sessions.repeats(df).orderBy("turn").collect()] == [False, False, True, True, False]
    assert [r["loop"] for r in sessions.loops(df).orderBy("turn").collect()] == [False, False, False, True, False]
    ended = spark.createDataFrame([(1, 0, "a"), (1, 1, "b [/END]"), (1, 2, "c"), (2, 40, "d")], "conv_id long, turn int, text string")
    assert [r["text"] for r in sessions.first_end(ended).orderBy("turn").collect()] == ["a", "b [/END]"]


def test_tagged_lines(spark):
    df = spark.createDataFrame([("x", "Client: a"), ("x", "b"), ("y", "a"), ("y", " "), ("y", "b")], "path string, line string")
    assert Counter(r["path"] for r in statistics.tagged_lines(df).collect()) == {"x": 1, "y": 2}


def test_mtld():
    assert statistics.mtld_of(list("abcdefghi")) is None
    assert statistics.mtld_of([str(i) for i in range(12)]) is None
    assert statistics._factors("a b c a b d e f a a b c d a b".split(), 0.72) == pytest.approx(7.5)
    words = ("to be or not to be that is the question " * 3).split()
    assert statistics.mtld_of(words) == pytest.approx(statistics.mtld_of(words[::-1]))


def bleu(hyp, refs, n=4):
    """Sentence BLEU with the small-count rule, by definition."""
    total = 0.0
    for k in range(1, n + 1):
        grams = Counter(tuple(hyp[i : i + k]) for i in range(len(hyp) - k + 1))
        best = Counter()
        for r in refs:
            for g, c in Counter(tuple(r[i : i + k]) for i in range(len(r) - k + 1)).items():
                best[g] = max(best[g], c)
        hit = sum(min(c, best[g]) for g, c in grams.items())
        if k == 1 and hit == 0:
            return 0.0
        total += math.log((hit or 0.1) / max(1, sum(grams.values()))) / n
    ref = min((abs(len(r) - len(hyp)), len(r)) for r in refs)[1]
    return math.exp(total) * (1.0 if len(hyp) > ref else math.exp(1 - ref / len(hyp)))


def test_self_bleu(spark):
    docs = {1: "a b c d e".split(), 2: "a b c d e".split(), 3: "a b a b x".split(), 4: ["z"], 5: "a a a c d e f".split(), 6: []}
    df = spark.createDataFrame(list(docs.items()), "k long, words array<string>")
    got = {r["k"]: r["self_bleu"] for r in statistics.self_bleu(df, "k").collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for k, w in docs.items():
        if w:
            assert got[k] == pytest.approx(bleu(w, [v for j, v in docs.items() if j != k and v]))
    assert got[1] == pytest.approx(1.0)
    single = statistics.self_bleu(df.where("k = 3"), "k").first()
    assert single["self_bleu"] is None


def test_chunks():
    assert translation.chunks_of("a b\nc d\ne", "", 3) == [("a b", ""), ("c d", ""), ("e", "")]
    assert translation.chunks_of("", None, 3) == []
    assert translation.chunks_of("a\n\nb", "x", 9) == [("a\nb", "x")]


def test_macro_mean(spark):
    df = spark.createDataFrame([("d1", 1.0), ("d1", 1.0), ("d1", 1.0), ("d2", 0.0)], "doc string, score double")
    assert translation.macro_mean(df, "doc").first()["score"] == 0.5


def test_pairing(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "")], "basename string, text string")
    b = spark.createDataFrame([("x", "3"), ("z", "4")], "basename string, text string")
    assert [tuple(r) for r in translation.paired(a, b).collect()] == [("x", "1", "3")]
    assert [r["basename"] for r in translation.untranslated(a, b).collect()] == ["y"]
    z = translation.zipped_lines(spark.createDataFrame([(1, "a\nb", "c")], "k long, src string, mt string"), "k")
    assert [tuple(r) for r in z.collect()] == [(1, 0, "a", "c"), (1, 1, "b", "")]


def test_judge_means(spark):
    schema = "dialogue_id string, language string, fluency int, coherence int, naturalness int, empathy int, appropriateness int, engagement int, error string"
    df = spark.createDataFrame([("d", "de", 4, None, None, None, None, None, None), ("d", "de", 2, 2, 2, 2, 2, 2, None), ("e", "fr", None, None, None, None, None, None, "x")], schema)
    assert sorted(round(r["average"], 2) for r in judging.with_average(df.where("error is null")).collect()) == [0.67, 2.0]
    whole = judging.group_means(df).where("level = 'overall'").first()
    assert (whole["fluency"], whole["empathy"], whole["n"]) == (3.0, 2.0, 2)
    assert judging.group_means(df.where("dialogue_id = 'e'")).count() == 0


def test_scores_count_unseen_labels(spark):
    dim = spark.createDataFrame([(2, 0, "a", "x", "en", "x"), (2, 1, "b", "y, z", "en", "y, z"), (2, 1, "b", "y, z", "de", "J"), (2, 2, "c", "w", "en", "w")], "task_id int, ord int, letter string, label_en string, lang string, label string")
    items = spark.createDataFrame([(1, 2, ["x", "nonsense"]), (2, 2, ["j"]), (3, 2, None)], "idx long, task_id int, gold array<string>")
    pred = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, None)], "idx long, pred_letters array<string>")
    got = benchmark.scores(benchmark.truth_table(pred, items, dim), ["task_id"]).first()
    assert got["macro_f1"] == pytest.approx((2 / 3 + 0 + 0) / 3)
    assert got["weighted_f1"] == pytest.approx((2 / 3 + 0) / 2)
    assert got["macro_recall"] == pytest.approx((1 + 0 + 0) / 3)


def test_json_trees(spark):
    assert jsontree.utterances_of({"text": "a", "x": {"text": "b"}}) == ["a"]
    assert jsontree.utterances_of({"x": [1, "c", " ", None, True]}) == ["c"]
    assert jsontree.utterances_of([{"Text": "a"}, {"x": {"y": ["b"]}}]) == ["a", "b"]
    df = spark.createDataFrame([(1, '{"text": "a"}\n\n["b", "c"]'), (2, None)], "k long, t string")
    assert [tuple(r) for r in jsontree.utterances(df, "k", "t", lines=True).collect()] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c")]


def test_plugins(spark):
    df = spark.createDataFrame([("a", "bb"), (None, "b")], "src string, mt string")
    assert [r[0] for r in df.select(generation.pair_scorer(generation.stub_scores)("src", "mt")).collect()] == [0.5, 0.0]
    assert df.select(generation.counter(lambda ts: [len(t or "") for t in ts])("mt")).first()[0] == 2
    meta = generation.generator_with_metadata(lambda ps: [{"text": p, "prompt_tokens": 1, "generated_tokens": 2, "elapsed_sec": 0.5} for p in ps])
    assert df.select(meta("mt").alias("g")).first()["g"]["generated_tokens"] == 2
    open_ = spark.createDataFrame([(1, ["Therapist: hi"], 2, "mdd")], "id long, history array<string>, turn int, style string")
    said = generation.next_turns(open_, F.lit("{history}\n{turns}"), generation.generator(generation.stub_texts), "client").first()["history"]
    assert said[0] == "Therapist: hi" and said[1].startswith("Client: ")


def test_prompts_are_sent_once(spark):
    from colloquy.session import materialise

    calls = spark.sparkContext.accumulator(0)

    def run(prompts):
        calls.add(len(prompts))
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("a",)], "p string")
    out = generation.generated_once(df, "p", generation.generator(run), lambda d: materialise(d, "answers"))
    assert sorted((r["p"] or "", r["generated"]) for r in out.collect()) == [("", None), ("a", "A"), ("a", "A"), ("a", "A"), ("b", "B")]
    assert calls.value == 2


@pytest.mark.parametrize("named", ["plain", "uri", "none"])
def test_shared_dir_has_a_scheme(spark, tmp_path, monkeypatch, named):
    from colloquy.session import cleanup, materialise, shared_dir

    value = {"plain": str(tmp_path), "uri": f"file://{tmp_path}", "none": None}[named]
    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: value if key == "spark.checkpoint.dir" else get(self, key, *default))
    found = shared_dir(spark)
    assert found.startswith(f"file://{tmp_path}/" if value else "file:///") and found == shared_dir(spark)
    assert materialise(spark.range(3), "x").count() == 3
    if value:
        assert any(tmp_path.iterdir())
        cleanup(spark)
        assert not any(tmp_path.iterdir()) and materialise(spark.range(3), "x").count() == 3


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from colloquy.session import shared_dir

    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: {"spark.master": "spark://host:7077", "spark.app.id": "no-folder"}.get(key))
    with pytest.raises(ValueError):
        shared_dir(spark)


def test_retries(spark):
    waits, calls = [], []

    def call(prompt):
        calls.append(prompt)
        if prompt == "never" or len(calls) < 3:
            raise RuntimeError("busy " * 100)
        return prompt.upper()

    run = generation.with_retries(call, tries=3, pause=1.0, sleep=waits.append)
    assert run(["a", None]) == [{"text": "A", "error": None}, {"text": None, "error": None}] and waits == [2.0, 4.0, 1.0, 1.0]
    assert run(["never"])[0]["error"] == ("busy " * 100)[:200] and calls.count("never") == 3


def test_required_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("x")
    (tmp_path / "b").mkdir()
    readers.required(spark, str(tmp_path / "a"), str(tmp_path / "a" / "x.txt"))
    for missing in ("b", "c"):
        with pytest.raises(FileNotFoundError):
            readers.required(spark, str(tmp_path / missing))


def test_bad_bytes_are_dropped(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"ab\xffc\nd")
    assert [r["line"] for r in readers.text_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == ["abc", "d"]


def test_dispatch_by_kind(spark):
    df = spark.createDataFrame([("txt", "a b\n\n c"), ("TXT", None), ("pdf", "a b")], "kind string, text string")
    assert [(r["utterances"], r["tokens"]) for r in statistics.text_totals(df).collect()] == [(2, 3), (0, 0), (0, 0)]


def test_loops_of_whole_turns(spark):
    said = ["a x", "b x", "a x", "b x", "a y", "b x"]
    df = spark.createDataFrame([(1, i, "client" if i % 2 else "therapist", t) for i, t in enumerate(said)], "conv_id long, turn int, role string, text string")
    assert [r["loop"] for r in sessions.loops(df).orderBy("turn").collect()] == [False, False, False, True, False, False]


def test_long_sessions(spark):
    df = spark.createDataFrame([(n, "Therapist: bye [/END]") for n in (14, 15, 21, 22, 29, 30, 33)], "turn int, text string")
    rows = df.select(D.wind_down(F.col("turn")).alias("w"), D.late_end(F.col("text"), F.col("turn")).alias("t")).collect()
    assert [r["w"] for r in rows] == ["", "", "", "You should end the conversation in 8 turns.", "You should end the conversation in 1 turn.", "You should end the conversation in this turn with '[/END]' token.", "You should end the conversation in -3 turns."]
    assert [r["t"] for r in rows][:2] == ["Therapist: bye", "Therapist: bye [/END]"]


def test_labels_by_language(spark):
    df = spark.createDataFrame([(1, "de", "Therapeut: Ja. Klient: Nein."), (2, None, "Therapist: Yes. Klient: no"), (3, "fr", None)], "path long, code string, text string")
    got = {(r["path"], r["turn"]): (r["role"], r["text"]) for r in samples.transcript_turns(df, samples.labels_of(F.col("code"))).collect()}
    assert got == {(1, 0): ("assistant", "Ja."), (1, 1): ("user", "Nein."), (2, 0): ("assistant", "Yes. Klient: no")}


def test_hot_grams(spark, monkeypatch):
    rows = [(i, f"the cat {i} sat the".split()) for i in range(40)] + [(99, [])]
    df = spark.createDataFrame(rows, "k long, words array<string>")
    whole = sorted((r["k"], round(r["self_bleu"], 9)) for r in statistics.self_bleu(df, "k").collect())
    monkeypatch.setattr(statistics, "HOT_DOCUMENTS", 5)
    assert sorted((r["k"], round(r["self_bleu"], 9)) for r in statistics.self_bleu(df, "k").collect()) == whole and len(whole) == 40


def test_small_tables_are_checked(spark):
    from colloquy.session import fixed, small

    df = spark.range(5)
    assert len(small(df, 5)) == 5
    with pytest.raises(ValueError):
        small(df, 4)
    plan = lambda d: spark.range(9).join(d, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(fixed(df, 5)) and "broadcast" not in plan(fixed(df, 4))


def test_capped_sampled_latest(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [(None, 9)], "g string, i long")
    assert samples.capped(df, "g", "i", 2).count() == 3
    assert [r["i"] for r in samples.first_rows(df, "i", 2).collect()] == [0, 1]
    assert samples.seeded_sample(df, "i", 3).count() == 3 and samples.seeded_sample(df, "i", 99).count() == 6
    names = spark.createDataFrame([("c-9",), ("c-10",), ("c",), ("x-1b",)], "name string")
    assert samples.latest_checkpoint(names).first()["name"] == "c-10"


def test_files_round_trip(spark, tmp_path):
    folder = tmp_path / "in" / "train"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("Client: x\nb\n")
    (folder / "b.md").write_text("no")
    (folder / "c.json").write_text(json.dumps({"text": "q"}))
    (folder / "d.jsonl").write_text('{"text": "r"}\n\n{"text": "s"}\n')
    assert readers.whole_texts(spark, str(tmp_path / "in"), strip=True).first()["text"] == "Client: x\nb"
    assert readers.text_lines(spark, str(tmp_path / "in")).count() == 3
    assert sorted(r["kind"] for r in readers.mixed_corpus(spark, str(tmp_path / "in")).collect()) == ["json", "jsonl", "txt"]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("text", T.StringType())])
    assert [r["text"] for r in readers.json_lines(spark, str(tmp_path / "in"), schema).collect()] == ["r", "s"]
    assert readers.json_documents(spark, str(tmp_path / "in"), schema).first()["text"] == "q"
    manifest = readers.literal(spark, [("x",), ("y",)], "path string")
    texts = spark.createDataFrame([("x", "t")], "path string, text string")
    assert [r["error"] for r in readers.manifest_texts(manifest, texts).orderBy("path").collect()] == [None, "file not found: y"]
    turns = spark.createDataFrame([(1, 1, "b"), (1, 0, "a\nc")], "conv_id long, turn int, text string")
    sinks.write_texts(sinks.transcripts(turns), str(tmp_path / "out"), "conv_id")
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first()["value"].startswith("a\nc\nb\n")
    rows = spark.createDataFrame([("de", "train", 1), ("de", "dev", 2), ("fr", "dev", 3)], "lang string, split string, n int")
    sinks.write_dataset(rows, str(tmp_path / "set"))
    assert readers.dataset(spark, str(tmp_path / "set"), "dev").count() == 1
    scores = spark.createDataFrame([("a", 0.5), ("b", None), ("c", float("nan"))], "name string, s double")
    sinks.write_tsv(scores.coalesce(1), str(tmp_path / "tsv"))
    written = next((tmp_path / "tsv").glob("*.csv")).read_text()
    assert written.splitlines()[:2] == ["name\ts", "a\t0.500000"] and written.splitlines()[2].rstrip() == "b"
    sinks.write_report(rows.groupBy().count(), rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/rows")).count() == 3


def test_streaming_counts_equal_batch(spark, sf_dir, tmp_path):
    from colloquy.sources import table
    from colloquy.streaming import sessions as streams

    events = table(spark, sf_dir, "events")
    events.write.parquet(str(tmp_path / "events"))
    stream = streams.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (str(r["window"]["start"]), r["event_type"], r["n"])
    assert sorted(map(key, spark.table("counts").collect())) == sorted(map(key, streams.windowed_counts(events).collect()))


def test_empty_tables(spark):
    turns = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert samples.context_windows(turns).count() == 0
    docs = spark.createDataFrame([], "k long, words array<string>")
    assert statistics.self_bleu(docs, "k").count() == 0
    pairs = spark.createDataFrame([], "k long, src string, mt string")
    assert translation.chunks(pairs, "k").count() == 0 and translation.zipped_lines(pairs, "k").count() == 0
