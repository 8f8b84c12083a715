"""Language field on held-out sentences, forward-backward against enumeration, and pair defects."""

import itertools
import json
import random

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import _text, fitting, language, minhash, pairing, reading

SENTENCES = {
    "en": ["I could not sleep last night because of the noise.", "My brother thinks that this is the best way to go.", "What would you like to talk about with her today?", "We went to the market and then we came back home."],
    "de": ["Ich konnte gestern Nacht wegen des Lärms nicht schlafen.", "Mein Bruder denkt, dass dies der beste Weg für uns ist.", "Worüber möchten Sie heute mit ihr sprechen, wenn Sie kommen?", "Wir sind auf den Markt gegangen und dann nach Hause gekommen."],
    "fr": ["Je ne pouvais pas dormir la nuit dernière à cause du bruit.", "Mon frère pense que c'est la meilleure façon de faire.", "De quoi aimeriez-vous parler avec elle aujourd'hui dans la maison?", "Nous sommes allés au marché et puis nous sommes rentrés."],
    "ar": ["لم أستطع النوم الليلة الماضية بسبب الضجيج في الشارع.", "أخي يعتقد أن هذه هي أفضل طريقة للذهاب.", "ماذا تريد أن تتحدث معها اليوم في البيت؟", "ذهبنا إلى السوق ثم عدنا إلى البيت."],
}


@pytest.fixture(scope="module")
def fitted(request):
    import duckdb

    sf = "/root/testdata/sf0.01"
    alias = dict(duckdb.sql(f"select alias, lang from '{sf}/lang_alias.parquet'").fetchall())
    rows = duckdb.sql(f"select lang, messages from '{sf}/processed_dataset.parquet' where messages is not null order by sample_id limit 600").fetchall()
    data = [([t for role, t in _text.turns_of(m) if role != "system" and t], alias.get((lang or "").strip().lower())) for lang, m in rows]
    return language.fit(data), pairing.Endings([ts for ts, _ in data])


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    scores, border = rng.normal(size=(1, 4, 4)).astype(np.float64), np.array([[True, False, True, False]])
    field = language.Field(np.zeros((1, 4)), rng.normal(size=4), rng.normal(size=(4, 4)), rng.normal(size=(4, 4)), {})
    weight = {}
    for path in itertools.product(range(4), repeat=4):
        w = field.start[path[0]] + sum(scores[0, t, k] for t, k in enumerate(path))
        w += sum((field.border if border[0, t] else field.inner)[path[t - 1], path[t]] for t in range(1, 4))
        weight[path] = np.exp(w)
    z = sum(weight.values())
    post, counts, logz = language.forward_backward(field, scores, border, np.array([4]), pairs=True)
    for t in range(4):
        for k in range(4):
            assert post[0, t, k] == pytest.approx(sum(w for p, w in weight.items() if p[t] == k) / z)
    assert logz[0] == pytest.approx(np.log(z))
    assert counts[1][1, 2] == pytest.approx(sum(w for p, w in weight.items() if p[1] == 1 and p[2] == 2) / z)


def test_other_texts(fitted):
    tagger = language.Tagger(fitted[0])
    texts = [(k, s) for k, ss in SENTENCES.items() for s in ss]
    memo = tagger.tag([s for _, s in texts])
    assert sum(language.LANGS[int(memo[s][0].argmax())] == k for k, s in texts) >= 14


def test_mixed_text_and_names(fitted):
    tagger = language.Tagger(fitted[0])
    text = SENTENCES["de"][0] + " Dr. Smith! " + SENTENCES["en"][3] + "\n" + SENTENCES["ar"][1]
    tagged = tagger.tag([text, "", "12 34"])[text]
    assert set(language.sentence_languages(tagged)) == {0, 1, 3}
    assert [s[2] for s in language.stretches(text, tagged)][-1] == "ar"
    assert language.sentence_languages(tagger.memo[""]) == {}


def test_unstated(spark, fitted):
    def row(i, lang, *texts):
        return i, lang, json.dumps([{"role": "system", "content": SENTENCES["en"][0]}, *[{"role": "user", "content": t} for t in texts]]), "x"

    de, fr = SENTENCES["de"][1], SENTENCES["fr"][1]
    rows = [row(1, "Deutsch ", de), row(2, "de", de, fr), row(3, None, de), row(4, "??", fr), row(5, "fr", de), row(6, "de", None, "laisser faire"), (7, "de", None, "x"), (8, "de", "broken", "x"), row(3, None, de)]
    df = spark.createDataFrame(rows, "sample_id long, lang string, messages string, language string")
    alias = spark.createDataFrame([("de", "de"), ("deutsch", "de"), ("fr", "fr")], "alias string, lang string")
    got = sorted(map(tuple, language.unstated_languages(df, alias, field=fitted[0]).collect()))
    assert got == [(2, "fr"), (3, "de"), (3, "de"), (4, "fr"), (5, "de")]
    assert language.unstated_languages(df.limit(0), alias).count() == 0
    docs = {r["sample_id"]: r["language"] for r in language.document_languages(df, fitted[0]).collect()}
    assert docs[1] == "de" and docs[7] is None


def test_sentence_ends(fitted):
    _, endings = fitted
    for whole in ("1. Eins ist da.\n2. Zwei ist da.", "Alles ist gut! 🌱", "Gut so. :)", "Ja. –", "Wirklich?”"):
        assert not pairing.unfinished(whole, endings)
    for cut in ("1. Eins ist da.\n2.", "Was haben Sie in der Küche kurz", "Ce que vous :", "Nächstes Mal nehmen «"):
        assert pairing.unfinished(cut, endings)


def test_defects(spark, fitted):
    ask = SENTENCES["de"][0] + " " + SENTENCES["de"][1]
    answers = {
        1: None,
        2: "Therapeut: [/END]",
        3: ask + " Ja.",
        4: "Sie sagen: „" + SENTENCES["de"][0] + "“ Das klingt sehr anstrengend, und ich möchte gern mehr darüber hören, wie es Ihnen geht.",
        5: SENTENCES["fr"][3],
        6: "I'm sorry, but as a language model I cannot give such replies. Please ask someone.",
        7: "Das ist gut.\n1. Schlafen Sie viel.\n2.",
        8: "Es tut mir leid zu hören, wie einsam Sie waren.",
        9: "​…",
        10: "Sie sagten, Ihr Bruder konnte Ihnen nicht helfen. Es muss schwer sein, eine Einladung abzulehnen.",
    }
    rows = [(i, json.dumps([{"role": "Client", "response": ask}, {"role": "Therapist", "response": a}] if a is not None else [{"role": "user", "content": ask}, {"role": "assistant"}]), "q") for i, a in answers.items()]
    rows += [(20, None, "q"), (21, "[]", "q"), (22, "{", "q"), (11, json.dumps([{"role": "user", "content": "Ja, gern."}, {"role": "assistant", "content": "ja gern!"}]), "q")]
    df = spark.createDataFrame(rows, "sample_id long, messages string, defect string")
    got = sorted(map(tuple, pairing.pair_defects(df, None, models=fitted).collect()))
    assert got == [(1, "empty"), (2, "empty"), (3, "copy"), (5, "other_language"), (6, "other_language"), (7, "truncated"), (9, "empty"), (11, "copy"), (21, "empty")]
    assert pairing.pair_defects(df.limit(0), None, models=fitted).count() == 0


def test_models_come_from_every_row(spark):
    # the words before an end stand once in each row, so any row left out shows in the counts
    def row(i):
        turns = [("user", SENTENCES["de"][i % 4]), ("assistant", f"{SENTENCES['de'][(i + 1) % 4]} Das ist gut so für heute{'.' if i % 3 else ''}")]
        return i, "de", json.dumps([{"role": r, "content": t} for r, t in turns])

    others = [(10_000 * n + i, k, json.dumps([{"role": "user", "content": s} for s in SENTENCES[k]])) for n, k in enumerate(("en", "fr", "ar"), 1) for i in range(2000)]
    df = spark.createDataFrame([row(i) for i in range(4000)] + others, "sample_id long, lang string, messages string").repartition(3)
    alias = spark.createDataFrame([(k, k) for k in SENTENCES], "alias string, lang string")
    field, endings = fitting.fit_corpus(df, alias)
    assert endings.counts["2", "fur", "heute"] == [0, sum(i % 3 > 0 for i in range(4000))]
    memo = language.Tagger(field).tag([s for ss in SENTENCES.values() for s in ss])
    assert all(language.LANGS[int(memo[s][0].argmax())] == k for k, ss in SENTENCES.items() for s in ss)


def test_fit_reads_its_rows_once(spark):
    rows = [(k, json.dumps([{"role": "user", "content": s} for s in ss])) for k, ss in SENTENCES.items() for _ in range(50)]
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "lang string, messages string").mapInArrow(passed, "lang string, messages string")
    fitting.fit_corpus(df, spark.createDataFrame([(k, k) for k in SENTENCES], "alias string, lang string"))
    assert read.value == len(rows)


def test_pair_defects_read_their_rows_once(spark):
    ask = [{"role": "user", "content": SENTENCES["de"][0]}]
    rows = [(i, "de", json.dumps([*ask, {"role": "assistant", "content": s}])) for i, s in enumerate([*SENTENCES["de"], SENTENCES["de"][0], "", SENTENCES["fr"][3]] * 20)]
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    schema = "sample_id long, lang string, messages string"
    df, alias = spark.createDataFrame(rows, schema).mapInArrow(passed, schema), spark.createDataFrame([(k, k) for k in SENTENCES], "alias string, lang string")
    got = pairing.pair_defects(df, alias)
    assert {(r["sample_id"], r["defect"]) for r in got.where("defect in ('copy', 'empty')").collect()} == {(i, "copy" if i % 7 in (0, 4) else "empty") for i in range(140) if i % 7 in (0, 4, 5)}
    assert read.value == len(rows)


def test_pieces_give_the_words_of_texts():
    rng = random.Random(7)
    parts = ["Ja", "ŒUVRE", "naïve", "3", "12", "a1", "1b", "٣", "ΟΔΟΣ", "شكرًا", "_", "e\u0301", "\u0323", "æ", "ß", "ue", ".", ".", ":", ",", "!", "؟", "…", "...", " ", " ", " ", "\n", "'", "’", "Client: ", "-"]
    texts = list(dict.fromkeys("".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(3000)))
    pack = reading.read([[("client", None), ("therapist", t)] for t in texts], pa.array(range(len(texts))), pairing.open_clause)
    pack = reading.Pack.loads(pack.dumps())
    spans = [[p[a:b] for a, b in _text.sentences(p)] for p in map(_text.plain, texts)]
    assert pack.parts.tolist() == list(map(len, spans))

    def per_text(split):
        names, flat, size = pack.stream(split)
        flat, many = _text.listed(flat, size, pack.sentences)
        return [[names[i] for i in x] for x in np.split(flat, np.cumsum(fitting._sums(many, pack.parts))[:-1])]

    assert per_text(reading.lower_words) == [[w.lower() for s in ss for w in _text.words(s)] for ss in spans]
    assert per_text(reading.folded_words) == [_text.words(_text.fold(_text.plain(t))) for t in texts]
    assert per_text(fitting.folded_tokens) == [[w for s in ss for w in pairing._fold_tokens(s)] for ss in spans]
    names, flat, size = pack.stream(reading.folded_words)
    flat, many = _text.listed(flat, size, pack.sentences)
    length = reading.sums(many, pack.parts)
    opened = pairing._Checks(None, None)._openings(pack, names, flat.tolist(), np.cumsum(length) - length, many, list(range(len(texts))))
    assert [opened[m] for m in range(len(texts))] == [pairing.opening(_text.plain(t)) for t in texts]


def test_batches_are_counted_whole(monkeypatch):
    monkeypatch.setattr(fitting, "PLACES", 7)
    rng = random.Random(5)
    texts = ["", "\n", "...", *("".join(rng.choice(["Ja", "ja", "nein", "so", "3.5", " ", " ", ".", ". ", "!\n", "\n", ", "]) for _ in range(12)) for _ in range(60))]
    rows = [(rng.choices(texts, k=rng.randrange(4)), rng.randrange(-1, 4)) for _ in range(80)]
    spans = {t: [t[a:b] for a, b in _text.sentences(t)] for t in texts}
    sentences = list(dict.fromkeys(s for ss in spans.values() for s in ss))
    messages = np.array([sentences.index(s) for t in texts for s in spans[t]]), np.array([len(spans[t]) for t in texts])
    held = np.array([texts.index(t) for ts, _ in rows for t in ts]), np.array([len(ts) for ts, _ in rows])
    counts = fitting._Counts(fitting._one_token)
    names, flat, size = counts.add([pairing.raw_tokens(s) for s in sentences], messages, held, np.array([k for _, k in rows]))
    tokens = [[w for t in ts for w in pairing._fold_tokens(t)] for ts, _ in rows]
    for w, n in counts.ids.words.items():
        assert counts.rows[n] == sum(w in ws for ws in tokens)
        assert counts.by_label[n].tolist() == [sum(ws.count(w) for ws, (_, k) in zip(tokens, rows) if k == label) for label in range(4)]
    known = {"ja", "nein", "#"}
    endings = pairing.Endings([])
    for ts, _ in rows:
        for t in ts:
            for clause, end in pairing.clauses(pairing._fold_tokens(t), known):
                for context in endings._contexts(clause):
                    endings.counts.setdefault(context, [0, 0])[end] += 1
    asked = rng.sample(list(endings.counts), len(endings.counts) // 2)
    flat, many = _text.listed(flat, size, messages[0])
    got = fitting._Asked(asked, known).count(names, flat, fitting._sums(many, messages[1]), np.bincount(held[0], minlength=len(texts)))
    assert dict(zip(asked, got.tolist())) == {c: endings.counts[c] for c in asked}
    assert fitting._Asked([], known).count(names, flat, fitting._sums(many, messages[1]), np.ones(len(texts))).shape == (0, 2)


def test_openings_fold_no_more_than_they_need(monkeypatch):
    folded, fold = [], _text.fold
    monkeypatch.setattr(_text, "fold", lambda t: folded.append(t) or fold(t))
    words = "ja gut ich mochte heute noch # dinge sagen".split()
    assert pairing._Openings()("Ja, gut. " + "Ich möchte heute noch 3 Dinge sagen. " * 50) == pairing._code(words)
    assert sum(map(len, folded)) < 60
    # a mark behind the stop is folded away, so the sentence ends there
    assert pairing._Openings()("Ich möchte heute noch etwas.\u0323 Ja.") == pairing._code("ich mochte heute noch etwas".split())


def test_copies():
    prompt = "ich habe den zug nach bern verpasst und im park geweint danach ging ich ohne mantel nach hause".split()
    assert pairing.copies(prompt + ["ja"], prompt)
    assert pairing.copies([w for i, w in enumerate(prompt) if i % 6 != 4], prompt)
    assert not pairing.copies(prompt[:9] + "das klingt sehr schwer und ich frage mich wie es ihnen damit heute geht".split(), prompt)
    assert not pairing.copies(prompt[:4], prompt) and not pairing.copies([], prompt) and not pairing.copies(prompt, [])


def refusal_rows(seed, template, dialogues=60):
    """Windows of dialogues with unrelated prompts; ordinary answers, also one that always says the same, stay in the
    history, while some windows end with ``template`` in place of their answer."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("bdfgklmnprst", k=3)) + "a" + "".join(rng.choices("aeiou", k=2)) for _ in range(900)]
    rows = []
    for d in range(dialogues):
        turns = []
        for k in range(5):
            topic = rng.choices(words, k=12)
            answer = "I am listening, please go on and take your time." if k == 2 else f"Part of you misses {topic[3]} and {topic[5]} a lot. Let us write about {topic[7]}."
            turns += [("user", " ".join(topic) + " happened."), ("assistant", answer)]
            window = turns[-7:]
            if k == 3 and d % 3 == 0:
                lead = ("", "Sorry, ", f"Part of you misses {topic[3]} and {topic[5]} a lot. ")[d // 3 % 3]
                window = window[:-1] + [("assistant", lead + template)]
            rows.append((d * 10 + k, json.dumps([{"role": r, "content": t} for r, t in window])))
    return rows


@pytest.mark.parametrize("template", ["I am going to pass on that one today and would rather leave it open my friend.", "Over such matters the answer shall stay with somebody else than me, so there.", "Dazu bleibt mein Blatt heute lieber ganz und gar leer, danke sehr."])
def test_recurring_templates_are_refusals(spark, fitted, template):
    rows = refusal_rows(3, template)
    df = spark.createDataFrame([*rows, (9990, rows[0][1].replace("Part of you", "You said you were unable to sleep last night, tell me more. Part of you"))], "sample_id long, messages string")
    got = {r["sample_id"] for r in pairing.pair_defects(df, None, models=fitted).where("defect = 'refusal'").collect()}
    assert got == {i for i, m in rows if template in m}
    clusters = pairing.opening_clusters(pairing.row_checks(df, *fitted)).collect()
    assert {r["prompts"] >= pairing.RECURS and r["answered"] == 0 for r in clusters if r["refuses"]} == {True}


def test_recurrence_decides_without_history(spark, fitted):
    rng = random.Random(2)
    template = "i am going to pass on that one today and would rather leave it open my friend"
    ask = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12)) for _ in range(300)]
    rows = [(i, json.dumps([{"role": "user", "content": a}, {"role": "assistant", "content": template + "." if i < 200 else f"so {a[:13]} is what you mean, then let us look at {a[20:33]} together."}])) for i, a in enumerate(ask)]
    got = {r["sample_id"] for r in pairing.pair_defects(spark.createDataFrame(rows, "sample_id long, messages string"), None, models=fitted).where("defect = 'refusal'").collect()}
    assert got == set(range(200))


def sets(spark, texts):
    known = {}
    codes = [minhash.shingles(np.array(minhash.word_codes(t.split(), known))) for t in texts]
    rows = [(i, [int(x) for x in dict.fromkeys(c.tolist())]) for i, c in enumerate(codes)]
    return rows, spark.createDataFrame(rows, "code long, shingles array<long>")


def test_links_lose_nothing(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=rng.randrange(3, 40))
        texts += [" ".join(base)] + [" ".join(w if rng.random() > 0.02 else rng.choice(words) for w in base + rng.choices(words, k=rng.randrange(3))) for _ in range(8)]
    rows, df = sets(spark, list(dict.fromkeys(texts)))
    near = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if len({*x} & {*y}) >= minhash.SIMILARITY * len({*x} | {*y})}
    found = {(r["a"], r["b"]) for r in minhash.links(df).collect()}
    assert found <= near and len(near) > 200

    def roots(pairs):
        least = {i: i for i, _ in rows}
        for _ in range(len(rows)):
            for a, b in pairs:
                least[a] = least[b] = min(least[a], least[b])
        return least

    assert roots(found) == roots(near)


def test_links_are_connected(spark):
    # the first text is similar to none of the others; two of them are similar through a third only
    tail = " ".join(f"w{i}" for i in range(60))
    texts = ["aaa " + " ".join(map(str, range(200, 230))), tail, *(" ".join([tail, *(f"v{i}" for i in range(n))]) for n in (9, 18)), "short", ""]
    rows, df = sets(spark, texts)
    assert [len(r[1]) for r in rows][-2:] == [1, 0]
    assert {(r["a"], r["b"]) for r in minhash.links(df).collect()} == {(1, 2), (2, 3)}
    assert minhash.links(df.limit(0)).count() == 0
