"""Full-text index against brute force; alignment against planted translations."""

import itertools
import json
import random

import numpy as np
import pytest

from colloquy.llm import align, overlap


def test_index_and_search():
    rng = np.random.default_rng(1)
    messages = [rng.integers(0, 3, int(n)).astype(np.int32) for n in rng.integers(5, 30, 12)]
    keys = np.arange(12, dtype=np.int64) * 7
    lists = [np.array([i, (i + 1) % 12]) for i in range(12)]
    shard = overlap.Shard.load(overlap.Shard.build(messages, keys, np.arange(12) * 3, np.zeros((12, overlap.BAG), np.uint8), lists))
    for p, code in enumerate(shard.codes.tolist()):
        assert shard.passage(p).tolist() == [*messages[code // 3].tolist(), *messages[(code // 3 + 1) % 12].tolist()]
        assert shard.totals[p] == len(shard.passage(p))
    assert shard.equal(np.array([21, 5])).tolist() == [3, -1]
    pattern = [np.concatenate([messages[3][:9], rng.integers(0, 3, 6).astype(np.int32), messages[5]]), messages[7]]
    sizes = np.array([len(m) for m in pattern])
    owner, places, low, high = shard.matches(np.concatenate(pattern), np.cumsum(sizes) - sizes, sizes)
    for k, whole in enumerate(pattern):
        # places of runs of five words, once for each place in a message that holds them
        got, want = np.zeros(12, int), np.zeros(12, int)
        for n, a, b in zip(places[owner == k], low[owner == k], high[owner == k]):
            np.add.at(got, shard.passages[shard.spread[a] : shard.spread[b]], n)
        for i in range(len(whole) - 4):
            for p, code in enumerate(shard.codes.tolist()):
                for text in (messages[m] for m in lists[code // 3]):
                    want[p] += sum(text[j : j + 5].tolist() == whole[i : i + 5].tolist() for j in range(len(text) - 4))
        assert got.tolist() == want.tolist() and len(places) < places.sum()
    for m in range(12):
        assert {int(shard.codes[p]) // 3 for p in shard.passages[shard.held[m] : shard.held[m + 1]]} == {m, (m - 1) % 12}


def test_shards_of_neighbouring_rows_hold_each_message_once(spark, tmp_path):
    # windows of dialogues, of which each message stands in up to three
    def text(d, k):
        return " ".join(f"w{chr(97 + d)}{chr(97 + k)}{chr(97 + i)}" for i in range(20))

    rows = [(10 * d + k, sample(*[text(d, k + j) for j in range(3)])) for d in range(8) for k in range(6)]
    df = spark.createDataFrame(rows, "sample_id long, messages string").coalesce(1)
    chars = sum(len(m) for _, m in rows) // 4
    overlap.evaluation_messages(df, "sample_id", "messages", chars // overlap.CHUNKS).write.parquet(f"file://{tmp_path}/messages")
    messages = spark.read.parquet(f"file://{tmp_path}/messages")
    index = [overlap._read(f) for f in overlap.build_index(messages, f"file://{tmp_path}/index", overlap.shards_of(messages, chars))]
    assert len(index) >= 4 and sum(len(s.codes) for s in index) == len(rows)
    # a message stands in two shards at most, where a dialogue is cut, and not in every shard that its windows fall into
    assert sum(len(s.words) for s in index) <= 20 * (8 * 8 + 2 * (len(index) - 1))


def test_common_words():
    rng = random.Random(0)
    for _ in range(30):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert overlap.common_words(np.array(a, np.int32), np.array(b, np.int32)) == table[-1][-1]


def sample(*texts):
    return json.dumps([{"role": "system", "content": "be kind"}, *[{"role": "user" if i % 2 == 0 else "assistant", "content": t} for i, t in enumerate(texts)]])


def test_overlaps(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]

    def text(n=40):
        return " ".join(rng.choices(words, k=n))

    a, b, c = text(), text(), text()
    edited = " ".join(w for i, w in enumerate(a.split()) if i % 13 != 5) + " also"
    rows = [
        (1, "train", sample(a, b)), (2, "dev", sample(a, b)), (3, "test", sample(edited.upper(), "Therapist: " + b)), (4, "dev", sample(a, c)), (5, "dev", sample(text(), b)),
        (6, "train", sample(a, b)), (7, "train", sample(text(), text())), (8, "train", None), (9, "dev", "[]"), (10, None, sample(a, b)), (11, "train", sample(c, text(), a, b)), (12, "dev", sample(a)), (13, "train", sample(a)), (13, "train", sample(a)), (2, "dev", sample(a, b)),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "sample_id long, split string, messages string, share string")
    rows = overlap.cross_split_overlaps(df).collect()
    got = {(r["train_id"], r["eval_id"]) for r in rows}
    assert got == {(1, 2), (1, 3), (6, 2), (6, 3), (13, 12)} and len(rows) == len(got)
    monkeypatch.setattr(overlap, "OCCURRENCES", 3)
    sharded = {(r["train_id"], r["eval_id"]) for r in overlap.cross_split_overlaps(df, shard_chars=900).collect()}
    assert sharded == got
    assert overlap.cross_split_overlaps(df.limit(0)).count() == 0
    assert overlap.cross_split_overlaps(df.where("split = 'train'")).count() == 0


def test_many_near_copies(spark):
    rng = random.Random(8)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    base = [rng.choices(words, k=40), rng.choices(words, k=45)]

    def copy():
        return sample(*[" ".join(w if rng.random() > 0.04 else rng.choice(words) for w in m) for m in base])

    rows = [(i, "train" if i % 2 else "dev", copy()) for i in range(120)] + [(200 + i, "dev", sample(" ".join(rng.choices(words, k=50)), " ".join(rng.choices(words, k=50)))) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id long, split string, messages string")
    ids = overlap.WordIds()
    bodies = {i: [w for w in map(ids, overlap.passage(m))] for i, _, m in rows}
    flat = {i: (np.concatenate(p), len(p[-1])) for i, p in bodies.items()}
    want = {(a, b) for a, s, _ in rows if s == "train" for b, t, _ in rows if t == "dev" and overlap._compare(*flat[a], *flat[b])}
    got = {(r["train_id"], r["eval_id"]) for r in overlap.cross_split_overlaps(df).collect()}
    assert got == want and len(want) > 2000


def test_large_family_with_shared_edits(spark):
    rng = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    base = [rng.choices(words, k=40), rng.choices(words, k=45)]

    def copy():
        # one edit a message, of a thousand: each also stands in some three other rows, others for either message
        texts = [list(m) for m in base]
        for m in texts:
            m[rng.randrange(40)] = f"edit{chr(97 + rng.randrange(25))}"
        return sample(*map(" ".join, texts))

    rows = [(i, "dev", copy()) for i in range(3000)] + [(5000 + i, "train", copy()) for i in range(12)]
    df = spark.createDataFrame(rows, "sample_id long, split string, messages string")
    got = {(r["train_id"], r["eval_id"]) for r in overlap.cross_split_overlaps(df).collect()}
    assert got == {(5000 + t, e) for t in range(12) for e in range(3000)}


def test_overlaps_of_the_table_against_brute_force(spark, sf_dir):
    from colloquy.sources import table

    df = table(spark, sf_dir, "processed_dataset")
    got = {(r["train_id"], r["eval_id"]) for r in overlap.cross_split_overlaps(df).collect()}
    ids = overlap.WordIds()
    bodies = []
    for r in df.select("sample_id", "split", "messages").collect():
        parts = [w for w in map(ids, overlap.passage(r["messages"])) if len(w)]
        if parts:
            bodies.append((r["sample_id"], r["split"], np.concatenate(parts), len(parts[-1])))
    train, held = [x for x in bodies if x[1] == "train"], [x for x in bodies if x[1] != "train"]
    want = {(a[0], b[0]) for a in train for b in held if overlap._compare(a[2], a[3], b[2], b[3])}
    assert got == want


@pytest.mark.parametrize("text,want", [("Client: Hallo du! Wie geht es?\n\n12\nTherapist: Gut. :)", ["Hallo du!", "Wie geht es?", "Gut."]), (None, []), ("Client:\n3. \n!", []), ("a.b c", ["a.b c"]), ("هل؟ نعم.", ["هل؟", "نعم."])])
def test_numbering(text, want):
    assert align.numbered_sentences(text) == want


def test_assignment_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        w = rng.normal(size=(n, m)).round(2)
        best = 0.0
        rows = list(range(n))
        for k in range(1, min(n, m) + 1):
            for r in itertools.combinations(rows, k):
                for c in itertools.permutations(range(m), k):
                    best = max(best, sum(w[i, j] for i, j in zip(r, c)))
        assert sum(w[i, j] for i, j in align.assignment(w)) == pytest.approx(best)


def test_names_across_scripts():
    assert align.consonants("pomarbelvik") == align.consonants("بوماربيلفيك")
    assert align.consonants("guhavel") == align.consonants("غوهافيل")


def planted(n=60, seed=4):
    rng = random.Random(seed)
    verbs = [(f"verb{chr(97 + i)}", f"tun{chr(97 + i)}") for i in range(12)]
    nouns = [(f"thing{chr(97 + i)}", f"ding{chr(97 + i)}") for i in range(16)]
    rows, truth = [], set()
    for k in range(n):
        src, mt, links = [], [], []
        for i in range(rng.randrange(4, 9)):
            v, o, num = rng.choice(verbs), rng.choice(nouns), rng.randrange(1, 9999)
            src.append(f"The man {v[0]} a {o[0]} at {num}.")
            mt.append((f"Der Mann {v[1]} um {num} ein {o[1]}.", [i]))
        if rng.random() < 0.5:
            mt.pop(rng.randrange(len(mt)))  # left out
        if rng.random() < 0.5:
            i = rng.randrange(len(mt) - 1)
            mt[i], mt[i + 1] = mt[i + 1], mt[i]  # moved
        if rng.random() < 0.5:
            i = rng.randrange(len(mt) - 1)
            mt[i : i + 2] = [(mt[i][0][:-1] + ", und " + mt[i + 1][0], mt[i][1] + mt[i + 1][1])]  # merged
        links = [(k, s, j) for j, (_, own) in enumerate(mt) for s in own]
        rows.append((k, "\n".join(src), " ".join(t for t, _ in mt), "en", None if k % 9 == 0 else "de"))
        truth.update(links)
    return rows, truth


def test_alignment_of_planted_pairs(spark):
    rows, truth = planted()
    rows += [(900, None, "x", "en", "de"), (901, "", "Der Mann.", "en", "de"), (902, "123", "456", "en", "de")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "pair_id long, src string, mt string, src_lang string, mt_lang string, score string")
    got = {(r["pair_id"], r["src_no"], r["mt_no"]) for r in align.sentence_pairs(df).collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.95 * len(got)
    assert align.sentence_pairs(df.limit(0)).count() == 0


def test_components(spark):
    from colloquy.llm import graph

    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(i, i + 1) for i in range(500, 540)]
    least = {n: n for pair in links for n in pair}
    for _ in range(60):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    linked = {n for a, b in links if a != b for n in (a, b)}
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r[0], r[1]) for r in got} == {(n, least[n]) for n in linked} and len(got) == len(linked)
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_counts_do_not_depend_on_how_they_are_held(monkeypatch):
    rng = np.random.default_rng(2)
    blocks = [(np.sort(rng.choice(30, 6, replace=False)), np.sort(rng.choice(40, 9, replace=False)), rng.integers(0, 3, (6, 9)).astype(np.int32)) for _ in range(50)]
    found = []
    for cells in (2000, 0):
        monkeypatch.setattr(align, "DENSE_CELLS", cells)
        monkeypatch.setattr(align, "HELD_CODES", 100)
        counts = align._Counts(30, 40)
        for block in blocks:
            counts.add(*block)
        found.append([x.tolist() for x in counts.merge()])
    assert found[0] == found[1] and sum(found[0][1]) == sum(int(c.sum()) for _, _, c in blocks)


def test_windows_are_about_the_same_place():
    low, high = align._windows(10, 30)
    assert (low < high).all() and low[0] == 0 and high[-1] == 30 and (np.diff(low) >= 0).all()
    assert all(lo <= (i + 0.5) * 3 <= hi for i, (lo, hi) in enumerate(zip(low, high)))


def test_spans_compete_with_their_sentences():
    units = [(0,), (1,), (2,), (0, 1)]
    single = [(0,), (1,), (2,)]
    weight = np.full((4, 3), -1.0)
    weight[0, 0], weight[1, 1], weight[3, 0] = 0.4, 0.3, 0.5
    assert align.exclusive_assignment(weight, units, single) == [(0, 0), (1, 1)]
    weight[1, 1], weight[2, 2] = 0.05, 0.2
    assert align.exclusive_assignment(weight, units, single) == [(2, 2), (3, 0)]
    assert align.exclusive_assignment(weight.T, single, units) == [(0, 3), (2, 2)]
    rng = np.random.default_rng(7)
    for _ in range(30):
        chosen = align.exclusive_assignment(rng.normal(size=(4, 3)), units, single)
        taken = [i for u, _ in chosen for i in units[u]]
        assert len(taken) == len(set(taken)) and len({j for _, j in chosen}) == len(chosen)
