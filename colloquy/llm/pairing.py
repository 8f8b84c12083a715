"""Defects of prompt and response pairs (problem 2).

The last message of a sample is a therapist's response to the last client message before it. Copies, languages,
terminations and empty responses are judged per row in one narrow map. Refusals are templates: response openings are
clustered by verified MinHash, and a cluster is a refusal if it

* recurs across unrelated prompts,
* does not depend on them: its words stand in its own prompts no more often than in unrelated prompts of the same
  language, and
* is not what dialogues go on from: it hardly ever stands in the history of other samples, where ordinary responses
  stand as often as the corpus has it. (A refused turn is generated again before its dialogue continues.) A corpus
  without history leaves this test out.

Rows whose response holds a refusing template anywhere, behind a lead-in too, are refusals. No list of phrases is used.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import _text, graph, language, minhash, overlap, reading
from colloquy.session import fixed

#: A response copies its prompt if this share of its word trigrams stands in the prompt.
COPY_SHARE = 0.8
#: With a share from the first value on, it also copies it if the second share of its words stands there in order.
COPY_LEAST, COPY_ORDER = 0.45, 0.9
#: Below this probability of a sentence end the last words are broken off.
END_PROBABILITY = 0.48
OTHER_WORDS = 3

#: A template of refusal recurs across at least so many unrelated prompts.
RECURS = 4
#: Its words stand in its own prompts at most so many standard deviations more often than in unrelated ones.
DEVIATIONS = 2.0
#: Where ordinary openings would be expected in so many histories, it is found in at most this share of them. Corpora
#: with a smaller ratio of histories to responses than the last value have no history to speak of.
EXPECTED, ANSWERED, NO_HISTORY = 7.0, 0.1, 0.05
#: A response holds a template if it holds this share of its shingles.
HELD = 0.8
#: Opening words of fewer letters tell nothing of what a prompt is about.
TOPICAL_LETTERS = 4
#: Prompts a task keeps per language to compare openings with.
KEPT_PROMPTS = 8
#: Rows that are read at once.
PACK_ROWS = 10_000

_TOKEN = re.compile(r"[^\W\d_][^\W_]*|\d+(?:[:.,]\d+)*|[,،;؛:.!?؟…]")
_ENDS = frozenset(".!?؟")
_STOPS = _ENDS | frozenset(",،;؛…")
_LIST_TAIL = re.compile(r"(?:^|\n)\s*(?:\d{1,3}[.)]|[-*•])\s*$")
_DECOR = re.compile(r"[^\w.!?؟…]+$")


def raw_tokens(text: str) -> list[str]:
    """Folded words, numbers and stops."""
    return _TOKEN.findall(_text.fold(text))


def _fold_tokens(text: str) -> list[str]:
    return ["#" if t[0].isdigit() else t for t in raw_tokens(text)]


def _last_stop(text: str) -> int:
    """Place of the last stop of ``text`` but not of one inside a number; 0 if it has none."""
    at = len(text)
    while True:
        at = max(text.rfind(stop, 0, at) for stop in _STOPS)
        if at <= 0:
            return 0
        if not (text[at - 1].isdigit() and text[at + 1 : at + 2].isdigit()):
            return at


class Endings:
    """How often the words before a place stand at a sentence's end. Contexts reach from the last word to the last four
    and to the clause's first words with the last ones; numbers and words found in few rows form classes. The
    estimate interpolates from short to long contexts. Of a whole corpus they are counted by ``fitting``."""

    def __init__(self, rows: list[list[str]]):
        by_row = [[_fold_tokens(_text.plain(t)) for t in texts] for texts in rows]
        # names of people and places recur within a row only; words found in three rows stand for themselves
        freq = Counter(w for seqs in by_row for w in {w for s in seqs for w in s})
        self.known = {w for w, n in freq.items() if n >= 3}
        self.counts: dict[tuple, list[int]] = {}
        for tokens in (s for seqs in by_row for s in seqs):
            for clause, end in clauses(tokens, self.known):
                for context in self._contexts(clause):
                    self.counts.setdefault(context, [0, 0])[end] += 1

    @classmethod
    def of(cls, known: set[str], counts: dict[tuple, list[int]]) -> Endings:
        """Endings of counts made elsewhere; contexts that nothing asks for may be left out."""
        out = cls([])
        out.known, out.counts = known, counts
        return out

    @staticmethod
    def _contexts(clause: list[str]) -> list[tuple]:
        """Short contexts first; the letter tells the kind."""
        last, size = clause[-1], len(clause)
        found = [("1", last)]
        if size > 1:
            found.append(("2", clause[-2], last))
        if size > 2:
            found += [("3", *clause[-3:]), ("c", clause[0], clause[1], last)]
        if size > 3:
            found += [("4", *clause[-4:]), ("d", clause[0], clause[1], clause[2], clause[-2], last), ("e", clause[0], clause[1], clause[2], last)]
        return found

    def probability(self, text: str) -> float:
        """Probability that the last word of ``text`` ends a sentence."""
        return self.after(last_clause(text))

    def after(self, words: list[str]) -> float:
        """Probability that the last one of a clause's folded words ends a sentence."""
        clause = [w if w in self.known else "?" for w in words]
        if not clause:
            return 0.0
        p, mids, ends = 0.1, 0, 0
        for context in self._contexts(clause):
            mid, end = self.counts.get(context, (0, 0))
            if context[0] in "12":
                p = (end + 2 * p) / (mid + end + 2)
            else:
                mids, ends = mids + mid, ends + end
        return (ends + p) / (mids + ends + 1)


def clauses(tokens: list[str], known: set[str]) -> Iterator[tuple[list[str], bool]]:
    """The clause up to each word but a text's last token, and whether a sentence ends there. The list goes on to grow; it
    is read before the next one is taken."""
    clause: list[str] = []
    for word, after in zip(tokens, tokens[1:]):
        if word in _STOPS:
            clause = []
            continue
        clause.append(word if word in known else "?")
        yield clause, after in _ENDS


def last_clause(text: str) -> list[str]:
    """Folded words of the last clause of a text."""
    clause: list[str] = []
    for word in _fold_tokens(text[_last_stop(text) :]):
        if word in _STOPS:
            clause = []
        else:
            clause.append(word)
    return clause


def open_end(text: str) -> str | bool:
    """Whether a text is unfinished where its marks tell; else the text without marks, whose last words have to tell."""
    t = text.rstrip()
    # a mark behind a word leaves nothing to ask
    if t[-1:] in _ENDS and (t[-1] != "." or not (t[-2:-1] in (".", "…") or t[-2:-1].isdigit())):
        return False
    if _LIST_TAIL.search(t):
        return True
    core = _DECOR.sub("", t)
    if core.endswith(("...", "…")):
        core = core.rstrip(".…").rstrip()
    if not core or core[-1] in _ENDS:
        return False
    return core


def open_clause(text: str) -> str | bool:
    """``open_end`` with the words of the last clause in place of the text, between spaces."""
    core = open_end(text)
    return core if isinstance(core, bool) else " ".join(last_clause(core))


def unfinished(text: str, endings: Endings) -> bool:
    """Whether a response breaks off before its sentence or list is complete. ``text`` is plain (see ``_text.plain``)."""
    core = open_end(text)
    return core if isinstance(core, bool) else endings.probability(core) < END_PROBABILITY


def copies(response: list[str], prompt: list[str]) -> bool:
    """Whether a response (folded words) consists of hardly anything but the prompt. One of under five words copies the
    prompt only if it is the prompt."""
    if response == prompt:
        return bool(response)
    if len(response) < 5 or len(prompt) < 3:
        return False
    own = set(response)
    if len(own.intersection(prompt)) < 0.5 * len(own):
        return False
    seen = set(zip(prompt, prompt[1:], prompt[2:]))
    hit = [False] * len(response)
    for i, gram in enumerate(zip(response, response[1:], response[2:])):
        if gram in seen:
            hit[i] = hit[i + 1] = hit[i + 2] = True
    # a response that quotes one of several sentences goes on with its own words
    share = sum(hit) / len(response)
    if share >= COPY_SHARE or share < COPY_LEAST:
        return share >= COPY_SHARE
    # words left out break trigrams; the order of the words that stayed tells such a copy
    code: dict[str, int] = {}
    a, b = (np.array([code.setdefault(w, len(code)) for w in ws], np.int32) for ws in (response, prompt))
    return overlap.common_words(a, b) >= COPY_ORDER * len(response)


def opening(text: str) -> list[str]:
    """The folded words of a plain text's first sentence, of its first two where that has under five; numbers as ``#``."""
    words: list[str] = []
    for a, b in _text.each_sentence(text):
        # marks that folding takes away may have hidden an end
        folded = _text.fold(text[a:b])
        for c, d in _text.each_sentence(folded):
            words += ["#" if w.isdigit() else w for w in _text.words(folded[c:d])]
            if len(words) >= minhash.SHINGLE:
                return words
    return words


class _Codes(dict):
    """Codes of words above 0; with ``numbers`` all numbers are one word."""

    def __init__(self, numbers: bool):
        self.numbers = numbers

    def __missing__(self, word: str) -> int:
        w = "#" if self.numbers and word.isdigit() else word
        self[word] = code = minhash.word_codes([w], {})[0]
        return code


def _code(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - (1 << 63)


class _Openings:
    """Codes of the openings of messages, with a memo for the histories that windows of a dialogue share."""

    def __init__(self):
        self.memo: dict[str, int | None] = {}

    def __call__(self, text: str) -> int | None:
        if text not in self.memo:
            if len(self.memo) > 20_000:
                self.memo.clear()
            words = opening(_text.plain(text))
            self.memo[text] = _code(words) if words else None
        return self.memo[text]


def row_checks(samples: DataFrame, field: language.Field, endings: Endings, id_col: str = "sample_id", text_col: str = "messages", packs: DataFrame | None = None) -> DataFrame:
    """One row per sample, by a narrow map: ``id_col``; ``defects`` (all but refusals); ``code`` of the response's opening
    and, where the task has not given them out before, ``opening`` and its ``shingles``; ``held``, the shingles of the
    response; ``prompt``, a MinHash value of the prompt, equal for near copies; ``own`` and ``other``, how many topical
    words of the opening stand in its prompt and in an unrelated one of the same language; ``history``, the codes of the
    openings of earlier responses.

    Rows with null or unreadable messages are left out. A list without any message, or one that ends with a client,
    counts as an empty response. Where the last client message has no content, nothing is compared with it. Responses
    that are copies, and openings that are broken off, have no ``code``. A response of one or two words states no
    language. ``packs`` are the messages of ``samples`` as read by ``fitting.fit_pairs``; with them no text is read again.
    """
    field_key, shared = uuid.uuid4().hex, samples.sparkSession.sparkContext.broadcast(field)
    ends = samples.sparkSession.sparkContext.broadcast(endings)
    kind, packed = dict(samples.dtypes)[id_col], packs is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = _Checks(language.worker_tagger(field_key, shared), ends.value)
        for batch in batches:
            if packed:
                found = (reading.Pack.loads(x.as_py()) for x in batch.column(0))
            else:
                found = (reading.read(turns_without_system(part.column(1)), part.column(0), open_clause) for part in (batch.slice(at, PACK_ROWS) for at in range(0, batch.num_rows, PACK_ROWS)))
            for pack in found:
                columns = zip(*check(pack)) if len(pack.rows["row"]) else [()] * len(types)
                yield pa.RecordBatch.from_arrays([pack.rows["id"], *(pa.array(c, t) for c, t in zip(columns, types))], names=[id_col, *CHECKED])

    many = pa.list_(pa.int64())
    types = (pa.list_(pa.string()), pa.int64(), pa.string(), many, many, pa.int64(), pa.int32(), pa.int32(), many)
    schema = "defects array<string>, code bigint, opening string, shingles array<bigint>, held array<bigint>, prompt bigint, own int, other int, history array<bigint>"
    texts = packs.select("pack") if packed else samples.select(id_col, F.col(text_col).cast("string").alias("_text"))
    return texts.mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def turns_without_system(texts: pa.Array) -> Iterator[list[tuple[str, str | None]] | None]:
    """The turns of each text but system messages; None if it is unreadable."""
    for raw in texts.to_pylist():
        turns = _text.turns_of(raw)
        yield [t for t in turns if t[0] != "system"] if turns is not None else None


class _Checks:
    """The row checks of a task, pack by pack."""

    def __init__(self, tagger: language.Tagger, endings: Endings):
        self.tagger, self.endings = tagger, endings
        self.given: set[int] = set()
        self.said_codes, self.asked_codes = _Codes(numbers=True), _Codes(numbers=False)
        self.kept: dict[int, list[tuple[frozenset, frozenset]]] = {}

    def _languages(self, pack: reading.Pack, take: np.ndarray) -> np.ndarray:
        """Language of most words of the messages ``take``; -1 where they have none. Other messages get -2."""
        names, flat, size = pack.stream(reading.lower_words)
        held, parts = _text.listed(pack.sentences, pack.parts, take)
        flat, many = _text.listed(flat, size, held)
        edge = np.zeros(len(flat), bool)
        edge[(np.cumsum(many) - many)[many > 0]] = True
        n_words = self.tagger.counts(names, flat, edge, reading.sums(many, parts))
        out = np.full(len(pack.parts), -2)
        out[take] = np.where(n_words.any(axis=1), n_words.argmax(axis=1), -1)
        return out

    def _openings(self, pack: reading.Pack, names: list[str], flat: list[int], begin: np.ndarray, many: np.ndarray, take: list[int]) -> dict[int, list[str]]:
        """``opening`` of the messages ``take``, of ``many`` folded words in each sentence."""
        owner = np.repeat(np.arange(len(pack.parts)), pack.parts)
        upto = np.cumsum(many) - begin[owner]
        width = reading.sums(many, pack.parts)
        np.minimum.at(width, owner, np.where(upto >= minhash.SHINGLE, upto, len(flat)))
        word = ["#" if w.isdigit() else w for w in names]
        found = {m: [word[i] for i in flat[a : a + n]] for m, a, n in zip(take, begin[take].tolist(), width[take].tolist())}
        found.update((m, opening(text)) for m, text in pack.rows["odd"].items() if m in found)
        return found

    def __call__(self, pack: reading.Pack) -> Iterator[tuple]:
        names, flat, size = pack.stream(reading.folded_words)
        flat, many = _text.listed(flat, size, pack.sentences)
        length = reading.sums(many, pack.parts)
        begin = np.cumsum(length) - length
        rows = pack.rows
        lasts, prompts = (np.unique(x[x >= 0]) for x in (rows["last"], rows["prompt"]))
        spoken = rows["spoken"]
        lang = self._languages(pack, np.union1d(lasts, prompts)).tolist()
        for codes in (self.said_codes, self.asked_codes):
            if len(codes) > 250_000:
                codes.clear()
        said_of, asked_of = (np.fromiter(map(codes.__getitem__, names), np.int64, len(names)) for codes in (self.said_codes, self.asked_codes))
        held_of, sketch_of = ({m: x for m, x in zip(take.tolist(), minhash.shingle_runs(*_text.listed(of[flat], length, take)))} for of, take in ((said_of, lasts), (asked_of, prompts)))
        held_of = {m: list(dict.fromkeys(x.tolist())) for m, x in held_of.items()}
        sketch_of = {m: int(x.min()) if len(x) else 0 for m, x in sketch_of.items()}
        flat = flat.tolist()
        opened = self._openings(pack, names, flat, begin, many, np.union1d(lasts, pack.own[spoken]).tolist())
        code_of = {m: _code(words) if words else None for m, words in opened.items()}
        message = [flat[a : a + n] for a, n in zip(begin.tolist(), length.tolist())]
        begun = [list(map(self.said_codes.__getitem__, opened[m])) for m in lasts.tolist()]
        parts_of = dict(zip(lasts.tolist(), minhash.shingle_lists(begun)))
        ends = np.cumsum(pack.held)[rows["row"]]
        starts = ends - pack.held[rows["row"]]
        unfinished_of = [False, True, *(self.endings.after(c.split()) < END_PROBABILITY for c in rows["clauses"])]
        own_of, spoken, hashes = pack.own.tolist(), spoken.tolist(), rows["hash"].tolist()
        columns = (rows["last"], rows["prompt"], rows["state"], starts, ends - rows["cut"])
        for last, prompt, state, start, end in zip(*(x.tolist() for x in columns)):
            found = []
            said = message[last] if last >= 0 else []
            asked = message[prompt] if prompt >= 0 else []
            if not said:
                found.append("empty")
            else:
                if unfinished_of[state]:
                    found.append("truncated")
                if copies(said, asked):
                    found.append("copy")
                if prompt >= 0 and len(said) >= OTHER_WORDS and lang[last] != lang[prompt] and min(lang[last], lang[prompt]) >= 0:
                    found.append("other_language")
            words = opened[last] if last >= 0 else []
            code = text = parts = None
            if words and "copy" not in found and not ("truncated" in found and len(words) == len(said)):
                code = code_of[last]
                if code not in self.given:
                    self.given.add(code)
                    text = " ".join(words)
                    parts = list(dict.fromkeys(parts_of[last].tolist()))
            earlier = own_of[start:end]
            own = other = 0
            if prompt >= 0:
                # an unrelated prompt is one whose sample shares no message with this one
                dialogue = frozenset(map(hashes.__getitem__, earlier))
                ring = self.kept.setdefault(max(lang[prompt], 0), [])
                about = {w for w in words if len(w) >= TOPICAL_LETTERS} if code is not None else None
                unrelated = next((ws for ds, ws in ring if ds.isdisjoint(dialogue)), None) if about else None
                fresh = not ring or ring[-1][0].isdisjoint(dialogue)
                if unrelated is not None or fresh:
                    topics = frozenset(map(names.__getitem__, asked))
                    if unrelated is not None:
                        own, other = len(about & topics), len(about & unrelated)
                    if fresh:
                        ring.append((dialogue, topics))
                        del ring[:-KEPT_PROMPTS]
            history = [c for m, by in zip(earlier, spoken[start:end]) if by and (c := code_of[m]) is not None]
            yield found, code, text, parts, held_of.get(last, ()), sketch_of.get(prompt, 0), own, other, history


CHECKED = ("defects", "code", "opening", "shingles", "held", "prompt", "own", "other", "history")


def _sums(*keys: str):
    """Partial sums of the figures of openings."""
    return lambda df: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.bit_or("mask").alias("mask"), F.sum("own").alias("own"), F.sum("other").alias("other"), F.sum("h").alias("h"))


def opening_clusters(checked: DataFrame, keep=None) -> DataFrame:
    """Openings that may be refusals: ``code``, ``opening``, ``shingles``, ``cluster`` (the least code of the connected
    component of verified links) and figures of all openings that hold one of the cluster's: ``rows``, ``prompts``
    (unrelated ones, up to some 270: linear counting in 64 classes), ``own``, ``other``, ``answered`` (how often they
    stand in a history), ``expected`` (how often ordinary openings would) and ``refuses``.

    Candidates are clusters that recur and hardly stand in a history. They are judged together with the openings that
    hold them: other lead-ins add to a refusal's figures, while beginnings of ordinary sentences meet their histories.
    """
    keep = keep or (lambda df: df)
    counted = checked.where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.bit_or(F.expr("shiftleft(1L, cast(pmod(prompt, 64) as int))")).alias("mask"), F.sum("own").alias("own"), F.sum("other").alias("other"))
    texts = checked.where("opening is not null").select("code", "opening", "shingles").dropDuplicates(["code"])
    before = checked.select(F.explode("history").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("h"))
    stats = keep(counted.join(before, "code", "left").withColumn("h", F.coalesce("h", F.lit(0))).join(texts, "code"))
    # two numbers of the whole corpus
    total = stats.agg(F.sum("n").alias("n"), F.sum("h").alias("h")).first()
    ratio = (total["h"] or 0) / max(1, total["n"] or 0)
    expected = F.col("n") * F.lit(ratio)
    seldom = F.lit(ratio < NO_HISTORY) | (F.col("h") <= ANSWERED * expected)
    linked = graph.components(minhash.links(stats)).toDF("code", "cluster")
    members = stats.join(linked, "code", "left").withColumn("cluster", F.coalesce("cluster", "code"))
    open_to = _sums("cluster")(members).where((F.bit_count("mask") > 1) & seldom).select("cluster")
    candidates = keep(members.join(open_to, "cluster", "left_semi").select("cluster", "code", "opening", "shingles"))
    parts = candidates.select("cluster", F.col("code").alias("template"), F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
    hits = stats.select("code", F.explode("shingles").alias("s")).join(fixed(parts, 100_000), "s").groupBy("code", "cluster", "template", "size").agg(F.count(F.lit(1)).alias("k"))
    holders = hits.where(F.col("k") >= HELD * F.col("size")).select("code", "cluster").distinct()
    pooled = _sums("cluster")(holders.join(stats.drop("shingles", "opening"), "code"))
    free = F.greatest(F.lit(64) - F.bit_count("mask"), F.lit(1))
    prompts = F.round(-64 * F.log(free / F.lit(64.0))).cast("int")
    unrelated = (F.col("own") - F.col("other")) <= DEVIATIONS * F.sqrt(F.col("own") + F.col("other"))
    refuses = (prompts >= RECURS) & unrelated & seldom & (F.lit(ratio < NO_HISTORY) | (expected >= EXPECTED))
    judged = pooled.select("cluster", F.col("n").alias("rows"), prompts.alias("prompts"), "own", "other", F.col("h").alias("answered"), expected.alias("expected"), refuses.alias("refuses"))
    return candidates.join(judged, "cluster")


def refusals(checked: DataFrame, clusters: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """``id_col`` of the rows whose response opens with a refusing template or holds one anywhere.

    Templates are few and looked up by their shingles; a table of them beyond the size checked is joined by a shuffle.
    """
    templates = clusters.where("refuses").select(F.col("code").alias("template"), F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
    # rows are told apart before they are exploded, as ids may repeat
    held = checked.select(id_col, "held", F.monotonically_increasing_id().alias("_row")).select(id_col, "_row", F.explode("held").alias("s"))
    hits = held.join(fixed(templates, 100_000), "s").groupBy("_row", id_col, "template", "size").agg(F.count(F.lit(1)).alias("k"))
    inside = hits.where(F.col("k") >= HELD * F.col("size")).select(id_col)
    # templates of under five words have a shingle of their own kind, which no longer response holds
    opened = checked.select(id_col, "code").join(fixed(clusters.where("refuses").select("code"), 100_000), "code", "left_semi").select(id_col)
    return inside.unionByName(opened).distinct()


def pair_defects(samples: DataFrame, alias: DataFrame, glossary: DataFrame | None = None, id_col: str = "sample_id", text_col: str = "messages", models=None, keep=None) -> DataFrame:
    """``(id_col, defect)``: empty, truncated, refusal, copy, other_language; one row for each defect of a row.

    ``keep`` materialises the row checks and the clusters (a callable), so they run once; without it they may run again.
    """
    if models is None:
        from colloquy.llm import fitting

        models = fitting.fit_pairs(samples, alias, glossary, id_col, text_col)
    checked = row_checks(samples, *models[:2], id_col, text_col, *models[2:])
    checked = keep(checked) if keep else checked
    direct = checked.select(id_col, F.explode("defects").alias("defect"))
    clusters = opening_clusters(checked, keep)
    clusters = keep(clusters) if keep else clusters
    return direct.unionByName(refusals(checked, clusters, id_col).select(id_col, F.lit("refusal").alias("defect")))
