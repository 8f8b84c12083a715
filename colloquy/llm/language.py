"""Language of documents and of the stretches of mixed documents (problem 1).

A linear-chain conditional random field labels words. Emission features are affixes, character n-grams, script and a
lexicon; transitions (inside a sentence and across a sentence boundary) are learned with them. Words of code-switched
text are labelled by forward-backward, so every stretch comes with a posterior probability as its confidence.

The field is fitted on all rows (``fitting``); wrong labels are outvoted by the words of the whole corpus, then by the
field's own sentence labels. All statistics of the result cover every row.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import _text
from colloquy.session import small

LANGS = ("en", "de", "fr", "ar")
#: A sentence counts for a language from so many words on, if its words' mean posterior reaches this share.
SENTENCE_WORDS = 5
SENTENCE_SHARE = 0.6
BUCKETS = 1 << 16
#: Places of a padded block of sequences; a longer sequence forms a block of its own.
BLOCK = 60_000

_ARABIC = re.compile("[\u0600-\u06ff]")


@lru_cache(1 << 18)
def _hash(text: str) -> int:
    h = 2166136261
    for b in text.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 15)) & (BUCKETS - 1)


def bare(word: str) -> str:
    """Lower case without accents, as some writers leave them out."""
    return word if word.isascii() else _text.MARKS.sub("", unicodedata.normalize("NFKD", word))


@lru_cache(1 << 17)
def _own_features(word: str) -> tuple[str, tuple[int, ...]]:
    """The form of a word that the lexicon holds, and its features but for the lexicon's, script first."""
    low = word.lower()
    if low.isdigit():
        return "", (_hash("digit"),)
    script = "s=" + ("ar" if _ARABIC.search(low) else "lat" if low.isascii() else "acc")
    low = bare(low)
    padded = f"^{low}$"
    found = [script, "w=" + low]
    found += [f"p{n}=" + low[:n] for n in (1, 2, 3) if len(low) >= n]
    found += [f"e{n}=" + low[-n:] for n in (1, 2, 3, 4) if len(low) >= n]
    found += ["g=" + padded[i : i + 3] for i in range(len(padded) - 2)]
    return low, tuple(map(_hash, found))


def features(word: str, lexicon: dict[str, int]) -> tuple[int, ...]:
    """Hashed features of a word: itself, affixes, character n-grams, script and lexicon entry."""
    form, found = _own_features(word)
    entry = lexicon.get(form) if form else None
    return found if entry is None else (found[0], _hash(f"x={entry}"), *found[1:])


class Field:
    """Weights of the field and its inference. ``inner`` and ``border`` are log transition scores."""

    def __init__(self, weights: np.ndarray, start: np.ndarray, inner: np.ndarray, border: np.ndarray, lexicon: dict[str, int]):
        self.weights, self.start, self.inner, self.border, self.lexicon = weights, start, inner, border, lexicon

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(LANGS)), np.float32)
        rows = [features(w, self.lexicon) for w in words]
        flat = np.fromiter((f for r in rows for f in r), np.int64)
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        owner = np.repeat(np.arange(len(rows)), size)
        for k in range(len(LANGS)):
            out[:, k] = np.bincount(owner, self.weights[flat, k], len(rows))
        return out


def forward_backward(field: Field, scores: np.ndarray, border: np.ndarray, lengths: np.ndarray, pairs: bool = False):
    """Posteriors ``(B, T, L)`` of padded score rows ``(B, T, L)``; ``border[b, t]`` marks the first word of a sentence.

    With ``pairs`` also the expected transition counts (inner, border) and the log partition of each row.
    """
    rows, steps, width = scores.shape
    # places first, rows last: the operations of a place run along its rows
    scores, edges = np.ascontiguousarray(scores.transpose(1, 2, 0)), np.ascontiguousarray(border.T)
    top = scores.max(axis=1)
    e = np.exp(scores - top[:, None])
    inner, across, first = np.exp(field.inner).astype(e.dtype), np.exp(field.border).astype(e.dtype), np.exp(field.start).astype(e.dtype)
    onward, back = np.vstack([across.T, inner.T]), np.vstack([across, inner])
    alpha = np.empty_like(e)
    scale = np.empty((steps, rows), e.dtype)
    a = first[:, None] * e[0]
    for t in range(steps):
        if t:
            both = onward @ a
            a = np.where(edges[t], both[:width], both[width:]) * e[t]
        z = a.sum(axis=0)
        a = a / z
        alpha[t], scale[t] = a, z
    beta = np.ones((width, rows), e.dtype)
    post = np.empty_like(e)
    counts = [np.zeros((width, width)), np.zeros((width, width))] if pairs else None
    for t in range(steps - 1, -1, -1):
        if t < steps - 1:
            inside = t + 1 < lengths
            step = e[t + 1] * beta
            both = back @ step
            moved = np.where(edges[t + 1], both[:width], both[width:])
            if pairs:
                share = alpha[t] * (inside / (alpha[t] * moved).sum(axis=0)).astype(e.dtype)
                apart = share * edges[t + 1]
                counts[0] += ((share - apart) @ step.T) * inner
                counts[1] += (apart @ step.T) * across
            beta = np.where(inside, moved / moved.sum(axis=0) * width, 1.0).astype(e.dtype)
        p = alpha[t] * beta
        post[t] = p * ((t < lengths) / p.sum(axis=0)).astype(e.dtype)
    post = np.ascontiguousarray(post.transpose(2, 0, 1))
    if not pairs:
        return post
    mask = np.arange(steps)[:, None] < lengths
    return post, counts, ((np.log(scale) + top) * mask).sum(axis=0)


def _padded(sequences: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    out = np.zeros((len(sequences), max(1, int(lengths.max(initial=0)))), np.int64)
    mask = np.arange(out.shape[1])[None] < lengths[:, None]
    if lengths.any():
        out[mask] = np.concatenate(sequences)
    return out, lengths


def _blocks(order: list[int], lengths: list[int]) -> Iterator[list[int]]:
    """``order``, which is by length, in blocks that stay small when padded to their longest sequence."""
    block: list[int] = []
    for i in order:
        if block and (len(block) + 1) * lengths[i] > BLOCK:
            yield block
            block = []
        block.append(i)
    if block:
        yield block


def sentence_words(text: str) -> list[list[str]]:
    """Words of each sentence of a message."""
    return [_text.words(text[a:b]) for a, b in _text.sentences(text)]


def fit(rows: list[tuple[list[str], str | None]], glossary: dict[str, str] | None = None, passes: tuple[int, ...] = (10, 10)) -> Field:
    """Fit the field on ``(messages, label)`` rows; labels may be wrong or missing in part. Sentences are labelled by
    word counts over the labelled rows, then by the field itself between the ``passes`` (numbers of gradient steps).
    ``glossary`` maps words to languages."""
    vocab: dict[str, int] = {}
    seqs, borders, labels = [], [], []
    for messages, label in rows:
        for text in messages:
            ids, edge = [], []
            for ws in sentence_words(_text.plain(text)):
                for n, w in enumerate(ws):
                    ids.append(vocab.setdefault(w.lower(), len(vocab)))
                    edge.append(n == 0)
            if ids:
                seqs.append(ids)
                borders.append(edge)
                labels.append(LANGS.index(label) if label in LANGS else -1)
    width = len(LANGS)
    flat_weights = np.zeros((BUCKETS, width), np.float32)
    empty = Field(flat_weights, np.zeros(width), np.eye(width) * 2.0, np.eye(width), {})
    if not seqs:
        return empty
    words = list(vocab)
    flat_ids = np.fromiter((i for ids in seqs for i in ids), np.int64)
    flat_edge = np.fromiter((e for es in borders for e in es), bool)
    size = np.fromiter(map(len, seqs), np.int64)
    flat_edge[np.cumsum(size) - size] = True
    sentence = np.cumsum(flat_edge) - 1
    # sentence labels by word counts outvote wrong row labels before the field sees any of them
    gold = np.repeat(np.array(labels), size)
    for _ in range(3):
        seen = np.zeros((len(words), width))
        np.add.at(seen, (flat_ids[gold >= 0], gold[gold >= 0]), 1.0)
        share = (seen + 0.05) / (seen.sum(axis=0) + 0.05 * len(words))
        share = share / share.sum(axis=1, keepdims=True)
        votes = np.stack([np.bincount(sentence, np.log(share[flat_ids, k] + 0.02)) for k in range(width)], axis=1)
        gold = votes.argmax(axis=1)[sentence]
    # lexicon: glossary entries, and words found in sentences of one language (nearly) alone
    lexicon = {bare(w): int(share[i].argmax()) for w, i in vocab.items() if seen[i].sum() >= 6 and share[i].max() > 0.9}
    lexicon |= {bare(w): LANGS.index(g) for w, g in (glossary or {}).items() if g in LANGS and bare(w) not in lexicon}
    golds = np.split(gold, np.cumsum(size)[:-1])
    rows_of = [features(w, lexicon) for w in words]
    feat = np.fromiter((f for r in rows_of for f in r), np.int64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, rows_of), np.int64))

    packed = []
    for g in _blocks(np.argsort(size, kind="stable").tolist(), size.tolist()):
        ids, lengths = _padded([seqs[i] for i in g])
        edges, _ = _padded([borders[i] for i in g])
        truth, _ = _padded([golds[i] for i in g])
        truth[np.arange(ids.shape[1])[None] >= lengths[:, None]] = -1
        packed.append([ids, edges.astype(bool), lengths, truth])
    field = Field(flat_weights, np.zeros(width), np.eye(width) * 3.0, np.eye(width) * 2.0, lexicon)
    total = sum(int(p[2].sum()) for p in packed)
    state = None
    for turn, epochs in enumerate(passes):
        if turn:
            table = _word_scores(field, owner, feat, len(words))
            for p in packed:
                p[3] = _relabel(field, table, p)
        for _ in range(epochs):
            state = _step(field, packed, owner, feat, len(words), total, state)
    return field


def _word_scores(field: Field, owner: np.ndarray, feat: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, field.weights[feat, k], n) for k in range(len(LANGS))], axis=1).astype(np.float32)


def _step(field: Field, packed: list, owner, feat, n_words: int, total: int, state, table: np.ndarray | None = None, own: bool = False):
    """One full-batch Adam step on the conditional log-likelihood of the labelled positions. ``table``: the words' scores.
    With ``own`` the field labels the sentences itself (see ``_relabel``)."""
    width = len(LANGS)
    table = _word_scores(field, owner, feat, n_words) if table is None else table
    by_word = np.zeros((n_words, width))
    inner, border, start = np.zeros((width, width)), np.zeros((width, width)), np.zeros(width)
    for ids, edges, lengths, gold in packed:
        pick = (lengths > 0) if own else (gold[:, 0] >= 0) & (lengths > 0)
        if not pick.any():
            continue
        ids, edges, lengths, gold = ids[pick], edges[pick], lengths[pick], gold[pick]
        post, counts, _ = forward_backward(field, table[ids], edges, lengths, pairs=True)
        if own:
            gold = _labels(post, edges, lengths)
        live = np.arange(ids.shape[1])[None] < lengths[:, None]
        flat, truth = ids[live], np.maximum(gold[live], 0)
        diff = -post[live]
        diff[np.arange(len(flat)), truth] += 1
        for k in range(width):
            by_word[:, k] += np.bincount(flat, diff[:, k], n_words)
        head = np.zeros(len(flat), bool)
        head[np.cumsum(lengths) - lengths] = True
        start += diff[head].sum(axis=0)
        moves, across = truth[:-1] * width + truth[1:], edges[live][1:]
        for which, out in ((False, inner), (True, border)):
            out += np.bincount(moves[~head[1:] & (across == which)], minlength=width * width).reshape(width, width) - counts[int(which)]
    grad = np.stack([np.bincount(feat, by_word[owner, k], BUCKETS) for k in range(width)], axis=1)
    grads = [grad / total - 1e-6 * field.weights, start / total, inner / total, border / total]
    state = state or (0, [np.zeros_like(g) for g in grads], [np.zeros_like(g) for g in grads])
    t = state[0] + 1
    for i, (g, m, v, name) in enumerate(zip(grads, state[1], state[2], ("weights", "start", "inner", "border"))):
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        delta = (0.15 if i == 0 else 0.1) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        setattr(field, name, (getattr(field, name) + delta).astype(np.float32 if i == 0 else np.float64))
    return t, state[1], state[2]


def _relabel(field: Field, table: np.ndarray, packed: list) -> np.ndarray:
    """Labels of the field itself, one for all words of a sentence, by its mean posterior; ``table``: the words' scores."""
    ids, edges, lengths, _ = packed
    return _labels(forward_backward(field, table[ids], edges, lengths), edges, lengths)


def _labels(post: np.ndarray, edges: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    live = np.arange(edges.shape[1])[None] < lengths[:, None]
    first = edges.copy()
    first[:, 0] = True
    sentence = np.cumsum(first.ravel()) - 1
    sums = np.stack([np.bincount(sentence, post[:, :, k].ravel(), sentence[-1] + 1) for k in range(len(LANGS))], axis=1)
    return np.where(live, sums.argmax(axis=1)[sentence].reshape(edges.shape), -1)


class Tagger:
    """Worker-side inference with memos of word scores and of whole messages."""

    def __init__(self, field: Field):
        self.field = field
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1024, len(LANGS)), np.float32)
        self.memo: dict[str, tuple] = {}

    def _score(self, new: list[str]) -> None:
        if len(self.ids) + len(new) > 600_000:
            self.ids.clear()
        base = len(self.ids)
        while base + len(new) > len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[base : base + len(new)] = self.field.emissions(new)
        self.ids.update((w, base + i) for i, w in enumerate(new))

    def counts(self, names: list[str], words: np.ndarray, head: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Words per language of messages of ``length`` words, numbers of ``names``; ``head`` is set at a sentence's first."""
        if len(self.ids) + len(names) > 600_000:
            self.ids.clear()
        new = [w for w in names if w not in self.ids]
        if new:
            self._score(new)
        words = np.fromiter(map(self.ids.__getitem__, names), np.int64, len(names))[words]
        width = len(LANGS)
        out = np.zeros((len(length), width), np.int64)
        for group, lengths, flat in self._posteriors(words, head, length):
            row = np.repeat(np.arange(len(group)), lengths)
            out[group] = np.bincount(row * width + flat.argmax(axis=1), minlength=len(group) * width).reshape(-1, width)
        return out

    def _posteriors(self, words: np.ndarray, head: np.ndarray, length: np.ndarray) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Messages in groups: their numbers, lengths, and the posteriors of their words one after another."""
        begin = np.cumsum(length) - length
        for group in _blocks(np.argsort(length, kind="stable").tolist(), length.tolist()):
            lengths = length[group]
            place = np.arange(max(1, lengths.max()))
            live = place < lengths[:, None]
            at = np.where(live, begin[group][:, None] + place, 0)
            ids, border = (words[at], head[at] & live) if len(words) else (at, live)
            yield group, lengths, forward_backward(self.field, self.table[ids], border, lengths)[live]

    def tag(self, texts: list[str], sentences: bool = True) -> dict[str, tuple]:
        """For each distinct text ``(words per language, confidence per language, sentences)`` where sentences are
        ``(start, end, n_words, posteriors)`` with offsets in the plain text. Results of earlier calls are reused, so a
        tagger's calls agree on whether they ask for ``sentences``."""
        fresh = [t for t in dict.fromkeys(texts) if t not in self.memo]
        if fresh:
            if len(self.memo) > 15_000:
                self.memo.clear()
                fresh = list(dict.fromkeys(texts))
            for at in range(0, len(fresh), 4000):
                self._tag(fresh[at : at + 4000], sentences)
        return self.memo

    def _tag(self, texts: list[str], sentences: bool) -> None:
        spans, held = [], []
        numbers: dict[str, int] = {}
        parts: list[list[str]] = []
        for text in texts:
            flat = _text.plain(text)
            own = []
            for a, b in _text.sentences(flat):
                n = numbers.setdefault(flat[a:b], len(parts))
                if n == len(parts):
                    parts.append(_text.words(flat[a:b]))
                if parts[n]:
                    own.append((a, b, len(parts[n])))
                    held.append(n)
            spans.append(own)
        every = set(chain.from_iterable(parts))
        if len(self.ids) + len(every) > 600_000:
            self.ids.clear()
        new = [w for w in every if w not in self.ids]
        if new:
            self._score(new)
        width = len(LANGS)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        words, many = _text.listed(np.fromiter(map(self.ids.__getitem__, chain.from_iterable(parts)), np.int64, int(size.sum())), size, np.array(held, np.int64))
        head = np.zeros(len(words), bool)
        head[np.cumsum(many) - many] = True
        length = np.fromiter((sum(n for _, _, n in own) for own in spans), np.int64, len(spans))
        for group, lengths, flat in self._posteriors(words, head, length):
            best = flat.argmax(axis=1)
            row = np.repeat(np.arange(len(group)), lengths)
            n_words = np.bincount(row * width + best, minlength=len(group) * width).reshape(-1, width)
            mass = np.bincount(row * width + best, flat.max(axis=1), len(group) * width).reshape(-1, width)
            conf = mass / np.maximum(n_words, 1)
            if not sentences:
                self.memo.update((texts[i], (n_words[j], conf[j], ())) for j, i in enumerate(group))
                continue
            counts = np.fromiter((n for i in group for _, _, n in spans[i]), np.int64)
            starts = np.cumsum(counts) - counts
            sums = np.add.reduceat(flat, starts, axis=0) / counts[:, None] if len(starts) else np.zeros((0, width))
            k = 0
            for j, i in enumerate(group):
                own = spans[i]
                self.memo[texts[i]] = (n_words[j], conf[j], [(a, b, n, sums[k + m]) for m, (a, b, n) in enumerate(own)])
                k += len(own)


def sentence_languages(tagged: tuple, least: int = SENTENCE_WORDS, share: float = SENTENCE_SHARE) -> dict[int, float]:
    """Languages in which a tagged text holds a whole sentence, each with the best confidence."""
    out: dict[int, float] = {}
    for _, _, n, post in tagged[2]:
        if n >= least:
            k = int(post.argmax())
            if post[k] >= share:
                out[k] = max(out.get(k, 0.0), float(post[k]))
    return out


def stretches(text: str, tagged: tuple) -> list[tuple[int, int, str, float, int]]:
    """Single-language stretches ``(start, end, lang, confidence, n_words)``: runs of sentences of one language."""
    out: list[list] = []
    for a, b, n, post in tagged[2]:
        k = int(post.argmax())
        if out and out[-1][2] == LANGS[k]:
            last = out[-1]
            last[3] = (last[3] * last[4] + float(post[k]) * n) / (last[4] + n)
            last[1], last[4] = b, last[4] + n
        else:
            out.append([a, b, LANGS[k], float(post[k]), n])
    return [tuple(x) for x in out]


_WORKER: dict[str, Tagger] = {}


def worker_tagger(key: str, shared) -> Tagger:
    """One tagger per worker process and field, kept across tasks."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Tagger(shared.value)
    return _WORKER[key]


def glossary_words(glossary: DataFrame | None) -> dict[str, str]:
    """The words of the glossary by language (``?`` where languages share one)."""
    words: dict[str, str] = {}
    for r in small(glossary) if glossary is not None else ():
        for lang in LANGS:
            for w in _text.words((r.asDict().get(f"{lang}_term") or "").lower()):
                words[w] = lang if words.get(w, lang) == lang else "?"
    return words


def fit_field(samples: DataFrame, alias: DataFrame, glossary: DataFrame | None = None, text_col: str = "messages", label_col: str = "lang") -> Field:
    """The field fitted on all rows."""
    from colloquy.llm import fitting

    return fitting.fit_corpus(samples, alias, glossary, text_col, label_col, endings=False)[0]


def document_languages(samples: DataFrame, field: Field, id_col: str = "sample_id", text_col: str = "messages", keep: tuple[str, ...] = (), json: bool = True) -> DataFrame:
    """One row per row of ``samples``: ``id_col``, ``keep``, ``language``, ``confidence`` and ``languages``.

    ``language`` is that of most words with its mean posterior as ``confidence``; ``languages`` lists each language
    with a whole sentence of five or more words and the confidence of the best one. Null or unreadable texts give
    nulls and an empty list, texts without words likewise. System messages are left out. A narrow map, no shuffle.
    """
    field_key, shared = uuid.uuid4().hex, samples.sparkSession.sparkContext.broadcast(field)
    width = 1 + len(keep)
    item = pa.struct([("lang", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = worker_tagger(field_key, shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                lists = _lists(batch.column(width).to_pylist(), json)
                memo = tagger.tag([t for ts in lists for _, t in ts])
                language, confidence, found = [], [], []
                for ts in lists:
                    n = np.zeros(len(LANGS))
                    mass = np.zeros(len(LANGS))
                    best: dict[int, float] = {}
                    for _, t in ts:
                        tagged = memo[t]
                        n += tagged[0]
                        mass += tagged[0] * tagged[1]
                        for k, c in sentence_languages(tagged).items():
                            best[k] = max(best.get(k, 0.0), c)
                    k = int(n.argmax())
                    language.append(LANGS[k] if n[k] else None)
                    confidence.append(float(mass[k] / n[k]) if n[k] else None)
                    found.append([{"lang": LANGS[k], "confidence": c} for k, c in sorted(best.items())])
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(language, pa.string()), pa.array(confidence, pa.float64()), pa.array(found, pa.list_(item))], names=[id_col, *keep, "language", "confidence", "languages"])

    kinds = dict(samples.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep)) + ", language string, confidence double, languages array<struct<lang: string, confidence: double>>"
    return samples.select(id_col, *keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def _lists(values: list[str | None], json: bool) -> list[list[tuple[int, str]]]:
    if not json:
        return [[(0, v)] if v else [] for v in values]
    return [[(n, t) for n, (role, t) in enumerate(_text.turns_of(v) or ()) if role != "system" and t] for v in values]


def language_stretches(samples: DataFrame, field: Field, id_col: str = "sample_id", text_col: str = "messages") -> DataFrame:
    """Single-language stretches of every message: ``id_col``, ``message_no`` (position in the list), ``start``,
    ``end`` (in the message without markers and labels), ``lang``, ``confidence``, ``n_words``."""
    field_key, shared = uuid.uuid4().hex, samples.sparkSession.sparkContext.broadcast(field)
    kind = dict(samples.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = worker_tagger(field_key, shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                lists = _lists(batch.column(1).to_pylist(), True)
                memo = tagger.tag([t for ts in lists for _, t in ts])
                rows = [(i, no, *s) for i, ts in enumerate(lists) for no, t in ts for s in stretches(t, memo[t])]
                if rows:
                    cols = list(zip(*rows))
                    types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())
                    arrays = [pa.array(c, t) for c, t in zip(cols, types)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(arrays[0]), *arrays[1:]], names=[id_col, "message_no", "start", "end", "lang", "confidence", "n_words"])

    return samples.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, message_no int, start int, end int, lang string, confidence double, n_words int")


def unstated_languages(samples: DataFrame, alias: DataFrame, glossary: DataFrame | None = None, id_col: str = "sample_id", text_col: str = "messages", label_col: str = "lang", field: Field | None = None) -> DataFrame:
    """``(id_col, lang)`` for each language with a whole sentence that the row's label does not state. The alias
    dimension has a fixed size and is joined as such."""
    field = field or fit_field(samples, alias, glossary, text_col, label_col)
    tagged = document_languages(samples.withColumn("_label", F.lower(F.trim(F.col(label_col)))), field, id_col, text_col, keep=("_label",))
    names = alias.select(F.col("alias").alias("_label"), F.col("lang").alias("_stated")).dropDuplicates(["_label"])
    rows = tagged.select(id_col, "_label", F.explode("languages.lang").alias("lang")).join(names, "_label", "left")
    return rows.where("_stated is null or _stated <> lang").select(id_col, "lang")
