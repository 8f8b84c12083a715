"""Sentence alignment of rough translations (problem 4).

A lexicon is induced from all pairs: words that occur in sentences at about the same place of both sides are counted,
and word pairs with a significant log-likelihood ratio keep a strength. Sentence pairs, and spans of neighbouring
sentences merged, are scored by the words they cover of each other; equal numbers and names (also in another script)
count as translations. The pairs of a document come from a maximum-weight assignment with a cost for staying alone, in
which spans are candidates beside their sentences.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import _text
from colloquy.session import fixed, shared_dir, small

#: Documents a word must occur in to take part in the lexicon; fewer give no significant ratio.
LEAST_DOCUMENTS = 4
#: Words of all languages together that workers are meant to hold.
MOST_WORDS = 4_000_000
#: Half width of the band of sentences that count as "about the same place": at least so many, and a share of the side.
BAND, BAND_SHARE = 2, 0.06
#: Significance of a word pair (0.001 with one degree of freedom) and least strength that is kept.
SIGNIFICANT, LEAST_STRENGTH = 10.83, 0.08
#: Words found in more than one of so many windows tell less and less about their sentence.
COMMON = 10
#: What a sentence gains by staying alone: pairs scoring below stay apart.
NULL_SCORE = 0.3
#: Share of a merged sentence that a further sentence must render in addition to those found.
GAIN = 0.12
#: Words in under this share of a language's documents count as names; sides whose paired sentences share fewer than
#: ``FOREIGN`` of their numbers and names belong to different texts.
RARE_SHARE, FOREIGN = 0.005, 0.35

_BREAK = re.compile("[\r\n\u2028\u2029]+|(?<=[.!?\u061f])(?=\\s)")
_LABEL = re.compile(r"\s*(?:" + "|".join(sorted(_text.LABELS, key=len, reverse=True)) + r")\s*[:：]\s*", re.I)
_LETTER = re.compile(r"[^\W\d_]")


def numbered_sentences(text: str | None) -> list[str]:
    """Sentences in order: each ends after ``. ! ? ؟`` before white space or the end, and at a line break; speaker
    labels are cut off, pieces without a letter are not numbered. Null gives none."""
    out = []
    for piece in _BREAK.split(text or ""):
        m = _LABEL.match(piece)
        while m:
            piece = piece[m.end() :]
            m = _LABEL.match(piece)
        if _LETTER.search(piece):
            out.append(piece.strip())
    return out


# Consonants of Arabic letters as Latin classes; long vowels fall away like Latin vowels.
_ARABIC_CONSONANTS = {"ب": "b", "ت": "t", "ث": "t", "ج": "g", "ح": "h", "خ": "h", "د": "d", "ذ": "d", "ر": "r", "ز": "z", "س": "s", "ش": "s", "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ع": "", "غ": "g", "ف": "f", "ق": "k", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "ة": "", "و": "", "ي": "", "ا": "", "ى": "", "ء": ""}
_LATIN_CLASSES = str.maketrans({"p": "b", "v": "f", "q": "k", "c": "k", "j": "g", **dict.fromkeys("aeiouyw", "")})


@lru_cache(maxsize=200_000)
def consonants(word: str) -> str:
    """Consonant classes of a folded word, the same in Latin and Arabic script."""
    if word.isascii():
        return word.translate(_LATIN_CLASSES)
    return "".join(_ARABIC_CONSONANTS.get(c, c) for c in word)


class Lexicon:
    """Vocabulary (language and word to id, document and sentence counts), and strengths of word pairs by language pair,
    as a worker holds them: one language pair at a time, both ways, read when a document asks for it."""

    def __init__(self, vocabulary: dict[str, dict[str, tuple[int, int, int]]], load: Callable[[int], tuple[np.ndarray, ...]] | None = None):
        self.vocabulary = vocabulary
        self.size = 1 + max((i for words in vocabulary.values() for i, _, _ in words.values()), default=0)
        totals = {lang: words.get("", (0, 1, 1)) for lang, words in vocabulary.items()}
        self.documents = {lang: n for lang, (_, n, _) in totals.items()}
        self.sentences = {lang: k for lang, (_, _, k) in totals.items()}
        self.number = {lang: i for i, lang in enumerate(sorted(vocabulary))}
        self.load = load
        self.open: dict[tuple[str, str], tuple[np.ndarray, ...]] = {}

    def pair(self, source: str, target: str) -> int:
        return self.number[source] * len(self.number) + self.number[target]

    def entries(self, source: str, target: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Target words and strengths of all source words, and where those of each source word begin."""
        if (source, target) not in self.open:
            if (target, source) not in self.open:
                self.open.clear()
            s, t, strength = self.load(self.pair(source, target))
            order = np.argsort(s, kind="stable")
            self.open[source, target] = t[order], strength[order], np.searchsorted(s[order], np.arange(self.size + 1))
        return self.open[source, target]

    def language(self, stated: str | None, words: set[str]) -> str:
        """The stated language, or the one whose documents use the words most."""
        if stated in self.vocabulary:
            return stated
        best, top = "", -math.inf
        for lang in sorted(self.vocabulary):
            known, n = self.vocabulary[lang], self.documents[lang]
            score = sum(math.log((known[w][1] if w in known else 0.1) / n) for w in words if not w.isdigit())
            if score > top:
                best, top = lang, score
        return best


def _tokens(sentence: str) -> list[str]:
    return list(dict.fromkeys(_text.words(_text.fold(_text.plain(sentence)))))


def _windows(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` sentences the range of the other side's ``m`` sentences at about the same place."""
    centre = (np.arange(n) + 0.5) * m / n
    half = max(BAND, BAND_SHARE * m)
    return np.maximum(0, (centre - half - 0.5).astype(np.int64)), np.minimum(m, (centre + half + 0.5).astype(np.int64) + 1)


def _files(path: str) -> list[pa.Table]:
    files, inner = pyarrow.fs.FileSystem.from_uri(path)
    out = []
    for found in files.get_file_info(pyarrow.fs.FileSelector(inner, recursive=True, allow_not_found=True)):
        if found.path.endswith(".parquet"):
            with files.open_input_file(found.path) as f:
                out.append(pq.ParquetFile(f).read())
    return out


_LOADED: dict[tuple[str, str | None], Lexicon] = {}


def _lexicon(words: str, pairs: str | None = None) -> Lexicon:
    if (words, pairs) not in _LOADED:
        _LOADED.clear()
        vocabulary: dict[str, dict[str, tuple[int, int, int]]] = {}
        for t in _files(words):
            for i, lang, word, n, k in zip(*(t.column(c).to_pylist() for c in ("id", "lang", "word", "n", "k"))):
                vocabulary.setdefault(lang, {})[word] = (i, n, k)

        def load(pair: int) -> tuple[np.ndarray, ...]:
            parts = [[t.column(c).to_numpy() for c in ("s", "t", "strength")] for t in _files(f"{pairs}/pair={pair}") if t.num_rows]
            return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))

        _LOADED[words, pairs] = Lexicon(vocabulary, load)
    return _LOADED[words, pairs]


def document_words(pairs: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``n``, ``k``: in how many documents and sentences of a language a word occurs; numbers are
    left out. The empty word holds the numbers of documents and sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents: Counter = Counter()
            sentences: Counter = Counter()
            for src, mt, sl, ml in zip(*(batch.column(c).to_pylist() for c in range(4))):
                for text, lang in ((src, sl), (mt, ml)):
                    if text and lang:
                        by_sentence = [_tokens(s) for s in numbered_sentences(text)]
                        for ws in by_sentence:
                            sentences.update((lang, w) for w in ws if not w.isdigit())
                        documents.update((lang, w) for w in {w for ws in by_sentence for w in ws} if not w.isdigit())
                        sentences[lang, ""] += len(by_sentence)
                        documents[lang, ""] += 1
            if documents:
                langs, words = zip(*documents)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(documents.values(), pa.int64()), pa.array([sentences[x] for x in documents], pa.int64())], names=["lang", "word", "n", "k"])

    found = pairs.mapInArrow(run, "lang string, word string, n bigint, k bigint")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where((F.col("n") >= LEAST_DOCUMENTS) | (F.col("word") == ""))


def _alike(a: set[str], b: set[str]) -> set[str]:
    """Words of both sides that the other side has alike (names, mostly): the scores know them without a lexicon."""
    left, right = {consonants(w) for w in a}, {consonants(w) for w in b}
    both = {c for c in left & right if len(c) >= 3}
    return {w for w in a if (len(w) > 3 and w in b) or consonants(w) in both} | {w for w in b if (len(w) > 3 and w in a) or consonants(w) in both}


#: Cells of a table of word pairs that is held as such; larger ones are held by the cells that occur.
DENSE_CELLS = 12_000_000
#: Cells held by what occurs before they are summed up, and given out.
HELD_CODES = 1_500_000


class _Counts:
    """Counts of the word pairs of one pair of languages, summed up within a task: most repeat and leave it once."""

    def __init__(self, rows: int, columns: int):
        self.columns = columns
        self.table = np.zeros((rows, columns), np.int32) if rows * columns <= DENSE_CELLS else None
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, rows: np.ndarray, columns: np.ndarray, counts: np.ndarray) -> None:
        """Add a block of counts; ``rows`` and ``columns`` do not repeat."""
        if self.table is not None:
            self.table[np.ix_(rows, columns)] += counts
            return
        i, j = np.nonzero(counts)
        self.parts.append((rows[i] * self.columns + columns[j], counts[i, j].astype(np.int64)))
        self.size += len(i)
        if self.size > 2 * HELD_CODES:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of cells (row times columns, plus column) and their counts."""
        if self.table is not None:
            codes = np.flatnonzero(self.table)
            return codes, self.table.ravel()[codes].astype(np.int64)
        codes, n = (np.concatenate(c) for c in zip(*self.parts))
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        self.parts = [(codes[first], np.add.reduceat(n, first))]
        self.size = len(first)
        return self.parts[0]


def _presence(sentences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words of a document with 0 before them, and which sentence holds which; 0 is held by all."""
    words, place = np.unique(np.concatenate(sentences), return_inverse=True)
    held = np.zeros((len(sentences), len(words) + 1), np.float32)
    held[:, 0] = 1
    held[np.repeat(np.arange(len(sentences)), [len(x) for x in sentences]), place + 1] = 1
    return np.r_[0, words], held


def cooccurrences(pairs: DataFrame, words: str) -> DataFrame:
    """``pair``, ``s``, ``t``, ``n``: source sentences with word ``s`` whose window on the other side holds ``t``.
    ``pair`` is a number for both languages. ``t`` = -1 and ``s`` = -1 hold the marginals of the other word, both -1
    the number of sentences. The counts of a document are one product of two tables; rows of a task are taken by pair of
    languages, so that few pairs' counts are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(words)
        # words by number within their language, from 1 on
        local = {lang: {w: k for k, w in enumerate(sorted(known), 1)} for lang, known in lexicon.vocabulary.items()}
        ids = {lang: np.array([-1, *(lexicon.vocabulary[lang][w][0] for w in sorted(lexicon.vocabulary[lang]))], np.int64) for lang in local}
        counts: dict[tuple[str, str], _Counts] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for source, target in list(counts):
                code, n = counts.pop((source, target)).merge()
                width = len(ids[target])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), lexicon.pair(source, target), np.int32)), pa.array(ids[source][code // width].astype(np.int32)), pa.array(ids[target][code % width].astype(np.int32)), pa.array(n)], names=["pair", "s", "t", "n"])

        for batch in batches:
            for src, mt, sl, ml in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if not src or not mt:
                    continue
                a, b = [_tokens(s) for s in numbered_sentences(src)], [_tokens(s) for s in numbered_sentences(mt)]
                if not a or not b:
                    continue
                sl = lexicon.language(sl, {w for ws in a for w in ws})
                ml = lexicon.language(ml, {w for ws in b for w in ws})
                if sl not in local or ml not in local:
                    continue
                left, right = local[sl], local[ml]
                known = _alike({w for ws in a for w in ws}, {w for ws in b for w in ws})
                x, own = _presence([np.array([left[w] for w in ws if w in left and w not in known], np.int64) for ws in a])
                y, other = _presence([np.array([right[w] for w in ws if w in right and w not in known], np.int64) for ws in b])
                if (sl, ml) not in counts and (2 + len(counts)) * len(ids[sl]) * len(ids[ml]) > 2 * DENSE_CELLS:
                    yield from given()
                # both directions: a lexicon from en to de also learns from pairs that go from de to en
                for source, target, here, rows, there, columns in ((sl, ml, own, x, other, y), (ml, sl, other, y, own, x)):
                    low, high = _windows(len(here), len(there))
                    before = np.vstack([np.zeros((1, there.shape[1]), np.float32), np.cumsum(there, axis=0)])
                    near = (before[high] > before[low]).astype(np.float32)
                    near[:, 0] = 1
                    if (source, target) not in counts:
                        counts[source, target] = _Counts(len(ids[source]), len(ids[target]))
                    counts[source, target].add(rows, columns, (here.T @ near).astype(np.int32))
                if sum(c.size for c in counts.values()) > HELD_CODES:
                    yield from given()
        yield from given()

    ordered = pairs.sortWithinPartitions(F.least("la", "lb"), F.greatest("la", "lb"))
    found = ordered.mapInArrow(run, "pair int, s int, t int, n bigint")
    return found.groupBy("pair", "s", "t").agg(F.sum("n").alias("n"))


def strengths(counts: DataFrame) -> DataFrame:
    """``pair``, ``s``, ``t``, ``strength`` of word pairs with a significant log-likelihood ratio: how far the probability of
    ``t`` near ``s`` rises from its base rate towards one, less for words that stand almost everywhere. The three
    marginals are joined by key."""
    pair = counts.where("s >= 0 and t >= 0 and n >= 3")
    by_s = counts.where("s >= 0 and t = -1").select("pair", "s", F.col("n").alias("ns"))
    by_t = counts.where("s = -1 and t >= 0").select("pair", "t", F.col("n").alias("nt"))
    total = counts.where("s = -1 and t = -1").select("pair", F.col("n").alias("total"))
    joined = pair.join(by_s, ["pair", "s"]).join(by_t, ["pair", "t"]).join(fixed(total), "pair")

    def term(k, n, p):
        return F.when(k > 0, k * F.log(k / n / p)).otherwise(F.lit(0.0))

    a = F.col("n").cast("double")
    ns, nt, total_n = (F.col(c).cast("double") for c in ("ns", "nt", "total"))
    base = nt / total_n
    ratio = 2 * (term(a, ns, base) + term(ns - a, ns, 1 - base) + term(nt - a, total_n - ns, base) + term(total_n - ns - nt + a, total_n - ns, 1 - base))
    strength = (a / ns - base) / (1 - base) * F.least(F.lit(1.0), -F.log(base) / math.log(COMMON))
    kept = joined.where(base < 1).select("pair", F.col("s").cast("long").alias("s"), F.col("t").cast("long").alias("t"), strength.cast("float").alias("strength"), ratio.alias("ratio"))
    return kept.where((F.col("ratio") >= SIGNIFICANT) & (F.col("strength") >= LEAST_STRENGTH)).select("pair", "s", "t", "strength")


def _groups(weight: np.ndarray, ties_a: list[tuple[int, int]] = (), ties_b: list[tuple[int, int]] = ()) -> list[tuple[list[int], list[int]]]:
    """Rows and columns of the connected components of positive weights; rows of ``ties_a`` and columns of ``ties_b`` belong
    together as well."""
    n, m = weight.shape
    rows, cols = np.nonzero(weight > 0)
    parent = list(range(n + m))

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for i, j in zip(rows.tolist(), cols.tolist()):
        parent[find(i)] = find(n + j)
    for i, j in ties_a:
        parent[find(i)] = find(j)
    for i, j in ties_b:
        parent[find(n + i)] = find(n + j)
    groups: dict[int, tuple[set[int], set[int]]] = {}
    for i, j in zip(rows.tolist(), cols.tolist()):
        g = groups.setdefault(find(i), (set(), set()))
        g[0].add(i)
        g[1].add(j)
    return [(sorted(left), sorted(right)) for left, right in groups.values()]


def assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight assignment (Hungarian method with potentials); rows and columns may stay alone at weight 0.

    Only pairs of positive weight are returned. The problem falls apart into the connected components of its positive
    weights, which are solved one by one.
    """
    out = []
    for r, c in _groups(weight):
        block = weight[np.ix_(r, c)]
        if len(r) == 1 or len(c) == 1:
            k = int(block.argmax())
            out.append((r[k // len(c)], c[k % len(c)]))
        else:
            out.extend((r[x], c[y]) for x, y in _hungarian(block))
    return sorted(out)


def _hungarian(weight: np.ndarray) -> list[tuple[int, int]]:
    n, m = weight.shape
    # every row has a column of its own in which it stays alone
    cost = np.hstack([-np.maximum(weight, 0), np.zeros((n, n))])
    width = m + n
    u, v = np.zeros(n + 1), np.zeros(width + 1)
    match = np.zeros(width + 1, np.int64)
    for i in range(1, n + 1):
        match[0] = i
        j0 = 0
        least = np.full(width + 1, np.inf)
        back = np.zeros(width + 1, np.int64)
        used = np.zeros(width + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            back[1:][better] = j0
            j1 = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            j1 = back[j0]
            match[j0] = match[j1]
            j0 = j1
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j] and weight[match[j] - 1, j - 1] > 0]


class Scorer:
    """Coverage of the sentences of one document by those of the other side."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.column = np.full(lexicon.size + 1, -1, np.int64)  # column of each word of the vocabulary in the open document

    def coverage(self, a: list[list[str]], b: list[list[str]], sl: str, ml: str):
        """For each side the words' shares in their sentences, the best strength of each word in each sentence of the
        other side, and which words are numbers or names."""
        left, right = sorted({w for ws in a for w in ws}), sorted({w for ws in b for w in ws})
        at_left, at_right = {w: i for i, w in enumerate(left)}, {w: i for i, w in enumerate(right)}
        known_l, known_r = self.lexicon.vocabulary.get(sl, {}), self.lexicon.vocabulary.get(ml, {})
        strength = np.zeros((len(left), len(right)), np.float32)
        if known_l and known_r:
            self._fill(strength, at_left, known_l, {known_r[w][0]: j for w, j in at_right.items() if w in known_r}, self.lexicon.entries(sl, ml))
            self._fill(strength.T, at_right, known_r, {known_l[w][0]: i for w, i in at_left.items() if w in known_l}, self.lexicon.entries(ml, sl))
        skeletons: dict[str, list[int]] = {}
        for w, j in at_right.items():
            if not w.isdigit() and len(c := consonants(w)) >= 3:
                skeletons.setdefault(c, []).append(j)
        for w, i in at_left.items():
            j = at_right.get(w)
            if j is not None and (w.isdigit() or len(w) > 3):
                strength[i, j] = 1.0
            elif not w.isdigit():
                for j in skeletons.get(consonants(w), ()):
                    strength[i, j] = max(strength[i, j], 0.9)
        weight_l = self._weights(left, known_l, sl)
        weight_r = self._weights(right, known_r, ml)
        member_l, member_r = _members(a, at_left, weight_l), _members(b, at_right, weight_r)
        best_l = _best(strength, b, at_right)  # word of a by sentence of b
        best_r = _best(strength.T, a, at_left)  # word of b by sentence of a
        return member_l, best_l, member_r, best_r, self._rare(left, known_l, sl), self._rare(right, known_r, ml)

    def _fill(self, strength: np.ndarray, at: dict[str, int], known: dict, other: dict[int, int], entries: tuple) -> None:
        """Raise the strengths of the words ``at`` to those of their lexicon entries among ``other``."""
        found = [(known[w][0], i) for w, i in at.items() if w in known]
        if not found or not other:
            return
        target, strengths, cut = entries
        ids, rows = np.array(found, np.int64).T
        low = cut[ids]
        count = cut[ids + 1] - low
        entry = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        mine = np.fromiter(other, np.int64, len(other))
        self.column[mine] = np.fromiter(other.values(), np.int64, len(other))
        column = self.column[target[entry]]
        self.column[mine] = -1
        hit = column >= 0
        i, j = np.repeat(rows, count)[hit], column[hit]
        strength[i, j] = np.maximum(strength[i, j], strengths[entry[hit]])

    def _rare(self, words: list[str], known: dict, lang: str) -> np.ndarray:
        least = max(LEAST_DOCUMENTS, RARE_SHARE * self.lexicon.documents.get(lang, 1))
        return np.array([w.isdigit() or ((known[w][1] if w in known else 0) < least and len(w) > 3) for w in words], bool)

    def _weights(self, words: list[str], known: dict, lang: str) -> np.ndarray:
        """Information of a word by the share of sentences it occurs in; numbers and unknown words weigh much."""
        n = self.lexicon.sentences.get(lang, 1)
        return np.array([2.0 if w.isdigit() else min(3.0, 0.1 + math.log((n + 1) / known[w][2]) / 2) if w in known else 2.5 for w in words], np.float32)


def _members(sentences: list[list[str]], at: dict[str, int], weight: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sentences), len(at)), np.float32)
    for i, ws in enumerate(sentences):
        for w in ws:
            out[i, at[w]] = weight[at[w]]
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-9)


def _best(strength: np.ndarray, sentences: list[list[str]], at: dict[str, int]) -> np.ndarray:
    flat = [at[w] for ws in sentences for w in ws]
    starts = np.cumsum([0, *[len(ws) for ws in sentences[:-1]]])
    return np.maximum.reduceat(strength[:, flat], starts, axis=1)


def align(a: list[list[str]], b: list[list[str]], scorer: Scorer, sl: str, ml: str, null: float = NULL_SCORE, foreign: float = FOREIGN) -> list[tuple[int, int, float]]:
    """``(i, j, score)`` of sentences (word lists, none of them empty) that translate each other.

    Sides whose paired sentences hardly share a number or name are texts of their own and give nothing.
    """
    member_a, best_a, member_b, best_b, rare_a, rare_b = scorer.coverage(a, b, sl, ml)
    cover_a, cover_b = member_a @ best_a, (member_b @ best_b).T
    score = (cover_a + cover_b) / 2
    # candidates are sentences and spans of neighbours that one sentence of the other side may render as a whole
    units_a = [(i,) for i in range(len(a))] + _spans(score.T, cover_b.T, cover_a.T, null)
    units_b = [(j,) for j in range(len(b))] + _spans(score, cover_a, cover_b, null)
    unit_a, near_b = _joined(member_a, best_b.T, units_a[len(a) :])
    unit_b, near_a = _joined(member_b, best_a.T, units_b[len(b) :])
    near_a, near_b = near_a.T, near_b.T
    taken = score if len(units_a) == len(a) and len(units_b) == len(b) else (unit_a @ near_a + (unit_b @ near_b).T) / 2
    chosen = exclusive_assignment(taken - null, units_a, units_b)
    # numbers and names of the paired sentences, and how many of them the other side has
    xs, ys = np.array([x for x, _ in chosen], np.int64), np.array([y for _, y in chosen], np.int64)
    own = unit_a[:, rare_a][xs] > 0
    n_own, n_other = own.sum(axis=1), (unit_b[:, rare_b][ys] > 0).sum(axis=1)
    shared = (own & (near_a[rare_a][:, ys].T >= 0.9)).sum(axis=1)
    both = (n_own > 0) & (n_other > 0)
    total, met = int(n_own[both].sum()), int(shared[both].sum())
    # one detail may slip; two sentences of one pattern with all details different are no translation
    kept = [pair for pair, s, n in zip(chosen, shared, np.minimum(n_own, n_other)) if s or n < 2]
    if total and met < foreign * total and (total >= 3 or len(chosen) < 0.6 * min(len(a), len(b))):
        return []
    out = []
    for x, y in kept:
        for i in units_a[x]:
            for j in units_b[y]:
                # of a span only the sentences that are rendered themselves
                if len(units_a[x]) * len(units_b[y]) == 1 or max(cover_a[i, j], cover_b[i, j]) >= null:
                    out.append((i, j, float(taken[x, y])))
    _attach(out, cover_a, score, member_b, best_b, null)
    turned = [(j, i, s) for i, j, s in out]
    _attach(turned, cover_b.T, score.T, member_a, best_a, null)
    return [(i, j, s) for j, i, s in turned]


def _attach(pairs: list[tuple[int, int, float]], cover: np.ndarray, score: np.ndarray, member: np.ndarray, best: np.ndarray, null: float) -> None:
    """Add sentences that stayed alone to the partner of another one, where that partner renders them too: parts of a
    merged sentence need not be neighbours on the other side once sentences were moved."""
    partners: dict[int, list[int]] = {}
    for i, j, _ in pairs:
        partners.setdefault(j, []).append(i)
    taken = {i for i, _, _ in pairs}
    for i in range(len(cover)):
        if i in taken:
            continue
        j = int(score[i].argmax())
        if j not in partners or cover[i, j] < 1.2 * null or score[i, j] < null:
            continue
        before = best[:, partners[j]].max(axis=1)
        gain = float(member[j] @ np.maximum(before, best[:, i]) - member[j] @ before)
        if gain >= GAIN:
            pairs.append((i, j, float(score[i, j])))
            partners[j].append(i)


def _spans(score: np.ndarray, cover_a: np.ndarray, cover_b: np.ndarray, null: float) -> list[tuple[int, ...]]:
    """Spans of side b that are candidates beside their sentences: runs of neighbours for which one sentence i is the best
    and covers each well, while each further one covers words of i that the span so far leaves open."""
    runs: list[tuple[int, ...]] = []
    best = score.argmax(axis=0)
    for j in range(1, score.shape[1]):
        i = int(best[j])
        if best[j - 1] == i and cover_b[i, j] >= null and cover_b[i, j - 1] >= null:
            run = runs[-1] if runs and runs[-1][-1] == j - 1 else (j - 1,)
            covered = [float(cover_a[i, k]) for k in run]
            new = float(cover_a[i, j])
            # a sentence that renders the same part again adds little to the largest share
            if min(new, *covered) >= 0.08 and sum(covered) + new <= 1.0:
                if len(run) > 1:
                    runs.pop()
                runs.append((*run, j))
    return runs


def _joined(member: np.ndarray, best: np.ndarray, spans: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Word shares and best strengths of sentences with those of ``spans`` below: their mean, and their best."""
    if not spans:
        return member, best
    return np.vstack([member, *(member[list(u)].mean(axis=0) for u in spans)]), np.vstack([best, *(best[list(u)].max(axis=0) for u in spans)])


def exclusive_assignment(weight: np.ndarray, units_a: list[tuple[int, ...]], units_b: list[tuple[int, ...]]) -> list[tuple[int, int]]:
    """``assignment`` of units of which none shares a sentence with another one chosen on its side.

    Where the assignment takes a span and some of its sentences, its component is solved without the span and without its
    sentences, and the better goes on. Each round rules out a span or its sentences for good, so there are at most as many
    rounds as spans.
    """
    ties = [[(k, i) for k, u in enumerate(units) if len(u) > 1 for i in u] for units in (units_a, units_b)]
    if not any(ties):
        return assignment(weight)
    out = []
    for rows, cols in _groups(weight, *ties):
        block = weight[np.ix_(rows, cols)]
        chosen = assignment(block)
        while clash := _clash([(rows[x], cols[y]) for x, y in chosen], units_a, units_b):
            side, span, sentences = clash
            place = {k: n for n, k in enumerate(cols if side else rows)}
            best = None
            for gone in ([span], sentences):
                rest = block.copy()
                gone = [place[k] for k in gone if k in place]
                rest[(slice(None), gone) if side else (gone, slice(None))] = -1.0
                pairs = assignment(rest)
                total = sum(float(rest[pair]) for pair in pairs)
                if best is None or total > best[0]:
                    best = total, rest, pairs
            _, block, chosen = best
        out.extend((rows[x], cols[y]) for x, y in chosen)
    return sorted(out)


def _clash(chosen: list[tuple[int, int]], units_a: list[tuple[int, ...]], units_b: list[tuple[int, ...]]) -> tuple[int, int, tuple[int, ...]] | None:
    """Side, span and sentences of a chosen span of which a sentence is chosen too."""
    for side, units in ((0, units_a), (1, units_b)):
        taken = {pair[side] for pair in chosen}
        for u in sorted(taken):
            if len(units[u]) > 1 and taken.intersection(units[u]):
                return side, u, units[u]
    return None


def sentence_pairs(pairs: DataFrame, id_col: str = "pair_id", src: str = "src", mt: str = "mt", src_lang: str = "src_lang", mt_lang: str = "mt_lang", null: float = NULL_SCORE, foreign: float = FOREIGN, most_words: int = MOST_WORDS) -> DataFrame:
    """``id_col``, ``src_no``, ``mt_no``, ``score`` for each two sentences that translate each other.

    Null and empty sides align with nothing; a null or unknown language is taken from the words; repeated rows are
    aligned each. Three passes over the pairs: vocabulary, co-occurrences, alignment. Only counted words and word
    pairs are shuffled, partially summed per task. Workers hold the vocabularies, ``most_words`` in all, which is checked,
    and the lexicon of one pair of languages; rows of a task are taken by pair of languages.
    """
    spark = pairs.sparkSession
    kind = dict(pairs.dtypes)[id_col]
    base = f"{shared_dir(spark).rstrip('/')}/align-{uuid.uuid4().hex}"
    sides = [F.col(c).cast("string").alias(n) for c, n in ((src, "a"), (mt, "b"))] + [F.lower(F.trim(F.col(c))).alias(n) for c, n in ((src_lang, "la"), (mt_lang, "lb"))]
    texts = pairs.select(*sides).where("a is not null and b is not null")
    found = document_words(texts)
    found.select(F.monotonically_increasing_id().alias("wide"), "*").write.parquet(f"{base}/counted")
    _numbered(spark.read.parquet(f"{base}/counted")).write.parquet(f"{base}/words")
    known = spark.read.parquet(f"{base}/words").count()
    if known > most_words:
        raise ValueError(f"{known} words are more than the {most_words} a worker is meant to hold; raise most_words or workers' memory")
    cooccurrences(texts, f"{base}/words").write.parquet(f"{base}/counts")
    strengths(spark.read.parquet(f"{base}/counts")).repartition("pair").write.partitionBy("pair").parquet(f"{base}/lexicon")
    words, lexicon_path = f"{base}/words", f"{base}/lexicon"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(words, lexicon_path)
        scorer = Scorer(lexicon)
        for whole in batches:
            for begin in range(0, whole.num_rows, 100):
                batch = whole.slice(begin, 100)
                rows = []
                for k, (a, b, la, lb) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 5)))):
                    x = [(n, ws) for n, s in enumerate(numbered_sentences(a)) if (ws := _tokens(s))]
                    y = [(n, ws) for n, s in enumerate(numbered_sentences(b)) if (ws := _tokens(s))]
                    if not x or not y:
                        continue
                    la = lexicon.language(la, {w for _, ws in x for w in ws})
                    lb = lexicon.language(lb, {w for _, ws in y for w in ws})
                    rows.extend((k, x[i][0], y[j][0], s) for i, j, s in align([ws for _, ws in x], [ws for _, ws in y], scorer, la, lb, null, foreign))
                if rows:
                    index, i, j, s = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int32())), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(s, pa.float64())], names=[id_col, "src_no", "mt_no", "score"])

    rows = pairs.select(F.col(id_col), *sides).where("a is not null and b is not null")
    return rows.sortWithinPartitions(F.least("la", "lb"), F.greatest("la", "lb")).mapInArrow(run, f"`{id_col}` {kind}, src_no int, mt_no int, score double")


def _numbered(counted: DataFrame) -> DataFrame:
    """Dense ids: the rank of a row within its partition after the rows of the partitions before it."""
    part = counted.withColumn("p", F.shiftright("wide", 33)).withColumn("row", F.col("wide").bitwiseAND((1 << 33) - 1))
    # one row per partition, which is checked
    sizes = sorted(small(part.groupBy("p").agg((F.max("row") + 1).alias("size")), 100_000))
    offsets, at = [], 0
    for r in sizes:
        offsets.append((r["p"], at))
        at += r["size"]
    if not offsets:
        return part.select(F.lit(0).cast("bigint").alias("id"), "lang", "word", "n", "k")
    offset = counted.sparkSession.createDataFrame(offsets, "p bigint, offset bigint")
    return part.join(fixed(offset, 100_000), "p").select((F.col("row") + F.col("offset")).alias("id"), "lang", "word", "n", "k")
