"""Messages of a batch as numbers of pieces, each message and sentence of the batch read once.

A piece is a run of letters, digits and marks, with the points and colons between its digits, or one stop. Words, tokens
and folded words of a text are those of its pieces one after another, so what is asked of words is asked once a piece.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

from colloquy.llm import _text

_M = _text.MARKS.pattern[1:-2]
_PIECE = re.compile(rf"[\w{_M}]+(?:(?<=\d)[:.,](?=\d)[\w{_M}]+)*|[,،;؛:.!?؟…]")
#: The same for ASCII.
_ASCII_PIECE = re.compile(r"[0-9A-Za-z_]+(?:(?<=[0-9])[:.,](?=[0-9])[0-9A-Za-z_]+)*|[,;:.!?]")
#: The texts of ``_text.each_sentence``, and empty ones.
_SENTENCES = re.compile(r"[^.!?؟\n]*(?:[.!?؟](?!\s)[^.!?؟\n]*)*[.!?؟]?")
#: Where folding depends on more than a piece: marks beside a number's or a sentence's stop, a sigma. Such a sentence is one
#: piece; it has pieces with marks or a sigma.
_MARKED = re.compile(f"[{_M}Σ]")
_WHOLE = re.compile(rf"\d[{_M}]+[:.,]|[:.,!?؟][{_M}]|Σ")


@lru_cache(1 << 17)
def lower_words(piece: str) -> tuple[str, ...]:
    return tuple(w.lower() for w in _text.words(piece))


@lru_cache(1 << 17)
def folded_words(piece: str) -> tuple[str, ...]:
    return tuple(_text.words(_text.fold(piece)))


def small(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of lists that stand one after another, empty ones too."""
    total, ends = np.r_[0, np.cumsum(values)], np.cumsum(size)
    return total[ends] - total[ends - size]


class _Numbers(dict):
    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        return number


class Pack:
    """``pieces`` (texts), numbers of the pieces of sentences, of the sentences of messages, and of the messages of rows
    (``own``), each with the sizes of its lists. ``rows`` has what the row checks need of each readable row, see ``read``."""

    def __init__(self, pieces: list[str], flat: np.ndarray, size: np.ndarray, sentences: np.ndarray, parts: np.ndarray, own: np.ndarray, held: np.ndarray, rows: dict | None = None):
        self.pieces, self.flat, self.size, self.sentences, self.parts, self.own, self.held, self.rows = pieces, flat, size, sentences, parts, own, held, rows

    def stream(self, split: Callable[[str], tuple[str, ...]]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """What ``split`` makes of the pieces: its words, their numbers over all sentences, and the sentences' sizes."""
        numbers = _Numbers()
        lists = list(map(split, self.pieces))
        table = np.fromiter(map(numbers.__getitem__, chain.from_iterable(lists)), np.int64)
        flat, many = _text.listed(table, np.fromiter(map(len, lists), np.int64, len(lists)), self.flat)
        return list(numbers), flat, sums(many, self.size)

    def dumps(self) -> bytes:
        return pickle.dumps((self.pieces, *map(small, (self.flat, self.size, self.sentences, self.parts, self.own, self.held)), self.rows))

    @classmethod
    def loads(cls, data: bytes) -> Pack:
        pieces, *numbers, rows = pickle.loads(data)
        return cls(pieces, *(x.astype(np.int64) for x in numbers), rows)


def _numbered(lists: list[list[str]], numbers: _Numbers) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(map(numbers.__getitem__, chain.from_iterable(lists)), np.int64, int(size.sum())), size


def read(rows: Iterable[list[tuple[str, str | None]] | None], ids: pa.Array | None = None, ending: Callable[[str], str | bool] | None = None) -> Pack:
    """The messages with content of rows (turns without system messages; None if unreadable).

    With ``ids`` also, for each readable row: ``id``; ``row``, its place; ``last``, its response; ``prompt``, the last client
    message before it (-1 where there is none or no content); ``cut``, whether its last message has content; ``state`` of
    the response as ``ending`` tells of its plain text, 0 whole, 1 unfinished, or 2 and the number of one of ``clauses``.
    And for each message: ``spoken``, whether a therapist speaks in each of ``own``; ``hash``; ``odd``, the plain texts of
    those whose sentences folding may change."""
    sentences, messages, pieces, clauses = _Numbers(), _Numbers(), _Numbers(), _Numbers()
    parts, found, texts = [], [], []
    own, held, spoken = [], [], []
    checked: list[tuple[int, int, int, int, int]] = []
    states: dict[int, int] = {}
    for place, turns in enumerate(rows):
        before = len(own)
        for role, text in turns or ():
            if not text:
                continue
            number = messages[text]
            own.append(number)
            spoken.append(role == "therapist")
            if number < len(parts):
                continue
            texts.append(text)
            split = [sentences[s] for s in _SENTENCES.findall(_text.plain(text)) if s]
            parts.append(len(split))
            found += split
        held.append(len(own) - before)
        if ids is None or turns is None:
            continue
        cut = bool(turns and turns[-1][1])
        last = messages[turns[-1][1]] if cut and turns[-1][0] != "client" else -1
        prompt = next((t for role, t in reversed(turns[:-1]) if role == "client"), None)
        if last >= 0 and last not in states:
            open_to = ending(_text.plain(turns[-1][1]))
            states[last] = int(open_to) if isinstance(open_to, bool) else 2 + clauses[open_to]
        checked.append((place, last, messages[prompt] if prompt else -1, cut, states.get(last, 0)))
    lists = [(_ASCII_PIECE if s.isascii() else _PIECE).findall(s) for s in sentences]
    flat, size = _numbered(lists, pieces)
    marked = np.fromiter((not p.isascii() and _MARKED.search(p) is not None for p in pieces), bool, len(pieces))
    whole = np.zeros(len(lists), bool)
    if marked.any():
        names = list(sentences)
        for n in np.flatnonzero(sums(marked[flat], size)).tolist():
            if _WHOLE.search(names[n]):
                lists[n], whole[n] = [names[n]], True
        if whole.any():
            pieces = _Numbers()
            flat, size = _numbered(lists, pieces)
    found, parts = np.array(found, np.int64), np.array(parts, np.int64)
    about = None
    if ids is not None:
        columns = np.array(checked, np.int64).reshape(-1, 5).T
        about = dict(zip(("row", "last", "prompt", "cut", "state"), columns), id=ids.take(pa.array(columns[0])), clauses=list(clauses), spoken=np.array(spoken, bool))
        about["odd"] = {m: _text.plain(texts[m]) for m in np.flatnonzero(sums(whole[found], parts)).tolist()}
        about["hash"] = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in messages), np.int64, len(messages))
    return Pack(list(pieces), flat, size, found, parts, np.array(own, np.int64), np.array(held, np.int64), about)
