"""Parsing and word rules shared by the training-text operators. Pure functions, run on executors in Arrow batches."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

# Names of the speaking roles, as found in both message layouts.
SYSTEM_ROLES = {"system"}
CLIENT_ROLES = {"user", "client"}
THERAPIST_ROLES = {"assistant", "therapist"}

# Speaker labels by language (en, fr, de, ar), with and without accents.
LABELS = ("Therapist", "Client", "Thérapeute", "Therapeute", "Therapeut", "Klient", "المعالج", "العميل")

_LABEL = re.compile(r"(?:(?<=\s)|^)(?:" + "|".join(sorted(LABELS, key=len, reverse=True)) + r")\s*[:：]\s*", re.I)
#: Parts of labels, one of which every text with a label holds.
_LABEL_HINTS = ("rapeut", "therapist", "client", "klient", "المعالج", "العميل")
_MARKER = re.compile(r"\[\s*(?:\*\*)?/?\s*END\s*(?:\*\*)?\s*\]|<\|END_RESPONSE\|>|</?think>|\*\*", re.I)
_WORD = re.compile("[^\\W_]+(?:[\u0300-\u036f\u064b-\u0655]+[^\\W_]*)*")
_SENTENCE = re.compile(r"[.!?؟\n]")
#: ASCII letters and digits as they are, spaces for the rest.
_ASCII_WORDS = "".join(c if c.isalnum() else " " for c in map(chr, range(128)))
#: Characters that show nothing: zero-width, joiners, directional marks, soft hyphen.
INVISIBLE = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u2060\ufeff]")
#: Combining marks: Latin accents, Arabic vowel signs and the like.
MARKS = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_FAR_DIGITS = re.compile("[\u0660-\u0669\u06f0-\u06f9]")
_ARABIC_DIGITS = {0x0660 + i: str(i) for i in range(10)} | {0x06F0 + i: str(i) for i in range(10)}


@lru_cache(1 << 10)
def _kind(role: str) -> str:
    role = role.strip().lower()
    return "system" if role in SYSTEM_ROLES else "client" if role in CLIENT_ROLES else "therapist" if role in THERAPIST_ROLES else "other"


def turns_of(raw: str | None) -> list[tuple[str, str | None]] | None:
    """``(role, content)`` of each message of a JSON list; role is system, client, therapist or other.

    Null or unreadable JSON gives None; a message without content keeps its place with content None. Both key
    layouts (role/content and role/response) are read.
    """
    if raw is None:
        return None
    try:
        items = json.loads(raw)
    except ValueError:
        return None
    if isinstance(items, dict):
        items = [items]
    if not isinstance(items, list):
        return None
    out = []
    for item in items:
        if not isinstance(item, dict):
            continue
        text = item.get("content")
        if text is None:
            text = item.get("response")
        out.append((_kind(str(item.get("role") or "")), text if isinstance(text, str) else None))
    return out


@lru_cache(1 << 12)
def plain(text: str) -> str:
    """Text without markers, speaker labels and invisible characters, in composed form."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = INVISIBLE.sub("", text)
    if "[" in text or "<" in text or "*" in text:
        text = _MARKER.sub(" ", text)
    if ":" in text or "：" in text:
        low = text.lower()
        if any(hint in low for hint in _LABEL_HINTS):
            text = _LABEL.sub(" ", text)
    return text


def fold(text: str) -> str:
    """Lower case without accents; Arabic-Indic digits as ASCII; ``ß`` as ``ss``, umlauts and ligatures as one letter.

    Spelled-out umlauts (``ae oe ue``) fold to the plain vowel too, so all writing habits of a word meet in one form.
    """
    text = text.lower()
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text))
        if not text.isascii():
            text = text.replace("ß", "ss").replace("œ", "oe").replace("æ", "ae")
            if _FAR_DIGITS.search(text):
                text = text.translate(_ARABIC_DIGITS)
    return text.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def words(text: str) -> list[str]:
    """Runs of letters and digits."""
    return text.translate(_ASCII_WORDS).split() if text.isascii() else _WORD.findall(text)


def each_sentence(text: str) -> Iterator[tuple[int, int]]:
    """Spans of sentences: each ends after ``. ! ? ؟`` before white space or the end, or at a line break."""
    start = 0
    for m in _SENTENCE.finditer(text):
        end = m.end()
        if text[end - 1] == "\n":
            if end - 1 > start:
                yield start, end - 1
            start = end
        elif text[end : end + 1].isspace():
            yield start, end
            start = end
    if start < len(text):
        yield start, len(text)


def sentences(text: str) -> list[tuple[int, int]]:
    """The spans of ``each_sentence``."""
    return list(each_sentence(text))


def listed(parts: np.ndarray, size: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``take`` of those that stand one after another in ``parts``, and their sizes."""
    many = size[take]
    starts = (np.cumsum(size) - size)[take] - (np.cumsum(many) - many)
    return parts[np.repeat(starts, many) + np.arange(many.sum())], many
