"""Splitting oversized texts at natural boundaries (problem 6).

A hierarchy of separators is applied recursively: sections (blank lines), paragraphs (line breaks), sentences, words,
then single characters. Pieces are packed greedily up to the limit; each piece but the first repeats the end of the
one before, cut at a word boundary where there is one. Spans are reported, so the text can be put together again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1800
OVERLAP = 120

#: From coarse to fine: each pattern matches the gap behind which a cut is natural.
LEVELS = tuple(re.compile(p) for p in (r"\n[^\S\n]*\n\s*", r"\n+", r"(?<=[.!?؟…])[\"'”»)\]]*\s+", r"\s+"))
_SPACE = re.compile(r"\s")


def _units(text: str, start: int, end: int, level: int, limit: int) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` characters that tile ``text[start:end]``, each as coarse as possible."""
    if end - start <= limit:
        return [(start, end)]
    if level == len(LEVELS):
        # single characters: combining marks stay with their letter where the limit allows
        out = []
        while start < end:
            stop = min(start + limit, end)
            if stop < end:
                back = stop
                while back > start + 1 and _joins(text[back]):
                    back -= 1
                stop = back if back > start + 1 else stop
            out.append((start, stop))
            start = stop
        return out
    out, at = [], start
    cuts = [m.end() for m in LEVELS[level].finditer(text, start, end)]
    for cut in [*[c for c in cuts if start < c < end], end]:
        out.extend(_units(text, at, cut, level + 1, limit))
        at = cut
    return out


def _joins(ch: str) -> bool:
    code = ord(ch)
    return 0x0300 <= code <= 0x036F or 0x064B <= code <= 0x0655 or code in (0x200D, 0xFE0F, 0x0670)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """``(start, end, repeated)`` of each piece: ``text[start:end]`` has at most ``limit`` characters, its first
    ``repeated`` ones (at most ``overlap``) are the end of the piece before. A text within the limit is one piece."""
    if limit <= 0 or overlap < 0 or overlap >= limit:
        raise ValueError("need 0 <= overlap < limit")
    if len(text) <= limit:
        return [(0, len(text), 0)]
    pieces: list[tuple[int, int, int]] = []
    fresh, end = 0, 0  # where the new part of the open piece begins and ends
    repeated = 0
    for a, b in _units(text, 0, len(text), 0, limit - overlap):
        if b - fresh + repeated > limit:
            pieces.append((fresh - repeated, end, repeated))
            repeated = _tail(text, fresh - repeated, end, min(overlap, limit - (b - a)))
            fresh = a
        end = b
    pieces.append((fresh - repeated, end, repeated))
    return pieces


def _tail(text: str, start: int, end: int, overlap: int) -> int:
    """Length of the repeated end: up to ``overlap`` characters, from a word's beginning where one lies there."""
    if overlap <= 0:
        return 0
    low = max(start, end - overlap)
    if low > start and not text[low - 1].isspace():
        m = _SPACE.search(text, low, end - 1)
        if m:
            return end - m.end()
    return end - low


def split_sides(df: DataFrame, id_col: str, sides: tuple[str, ...] = ("src", "mt"), limit: int = LIMIT, overlap: int = OVERLAP, only_oversized: bool = True) -> DataFrame:
    """Pieces of the texts in ``sides``: ``id_col``, ``side``, ``piece_no`` from 0, ``start``, ``end`` (code points),
    ``repeated`` and ``text``.

    Null texts give no pieces; with ``only_oversized`` texts within the limit give none either, else they come out
    as one piece (an empty text as one empty piece). Repeated rows are split each. The length test runs in the JVM
    before any text is handed to Python; no shuffle.
    """
    kind = dict(df.dtypes)[id_col]
    sided = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).cast("string").alias("text")) for s in sides])).alias("s")
    long = df.select(F.col(id_col), sided).select(id_col, "s.side", "s.text").where("text is not null")
    if only_oversized:
        long = long.where(F.char_length("text") > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for i, text in enumerate(part.column(2).to_pylist()):
                    rows.extend((i, n, a, b, r, text[a:b]) for n, (a, b, r) in enumerate(split_text(text, limit, overlap)))
                if not rows:
                    continue
                take, no, start, end, rep, cut = map(list, zip(*rows))
                index = pa.array(take, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(index), part.column(1).take(index), pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(rep, pa.int32()), pa.array(cut, pa.string())],
                    names=[id_col, "side", "piece_no", "start", "end", "repeated", "text"],
                )

    return long.mapInArrow(run, f"`{id_col}` {kind}, side string, piece_no int, start int, end int, repeated int, text string")
