"""Byte-level BPE under an existing vocabulary: exact token counts (problem 3) and token ids (problem 7). Vocabularies
come as ``tokenizers`` JSON files, also with a normaliser and ends of words, or as ``tiktoken`` rank files.

Two independent merge engines share the pre-splitter:

* ``count_pieces``: distinct pieces are symbol arrays in one flat numpy vector; adjacent pairs are joined with the
  sorted merge table, each piece applies its lowest-ranked merge, until no pair joins any more.
* ``PairIndex``: every pair maps to all its positions among the distinct pieces of a partition; active ranks are
  applied in ascending order and the lists of the neighbouring pairs are updated.

The vocabulary file is named by a parameter, read once on the driver and broadcast (its size is that of the
vocabulary, never of the data).
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import _text

TOKENIZER_DIR = "/opt/tokenizers"
DEFAULT_TOKENIZER = "byte_bpe_50k"

#: Pieces kept by a worker between batches; beyond it the memo is emptied, which changes speed but no result.
MEMO_PIECES = 400_000

# Fixed value: the public pre-splitting pattern of the byte-level vocabularies.
PRE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: visible Latin-1 bytes stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merge rules as arrays, and how texts are normalised and cut before them.

    ``left``, ``right`` and ``rank`` are the rules, ``made`` the token each rank makes. ``byte_ids`` are the tokens of
    single bytes, ``end_ids`` those of a piece's last byte (the same where words have no end of their own). ``whole``
    are pieces that are tokens as they stand.
    """

    def __init__(self, byte_ids, end_ids, left, right, rank, made, pattern: str = PRE_SPLIT, steps: tuple = (), whole: dict[bytes, int] | None = None):
        self.byte_ids, self.end_ids, self.left, self.right, self.rank, self.made = byte_ids, end_ids, left, right, rank, made
        self.pattern, self.steps, self.whole = pattern, steps, whole or {}
        key = left.astype(np.int64) << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], rank[order].astype(np.int64)
        self.rules = dict(zip(key.tolist(), rank.tolist()))

    def __getstate__(self):
        return self.byte_ids, self.end_ids, self.left, self.right, self.rank, self.made, self.pattern, self.steps, self.whole

    def __setstate__(self, state):
        self.__init__(*state)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a ``tokenizers`` JSON file or a ``tiktoken`` rank file. What this engine does not follow exactly, such as
        other models, normalisers or pre-splitters, is refused with ValueError, never counted wrongly."""
        if path.endswith(".tiktoken"):
            return cls._ranks(path)
        if not path.endswith(".json"):
            raise ValueError(f"not a vocabulary of byte pairs: {path}")
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
        odd = {k for k, v in plain.items() if model.get(k, v) != v and (model.get(k) or v)}
        if odd:
            raise ValueError(f"{path}: model settings that are not followed: {sorted(odd)}")
        pattern, steps = _pre_split(whole.get("pre_tokenizer"), path), tuple(_steps(whole.get("normalizer"), path))
        ids, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        suffix = model.get("end_of_word_suffix") or ""
        byte_ids, end_ids = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for letter, byte in _byte_letters().items():
            byte_ids[byte], end_ids[byte] = ids[letter], ids[letter + suffix]
        left, right, made = (np.array([ids[t] for t in column], np.int32) for column in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        return cls(byte_ids, end_ids, left, right, np.arange(len(merges), dtype=np.int32), made, pattern, steps)

    @classmethod
    def _ranks(cls, path: str) -> Vocabulary:
        """Tokens with their ranks; every two tokens whose bytes make a third are a rule of its rank."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        rules = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(c, np.int32) for c in zip(*rules))
        return cls(byte_ids, byte_ids, left, right, rank, np.arange(max(ranks.values()) + 1, dtype=np.int32), whole={t: r for t, r in ranks.items() if len(t) > 1})


def _pre_split(found: dict | None, path: str) -> str:
    """The pattern of pieces of a pre-splitter."""
    match found:
        case {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            return PRE_SPLIT
        case {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]}:
            # the public library's white space leaves out the separators of the ASCII controls
            return pattern.replace(r"\s", r"\p{White_Space}")
    raise ValueError(f"{path}: a pre-splitter that is not followed")


def _steps(found: dict | None, path: str) -> Iterator[tuple]:
    """Steps of a normaliser in order."""
    match found:
        case None:
            return
        case {"type": "Sequence", "normalizers": parts}:
            for part in parts:
                yield from _steps(part, path)
        case {"type": "NFC" | "NFD" | "NFKC" | "NFKD" as form}:
            yield "form", form
        case {"type": "Lowercase"}:
            yield ("lower",)
        case {"type": "Replace", "pattern": {"Regex": pattern}, "content": content}:
            yield "replace", pattern.replace(r"\s", r"\p{White_Space}"), content
        case _:
            raise ValueError(f"{path}: a normaliser that is not followed: {found.get('type')}")


def normalised(text: str, steps: tuple) -> str:
    """A text after the normaliser's steps; letters are lowered one by one, whatever stands beside them."""
    for step in steps:
        if step[0] == "form":
            text = unicodedata.normalize(step[1], text)
        elif step[0] == "replace":
            text = regex.sub(step[1], step[2], text)
        else:
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
    return text


def vocabulary_path(name: str = DEFAULT_TOKENIZER, directory: str | None = None) -> str:
    """The file of a named vocabulary below ``directory``, else below ``$TOKENIZER_DIR``."""
    base = os.path.join(directory or os.environ.get("TOKENIZER_DIR", TOKENIZER_DIR), name)
    return next((base + suffix for suffix in ("", ".json", ".tiktoken", ".model") if os.path.isfile(base + suffix)), base + ".json")


class PreSplitter:
    """Splits texts at single inner spaces first: no piece spans such a space, so each part is a memo key of its own."""

    _inner = regex.compile(r"(?<=\S) (?=\S)")

    def __init__(self, pattern: str = PRE_SPLIT):
        self._split = regex.compile(pattern)

    def parts(self, text: str) -> list[str]:
        """Parts whose concatenation, each but the first behind one space, is the text."""
        found = text.split(" ")
        # an empty part or white space at a part's edge means that the space is not a single inner one
        for p in found:
            if not p or p[0].isspace() or p[-1].isspace():
                return self._inner.split(text)
        return found

    def pieces(self, part: str) -> list[bytes]:
        return [m.encode("utf-8", "surrogatepass") for m in self._split.findall(part)]


def count_pieces(vocab: Vocabulary, pieces: list[bytes]) -> np.ndarray:
    """Number of tokens of each piece, by repeated joins of adjacent pairs with the ranked merges."""
    if not pieces:
        return np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    symbols = vocab.byte_ids[data].astype(np.int64)
    last = np.cumsum(lengths)[lengths > 0] - 1
    symbols[last] = vocab.end_ids[data[last]]
    owner = np.repeat(np.arange(len(pieces)), lengths)
    counts = lengths.copy()
    none = len(vocab.made)
    while len(symbols) > 1:
        key = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(vocab.keys, key), len(vocab.keys) - 1)
        rank = np.where((vocab.keys[at] == key) & (owner[:-1] == owner[1:]), vocab.ranks[at], none)
        # lowest rank of each piece that is still open
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lowest = np.minimum.reduceat(np.r_[rank, none], starts)
        size = np.diff(np.r_[starts, len(symbols)])
        chosen = (rank < none) & (rank == np.repeat(lowest, size)[:-1])
        if not chosen.any():
            break
        # of overlapping choices (runs of one symbol) every second one holds, from the left
        run_start = chosen & ~np.r_[False, chosen[:-1]]
        offset = np.arange(len(chosen)) - np.maximum.accumulate(np.where(run_start, np.arange(len(chosen)), 0))
        chosen &= offset % 2 == 0
        hit = np.flatnonzero(chosen)
        symbols[hit] = vocab.made[rank[hit]]
        np.subtract.at(counts, owner[hit], 1)
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        # pieces without any joinable pair leave the work set
        open_piece = np.repeat(lowest < none, size)
        keep &= open_piece
        symbols, owner = symbols[keep], owner[keep]
    if vocab.whole:
        counts[np.fromiter((p in vocab.whole for p in pieces), bool, len(pieces))] = 1
    return counts


class PairIndex:
    """Encodes distinct pieces of a partition through a pair occurrence index."""

    def __init__(self, vocab: Vocabulary):
        self.rules, self.whole = vocab.rules, vocab.whole
        self.byte_ids, self.end_ids, self.made = vocab.byte_ids.tolist(), vocab.end_ids.tolist(), vocab.made.tolist()

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece. Pieces are laid end to end with a gap of -1 between them."""
        rules, made, ids, ends = self.rules, self.made, self.byte_ids, self.end_ids
        sym: list[int] = []
        for p in pieces:
            sym.extend([ids[b] for b in p])
            if p:
                sym[-1] = ends[p[-1]]
            sym.append(-1)
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[int, list[int]] = {}
        for i in range(n - 1):
            a, b = sym[i], sym[i + 1]
            if a >= 0 and b >= 0 and (r := rules.get(a << 32 | b)) is not None:
                if r in where:
                    where[r].append(i)
                else:
                    where[r] = [i]
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            positions = where.pop(rank)
            new = made[rank]
            positions.sort()
            for i in positions:
                a, j = sym[i], nxt[i]
                # the pair may be gone; several pairs may make one token, from the left
                if a < 0 or j >= n or sym[j] < 0 or rules.get(a << 32 | sym[j]) != rank:
                    continue
                k = nxt[j]
                sym[i], sym[j], nxt[i] = new, -2, k
                if k < n:
                    prv[k] = i
                    if sym[k] >= 0 and (r := rules.get(new << 32 | sym[k])) is not None:
                        if r in where:
                            where[r].append(i)
                        else:
                            where[r] = [i]
                            heapq.heappush(active, r)
                h = prv[i]
                if h >= 0 and sym[h] >= 0 and (r := rules.get(sym[h] << 32 | new)) is not None:
                    if r in where:
                        where[r].append(h)
                    else:
                        where[r] = [h]
                        heapq.heappush(active, r)
        out, current = [], []
        for s in sym:
            if s >= 0:
                current.append(s)
            elif s == -1:
                out.append(current)
                current = []
        if self.whole:
            out = [[self.whole[p]] if p in self.whole else o for p, o in zip(pieces, out)]
        return out


class Encoder:
    """Worker-side memo from text parts to token ids (or counts), filled batch by batch for parts not seen before."""

    def __init__(self, vocab: Vocabulary, counting: bool):
        self.vocab, self.counting, self.split = vocab, counting, PreSplitter(vocab.pattern)
        self.index = None if counting else PairIndex(vocab)
        self.memo: dict[str, object] = {}

    def _fill(self, missing: list[str]) -> None:
        pieces_of = [self.split.pieces(p) for p in missing]
        distinct = list(dict.fromkeys(chain.from_iterable(pieces_of)))
        if self.counting:
            known = dict(zip(distinct, count_pieces(self.vocab, distinct).tolist()))
            self.memo.update((m, sum(map(known.__getitem__, ps))) for m, ps in zip(missing, pieces_of))
        else:
            known = dict(zip(distinct, self.index.encode(distinct)))
            self.memo.update((m, [i for p in ps for i in known[p]]) for m, ps in zip(missing, pieces_of))

    def batch(self, texts: list[str | None]) -> list:
        """Token ids (counts) of each text; empty list (zero) for null and empty texts."""
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        keyed = []
        for text in texts:
            if text and self.vocab.steps:
                text = normalised(text, self.vocab.steps)
            if not text:
                keyed.append(())
                continue
            parts = self.split.parts(text)
            keyed.append([parts[0], *[" " + p for p in parts[1:]]])
        missing = [p for p in set(chain.from_iterable(keyed)) if p not in self.memo]
        for i in range(0, len(missing), 20_000):
            self._fill(missing[i : i + 20_000])
        get = self.memo.__getitem__
        if self.counting:
            return [sum(map(get, ks)) for ks in keyed]
        return [list(chain.from_iterable(map(get, ks))) for ks in keyed]


_WORKER: dict[tuple[str, bool], Encoder] = {}


def worker_encoder(key: str, shared, counting: bool) -> Encoder:
    """One encoder per worker process and vocabulary, kept across tasks."""
    if (key, counting) not in _WORKER:
        _WORKER.clear()
        _WORKER[key, counting] = Encoder(shared.value, counting)
    return _WORKER[key, counting]


def broadcast_vocabulary(df: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, directory: str | None = None):
    """A key for the workers' memo and the broadcast vocabulary."""
    path = vocabulary_path(tokenizer, directory)
    return path, df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))


def encode_texts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = DEFAULT_TOKENIZER, directory: str | None = None) -> DataFrame:
    """``id_col`` and ``ids`` (token ids without special tokens) of every row; a narrow map without shuffle.

    Null and empty texts get an empty list; repeated rows are kept; strings of special tokens are ordinary text;
    other columns of ``df`` (also one named ``ids``) are not read.
    """
    key, shared = broadcast_vocabulary(df, tokenizer, directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(key, shared, counting=False)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # bounds the Python objects alive at once
                part = batch.slice(at, 1000)
                ids = encoder.batch(part.column(1).to_pylist())
                flat = np.fromiter(chain.from_iterable(ids), np.int32)
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)), out=ends[1:])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[id_col, "ids"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_cols: list[str], text_col: str, tokenizer: str = DEFAULT_TOKENIZER, directory: str | None = None, messages: bool = False) -> DataFrame:
    """``id_cols`` and ``n_tokens BIGINT`` of every row; with ``messages``, over the contents of a JSON message list.

    Null, empty and unreadable values count 0 tokens; rows are never dropped or merged; a narrow map without shuffle.
    """
    key, shared = broadcast_vocabulary(df, tokenizer, directory)
    width = len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(key, shared, counting=True)
        memo: dict[str, int] = {}
        for batch in batches:
            values = batch.column(width).to_pylist()
            if messages:
                lists = [[t for _, t in (_text.turns_of(v) or ()) if t] for v in values]
                fresh = [t for t in set(chain.from_iterable(lists)) if t not in memo]
                if len(memo) + len(fresh) > 60_000:
                    memo.clear()
                    fresh = list(set(chain.from_iterable(lists)))
                memo.update(zip(fresh, encoder.batch(fresh)))
                counts = [sum(map(memo.__getitem__, ts)) for ts in lists]
            else:
                counts = encoder.batch(values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(counts, pa.int64())], names=[*id_cols, "n_tokens"])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in id_cols) + ", n_tokens bigint"
    return df.select(*id_cols, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def spelled(lang: Column) -> Column:
    """Join key of a language label: trimmed lower case."""
    return F.lower(F.trim(lang))


def token_budget(samples: DataFrame, alias: DataFrame, by: tuple[str, ...] = ("source", "lang", "domain"), text_col: str = "messages", tokenizer: str = DEFAULT_TOKENIZER, directory: str | None = None) -> DataFrame:
    """Samples and tokens by ``by`` with ``lang`` brought to one spelling.

    Labels without a listed spelling (also null and blank ones) fall in the group with ``lang`` null; null sources
    and domains form groups of their own. Totals are partial sums per partition before the only shuffle, so a hot
    source costs one row per partition. ``alias`` is a fixed-size dimension of spellings.
    """
    counted = count_tokens(samples, list(by), text_col, tokenizer, directory, messages=True)
    first = counted.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    names = alias.select(F.col("alias").alias("_alias"), F.col("lang").alias("_lang")).dropDuplicates(["_alias"])
    joined = first.join(names, spelled(F.col("lang")) == F.col("_alias"), "left") if "lang" in by else first
    keys = [F.col("_lang").alias("lang") if c == "lang" else F.col(c) for c in by]
    return joined.groupBy(*keys).agg(F.sum("n").alias("n_samples"), F.sum("t").alias("n_tokens"))
