"""Same or near-same records across splits (problem 5), by an inverted full-text index.

The messages of the evaluation splits form the shards of an index: for every run of ``LEAST`` words, the passages that
hold it. Training samples are streamed through it. Every place of a message is looked up; a match is extended backwards
as long as all its texts go along. Such matches are merged and the words they cover are counted for every evaluation
passage. Passages that share enough words of a training passage are compared with it as a whole, where they meet.

Matches differ in how many passages hold them. As a passage must share ``COVER`` of the training passage's places, it
cannot do so by the most frequent matches alone as long as these make up less than that; so up to ``SKIP`` of the
places, the most frequent matches are not followed up, and still no passage is lost. What they could add is granted to
every passage.

The index lies in the folder all executors share, so a lost executor costs its tasks only. Training data is read
once, without a shuffle; what is shuffled are evaluation messages (to their shards) and the pairs found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import _text
from colloquy.session import shared_dir

#: Characters of evaluation rows per index shard: some twenty million words, of which windows of one dialogue share most;
#: built within a worker's memory, searched from a mapped file.
SHARD_CHARS = 120_000_000
#: Shortest match that counts, in words.
LEAST = 5
#: Share of a training passage's places (words that begin a match) that an evaluation passage must share, and the share
#: of them, in the most frequent matches, that is granted instead of counted. With SKIP below COVER nothing is lost by it.
COVER, SKIP = 0.4, 0.3
#: Rows are cut into chunks of so many a shard at least, so that shards come out near the same size.
CHUNKS = 16
#: Occurrences of matches in passages are worked off in slices of so many, pairs compared by class likewise.
OCCURRENCES, COMPARED = 1_000_000, 4_096
#: Matches that so many passages hold at most are counted together.
FEW = 40
#: Classes of words by which passages are compared before the exact check; a full count in a byte says nothing.
BAG, FULL = 256, 255
#: Training rows that visit a shard together, and those of them that are searched at a time.
BATCH_ROWS, SEARCH_ROWS = 10_000, 400
#: Share of common words (longest common subsequence, both sides) of the whole passage, and of its last message.
SAME, SAME_LAST = 0.85, 0.6


class WordIds:
    """31-bit codes of folded words, with a memo; and one of whole messages, which windows of a dialogue share."""

    def __init__(self):
        self.memo: dict[str, int] = {}
        self.texts: dict[str, np.ndarray] = {}

    def __call__(self, text: str) -> np.ndarray:
        found = self.texts.get(text)
        if found is None:
            if len(self.texts) > 10_000:
                self.texts.clear()
            found = self.texts[text] = self._codes(text)
        return found

    def _codes(self, text: str) -> np.ndarray:
        memo = self.memo
        if len(memo) > 500_000:
            memo.clear()
        found = _text.words(_text.fold(_text.plain(text)))
        codes = list(map(memo.get, found))
        if None in codes:
            for i, w in enumerate(found):
                if codes[i] is None:
                    codes[i] = memo[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) >> 1
        return np.array(codes, np.int32)


def passage(raw: str | None) -> list[str]:
    """The messages of a sample in order, without system messages and messages without content."""
    return [t for role, t in (_text.turns_of(raw) or ()) if role != "system" and t]


def message_key(words: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(words.tobytes()), "big", signed=True)


def _grams(text: np.ndarray) -> np.ndarray:
    """A code of the LEAST words from each place on; the last places are short of words and mean nothing."""
    out = np.zeros(len(text), np.uint64)
    wide = np.r_[text.astype(np.uint64), np.zeros(LEAST, np.uint64)]
    for k in range(LEAST):
        out = out * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + len(text)]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


class Rows:
    """Training rows that are searched together, prepared once for all shards: the words of their messages end to end, and
    the places that begin a run of LEAST words, in order of the run's code."""

    def __init__(self, rows: list[list[np.ndarray]]):
        self.rows = rows
        self.messages = [w for ws in rows for w in ws]
        self.of = np.repeat(np.arange(len(rows)), [len(ws) for ws in rows])
        self.sizes = np.fromiter(map(len, self.messages), np.int64, len(self.messages))
        self.totals = np.bincount(self.of, self.sizes, len(rows)).astype(np.int64)
        self.bags = np.array([_bag(ws) for ws in rows])
        self.keys = np.array([message_key(w) for w in self.messages], np.int64)
        self.words = np.concatenate(self.messages) if self.messages else np.zeros(0, np.int32)
        self.places = sorted_places(self.words, np.cumsum(self.sizes) - self.sizes, self.sizes)
        # places where no match can begin, at the ends of messages, do not count
        self.countable = np.bincount(self.of, np.where(self.sizes < LEAST, self.sizes, self.sizes - LEAST + 1), len(rows))


def sorted_places(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of messages, laid end to end in ``words``, that begin a run of LEAST words, and the codes of these runs;
    in order of the codes."""
    room = np.repeat(starts + sizes, sizes) - np.arange(len(words))
    begin = np.flatnonzero(room >= LEAST).astype(np.int32)
    code = _grams(words.astype(np.int64) + 1)[begin]
    order = np.argsort(code, kind="stable")
    return begin[order], code[order]


class Shard:
    """Inverted index of one shard: the passages that hold each run of LEAST words, once for each place; and the shard's
    passages: which messages they consist of, their words by class, and the size of their last message."""

    def __init__(self, grams, left, twice, spread, passages, held, keys, words, starts, codes, bags, lists, ends):
        self.grams, self.left, self.twice, self.keys = grams, left, twice, keys
        self.words, self.starts = words, starts
        self._by_key = np.argsort(keys, kind="stable")
        self._sorted_keys = keys[self._by_key]
        # passages: ``lists`` are the numbers of their messages in order, ``ends`` where each passage's list ends
        self.codes, self.bags, self.lists = codes, bags.reshape(-1, BAG), lists
        self.firsts = np.r_[0, ends[:-1]] if len(ends) else ends
        self.sizes = np.diff(np.r_[starts, len(words)])
        many = np.diff(np.r_[0, ends])
        self.totals = np.bincount(np.repeat(np.arange(len(ends)), many), self.sizes[lists], len(ends)).astype(np.int64)
        self.tails = self.sizes[lists[ends - 1]] if len(ends) else ends
        # ``passages`` are those that hold each run, in order of the runs, and ``spread`` tells where those of a run begin;
        # behind them come the passages of each message, from ``held`` on
        self.spread, self.passages, self.held = spread, passages, held
        self.begins = np.r_[spread[:-1], held]

    @staticmethod
    def build(messages: list[np.ndarray], keys: np.ndarray, codes: np.ndarray, bags: np.ndarray, lists: list[np.ndarray]) -> dict[str, np.ndarray]:
        """The parts of the index, as they are stored. ``messages`` are distinct and not empty; ``lists`` are the numbers
        of the messages of each passage. Passages are kept in order of their words' number."""
        order = np.argsort([sum(len(messages[m]) for m in x) for x in lists], kind="stable")
        codes, bags, lists = codes[order], bags.reshape(-1, BAG)[order], [lists[i] for i in order]
        sizes = np.fromiter(map(len, messages), np.int64, len(messages))
        starts = np.cumsum(sizes) - sizes
        words = np.concatenate(messages).astype(np.int32)
        parts = {"keys": keys.astype(np.int64), "words": words, "starts": starts}
        parts |= {"codes": codes.astype(np.int64), "bags": bags.astype(np.uint8), "lists": np.concatenate(lists).astype(np.int32), "ends": np.cumsum([len(x) for x in lists], dtype=np.int64)}
        places, code = sorted_places(words, starts, sizes)
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        parts["grams"] = code[first]
        del code
        # the run one place before, if all texts of a run go along to it and it has no others
        number = np.full(len(words) + 1, -1, np.int32)
        many = np.diff(np.r_[first, len(places)])
        number[places] = np.repeat(np.arange(len(first), dtype=np.int32), many)
        head = np.zeros(len(words), bool)
        head[starts] = True
        before = np.where(head[places], -1, number[places - 1])
        del number, head
        left = np.full(len(first), -1, np.int32)
        if len(first):
            least, most = np.minimum.reduceat(before, first), np.maximum.reduceat(before, first)
            left = np.where((least == most) & (least >= 0) & (many[np.maximum(least, 0)] == many), least, -1).astype(np.int32)
        parts["left"] = left
        del before
        # the passages of each message, and of the message of each place
        by_message = np.argsort(parts["lists"], kind="stable")
        holders = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])[by_message]
        held = np.searchsorted(parts["lists"][by_message], np.arange(len(sizes) + 1))
        owners = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[places]
        del places
        ends = np.r_[0, np.cumsum(np.diff(held)[owners])]
        passages = np.empty(int(ends[-1]) + len(holders), np.int32)
        at = 0
        while at < len(owners):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + OCCURRENCES, "right")) - 1)
            own = owners[at:stop]
            passages[ends[at] : ends[stop]] = holders[_ranges(held[own], held[own + 1] - held[own])]
            at = stop
        passages[ends[-1] :] = holders
        parts |= {"passages": passages, "held": ends[-1] + held, "spread": ends[np.r_[first, len(owners)]]}
        # which runs, and behind them messages, some passage holds more than once
        begins = np.r_[parts["spread"][:-1], parts["held"]]
        parts["twice"] = np.zeros(len(begins) - 1, bool)
        at = 0
        while at < len(begins) - 1:
            stop = max(at + 1, int(np.searchsorted(begins, begins[at] + OCCURRENCES, "right")) - 1)
            of = np.repeat(np.arange(stop - at), np.diff(begins[at : stop + 1]))
            pair = np.sort(of * np.int64(len(lists)) + passages[begins[at] : begins[stop]])
            parts["twice"][at + pair[1:][pair[1:] == pair[:-1]] // len(lists)] = True
            at = stop
        return {k: np.ascontiguousarray(v) for k, v in parts.items()}

    @classmethod
    def load(cls, parts: dict) -> Shard:
        return cls(**{k: np.frombuffer(parts[k], t) for k, t in PARTS.items()})

    def equal(self, keys: np.ndarray) -> np.ndarray:
        """Number of the shard's message with the same words, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self._sorted_keys, keys), len(self.keys) - 1)
        return np.where(self._sorted_keys[at] == keys, self._by_key[at], -1)

    def matches(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
        """``(message, places, low, high)``: the matches of many messages at once, laid end to end in ``words``. Each stands
        for so many neighbouring places and for the interval of the runs whose passages hold it."""
        begin, code = places or sorted_places(words, starts, sizes)
        if not len(begin) or not len(self.grams):
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        # in order of the directory, so that neighbouring searches share its cached parts
        at = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
        hit = self.grams[at] == code
        gram = np.full(len(words), -1)
        gram[begin[hit]] = at[hit]
        place = np.flatnonzero(gram >= 0)
        gram = gram[place]
        owner = np.repeat(np.arange(len(sizes)), sizes)[place]
        apart = np.ones(len(place), bool)
        apart[1:] = (np.diff(place) != 1) | (owner[1:] != owner[:-1]) | (self.left[gram[1:]] != gram[:-1])
        first = np.flatnonzero(apart)
        return owner[first], np.diff(np.r_[first, len(place)]), gram[first], gram[first] + 1

    def passage(self, number: int) -> np.ndarray:
        first, many = self.firsts[number], self.firsts[number + 1] if number + 1 < len(self.firsts) else len(self.lists)
        return np.concatenate([self.words[self.starts[m] : self.starts[m] + self.sizes[m]] for m in self.lists[first:many].tolist()])

    def candidates(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """``(row, passage)``: training rows and the passages that cover at least ``COVER`` of their places and are not too
        unlike in length and words for the exact check."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not rows.messages or not len(self.codes):
            return none
        of, sizes, totals = rows.of, rows.sizes, rows.totals
        which, weight, run, _ = self.matches(rows.words, np.cumsum(sizes) - sizes, sizes, rows.places)
        row = of[which]
        # a message shorter than a match corresponds if the shard has it; a word of its own tells its passages
        same = self.equal(rows.keys)
        short = np.flatnonzero((sizes < LEAST) & (same >= 0))
        row, weight, run = np.r_[row, of[short]], np.r_[weight, sizes[short]], np.r_[run, len(self.grams) + same[short]]
        many = self.begins[run + 1] - self.begins[run]
        # the most frequent matches of each row first
        order = np.lexsort((-many, row))
        row, weight, run, many = row[order], weight[order], run[order], many[order]
        reached = np.cumsum(weight)
        begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        before = np.repeat((reached - weight)[begins], np.diff(np.r_[begins, len(row)]))
        skip = reached - before <= SKIP * totals[row]
        granted = np.bincount(row[skip], weight[skip], len(totals))
        row, weight, run, many = (c[~skip] for c in (row, weight, run, many))
        need = np.maximum(1, COVER * rows.countable - granted)
        # passages too unlike in length fail the exact check; they are in order of length
        first, last = np.searchsorted(self.totals, [SAME / (2 - SAME) * totals - 1e-6, (2 - SAME) / SAME * totals + 1e-6])
        cut = np.searchsorted(row, np.arange(len(totals) + 1))
        found, covered = [none], np.zeros(len(self.codes), np.int32)
        for r in np.flatnonzero(np.diff(cut)).tolist():
            part = slice(cut[r], cut[r + 1])
            covered[:] = 0
            self._cover(covered, run[part], many[part], weight[part])
            near = first[r] + np.flatnonzero(covered[first[r] : last[r]] >= need[r])
            for k in range(0, len(near), COMPARED):
                found.append(self._alike(rows, r, near[k : k + COMPARED]))
        return tuple(np.concatenate(c).astype(np.int64) for c in zip(*found))

    def _cover(self, covered: np.ndarray, run: np.ndarray, many: np.ndarray, weight: np.ndarray) -> None:
        """Add the places of one row's matches to the passages that hold them."""
        single = (many > FEW) & ~self.twice[run]
        for a, n, w in zip(self.begins[run[single]].tolist(), many[single].tolist(), weight[single].tolist()):
            covered[self.passages[a : a + n]] += w
        run, many, weight = run[~single], many[~single], weight[~single]
        ends, at = np.r_[0, np.cumsum(many)], 0
        while at < len(run):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + OCCURRENCES, "right")) - 1)
            part = slice(at, stop)
            np.add.at(covered, self.passages[_ranges(self.begins[run[part]], many[part])], np.repeat(weight[part], many[part]).astype(np.int32))
            at = stop

    def _alike(self, rows: Rows, row: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The passages with enough common words by class, which are never fewer than those the exact check finds."""
        common = np.minimum(rows.bags[row], self.bags[near])
        keep = 2 * common.sum(1, dtype=np.uint32) >= SAME * (rows.totals[row] + self.totals[near])
        if rows.bags[row].max() == FULL:
            keep |= (common == FULL).any(1)
        return np.full(int(keep.sum()), row), near[keep]


#: Parts of a stored shard and their kinds.
PARTS = {"grams": np.int64, "left": np.int32, "twice": np.bool_, "spread": np.int64, "passages": np.int32, "held": np.int64, "keys": np.int64, "words": np.int32, "starts": np.int64, "codes": np.int64, "bags": np.uint8, "lists": np.int32, "ends": np.int64}


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the ranges that begin at ``starts``, one behind the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


_WORDS = WordIds()
_LOADED: dict[str, tuple[str, object]] = {}


def _held(kind: str, path: str, load):
    """What was loaded last of a kind, or ``path`` loaded in its place: a worker holds one shard and one slice."""
    if _LOADED.get(kind, ("",))[0] != path:
        _LOADED.pop(kind, None)
        _LOADED[kind] = (path, load())
    return _LOADED[kind][1]


def store(parts: dict[str, np.ndarray], path: str) -> None:
    """Write a shard as one file of plain arrays."""
    columns = [pa.Array.from_buffers(pa.large_binary(), 1, [None, pa.py_buffer(np.array([0, v.nbytes], np.int64)), pa.py_buffer(v.reshape(-1).view(np.uint8))]) for v in parts.values()]
    batch = pa.RecordBatch.from_arrays(columns, names=list(parts))
    files, inner = pyarrow.fs.FileSystem.from_uri(path)
    files.create_dir(inner.rsplit("/", 1)[0])
    with files.open_output_stream(inner) as out, pa.ipc.new_file(out, batch.schema) as writer:
        writer.write_batch(batch)


def _read(path: str) -> Shard:
    """A stored shard. From a local folder it is mapped: the workers of a machine share it, and what memory it takes is
    given back under pressure."""
    files, inner = pyarrow.fs.FileSystem.from_uri(path)
    local = isinstance(files, pyarrow.fs.LocalFileSystem)
    with pa.memory_map(inner) if local else files.open_input_file(inner) as f:
        batch = pa.ipc.open_file(f).get_batch(0)
    return Shard.load({c: batch.column(c)[0].as_buffer() for c in batch.schema.names})


def _shards(paths: list[str]) -> Iterator[Shard]:
    """The shards of an index one after another."""
    for path in paths:
        yield _held("shard", path, lambda path=path: _read(path))


def _bag(words: list[np.ndarray]) -> np.ndarray:
    """Number of words of each class, ``FULL`` at most."""
    counts = np.bincount(np.concatenate(words) % BAG, minlength=BAG) if words else np.zeros(BAG, np.int64)
    return np.minimum(counts, FULL).astype(np.uint8)


def evaluation_messages(rows: DataFrame, id_col: str, text_col: str, chunk_chars: int) -> DataFrame:
    """``id``, ``code`` of the passage, its ``chunk`` and number of characters; and, where the chunk has not had them
    before: its ``bag``, the ``keys`` of its messages and their ``words``. A chunk is a run of neighbouring rows, which
    share most messages where they are windows of one dialogue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        messages: set[int] = set()
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            take, codes, places, chars, bags, lists, texts = [], [], [], [], [], [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                words = [w for w in map(_WORDS, passage(raw)) if len(w)]
                if not words:
                    continue
                keys = [message_key(w) for w in words]
                code = int.from_bytes(xxhash.xxh64_digest(np.array(keys, np.int64).tobytes()), "big", signed=True)
                if held >= chunk_chars:
                    chunk, held = chunk + 1, 0
                    seen.clear()
                    messages.clear()
                take.append(i)
                codes.append(code)
                places.append(chunk)
                if code in seen:
                    chars.append(0), bags.append(None), lists.append(None), texts.append(None)
                    continue
                seen.add(code)
                held += len(raw)
                chars.append(len(raw))
                bags.append(_bag(words).tobytes())
                lists.append(keys)
                texts.append([None if k in messages else w.tobytes() for k, w in zip(keys, words)])
                messages.update(keys)
            columns = [batch.column(0).take(pa.array(take, pa.int32())), pa.array(codes, pa.int64()), pa.array(places, pa.int64()), pa.array(chars, pa.int64()), pa.array(bags, pa.binary()), pa.array(lists, pa.list_(pa.int64())), pa.array(texts, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "code", "chunk", "chars", "bag", "keys", "words"])

    kind = dict(rows.dtypes)[id_col]
    return rows.select(F.col(id_col), F.col(text_col).cast("string").alias("_t")).mapInArrow(run, f"id {kind}, code bigint, chunk bigint, chars bigint, bag binary, keys array<bigint>, words array<binary>")


def shards_of(messages: DataFrame, shard_chars: int) -> dict[int, int]:
    """Shard of each chunk: neighbouring chunks of ``shard_chars`` together. There are a few chunks a shard and task."""
    out, shard, held = {}, 0, 0
    for r in messages.groupBy("chunk").agg(F.sum("chars").alias("n")).orderBy("chunk").collect():
        if held and held + r["n"] > shard_chars:
            shard, held = shard + 1, 0
        out[r["chunk"]] = shard
        held += r["n"]
    return out


def build_index(messages: DataFrame, path: str, shards: dict[int, int]) -> list[str]:
    """Write the shards' indexes below ``path``, one task per shard, and return their files."""

    def build(table: pa.Table) -> pa.Table:
        lists = table.column("keys").combine_chunks()
        keys, words = lists.flatten().to_numpy(), table.column("words").combine_chunks().flatten()
        held = np.flatnonzero(~words.is_null().to_numpy(zero_copy_only=False))
        distinct, first = np.unique(keys[held], return_index=True)
        texts = [np.frombuffer(w.as_buffer(), np.int32) for w in words.take(pa.array(held[first]))]
        codes, rows = np.unique(table.column("code").to_numpy(), return_index=True)
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        numbers = np.searchsorted(distinct, keys)
        bags = np.frombuffer(b"".join(table.column("bag").take(pa.array(rows)).to_pylist()), np.uint8)
        parts = Shard.build(texts, distinct, codes, bags, [numbers[a : a + n] for a, n in zip(starts[rows].tolist(), sizes[rows].tolist())])
        # an attempt that fails or comes second leaves a file that nobody reads
        file = f"{path}/{uuid.uuid4().hex}.arrow"
        store(parts, file)
        return pa.table({"file": pa.array([file], pa.string())})

    spark = messages.sparkSession
    of = F.broadcast(spark.createDataFrame(list(shards.items()) or [(0, 0)], "chunk bigint, shard int"))
    rows = messages.where("keys is not null").join(of, "chunk").select("shard", "code", "bag", "keys", "words")
    return [r["file"] for r in rows.repartition(max(1, len({*shards.values()})), "shard").groupBy("shard").applyInArrow(build, "file string").collect()]


def streamed_pairs(rows: DataFrame, id_col: str, text_col: str, index: list[str]) -> DataFrame:
    """``train_id``, ``code``, ``shared_words``, ``share``: training rows streamed through the index, and the codes of the
    evaluation passages that are the same as theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from search(batches)
        finally:
            # workers outlive their tasks
            _LOADED.clear()
            _WORDS.memo.clear()
            _WORDS.texts.clear()
            pa.default_memory_pool().release_unused()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(begin, BATCH_ROWS)
                groups = []
                for lead in range(0, batch.num_rows, SEARCH_ROWS):
                    own = [[w for w in map(_WORDS, passage(raw)) if len(w)] for raw in batch.column(1).slice(lead, SEARCH_ROWS).to_pylist()]
                    groups.append((lead, Rows(own)))
                for shard in _shards(index):
                    for lead, own in groups:
                        found = _met(shard, own)
                        if found:
                            row, code, shared, share = zip(*found)
                            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lead).take(pa.array(row, pa.int64())), pa.array(code, pa.int64()), pa.array(shared, pa.int32()), pa.array(share, pa.float64())], names=["train_id", "code", "shared_words", "share"])

    kind = dict(rows.dtypes)[id_col]
    return rows.select(F.col(id_col), F.col(text_col).cast("string").alias("_t")).mapInArrow(run, f"train_id {kind}, code bigint, shared_words int, share double")


def _met(shard: Shard, group: Rows) -> list[tuple[int, int, int, float]]:
    """``(row, code, shared words, share)`` of the passages of a shard that are the same as those of the rows."""
    rows = group.rows
    row, other = shard.candidates(group)
    out, memo = [], {}
    flat: dict[int, np.ndarray] = {}
    for r, p in zip(row.tolist(), other.tolist()):
        if r not in flat:
            flat[r] = np.concatenate(rows[r])
        # equal passages (deliveries of one sample, hot copies) are compared once
        key = (flat[r].tobytes(), len(rows[r][-1]), p)
        if key not in memo:
            memo[key] = _compare(flat[r], len(rows[r][-1]), shard.passage(p), int(shard.tails[p]))
        if memo[key]:
            out.append((r, int(shard.codes[p]), *memo[key]))
    return out


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the shorter side."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _compare(a: np.ndarray, tail_a: int, b: np.ndarray, tail_b: int) -> tuple[int, float] | None:
    if not len(a) or not len(b) or 2 * min(len(a), len(b)) < SAME * (len(a) + len(b)):
        return None
    shared = common_words(a, b)
    share = 2 * shared / (len(a) + len(b))
    if share < SAME:
        return None
    if max(tail_a, tail_b) >= LEAST and 2 * common_words(a[-tail_a:], b[-tail_b:]) < SAME_LAST * (tail_a + tail_b):
        return None
    return shared, share


def cross_split_overlaps(samples: DataFrame, id_col: str = "sample_id", text_col: str = "messages", split_col: str = "split", train: str = "train", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``train_id``, ``eval_id``, ``shared_words`` and ``share`` for each training and evaluation row with the same
    passage up to layout and small edits.

    Every delivery under an id of its own counts; rows repeated under one id count once. Rows with null or unreadable
    texts, or without words, pair with nothing; a null split belongs to neither side. Evaluation rows of equal passages
    are one passage of the index and are told apart by the last join only.
    """
    spark = samples.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/overlap-{uuid.uuid4().hex}"
    held = samples.where(F.col(split_col) != train)
    evaluation_messages(held, id_col, text_col, max(1, shard_chars // CHUNKS)).write.parquet(f"{base}/messages")
    messages = spark.read.parquet(f"{base}/messages")
    index = build_index(messages, f"{base}/index", shards_of(messages, shard_chars))
    streamed = streamed_pairs(samples.where(F.col(split_col) == train), id_col, text_col, index)
    once = streamed.groupBy("train_id", "code").agg(F.max("shared_words").alias("shared_words"), F.max("share").alias("share"))
    members = messages.select(F.col("id").alias("eval_id"), "code").distinct()
    return once.join(members, "code").select("train_id", "eval_id", "shared_words", "share")
