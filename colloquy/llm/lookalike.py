"""Visually identical texts (problem 9): confusables skeletons and groups of equal skeleton.

The skeleton decomposes a text, replaces every character by its prototype, and decomposes again. Only differences
that no reader sees are levelled: full-width and presentation forms, ligature characters, combining against composed
accents, zero-width characters, white spaces of any width, look-alike letters of other scripts. Accents, case, digits
of another shape, superscripts and circled digits stay different.

The look-alike table is the public confusables table (UTS 39) as Spark's own ICU library holds it, read once on the
driver, for letters that look like ASCII letters. Visible exceptions to it: ASCII characters are prototypes of their own
(``l``, ``I``, ``1`` and ``|`` stay apart), a look-alike of several of them takes that of its compatibility form or its
case, and punctuation and letters of several parts (``œ``, ``æ``) stay as they are.
"""

from __future__ import annotations

import string
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import materialise

# Look-alike letters and marks (other script -> prototype), in natural order.
LOOKALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I",
    # Cyrillic small letters
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "ү": "y", "х": "x", "ԝ": "w", "ѵ": "v",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Greek small letters
    "ο": "o", "ϲ": "c", "ϳ": "j", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u",
    # Armenian and Latin
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "ɡ": "g", "ı": "i", "ɑ": "a",
    # Arabic letters of other alphabets
    "ی": "ي", "ک": "ك", "ھ": "ه", "ہ": "ه", "ە": "ه",
    # Hyphens, dots, apostrophes and slashes that show alike
    "‐": "-", "‑": "-", "﹣": "-", "⁃": "-", "․": ".", "‚": ",", "ʼ": "’", "ꞌ": "'", "∕": "/", "⁄": "/", "∶": ":", "ː": ":",
}

#: Compatibility decompositions that keep the look of a text.
_SAME_LOOK = ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>", "<font>")
_JOINER, _KEPT = "\u200d", "\ue000"  # the second stands for joiners that show, while the table is applied


def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters that look like one ASCII letter, and that letter, after the public table (see above). A few thousand
    entries at most: bounded by the code space, not by the data."""
    wanted = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lo", "Lm", "Nl") and unicodedata.bidirectional(chr(c)) == "L" and not unicodedata.decomposition(chr(c))]
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    # one call: no prototype holds a line break
    shown = checker.getSkeleton("\n".join([*string.ascii_letters, *wanted])).split("\n")
    letters: dict[str, list[str]] = {}
    for letter, form in zip(string.ascii_letters, shown):
        letters.setdefault(form, []).append(letter)
    found = {}
    for ch, form in zip(wanted, shown[len(string.ascii_letters) :]):
        alike = letters.get(form, [])
        if len(alike) > 1:
            alike = [x for x in alike if x.isupper() == ch.isupper()]
        if len(alike) == 1:
            found[ch] = alike[0]
    return found


def _prototype(ch: str, letters: dict[str, str]) -> str | None:
    """Replacement of a decomposed character, or None where it stays."""
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    if ch in letters:
        return letters[ch]
    if ch == "\n" or " " <= ch <= "~":
        return None
    kind = unicodedata.category(ch)
    if ch in "\r\x85\u2028\u2029":
        return "\n"
    if kind == "Zs" or ch in "\t\x0b\x0c":
        return " "
    if kind == "Cf" or kind == "Cc":
        return ""
    made = unicodedata.decomposition(ch)
    if made:
        tag, *points = made.split()
        # of the remaining compatibility forms, ligatures and letter numerals show the letters they stand for
        if tag in _SAME_LOOK or (tag == "<compat>" and (0xFB00 <= ord(ch) <= 0xFB4F or kind in ("Nl", "Lu", "Ll", "Lt"))):
            text = "".join(chr(int(p, 16)) for p in points)
            return "".join(c if (r := _prototype(c, letters)) is None else r for c in text)
    return None


class Table(dict):
    """Translation table built from the rules above as characters come up; bounded by the code space."""

    def __init__(self, letters: dict[str, str] | None = None):
        self.letters = letters or {}

    def __missing__(self, code: int):
        found = _prototype(chr(code), self.letters)
        self[code] = code if found is None else found
        return self[code]


_TABLE = Table()


def skeleton(text: str, table: Table = _TABLE) -> str:
    """The form in which texts that look alike are equal. Ends of lines and of the text lose invisible white space.
    Without a ``table`` of ``confusables`` only the letters named above have look-alikes."""
    if not text.isascii():
        kept = text
        if _JOINER in text:
            # between pictographs a joiner shapes one visible sign; elsewhere it shows nothing
            kept = "".join(_KEPT if c == _JOINER and 0 < i < len(text) - 1 and _pictograph(text[i - 1]) and _pictograph(text[i + 1]) else c for i, c in enumerate(text))
        text = unicodedata.normalize("NFD", unicodedata.normalize("NFD", kept).translate(table)).replace(_KEPT, _JOINER)
    elif "\r" in text or "\t" in text:
        text = text.replace("\r\n", "\n").translate(table)
    return "\n".join(line.rstrip(" ") for line in text.split("\n")).strip("\n ")


def _pictograph(ch: str) -> bool:
    return ord(ch) > 0x2190 and unicodedata.category(ch) in ("So", "Sk", "Mn")


def canonical(text: str, table: Table = _TABLE) -> str:
    """The skeleton in composed form: the readable text all look-alikes are brought to."""
    return unicodedata.normalize("NFC", skeleton(text, table))


_WORKER: list = []


def normal_forms(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``canonical``, ``skeleton_high`` and ``skeleton_low`` (a 128-bit digest of the skeleton) and ``text_key``
    (a 64-bit one of the text, which tells spellings of one skeleton apart) of every row.

    Null texts give nulls. Texts without a visible character give an empty ``canonical`` and null digests of the
    skeleton, so they match nothing. Repeated rows stay; further columns are not read. A narrow map.
    """
    kind = dict(df.dtypes)[id_col]
    shared = df.sparkSession.sparkContext.broadcast(confusables(df.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _WORKER:
            _WORKER.append(Table(shared.value))
        table = _WORKER[0]
        for batch in batches:
            forms, keys, own = [], [], []
            for text in batch.column(1).to_pylist():
                if text is None:
                    forms.append(None), keys.append(None), own.append(None)
                    continue
                form = canonical(text, table)
                forms.append(form)
                keys.append(xxhash.xxh3_128_digest(form.encode("utf-8", "surrogatepass")) if form else None)
                own.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63))
            halves = np.frombuffer(b"".join(k or bytes(16) for k in keys), np.int64).reshape(-1, 2)
            blank = np.array([k is None for k in keys], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string()), pa.array(halves[:, 0], mask=blank), pa.array(halves[:, 1], mask=blank), pa.array(own, pa.int64())], names=[id_col, "canonical", "skeleton_high", "skeleton_low", "text_key"])

    return df.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, canonical string, skeleton_high bigint, skeleton_low bigint, text_key bigint")


def lookalike_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=materialise) -> DataFrame:
    """One row ``(<id>_lo, <id>_hi)`` for each two rows of equal skeleton and different characters; rows repeated under one
    id count once.

    Spellings are paired, not rows: copies of a text are one spelling, summed up per task before they move, and are
    expanded last, to the pairs that are the stated result. Groups with one spelling, exact copies only, never meet.
    ``keep`` materialises the digests, so that texts are read once.
    """
    group = ["skeleton_high", "skeleton_low"]
    forms = keep(normal_forms(df, id_col, text_col).select(id_col, *group, "text_key").where("skeleton_high is not null"), "look-alikes")
    spellings = forms.select(*group, "text_key").distinct()
    mixed = spellings.groupBy(*group).agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a <> b").select(*group)
    several = spellings.join(mixed, group, "left_semi")
    two = several.join(several.withColumnRenamed("text_key", "other"), group).where("text_key < other")
    members = forms.join(mixed, group, "left_semi").distinct()
    left = two.join(members.withColumnRenamed(id_col, "_x"), [*group, "text_key"])
    pairs = left.join(members.select(*group, F.col("text_key").alias("other"), F.col(id_col).alias("_y")), [*group, "other"]).where("_x <> _y")
    return pairs.select(F.least("_x", "_y").alias(f"{id_col}_lo"), F.greatest("_x", "_y").alias(f"{id_col}_hi"))
