"""Scalar text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and single marks; the same in Java and RE2, for all scripts.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"


def tokens(col: Column) -> Column:
    """Lower-cased words and single punctuation marks (F1); null stays null."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN), F.lit(0))


def words(col: Column) -> Column:
    """Lower-cased words only."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))


def squeeze(col: Column) -> Column:
    """Trim white space of any kind at both ends."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def whitespace_count(col: Column) -> Column:
    """Number of white-space separated pieces (A3); null counts 0."""
    return F.coalesce(F.size(F.filter(F.split(col, r"\s+"), lambda x: x != "")), F.lit(0))


def short_id(name: Column) -> Column:
    """Leftmost ``notactiveN``, ``activeN`` or ``controlN`` in lower case, else the name without its last suffix (F2)."""
    found = F.lower(F.regexp_extract(name, r"(?i)(notactive|active|control)\d+", 0))
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.when(found != "", found).otherwise(stem)


def format_double(col: Column, digits: int = 4) -> Column:
    """Fixed decimals, or ``nan`` where undefined."""
    value = col.cast("double")
    return F.when(value.isNull() | F.isnan(value), "nan").otherwise(F.format_string(f"%.{digits}f", value))


def normalise(col: Column) -> Column:
    """Trim, lower case, straight quotes, plain dashes, single spaces."""
    plain = F.translate(F.lower(squeeze(col)), "’`“”—–", "''\"\"--")
    return F.regexp_replace(plain, r"\s+", " ")


def shorten(col: Column, n: int = 300, tail: str = "...[TRUNCATED]") -> Column:
    """The first ``n`` characters with line breaks shown as ``\\n``, marked if cut."""
    flat = F.replace(col, F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.substring(flat, 1, n), F.lit(tail)))


def slashes(path: Column) -> Column:
    """Backslashes as slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def path_name(path: Column) -> Column:
    """Last path part up to its first dot."""
    return F.split(F.element_at(F.split(slashes(path), "/"), -1), r"\.")[0]


def path_style(path: Column) -> Column:
    """Third-last path part, null for shorter paths."""
    parts = F.split(slashes(path), "/")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -3))


def path_suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def split_of(path: Column) -> Column:
    """train, dev or test by the first of these folders in this order, else train (P5)."""
    p = slashes(path)
    return F.when(F.contains(p, F.lit("/train/")), "train").when(F.contains(p, F.lit("/dev/")), "dev").when(F.contains(p, F.lit("/test/")), "test").otherwise("train")


def subset_of(path: Column) -> Column:
    """mdd if such a folder is in the path, else control."""
    return F.when(F.contains(slashes(path), F.lit("/mdd/")), "mdd").otherwise("control")


def elapsed(seconds: Column) -> Column:
    """``h:m:s`` of whole seconds."""
    s = F.floor(seconds)
    return F.concat_ws(":", F.floor(s / 3600).cast("string"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string"), F.pmod(s, F.lit(60)).cast("string"))


def stamped(name: Column, at: Column) -> Column:
    """Name with a minute stamp."""
    return F.concat(name, F.lit("_"), F.date_format(at, "yyyy-MM-dd_HH-mm"))


def instruction(source: Column, target: Column) -> Column:
    """Input and output as one training text."""
    return F.concat(source, F.lit(" "), target)


def error_text(col: Column, n: int = 200) -> Column:
    """First characters of an error message (F32)."""
    return F.substring(col, 1, n)
