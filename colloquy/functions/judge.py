"""Column functions on the replies of a judge model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import squeeze
from colloquy.schemas import CRITERIA

# Further spellings of criteria in replies.
KEY_ALIASES = {"context fit & coherence": "coherence", "context_fit": "coherence", "naturalness / realism": "naturalness", "naturalness_realism": "naturalness"}


def reply_json(text: Column) -> Column:
    """The reply without code fences."""
    return squeeze(F.regexp_replace(F.regexp_replace(squeeze(text), r"```json\s*", ""), r"```\s*", ""))


def parsed_scores(text: Column) -> Column:
    """Struct of the six scores (clamped to 1..5, missing ones null), ``brief_justification`` (default empty) and
    ``error`` (null where the reply could be read): unreadable JSON or a score that is no whole number is an error.

    Fractions of JSON numbers are cut off; texts must be whole numbers (F23, J9).
    """
    raw = F.from_json(reply_json(text), "map<string,string>")
    keyed = F.transform_keys(raw, lambda k, _: F.lower(F.trim(k)))
    fields, bad = [], F.lit(False)
    for name in CRITERIA:
        spellings = [name, *[k for k, v in KEY_ALIASES.items() if v == name]]
        value = F.coalesce(*[F.try_element_at(keyed, F.lit(k)) for k in spellings])
        present = F.lit(False)
        for k in spellings:
            present = present | F.coalesce(F.map_contains_key(keyed, k), F.lit(False))
        whole = F.try_to_number(F.regexp_extract(value, r"^\s*([+-]?\d{1,9})(?:\.\d+)?\s*$", 1), F.lit("S999999999")).cast("int")
        quoted = F.regexp_like(reply_json(text), F.lit(rf'(?i)"\s*(?:{"|".join(spellings)})\s*"\s*:\s*"\s*[+-]?\d+\.'))
        bad = bad | (present & (whole.isNull() | quoted))
        fields.append(F.when(whole.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), whole))).alias(name))
    error = F.when(raw.isNull(), "unreadable reply").when(bad, "score is no whole number")
    return F.struct(*fields, F.coalesce(F.try_element_at(keyed, F.lit("brief_justification")), F.lit("")).alias("brief_justification"), error.alias("error"))


def row_average(*scores: Column) -> Column:
    """Mean of all criteria to two decimals, missing ones counting 0."""
    return F.round(sum((F.coalesce(s, F.lit(0)) for s in scores), F.lit(0)) / len(scores), 2)
