"""Training samples from transcripts and dialogues: turns, windows, routing, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import dialogue as D
from colloquy.functions import text as X

CONTEXT_TURNS = 6


def context_windows(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", target: str = "assistant", size: int = CONTEXT_TURNS, first: Column | None = None) -> DataFrame:
    """A row for each non-empty target turn with the up to ``size`` turns before it, in order.

    The frame counts all turns; empty ones are dropped after framing. ``first``, a text per row, leads every sample
    as a system message. Result: ``conv``, ``order``, ``messages`` of ``{role, content}``. One shuffle by dialogue.
    """
    w = Window.partitionBy(conv).orderBy(order).rowsBetween(-size, -1)
    message = F.struct(F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    framed = turns.select("*", message.alias("_own"), F.collect_list(message).over(w).alias("_before"))
    wanted = framed.where((F.col(role) == target) & (F.col("_own.content") != ""))
    lead = F.array(F.struct(F.lit("system").alias("role"), first.alias("content"))) if first is not None else F.array().cast("array<struct<role: string, content: string>>")
    kept = F.filter("_before", lambda m: m["content"] != "")
    return wanted.select(conv, order, F.concat(lead, kept, F.array("_own")).alias("messages"))


def array_windows(df: DataFrame, key: str, messages: Column, target: str = "assistant", size: int = CONTEXT_TURNS, lead: Column | None = None) -> DataFrame:
    """``context_windows`` of rows that hold a whole dialogue as array of ``{role, content}``: windows are cut inside the
    row, without a shuffle. ``lead`` is an array put before every window."""
    said = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    placed = df.select(key, said.alias("t")).select(key, "t", F.posexplode("t").alias("turn", "own")).where((F.col("own.role") == target) & (F.col("own.content") != ""))
    before = F.slice("t", F.greatest(F.lit(1), F.col("turn") + 1 - size), F.least(F.lit(size), F.col("turn")))
    window = F.concat(F.filter(before, lambda m: m["content"] != ""), F.array("own"))
    return placed.select(key, "turn", (window if lead is None else F.concat(lead, window)).alias("messages"))


def labels_of(lang: Column) -> tuple[Column, Column]:
    """Speaker labels of a language, English where it is unknown."""
    return tuple(D.by_language(lang, lambda code, i=i: F.lit(D.LABELS[code][i])) for i in (0, 1))


def _turn_array(text: Column, labels: tuple) -> Column:
    """The turns of a transcript as array of ``{role, content}``; labels are texts or columns."""
    therapist, client = (x if isinstance(x, Column) else F.lit(x) for x in labels)
    mark = lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))
    pieces = F.filter(F.transform(F.split(X.squeeze(text), F.concat(F.lit("(?=(?:"), mark(therapist), F.lit("|"), mark(client), F.lit("))"))), X.squeeze), lambda x: x != "")

    def turn(p: Column) -> Column:
        is_t, is_c = F.startswith(p, therapist), F.startswith(p, client)
        content = F.when(is_t, D.without_end(X.squeeze(F.replace(p, therapist, F.lit(""))))).when(is_c, X.squeeze(F.replace(p, client, F.lit("")))).otherwise(F.lit(""))
        return F.struct(F.when(is_t, "assistant").when(is_c, "user").alias("role"), content.alias("content"))

    return F.transform(pieces, turn)


def transcript_turns(texts: DataFrame, labels: tuple, key: str = "path") -> DataFrame:
    """Turns of whole transcripts: ``key``, ``turn`` from 0, ``role`` (assistant, user or null before the first label)
    and ``text`` without label; end markers leave therapist turns only (F4-F6, W2). ``labels`` are two texts, or two
    columns where transcripts of several languages are read at once (``labels_of``)."""
    pieces = texts.select(key, F.posexplode(_turn_array(F.col("text"), labels)).alias("turn", "p"))
    return pieces.select(key, "turn", F.col("p.role").alias("role"), F.col("p.content").alias("text"))


def transcript_samples(texts: DataFrame, labels: tuple, system: str, key: str = "path", size: int = CONTEXT_TURNS) -> DataFrame:
    """Samples of whole transcripts without a shuffle: windows are cut inside each row's turn array."""
    spoken = F.transform(_turn_array(F.col("text"), labels), lambda m: F.struct(m["role"].alias("role"), F.when(m["role"].isNotNull(), m["content"]).alias("content")))
    lead = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return array_windows(texts, key, spoken, size=size, lead=lead)


def allowed_languages(df: DataFrame, langs: tuple[str, ...], lang: str = "lang") -> DataFrame:
    """Rows of the languages of a list."""
    return df.where(F.col(lang).isin(*langs))


def routed(texts: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``split`` and ``subset`` from the path."""
    return texts.withColumns({"split": X.split_of(F.col(path)), "subset": X.subset_of(F.col(path))})


def sample_counts(samples: DataFrame, lang: str = "lang") -> DataFrame:
    """Rows per language by subset and split, and test rows set aside (A1, P7); one partial aggregate."""
    cells = [(s, p) for s in ("control", "mdd") for p in ("train", "dev")]
    counts = [F.count_if((F.col("subset") == s) & (F.col("split") == p)).alias(f"{s}_{p}") for s, p in cells]
    return samples.groupBy(lang).agg(*counts, F.count_if(F.col("split") == "test").alias("skipped_test"))


def languages_with_training(samples: DataFrame, lang: str = "lang") -> DataFrame:
    """Rows of languages that have training rows."""
    return samples.join(samples.where("split = 'train'").select(lang).distinct(), lang, "left_semi")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows (all if there are fewer), the same for a seed on every run."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def capped(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group in order."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in order (O3): a top-k per partition, then of those."""
    return df.orderBy(order).limit(n)


def latest_checkpoint(names: DataFrame, name: str = "name") -> DataFrame:
    """The name with the largest number behind its last dash (O5); names without one do not take part."""
    number = F.regexp_extract(name, r"-(\d{1,18})$", 1)
    return names.where(number != "").agg(F.max_by(F.col(name), number.cast("long")).alias(name))
