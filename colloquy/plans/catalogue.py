"""Named queries over the project's tables, each with the SQL that must give the same rows.

Every query reads its whole tables. Results are flat scalars with the same names and types on both sides; nested
values come out as joined text, undefined numbers as null.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import dialogue as D
from colloquy.functions import labels as L
from colloquy.functions import text as X
from colloquy.operators import benchmark, generation, jsontree, judging, samples, sessions, statistics, translation
from colloquy.functions.judge import KEY_ALIASES
from colloquy.schemas import CRITERIA
from colloquy.session import fixed, shared_dir
from colloquy.sources import sinks, table, text
from colloquy.streaming import sessions as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its oracle."""

    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def turns(spark: SparkSession, d: str, *carried: str) -> DataFrame:
    """Messages of each sample as turns of a session: sample_id, ``carried`` columns, turn from 0, role, text; both key
    layouts. A narrow explode."""
    flat = table(spark, d, "processed_dataset").select("sample_id", *carried, F.posexplode(D.decoded(F.col("messages"))).alias("turn", "x"))
    return flat.select("sample_id", *carried, "turn", F.col("x.role").alias("role"), F.coalesce("x.content", F.lit("")).alias("text"))


def spoken(spark: SparkSession, d: str) -> DataFrame:
    """``sample_id`` and ``m``, its messages as array of ``{role, content}`` without nulls."""
    said = F.transform(D.decoded(F.col("messages")), lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["content"], F.lit("")).alias("content")))
    return table(spark, d, "processed_dataset").select("sample_id", said.alias("m")).where("size(m) > 0")


#: The same in SQL, as common table expression ``turns``.
TURNS = """turns AS (
  SELECT sample_id, CAST(i AS INT) AS turn,
    CASE WHEN lower(x.role) IN ('assistant','therapist') THEN 'assistant' WHEN lower(x.role) IN ('user','client') THEN 'user' ELSE lower(x.role) END AS role,
    coalesce(x.content, x.response, '') AS text
  FROM (SELECT sample_id, unnest(m) AS x, unnest(range(len(m))) AS i
    FROM (SELECT sample_id, from_json(messages, '[{"role":"VARCHAR","content":"VARCHAR","response":"VARCHAR"}]') AS m FROM processed_dataset WHERE messages IS NOT NULL)))"""

WORDS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
TOKENS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\p{{Z}}]')"
STRIP_SQL = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
STRIP_ANY_SQL = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
# the other engine's classes know ASCII only: white space, line breaks, and words between white space as Python has them
WIDE = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BREAKS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
COUNT_SQL = r"CAST(coalesce(len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')), 0) AS BIGINT)"


@query(
    "context_windows",
    f"""WITH {TURNS}, f AS (
      SELECT sample_id, turn, role, text,
        list(CASE WHEN text <> '' THEN role || ':' || text END) OVER (PARTITION BY sample_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS before
      FROM turns)
    SELECT sample_id, turn, CAST(coalesce(len(list_filter(before, lambda x: x IS NOT NULL)), 0) + 1 AS BIGINT) AS n_messages,
      md5(concat_ws(chr(10), nullif(array_to_string(list_filter(before, lambda x: x IS NOT NULL), chr(10)), ''), role || ':' || text)) AS digest
    FROM f WHERE role = 'assistant' AND text <> ''""",
)
def context_windows(spark, d):
    """W1, P2, P3, P4 over the messages of every sample."""
    found = samples.array_windows(table(spark, d, "processed_dataset"), "sample_id", D.decoded(F.col("messages")))
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return found.select("sample_id", "turn", F.size("messages").cast("long").alias("n_messages"), F.md5(text).alias("digest"))


@query(
    "sample_counts",
    r"""SELECT lang, CAST(count(*) FILTER (sub = 'control' AND sp = 'train') AS BIGINT) AS control_train, CAST(count(*) FILTER (sub = 'control' AND sp = 'dev') AS BIGINT) AS control_dev,
      CAST(count(*) FILTER (sub = 'mdd' AND sp = 'train') AS BIGINT) AS mdd_train, CAST(count(*) FILTER (sub = 'mdd' AND sp = 'dev') AS BIGINT) AS mdd_dev, CAST(count(*) FILTER (sp = 'test') AS BIGINT) AS skipped_test
    FROM (SELECT lang, CASE WHEN contains(p, '/train/') THEN 'train' WHEN contains(p, '/dev/') THEN 'dev' WHEN contains(p, '/test/') THEN 'test' ELSE 'train' END AS sp,
        CASE WHEN contains(p, '/mdd/') THEN 'mdd' ELSE 'control' END AS sub FROM (SELECT lang, replace(path, '\', '/') AS p FROM processed_dataset)) GROUP BY lang""",
)
def sample_counts(spark, d):
    """A1 with routing from the path."""
    return samples.sample_counts(samples.routed(table(spark, d, "processed_dataset").select("lang", "path")))


@query("languages_with_training", "SELECT lang, split, CAST(count(*) AS BIGINT) AS n FROM processed_dataset WHERE lang IN (SELECT lang FROM processed_dataset WHERE split = 'train') GROUP BY lang, split")
def languages_with_training(spark, d):
    """J5, A18."""
    return samples.languages_with_training(table(spark, d, "processed_dataset").select("lang", "split")).groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))


@query("spelled_languages", "SELECT a.lang AS lang, CAST(count(*) AS BIGINT) AS n FROM processed_dataset p LEFT JOIN lang_alias a ON lower(trim(p.lang)) = a.alias GROUP BY a.lang")
def spelled_languages(spark, d):
    """Labels through a fixed-size dimension; labels without spelling form the null group."""
    alias = table(spark, d, "lang_alias").select(F.col("alias"), F.col("lang").alias("to"))
    return table(spark, d, "processed_dataset").join(alias, F.lower(F.trim("lang")) == F.col("alias"), "left").groupBy(F.col("to").alias("lang")).agg(F.count(F.lit(1)).alias("n"))


_SPEAKERS = "CASE a.lang " + " ".join(f"WHEN '{k}' THEN '{{0}}'".replace("{0}", "{" + k + "}") for k in D.LABELS if k != "en") + " ELSE '{en}' END"
_THERAPIST, _CLIENT = (_SPEAKERS.format(**{k: v[i] for k, v in D.LABELS.items()}) for i in (0, 1))


@query(
    "transcript_turns",
    rf"""WITH x AS (SELECT doc_id, {STRIP_SQL.format("text")} AS text, {_THERAPIST} AS th, {_CLIENT} AS cl FROM documents d LEFT JOIN lang_alias a ON lower(trim(d.lang)) = a.alias WHERE text IS NOT NULL),
    c AS (SELECT doc_id, th, cl, list_filter(list_transform(string_split(regexp_replace(text, '(' || th || '|' || cl || ')', chr(1) || '\1', 'g'), chr(1)), lambda x: {STRIP_SQL.format('x')}), lambda x: x <> '') AS ps FROM x)
    SELECT doc_id, CAST(i AS INT) AS turn, CASE WHEN starts_with(p, th) THEN 'assistant' WHEN starts_with(p, cl) THEN 'user' END AS role,
      md5(CASE WHEN starts_with(p, th) THEN {STRIP_SQL.format("regexp_replace(" + STRIP_SQL.format("replace(p, th, '')") + r", '\[/?END\]', '', 'g')")}
        WHEN starts_with(p, cl) THEN {STRIP_SQL.format("replace(p, cl, '')")} ELSE '' END) AS digest
    FROM (SELECT doc_id, th, cl, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM c)""",
)
def transcript_turns(spark, d):
    """F4, F5, F6, W2, P1, J6 over all documents, with the labels of the language each states."""
    alias = table(spark, d, "lang_alias").select("alias", F.col("lang").alias("code"))
    docs = table(spark, d, "documents").select("doc_id", "text", "lang").where("text is not null").join(fixed(alias), F.lower(F.trim("lang")) == F.col("alias"), "left")
    found = samples.transcript_turns(docs, samples.labels_of(F.col("code")), key="doc_id")
    return found.select("doc_id", "turn", "role", F.md5("text").alias("digest"))


@query("allowed_languages", "SELECT sample_id, lang FROM processed_dataset WHERE lang IN ('ar', 'de', 'fr')")
def allowed_languages(spark, d):
    """P9."""
    return samples.allowed_languages(table(spark, d, "processed_dataset").select("sample_id", "lang"), ("ar", "de", "fr"))


_ENDS = "text"
for _a, _b in D.END_SPELLINGS:
    _ENDS = f"replace({_ENDS}, '{_a}', '{_b}')"


@query("end_markers", f"WITH {TURNS}, c AS (SELECT sample_id, turn, {_ENDS} AS t FROM turns) SELECT sample_id, turn, contains(t, '[/END]') AS ended, md5({STRIP_SQL.format(r'''regexp_replace(t, '\[/?END\]', '', 'g')''')}) AS digest FROM c")
def end_markers(spark, d):
    """F6, F7."""
    t = D.canonical_end(F.col("text"))
    return turns(spark, d).select("sample_id", "turn", F.contains(t, F.lit("[/END]")).alias("ended"), F.md5(D.without_end(t)).alias("digest"))


def _first_place(tags: tuple[str, ...], text: str) -> str:
    """Place of the first tag in list order."""
    return "coalesce(" + ", ".join(f"nullif(strpos(lower({text}), '{t.lower()}:'), 0)" for t in tags) + ")"


def _cleaning(own: tuple[str, ...], other: tuple[str, ...], whole: bool) -> str:
    """The cleaning steps as chained tables ``c0`` to ``c4`` over ``turns`` with ``subset``."""
    plain = "replace(replace(t, '<|END_RESPONSE|>', ''), '<tool_call>', '')"
    for tag in reversed(own):
        plain = plain.replace("(t,", f"(replace(t, '**{tag}:**', '{tag}:'),", 1)
    ends = "t"
    for a, b in D.END_SPELLINGS:
        ends = f"replace({ends}, '{a}', '{b}')"
    grab = f"regexp_extract(t, '(?{'is' if whole else 'i'})((?:{'|'.join(own)})\\s*:\\s*.+)', 1)".replace("\\\\", "\\")
    return f"""c0 AS (SELECT sample_id, turn, subset, text AS t FROM s), c1 AS (SELECT * REPLACE ({plain} AS t) FROM c0),
    c2 AS (SELECT * REPLACE (CASE WHEN {grab} <> '' THEN {STRIP_SQL.format(grab)} ELSE t END AS t) FROM c1),
    c3 AS (SELECT * REPLACE (CASE WHEN {_first_place(other, 't')} IS NOT NULL THEN substr(t, 1, {_first_place(other, 't')} - 1) ELSE t END AS t) FROM c2),
    c4 AS (SELECT * REPLACE ({ends} AS t) FROM c3)
    SELECT sample_id, turn, md5({STRIP_SQL.format("CASE WHEN turn < CASE WHEN contains(subset, 'mdd') THEN 12 ELSE 7 END THEN replace(replace(t, '[/END]', ''), '[END]', '') ELSE t END")}) AS digest FROM c4"""


def _cleaned(name: str, role: str, spoken_by: str) -> None:
    own, other = (D.CLIENT_TAGS, D.THERAPIST_TAGS) if role == "client" else (D.THERAPIST_TAGS, D.CLIENT_TAGS)
    sql = f"WITH {TURNS}, s AS (SELECT t.sample_id, t.turn, p.subset, t.text FROM turns t JOIN processed_dataset p USING (sample_id) WHERE t.role = '{spoken_by}'), {_cleaning(own, other, role == 'client')}"

    @query(name, sql)
    def run(spark, d):
        said = D.cleaned(F.col("text"), role, F.col("turn"), F.col("subset"))
        return turns(spark, d, "subset").where(F.col("role") == spoken_by).select("sample_id", "turn", F.md5(said).alias("digest"))

    run.__doc__ = f"F7-F9, F11, F12, F16, O7 on {role} turns in one expression."


_cleaned("cleaned_client_turns", "client", "user")
_cleaned("cleaned_therapist_turns", "therapist", "assistant")


@query(
    "thought_and_quoted_turns",
    rf"""WITH x AS (SELECT doc_id, CASE WHEN contains(text, '</think>') THEN {STRIP_SQL.format(r"regexp_extract(text, '(?s)</think>\s*(.*)', 1)")} ELSE text END AS t FROM documents WHERE text IS NOT NULL),
    q AS (SELECT doc_id, t, regexp_extract(t, '(?s)(Client:.*?)"', 1) AS found, strpos(t, '."') AS stop FROM x)
    SELECT doc_id, md5(regexp_replace({STRIP_SQL.format("CASE WHEN found <> '' THEN found WHEN stop > 0 THEN substr(t, 1, stop) ELSE t END")}, '\s*\(\d+\s+words\)$', '')) AS digest FROM q""",
)
def thought_and_quoted_turns(spark, d):
    """F10, F13."""
    said = D.without_word_count(D.quoted_turn(D.after_thinking(F.col("text")), "Client:"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(said).alias("digest"))


@query(
    "wind_down_messages",
    f"""WITH {TURNS} SELECT sample_id, turn, md5(CASE WHEN turn < 15 THEN replace(text, ' [/END]', '') ELSE text END) AS digest,
      CASE WHEN turn + 20 < 22 THEN '' WHEN turn + 20 = 29 THEN 'You should end the conversation in 1 turn.' WHEN turn + 20 = 30 THEN 'You should end the conversation in this turn with ''[/END]'' token.'
        ELSE 'You should end the conversation in ' || (10 - turn) || ' turns.' END AS ending FROM turns""",
)
def wind_down_messages(spark, d):
    """What late turns are told, and ends of early ones."""
    return turns(spark, d).select("sample_id", "turn", F.md5(D.late_end(F.col("text"), F.col("turn"))).alias("digest"), D.wind_down(F.col("turn") + 20).alias("ending"))


@query("ended_sessions", f"WITH {TURNS}, e AS (SELECT *, least(coalesce(min(CASE WHEN contains(text, '[/END]') THEN turn END) OVER (PARTITION BY sample_id), 33), 33) AS last FROM turns) SELECT sample_id, turn FROM e WHERE turn <= last")
def ended_sessions(spark, d):
    """Sessions up to their first end marker."""
    return sessions.first_end(turns(spark, d), conv="sample_id").select("sample_id", "turn")


@query(
    "cut_at_other_speaker",
    """WITH """
    + TURNS
    + """, p AS (SELECT sample_id, turn, text, coalesce(nullif(strpos(lower(text), 'klient:'), 0), nullif(strpos(lower(text), 'client:'), 0), nullif(strpos(lower(text), 'العميل:'), 0), nullif(strpos(lower(text), 'العميلة:'), 0)) AS place FROM turns)
    SELECT sample_id, turn, CAST(place AS INT) AS place, md5(CASE WHEN place IS NOT NULL THEN substr(text, 1, place - 1) ELSE text END) AS digest FROM p""",
)
def cut_at_other_speaker(spark, d):
    """The first tag of the list that occurs, not the first in the text."""
    return turns(spark, d).select("sample_id", "turn", D.first_tag(F.col("text"), D.CLIENT_TAGS).alias("place"), F.md5(D.cut_at_tags(F.col("text"), D.CLIENT_TAGS)).alias("digest"))


@query(
    "early_ends",
    f"WITH {TURNS} SELECT t.sample_id, t.turn, md5({STRIP_SQL.format('''CASE WHEN t.turn < CASE WHEN contains(p.subset, 'mdd') THEN 12 ELSE 7 END THEN replace(replace(t.text, '[/END]', ''), '[END]', '') ELSE t.text END''')}) AS digest FROM turns t JOIN processed_dataset p USING (sample_id)",
)
def early_ends(spark, d):
    """F16, W6."""
    return turns(spark, d, "subset").select("sample_id", "turn", F.md5(D.early_end(F.col("text"), F.col("turn"), F.col("subset"))).alias("digest"))


@query("repeated_turns", f"WITH {TURNS} SELECT sample_id, turn, row_number() OVER (PARTITION BY sample_id, role, text ORDER BY turn) > 1 AS seen_before FROM turns")
def repeated_turns(spark, d):
    """W3, J12."""
    return sessions.repeats(turns(spark, d), conv="sample_id").select("sample_id", "turn", "seen_before")


@query(
    "first_word_loops",
    f"""WITH {TURNS}, k AS (SELECT sample_id, turn, coalesce(role, '') AS role, left(lower(text), 1) AS w FROM turns),
    l AS (SELECT *, lag(role, 1) OVER o AS r1, lag(role, 2) OVER o AS r2, lag(role, 3) OVER o AS r3, lag(w, 1) OVER o AS w1, lag(w, 2) OVER o AS w2, lag(w, 3) OVER o AS w3 FROM k WINDOW o AS (PARTITION BY sample_id ORDER BY turn))
    SELECT sample_id, turn, coalesce(role = r2 AND w = w2 AND r1 = r3 AND w1 = w3, false) AS loop FROM l""",
)
def first_word_loops(spark, d):
    """W4 on the first letter, where loops occur; beside ``turn_loops``."""
    keyed = turns(spark, d).select("sample_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.substring(F.lower("text"), 1, 1).alias("text"))
    return sessions.loops(keyed, conv="sample_id").select("sample_id", "turn", "loop")


@query(
    "turn_loops",
    f"""WITH {TURNS}, l AS (SELECT sample_id, turn, struct_pack(r := role, t := text) AS x, lag(x, 1) OVER o AS a, lag(x, 2) OVER o AS b, lag(x, 3) OVER o AS c FROM turns WINDOW o AS (PARTITION BY sample_id ORDER BY turn))
    SELECT sample_id, turn, coalesce(c IS NOT NULL AND x = b AND a = c, false) AS loop FROM l""",
)
def turn_loops(spark, d):
    """W4 on role and whole text."""
    return sessions.loops(turns(spark, d).withColumn("role", F.coalesce("role", F.lit(""))), conv="sample_id").select("sample_id", "turn", "loop")


@query("session_lengths", f"WITH {TURNS}, s AS (SELECT sample_id, count(*) AS n FROM turns GROUP BY sample_id) SELECT CAST(count(n) AS BIGINT) AS n, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, CAST(min(n) AS BIGINT) AS min, CAST(max(n) AS BIGINT) AS max FROM s")
def session_lengths(spark, d):
    """A19, A5."""
    out = statistics.summary(sessions.session_lengths(turns(spark, d), conv="sample_id"), "n_turns")
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


@query(
    "dialogue_totals",
    f"""WITH {TURNS}, u AS (SELECT p.source, t.sample_id, {COUNT_SQL.format('t.text')} AS c FROM turns t JOIN processed_dataset p USING (sample_id) WHERE t.text <> ''),
    per AS (SELECT source, sample_id, count(*) AS u, sum(c) AS t FROM u GROUP BY ALL)
    SELECT source, CAST(count(*) AS BIGINT) AS dialogues, CAST(sum(u) AS BIGINT) AS utterances, CAST(sum(t) AS BIGINT) AS tokens, round(sum(u) / count(*), 6) AS avg_utterances FROM per GROUP BY source""",
)
def dialogue_totals(spark, d):
    """A2, A3, P11."""
    said = turns(spark, d, "source").where("text <> ''")
    out = statistics.dialogue_totals(said, "source", "sample_id", "text")
    return out.withColumn("avg_utterances", F.round("avg_utterances", 6))


@query(
    "tagged_lines",
    f"""WITH l AS (SELECT doc_id, {STRIP_SQL.format('x')} AS line FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS x FROM documents WHERE text IS NOT NULL)),
    k AS (SELECT doc_id, line, starts_with(line, 'Therapist:') OR starts_with(line, 'Client:') AS t FROM l WHERE line <> ''),
    w AS (SELECT *, bool_or(t) OVER (PARTITION BY doc_id) AS a FROM k)
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum({COUNT_SQL.format('line')}) AS BIGINT) AS tokens FROM w WHERE t OR NOT a GROUP BY doc_id""",
)
def tagged_lines(spark, d):
    """P10, S5."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", r"\r?\n")).alias("line"))
    kept = statistics.tagged_lines(lines, key="doc_id")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(X.whitespace_count(F.col("line")).cast("long")).alias("tokens"))


@query(
    "vocabulary_by_language",
    f"""WITH t AS (SELECT lang, unnest({TOKENS_SQL.format('text')}) AS token FROM documents WHERE text IS NOT NULL)
    SELECT lang, CAST(count(*) AS BIGINT) AS tokens, CAST(count(DISTINCT token) AS BIGINT) AS types, round(count(DISTINCT token) / count(*), 9) AS ttr FROM t GROUP BY lang""",
)
def vocabulary_by_language(spark, d):
    """F1, A4, U4."""
    return statistics.vocabulary(table(spark, d, "documents").select("lang", "text"), ["lang"], "text").withColumn("ttr", F.round("ttr", 9))


@query(
    "two_corpora_vocabulary",
    f"""WITH t AS (SELECT unnest({TOKENS_SQL.format('src')}) AS token FROM pairs UNION ALL SELECT unnest({TOKENS_SQL.format('mt')}) FROM pairs)
    SELECT CAST(count(*) AS BIGINT) AS tokens, CAST(count(DISTINCT token) AS BIGINT) AS types, round(count(DISTINCT token) / count(*), 9) AS ttr FROM t""",
)
def two_corpora_vocabulary(spark, d):
    """U1, A4 over the union of two corpora."""
    pairs = table(spark, d, "pairs")
    both = pairs.select(F.col("src").alias("text")).unionByName(pairs.select(F.col("mt").alias("text")))
    return statistics.vocabulary(both, [], "text").withColumn("ttr", F.round("ttr", 9))


_MTLD = """WITH w AS (SELECT doc_id, kind, {words} AS w FROM documents WHERE text IS NOT NULL),
    d AS (SELECT doc_id, kind, dir, len(w) AS n, list_transform(CASE WHEN dir = 1 THEN w ELSE list_reverse(w) END, lambda x: {{'w': x, 'seen': CAST([] AS VARCHAR[]), 'k': 0, 'f': 0e0}}) AS s FROM w, (SELECT unnest([1, 2]) AS dir) WHERE len(w) >= 10),
    r AS (SELECT doc_id, kind, n, list_reduce(s, lambda a, x: CASE
        WHEN list_contains(a.seen, x.w) THEN CASE WHEN len(a.seen) / (a.k + 1) < 0.72 THEN {{'w': x.w, 'seen': CAST([] AS VARCHAR[]), 'k': 0, 'f': a.f + 1}} ELSE {{'w': x.w, 'seen': a.seen, 'k': a.k + 1, 'f': a.f}} END
        WHEN (len(a.seen) + 1) / (a.k + 1) < 0.72 THEN {{'w': x.w, 'seen': CAST([] AS VARCHAR[]), 'k': 0, 'f': a.f + 1}}
        ELSE {{'w': x.w, 'seen': list_append(a.seen, x.w), 'k': a.k + 1, 'f': a.f}} END, {{'w': '', 'seen': CAST([] AS VARCHAR[]), 'k': 0, 'f': 0e0}}) AS e FROM d),
    v AS (SELECT doc_id, kind, n / nullif(e.f + CASE WHEN e.k > 0 THEN (1 - len(e.seen) / e.k) / 0.28e0 ELSE 0 END, 0) AS m FROM r),
    q AS (SELECT doc_id, kind, CASE WHEN count(m) = 2 THEN avg(m) END AS mtld FROM v GROUP BY ALL)""".format(words=WORDS_SQL.format("text"))


@query("mtld_by_kind", _MTLD + " SELECT d.kind, CAST(count(mtld) AS BIGINT) AS n, round(avg(mtld), 5) AS mean, round(stddev_samp(mtld), 5) AS std, round(min(mtld), 5) AS min, round(max(mtld), 5) AS max FROM documents d LEFT JOIN q USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.kind")
def mtld_by_kind(spark, d):
    """A6, A7, A5, X6."""
    scored = table(spark, d, "documents").where("text is not null").select("kind", statistics.mtld(X.words(F.col("text"))).alias("mtld"))
    return statistics.summary(scored, "mtld", ["kind"]).select("kind", "n", *[F.round(c, 5).alias(c) for c in ("mean", "std", "min", "max")])


@query("mtld_per_document", _MTLD + " SELECT d.doc_id, round(mtld, 5) AS mtld FROM documents d LEFT JOIN q USING (doc_id)")
def mtld_per_document(spark, d):
    """A7, K4."""
    return table(spark, d, "documents").select("doc_id", F.round(statistics.mtld(X.words(F.col("text"))), 5).alias("mtld"))


_BLEU = """WITH d AS (SELECT {key} AS id, {words} AS w FROM {table}),
    b AS (SELECT id, w, len(w) AS n FROM d WHERE len(w) > 0),
    g AS (SELECT id, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS gram FROM (SELECT id, w, k, unnest(range(1, n - k + 2)) AS i FROM b, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE n >= k)),
    c AS (SELECT id, k, gram, count(*) AS c FROM g GROUP BY ALL),
    r AS (SELECT *, row_number() OVER o AS rn, first_value(c) OVER o AS top, lead(c) OVER o AS nxt FROM c WINDOW o AS (PARTITION BY k, gram ORDER BY c DESC, id)),
    m AS (SELECT id, k, sum(least(c, CASE WHEN rn = 1 THEN coalesce(nxt, 0) ELSE top END)) AS clip FROM r GROUP BY ALL),
    l AS (SELECT n, count(*) AS same FROM b GROUP BY n),
    z AS (SELECT n, same, lag(n) OVER (ORDER BY n) AS lo, lead(n) OVER (ORDER BY n) AS hi FROM l),
    f AS (SELECT n, CASE WHEN same > 1 THEN n WHEN lo IS NULL THEN hi WHEN hi IS NULL THEN lo WHEN n - lo <= hi - n THEN lo ELSE hi END AS ref FROM z),
    p AS (SELECT b.id, b.n, x.k, coalesce(m.clip, 0) AS clip FROM b CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) x LEFT JOIN m ON m.id = b.id AND m.k = x.k),
    s AS (SELECT id, n, max(CASE WHEN k = 1 THEN clip END) AS uni, sum(ln(CASE WHEN clip > 0 THEN clip ELSE 0.1e0 END / greatest(1, n - k + 1)) / 4) AS e FROM p GROUP BY ALL)
    SELECT s.id AS {key}, round(CASE WHEN ref IS NULL THEN NULL WHEN uni = 0 THEN 0e0 ELSE CASE WHEN s.n > ref THEN 1e0 ELSE exp(1 - ref / s.n) END * exp(e) END, 6) AS self_bleu FROM s JOIN f ON f.n = s.n"""
_BLEU_SQL = _BLEU.format(key="idx", table="items", words=WORDS_SQL.format("coalesce(situation, '') || ' ' || coalesce(thoughts, '')"))


@query("self_bleu_per_item", _BLEU_SQL)
def self_bleu_per_item(spark, d):
    """A8, A9, J10, W7, W8."""
    text = F.concat_ws(" ", F.coalesce("situation", F.lit("")), F.coalesce("thoughts", F.lit("")))
    docs = table(spark, d, "items").select("idx", X.words(text).alias("words"))
    return statistics.self_bleu(docs, "idx").select("idx", F.round("self_bleu", 6).alias("self_bleu"))


@query("self_bleu_per_document", _BLEU.format(key="doc_id", table="documents WHERE text IS NOT NULL", words=WORDS_SQL.format("text")))
def self_bleu_per_document(spark, d):
    """A8, A9 on every whole document."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", X.words(F.col("text")).alias("words"))
    return statistics.self_bleu(docs, "doc_id").select("doc_id", F.round("self_bleu", 6).alias("self_bleu"))


@query("self_bleu_summary", f"WITH q AS ({_BLEU_SQL}) SELECT CAST(count(self_bleu) AS BIGINT) AS n, round(avg(self_bleu), 5) AS mean, round(stddev_samp(self_bleu), 5) AS std FROM q")
def self_bleu_summary(spark, d):
    """A5, P16."""
    return statistics.summary(self_bleu_per_item(spark, d), "self_bleu").select("n", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query("short_ids", r"SELECT pair_id, CASE WHEN regexp_extract(basename, '(?i)(notactive|active|control)\d+') <> '' THEN lower(regexp_extract(basename, '(?i)(notactive|active|control)\d+')) ELSE regexp_replace(basename, '(.)\.[^.]*$', '\1') END AS short_id FROM pairs")
def short_ids(spark, d):
    """F2."""
    return table(spark, d, "pairs").select("pair_id", X.short_id(F.col("basename")).alias("short_id"))


@query(
    "path_parts",
    r"""SELECT sample_id, string_split(string_split(p, '/')[-1], '.')[1] AS name, CASE WHEN len(string_split(p, '/')) >= 3 THEN string_split(p, '/')[-3] END AS style, lower(regexp_extract(p, '(\.[^./\\]+)$', 1)) AS suffix
    FROM (SELECT sample_id, replace(path, '\', '/') AS p FROM processed_dataset)""",
)
def path_parts(spark, d):
    """F29, D4, P8, P19."""
    p = F.col("path")
    return table(spark, d, "processed_dataset").select("sample_id", X.path_name(p).alias("name"), X.path_style(p).alias("style"), X.path_suffix(p).alias("suffix"))


@query("capped_per_source", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 5")
def capped_per_source(spark, d):
    """The first five documents of each source."""
    return samples.capped(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 5)


@query("aligned_pairs", "SELECT a.pair_id AS src_id, b.pair_id AS mt_id FROM pairs a JOIN pairs b ON a.basename = b.basename WHERE a.src <> '' AND b.mt <> ''")
def aligned_pairs(spark, d):
    """Sources and translations by file name; repeated deliveries pair each."""
    pairs = table(spark, d, "pairs")
    left, right = (pairs.select("basename", F.col("pair_id").alias(f"{side}_id"), F.col(side).alias("text")) for side in ("src", "mt"))
    return translation.paired(left, right).select("src_id", "mt_id")


@query("untranslated", "SELECT pair_id, basename FROM pairs p WHERE src <> '' AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.basename = p.basename AND q.mt <> '')")
def untranslated(spark, d):
    """J2."""
    pairs = table(spark, d, "pairs")
    return translation.untranslated(pairs.where("src <> ''").select("pair_id", "basename"), pairs.where("mt <> ''").select("basename")).select("pair_id", "basename")


_ZIP = r"""s AS (SELECT pair_id, coalesce(regexp_split_to_array(src, '\r?\n'), []) AS a, coalesce(regexp_split_to_array(mt, '\r?\n'), []) AS b FROM pairs),
    z AS (SELECT pair_id, CAST(i AS INT) AS line_no, coalesce(a[i + 1], '') AS src, coalesce(b[i + 1], '') AS mt FROM (SELECT *, unnest(range(greatest(len(a), len(b)))) AS i FROM s))"""


@query("zipped_lines", f"WITH {_ZIP} SELECT pair_id, line_no, md5(src || chr(9) || mt) AS digest FROM z")
def zipped_lines(spark, d):
    """J3, J11."""
    z = translation.zipped_lines(table(spark, d, "pairs"), "pair_id")
    return z.select("pair_id", "line_no", F.md5(F.concat("src", F.lit("\t"), "mt")).alias("digest"))


_TEXT = "coalesce(text, '')"


def _size(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{WIDE}]+'))"


_CHUNKS = rf"""WITH s AS (SELECT pair_id, regexp_split_to_array(coalesce(src, ''), '{BREAKS}') AS a, regexp_split_to_array(coalesce(mt, ''), '{BREAKS}') AS b FROM pairs),
    z AS (SELECT pair_id, i, regexp_replace(coalesce(a[i + 1], ''), '[{WIDE}]+$', '') AS x, regexp_replace(coalesce(b[i + 1], ''), '[{WIDE}]+$', '') AS y FROM (SELECT *, unnest(range(greatest(len(a), len(b)))) AS i FROM s)),
    n AS (SELECT pair_id, i, x, y, {_size("x")} + {_size("y")} AS n FROM z),
    l AS (SELECT pair_id, list({{'n': n, 'sum': 0::BIGINT, 'c': 0, 'out': CAST([] AS INT[])}} ORDER BY i) AS ls FROM n GROUP BY pair_id),
    r AS (SELECT pair_id, list_reduce(ls, lambda a, x: CASE
        WHEN a.sum + x.n <= 462 THEN {{'n': x.n, 'sum': a.sum + x.n, 'c': a.c, 'out': list_append(a.out, a.c)}}
        WHEN a.sum > 0 THEN {{'n': x.n, 'sum': 0::BIGINT, 'c': a.c + 2, 'out': list_append(a.out, a.c + 1)}}
        ELSE {{'n': x.n, 'sum': 0::BIGINT, 'c': a.c + 1, 'out': list_append(a.out, a.c)}} END, {{'n': 0::BIGINT, 'sum': 0::BIGINT, 'c': 0, 'out': CAST([] AS INT[])}}).out AS o FROM l),
    g AS (SELECT pair_id, o[i + 1] AS chunk_no, CAST(sum(n) AS BIGINT) AS n_words, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER ({_size("x")} > 0), '') AS src, coalesce(string_agg(y, chr(10) ORDER BY i) FILTER ({_size("y")} > 0), '') AS mt
      FROM n JOIN r USING (pair_id) GROUP BY ALL HAVING sum(n) > 0),
    c AS (SELECT pair_id, CAST(chunk_no AS INT) AS chunk_no, n_words, regexp_replace(src, '^[{WIDE}]+', '') AS src, regexp_replace(mt, '^[{WIDE}]+', '') AS mt FROM g)"""


@query("greedy_chunks", _CHUNKS + " SELECT pair_id, chunk_no, n_words, md5(src || chr(9) || mt) AS digest FROM c")
def greedy_chunks(spark, d):
    """W5 with 512 positions."""
    return translation.chunks(table(spark, d, "pairs"), "pair_id").select("pair_id", "chunk_no", _pair_words(F.col("src"), F.col("mt")).alias("n_words"), F.md5(F.concat("src", F.lit("\t"), "mt")).alias("digest"))


def _pair_words(src, mt):
    """Words between white space as Python has it."""
    wide = "[\\t-\\r\\x1c-\\x1f \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
    return sum((F.size(F.filter(F.split(c, wide), lambda x: x != "")) for c in (src, mt)), F.lit(0)).cast("long")


@query(
    "chunk_macro_mean",
    _CHUNKS + """, m AS (SELECT pair_id, avg(CASE WHEN src = '' OR mt = '' THEN 0e0 ELSE least(length(src), length(mt)) / greatest(length(src), length(mt)) END) AS m FROM c GROUP BY pair_id)
    SELECT CAST(count(m) AS BIGINT) AS documents, round(avg(m), 5) AS score FROM m""",
)
def chunk_macro_mean(spark, d):
    """A10, X3 with the stand-in scorer."""
    scorer = generation.pair_scorer(generation.stub_scores)
    scored = translation.chunks(table(spark, d, "pairs"), "pair_id").withColumn("score", scorer("src", "mt"))
    return translation.macro_mean(scored, "pair_id").select("documents", F.round("score", 5).alias("score"))


_AVG = "(" + " + ".join(f"coalesce({c}, 0)" for c in CRITERIA) + ") / 6"


@query("judge_row_average", f"SELECT dialogue_id, language, round({_AVG}, 2) AS average FROM judge WHERE error IS NULL")
def judge_row_average(spark, d):
    """A11, P15."""
    return judging.with_average(table(spark, d, "judge").where("error is null")).select("dialogue_id", "language", "average")


_MEANS = ", ".join(f"coalesce(avg({c}), 0e0) AS {c}" for c in CRITERIA)


@query(
    "judge_group_means",
    f"""WITH g AS (SELECT CASE grouping_id(language, dialogue_id) WHEN 3 THEN 'overall' WHEN 1 THEN 'language' ELSE 'dialogue' END AS level, language, dialogue_id, count(*) AS n, {_MEANS}
      FROM judge WHERE error IS NULL GROUP BY GROUPING SETS ((language), (dialogue_id), ()))
    SELECT level, language, dialogue_id, CAST(n AS BIGINT) AS n, {", ".join(f"round({c}, 6) AS {c}" for c in CRITERIA)}, round(({" + ".join(CRITERIA)}) / 6, 6) AS overall FROM g WHERE n > 0""",
)
def judge_group_means(spark, d):
    """One pass for languages, dialogues and the whole."""
    out = judging.group_means(table(spark, d, "judge"))
    return out.select("level", "language", "dialogue_id", "n", *[F.round(c, 6).alias(c) for c in (*CRITERIA, "overall")])


_FENCED = r"regexp_replace(regexp_replace(" + STRIP_SQL.format("text") + r", '```json\s*', '', 'g'), '```\s*', '', 'g')"


def _score(name: str) -> str:
    value = "coalesce(" + ", ".join(f"m['{k}']" for k in (name, *[k for k, v in KEY_ALIASES.items() if v == name])) + ")"
    return f"CASE WHEN TRY_CAST({value} AS DOUBLE) IS NOT NULL THEN greatest(1, least(5, CAST(trunc(TRY_CAST({value} AS DOUBLE)) AS INT))) END AS {name}"


@query(
    "judge_parsed_replies",
    f"""WITH r AS (SELECT doc_id, {_FENCED} AS t FROM documents WHERE kind = 'judge_reply' AND text IS NOT NULL), v AS (SELECT doc_id, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM r),
    k AS (SELECT doc_id, j, map_from_entries(list_transform(json_keys(j), lambda x: struct_pack(k := lower(trim(x)), v := json_extract_string(j, '$."' || x || '"')))) AS m FROM v)
    SELECT doc_id, j IS NULL AS unreadable, {", ".join(map(_score, CRITERIA))}, md5(coalesce(m['brief_justification'], '')) AS justification FROM k""",
)
def judge_parsed_replies(spark, d):
    """All six criteria with their further spellings, and the justification."""
    out = judging.parsed(table(spark, d, "documents").where("kind = 'judge_reply' and text is not null").select("doc_id", "text"), "text")
    return out.select("doc_id", (F.col("error").isNotNull()).alias("unreadable"), *CRITERIA, F.md5("brief_justification").alias("justification"))


@query("judge_manifest", "SELECT x.d AS dialogue_id, l.lang AS language, CAST(count(j.dialogue_id) AS BIGINT) AS n FROM (SELECT DISTINCT dialogue_id AS d FROM judge) x CROSS JOIN (SELECT DISTINCT lang FROM lang_alias) l LEFT JOIN judge j ON j.dialogue_id = x.d AND j.language = l.lang GROUP BY ALL")
def judge_manifest(spark, d):
    """J7, S14."""
    judge, langs = table(spark, d, "judge"), table(spark, d, "lang_alias").select(F.col("lang").alias("language")).distinct()
    every = judging.manifest(judge.select("dialogue_id").distinct(), langs)
    have = judge.groupBy("dialogue_id", "language").agg(F.count(F.lit(1)).alias("n"))
    return every.join(have, ["dialogue_id", "language"], "left").select("dialogue_id", "language", F.coalesce("n", F.lit(0)).alias("n"))


_NORM = "regexp_replace(translate(lower(" + STRIP_SQL.format("{0}") + "), '’`“”—–', '''''\"\"--'), '\\s+', ' ', 'g')"
_GOLD = f"""names AS (SELECT DISTINCT task_id, label_en, {_NORM.format('label')} AS alias FROM label_dim UNION SELECT DISTINCT task_id, label_en, {_NORM.format('label_en')} FROM label_dim),
    gold AS (SELECT DISTINCT i.idx, i.task_id, n.label_en FROM (SELECT idx, task_id, unnest(gold) AS g FROM items) i JOIN names n ON n.task_id = i.task_id AND n.alias = {_NORM.format('i.g')})"""


@query("gold_labels", f"WITH {_GOLD} SELECT idx, task_id, label_en FROM gold")
def gold_labels(spark, d):
    """F17, J4, A16, O6."""
    return benchmark.gold_labels(table(spark, d, "items"), table(spark, d, "label_dim"))


_SCORES = f"""{_GOLD}, lab AS (SELECT DISTINCT task_id, label_en, letter FROM label_dim),
    t AS (SELECT i.task_id, p.source, l.label_en, CASE WHEN g.idx IS NULL THEN 0 ELSE 1 END AS y, CASE WHEN coalesce(list_contains(p.pred_letters, l.letter), false) THEN 1 ELSE 0 END AS q
      FROM predictions p JOIN items i USING (idx) JOIN lab l USING (task_id) LEFT JOIN gold g ON g.idx = p.idx AND g.label_en = l.label_en),
    c AS (SELECT task_id, source, label_en, sum(y * q) AS tp, sum((1 - y) * q) AS fp, sum(y * (1 - q)) AS fn FROM t GROUP BY ALL),
    f AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp / nullif(tp + fn, 0), 0) AS rc FROM c)"""


@query(
    "multilabel_scores",
    f"WITH {_SCORES} SELECT task_id, source, round(avg(f1), 6) AS macro_f1, round(coalesce(sum(f1 * (tp + fn)) / nullif(sum(tp + fn), 0), 0), 6) AS weighted_f1, round(avg(rc), 6) AS macro_recall FROM f GROUP BY task_id, source",
)
def multilabel_scores(spark, d):
    """J8, A13, D16."""
    rows = benchmark.truth_table(table(spark, d, "predictions"), table(spark, d, "items"), table(spark, d, "label_dim"), run=["source"])
    out = benchmark.scores(rows, ["task_id", "source"])
    return out.select("task_id", "source", *[F.round(c, 6).alias(c) for c in ("macro_f1", "weighted_f1", "macro_recall")])


@query(
    "format_and_cost",
    "SELECT source, CAST(count(*) FILTER (follow_format) AS BIGINT) AS n_format, round(coalesce(avg(CAST(follow_format AS INT)), 0), 6) AS format_ratio, "
    + ", ".join(f"round(coalesce(avg({c}), 0), 6) AS mean_{c}" for c in ("prompt_tokens", "generated_tokens", "elapsed_sec"))
    + " FROM predictions GROUP BY source",
)
def format_and_cost(spark, d):
    """A14, A15."""
    out = benchmark.format_and_cost(table(spark, d, "predictions"), ["source"])
    return out.select("source", "n_format", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("source", "n_format")])


_LETTERS = "replace(replace(replace(replace(replace(replace(lower(raw_output), chr(10), ','), ';', ','), '，', ','), 'answer:', ''), 'réponse:', ''), 'antwort:', '')"


@query(
    "reparsed_letters",
    rf"""WITH a AS (SELECT task_id, list(DISTINCT letter) AS allowed FROM label_dim GROUP BY task_id),
    r AS (SELECT p.idx, p.source, p.raw_output, list_filter(regexp_split_to_array({_LETTERS}, '[,\s]+'), lambda x: list_contains(a.allowed, x)) AS every, list_filter(every, lambda x, i: list_position(every, x) = i) AS l FROM predictions p JOIN items i USING (idx) JOIN a USING (task_id))
    SELECT idx, source, md5(coalesce(raw_output, '')) AS digest, coalesce(array_to_string(l, ','), '') AS letters, coalesce(len(l) > 0, false) AS in_format FROM r""",
)
def reparsed_letters(spark, d):
    """Letters in order of first appearance."""
    out = benchmark.reparsed(table(spark, d, "predictions"), table(spark, d, "items"), table(spark, d, "label_dim"))
    return out.select("idx", "source", F.md5(F.coalesce("raw_output", F.lit(""))).alias("digest"), F.array_join("letters", ",").alias("letters"), "in_format")


@query(
    "choice_prompts",
    """WITH c AS (SELECT task_id, lang, string_agg(letter || ': ' || label, chr(10) ORDER BY ord) AS choices FROM label_dim GROUP BY ALL)
    SELECT i.idx, md5('Situation: ' || coalesce(i.situation, '') || chr(10) || 'Thoughts: ' || coalesce(i.thoughts, '') || chr(10) || c.choices) AS digest FROM items i JOIN c ON c.task_id = i.task_id AND c.lang = i.lang""",
)
def choice_prompts(spark, d):
    """F20, F21, J11."""
    listed = table(spark, d, "label_dim").groupBy("task_id", "lang").agg(F.array_sort(F.collect_list(F.struct("ord", "letter", "label"))).alias("l"))
    choices = listed.select("task_id", "lang", L.choices(F.col("l.letter"), F.col("l.label")).alias("choices"))
    prompt = D.filled(F.lit("Situation: {situation}\nThoughts: {thoughts}\n{choices}"), situation=F.col("situation"), thoughts=F.col("thoughts"), choices=F.col("choices"))
    return table(spark, d, "items").join(choices, ["task_id", "lang"]).select("idx", F.md5(prompt).alias("digest"))


@query("instruction_texts", f"WITH {TURNS}, l AS (SELECT sample_id, turn, text, lag(text) OVER (PARTITION BY sample_id ORDER BY turn) AS before FROM turns) SELECT sample_id, turn, md5(before || ' ' || text) AS digest FROM l WHERE before IS NOT NULL")
def instruction_texts(spark, d):
    """F27, P17, X5."""
    t = turns(spark, d).withColumn("before", F.lag("text").over(Window.partitionBy("sample_id").orderBy("turn"))).where("before is not null")
    return t.select("sample_id", "turn", F.md5(X.instruction(F.col("before"), F.col("text"))).alias("digest"))


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id || '|7'), doc_id LIMIT 50")
def seeded_sample(spark, d):
    """Fifty rows drawn by a seed."""
    return samples.seeded_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50, seed=7)


@query("latest_checkpoint", "SELECT arg_max('checkpoint-' || doc_id, doc_id) AS name FROM documents")
def latest_checkpoint(spark, d):
    """O5."""
    return samples.latest_checkpoint(table(spark, d, "documents").select(F.concat(F.lit("checkpoint-"), F.col("doc_id").cast("string")).alias("name")))


@query("message_roles", f"WITH {TURNS} SELECT sample_id, CAST(count(*) AS BIGINT) AS n, string_agg(coalesce(role, ''), ',' ORDER BY turn) AS roles FROM turns GROUP BY sample_id")
def message_roles(spark, d):
    """decoded, encoded and decoded again."""
    again = spoken(spark, d).select("sample_id", D.decoded(D.encoded(F.col("m"))).alias("m"))
    return again.select("sample_id", F.size("m").cast("long").alias("n"), F.array_join(D.roles(F.col("m")), ",").alias("roles"))


@query(
    "flattened_messages",
    f"""WITH x AS (SELECT sample_id, unnest(m) AS x, unnest(range(len(m))) AS i FROM (SELECT sample_id, from_json(messages, '[{{"role":"VARCHAR","content":"VARCHAR","response":"VARCHAR"}}]') AS m FROM processed_dataset WHERE messages IS NOT NULL)),
    u AS (SELECT sample_id, i, {STRIP_ANY_SQL.format("coalesce(x.content, x.response, '')")} AS t, {STRIP_ANY_SQL.format("coalesce(x.role, '')")} AS r FROM x), v AS (SELECT sample_id, i, CASE WHEN t <> '' THEN t ELSE r END AS t FROM u)
    SELECT sample_id, CAST(count(*) AS BIGINT) AS n, md5(string_agg(t, chr(10) ORDER BY i)) AS digest FROM v WHERE t <> '' GROUP BY sample_id""",
)
def flattened_messages(spark, d):
    """F24, X7, U3 on message lists, where an object without an utterance gives its role."""
    listed = jsontree.utterance_lists(table(spark, d, "processed_dataset").select("sample_id", "messages"), "sample_id", "messages").where("size(utterances) > 0")
    return listed.select("sample_id", F.size("utterances").cast("long").alias("n"), F.md5(F.array_join("utterances", "\n")).alias("digest"))


def _choice(replies: dict, code: str, salt: int) -> str:
    options = replies[code]
    quoted = ", ".join("'" + r.replace("'", "''") + "'" for r in options)
    return f"[{quoted}][CAST(CAST('0x' || substr(md5(doc_id || '|{salt}'), 1, 8) AS UBIGINT) % {len(options)} AS INT) + 1]"


_DOC_LANG = "SELECT d.doc_id, d.text, a.lang FROM documents d LEFT JOIN lang_alias a ON lower(trim(d.lang)) = a.alias"


@query(
    "fallback_replies",
    f"""WITH x AS ({_DOC_LANG}), y AS (SELECT *, coalesce({STRIP_SQL.format("text")}, '') AS bare FROM x)
    SELECT doc_id, md5(CASE WHEN bare NOT IN ({", ".join(f"'{t}:'" for t in D.CLIENT_TAGS)}, '') AND ({" OR ".join(f"starts_with(text, '{t}:')" for t in D.CLIENT_TAGS)}) THEN text
      ELSE CASE lang {" ".join(f"WHEN '{k}' THEN {_choice(D.CLIENT_REPLIES, k, 3)}" for k in D.LABELS if k != "en")} ELSE {_choice(D.CLIENT_REPLIES, "en", 3)} END END) AS digest FROM y""",
)
def fallback_replies(spark, d):
    """F14 in the language of each text; the same choice on every run."""
    return _languages(spark, d).select("doc_id", F.md5(D.by_language(F.col("code"), lambda code: D.client_reply(F.col("text"), code, F.col("doc_id"), F.lit(3)))).alias("digest"))


@query(
    "therapist_fallbacks",
    f"""WITH x AS ({_DOC_LANG}), y AS (SELECT *, coalesce(row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1, false) OR NOT ({" OR ".join(f"starts_with(text, '{t}:')" for t in D.THERAPIST_TAGS)}) AS again FROM x WHERE text IS NOT NULL)
    SELECT doc_id, again, md5(CASE WHEN again THEN CASE lang {" ".join(f"WHEN '{k}' THEN {_choice(D.THERAPIST_REPLIES, k, 5)}" for k in D.THERAPIST_REPLIES)} ELSE text END ELSE text END) AS digest FROM y""",
)
def therapist_fallbacks(spark, d):
    """Texts that repeat an earlier one or lack a tag."""
    docs = _languages(spark, d).where("text is not null").withColumn("seen", F.row_number().over(Window.partitionBy("text").orderBy("doc_id")) > 1)
    reply = D.by_language(F.col("code"), lambda code: D.therapist_reply(F.col("text"), code, F.col("seen"), F.col("doc_id"), F.lit(5)))
    return docs.select("doc_id", D.needs_another(F.col("text"), F.col("seen"), F.lit(0)).alias("again"), F.md5(reply).alias("digest"))


def _languages(spark, d):
    """``doc_id``, ``text`` and ``code``, the language stated, of every document."""
    alias = table(spark, d, "lang_alias").select("alias", F.col("lang").alias("code"))
    return table(spark, d, "documents").select("doc_id", "text", "lang").join(fixed(alias), F.lower(F.trim("lang")) == F.col("alias"), "left")


@query("rendered_transcripts", f"WITH {TURNS} SELECT sample_id, md5(string_agg(text, chr(10) ORDER BY turn) || chr(10)) AS digest FROM turns GROUP BY sample_id")
def rendered_transcripts(spark, d):
    """K1, F26."""
    return spoken(spark, d).select("sample_id", F.md5(F.concat(D.history_text(F.col("m.content")), F.lit("\n"))).alias("digest"))


@query("chat_texts", f"WITH {TURNS} SELECT sample_id, md5(string_agg(coalesce(role, '') || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM turns GROUP BY sample_id")
def chat_texts(spark, d):
    """F28."""
    return spoken(spark, d).select("sample_id", F.md5(D.chat_text(F.col("m"))).alias("digest"))


@query("commented_prompts", "SELECT doc_id, md5(CASE WHEN source IS NULL THEN NULL WHEN source = '' THEN text || '<start>' ELSE string_split(text || '<start>', '<start>')[1] || chr(10) || source || chr(10) || '<start>' END) AS digest FROM documents WHERE text IS NOT NULL")
def commented_prompts(spark, d):
    """a comment before the model's token."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(D.commented(F.concat("text", F.lit("<start>")), F.col("source"), "<start>")).alias("digest"))


@query("label_lists", "SELECT idx, array_to_string(list_filter(list_transform(string_split(array_to_string(gold, ','), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS labels FROM items WHERE gold IS NOT NULL AND len(gold) > 0 UNION ALL SELECT idx, '' FROM items WHERE gold IS NULL OR len(gold) = 0")
def label_lists(spark, d):
    """Texts as lists, the first filled field."""
    joined = F.array_join("gold", ",")
    return table(spark, d, "items").select("idx", F.array_join(L.first_filled(L.as_list(joined)), "|").alias("labels"))


@query("elapsed_times", "SELECT idx, source, pred.elapsed_sec AS elapsed_sec, CAST(CAST(floor(elapsed_sec * 1000) AS BIGINT) // 3600 AS VARCHAR) || ':' || (CAST(floor(elapsed_sec * 1000) AS BIGINT) % 3600 // 60) || ':' || (CAST(floor(elapsed_sec * 1000) AS BIGINT) % 60) AS hms, CASE WHEN elapsed_sec IS NULL THEN 'nan' ELSE format('{:.4f}', elapsed_sec) END AS shown FROM predictions pred")
def elapsed_times(spark, d):
    """F30, F3."""
    p = table(spark, d, "predictions")
    hms = F.when(F.col("elapsed_sec").isNotNull(), X.elapsed(F.floor(F.col("elapsed_sec") * 1000)))
    return p.select("idx", "source", "elapsed_sec", hms.alias("hms"), X.format_double(F.col("elapsed_sec")).alias("shown"))


@query("stamped_names", "SELECT doc_id, kind || '_' || strftime(created_at, '%Y-%m-%d_%H-%M') AS name FROM documents")
def stamped_names(spark, d):
    """F30, K2."""
    return table(spark, d, "documents").select("doc_id", X.stamped(F.col("kind"), F.col("created_at")).alias("name"))


@query("first_items", "SELECT idx, task_id FROM items ORDER BY idx LIMIT 20")
def first_items(spark, d):
    """O3: the first twenty items."""
    return samples.first_rows(table(spark, d, "items").select("idx", "task_id"), "idx", 20)


@query("stub_replies", "SELECT doc_id, CASE WHEN text IS NULL THEN '' ELSE 'Client: ' || substr(md5(text), 1, 8) END AS reply FROM documents")
def stub_replies(spark, d):
    """X1, S9 with the stand-in generator."""
    return table(spark, d, "documents").select("doc_id", generation.generator(generation.stub_texts)(F.col("text")).alias("reply"))


@query("endpoint_replies", "SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN length(text) % 2 = 0 THEN 'ok ' || length(text) END AS reply, CASE WHEN length(text) % 2 = 1 THEN 'refused ' || length(text) END AS error FROM documents")
def endpoint_replies(spark, d):
    """An endpoint that fails for some texts, with tries and errors kept."""

    def call(text: str) -> str:
        if len(text) % 2:
            raise ValueError(f"refused {len(text)}")
        return f"ok {len(text)}"

    ask = generation.endpoint(generation.with_retries(call, tries=2, sleep=lambda _: None))
    return table(spark, d, "documents").select("doc_id", ask(F.col("text")).alias("r")).select("doc_id", F.col("r.text").alias("reply"), F.col("r.error").alias("error"))


@query("counted_tokens", f"SELECT doc_id, CAST({_size(_TEXT)} AS INT) AS n FROM documents")
def counted_tokens(spark, d):
    """X4, A3 with a plug-in counter."""
    count = generation.counter(lambda texts: [len((t or "").split()) for t in texts])
    return table(spark, d, "documents").select("doc_id", count(F.col("text")).alias("n"))


@query("texts_by_kind", rf"SELECT doc_id, CASE WHEN kind = 'note' THEN CAST(len(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: {STRIP_SQL.format('x')}), lambda x: x <> '')) AS BIGINT) ELSE 0 END AS utterances, CASE WHEN kind = 'note' THEN {COUNT_SQL.format("coalesce(text, '')")} ELSE 0 END AS tokens FROM documents")
def texts_by_kind(spark, d):
    """Kinds without a counter count 0."""
    lines = lambda t: F.filter(F.transform(F.split(t, r"\r?\n"), X.squeeze), lambda x: x != "")
    return statistics.text_totals(table(spark, d, "documents").select("doc_id", "kind", "text"), counters={"note": lines}).select("doc_id", "utterances", "tokens")


# sources and sinks: tables are written to the shared folder and read back by the library's readers


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("stored_dataset", "SELECT nullif(lang, '') AS lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(turn) AS BIGINT) AS turns FROM processed_dataset p WHERE split = 'dev' AND lang IN (SELECT lang FROM processed_dataset WHERE split = 'train') GROUP BY 1")
def stored_dataset(spark, d):
    """One set by language and split, read back pruned to a split; a blank folder name reads as null."""
    path = _folder(spark, "set")
    sinks.write_dataset(table(spark, d, "processed_dataset").select("lang", "split", "sample_id", "turn"), path)
    read = text.dataset(spark, path, "dev", "lang string, split string, sample_id bigint, turn int")
    return read.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("turn").alias("turns"))


@query("stored_texts", rf"WITH l AS (SELECT kind, unnest(regexp_split_to_array(text, '\r?\n')) AS line FROM documents WHERE text IS NOT NULL) SELECT kind, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM l WHERE line <> '' GROUP BY kind")
def stored_texts(spark, d):
    """Text files below a folder per kind, read back line by line."""
    path = _folder(spark, "texts")
    sinks.write_texts(table(spark, d, "documents").where("text is not null").select("kind", F.regexp_replace("text", "\ufffd", "").alias("value")), path, "kind")
    lines = text.text_lines(spark, path).where("line <> ''")
    return lines.groupBy(F.regexp_extract("path", "/kind=([^/]+)/", 1).alias("kind")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("stored_lines", "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")
def stored_lines(spark, d):
    """JSON Lines."""
    path = _folder(spark, "lines")
    table(spark, d, "documents").select("doc_id", "text").write.json(path)
    read = text.json_lines(spark, path, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]), glob="*.json")
    return read.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query("stored_report", "SELECT 'rows' AS part, CAST(count(*) AS BIGINT) AS n FROM judge UNION ALL SELECT 'summary', 1")
def stored_report(spark, d):
    """A report with its rows, read back by suffix."""
    path = _folder(spark, "report")
    judge = table(spark, d, "judge")
    sinks.write_report(judge.groupBy().agg(F.count(F.lit(1)).alias("n")), judge, path)
    files = text.mixed_corpus(spark, path, ("json",))
    lines = files.select(F.when(F.contains("path", F.lit("/summary/")), "summary").otherwise("rows").alias("part"), F.explode(F.split(X.squeeze(F.col("text")), "\n")).alias("line"))
    return lines.where("line <> ''").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("stored_scores", "SELECT doc_id, format('{:.6f}', n_chars / 7) AS score FROM documents WHERE n_chars IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE n_chars IS NULL")
def stored_scores(spark, d):
    """K4: tab-separated scores with six decimals, read back as texts."""
    path = _folder(spark, "scores")
    sinks.write_tsv(table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 7).alias("score")), path)
    return spark.read.csv(path, sep="\t", header=True, schema="doc_id bigint, score string").select("doc_id", F.nullif("score", F.lit("")).alias("score"))


@query("manifest_files", "SELECT basename, CASE WHEN count(src) = 0 THEN 'file not found: ' || basename END AS error FROM pairs GROUP BY basename")
def manifest_files(spark, d):
    """Names without a text are reported, not dropped."""
    pairs = table(spark, d, "pairs")
    texts = pairs.where("src is not null").select("basename", F.col("src").alias("text")).dropDuplicates(["basename"])
    return text.manifest_texts(pairs.select("basename").distinct(), texts, key="basename").select("basename", "error")


@query("score_rows", "SELECT doc_id, format('{:.6f}', n_chars / 7) AS score FROM documents WHERE n_chars IS NOT NULL UNION ALL SELECT doc_id, '' FROM documents WHERE n_chars IS NULL")
def score_rows(spark, d):
    """K4, F3."""
    return sinks.score_table(table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 7).alias("score")))


@query("shortened_texts", "SELECT doc_id, CASE WHEN length(t) <= 300 THEN t ELSE left(t, 300) || '...[TRUNCATED]' END AS preview FROM (SELECT doc_id, replace(text, chr(10), '\\n') AS t FROM documents)")
def shortened_texts(spark, d):
    """F22, O8."""
    return table(spark, d, "documents").select("doc_id", X.shorten(F.col("text")).alias("preview"))


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """The streaming aggregate run as a batch."""
    out = streams.windowed_counts(table(spark, d, "events").select("ts", "event_type", "value"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))
