"""Column functions on transcripts, turns and generated responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import squeeze
from colloquy.schemas import ANY_MESSAGES

# Tags of both speakers, in order of priority, and the labels of each language's transcripts.
THERAPIST_TAGS = ("Therapeut", "Therapist", "Thérapeute", "Therapiste", "المعالج", "المعالجة")
CLIENT_TAGS = ("Klient", "Client", "العميل", "العميلة")
LABELS = {"fr": ("Thérapeute:", "Client:"), "ar": ("المعالج:", "العميل:"), "de": ("Therapeut:", "Klient:"), "en": ("Therapist:", "Client:")}
LINE_TAGS = ("Therapist:", "Client:")
# Spellings of the end marker, replaced in this order.
END_SPELLINGS = (("[END]", "[/END]"), ("[**/END**]", "[/END]"), ("[**END**]", "[/END]"), ("/END", "[/END]"), ("[[/END]]", "[/END]"), ("[]", "[/END]"))
# Replies that stand in for an empty client turn.
CLIENT_REPLIES = {
    "fr": ("Client: [Pas de réponse]", "Client: [Pause et réfléchit]", "Client: [Reste silencieux]", "Client: [Silence]", "Client: Je ne sais pas quoi dire", "Client: Je ne sais pas"),
    "en": ("Client: [No reply]", "Client: [Pause and thinking]", "Client: [Keep silent]", "Client: [Quiet]", "Client: I don't know what to say", "Client: I don't know"),
    "de": ("Klient: [Keine Antwort]", "Klient: [Pause und denkt nach]", "Klient: [Schweigt]", "Klient: [Still]", "Klient: Ich weiß nicht, was ich sagen soll", "Klient: Ich weiß nicht"),
    "ar": ("العميل: [لا رد]", "العميل: [وقفة قصيرة ويفكر]", "العميل: [يلتزم الصمت]", "العميل: [صمت]", "العميل: لا أعرف ماذا أقول", "العميل: لا أعرف"),
}


# Replies that stand in for a therapist turn that repeats itself or has no tag after all attempts.
THERAPIST_REPLIES = {
    "fr": ("Thérapeute: Je vous entends.", "Thérapeute: Pouvez-vous m'en dire plus ?", "Thérapeute: Comment vous sentez-vous en ce moment ?", "Thérapeute: Prenons le temps d'y réfléchir ensemble.", "Thérapeute: Je suis là pour vous écouter."),
    "ar": ("المعالج: أنا أسمعك.", "المعالج: هل يمكنك إخباري بالمزيد؟", "المعالج: كيف تشعر في هذه اللحظة؟", "المعالج: دعنا نفكر في هذا معًا.", "المعالج: أنا هنا للاستماع إليك."),
    "de": ("Therapeut: Ich höre Ihnen zu.", "Therapeut: Können Sie mir mehr darüber erzählen?", "Therapeut: Wie fühlen Sie sich gerade?", "Therapeut: Lassen Sie uns gemeinsam darüber nachdenken.", "Therapeut: Ich bin hier, um Ihnen zuzuhören."),
}
# Turn from which a session is wound down, the turn it is told to end in, and the last turn of all.
WIND_DOWN, LAST_TURN, HARD_STOP = 22, 30, 33
#: Therapist turns before this one keep no end marker.
LEAST_END = 15


def _quoted(values) -> str:
    return "|".join("\\Q" + v + "\\E" for v in values)


def turns(text: Column, labels: tuple[str, ...]) -> Column:
    """Trimmed, non-blank pieces of a transcript, cut before every speaker label."""
    pieces = F.split(squeeze(text), f"(?=(?:{_quoted(labels)}))")
    return F.filter(F.transform(pieces, squeeze), lambda x: x != "")


def without_label(turn: Column, label: str) -> Column:
    """The turn without its speaker's label."""
    return squeeze(F.replace(turn, F.lit(label), F.lit("")))


def without_end(text: Column) -> Column:
    """Trimmed text without end markers."""
    return squeeze(F.regexp_replace(text, r"\[/?END\]", ""))


def canonical_end(text: Column) -> Column:
    """All spellings of the end marker brought to ``[/END]``."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), END_SPELLINGS, text)


def plain_tags(text: Column, tags: tuple[str, ...]) -> Column:
    """``**Tag:**`` as ``Tag:`` (F8)."""
    return reduce(lambda c, t: F.replace(c, F.lit(f"**{t}:**"), F.lit(f"{t}:")), tags, text)


def without_response_end(text: Column) -> Column:
    """Without the generator's stop marker."""
    return F.replace(text, F.lit("<|END_RESPONSE|>"), F.lit(""))


def after_thinking(text: Column) -> Column:
    """What follows the first ``</think>``, trimmed; the whole text if there is none."""
    return F.when(F.contains(text, F.lit("</think>")), squeeze(F.regexp_extract(text, r"(?s)</think>\s*(.*)", 1))).otherwise(text)


def own_turn(text: Column, tags: tuple[str, ...], whole: bool) -> Column:
    """From the first own tag on, to the end (``whole``) or the end of its line; unchanged without a tag."""
    found = F.regexp_extract(text, f"(?{'is' if whole else 'i'}u)((?:{_quoted(tags)})\\s*:\\s*.+)", 1)
    return F.when(found != "", squeeze(found)).otherwise(text)


def first_tag(text: Column, tags: tuple[str, ...]) -> Column:
    """Place (from 1) of the first tag in list order that occurs, in any letter case; null if none does."""
    low = F.lower(text)
    return F.coalesce(*[F.nullif(F.locate(f"{t.lower()}:", low), F.lit(0)) for t in tags])


def cut_at_tags(text: Column, tags: tuple[str, ...]) -> Column:
    """The text before the other speaker's tag."""
    at = first_tag(text, tags)
    return F.when(at.isNotNull(), F.substring(text, F.lit(1), at - 1)).otherwise(text)


def without_word_count(text: Column) -> Column:
    """Without ``(N words)`` at the end."""
    return F.regexp_replace(text, r"\s*\(\d+\s+words\)$", "")


def quoted_turn(text: Column, label: str) -> Column:
    """From the label to the first quote, else to the first quoted full stop."""
    found = F.regexp_extract(text, f'(?s)(\\Q{label}\\E.*?)"', 1)
    stop = F.locate('."', text)
    return squeeze(F.when(found != "", found).when(stop > 0, F.substring(text, F.lit(1), stop)).otherwise(text))


def early_end(text: Column, turn: Column, style: Column) -> Column:
    """End markers are dropped before turn 12 of mdd sessions and turn 7 of others (F16)."""
    least = F.when(F.contains(style, F.lit("mdd")), 12).otherwise(7)
    bare = F.replace(F.replace(text, F.lit("[/END]"), F.lit("")), F.lit("[END]"), F.lit(""))
    return squeeze(F.when(turn < least, bare).otherwise(text))


def pick(options: Column, *key: Column) -> Column:
    """One of ``options``, chosen by a hash of the key: the same on every run."""
    at = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("long"), F.size(options).cast("long"))
    return F.element_at(options, (at + 1).cast("int"))


def client_reply(text: Column, lang: str, *key: Column) -> Column:
    """A stand-in reply where a client turn is empty, only a tag, or lacks a tag."""
    tagged = _tagged(text, CLIENT_TAGS)
    bare = F.coalesce(squeeze(text), F.lit("")).isin("", *[f"{t}:" for t in CLIENT_TAGS])
    return F.when(~bare & tagged, text).otherwise(pick(F.array(*[F.lit(r) for r in CLIENT_REPLIES[lang]]), *key))


def therapist_reply(text: Column, lang: str, seen_before: Column, *key: Column) -> Column:
    """A stand-in reply where a therapist turn still repeats an earlier one or has no tag (F15); languages without
    stand-ins keep the turn."""
    if lang not in THERAPIST_REPLIES:
        return text
    return F.when(seen_before | ~_tagged(text, THERAPIST_TAGS), pick(F.array(*[F.lit(r) for r in THERAPIST_REPLIES[lang]]), *key)).otherwise(text)


def by_language(lang: Column, make) -> Column:
    """``make(code)`` of the language a row states, English where it states none."""
    return reduce(lambda c, code: c.when(lang == code, make(code)), [c for c in LABELS if c != "en"], F.when(F.lit(False), make("en"))).otherwise(make("en"))


def needs_another(text: Column, seen_before: Column, attempts: Column, most: int = 4) -> Column:
    """Whether a therapist turn is generated again: it repeats an earlier one or has no tag, and fewer than ``most``
    attempts were made (W6)."""
    return (seen_before | ~_tagged(text, THERAPIST_TAGS)) & (attempts < most)


def wind_down(turn: Column) -> Column:
    """What long sessions are told from turn 22 on; empty before."""
    left = F.lit(LAST_TURN) - turn
    said = F.when(left == 1, "You should end the conversation in 1 turn.").when(left == 0, "You should end the conversation in this turn with '[/END]' token.")
    return F.when(turn < WIND_DOWN, "").otherwise(said.otherwise(F.concat(F.lit("You should end the conversation in "), left.cast("string"), F.lit(" turns."))))


def late_end(text: Column, turn: Column) -> Column:
    """A therapist turn before turn 15 without `` [/END]`` (F16)."""
    return F.when(turn < LEAST_END, F.replace(text, F.lit(" [/END]"), F.lit(""))).otherwise(text)


def without_tool_calls(text: Column) -> Column:
    """Without the generator's call markers."""
    return F.replace(text, F.lit("<tool_call>"), F.lit(""))


def _tagged(text: Column, tags: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(text, F.lit(f"{t}:")) for t in tags])


def cleaned(text: Column, role: str, turn: Column, style: Column, thinking: bool = False) -> Column:
    """The response of a generator as a turn: all cleaning steps in order."""
    own, other = (CLIENT_TAGS, THERAPIST_TAGS) if role == "client" else (THERAPIST_TAGS, CLIENT_TAGS)
    out = without_tool_calls(without_response_end(plain_tags(text, own)))
    out = after_thinking(out) if thinking else out
    out = cut_at_tags(own_turn(out, own, whole=role == "client"), other)
    out = early_end(canonical_end(out), turn, style)
    if thinking:
        out = without_word_count(quoted_turn(out, "Client:" if role == "client" else "Therapist:"))
    return out


def history_text(responses: Column) -> Column:
    """Responses joined by line breaks."""
    return F.array_join(responses, "\n")


def filled(template: Column, **values: Column) -> Column:
    """The template with ``{name}`` slots replaced."""
    return reduce(lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1], F.lit(""))), values.items(), template)


def commented(prompt: Column, comment: Column, token: str, last: bool = False) -> Column:
    """A comment set before the model's token: after the text before its first place, or with its last place removed
    (F26); an empty comment changes nothing."""
    head = F.substring_index(prompt, token, -1)
    kept = F.concat(F.substring(prompt, F.lit(1), F.length(prompt) - F.length(head) - len(token)), head) if last else F.substring_index(prompt, token, 1)
    return F.when(comment == "", prompt).otherwise(F.concat(kept, F.lit("\n"), comment, F.lit("\n" + token)))


def decoded(raw: Column) -> Column:
    """Messages of a JSON text as ``{role, content}``, whichever key layout it has; unreadable texts give null."""
    role = lambda m: F.lower(m["role"])
    named = lambda m: F.when(role(m) == "therapist", "assistant").when(role(m) == "client", "user").otherwise(role(m))
    return F.transform(F.from_json(raw, ANY_MESSAGES), lambda m: F.struct(named(m).alias("role"), F.coalesce(m["content"], m["response"]).alias("content")))


def encoded(messages: Column) -> Column:
    """Messages as JSON text."""
    return F.to_json(messages)


def chat_text(messages: Column) -> Column:
    """A plain rendering of a message list, one ``role: content`` line each."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def roles(messages: Column) -> Column:
    """Roles in order."""
    return F.transform(messages, lambda m: m["role"])
