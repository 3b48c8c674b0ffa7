"""Linking of people's mentions in one document: which spans name the same person, and mentions a tagger missed."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.unicode import arrow_values

#: Parts of names that say nothing alone, and words of letters that stand beside names.
PARTICLES = frozenset(("af", "al", "bin", "da", "de", "del", "der", "di", "du", "el", "ibn", "la", "le", "van", "von"))
LETTER_WORDS = frozenset(("hej", "hejsan", "hälsningar", "hälsning", "mvh", "vh", "mvg", "tack", "regards", "dear", "hi", "hello", "cheers", "sincerely", "thanks"))
_CUT = regex.compile(r"[\n\t]| {2,}")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’-]*\.?")
_INITIAL = regex.compile(r"(?<!\p{L})\p{Lu}\. $")
_EMAIL = regex.compile(r"[^\s@]+@[^\s@]+")


@dataclass(frozen=True)
class Linked:
    start: int
    end: int
    type: str
    person: int | None = None
    added: bool = False


def _bare(word: str) -> str:
    return word.rstrip(".").lower()


def _names(text: str) -> list[str]:
    return [_bare(m[0]) for m in _WORD.finditer(text)]


def same_name(a: str, b: str) -> bool:
    """Equal, or one is the other's genitive."""
    return a == b or a == b + "s" or b == a + "s"


def clean(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The span up to a line break or a wide gap, without what is no name at its ends: letter words, a label with its colon, punctuation."""
    if m := _CUT.search(text, start, end):
        end = m.start()
    if (colon := text.rfind(":", start, end)) >= 0:
        start = colon + 1
    words = [m.span() for m in _WORD.finditer(text, start, end)]
    while words and _bare(text[slice(*words[0])]) in LETTER_WORDS:
        words.pop(0)
    while words and _bare(text[slice(*words[-1])]) in LETTER_WORDS:
        words.pop()
    return (words[0][0], words[-1][1]) if words else None


def link(text: str, spans: Iterable[tuple[int, int, str]], blocked: Iterable[tuple[int, int]] = (), person: str = "PERSON") -> list[Linked]:
    """The spans with a person's number where they name one, and added mentions of known names.

    Full names make people: a name whose words are all part of one longer name with the same first name, or a single
    word of it, joins that person; a first name prefers whom it is the first name of, one that fits several stands for
    itself. One-word organisations and places that equal a person's name count as that person.
    Capitalized runs of known name words that no span covers, outside e-mails and blocked spans, are added.
    """
    own: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(spans):
        if kind != person:
            own.append((a, b, kind))
        elif (c := clean(text, a, b)) is not None:
            if m := _INITIAL.search(text, max(0, c[0] - 3), c[0]):
                c = (m.start(), c[1])
            own.append((*c, kind))
    known = {w for a, b, k in own if k == person for w in _names(text[a:b]) if len(w) > 1 and w not in PARTICLES}
    fixed = []
    for a, b, k in own:
        words = _names(text[a:b])
        alike = len(words) == 1 and any(same_name(words[0], w) for w in known)
        fixed.append((a, b, person if k in ("ORGANIZATION", "LOCATION", "ORG", "LOC") and alike else k))
    shut = [*((a, b) for a, b, _ in fixed), *blocked, *(m.span() for m in _EMAIL.finditer(text))]
    added = [(a, b, person) for a, b in _runs(text, known) if all(b <= x or y <= a for x, y in shut)]
    # names of places and organisations stand for the same wherever they are repeated
    seen: dict[str, str] = {}
    for a, b, k in fixed:
        if k != person and text[a:b].strip():
            seen.setdefault(text[a:b], k)
    shut += [(a, b) for a, b, _ in added]
    for name, k in sorted(seen.items(), key=lambda x: (-len(x[0]), x[0])):
        for m in regex.finditer(rf"(?<![\p{{L}}\p{{N}}]){regex.escape(name)}(?![\p{{L}}\p{{N}}])", text):
            if all(m.end() <= x or y <= m.start() for x, y in shut):
                added.append((*m.span(), k))
                shut.append(m.span())
    people = _people([text[a:b] for a, b, k in (*fixed, *added) if k == person])
    everything = sorted([(a, b, k, False) for a, b, k in fixed] + [(a, b, k, True) for a, b, k in added])
    return [Linked(a, b, k, people.get(text[a:b]) if k == person else None, new) for a, b, k, new in everything]


def _runs(text: str, known: set[str]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for m in _WORD.finditer(text):
        word = m[0].rstrip(".")
        if not word[:1].isupper() or len(word) > 1 and word.isupper() or not any(same_name(word.lower(), k) for k in known):
            continue
        if out and text[out[-1][1] : m.start()] == " ":
            out[-1] = (out[-1][0], m.start() + len(word))
        else:
            out.append((m.start(), m.start() + len(word)))
    return out


def _fits(short: list[str], full: list[str]) -> bool:
    """Whether the short name can mean the full one; initials stand for names that start with them."""
    alike = lambda w, v: same_name(w, v) or len(w) == 1 and v.startswith(w)
    return all(any(alike(w, v) for v in full) for w in short) and (len(short) == 1 or alike(short[0], full[0]) or {*short} == {*full})


def _people(mentions: list[str]) -> dict[str, int]:
    """A number for each distinct mention text, in order of first appearance."""
    order = list(dict.fromkeys(mentions))
    words = {m: [w for w in _names(m) if w not in PARTICLES] or _names(m) for m in order}
    person: dict[str, str] = {}
    for m in sorted(order, key=lambda m: (-len(words[m]), order.index(m))):
        hosts = [h for h in person if person[h] == h and _fits(words[m], words[h])]
        equal = [h for h in hosts if len(words[h]) == len(words[m])]
        first = [h for h in hosts if len(words[m]) == 1 and same_name(words[m][0], words[h][0])]
        person[m] = next((x[0] for x in (equal, hosts, first) if len(x) == 1 or x and x is equal), m)
    numbers: dict[str, int] = {}
    return {m: numbers.setdefault(person[m], len(numbers) + 1) for m in order}


def person_placeholders(text: str, linked: list[Linked]) -> str:
    """text with people as <PERSON_n> and other spans as <TYPE>."""
    out, at = [], 0
    for s in linked:
        if s.start < at:
            continue
        out += [text[at : s.start], f"<{s.type}_{s.person}>" if s.person is not None else f"<{s.type}>"]
        at = s.end
    return "".join([*out, text[at:]])


def linked(docs: DataFrame, key: str = "doc_id", person: str = "PERSON") -> DataFrame:
    """key, start, end, type, person, added of the linked spans of docs(key, text, spans array<struct<start, end, type>>)."""

    def one(row: dict) -> list[dict]:
        spans = [(s["start"], s["end"], s["type"]) for s in row["spans"] or ()]
        return [{"start": x.start, "end": x.end, "type": x.type, "person": x.person, "added": x.added} for x in link(row["text"] or "", spans, person=person)]

    found = arrow_values(one, "array<struct<start:int,end:int,type:string,person:int,added:boolean>>")(F.struct("text", "spans"))
    return docs.select(key, F.explode(found).alias("_l")).select(key, "_l.*")
