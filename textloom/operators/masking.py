"""Masking of personal data: spans by pattern and by tagger, merged, replaced by numbered placeholders, and scored."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, fields

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import passes_luhn
from ..functions.unicode import arrow_values
from ..session import bounded_batches
from ..sources.documents import Entity
from ..sources.marked import Gold

#: The patterns of what taggers miss.
_IDS = regex.compile(r"(?<![\d-])(?<century>(?:19|20|16)?)(?<date>\d{6})[-+]?(?<serial>\d{4})(?![\d-])")
_PHONE = regex.compile(r"(?<![\w+-])(?:\+46[ -]?|0)\d{1,3}(?:[ -]?\d{2,4}){2,4}(?![\w-])")
_EMAIL = regex.compile(r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b")
_STREET = regex.compile(r"\b(?:\p{Lu}\p{Ll}+ )?\p{Lu}\p{Ll}*(?:gatan|vägen|gränd|torget|backen|stigen|allén|leden|platsen|esplanaden) \d+(?: ?[A-Z]\b)?")
_POSTAL = regex.compile(r"(?<![\d-])\d{3} \d{2} \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?")
#: Tagger types that are masked unless others are named.
KINDS = ("PER", "LOC", "ORG")


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    type: str
    source: str
    text: str


def is_date(ten: str) -> bool:
    """Whether ten digits open with a month and a day of 1 to 31; 60 may be added to the day."""
    month, day = int(ten[2:4]), int(ten[4:6])
    return 1 <= month <= 12 and (1 <= day <= 31 or 61 <= day <= 91)


def _number(m: regex.Match) -> tuple[str, str] | None:
    """Type and source of a number that passes its check: an organisation's has a third digit of 2 or more."""
    ten = m["date"] + m["serial"]
    if not (ten.isascii() and passes_luhn(ten)):
        return None
    if ten[2] >= "2" and m["century"] in ("", "16"):
        return "ORGNR", "organisationsnummer"
    return ("PNR", "personnummer") if is_date(ten) else None


def find_patterns(text: str) -> list[Span]:
    plain = [(_PHONE, "PHONE", "phone"), (_STREET, "ADDRESS", "street"), (_POSTAL, "ADDRESS", "postal-code")]
    if "@" in text:
        plain.append((_EMAIL, "EMAIL", "email"))
    out = [Span(*m.span(), kind, source, m[0]) for p, kind, source in plain for m in p.finditer(text)]
    out += [Span(*m.span(), *found, m[0]) for m in _IDS.finditer(text) if (found := _number(m))]
    return sorted(out, key=lambda s: (s.start, -s.end))


def _rank(s: Span) -> tuple[int, int]:
    return (3 if s.source in ("personnummer", "organisationsnummer") else 1 if s.source == "ner" else 2, s.end - s.start)


def merge(spans: Iterable[Span], text: str) -> list[Span]:
    """Overlapping spans become one over both; numbers outrank patterns, patterns outrank the tagger, then the longer wins."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, s.start - s.end)):
        if out and s.start < out[-1].end:
            last = out[-1]
            best, end = (s if _rank(s) > _rank(last) else last), max(last.end, s.end)
            out[-1] = Span(last.start, end, best.type, best.source, text[last.start : end])
        else:
            out.append(s)
    return out


def find(text: str, entities: Iterable[Entity] = (), kinds: Iterable[str] = KINDS) -> list[Span]:
    chosen = set(kinds)
    tagged = [Span(e.start_char, e.end_char, e.type, "ner", text[e.start_char : e.end_char]) for e in entities if e.type in chosen and e.start_char is not None]
    return merge([*find_patterns(text), *tagged], text)


def placeholders(spans: Iterable[Span], key: Callable[[Span], str] = lambda s: s.text) -> list[str]:
    """[TYPE-n] for each span: equal keys of a type share a number, numbers follow first appearance."""
    seen: dict[tuple[str, str], int] = {}
    counts: dict[str, int] = {}
    out = []
    for s in spans:
        k = (s.type, key(s))
        if k not in seen:
            counts[s.type] = seen[k] = counts.get(s.type, 0) + 1
        out.append(f"[{s.type}-{seen[k]}]")
    return out


def apply(text: str, spans: list[Span], names: list[str] | None = None) -> str:
    out, at = [], 0
    for s, name in zip(spans, names or placeholders(spans), strict=True):
        out += [text[at : s.start], name]
        at = s.end
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, masked, n_spans of docs(key, text), by patterns; row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [merge(find_patterns(t), t) if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else apply(t, s) for t, s in zip(texts, found, strict=True)], pa.string()), pa.array([len(s) for s in found], pa.int64())], names=[key, "masked", "n_spans"])

    bounded_batches(docs.sparkSession)
    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, masked string, n_spans long")


def spans_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, end, type, source, text of every merged span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, s) for i, t in enumerate(batch.column(1).to_pylist()) if t for s in merge(find_patterns(t), t)]
            cols = [pa.array([getattr(s, c) for _, s in rows], t) for c, t in (("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("source", pa.string()), ("text", pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in rows], pa.int64())), *cols], names=[key, "start", "end", "type", "source", "text"])

    bounded_batches(docs.sparkSession)
    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, start int, end int, type string, source string, text string")


@dataclass
class Score:
    gold: int = 0
    leaked: int = 0
    masks: int = 0
    over_masked: int = 0
    same_pairs: int = 0
    same_agree: int = 0
    other_pairs: int = 0
    other_agree: int = 0
    people: int = 0
    people_whole: int = 0


def evaluate(text: str, gold: list[Gold], spans: list[Span], names: list[str] | None = None) -> Score:
    """A gold span leaks if a letter or digit of it stays; a mask over no gold span is one too many.

    Pairs of gold mentions of people should share a placeholder exactly if they share an id; a person is whole with one
    placeholder that no other person has.
    """
    names = names or placeholders(spans)
    out = Score(gold=len(gold), masks=len(spans))
    hidden = [False] * len(text)
    for s in spans:
        hidden[s.start : s.end] = [True] * (s.end - s.start)
    out.leaked = sum(any(text[i].isalnum() and not hidden[i] for i in range(g.start, g.end)) for g in gold)
    out.over_masked = sum(not any(g.start < s.end and s.start < g.end for g in gold) for s in spans)

    def mask_of(g: Gold) -> str | None:
        best = max(range(len(spans)), key=lambda i: (min(spans[i].end, g.end) - max(spans[i].start, g.start), -i), default=None)
        return names[best] if best is not None and min(spans[best].end, g.end) > max(spans[best].start, g.start) else None

    people = [(g.id, mask_of(g)) for g in gold if g.id is not None]
    for i, (a, x) in enumerate(people):
        for b, y in people[i + 1 :]:
            if a == b:
                out.same_pairs += 1
                out.same_agree += x is not None and x == y
            else:
                out.other_pairs += 1
                out.other_agree += x is None or x != y
    by: dict[str, set[str | None]] = {}
    for i, x in people:
        by.setdefault(i, set()).add(x)
    out.people = len(by)
    for i, own in by.items():
        others = set().union(*(v for k, v in by.items() if k != i)) if len(by) > 1 else set()
        out.people_whole += len(own) == 1 and None not in own and not own & others
    return out


def numbered(mentions: DataFrame, keys: list[str], kind: str = "type", name: str = "text", order: str = "start") -> DataFrame:
    """keys, kind, name, placeholder of the distinct mentions of each document: [TYPE-n] in order of first appearance, in the JVM."""
    first = mentions.groupBy(*keys, kind, name).agg(F.min(order).alias("_first"))
    rank = F.dense_rank().over(Window.partitionBy(*keys, kind).orderBy("_first", name))
    return first.select(*keys, kind, name, F.concat(F.lit("["), F.upper(kind), F.lit("-"), rank, F.lit("]")).alias("placeholder"))


_SCORE = "struct<" + ",".join(f"{f.name}:int" for f in fields(Score)) + ">"


def evaluated(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and the score (a column each) of docs(key, text, gold, masks): gold of spans as gold_rows gives them, masks of spans(start, end, type, text)."""

    def one(row: dict) -> dict:
        gold = [Gold(g["start"], g["end"], g["type"], g["id"], g["text"]) for g in row["gold"] or ()]
        masks = [Span(m["start"], m["end"], m["type"], "mask", m["text"]) for m in row["masks"] or ()]
        return asdict(evaluate(row["text"] or "", gold, masks))

    score = arrow_values(one, _SCORE)(F.struct("text", "gold", "masks"))
    return docs.select(key, score.alias("_s")).select(key, "_s.*")


def report(scores: DataFrame) -> DataFrame:
    """scores(run, measure, value) with a column for each run."""
    runs = [r.run for r in scores.select("run").distinct().orderBy("run").collect()]
    return scores.groupBy("measure").pivot("run", runs).agg(F.sum("value"))
