"""Recognizers of Swedish personal data: patterns, check digits, context words.

A recognizer's verdict on a match is True (certain), None (counts only near a context word) or False. Context is looked
for among the WINDOW words on either side of the match; that width is this engine's own choice. Matches are code-point
spans.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import is_day, passes_luhn, passes_mod10, passes_mod11
from ..session import bounded_batches

WINDOW = 5
#: Raised to a certain score where a context word is near.
CONTEXT_SCORE, CERTAIN = 0.4, 1.0


@cache
def _compiled(pattern: str, ignore_case: bool) -> regex.Pattern:
    return regex.compile(pattern, regex.I if ignore_case else 0)


@cache
def _any_of(context: tuple[str, ...]) -> regex.Pattern:
    return regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(regex.escape, context)) or '(?!)'})(?![\p{{L}}\p{{N}}])")


@dataclass(frozen=True)
class Recognizer:
    """kind, (pattern, score) pairs tried in turn, words of context, and a verdict on a matched text."""

    kind: str
    patterns: tuple[tuple[str, float], ...]
    context: tuple[str, ...]
    verdict: Callable[[str, dt.date], bool | None]
    ignore_case: bool = True

    def compiled(self) -> list[tuple[regex.Pattern, float]]:
        return [(_compiled(p, self.ignore_case), s) for p, s in self.patterns]


@dataclass(frozen=True)
class Hit:
    start: int
    end: int
    kind: str
    text: str
    score: float


def _ten(text: str) -> tuple[str | None, bool]:
    """The last ten digits of a ten- or twelve-digit number, and whether a separator stands before the last four."""
    apart = len(text) >= 5 and text[-5] in "+-"
    number = text[:-5] + text[-4:] if apart else text
    return (number[-10:] if len(number) in (10, 12) and number.isascii() and number.isdigit() else None), apart


def personnummer(text: str, today: dt.date) -> bool | None:
    ten, apart = _ten(text)
    if ten is None:
        return False
    yy, month, day = int(ten[:2]), int(ten[2:4]), int(ten[4:6])
    full = len(text) - apart == 12
    if not is_day(int(text[:2]) * 100 + yy if full else None, yy, month, day - 60 if day > 60 else day) or not passes_luhn(ten):
        return False
    return True if apart else None


def organisationsnummer(text: str, today: dt.date) -> bool | None:
    ten, apart = _ten(text)
    if ten is None or ten[2] < "2" or "+" in text or not passes_luhn(ten):
        return False
    if len(text.replace("-", "")) == 12 and not text.startswith("16"):
        return False
    return True if apart else None


def _numbers(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _giro(least: int) -> Callable[[str, dt.date], bool | None]:
    return lambda text, today: None if least <= len(n := _numbers(text)) <= 8 and passes_mod10(n) else False


#: Fixed values, the clearing house's public table: first and last clearing number, type and comment (which name the
#: check), shortest and longest account.
CLEARING = (
    (1100, 1199, 1, 1, 7, 7),
    (1200, 1399, 1, 1, 7, 7),
    (1400, 2099, 1, 1, 7, 7),
    (2300, 2399, 1, 2, 7, 7),
    (2400, 2499, 1, 1, 7, 7),
    (3000, 3299, 1, 1, 7, 7),
    (3300, 3300, 2, 1, 10, 10),
    (3301, 3399, 1, 1, 7, 7),
    (3400, 3409, 1, 1, 7, 7),
    (3410, 3781, 1, 1, 7, 7),
    (3782, 3782, 2, 1, 10, 10),
    (3783, 3999, 1, 1, 7, 7),
    (4000, 4999, 1, 2, 7, 7),
    (5000, 5999, 1, 1, 7, 7),
    (6000, 6999, 2, 2, 8, 9),
    (7000, 7999, 1, 1, 7, 7),
    (8000, 8999, 2, 3, 2, 10),
    (9020, 9029, 1, 2, 7, 7),
    (9040, 9049, 1, 2, 7, 7),
    (9060, 9069, 1, 1, 7, 7),
    (9070, 9079, 1, 1, 7, 7),
    (9100, 9109, 1, 2, 7, 7),
    (9120, 9124, 1, 1, 7, 7),
    (9130, 9149, 1, 1, 7, 7),
    (9150, 9169, 1, 2, 7, 7),
    (9170, 9179, 1, 1, 7, 7),
    (9180, 9189, 2, 1, 10, 10),
    (9190, 9199, 1, 2, 7, 7),
    (9230, 9239, 1, 1, 7, 7),
    (9250, 9259, 1, 1, 7, 7),
    (9260, 9269, 1, 2, 7, 7),
    (9270, 9279, 1, 1, 7, 7),
    (9280, 9289, 1, 1, 7, 7),
    (9300, 9349, 2, 1, 10, 10),
    (9390, 9399, 1, 2, 7, 7),
    (9460, 9469, 1, 1, 7, 7),
    (9470, 9479, 1, 2, 7, 7),
    (9500, 9549, 2, 3, 2, 10),
    (9550, 9569, 1, 2, 7, 7),
    (9570, 9579, 2, 1, 10, 10),
    (9580, 9589, 1, 1, 7, 7),
    (9590, 9599, 1, 2, 7, 7),
    (9630, 9639, 1, 1, 7, 7),
    (9640, 9649, 1, 2, 7, 7),
    (9660, 9669, 1, 2, 7, 7),
    (9670, 9679, 1, 2, 7, 7),
    (9680, 9689, 1, 1, 7, 7),
    (9700, 9709, 1, 2, 7, 7),
    (9710, 9719, 1, 2, 7, 7),
    (9750, 9759, 1, 2, 7, 7),
    (9780, 9789, 1, 2, 7, 7),
    (9880, 9889, 1, 2, 7, 7),
    (9890, 9899, 2, 1, 10, 10),
    (9960, 9969, 2, 3, 2, 10),
)


def checked_digits(number: str, clearing: int, kind: tuple[int, int]) -> bool:
    """Type 1 sums clearing number and account by eleven (comment 1: without the first digit), type 2 the account by eleven or ten."""
    if kind[0] == 1:
        return passes_mod11(number[1:] if kind[1] == 1 else number)
    account = number[clearing:]
    return passes_mod11(account) if kind[1] == 2 else passes_mod10(account)


def with_clearing(df: DataFrame, column: str) -> DataFrame:
    """df with type, comment, shortest and longest of the row of CLEARING that holds its clearing number, null without one. The table is fixed and small: it is broadcast."""
    table = df.sparkSession.createDataFrame(list(CLEARING), "first int, last int, type int, comment int, shortest int, longest int")
    return df.join(F.broadcast(table), F.col(column).between(F.col("first"), F.col("last")), "left").drop("first", "last")


def bank_account(text: str, today: dt.date | None = None) -> bool | None:
    n = _numbers(text)
    head = 5 if n.startswith("8") else 4
    if not head + 2 <= len(n) <= 15:
        return False
    row = next((r for r in CLEARING if r[0] <= int(n[:4]) <= r[1]), None)
    if row is None or not row[4] <= len(n) - head <= row[5]:
        return False
    return None if checked_digits(n, head, row[2:4]) else False


#: Currency codes, months, and the parts of street names.
_CURRENCY = frozenset("AUD CAD CHF CNY CZK DKK EUR GBP HKD HUF JPY MXN NOK NZD PLN RUB SEK SGD THB TRY USD ZAR".split())
_MONTHS = "januari februari mars april maj juni juli augusti september oktober november december".split()
_SHORT = "jan feb mar apr jun jul aug sept sep okt nov dec".split()
_DATE = regex.compile(r"(?:den )?(?:(?P<y>\d{4})-?(?P<m>\d\d)-?(?P<d>\d\d)|(?P<d2>\d\d?)(?::[ae])? (?P<mon>\p{L}+)\.? (?P<y2>\d{4})|(?P<d3>\d\d?)[./](?P<m3>\d\d?)[-./ ](?P<y3>\d{4}|\d\d))", regex.I)


def date_of_birth(text: str, today: dt.date) -> bool | None:
    m = _DATE.fullmatch(text)
    if not m:
        return False
    g = m.groupdict()
    day, written = int(g["d"] or g["d2"] or g["d3"]), g["y"] or g["y2"] or g["y3"]
    month = [x[:3] for x in _MONTHS].index(g["mon"][:3].lower()) + 1 if g["mon"] and g["mon"][:3].lower() in [x[:3] for x in _MONTHS] else int(g["m"] or g["m3"] or 0)
    year = int(written) + (2000 if len(written) == 2 else 0)
    try:
        date = dt.date(year, month, day)
    except ValueError:
        return False
    return len(written) == 2 or date <= today


def _any(words: Iterable[str]) -> str:
    return "(?:" + "|".join(regex.escape(w) for w in words) + ")"


_ALONE, _ENDS = r"(?<![\d+-])", r"(?![\d-])"
_APART, _STOPS = r"(?<![\d+-])(?<!\d[ .])", r"(?![\d-])(?![ .]\d)"
_CODE = r"[1-9]\d\d ?\d\d"
_SUFFIX = "gatan vägen gränd gränden torget platsen allén backen stigen leden esplanaden kajen gången stråket promenaden parken slingan svängen kroken liden udden".split()
_SIDE = "Västra Östra Norra Södra Stora Lilla Gamla Nya Övre Nedre Inre Yttre Sankt S:t".split()
_STREET = rf"(?:\p{{Lu}}[\p{{Ll}}-]*{_any(_SUFFIX)}|\p{{Lu}}[\p{{Lu}}-]*{_any(s.upper() for s in _SUFFIX)})"


#: The patterns with their scores, and the words of context.
RECOGNIZERS: tuple[Recognizer, ...] = (
    Recognizer("SE_PERSONNUMMER", ((_ALONE + r"(?:19|20)?\d{6}[+-]\d{4}" + _ENDS, 0.5), (_ALONE + r"(?:19|20)\d{10}" + _ENDS, 0.1), (_ALONE + r"\d{10}" + _ENDS, 0.05)), ("personnummer", "personnr", "pnr", "samordningsnummer", "samordningsnr", "född", "födelsenummer", "personal identity number"), personnummer),
    Recognizer("SE_ORGANISATIONSNUMMER", ((_ALONE + r"(?:16)?\d{6}-\d{4}" + _ENDS, 0.5), (_ALONE + r"(?:16)?\d{10}" + _ENDS, 0.05)), ("organisationsnummer", "organisationsnr", "orgnr", "org.nr", "org nr", "momsregistreringsnummer", "bolagsverket", "organisation number"), organisationsnummer),
    Recognizer("SE_BANKGIRO", ((_APART + r"\d{3,4}-\d{4}" + _STOPS, 0.3), (_APART + r"\d{7,8}" + _STOPS, 0.05)), ("bankgiro", "bankgironummer", "bankgironr", "bankgirot", "bg", "bg-nr", "bg-nummer", "bank giro"), _giro(7)),
    Recognizer("SE_PLUSGIRO", ((_APART + r"\d\d?(?: ?\d\d){1,3}-\d" + _STOPS, 0.1), (_APART + r"\d{4,8}" + _STOPS, 0.05)), ("plusgiro", "plusgironummer", "plusgironr", "plusgirot", "postgiro", "pg", "pg-nr", "pg-nummer"), _giro(4)),
    Recognizer("SE_BANK_ACCOUNT", ((_APART + r"(?:8\d{3}-\d|\d{4,5})(?:,? | ?- ?)\d(?:[ -]?\d){1,11}" + _STOPS, 0.1), (_APART + r"\d{11,15}" + _STOPS, 0.05)), ("konto", "kontonummer", "kontonr", "bankkonto", "bankkontonummer", "lönekonto", "sparkonto", "privatkonto", "personkonto", "clearingnummer", "clearingnr", "clearing", "clnr", "bank account", "account number"), bank_account),
    Recognizer("SE_POSTNUMMER", ((r"(?<![\w-])SE-? ?" + _CODE + _STOPS, 0.6), (_APART + r"\b" + _CODE + r"(?= \p{Lu}[\p{L}-]+(?![\p{L}\d]))", 0.6), (_APART + r"\b" + _CODE + _STOPS, 0.05)), ("postnummer", "postnr", "postadress", "adress", "utdelningsadress", "besöksadress", "gatuadress", "bostadsadress", "folkbokföringsadress", "postort", "ort", "box", "postbox", "postal code", "zip"), lambda t, today: None if len(n := _numbers(t)) == 5 and int(n) <= 98499 else False, False),
    Recognizer("ADDRESS", ((rf"(?<![\p{{L}}\d-])(?:{_any([*_SIDE, *(s.upper() for s in _SIDE)])} )?{_STREET} [1-9]\d{{0,3}}(?:-\d{{1,4}})?(?: ?[A-Z]|[a-z])?(?![\p{{L}}\d])(?:,? {_any(['lgh', 'lägenhet', 'LGH'])} ?\d{{4}})?(?![\p{{L}}\d])", 0.6),), ("adress", "gatuadress", "bostadsadress", "besöksadress", "utdelningsadress", "folkbokföringsadress", "bor", "boende", "address"), lambda t, today: None, False),
    Recognizer("SE_VEHICLE_REGISTRATION", ((r"(?<![\p{L}\d-])[A-HJ-PR-UW-Z]{3} ?\d\d[A-HJ-NPR-UW-Z\d](?![\p{L}\d-])", 0.3),), ("registreringsnummer", "regnummer", "regnr", "reg.nr", "reg nr", "registreringsskylt", "nummerplåt", "bil", "bilen", "bilens", "fordon", "fordonet", "fordonets", "registration", "licence plate", "license plate"), lambda t, today: False if t[:3] in _CURRENCY else None, False),
    Recognizer("DATE_OF_BIRTH", ((rf"(?<=(?<![\p{{L}}\d]){_any(['född', 'föddes', 'f.', 'födelsedatum', 'födelsedag'])}(?: den)?:? )(?:den )?(?:(?:19|20)\d\d-?[01]\d-?[0-3]\d|[0-3]?\d(?::[ae])? {_any(_MONTHS + _SHORT)}\.? (?:19|20)\d\d|[0-3]?\d[./][01]?\d(?:[-./ ](?:19|20)\d\d|[-./]\d\d))(?![\p{{L}}\d-])(?![./]\d)", 0.6),), (), date_of_birth),
)

_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}.-]*[\p{L}\p{N}]|[\p{L}\p{N}]")
#: Kinds whose pattern alone is enough to report a match that has no verdict of its own.
THRESHOLD = 0.35


class Words:
    """The places of a text's words, found once."""

    def __init__(self, text: str):
        self.text = text
        found = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]

    def around(self, start: int, end: int, window: int) -> str:
        """The window words before the span and those after it, in lower case."""
        before, after = bisect_right(self.ends, start), bisect_left(self.starts, end)
        named = lambda a, b: " ".join(self.text[self.starts[i] : self.ends[i]] for i in range(max(0, a), min(b, len(self.starts))))
        return f" {named(before - window, before)} | {named(after, after + window)} ".lower()


def near_context(text: str | Words, start: int, end: int, context: Iterable[str], window: int = WINDOW) -> bool:
    """Whether one of the context's words or phrases stands among the window words before or after the span."""
    words = text if isinstance(text, Words) else Words(text)
    return bool(_any_of(tuple(context)).search(words.around(start, end, window)))


def recognize(text: str, recognizers: Iterable[Recognizer] = RECOGNIZERS, today: dt.date | None = None, threshold: float = THRESHOLD) -> list[Hit]:
    """Matches with a verdict other than False whose score, raised by context, reaches the threshold; the best at each span and kind."""
    today = today or dt.date.today()
    best: dict[tuple[int, int, str], Hit] = {}
    words: Words | None = None
    for r in recognizers:
        for pattern, score in r.compiled():
            for m in pattern.finditer(text):
                verdict = r.verdict(m[0], today)
                if verdict is False:
                    continue
                value = CERTAIN if verdict else score
                if not verdict and r.context:
                    words = words or Words(text)
                if not verdict and r.context and near_context(words, m.start(), m.end(), r.context):
                    value = min(CERTAIN, max(score + 0.35, CONTEXT_SCORE))
                key = (m.start(), m.end(), r.kind)
                if value >= threshold and (key not in best or best[key].score < value):
                    best[key] = Hit(*key, m[0], value)
    return sorted(best.values(), key=lambda h: (h.start, h.end, h.kind))


def find_pii(docs: DataFrame, kinds: Iterable[str] | None = None, today: dt.date | None = None, key: str = "doc_id") -> DataFrame:
    """key, start, end, kind, text, score of every hit in docs(key, text). Only the kinds asked for are run."""
    chosen = [r.kind for r in RECOGNIZERS if kinds is None or r.kind in set(kinds)]
    day = today or dt.date.today()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [r for r in RECOGNIZERS if r.kind in chosen]
        for batch in batches:
            rows = [(i, h) for i, t in enumerate(batch.column(1).to_pylist()) if t for h in recognize(t, own, day)]
            cols = [pa.array([getattr(h, c) for _, h in rows], t) for c, t in (("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("score", pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in rows], pa.int64())), *cols], names=[key, "start", "end", "kind", "text", "score"])

    kind = docs.schema[key].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, start int, end int, kind string, text string, score double")


#: Entity types of taggers and the kinds of personal data they stand for; others are dropped.
TYPE_MAP = {"PER": "PERSON", "PERSON": "PERSON", "PRS": "PERSON", "LOC": "LOCATION", "GPE": "LOCATION", "FAC": "LOCATION", "ORG": "ORGANIZATION", "NORP": "NRP", "DATE": "DATE_TIME", "TIME": "DATE_TIME", "TME": "DATE_TIME"}


def entity_kinds(entities: DataFrame, kinds: Iterable[str] | None = None, score: float = 0.85) -> DataFrame:
    """entities(type, ...) with kind and score; unmapped types go, and kinds not asked for."""
    spark = entities.sparkSession
    table = F.broadcast(spark.createDataFrame([(k, v) for k, v in TYPE_MAP.items()], "type string, kind string"))
    out = entities.join(table, "type").withColumn("score", F.lit(score))
    return out if kinds is None else out.where(F.col("kind").isin(list(kinds)))


#: Parts of speech that count as stop words.
STOP_UPOS = ("DET", "ADP", "PRON", "AUX", "CCONJ", "SCONJ", "PART")


def normalized_tokens(words: DataFrame) -> DataFrame:
    """Each distinct word text with its lemma and whether it is a stop word or punctuation, by its most frequent analysis."""
    counted = words.groupBy("text", "lemma", "upos").agg(F.count("*").alias("n"))
    best = counted.groupBy("text").agg(F.max_by(F.struct("lemma", "upos"), F.struct("n", F.col("lemma").isNotNull(), "lemma", "upos")).alias("b"))
    return best.select("text", F.coalesce("b.lemma", "text").alias("lemma"), F.coalesce(F.col("b.upos").isin(*STOP_UPOS), F.lit(False)).alias("is_stop"), F.coalesce(F.col("b.upos") == "PUNCT", F.lit(False)).alias("is_punct"))


