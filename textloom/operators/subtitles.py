"""Line breaks of subtitles: which breaks split words that belong together, and where a better one is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.unicode import arrow_values
from ..sources.documents import Word
from ..sources.marked import Cue, dialogue, plain_line

#: Relations whose two words belong on one line, with the cost of a break between them; those of the
#: first table only where the dependent stands before its head.
KEPT_BEFORE = {"det": 10, "det:poss": 10, "det:predet": 10, "nmod:poss": 10, "amod": 10, "nummod": 8}
KEPT = {"compound": 8, "flat": 10, "flat:name": 10, "fixed": 10, "case": 8, "compound:prt": 10}
#: Relations of words that should not end a line.
NOT_LAST = {"cc": 6, "mark": 6}
SUBJECTS, WITH_VERB = ("nsubj", "nsubj:pass", "expl"), ("aux", "aux:pass", "cop")
PRONOUN_COST = 10
MAX_LINE = 42


def midpoint(c: Column) -> Column:
    """The place (from 1) of the blank nearest the middle, the earlier on ties; null without a blank."""
    # one pass over the words with a running place: the length is carried along, as a lambda would count it each time
    words = F.split(c, " ", -1)
    nearest = F.struct(F.lit(None).cast("int").alias("off"), F.lit(None).cast("int").alias("at"))
    start = F.struct(F.lit(0).alias("at"), F.length(c).alias("n"), nearest.alias("best"))

    def step(done: Column, word: Column) -> Column:
        at = done["at"] + F.length(word) + 1
        here = F.struct(F.abs(2 * (at - 1) - (done["n"] - 1)).alias("off"), at.alias("at"))
        nearer = done["best"]["at"].isNull() | (here["off"] < done["best"]["off"])
        return F.struct(at.alias("at"), done["n"].alias("n"), F.when(nearer, here).otherwise(done["best"]).alias("best"))

    return F.aggregate(F.slice(words, 1, F.size(words) - 1), start, step)["best"]["at"]


def midpoint_of(text: str) -> int | None:
    blanks = [i for i, c in enumerate(text) if c == " "]
    return min(blanks, key=lambda i: (abs(2 * i - (len(text) - 1)), i)) if blanks else None


@dataclass(frozen=True)
class CueLine:
    start: int
    text: str
    dialogue: bool


def transcript(cues: list[Cue]) -> tuple[str, list[list[CueLine]]]:
    """The cues' plain lines joined by blanks, and each line's place in that text."""
    parts, placed, at = [], [], 0
    for cue in cues:
        own = []
        for raw in cue.lines:
            speaks, line = dialogue(plain_line(raw))
            if line:
                own.append(CueLine(at, line, speaks))
                parts.append(line)
                at += len(line) + 1
        placed.append(own)
    return " ".join(parts), placed


@dataclass(frozen=True)
class Split:
    relation: str
    weight: int
    head: str
    dependent: str


def relation_weight(word: Word, head: Word, ends_line: bool) -> int:
    """The cost of a break between a word and its head, 0 if it may fall there."""
    if word.id < head.id and word.deprel in KEPT_BEFORE:
        return KEPT_BEFORE[word.deprel]
    return KEPT.get(word.deprel, 0) or (NOT_LAST.get(word.deprel, 0) if ends_line else 0)


def relation_costs(words: DataFrame, ends_line: Column | None = None) -> DataFrame:
    """words(word_id, head, deprel, ...) with cost: relation_weight() in the JVM; 0 for words without a head."""
    cost = F.lit(0)
    if ends_line is not None:
        for relation, weight in NOT_LAST.items():
            cost = F.when(ends_line & (F.col("deprel") == relation), F.lit(weight)).otherwise(cost)
    for relation, weight in KEPT.items():
        cost = F.when(F.col("deprel") == relation, F.lit(weight)).otherwise(cost)
    for relation, weight in KEPT_BEFORE.items():
        cost = F.when((F.col("deprel") == relation) & (F.col("word_id") < F.col("head")), F.lit(weight)).otherwise(cost)
    return words.withColumn("cost", F.when(F.coalesce(F.col("head"), F.lit(0)) > 0, cost).otherwise(F.lit(0)))


def _is_subject_of(pronoun: Word, verb: Word) -> bool:
    return pronoun.upos == "PRON" and pronoun.deprel in SUBJECTS and (verb.id == pronoun.head or verb.head == pronoun.head and verb.deprel in WITH_VERB)


def splits(words: list[Word], at: int) -> list[Split]:
    """What a break before code point at tears apart in one sentence's words."""
    by_id = {w.id: w for w in words}
    left = {w.id for w in words if w.end_char is not None and w.end_char <= at}
    last, first = by_id.get(max(left, default=0)), by_id.get(max(left, default=0) + 1)
    out = []
    for w in words:
        head = by_id.get(w.head or 0)
        if head is not None and (w.id in left) != (head.id in left) and (cost := relation_weight(w, head, w is last)):
            out.append(Split(w.deprel, cost, head.text, w.text))
    for a, b in ((last, first), (first, last)):
        if a is not None and b is not None and _is_subject_of(a, b):
            out.append(Split(a.deprel, PRONOUN_COST, b.text, a.text))
    return out


@dataclass(frozen=True)
class BreakOption:
    at: int
    score: float
    splits: tuple[Split, ...]


def options(text: str, start: int, words: list[Word], longest: int = MAX_LINE) -> list[BreakOption]:
    """Every blank of a two-line subtitle as a break, scored: what it splits, and the shape of the two lines."""
    out = []
    for i, c in enumerate(text):
        if c != " ":
            continue
        first, second = text[:i].rstrip(), text[i + 1 :].lstrip()
        if not first or not second:
            continue
        torn = splits(words, start + i)
        score = sum(s.weight for s in torn) + abs(len(first) - len(second)) / 4
        score += len(first) > len(second)
        score += 3 * (" " not in first or " " not in second)
        score += 5 * (max(0, len(first) - longest) + max(0, len(second) - longest))
        score -= 4 * (first[-1] in ".,;:!?…")
        after = next((w for w in words if w.start_char is not None and w.start_char >= start + i), None)
        score -= 2 * (after is not None and after.deprel in ("cc", "mark", "case"))
        out.append(BreakOption(i, score, tuple(torn)))
    return out


@dataclass(frozen=True)
class Finding:
    cue: int
    line: int
    splits: tuple[Split, ...]
    suggestion: str | None


def check(placed: list[list[CueLine]], sentences: list[list[Word]]) -> list[Finding]:
    """Breaks between a cue's lines that tear words apart. A cue of two lines gets the best break, if that tears less."""
    words = [w for s in sentences for w in s]
    out = []
    for n, lines in enumerate(placed):
        for i in range(len(lines) - 1):
            if lines[i + 1].dialogue:
                continue
            at = lines[i].start + len(lines[i].text)
            torn = [x for s in sentences if s and (s[0].start_char or 0) < at < (s[-1].end_char or 0) for x in splits(s, at)]
            if not torn:
                continue
            suggestion = None
            if len(lines) == 2:
                text = f"{lines[0].text} {lines[1].text}"
                own = [w for w in words if w.start_char is not None and lines[0].start <= w.start_char < lines[1].start + len(lines[1].text)]
                best = min(options(text, lines[0].start, own), key=lambda o: o.score, default=None)
                if best is not None and best.at != len(lines[0].text) and sum(s.weight for s in best.splits) < sum(s.weight for s in torn):
                    suggestion = f"{text[: best.at]}\n{text[best.at + 1 :]}"
            out.append(Finding(n, i, tuple(torn), suggestion))
    return out


def measure(placed: list[list[CueLine]], sentences: list[list[Word]]) -> dict[str, int]:
    """Of two-line cues: how many own breaks are flagged, how many at the midpoint, and how often the best is the own."""
    counts = {"cues": 0, "own_flagged": 0, "midpoint_flagged": 0, "best_is_own": 0}
    for lines in placed:
        if len(lines) != 2 or lines[1].dialogue:
            continue
        text, start = f"{lines[0].text} {lines[1].text}", lines[0].start
        own = [w for s in sentences for w in s if w.start_char is not None and start <= w.start_char < start + len(text)]
        counts["cues"] += 1
        counts["own_flagged"] += bool(splits(own, start + len(lines[0].text)))
        mid = midpoint_of(text)
        counts["midpoint_flagged"] += mid is not None and bool(splits(own, start + mid))
        best = min(options(text, start, own), key=lambda o: o.score, default=None)
        counts["best_is_own"] += best is not None and best.at == len(lines[0].text)
    return counts


_TAG = r"<[^<>]*>|\{\\[^{}]*\}"


def cue_lines(cues: DataFrame, key: str = "path") -> DataFrame:
    """key, cue_idx, line_idx, start, text, dialogue of cues(key, cue_idx, lines): transcript() in the JVM, a row a line."""
    each = cues.select(key, "cue_idx", F.posexplode("lines").alias("_raw", "line"))
    plain = F.regexp_replace(F.regexp_replace("line", _TAG, ""), r"(?U)^\s+|\s+$", "")
    speaks = (F.length(plain) > 1) & F.substring(plain, 1, 1).isin(*"-‐–—") & (F.substring(plain, 2, 1) != "-")
    text = F.when(speaks, F.regexp_replace(F.substring(plain, 2, 1 << 30), r"(?U)^\s+", "")).otherwise(plain)
    kept = each.select(key, "cue_idx", "_raw", text.alias("text"), speaks.alias("dialogue")).where("text <> ''")
    order = Window.partitionBy(key).orderBy("cue_idx", "_raw")
    own = Window.partitionBy(key, "cue_idx").orderBy("_raw")
    start = F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return kept.select(key, "cue_idx", (F.row_number().over(own) - 1).alias("line_idx"), start.alias("start"), "text", "dialogue")


def _grouped(lines: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """key, lines (arrays of lines by cue) and sentences (arrays of words): what the checker sees of one file."""
    cues = lines.groupBy(key, "cue_idx").agg(F.array_sort(F.collect_list(F.struct("line_idx", F.struct("start", "text", "dialogue").alias("l")))).alias("_ls"))
    cues = cues.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("cue_idx", F.col("_ls.l").alias("ls")))).alias("cues"))
    word = F.struct(*[F.col(c) for c in ("word_id", "text", "upos", "head", "deprel", "start_char", "end_char")])
    sentences = words.groupBy(key, "sent_idx").agg(F.array_sort(F.collect_list(word)).alias("_ws")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sent_idx", F.col("_ws").alias("ws")))).alias("sentences"))
    return cues.join(sentences, key, "left")


def _inputs(row: dict) -> tuple[list[int], list[list[CueLine]], list[list[Word]]]:
    placed = [[CueLine(x["start"], x["text"], x["dialogue"]) for x in c["ls"]] for c in row["cues"]]
    words = [[Word(w["word_id"], w["text"], upos=w["upos"], head=w["head"], deprel=w["deprel"], start_char=w["start_char"], end_char=w["end_char"]) for w in s["ws"]] for s in row["sentences"] or ()]
    return [c["cue_idx"] for c in row["cues"]], placed, words


def findings(lines: DataFrame, words: DataFrame, key: str = "path") -> DataFrame:
    """key, cue_idx, line_idx, cost, suggestion of the breaks that tear words apart; lines as cue_lines gives them, words(key, sent_idx, word_id, ...) with places in the transcript."""

    def one(row: dict) -> list[dict]:
        cues, placed, sentences = _inputs(row)
        return [{"cue_idx": cues[f.cue], "line_idx": f.line, "cost": sum(s.weight for s in f.splits), "suggestion": f.suggestion} for f in check(placed, sentences)]

    found = arrow_values(one, "array<struct<cue_idx:int,line_idx:int,cost:int,suggestion:string>>")(F.struct("cues", "sentences"))
    return _grouped(lines, words, key).select(key, F.explode(found).alias("_f")).select(key, "_f.*")


def measures(lines: DataFrame, words: DataFrame, key: str = "path") -> DataFrame:
    """key, cues, own_flagged, midpoint_flagged, best_is_own of every file."""
    counts = arrow_values(lambda row: measure(*_inputs(row)[1:]), "struct<cues:int,own_flagged:int,midpoint_flagged:int,best_is_own:int>")(F.struct("cues", "sentences"))
    return _grouped(lines, words, key).select(key, counts.alias("_m")).select(key, "_m.*")
