"""Marked-up plain texts: subtitles, labelled evaluation texts, Markdown."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import bounded_batches

_NEWLINE = re.compile("\r\n|[\r\n\f\u0085  ]")


@dataclass(frozen=True)
class Cue:
    number: int
    timing: str
    lines: tuple[str, ...]


def _lines(text: str) -> list[str]:
    return _NEWLINE.sub("\n", text.lstrip("\ufeff")).split("\n")


def parse_srt(text: str) -> list[Cue]:
    """Blocks between blank lines whose first or second line is a timing; others are skipped."""
    cues: list[Cue] = []
    block: list[str] = []
    for line in [*_lines(text), ""]:
        if line.strip():
            block.append(line.rstrip())
            continue
        at = next((i for i, x in enumerate(block) if "-->" in x), -1)
        if at in (0, 1):
            first = block[0].strip()
            number = int(first) if at == 1 and re.fullmatch(r"[+-]?\d+", first) else len(cues) + 1
            cues.append(Cue(number, block[at].strip(), tuple(block[at + 1 :])))
        block = []
    return cues


def parse_tagged(text: str) -> list[Cue]:
    """Text with <eol> and <eob> after lines and blocks; an open block goes on over line breaks and to the end."""
    cues: list[Cue] = []
    lines: list[str] = []
    line: list[str] = []

    def end_line() -> None:
        if line:
            lines.append(" ".join(line))
        line.clear()

    def end_block() -> None:
        end_line()
        if lines:
            cues.append(Cue(len(cues) + 1, "", tuple(lines)))
        lines.clear()

    for row in _lines(text):
        for word in filter(None, row.split(" ")):
            if word == "<eol>":
                end_line()
            elif word == "<eob>":
                end_block()
            else:
                line.append(word)
    end_block()
    return cues


_LABEL = re.compile(r"\{([A-Z]+)(?:#([\w-]+))?:([^{}]+)\}")


@dataclass(frozen=True)
class Gold:
    start: int
    end: int
    type: str
    id: str | None
    text: str


def parse_labelled(text: str) -> tuple[str, list[Gold]]:
    """Plain text and spans of {TYPE:text} and {TYPE#id:text}; a brace outside a label raises ValueError."""
    plain, spans, at, size = [], [], 0, 0
    for m in _LABEL.finditer(text):
        plain += [text[at : m.start()], m[3]]
        size += m.start() - at
        spans.append(Gold(size, size + len(m[3]), m[1], m[2], m[3]))
        size += len(m[3])
        at = m.end()
    out = "".join([*plain, text[at:]])
    if "{" in out or "}" in out:
        raise ValueError("a brace outside a label")
    return out, spans


@dataclass(frozen=True)
class Element:
    kind: str  # header, paragraph, table, image
    text: str
    level: int = 0


_IMAGE = re.compile(r"!\[([^\]]*)\]\([^)]*\)")


def parse_markdown(text: str) -> list[Element]:
    """Headers, tables, images standing alone, and paragraphs, in order."""
    out: list[Element] = []
    block: list[str] = []

    def close() -> None:
        if block:
            table = all(x.lstrip().startswith("|") for x in block)
            image = _IMAGE.fullmatch("\n".join(block).strip())
            out.append(Element("image", image[1]) if image else Element("table" if table else "paragraph", "\n".join(block)))
        block.clear()

    fenced = False
    for line in _lines(text):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        m = None if fenced else re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if m:
            close()
            out.append(Element("header", line.strip(), len(m[1])))
        elif not line.strip() and not fenced:
            close()
        else:
            if block and not fenced and line.lstrip().startswith("|") != block[-1].lstrip().startswith("|"):
                close()
            block.append(line)
    close()
    return out


_TAGS = re.compile(r"<[^<>]*>|\{\\[^{}]*\}")


def plain_line(line: str) -> str:
    return _TAGS.sub("", line).strip()


def dialogue(plain: str) -> tuple[bool, str]:
    """Whether a speaker's dash opens the line, and the line without it."""
    if len(plain) > 1 and plain[0] in "-‐–—" and plain[1] != "-":
        return True, plain[1:].lstrip()
    return False, plain


def cue_rows(files: DataFrame, parse: Callable[[str], list[Cue]] = parse_srt, key: str = "path") -> DataFrame:
    """key, cue_idx, number, timing, lines of every cue of files(key, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, i, c) for n, t in enumerate(batch.column(1).to_pylist()) if t for i, c in enumerate(parse(t))]
            lines = pa.array([list(c.lines) for _, _, c in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([n for n, _, _ in rows], pa.int64())), pa.array([i for _, i, _ in rows], pa.int32()), pa.array([c.number for _, _, c in rows], pa.int32()), pa.array([c.timing for _, _, c in rows], pa.string()), lines], names=[key, "cue_idx", "number", "timing", "lines"])

    bounded_batches(files.sparkSession)
    return files.select(key, "value").mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, cue_idx int, number int, timing string, lines array<string>")


def gold_rows(files: DataFrame, key: str = "path") -> DataFrame:
    """key, start, end, type, id, text of every labelled span of files(key, value), in the places of the plain text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, g) for n, t in enumerate(batch.column(1).to_pylist()) if t for g in parse_labelled(t)[1]]
            cols = [pa.array([getattr(g, c) for _, g in rows], t) for c, t in (("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("id", pa.string()), ("text", pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([n for n, _ in rows], pa.int64())), *cols], names=[key, "start", "end", "type", "id", "text"])

    bounded_batches(files.sparkSession)
    return files.select(key, "value").mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, start int, end int, type string, id string, text string")


def element_rows(files: DataFrame, key: str = "path") -> DataFrame:
    """key, place, kind, text, level of every element of the Markdown texts files(key, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, i, e) for n, t in enumerate(batch.column(1).to_pylist()) if t for i, e in enumerate(parse_markdown(t))]
            cols = [pa.array([getattr(e, c) for _, _, e in rows], t) for c, t in (("kind", pa.string()), ("text", pa.string()), ("level", pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([n for n, _, _ in rows], pa.int64())), pa.array([i for _, i, _ in rows], pa.int32()), *cols], names=[key, "place", "kind", "text", "level"])

    bounded_batches(files.sparkSession)
    return files.select(key, "value").mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, place int, kind string, text string, level int")
