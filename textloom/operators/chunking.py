"""Chunks of documents for retrieval: sections under their headers, packed sentence by sentence into a token budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.unicode import bounded_udf
from ..session import bounded_batches
from ..sources.marked import Element, parse_markdown
from .segment import sentence_texts

Count = Callable[[str], int]


def count_words(text: str) -> int:
    return len(text.split())


@dataclass(frozen=True)
class Section:
    context: str
    units: tuple[str, ...]
    whole: bool = False


@dataclass(frozen=True)
class Chunk:
    context: str
    content: str


def sections(elements: list[Element], sentences: Callable[[str], list[str]] | None = None) -> Iterator[Section]:
    """The parts under each header, with the headers above as context. A table is a section of one unit of its own."""
    cut = sentences or sentence_texts
    heads: dict[int, str] = {}
    held: list[str] = []

    def close() -> Iterator[Section]:
        if held:
            yield Section("\n".join(heads[k] for k in sorted(heads) if heads[k]), tuple(held))
        held.clear()

    for e in elements:
        if e.kind == "header":
            yield from close()
            heads = {k: v for k, v in heads.items() if k < e.level} | {e.level: e.text}
        elif e.kind == "table":
            yield from close()
            yield Section("\n".join(heads[k] for k in sorted(heads) if heads[k]), (e.text,), True)
        else:
            held += [s for s in cut(e.text) if s.strip()]
    yield from close()


def pack(section: Section, most: int, overlap: int = 0, count: Count = count_words) -> list[Chunk]:
    """Units are added while the context and they fit; the last units that fit the overlap open the next chunk.

    A unit that alone is too long is cut at its words and takes no overlap. Headers that fill the budget raise ValueError.
    Words are counted unit by unit; any other count sees each candidate text whole, since it need not add up.
    """
    head = section.context + "\n" if section.context else ""
    if head and count(head) >= most:
        raise ValueError("the headers alone fill a chunk")
    if count is count_words:
        room = most - count_words(head)
        fits = lambda units, sizes: sum(sizes) <= room
    else:
        fits = lambda units, sizes: count(head + " ".join(units)) <= most
    out: list[Chunk] = []
    held: list[str] = []
    sizes: list[int] = []
    fresh = 0  # units of held that no chunk has yet

    def put(units: list[str]) -> None:
        out.append(Chunk(section.context, " ".join(units)))

    for unit in section.units:
        size = count(unit)
        if fits([*held, unit], [*sizes, size]):
            held.append(unit)
            sizes.append(size)
            fresh += 1
            continue
        if fresh:
            put(held)
        if not fits([unit], [size]):
            held, sizes, fresh = [], [], 0
            for piece in _pieces(unit, fits):
                put([piece])
            continue
        back = 0
        while back < len(held) and count(" ".join(held[len(held) - back - 1 :])) <= overlap:
            back += 1
        while back and not fits([*held[len(held) - back :], unit], [*sizes[len(held) - back :], size]):
            back -= 1
        held, sizes, fresh = [*held[len(held) - back :], unit], [*sizes[len(sizes) - back :], size], 1
    if fresh:
        put(held)
    return out


def _pieces(unit: str, fits) -> Iterator[str]:
    """Runs of a long unit's words that just fit; a word that does not fit alone stays whole."""
    words = unit.split(" ")
    at = 0
    while at < len(words):
        low, high = 1, len(words) - at
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if fits([" ".join(words[at : at + mid])], [sum(1 for w in words[at : at + mid] if w.strip())]) else (low, mid - 1)
        yield " ".join(words[at : at + low])
        at += low


def chunk(text: str, most: int, overlap: int = 0, count: Count = count_words) -> list[Chunk]:
    return [c for s in sections(parse_markdown(text)) for c in pack(s, most, overlap, count)]


def chunks(docs: DataFrame, most: int, overlap: int = 0, key: str = "doc_id") -> DataFrame:
    """key, chunk_idx, context, content of docs(key, text), by words; row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chunk(t or "", most, overlap) for t in batch.column(1).to_pylist()]
            owner = [i for i, own in enumerate(found) for _ in own]
            flat = [c for own in found for c in own]
            places = [k for own in found for k in range(len(own))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(places, pa.int32()), pa.array([c.context for c in flat], pa.string()), pa.array([c.content for c in flat], pa.string())], names=[key, "chunk_idx", "context", "content"])

    bounded_batches(docs.sparkSession)
    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, chunk_idx int, context string, content string")


def enriched(chunk_rows: DataFrame, find: Callable[[str], list[str]]) -> DataFrame:
    """chunk_rows with entities: the distinct names in context and content, in order of first appearance, blanks collapsed."""

    def names(context: pa.Array, content: pa.Array) -> pa.Array:
        rows = []
        for a, b in zip(context.to_pylist(), content.to_pylist(), strict=True):
            rows.append(list(dict.fromkeys(" ".join(x.split()) for part in (a, b) if part for x in find(part))))
        return pa.array(rows, pa.list_(pa.string()))

    return chunk_rows.withColumn("entities", bounded_udf(names, "array<string>")(F.col("context"), F.col("content")))
