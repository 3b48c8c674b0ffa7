"""Coreference: chains of mentions, their marks on words, and the steps from antecedent links to chains."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.unicode import arrow_values, bounded_udf
from ..sources.documents import Sentence, Word, documents_of
from .spans import covered


@dataclass(frozen=True)
class Mention:
    """Words start to end (from 0, end exclusive) of a sentence; with empty_index the empty word after word start."""

    sentence: int
    start: int
    end: int
    empty_index: int | None = None


@dataclass(frozen=True)
class Chain:
    index: int
    mentions: tuple[Mention, ...]
    text: str
    representative: int | None


_MARK = re.compile(r"(?:(unit|start|end|middle)-)?(repr-)?id(\d+)")


def all_words(s: Sentence) -> list[Word]:
    return [w for _, w in s.in_order()]


def mention_text(sentence: Sentence, m: Mention) -> str:
    """The text of the mention's words; a token that it covers whole counts as written."""
    if m.empty_index is not None:
        return next(w.text for w in sentence.empty if (w.id, w.empty_index) == (m.start, m.empty_index))
    out, at = [], 0
    for t in sentence.tokens:
        a, b = at, at + len(t.words)
        at = b
        if m.start <= a and b <= m.end:
            out.append(t.text)
        else:
            out += [w.text for i, w in enumerate(t.words, a) if m.start <= i < m.end]
    return " ".join(out)


def attach(sentences: list[Sentence], chains: Iterable[Chain]) -> None:
    """Sets the words' marks. A mention outside the document raises ValueError and leaves it as it is."""
    marks: dict[int, list[str]] = {}
    for c in chains:
        for k, m in enumerate(c.mentions):
            if not 0 <= m.sentence < len(sentences):
                raise ValueError(f"no sentence {m.sentence}")
            s = sentences[m.sentence]
            words = s.words()
            if m.empty_index is not None:
                covered = [w for w in s.empty if (w.id, w.empty_index) == (m.start, m.empty_index)]
            else:
                covered = words[m.start : m.end] if 0 <= m.start < m.end <= len(words) else []
            if not covered:
                raise ValueError(f"no words at {m}")
            for i, w in enumerate(covered):
                first, final = i == 0, i == len(covered) - 1
                place = "unit-" if first and final else "start-" if first else "end-" if final else ""
                marks.setdefault(id(w), []).append(f"{place}{'repr-' if k == c.representative else ''}id{c.index}")
    for s in sentences:
        for w in all_words(s):
            w.coref = ",".join(marks.get(id(w), [])) or None


def rebuild(sentences: list[Sentence]) -> list[Chain]:
    """The chains that the words' marks say; an end without a start, an open start or an unknown mark raises ValueError."""
    found: dict[int, list[tuple[Mention, bool]]] = {}
    for n, s in enumerate(sentences):
        open_: dict[int, list[tuple[int, bool]]] = {}
        at = 0
        for w in all_words(s):
            is_empty = w.empty_index is not None
            for mark in (w.coref or "").split(",") if w.coref else ():
                m = _MARK.fullmatch(mark)
                if not m:
                    raise ValueError(f"not a mark: {mark}")
                index, whole = int(m[3]), bool(m[2])
                if m[1] == "unit":
                    span = Mention(n, w.id, w.id, w.empty_index) if is_empty else Mention(n, at, at + 1)
                    found.setdefault(index, []).append((span, whole))
                elif m[1] == "start":
                    open_.setdefault(index, []).append((at, whole))
                elif m[1] == "end":
                    if not open_.get(index):
                        raise ValueError(f"an end without a start: {mark}")
                    # of nested mentions of one chain the representative's marks close its own start
                    k = next((i for i in reversed(range(len(open_[index]))) if open_[index][i][1] == whole), len(open_[index]) - 1)
                    start, _ = open_[index].pop(k)
                    found.setdefault(index, []).append((Mention(n, start, at + 1), whole))
            at += not is_empty
        if any(open_.values()):
            raise ValueError("a start without an end")
    out = []
    for index in sorted(found):
        own = sorted(found[index], key=lambda x: (x[0].sentence, x[0].start, x[0].end, x[0].empty_index is not None))
        head = next((i for i, (m, whole) in enumerate(own) if whole), None)
        text = mention_text(sentences[own[head][0].sentence], own[head][0]) if head is not None else "_"
        out.append(Chain(index, tuple(m for m, _ in own), text, head))
    return out


def components(links: Iterable[tuple[int, int]], nodes: Iterable[int]) -> list[list[int]]:
    """Connected components of antecedent links within one document, in order."""
    parent = {n: n for n in nodes}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    by: dict[int, list[int]] = {}
    for n in sorted(parent):
        by.setdefault(find(n), []).append(n)
    return sorted(by.values())


def representative(mentions: list[Mention], proper: list[int]) -> int | None:
    """The longest mention, then the one with most proper nouns, then the first; never an empty word."""
    real = [i for i, m in enumerate(mentions) if m.empty_index is None]
    return max(real, key=lambda i: (mentions[i].end - mentions[i].start, proper[i], -i), default=None)


def windows(sizes: list[int], most: int = 510) -> list[tuple[int, int]]:
    """Half-open runs of subwords of at most most, ending where a sentence ends; a longer sentence is cut hard."""
    ends, at = [], 0
    for s in sizes:
        at += s
        ends.append(at)
    out, start = [], 0
    while start < at:
        fit = [e for e in ends if start < e <= start + most]
        stop = fit[-1] if fit else start + most
        out.append((start, stop))
        start = stop
    return out


def representatives(mentions: DataFrame) -> DataFrame:
    """The representative of each chain of mentions(doc_id, chain, pos, length, n_propn, empty_idx, ...)."""
    w = Window.partitionBy("doc_id", "chain").orderBy(F.desc("length"), F.desc("n_propn"), "pos")
    return mentions.where("empty_idx is null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def exact_name_chains(entities: DataFrame) -> DataFrame:
    """A baseline scorer: entities of one document with equal lower-case text and type share a chain."""
    key = F.struct("type", F.lower("text").alias("name"))
    first = entities.groupBy("doc_id", key.alias("k")).agg(F.min("start_char").alias("first"), F.count("*").alias("n")).where("n > 1")
    numbered = first.withColumn("chain", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first", "k")) - 1)
    return entities.withColumn("k", key).join(numbered.select("doc_id", "k", "chain"), ["doc_id", "k"]).drop("k")


def attached(words: DataFrame, mentions: DataFrame, keys: list[str]) -> DataFrame:
    """words(keys, word_id, ...) with coref: the marks of mentions(keys, chain, start, end, is_representative), words start to end (from 0, end exclusive).

    An interval join within a sentence, in the JVM: each mention marks its first, last and inner words.
    """
    spans = mentions.select(*keys, "chain", F.col("start").alias("_from"), F.col("end").alias("_to"), "is_representative", "start", "end")
    at = words.select(*keys, "word_id", (F.col("word_id") - 1).alias("_at"))
    marked = covered(at, spans, keys, "_at")
    first, last = F.col("_at") == F.col("start"), F.col("_at") == F.col("end") - 1
    place = F.when(first & last, "unit-").when(first, "start-").when(last, "end-").otherwise("")
    mark = F.concat(place, F.when(F.col("is_representative"), "repr-").otherwise(""), F.lit("id"), F.col("chain"))
    joined = marked.groupBy(*keys, "word_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chain", "start", "end", mark.alias("m")))), lambda x: x["m"]), ",").alias("coref"))
    return words.drop("coref").join(joined, [*keys, "word_id"], "left")


_CHAINS = pa.list_(pa.struct([("chain", pa.int32()), ("representative_text", pa.string()), ("sentence", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("is_representative", pa.bool_())]))


def chains_of(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chain, representative_text, sentence, start, end, is_representative of every mention that the words' marks of parsed(key, sent_idx, sentence) say."""

    def one(sentences: list[Sentence]) -> list[dict]:
        found = rebuild(sentences)
        return [{"chain": c.index, "representative_text": c.text, "sentence": m.sentence, "start": m.start, "end": m.end, "is_representative": i == c.representative} for c in found for i, m in enumerate(c.mentions)]

    def run(rows: pa.Array) -> pa.Array:
        return pa.array((one(own) for own in documents_of(rows)), _CHAINS)

    chains = bounded_udf(run, "array<struct<chain:int,representative_text:string,sentence:int,start:int,end:int,is_representative:boolean>>")
    grouped = parsed.groupBy(key).agg(F.collect_list(F.struct("sent_idx", "sentence")).alias("_s"))
    return grouped.select(key, F.explode(chains(F.col("_s"))).alias("_c")).select(key, "_c.*")


def size_windows(most: int = 510):
    """An Arrow UDF: the half-open windows of an array of sentence sizes."""
    return arrow_values(lambda sizes: [{"start": a, "end": b} for a, b in windows(sizes, most)], "array<struct<start:int,end:int>>")
