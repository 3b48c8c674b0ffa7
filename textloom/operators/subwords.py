"""Subword tokenizers over a given vocabulary: longest piece, merges by rank, best-scored path."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.unicode import bounded_udf


def longest_piece(word: str, vocab: Mapping[str, int] | set[str], prefix: str = "##", unknown: str = "[UNK]", most: int = 100) -> list[str]:
    """Greedy: the longest piece of the vocabulary each time; a word with a part that has none is unknown."""
    if len(word) > most:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        piece = next((p for end in range(len(word), at, -1) if (p := (prefix if at else "") + word[at:end]) in vocab), None)
        if piece is None:
            return [unknown]
        out.append(piece)
        at += len(piece) - (len(prefix) if at else 0)
    return out


def merged(symbols: Sequence[str], ranks: Mapping[tuple[str, str], int]) -> list[str]:
    """Byte-pair merges: the pair of least rank is joined wherever it stands, until no pair is known."""
    out = list(symbols)
    while len(out) > 1:
        pair = min(zip(out, out[1:], strict=False), key=lambda p: ranks.get(p, math.inf))
        if pair not in ranks:
            break
        joined, i = [], 0
        while i < len(out):
            if i + 1 < len(out) and (out[i], out[i + 1]) == pair:
                joined.append(out[i] + out[i + 1])
                i += 2
            else:
                joined.append(out[i])
                i += 1
        out = joined
    return out


def best_path(text: str, scores: Mapping[str, float], unknown: float = -100.0, longest: int = 32) -> list[str]:
    """The segmentation with the best sum of scores; a character without a piece costs unknown, neighbours of them fuse."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        options = [(best[a][0] + scores[text[a:end]], a) for a in range(max(0, end - longest), end) if text[a:end] in scores]
        best.append(max([*options, (best[end - 1][0] + unknown, end - 1)], key=lambda x: x[0]))
    cuts, at = [], len(text)
    while at:
        cuts.append((best[at][1], at))
        at = best[at][1]
    out: list[str] = []
    open_ = False
    for a, b in reversed(cuts):
        known = text[a:b] in scores
        if not known and open_:
            out[-1] += text[a:b]
        else:
            out.append(text[a:b])
        open_ = not known
    return out


def word_places(words: Sequence[str], pieces) -> tuple[list[str], list[tuple[int, int]]]:
    """All pieces of the words, and each word's half-open run of them; a blank word counts as `-`."""
    out, places = [], []
    for w in words:
        own = pieces(w if w.strip() else "-")
        places.append((len(out), len(out) + len(own)))
        out += own
    return out, places


def piece_counter(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_words, n_pieces: longest-piece subwords under the size most frequent word beginnings (to five letters)."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    heads = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("w"), F.lit(5))), lambda i: F.substring("w", F.lit(1), i))).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n"))
    top = {r.p for r in heads.orderBy(F.desc("n"), "p").limit(size).collect()}
    vocab = docs.sparkSession.sparkContext.broadcast(top | {"##" + p for p in top})

    def pieces(lists: pa.Array) -> pa.Array:
        memo: dict[str, int] = {}
        out = []
        for x in lists:
            total = 0
            for w in x.as_py() or ():
                if w not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[w] = len(longest_piece(w, vocab.value))
                total += memo[w]
            out.append(total)
        return pa.array(out, pa.int32())

    listed = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("ws"))
    return listed.select("doc_id", F.size("ws").alias("n_words"), bounded_udf(pieces, "int")(F.col("ws")).alias("n_pieces"))
