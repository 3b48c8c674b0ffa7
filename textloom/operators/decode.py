"""Decoders over scores: exact given the scores, whatever model made them."""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.unicode import arrow_values
from ..session import bounded_batches
from .annotate import Scorer


def viterbi(scores: np.ndarray, transitions: np.ndarray) -> list[int]:
    """The best path through scores[n, tags] with transitions[from, to]; ties go to the lowest tag."""
    n = len(scores)
    if not n:
        return []
    total, back = scores[0].astype(np.float32), np.zeros((n, scores.shape[1]), np.int64)
    for i in range(1, n):
        step = total[:, None] + transitions
        back[i] = step.argmax(axis=0)
        total = step[back[i], np.arange(scores.shape[1])] + scores[i]
    path = [int(total.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    return path[::-1]


def repair_tags(tags: Sequence[str]) -> list[str]:
    """BIOES tags whose pieces fit together: spans open with B or S and close with E or S.

    First every tag is mended against the mended one before it, then ends against what follows. A change of type
    inside a span starts a new span.
    """
    out: list[str] = []
    for tag in tags:
        mark, kind = tag[:2], tag[2:]
        before = out[-1] if out else "O"
        inside = before[:2] in ("B-", "I-") and before[2:] == kind
        if mark in ("I-", "E-") and not inside:
            mark = "B-" if mark == "I-" else "S-"
        out.append(mark + kind if tag != "O" else "O")
    for i, tag in enumerate(out):
        after = out[i + 1] if i + 1 < len(out) else "O"
        goes_on = after[:2] in ("I-", "E-") and after[2:] == tag[2:]
        if tag[:2] == "B-" and not goes_on:
            out[i] = "S-" + tag[2:]
        elif tag[:2] == "I-" and not goes_on:
            out[i] = "E-" + tag[2:]
    return out


def arborescence(scores: np.ndarray) -> list[int]:
    """Chu-Liu/Edmonds: the head of each node in the maximum spanning arborescence from node 0; scores[dependent, head].

    Ties go to the first head. heads[0] is 0.
    """
    n = len(scores)
    weights = scores.astype(np.float64).copy()
    np.fill_diagonal(weights, -np.inf)
    weights[0, :] = -np.inf
    heads = weights.argmax(axis=1)
    heads[0] = 0
    cycle = _cycle(heads)
    if cycle is None:
        return heads.tolist()
    inside = np.zeros(n, bool)
    inside[cycle] = True
    outer = np.flatnonzero(~inside)
    place = {int(v): i for i, v in enumerate(outer)}
    k = len(outer)
    merged = np.full((k + 1, k + 1), -np.inf)
    merged[:k, :k] = weights[np.ix_(outer, outer)]
    # into the cycle: what breaking each of its arcs costs; out of it: the best of its nodes
    gain = weights[np.ix_(cycle, outer)] - weights[cycle, heads[cycle]][:, None]
    enter = gain.argmax(axis=0)
    merged[k, :k] = gain[enter, np.arange(k)]
    leave = weights[np.ix_(outer, cycle)].argmax(axis=1)
    merged[:k, k] = weights[np.ix_(outer, cycle)][np.arange(k), leave]
    found = arborescence(merged)
    out = heads.copy()
    for v in outer:
        if v:
            h = found[place[int(v)]]
            out[v] = cycle[leave[place[int(v)]]] if h == k else outer[h]
    broken = cycle[enter[found[k]]]
    out[broken] = outer[found[k]]
    return out.tolist()


def _cycle(heads: np.ndarray) -> np.ndarray | None:
    state = np.zeros(len(heads), np.int64)
    state[0] = 2
    for v in range(1, len(heads)):
        path = []
        while state[v] == 0:
            state[v] = 1
            path.append(v)
            v = int(heads[v])
        if state[v] == 1:
            return np.array(path[path.index(v) :])
        for x in path:
            state[x] = 2
    return None


def one_root(scores: np.ndarray) -> list[int]:
    """The best arborescence in which exactly one node hangs from node 0: each candidate root is tried if the free one has more."""
    heads = arborescence(scores)
    if sum(h == 0 for h in heads[1:]) <= 1:
        return heads
    best, best_total = heads, -np.inf
    for root in range(1, len(scores)):
        if not np.isfinite(scores[root, 0]):
            continue
        own = scores.astype(np.float64).copy()
        own[1:, 0] = -np.inf
        own[root, 0] = scores[root, 0]
        own[root, 1:] = -np.inf
        found = arborescence(own)
        total = sum(own[i, h] for i, h in enumerate(found) if i)
        if total > best_total:
            best, best_total = found, total
    return best


#: Groups of relations of which a head keeps one dependent.
ONCE = {"subj": ("nsubj", "nsubj:pass", "csubj", "csubj:pass"), "subj_outer": ("nsubj:outer", "csubj:outer"), "obj": ("obj",)}


def group_of(relation: str) -> str | None:
    return next((g for g, own in ONCE.items() if relation in own), None)


def constrained(arcs: np.ndarray, labels: np.ndarray, names: Sequence[str], rounds: int = 5) -> tuple[list[int], list[str]]:
    """Heads and relations from arcs[dependent, head] and labels[dependent, head, relation].

    In a few rounds, where a head has several dependents of one group, all but the best lose that group at that head;
    the tree is decoded anew. Of the rounds' trees without such a clash the best total wins, else the first.
    """
    labels = labels.astype(np.float64).copy()
    first, best, best_total = None, None, -np.inf
    for _ in range(rounds):
        whole = arcs + labels.max(axis=2)
        heads = one_root(whole)
        picked = [int(labels[i, h].argmax()) for i, h in enumerate(heads)]
        relations = [names[p] for p in picked]
        first = first or (heads, relations)
        by: dict[tuple[int, str], list[int]] = {}
        for i, h in enumerate(heads):
            if i and (g := group_of(relations[i])):
                by.setdefault((h, g), []).append(i)
        clashes = {k: v for k, v in by.items() if len(v) > 1}
        if not clashes:
            total = sum(whole[i, h] for i, h in enumerate(heads) if i)
            if total > best_total:
                best, best_total = (heads, relations), total
            break
        for (h, g), own in clashes.items():
            keep = max(own, key=lambda i: (labels[i, h, picked[i]], -i))
            for i in own:
                if i != keep:
                    labels[i, h, [j for j, x in enumerate(names) if group_of(x) == g]] = -1e9
    return best or first


def distance_bucket(d: int) -> int:
    """0 to 3 for distances 1 to 4, then by doubling up to 8."""
    return d - 1 if d < 5 else min(int(math.log2(d)), 6) + 2


def distance_buckets(d: Column) -> Column:
    """distance_bucket as a column."""
    doubled = F.floor(F.log2(F.greatest(d, F.lit(1)).cast("double"))).cast("int")
    return F.when(d < 5, d - 1).otherwise(F.least(doubled, F.lit(6)) + 2).cast("int")


def top_k(scores: Sequence[float], k: int) -> list[int]:
    """The places of the k largest, NaN above all, ties by place."""
    return sorted(range(len(scores)), key=lambda i: (not math.isnan(scores[i]), -scores[i] if not math.isnan(scores[i]) else 0, i))[:k]


def beam(start: Hashable, step: Callable[[tuple], Sequence[tuple[Hashable, float]]], end: Hashable, width: int = 5, most: int = 50, source: Sequence[Hashable] = (), copy: Callable[[tuple], tuple[float, Sequence[float]]] | None = None) -> tuple[list, float]:
    """The best sequence by beam search; step gives each next symbol and its log-probability after a prefix.

    With copy a symbol may also be copied from source: copy gives, after a prefix, the probability of copying and the
    attention to each place of source. A symbol's probability is then the sum of both ways to it.
    """
    if copy is not None:
        plain = step

        def step(prefix: tuple) -> Sequence[tuple[Hashable, float]]:
            gate, attention = copy(prefix)
            total: dict[Hashable, float] = {x: (1 - gate) * math.exp(p) for x, p in plain(prefix)}
            for x, a in zip(source, attention, strict=True):
                total[x] = total.get(x, 0.0) + gate * a
            return [(x, math.log(p)) for x, p in total.items() if p > 0]

    open_: list[tuple[float, tuple]] = [(0.0, (start,))]
    done: list[tuple[float, tuple]] = []
    for _ in range(most):
        after = sorted(((s + p, (*seq, x)) for s, seq in open_ for x, p in step(seq)), key=lambda c: -c[0])[:width]
        done += [c for c in after if c[1][-1] == end]
        open_ = [c for c in after if c[1][-1] != end]
        if not open_ or len(done) >= width:
            break
    score, seq = max(done or open_, key=lambda c: c[0] / len(c[1]))
    return [x for x in seq[1:] if x != end], score


def tag_paths(transitions: np.ndarray):
    """An Arrow UDF: the best path (array<int>) of a sentence's scores (array<array<double>>) under transitions[from, to]."""
    return arrow_values(lambda scores: viterbi(np.array(scores, np.float64).reshape(len(scores), -1), transitions), "array<int>")


#: Arrow UDFs: a sentence's tags repaired, and the heads of the best tree with one root over scores[dependent, head].
repaired = arrow_values(repair_tags, "array<string>")
tree_heads = arrow_values(lambda scores: one_root(np.array(scores, np.float64)), "array<int>")


def top_places(k: int):
    """An Arrow UDF: the places of the k largest of an array of scores."""
    return arrow_values(lambda scores: top_k([math.nan if x is None else x for x in scores], k), "array<int>")


def constrained_trees(names: Sequence[str]):
    """An Arrow UDF: heads and relations by constrained() of arcs and labels (struct of the two arrays)."""

    def decode(row: dict) -> dict:
        heads, relations = constrained(np.array(row["arcs"], np.float64), np.array(row["labels"], np.float64), names)
        return {"heads": heads, "relations": relations}

    return arrow_values(decode, "struct<heads:array<int>,relations:array<string>>")


def scored(sentences: DataFrame, scorer: Scorer, transitions: np.ndarray, tags: Sequence[str], column: str = "words") -> DataFrame:
    """sentences(words array<string>, ...) with tags: the best path under any scorer's matrices, one [words, tags] for each sentence.

    The scorer travels to the workers as it is, is loaded once in each task and sees batches of sentences.
    """
    kind = sentences.schema
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields if f.name != "tags"), "tags array<string>"])
    place = [f.name for f in kind.fields if f.name != "tags"]

    def run(batches):
        scorer.load()
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(column)).to_pylist()
            paths = [[tags[t] for t in viterbi(m, transitions)] if w else [] for w, m in zip(own, scorer.score([w or [] for w in own]), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(place))), pa.array(paths, pa.list_(pa.string()))], names=[*place, "tags"])

    bounded_batches(sentences.sparkSession)
    return sentences.select(*place).mapInArrow(run, out)


def windowed(scores: Callable[[Sequence], np.ndarray], items: Sequence, size: int, overlap: int) -> np.ndarray:
    """Scores of a long sequence from runs of at most size items; of overlapping runs each item takes the one that it lies deeper in."""
    if len(items) <= size:
        return scores(items)
    out, at = None, 0
    while True:
        part = scores(items[at : at + size])
        if out is None:
            out = np.zeros((len(items), *part.shape[1:]), part.dtype)
        begin = at + overlap // 2 if at else 0
        out[begin : at + len(part)] = part[begin - at :]
        if at + size >= len(items):
            return out
        at += size - overlap
