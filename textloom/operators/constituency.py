"""A shift-reduce machine for constituency trees: which transitions are legal, and what they build."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

from ..functions.unicode import arrow_values
from ..sources.trees import Tree, parse, write

SHIFT, CLOSE = "shift", "close"
#: Unary nodes in a row that are still legal.
UNARIES = 4


@dataclass
class _Mark:
    label: str


@dataclass
class Parser:
    """in_order: a node opens after its first child, else before it. words: (word, part of speech)."""

    words: Sequence[tuple[str, str]]
    in_order: bool = True
    stack: list[Tree | _Mark] = field(default_factory=list)
    at: int = 0
    steps: int = 0

    def opened(self) -> int:
        return sum(isinstance(x, _Mark) for x in self.stack)

    def unaries(self) -> int:
        node, n = (self.stack[-1], 0) if self.stack and isinstance(self.stack[-1], Tree) else (None, 0)
        while node is not None and len(node.children) == 1 and node.children[0].children:
            node, n = node.children[0], n + 1
        return n

    def done(self) -> bool:
        return self.at == len(self.words) and len(self.stack) == 1 and isinstance(self.stack[0], Tree) and bool(self.stack[0].children) and self.stack[0].label == "ROOT"

    def legal(self, step: str) -> bool:
        top_is_mark = bool(self.stack) and isinstance(self.stack[-1], _Mark)
        if self.done():
            return False
        if step == SHIFT:
            if self.at == len(self.words):
                return False
            return not self.stack or self.opened() > 0 if self.in_order else self.opened() > 0
        if step == CLOSE:
            if not self.opened():
                return False
            if self.in_order:
                return self.unaries() < UNARIES or not top_is_mark
            return not top_is_mark
        if self.in_order:
            if not self.stack or top_is_mark:
                return False
            # a further node around a finished tree only while the chain of single children is short
            return self.unaries() < UNARIES and (step != "ROOT" or self.at == len(self.words) and self.opened() == 0)
        if step == "ROOT":
            return not self.stack
        return self.at < len(self.words) and bool(self.stack)

    def apply(self, step: str) -> None:
        if not self.legal(step):
            raise ValueError(f"{step} is not legal here")
        self.steps += 1
        if step == SHIFT:
            word, tag = self.words[self.at]
            self.stack.append(Tree(tag, [Tree(word)]))
            self.at += 1
        elif step == CLOSE:
            children = []
            while not isinstance(self.stack[-1], _Mark):
                children.append(self.stack.pop())
            label = self.stack.pop().label
            if self.in_order:
                children.append(self.stack.pop())
            self.stack.append(Tree(label, children[::-1]))
        else:
            self.stack.append(_Mark(step))

    def run(self, scorer: Callable[[Parser], np.ndarray], steps: Sequence[str]) -> Tree | None:
        """The tree of the best legal step each time; None when no step is legal or they are too many."""
        while not self.done():
            order = np.argsort(-scorer(self), kind="stable")
            step = next((steps[i] for i in order if self.legal(steps[i])), None)
            if step is None or self.steps >= (len(self.words) + 2) * 20:
                return None
            self.apply(step)
        return self.stack[0]


def oracle(tree: Tree, in_order: bool = True) -> list[str]:
    """The transitions that build a tree whose leaves hang from their parts of speech."""
    if len(tree.children) == 1 and not tree.children[0].children:
        return [SHIFT]
    parts = [oracle(c, in_order) for c in tree.children]
    if in_order:
        return [*parts[0], tree.label, *(x for p in parts[1:] for x in p), CLOSE]
    return [tree.label, *(x for p in parts for x in p), CLOSE]


def build(words: Sequence[tuple[str, str]], steps: Sequence[str], in_order: bool = True) -> Tree:
    p = Parser(words, in_order)
    for s in steps:
        p.apply(s)
    return p.stack[0]


def transitions(in_order: bool = True):
    """An Arrow UDF: the transitions (array<string>) that build a bracketed tree."""
    return arrow_values(lambda text: oracle(parse(text), in_order), "array<string>")


def built(in_order: bool = True):
    """An Arrow UDF: the bracketed tree of struct<words:array<struct<word,tag>>,steps:array<string>>; null where a step is not legal."""

    def run(row: dict) -> str | None:
        try:
            return write(build([tuple(w.values()) for w in row["words"]], row["steps"], in_order))
        except ValueError:
            return None

    return arrow_values(run, "string")
