"""Bracketed constituency trees."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import functions as F

_PIECE = re.compile(r"\s*([()]|[^\s()]+)")


@dataclass
class Tree:
    label: str
    children: list[Tree] = field(default_factory=list)

    def leaves(self) -> list[str]:
        return [self.label] if not self.children else [x for c in self.children for x in c.leaves()]


def parse(text: str) -> Tree:
    """A tree from its brackets; anything unbalanced, unlabelled or left over raises ValueError."""
    root: Tree | None = None
    stack: list[Tree] = []
    pos, end, opened = 0, len(text.rstrip()), False
    while pos < end:
        m = _PIECE.match(text, pos)
        piece, pos = m[1], m.end()
        if root is not None and not stack:
            raise ValueError(f"text after the tree: {text}")
        if piece == "(":
            if opened:
                raise ValueError(f"a bracket without a label: {text}")
            opened = True
        elif piece == ")":
            if opened or not stack:
                raise ValueError(f"unbalanced: {text}")
            stack.pop()
        else:
            node = Tree(piece)
            if stack:
                stack[-1].children.append(node)
            else:
                root = node
            if opened:
                stack.append(node)
                opened = False
    if root is None or stack or opened:
        raise ValueError(f"unbalanced: {text}")
    return root


def write(tree: Tree) -> str:
    label = tree.label.replace("(", "-LRB-").replace(")", "-RRB-")
    return f"({' '.join([label, *(write(c) for c in tree.children)])})" if tree.children else label


@F.udtf(returnType="node_id int, parent_id int, label string, depth int, first_leaf int, last_leaf int")
class TreeNodes:
    """tree_nodes(text): one row a node, in preorder; leaves count from 0."""

    def eval(self, text: str):
        if text is None:
            return
        rows: list[list] = []
        leaf = 0

        def walk(t: Tree, parent: int | None, depth: int) -> None:
            nonlocal leaf
            row = [len(rows), parent, t.label, depth, leaf, leaf]
            rows.append(row)
            if t.children:
                for c in t.children:
                    walk(c, row[0], depth + 1)
                row[5] = leaf - 1
            else:
                leaf += 1

        walk(parse(text), None, 0)
        for r in rows:
            yield tuple(r)
