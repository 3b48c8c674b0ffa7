"""Connected components of a distributed table of links, by union-find within partitions and large-star/small-star between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A safety net; the number of rounds is logarithmic in the longest chain.
ROUNDS = 60
#: Links a worker joins before it passes on their forest.
LINKS = 1 << 18
#: So few links (4 MB) are joined by one worker; more go round by round.
LOCAL_LINKS = 1 << 18


def _forest(batches: Iterator[pa.RecordBatch], most: int | None = LINKS) -> Iterator[pa.RecordBatch]:
    """Union-find over the links at hand: (node, root) with root the least node it knows to be linked."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def out() -> Iterator[pa.RecordBatch]:
        rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
        parent.clear()
        if rows:
            a = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["u", "v"]) if most is not None else pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["node", "component"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if most is not None and len(parent) >= most:
            yield from out()
    yield from out()


def components(links: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """(node, component) of every node in links(u, v) that is not the least of its component; component is that least node.

    Each round links every node to the least node seen beside it; it ends when a round changes nothing. All work is
    joins and minima by node: no component, and no list of links, is gathered in one place.
    """
    links = links.select("u", "v")
    if links.count() <= local:
        return cut(links.coalesce(1).mapInArrow(lambda it: _forest(it, None), "node long, component long"))
    links = cut(links.mapInArrow(_forest, "u long, v long").distinct())
    for _ in range(ROUNDS):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = cut(small)
        a, b = (x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (links, after))
        links = after
        if a == b:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
