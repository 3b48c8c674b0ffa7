"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents may belong to several sources. They are summed by pattern (the set of sources they belong to), and a flow
routes each pattern's words to the quotas of its sources. The k-th pass over a pattern costs k, so the cost of
repetition is convex and no pattern is repeated while another of the same source is fresh. Whole passes take every
document of a pattern; the rest of a pass takes documents by a seeded hash of the whole row.

Words are counted once, into a narrow table of pattern, size and hash. Sums over the leading bits of the hash, then
over the bits after them, find for each pattern the hash at which its quota ends; what a row gives is then decided
where it lies, from a broadcast table of one row a pattern. No text moves and no rows are ordered but the few that
share the leading bits of all rounds with the end of a quota.

Defined cases: a null text has no words; a null source is a source of its own, last in order, and so is an empty list of
sources; documents without words are taken once, with 0 words; very long texts count as one row like any other; an
empty table gives no rows. Rows equal in every column share one hash: where a quota ends among them each is taken by a
draw over its place in the table, so that their number is right on average (deviation at most half the square root of
their number). Further columns are kept, whatever their names; those named like a result are replaced.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, cut, table

SEED = 20240229
WEIGHTS = (5, 2, 1)
#: Bits of the selection hash summed by at a time, and rounds: they leave a 16,777,216th of a pattern's rows to order.
LEVEL_BITS, LEVELS = 8, 3
#: Patterns the driver plans for (100,000 take it about 6 s); a mix has as many as its recipe's sources combine to, not
#: as many as documents. More are refused.
PATTERNS = 200_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """share of all sizes by weight; a source over most times its size gets that, and the excess goes to the others by weight."""
    target = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if weights[i] / weight * left > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = weights[i] / weight * left
            break
        for i in over:
            target[i] = float(most * sizes[i])
            left -= target[i]
            open_.discard(i)
    return target


def route(patterns: Sequence[tuple[tuple[int, ...], int]], quotas: Sequence[int], passes: int = 2) -> list[list[dict[int, int]]]:
    """Min-cost flow: for each pattern and pass the words routed to each of its sources.

    patterns: the sources of each pattern and its words. A pattern's cost depends on how often its words are used and
    not on the source, so a flow is cheapest if it is largest within the first pass, then within the first two, and so
    on: augmenting never lessens what a pattern already gives. Each round marks the sources' distances to a pattern
    with room and sends blocking flow along them.
    """
    quota_left = list(quotas)
    given: list[dict[int, int]] = [{s: 0 for s in dict.fromkeys(sources)} for sources, _ in patterns]
    used = [0] * len(patterns)
    members: list[list[int]] = [[] for _ in quotas]
    for p, own in enumerate(given):
        for s in own:
            members[s].append(p)
    by_pass: list[list[int]] = []
    for k in range(1, passes + 1):
        room = [k * total - u for (_, total), u in zip(patterns, used, strict=True)]
        before = list(used)
        # words that are asked for at once go first: what then remains is little
        for p in sorted(range(len(patterns)), key=lambda p: len(given[p])):
            for s in given[p]:
                if amount := min(room[p], quota_left[s]):
                    given[p][s] += amount
                    used[p] += amount
                    room[p] -= amount
                    quota_left[s] -= amount
        while _augment(members, given, used, room, quota_left):
            pass
        by_pass.append([u - b for u, b in zip(used, before, strict=True)])
    flow: list[list[dict[int, int]]] = []
    for p, own in enumerate(given):
        # the sources' words dealt to the passes in order
        rest = dict(own)
        rows = []
        for k in range(passes):
            row, left = {}, by_pass[k][p]
            for s in own:
                row[s] = min(left, rest[s])
                rest[s] -= row[s]
                left -= row[s]
            rows.append(row)
        flow.append(rows)
    return flow


def _augment(members: list[list[int]], given: list[dict[int, int]], used: list[int], room: list[int], quota_left: list[int]) -> bool:
    """One round of blocking flow from sources that lack words to patterns with room; whether anything was sent."""
    far: dict[int, int] = {}
    todo: deque[int] = deque()
    for p, r in enumerate(room):
        if r:
            for s in given[p]:
                if s not in far:
                    far[s] = 0
                    todo.append(s)
    # a source that gives up words of a pattern lets another source of that pattern have them
    passed = [False] * len(given)
    while todo:
        s = todo.popleft()
        for p in members[s]:
            if not passed[p] and given[p][s]:
                passed[p] = True
                for other in given[p]:
                    if other not in far:
                        far[other] = far[s] + 1
                        todo.append(other)
    next_member = [0] * len(members)
    inner: dict[int, int] = {}
    sent = False
    for start in range(len(members)):
        while quota_left[start] and start in far:
            # depth first along falling distances: path of (source, pattern that passes words on, source that gives them up)
            path: list[tuple[int, int, int]] = []
            at, end = start, -1
            while True:
                own, moved = members[at], False
                while next_member[at] < len(own):
                    p = own[next_member[at]]
                    if far[at] == 0 and room[p]:
                        end = p
                        break
                    keys = list(given[p])
                    i = inner.get((at, p), 0) if far[at] else len(keys)
                    while i < len(keys) and not (given[p][keys[i]] and far.get(keys[i], -1) == far[at] - 1 and keys[i] != at):
                        i += 1
                    inner[at, p] = i
                    if i < len(keys):
                        path.append((at, p, keys[i]))
                        at, moved = keys[i], True
                        break
                    next_member[at] += 1
                if end >= 0:
                    break
                if not moved:
                    if not path:
                        break
                    back, p, _ = path.pop()
                    inner[back, p] += 1
                    at = back
            if end < 0:
                break
            amount = min([quota_left[start], room[end], *(given[p][giver] for _, p, giver in path)])
            for taker, p, giver in path:
                given[p][giver] -= amount
                given[p][taker] += amount
            given[end][at] += amount
            used[end] += amount
            room[end] -= amount
            quota_left[start] -= amount
            sent = True
    return sent


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return False
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return all(_hashable(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else True


def row_hash(df: DataFrame) -> Column:
    """A seeded hash of all columns that have one (maps have none)."""
    return F.xxhash64(F.lit(SEED), *[df[f"`{f.name.replace('`', '``')}`"] for f in df.schema.fields if _hashable(f.dataType)])


def canonical(sources: Column) -> Column:
    """A set of sources in order, null last."""
    return F.array_sort(F.array_distinct(F.transform(sources, lambda x: F.struct(x.isNull().alias("none"), x.alias("name")))))


_PLAN = "q array<struct<none:boolean,name:string>>, whole int, rest long, source_size array<bigint>, target array<double>"


@dataclass
class Plan:
    """For each pattern: whole passes, and the hash at which the rest of a pass ends, with the share of rows of that very hash."""

    frame: DataFrame

    def times(self, rows: DataFrame, pattern: str, h: str) -> DataFrame:
        """rows with the struct _plan(times, source_size, target)."""
        joined = rows.join(F.broadcast(self.frame), F.col(pattern).eqNullSafe(F.col("_q")), "left")
        draw = (F.pmod(F.xxhash64(F.lit(SEED), F.monotonically_increasing_id()), F.lit(1 << 30)) / float(1 << 30))
        more = F.when(F.col("_end").isNull(), F.col("_all").cast("int")).otherwise(((F.col(h) < F.col("_end")) | ((F.col(h) == F.col("_end")) & (draw < F.col("_share")))).cast("int"))
        return joined.withColumn("_plan", F.struct((F.col("_whole") + more).alias("times"), F.col("_sizes").alias("source_size"), F.col("_targets").alias("target"))).drop("_q", "_whole", "_all", "_end", "_share", "_sizes", "_targets")


def plan(narrow: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, passes: int = 2) -> Plan:
    """The plan for narrow(pattern, size, h), read a few times."""
    spark = narrow.sparkSession
    found = narrow.groupBy("pattern").agg(F.sum("size").alias("words")).limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns")
    name = lambda x: (x.none, x.name or "")
    found = sorted(found, key=lambda r: [name(x) for x in r.pattern or ()])
    place = {x: i for i, x in enumerate(sorted({name(x) for r in found for x in r.pattern or ()}))}
    patterns = [(tuple(place[name(x)] for x in r.pattern or ()), int(r.words or 0)) for r in found]
    # a document of several sources may be used for any of them, so each counts its words in full
    size_of = [0] * len(place)
    for sources, total in patterns:
        for s in sources:
            size_of[s] += total
    targets = source_targets(size_of, [weights[i % len(weights)] for i in range(len(place))], share, passes)
    flow = route(patterns, [round(t) for t in targets], passes)
    plans = []
    for r, (sources, total), f in zip(found, patterns, flow, strict=True):
        amount = sum(x for k in f for x in k.values())
        whole = min(passes, amount // total) if total else 1
        plans.append((r.pattern, int(whole), int(amount - whole * total) if total else 0, [size_of[i] for i in sources], [targets[i] for i in sources]))
    quotas = cut(spark.createDataFrame(plans, _PLAN))
    return Plan(cut(_ends(narrow, quotas)))


def _ends(narrow: DataFrame, quotas: DataFrame) -> DataFrame:
    """The end of each pattern's rest, narrowed by LEVEL_BITS of the hash in each round and found among the hashes that remain."""
    wanted = F.broadcast(quotas.where("rest > 0").select("q", "rest"))
    left = narrow.join(wanted, F.col("pattern").eqNullSafe(F.col("q"))).select("pattern", "size", "h", "rest")
    for level in range(1, LEVELS + 1):
        shift = 64 - LEVEL_BITS * level
        bins = left.groupBy("pattern", F.shiftright("h", shift).alias("bin")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("bin"))
        ends = bins.withColumn("upto", upto).where("upto - words < rest and rest <= upto")
        ends = cut(ends.select(F.col("pattern").alias("p"), F.col("bin").alias("end"), (F.col("rest") - F.col("upto") + F.col("words")).alias("over")))
        left = left.join(F.broadcast(ends), F.col("pattern").eqNullSafe(F.col("p")) & (F.shiftright("h", shift) == F.col("end"))).select("pattern", "size", "h", F.col("over").alias("rest"))
    hashes = left.groupBy("pattern", "h").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("h"))
    last = hashes.withColumn("upto", upto).where("upto - words < rest and rest <= upto")
    part = (F.col("rest") - F.col("upto") + F.col("words")) / F.col("words")
    last = last.select(F.col("pattern").alias("p"), F.col("h").alias("_end"), F.when(F.col("n") == 1, F.round(part)).otherwise(part).alias("_share"))
    # without an end the rest is nothing
    out = quotas.join(F.broadcast(last), F.col("q").eqNullSafe(F.col("p")), "left")
    return out.select(F.col("q").alias("_q"), F.col("whole").alias("_whole"), (F.col("rest") > 0).alias("_all"), "_end", "_share", F.col("source_size").alias("_sizes"), F.col("target").alias("_targets"))


def mix(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, passes: int = 2) -> DataFrame:
    """sized(size, sources array, ...) with source_size and target (arrays, one for each source), times and taken."""
    kept = [c for c in sized.columns if c not in ("source_size", "target", "times", "taken")]
    named = sized.select(*[F.col(f"`{c}`") for c in kept])
    rows = named.select(F.struct("*").alias("_row"), canonical(F.col("sources")).alias("_pattern"), row_hash(named).alias("_h"))
    narrow = cut(rows.select(F.col("_pattern").alias("pattern"), F.col("_row.size").cast("long").alias("size"), F.col("_h").alias("h")))
    out = plan(narrow, weights, share, passes).times(rows, "_pattern", "_h")
    return out.select("_row.*", F.col("_plan.source_size").alias("source_size"), F.col("_plan.target").alias("target"), F.col("_plan.times").alias("times"), (F.col("_row.size") * F.col("_plan.times")).alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # words are counted once; the passes after it read narrow columns
    sized = cut(docs.select("doc_id", words(F.col("text")).alias("size"), F.array("source").alias("sources"), F.xxhash64("text").alias("digest")))
    return mix(sized).select("doc_id", "size", F.element_at("source_size", 1).alias("source_size"), F.element_at("target", 1).alias("target"), "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it: not at all, once or twice. Texts are read twice and not moved."""
    rows = docs.select(F.struct("*").alias("_row"), canonical(F.array("source")).alias("_pattern"), row_hash(docs).alias("_h"))
    narrow = cut(docs.select(canonical(F.array("source")).alias("pattern"), words(F.col("text")).alias("size"), row_hash(docs).alias("h")))
    mixed = plan(narrow).times(rows, "_pattern", "_h")
    return mixed.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_plan.times"))).alias("_copy")).select("_row.*")
