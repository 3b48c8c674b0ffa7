"""Near-duplicate documents: SuperMinHash, banding, exact verification, components.

1. Every whole text becomes its set of word shingles; a worker writes only the set's size, a 128-bit digest, the
   signature and the band keys.
2. Equal sets meet by digest in a partially aggregated minimum, so a group of any number of copies is one
   representative from here on.
3. Representatives that share a band key form a bucket. A bucket links its members to one centre and not to each
   other; links that full sets confirm contract the graph. Buckets that still hold several components repeat this with
   another centre. Members of what then remains are compared only if they share one of their rarest shingles, so many
   that two sets that can be linked must have one of them in common: no link between different components is left out.
   A pair is formed only if the shingles that each has in common with anyone suffice for a link, less those that its
   sketch (a bit for each hash of a shingle) proves to be missing in the other.
4. Components come from a distributed union-find.

Joins whose keys may be hot (a bucket, a centre, a digest, a shingle) are salted where a key has many rows.

Defined cases: a text without words (or null) has an empty set and is linked with nothing; rows with equal doc_id are
one document, and of its texts one stands for it in links; a row with null doc_id takes part in no link and its
component is null; very long texts are hashed piece by piece and whole; only doc_id and text are read, so no further
column clashes; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shingles as S
from .common import bounded_batches, cut, salted_join
from .components import components
from .superminhash import signatures

SLOTS, BAND = 96, 4
STAR_ROUNDS = 2
#: 64-bit words of a sketch.
SKETCH = 16
#: Ids of documents to verify that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def _sets(array: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for at, hashes, begins in S.words(array):
        yield at, [np.unique(x) for x in S.block_shingles(hashes, begins, width)]


def _digest(batches: Iterator[pa.RecordBatch], width: int, slots: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for at, sets in _sets(batch.column(1), width):
            sizes = np.array([len(x) for x in sets], np.int64)
            begins = np.concatenate(([0], np.cumsum(sizes)))
            flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
            sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(S.mix(flat ^ np.uint64(k)), dtype=np.uint64))) for k in (0x51ED270B, 0x2545F4914F6CDD1D)]
            h1, h2 = ((s[begins[1:]] - s[begins[:-1]]).view(np.int64) for s in sums)
            sig = signatures(flat, begins, slots)
            short = (sig & 0x7FFFFFFF).astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(at, len(sets)),
                    pa.array(sizes),
                    pa.array(h1),
                    pa.array(h2),
                    pa.array([row.tobytes() for row in short], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "h1", "h2", "signature"],
            )


def digests(docs: DataFrame, width: int = 5, slots: int = SLOTS) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (the set's digest), signature (four bytes a slot) of each row of docs(doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _digest(it, width, slots), "doc_id long, n_shingles long, h1 long, h2 long, signature binary")


def _sketch(grams: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * SKETCH, np.uint8)
    bits[(grams >> np.uint64(11)) % np.uint64(64 * SKETCH)] = 1
    return np.packbits(bits).view(np.int64)


def full_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, grams and sketch of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in _sets(batch.column(1), width):
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH), pa.array(np.concatenate([_sketch(x) for x in sets])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64))), sketches], names=["doc_id", "grams", "sketch"])

    return docs.mapInArrow(run, "doc_id long, grams array<long>, sketch array<long>")


def _missing(a: str, b: str) -> Column:
    """At least so many shingles of sketch a are not in b."""
    return sum((F.bit_count(F.col(a)[i].bitwiseAND(F.bitwise_not(F.col(b)[i]))) for i in range(SKETCH)), F.lit(0))


def _jaccard(common: Column, a: Column, b: Column, percent: int) -> Column:
    return common * 100 >= (a + b - common) * percent


class NearDuplicates:
    """Groups of docs(doc_id, text) whose shingle sets, linked pair by pair, have 100 * intersection >= percent * union."""

    def __init__(self, docs: DataFrame, percent: int = 80, width: int = 5, slots: int = SLOTS, band: int = BAND):
        bounded_batches(docs.sparkSession)
        self.docs, self.percent, self.width = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent, width
        self.slots, self.band = slots, band
        self.base = cut(digests(docs, width, slots))

    def _representatives(self) -> DataFrame:
        """One document for each distinct set: the least doc_id that has it."""
        real = self.base.where("n_shingles > 0 and doc_id is not null")
        return real.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))

    def _buckets(self, reps: DataFrame) -> DataFrame:
        """(key, rep) of the band keys that two or more representatives share."""
        real = self.base.where("n_shingles > 0")
        own = real.join(reps, [real.h1 == reps.h1, real.h2 == reps.h2, real.doc_id == reps.rep]).select("rep", "signature").dropDuplicates(["rep"])
        step = 4 * self.band
        bands = F.array(*[F.xxhash64(F.lit(i), F.substring("signature", 1 + i * step, step)) for i in range(self.slots // self.band)])
        exploded = own.select("rep", F.explode(bands).alias("key"))
        shared = cut(exploded.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1"))
        return cut(salted_join(exploded, shared.select("key"), "key", "rep", shared))

    def _shareable(self, sets: DataFrame) -> DataFrame:
        """rep, n, s of the members that can have a link at all: s is the number of their shingles that another member has.

        A link needs 100 * intersection >= percent * union, and an intersection holds none of the shingles that only one
        member has. So documents that merely share a passage drop out here, before any pair is formed.
        """
        grams = sets.select("doc_id", F.explode("grams").alias("gram"))
        alone = grams.groupBy("gram").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")).where("n = 1").groupBy("rep").agg(F.count("*").alias("alone"))
        sized = sets.select(F.col("doc_id").alias("rep"), F.size("grams").cast("long").alias("n")).join(alone, "rep", "left").withColumn("s", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
        return cut(sized.where(F.col("s") * 100 >= F.col("n") * self.percent))

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The links (u, v) among pairs(a, b), by the full sets."""
        half = salted_join(pairs, sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb")), "b", "a")
        full = salted_join(half, sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), "a", "b", pairs.groupBy("a").agg(F.count("*").alias("_n")))
        common = F.size(F.array_intersect("ga", "gb")).cast("long")
        return full.where(_jaccard(common, F.size("ga").cast("long"), F.size("gb").cast("long"), self.percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))

    def _rarest(self, state: DataFrame, sets: DataFrame) -> DataFrame:
        """Candidate pairs, as rows with the columns of two members, of state's members that share one of their rarest shingles.

        With shingles in order of how many members have them, of two sets that can be linked the smaller has one of the
        common shingles among its first n - 2 * percent * n / (100 + percent), and the larger among its first
        n - percent * n / 100 (and one more each).
        """
        members = state.select("rep", "n", "s", "k", "component").dropDuplicates(["rep"])
        grams = cut(sets.select(F.col("doc_id").alias("rep"), F.explode("grams").alias("gram")).join(members.select("rep", "n"), "rep"))
        held = grams.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1")
        shared = salted_join(grams, held, "gram", "rep")
        alone = grams.groupBy("rep").agg(F.count("*").alias("all")).join(shared.groupBy("rep").agg(F.count("*").alias("some")), "rep").select("rep", (F.col("all") - F.col("some")).alias("alone"))
        # shingles of one member alone come first in the order and match nothing
        place = F.col("alone") + F.row_number().over(Window.partitionBy("rep").orderBy("held", "gram"))
        ranked = cut(shared.join(alone, "rep").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1).select("gram", "rep", "n", "place"))
        small = ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * (2 * self.percent) / (100 + self.percent)) + 1)
        left = small.select("gram", "rep").join(members, "rep")
        right = ranked.select("gram", F.col("rep").alias("c")).join(members.select(F.col("rep").alias("c"), F.col("component").alias("cc"), F.col("n").alias("nc"), F.col("s").alias("sc"), F.col("k").alias("kc")), "c")
        return salted_join(cut(left), cut(right), "gram", "rep").where("component <> cc and (n < nc or n = nc and rep <> c)")

    def links(self, reps: DataFrame) -> DataFrame | None:
        buckets = self._buckets(reps)
        members = buckets.select(F.col("rep").alias("doc_id")).distinct()
        count = members.count()
        if not count:
            return None
        members = F.broadcast(members) if count <= BROADCAST_IDS else members
        sets = cut(full_sets(self.docs.join(members, "doc_id", "left_semi"), self.width).dropDuplicates(["doc_id"]))
        found: DataFrame | None = None
        tried: DataFrame | None = None
        live = self._shareable(sets)
        sets = cut(sets.join(live.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"))
        buckets = cut(buckets.join(live.join(sets.select(F.col("doc_id").alias("rep"), F.col("sketch").alias("k")), "rep"), "rep"))
        state = buckets.withColumn("component", F.col("rep"))
        for turn in range(STAR_ROUNDS + 1):
            # The first centre is the member with the fewest shingles of its own: edits of one text link with it, though
            # not with each other. Then it is another each turn; only members outside its component are compared with it.
            if turn < STAR_ROUNDS:
                rank = F.xxhash64("rep", F.lit(turn)) if turn else F.col("n") - F.col("s")
                centre = state.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), F.col("rep").alias("c"), F.col("component").alias("cc"), F.col("n").alias("nc"), F.col("s").alias("sc"), F.col("k").alias("kc"))).alias("m")).select("key", "m.c", "m.cc", "m.nc", "m.sc", "m.kc")
                pairs = salted_join(state, centre, "key", "rep").where("component <> cc")
            else:
                pairs = self._rarest(state, sets)
            # the largest intersection that they can have, against the one that their sizes ask for
            most = F.least("s", "sc", F.col("n") - _missing("k", "kc"), F.col("nc") - _missing("kc", "k"))
            pairs = pairs.where(most * (100 + self.percent) >= (F.col("n") + F.col("nc")) * self.percent)
            pairs = pairs.select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = cut(pairs)
            if not pairs.isEmpty():
                tried = pairs if tried is None else tried.union(pairs)
                more = self._verified(pairs, sets)
                found = cut(more if found is None else found.union(more))
            if turn == STAR_ROUNDS:
                break
            if found is not None:
                found_in = components(found)
                state = buckets.join(found_in.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
            mixed = state.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least_n")).where("low < high").select("key", "least_n")
            able = F.col("s") * (100 + self.percent) >= (F.col("n") + F.col("least_n")) * self.percent
            state = cut(salted_join(state.select("key", "rep", "n", "s", "k", "component"), mixed, "key", "rep", buckets.groupBy("key").agg(F.count("*").alias("_n"))).where(able).drop("least_n"))
            if state.isEmpty():
                break
        return found

    def groups(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept for every row of docs."""
        reps = cut(self._representatives())
        found = self.links(reps)
        classes = reps.withColumn("component", F.col("rep"))
        if found is not None:
            classes = reps.join(components(found).withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
        # texts without words, all alike, are in no class, and rows without doc_id in none that is told
        live = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
        digest = F.struct("h1", "h2").alias("digest")
        named = self.base.where(live).select("doc_id", "n_shingles", digest, F.monotonically_increasing_id().alias("_row"))
        joined = salted_join(named, classes.select(digest, F.col("component").alias("component_id")), "digest", "_row").select("doc_id", "n_shingles", "component_id")
        rows = joined.unionByName(self.base.where(~live).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
        return rows.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    return NearDuplicates(docs, percent, width).groups()


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
