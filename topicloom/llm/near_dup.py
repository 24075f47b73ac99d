"""Near duplicates by circulant MinHash.

Two permutations give a whole signature: one scatters the shingles, the other, shifted circularly by one place
for each coordinate, ranks them; a coordinate is the smallest rank.  Documents with equal sets form one class
first.  Classes that agree in a band of coordinates meet in a bucket, and every class is compared with the
smallest one of each of its buckets, its pivot.

Two classes with similarity of the threshold or more may still meet only at a pivot that neither is linked with.
Distances to the pivot are then known exactly and obey the triangle inequality, so the classes around a pivot
are dealt into rings as wide as the allowed distance, and only a ring with itself and its inner neighbour is
compared, in blocks of bounded size.  All comparisons use the full sets.  Links go through connected components.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.graph import components
from topicloom.runtime import materialise

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearDupParams:
    """25 bands of 5: a pair at similarity 0.85 is missed with a chance below 10^-6."""

    words: int = 5
    percent: int = 85
    bands: int = 25
    rows: int = 5
    block: int = 384  # classes of a ring that one task compares with as many others
    chunk: int = 2048  # classes that one task compares with their pivot


class Shingles:
    """Sets of hashed word shingles of whole texts, A-Z lowered."""

    def __init__(self, words: int):
        self.words, self.seen = words, {}

    def of(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingle hashes; fewer words than a shingle has make one shingle."""
        words = text.encode().lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.seen) > 400_000:
            self.seen.clear()
        seen, new = self.seen, xxhash.xxh64_intdigest
        values = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = seen.get(w)
            if h is None:
                h = seen[w] = new(w)
            values[i] = h
        n = max(1, len(values) - self.words + 1)
        total = np.full(n, len(words) if len(words) < self.words else self.words, np.uint64)
        for j in range(min(self.words, len(values))):
            total = mixed(total * GOLDEN + values[j : j + n])
        return np.unique(total)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    return x * np.uint64(0xBF58476D1CE4E5B9)


def scatter(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return x ^ (x >> np.uint32(16))


def ranks(x: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Another permutation of the 32-bit numbers, without new arrays."""
    np.right_shift(x, np.uint32(15), out=spare)
    np.bitwise_xor(x, spare, out=out)
    np.multiply(out, np.uint32(0x2C1B3C6D), out=out)
    np.right_shift(out, np.uint32(12), out=spare)
    np.bitwise_xor(out, spare, out=out)
    np.multiply(out, np.uint32(0x297A2D39), out=out)
    np.right_shift(out, np.uint32(15), out=spare)
    return np.bitwise_xor(out, spare, out=out)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """``(sets, coordinates)`` smallest ranks; no set may be empty."""
    out = np.empty((coordinates, len(sets)), np.uint32)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= 32768):
            size += len(sets[last])
            last += 1
        starts = np.cumsum([0] + [len(s) for s in sets[first : last - 1]])
        place = scatter((np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32))
        a, b = np.empty_like(place), np.empty_like(place)
        for k in range(coordinates):
            np.minimum.reduceat(ranks(place, a, b), starts, out=out[k, first:last])
            place += np.uint32(1)  # the ranking moves by one place
        first = last
    return out.T


SIGNED = "doc_id bigint, n_shingles bigint, low bigint, high bigint, bands array<bigint>"


def sign(p: NearDupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(p.words)
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                sets = [shingles.of(t.as_py()) for t in part.column(1)]
                full = [s for s in sets if len(s)]
                low, high = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                for i, s in enumerate(sets):
                    digest = xxhash.xxh128_intdigest(s.tobytes())
                    low[i], high[i] = digest & 0xFFFFFFFFFFFFFFFF, digest >> 64
                offsets = np.concatenate([[0], np.cumsum([p.bands if len(s) else 0 for s in sets])]).astype(np.int32)
                bands = np.zeros(0, np.uint64)
                if full:
                    grid = signatures(full, p.bands * p.rows).astype(np.uint64).reshape(len(full), p.bands, p.rows)
                    bands = np.broadcast_to(np.arange(p.bands, dtype=np.uint64), grid.shape[:2])
                    for j in range(p.rows):
                        bands = mixed(bands * GOLDEN + grid[:, :, j])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(low.view(np.int64)),
                        pa.array(high.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1).view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "low", "high", "bands"],
                )

    return run


SHARED = "pivot bigint, node bigint, same bigint, size_pivot bigint, size_node bigint"


def compare_with_pivot(p: NearDupParams):
    """Rows come sorted by pivot and chunk, the pivot's own text first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, at, held = Shingles(p.words), None, None
        for batch in batches:
            out = []
            for pivot, node, text in zip(batch.column("pivot").to_numpy(), batch.column("node").to_numpy(), batch.column("text")):
                if node == pivot:
                    at, held = pivot, shingles.of(text.as_py())
                    continue
                assert at == pivot
                own = shingles.of(text.as_py())
                both = np.concatenate([held, own])
                both.sort()
                out.append((pivot, node, int((both[1:] == both[:-1]).sum()), len(held), len(own)))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in columns], names=["pivot", "node", "same", "size_pivot", "size_node"])

    return run


def compare_rings(p: NearDupParams):
    """Rows come sorted by block; each block holds ring members and those they are compared with."""

    def links(members: list[tuple[int, bool, np.ndarray]]) -> list[tuple[int, int]]:
        outer = [m for m in members if m[1]]
        ids_a, ids_b = np.array([m[0] for m in outer]), np.array([m[0] for m in members])
        sizes_a, sizes_b = np.array([len(m[2]) for m in outer]), np.array([len(m[2]) for m in members])
        every, cell = np.unique(np.concatenate([m[2] for m in members]), return_inverse=True)
        often = np.bincount(cell) > 1  # shingles of one class only add nothing to what two share
        column = np.where(often, np.cumsum(often) - 1, -1)[cell]
        row = np.repeat(np.arange(len(members)), sizes_b)
        inner = np.array([not m[1] for m in members])
        same = np.zeros((len(outer), len(members)), np.float32)
        position = np.cumsum(~inner) - 1
        for start in range(0, int(often.sum()), 4096):
            fits = (column >= start) & (column < start + 4096)
            right = np.zeros((len(members), 4096), np.float32)
            right[row[fits], column[fits] - start] = 1
            left = right[~inner]
            same += left @ right.T
        found = 100 * same >= p.percent * (sizes_a[:, None] + sizes_b[None] - same)
        found &= ids_a[:, None] != ids_b[None]
        return [(int(ids_a[i]), int(ids_b[j])) for i, j in spanning(np.argwhere(found), position, inner)]

    def spanning(pairs: np.ndarray, position: np.ndarray, inner: np.ndarray) -> list[tuple[int, int]]:
        """Enough of the pairs to connect what all of them connect."""
        spot = {int(position[j]): j for j in np.flatnonzero(~inner)}
        parent = list(range(len(inner)))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j in pairs:
            a, b = top(spot[int(i)]), top(int(j))
            if a != b:
                parent[a] = b
                out.append((i, j))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, at, members = Shingles(p.words), None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = (row["pivot"], row["ring"], row["i"], row["j"])
                if key != at:
                    out += links(members) if members else []
                    at, members = key, []
                members.append((row["node"], row["outer"], shingles.of(row["text"])))
            yield packed(out)
        if members:
            yield packed(links(members))

    def packed(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*pairs) if pairs else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], names=["a", "b"])

    return run


def stars(signed: DataFrame, classes: DataFrame, p: NearDupParams) -> DataFrame:
    """``(pivot, node)``: every class with the smallest class of each bucket that it is in."""
    first = classes.select(F.col("first").alias("doc_id"), "low", "high")
    nodes = signed.where("n_shingles > 0").join(first, ["doc_id", "low", "high"], "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", F.explode("bands").alias("bucket"))
    pivots = nodes.groupBy("bucket").agg(F.min(F.struct("node", "n_shingles")).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = nodes.join(pivots, "bucket").select(F.col("p.node").alias("pivot"), "node")
    return pairs.where("pivot <> node").distinct()


def compared(star: DataFrame, texts: DataFrame, p: NearDupParams) -> DataFrame:
    """How much of their sets every node and its pivot share."""
    sizes = star.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    chunks = F.ceil(F.col("n") / p.chunk).cast("int")
    members = star.join(sizes, "pivot").select("pivot", "node", F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk"))
    own = sizes.select("pivot", F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    rows = members.union(own).hint("merge").join(texts, "node").select("pivot", "chunk", "node", "text")
    rows = rows.repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk", F.col("node") != F.col("pivot"))
    return rows.mapInArrow(compare_with_pivot(p), SHARED)


def linked_with_pivot(p: NearDupParams) -> Column:
    return 100 * F.col("same") >= p.percent * (F.col("size_pivot") + F.col("size_node") - F.col("same"))


def ring_links(star: DataFrame, texts: DataFrame, p: NearDupParams) -> DataFrame:
    """Links ``(a, b)`` among the nodes around a pivot that are not both linked with it.

    Ring 0 reaches a little beyond the allowed distance: its nodes that aren't linked with the pivot are compared as well.
    """
    # a little wider than the allowed distance, so that rounding moves no pair two rings apart
    distance = 1 - F.col("same") / (F.col("size_pivot") + F.col("size_node") - F.col("same"))
    ring = F.floor(distance / F.lit(1.0001 * (1 - p.percent / 100))).cast("int")
    apart = ~linked_with_pivot(p)
    placed = star.select("pivot", "node", ring.alias("own"), apart.alias("apart"))
    rows = placed.select("pivot", "node", F.explode(F.array(F.struct(F.col("own").alias("ring"), F.col("apart").alias("outer")), F.struct((F.col("own") + 1).alias("ring"), F.lit(False).alias("outer")))).alias("x"))
    rows = rows.select("pivot", "node", "x.ring", "x.outer")
    sizes = rows.groupBy("pivot", "ring").agg(F.sum(F.col("outer").cast("int")).alias("n_outer"), F.count(F.lit(1)).alias("n"))
    # a ring with one member and nothing inside has no pair; the pivot itself was compared before
    rows = rows.join(sizes.where("n_outer > 0 AND n > 1"), ["pivot", "ring"])
    blocks = lambda n: F.ceil(F.col(n) / p.block).cast("int")
    i, j = F.pmod(F.xxhash64("node"), blocks("n_outer")).cast("int"), F.pmod(F.xxhash64("node"), blocks("n")).cast("int")
    to_columns, to_rows = F.sequence(F.lit(0), blocks("n") - 1), F.sequence(F.lit(0), blocks("n_outer") - 1)
    left = rows.where("outer").select("pivot", "ring", "node", "outer", i.alias("i"), F.explode(to_columns).alias("j"))
    right = rows.select("pivot", "ring", "node", F.lit(False).alias("outer"), F.explode(to_rows).alias("i"), j.alias("j"))
    keys = ["pivot", "ring", "i", "j", "node"]
    # a node that stands on both sides of its block is sent once
    dealt = left.union(right).groupBy(*keys).agg(F.max("outer").alias("outer"))
    dealt = dealt.hint("merge").join(texts, "node").repartition("pivot", "ring", "i", "j").sortWithinPartitions("pivot", "ring", "i", "j")
    return dealt.select(*keys, "outer", "text").mapInArrow(compare_rings(p), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs`` (``doc_id``, ``text``).

    Documents whose shingle sets have similarity ``percent`` or more are linked; ``component_id`` is the smallest
    id that a document reaches, ``kept`` whether that is its own.  Null and empty texts and texts of blanks have
    an empty set and link with nothing; fewer words than a shingle has are one shingle.  Rows that repeat an id
    count as one document; a null id links with nothing and is kept.  Other columns are ignored.
    """
    signed = materialise(docs.select("doc_id", "text").mapInArrow(sign(p), SIGNED), "signatures")
    named = signed.where("doc_id IS NOT NULL")
    classes = named.where("n_shingles > 0").groupBy("low", "high").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    star = materialise(stars(named, classes, p), "stars")
    nodes = star.select("node").union(star.select("pivot")).distinct()
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(nodes.hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    texts = materialise(texts, "suspects")  # joined by sorting at every size: what meets them grows with the corpus
    measured = materialise(compared(star, texts, p), "measured")
    links = measured.where(linked_with_pivot(p)).select(F.col("pivot").alias("a"), F.col("node").alias("b")).union(ring_links(measured, texts, p))
    labels = components(links, "a", "b")
    copies = classes.where("n > 1").select("low", "high", "first")
    rows = signed.join(copies, ["low", "high"], "left").withColumn("node", F.coalesce("first", "doc_id"))
    label = F.coalesce("label", "node")
    return rows.join(labels, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, label).otherwise(F.col("doc_id")).alias("component_id")
    ).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


# workers get this module's functions with the task, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
