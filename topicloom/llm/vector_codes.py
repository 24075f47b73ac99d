"""Vector compression: every vector becomes one small index for each of its parts.

Vectors are turned into whole numbers and cut into equal parts; each part position has a codebook whose
entries are fitted by a few rounds of assigning parts to their nearest entry and averaging.  All distances are
squared distances of whole numbers, so that assignments and ties are exact.

Rounds after the first use adaptive bounds.  Each part keeps its ``b`` closest entries: an upper bound of the
distance to its own entry, ordered lower bounds for the others, and one outer bound for all entries that are
not listed.  When entries move, bounds widen by the way moved; a part whose upper bound stays below all lower
bounds keeps its entry without a distance.  Others are verified in whole numbers: first the own entry, then
the listed entries that are still possible, and only if the outer bound does not exclude the rest, all entries.
How far down the lists the checks went decides ``b`` of the next round.

Bounds are counts of a fixed unit, lower ones rounded down and upper ones up, in 16 bits.  They live in a written
table; each round reads the last one and writes the next.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.runtime import discard, materialise, sized

MOST = (1 << 16) - 1  # units of a bound
BEYOND = 255  # the depth of a part that was compared with every entry
ROWS = 4096  # handled at once


@dataclass(frozen=True)
class CodeParams:
    """``entries`` (256 at most) for each of ``parts`` positions, fitted in ``rounds``.  ``nearest`` entries are
    listed at first, ``least_nearest`` at least."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    nearest: int = 16
    least_nearest: int = 8


@dataclass(frozen=True)
class Codebooks:
    """``values`` is parts x entries x components, in whole numbers."""

    values: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.values.ravel().tolist())).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that rows of indexes stand for."""
        return self.values[np.arange(len(self.values)), codes].reshape(len(codes), -1)


@dataclass(frozen=True)
class Scale:
    """Whole numbers of at most ``largest``: how distances become units of a bound."""

    largest: int
    width: int  # components of a part

    @property
    def unit(self) -> float:
        return max(2.0 * self.largest * self.width**0.5, 1.0) / MOST

    def below(self, squares: np.ndarray) -> np.ndarray:
        """Units that the distance surely has; the slack covers the rounding of root and quotient."""
        return np.floor(np.sqrt(squares) / self.unit * (1 - 1e-12)).astype(np.int64)

    def above(self, squares: np.ndarray) -> np.ndarray:
        return np.minimum(np.ceil(np.sqrt(squares) / self.unit * (1 + 1e-12)).astype(np.int64), MOST)

    def to_all(self, x: np.ndarray, book: np.ndarray) -> np.ndarray:
        """Squared distances of parts to all entries; by matrix product where that is exact."""
        if 4 * self.width * self.largest**2 < 1 << 53:
            xf, bf = x.astype(np.float64), book.astype(np.float64)
            return ((xf * xf).sum(1)[:, None] - 2 * (xf @ bf.T) + (bf * bf).sum(1)).astype(np.int64)
        return squared(x[:, None, :], book[None])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


@dataclass
class Lists:
    """The bounds of many parts of one position: ``near`` holds the own entry first, then the others in the
    order of their lower bounds ``lower``."""

    near: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    outer: np.ndarray

    @classmethod
    def of(cls, squares: np.ndarray, b: int, scale: Scale) -> Lists:
        """From the squared distances to all entries; ties to the lower index."""
        order = np.argsort(squares, axis=1, kind="stable")[:, : b + 1]
        found = np.take_along_axis(squares, order, axis=1)
        lower = scale.below(found[:, 1:])
        outer = lower[:, b - 1] if found.shape[1] > b else np.full(len(found), MOST)
        return cls(order[:, :b], scale.above(found[:, 0]), lower[:, : b - 1], outer)

    def cut(self, b: int) -> Lists:
        """The same with lists of at most ``b``: what is dropped counts for the outer bound."""
        if self.near.shape[1] <= b:
            return self
        return Lists(self.near[:, :b], self.upper, self.lower[:, : b - 1], np.minimum(self.outer, self.lower[:, b - 1]))

    def put(self, rows: np.ndarray, other: Lists) -> None:
        for name in ("near", "upper", "lower", "outer"):
            getattr(self, name)[rows] = getattr(other, name)

    def ordered(self) -> None:
        order = np.argsort(self.lower, axis=1, kind="stable")
        self.lower = np.take_along_axis(self.lower, order, axis=1)
        self.near[:, 1:] = np.take_along_axis(self.near[:, 1:], order, axis=1)


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, lists: Lists, scale: Scale) -> np.ndarray:
    """Bring the lists of one position up to moved entries; returns how deep each part had to look.

    ``moved`` are units, rounded up.  An outer bound of ``MOST`` where every entry is listed stays.
    """
    b = lists.near.shape[1]
    lists.upper = np.minimum(lists.upper + moved[lists.near[:, 0]], MOST)
    lists.lower = np.maximum(lists.lower - moved[lists.near[:, 1:]], 0)
    if b < len(book):
        lists.outer = np.maximum(lists.outer - moved.max(), 0)
    lists.ordered()
    closest = np.minimum(lists.lower[:, 0], lists.outer) if b > 1 else lists.outer
    depth = np.zeros(len(x), np.int64)
    unsure = np.flatnonzero(lists.upper >= closest) if len(book) > 1 else depth[:0]
    lists.upper[unsure] = scale.above(squared(x[unsure], book[lists.near[unsure, 0]]))
    unsure = unsure[lists.upper[unsure] >= closest[unsure]]
    if not len(unsure):
        return depth
    near, lower = lists.near[unsure], lists.lower[unsure]
    asked = np.hstack([np.ones((len(unsure), 1), bool), lower <= lists.upper[unsure][:, None]])
    found = np.where(asked, squared(x[unsure][:, None, :], book[near]), np.iinfo(np.int64).max)
    least = found.min(axis=1)
    best = np.where(found == least[:, None], near, len(book)).argmin(axis=1)
    rest = (scale.above(least) >= lists.outer[unsure]) & (b < len(book))
    depth[unsure] = np.where(rest, BEYOND, asked.sum(axis=1))
    # the listed entries in place: the best one first, every checked one with its own distance
    bounds = np.where(asked, scale.below(np.where(asked, found, 0)), np.hstack([np.zeros((len(unsure), 1), np.int64), lower]))
    rows = np.arange(len(unsure))
    near[rows, best], near[:, 0] = near[:, 0].copy(), near[rows, best].copy()
    bounds[rows, best] = bounds[:, 0]
    fresh = Lists(near, scale.above(least), bounds[:, 1:], lists.outer[unsure])
    fresh.ordered()
    lists.put(unsure, fresh)
    again = unsure[rest]
    if len(again):
        lists.put(again, Lists.of(scale.to_all(x[again], book), b, scale))
    return depth


def next_nearest(depths: np.ndarray, b: int, p: CodeParams) -> int:
    """The list length that costs least: every part carries ``b`` bounds, and a part that looks deeper is
    compared with all entries.  ``depths`` counts parts by depth."""
    lengths = np.arange(min(p.least_nearest, b), b + 1)
    deeper = depths.sum() - np.cumsum(depths)[lengths]
    return int(lengths[np.argmin(lengths * depths.sum() + p.entries * deeper)])


STATE = "near binary, upper binary, lower binary, outer binary, depth binary"


def binary_column(values: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def flat_column(column: pa.Array, kind, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def vectors_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def assign_task(books: np.ndarray, scale: Scale, b: int, moved: np.ndarray | None, final: bool):
    """The task of a round: ``(id, label, x)`` and, after the first, the lists of the last round.

    Writes the lists of this round, or, when ``final``, the codes with their errors.
    """
    parts = len(books)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = vectors_of(batch.column(2)).reshape(batch.num_rows, parts, -1)
        if moved is not None:
            kinds = (("near", np.uint8), ("upper", np.uint16), ("lower", np.uint16), ("outer", np.uint16))
            stored = {name: flat_column(batch.column(name), kind, parts, -1).astype(np.int64) for name, kind in kinds if name != "lower" or b_stored(batch, parts) > 1}
        done, depths, errors = [], [], np.zeros(batch.num_rows, np.int64)
        for part in range(parts):
            own = x[:, part]
            if moved is None:
                lists, depth = Lists.of(scale.to_all(own, books[part]), b, scale), np.zeros(len(own), np.int64)
            else:
                lower = stored["lower"][:, part] if "lower" in stored else np.zeros((len(own), 0), np.int64)
                lists = Lists(stored["near"][:, part], stored["upper"][:, part, 0], lower, stored["outer"][:, part, 0]).cut(b)
                depth = reassign(own, books[part], moved[part], lists, scale)
            done.append(lists)
            depths.append(depth)
            if final:
                errors += squared(own, books[part][lists.near[:, 0]])
        if final:
            codes = np.stack([lists.near[:, 0] for lists in done], axis=1).astype(np.uint8)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binary_column(codes), pa.array(errors)], ["id", "label", "code", "error"])
        packed = [("near", np.uint8), ("upper", np.uint16), ("lower", np.uint16), ("outer", np.uint16)]
        columns = [binary_column(np.stack([getattr(lists, name) for lists in done], axis=1).astype(kind)) for name, kind in packed]
        columns.append(binary_column(np.stack(depths, axis=1).astype(np.uint8)))
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns], ["id", "label", "x", "near", "upper", "lower", "outer", "depth"])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                yield step(batch.slice(start, ROWS))

    return job


def b_stored(batch: pa.RecordBatch, parts: int) -> int:
    return len(batch.column("near")[0].as_py()) // parts


def sum_task(parts: int, entries: int, width: int):
    """The task that adds up the parts of every entry: rows ``(slot, total)``, slots being the place in the
    codebooks, then the place of the counts, then the depths."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, depths = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), np.zeros(BEYOND + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors_of(batch.column(0)).reshape(batch.num_rows, parts, width)
            code = flat_column(batch.column(1), np.uint8, parts, -1)[:, :, 0]
            depths += np.bincount(flat_column(batch.column(2), np.uint8, parts).ravel(), minlength=BEYOND + 1)
            for part in range(parts):
                np.add.at(sums[part], code[:, part], x[:, part])
                counts[part] += np.bincount(code[:, part], minlength=entries)
        every = np.concatenate([sums.ravel(), counts.ravel(), depths])
        slots = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(every[slots])], ["slot", "total"])

    return job


def whole_vectors(vectors: DataFrame, p: CodeParams, key: str, column: str, label: str) -> tuple[DataFrame, int, int]:
    """``(id, label, x)`` of the rows that take part, the length and the largest component.

    Vectors have whole components and are filled up with zeros to a multiple of ``parts``.
    """
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(v.isNotNull() & fine)
    lengths = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    length = lengths[0]["d"] if lengths else 0
    rows = rows.where(F.size(v) == length)
    reach = rows.agg(F.max(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))).alias("m")).first()["m"] or 0.0
    width = -(-length // p.parts)
    largest = int(reach * p.scale) + 1
    if 4 * max(length, 1) * largest**2 >= 1 << 62:
        raise ValueError(f"components up to {reach} give errors beyond 64 bits")
    filled = F.concat(F.transform(v, lambda x: F.floor(x.cast("double") * p.scale).cast("long")), F.array_repeat(F.lit(0).cast("long"), width * p.parts - length))
    return rows.select(F.col(key).alias("id"), F.col(label).alias("label"), filled.alias("x")), width, largest


def compress(vectors: DataFrame, p: CodeParams = CodeParams(), key: str = "vec_id", column: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks]:
    """``(id, label, code, error)`` and the codebooks: an index byte for each part, and the squared distance of
    the whole vector to what it stands for.

    Rows whose vector is null or holds null or non-finite components go; so do vectors of another than the
    most frequent length (ties: the shorter).  Components become ``floor(scale * x)``.  Codebooks start as the
    parts of the ``entries`` rows with the smallest ids (null ids last, repeated ids by their vectors); fewer
    rows give fewer entries.  Ties go to the lower index; entries without parts stay as they are.  Every row
    is coded, also with a null or repeated id.  An empty table gives no rows and empty codebooks; other
    columns are ignored.  Raises where errors would not fit into 64 bits.

    A round is one pass over the written lists and one sum of (components + parts) x entries numbers.
    """
    rows, width, largest = whole_vectors(vectors, p, key, column, label)
    scale = Scale(largest, width)
    state = materialise(rows, "whole-vectors")
    first = state.select("x").orderBy(F.col("id").asc_nulls_last(), "x").limit(p.entries).collect()
    if not first:
        return state.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), Codebooks(np.zeros((p.parts, 0, width), np.int64))
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), p.parts, width).transpose(1, 0, 2).copy()
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    b, moved = min(p.nearest, len(first)), None
    for _ in range(p.rounds):
        lists = materialise(state.mapInArrow(assign_task(books, scale, b, moved, False), f"{kinds}, x array<bigint>, {STATE}"), "code-lists")
        discard(state)
        state = lists
        after, depths = averaged(state, books)
        if moved is not None:
            b = next_nearest(depths, b, p)
        moved = np.minimum(np.ceil(np.sqrt(squared(after, books)) / scale.unit * (1 + 1e-12)).astype(np.int64), MOST)
        books = after
    codes = materialise(state.mapInArrow(assign_task(books, scale, b, moved, True), f"{kinds}, code binary, error bigint"), "codes")
    discard(state)
    return codes, Codebooks(books)


def averaged(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries as rounded-down means of their parts, and how many parts looked how deep."""
    partial = state.select("x", "near", "depth").mapInArrow(sum_task(*books.shape), "slot bigint, total bigint")
    found = partial.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = {r["slot"]: int(r["total"]) for r in found}
    after, cells, lists = books.copy(), books.size, books.shape[0] * books.shape[1]
    flat = after.reshape(lists, -1)
    for entry in range(lists):
        if n := total.get(cells + entry, 0):
            flat[entry] = [total.get(entry * flat.shape[1] + i, 0) // n for i in range(flat.shape[1])]
    depths = np.array([total.get(cells + lists + i, 0) for i in range(BEYOND + 1)])
    return after, depths


def with_label_errors(codes: DataFrame) -> DataFrame:
    """The codes with ``label_error``: the error summed over the rows of an equal label, nulls together."""
    sums = sized(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.join(sums, codes["label"].eqNullSafe(sums["of"])).drop("of")


def codes_sql(p: CodeParams = CodeParams()) -> str:
    """The same codes by comparing every part with every entry, for DuckDB; lengths are a multiple of ``parts``."""
    steps = []
    for i in range(p.rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (SELECT rid, p, arg_min(e, d * {p.entries} + e) AS e, min(d) AS d
        FROM (SELECT rid, cut.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM cut JOIN book{i} USING (p)) GROUP BY rid, p)""")
        if i < p.rounds:
            steps.append(f"""book{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN (SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (
            SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM near{i} JOIN cut USING (rid, p), unnest(range(1, len(x) + 1)) u(i) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))""")
    last = p.rounds
    return f"""
    WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: floor({p.scale} * x::DOUBLE)::BIGINT) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    cut AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // {p.parts}) + 1 : (p + 1) * (len(v) // {p.parts})] AS x FROM kept, range({p.parts}) r(p)),
    book0 AS (SELECT p, rid AS e, x AS c FROM cut WHERE rid < {p.entries}),
    {", ".join(steps)},
    coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{last} GROUP BY rid),
    named AS (SELECT vec_id, label, code, error FROM coded JOIN kept USING (rid)),
    sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM named GROUP BY label),
    book AS (SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{last})
    SELECT vec_id, code, error, label_error, codebooks_sha256 FROM named JOIN sums ON named.label IS NOT DISTINCT FROM sums.label, book"""


cloudpickle.register_pickle_by_value(sys.modules[__name__])
