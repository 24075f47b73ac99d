"""Nearest vectors by multi-index hashing.

A rotation is learned on a bounded sample (principal directions, then alternating sign fitting), every
vector becomes a binary code of its rotated signs, and a code is cut into 16-bit substrings.  A code
within Hamming radius ``r`` of a query agrees with it in one substring up to its share of ``r``
(pigeonhole), so probing the substring tables retrieves every such code; those are reranked by the
inner product of the original vectors in double precision.

Rows and queries are dealt by id into blocks of bounded size.  A task holds one block of rows with its
substring tables and one block of queries, and returns the best ``k`` of the block for each query; a
second step keeps the best ``k`` of all blocks.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUBSTRING = 16  # bits; a table has 65,536 keys at most


@dataclass(frozen=True)
class NeighbourParams:
    """``sample_rows`` bounds what the rotation and the radius are fitted on; all rows are indexed.

    The radius is the smallest that holds ``sample_recall`` of the true neighbours inside the sample.
    Neighbours only come closer as rows are added, so the whole table is found at least as well.
    """

    k: int = 20
    bits: int = 64
    sample_rows: int = 4096
    sample_recall: float = 0.96
    rotations: int = 40
    rows_per_block: int = 16384
    queries_per_block: int = 1024


@dataclass(frozen=True)
class Codes:
    """A fitted code: ``sign((x', - mean) . turn)`` for the vector extended by its missing length."""

    longest: float
    mean: np.ndarray
    turn: np.ndarray
    radius: int

    def of(self, x: np.ndarray, query: bool) -> np.ndarray:
        return np.packbits((extended(x, self.longest, query) - self.mean) @ self.turn > 0, axis=1).view(np.uint16)


def extended(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors of equal length whose angles to the queries order as the inner products do."""
    norm2 = (x * x).sum(1)
    if query:
        return np.hstack([x / np.sqrt(norm2)[:, None], np.zeros((len(x), 1))])
    return np.hstack([x, np.sqrt(np.maximum(longest**2 - norm2, 0))[:, None]]) / longest


def fit_codes(sample: np.ndarray, longest: float, p: NeighbourParams) -> Codes:
    z = extended(sample, longest, False)
    mean = z.mean(0)
    _, _, axes = np.linalg.svd(z - mean, full_matrices=False)
    directions = axes[: p.bits].T
    v = (z - mean) @ directions
    rng = np.random.default_rng(7)
    # as many bits as asked for, also from fewer dimensions: the rotation then has fewer rows than columns
    rotation = np.linalg.qr(rng.normal(size=(p.bits, p.bits)))[0][: v.shape[1]]
    for _ in range(p.rotations):
        signs = np.where(v @ rotation > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(v.T @ signs, full_matrices=False)
        rotation = left @ right
    codes = Codes(longest, mean, directions @ rotation, 0)
    probes = sample[: max(1, len(sample) // 8)]
    score = probes @ sample.T
    score[np.arange(len(probes)), np.arange(len(probes))] = -np.inf
    n = min(p.k, len(sample) - 1)
    if n < 1:
        return codes
    best = np.argpartition(-score, n - 1, axis=1)[:, :n]
    a, b = codes.of(probes, True), codes.of(sample, False)
    apart = np.bitwise_count(a[:, None, :] ^ b[best]).sum(2, dtype=np.int64)
    return Codes(longest, mean, codes.turn, int(np.quantile(apart, p.sample_recall, method="higher")))


class BlockIndex:
    """The substring tables of one block: for each substring its keys and the rows that have them."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            keys, counts = np.unique(codes[:, j], return_counts=True)
            self.tables.append((keys, counts, order))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code lies within the radius."""
        share, extra = divmod(radius, len(self.tables))
        found = np.zeros(len(self.codes), bool)
        for j, (keys, counts, order) in enumerate(self.tables):
            reach = share if j <= extra else share - 1
            if reach >= 0:
                found[order[np.repeat(np.bitwise_count(keys ^ code[j]) <= reach, counts)]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1, dtype=np.int64) <= radius]


OUT = "query_id bigint, vec_id bigint, score double"


def search_block(codes: Codes, k: int):
    """The function of a cogrouped block: best ``k`` rows of the block for each of its queries."""

    def matrix(table: pa.Table) -> np.ndarray:
        column = table.column("vector").combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[], [], []]
        if len(rows) and len(queries):
            ids, x = rows.column("id").to_numpy(), matrix(rows)
            index = BlockIndex(codes.of(x, False))
            q = matrix(queries)
            for query, code, vector in zip(queries.column("id").to_numpy(), codes.of(q, True), q):
                radius, other = codes.radius, int((ids != query).sum())
                while True:
                    found = index.within(code, radius)
                    found = found[ids[found] != query]
                    if len(found) >= min(k, other):
                        break
                    radius += 2  # too few in this ball: a wider one
                # one row at a time in one order of summing, so that equal vectors score equally
                score = (x[found] * vector).sum(1)
                best = np.lexsort((ids[found], -score))[:k]
                out[0].append(np.full(len(best), query))
                out[1].append(ids[found][best])
                out[2].append(score[best])
        flat = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table({"query_id": flat[0].astype(np.int64), "vec_id": flat[1].astype(np.int64), "score": flat[2].astype(np.float64)})

    return search


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """``(id, vector)`` of the rows that take part: an id, and a vector of finite components, not all zero.

    Vectors of another than the most frequent length (ties: the shorter) cannot be compared and are left out.
    """
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & v.isNotNull() & fine)
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("vector") == (lengths[0]["d"] if lengths else 0))


def nearest(vectors: DataFrame, is_query, p: NeighbourParams = NeighbourParams(), id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each row where ``is_query`` holds.

    Nearest by largest inner product, ties to the smaller id; a row is no candidate of a query with its
    own id (also when an id is repeated).  Vectors null, zero, or holding null or non-finite components
    take no part.  Fewer than ``k`` candidates: all of them.  An empty table gives no rows; other columns
    are ignored.
    """
    rows = usable(vectors, id_column, column)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    queries = rows.where(is_query(F.col("id")))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest")).first()
    asked = queries.count()
    if not total["n"] or not asked:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(p.sample_rows).collect()
    codes = fit_codes(np.array([r["vector"] for r in sample], dtype=np.float64), total["longest"], p)
    row_blocks, query_blocks = -(-total["n"] // p.rows_per_block), -(-asked // p.queries_per_block)

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id", F.lit(own)), F.lit(n)).cast("int").alias(own)
        return df.select("id", "vector", block, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    left = dealt(rows, "row_block", row_blocks, "query_block", query_blocks).groupBy("row_block", "query_block")
    right = dealt(queries, "query_block", query_blocks, "row_block", row_blocks).groupBy("row_block", "query_block")
    found = left.cogroup(right).applyInArrow(search_block(codes, p.k), OUT)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", place).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


# workers get this module's functions with the task, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
