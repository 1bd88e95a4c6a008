"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Iterative quantization learns rotations whose signs are a vector's code. A code is cut into 16-bit
substrings, each indexed by value. By the pigeonhole principle a code within Hamming radius r of a
query's is within about r / m of it in one of the m substrings, so probing each index for the values that
near retrieves every code within r; those get exact inner products. The radius is read off the exact
neighbours of a few calibration queries, and a query that finds too few is asked again with all of them.
Vectors are dealt to blocks with an index each; every query probes every block, which answers with its best.
`examined` is the mean number of rows that the probes of the block of the answer led to, for a query of those asked together.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.llm.common import materialize

#: Vectors that rotations are learned from at most, rotations, and calibration queries.
FIT_ROWS, ROTATIONS, CALIBRATION = 10_000, 4, 64
#: Rows and queries that meet in a task: at 64 dimensions, 4 and 2 MB.
ROW_BLOCK, QUERY_BLOCK = 8192, 4096
#: Share of the calibration queries' true neighbours that must be within the radius.
WITHIN = 0.975


def learn(x: np.ndarray, rotations: int = ROTATIONS, steps: int = 20, seed: int = 5) -> np.ndarray:
    """Orthogonal matrices, side by side (d, rotations * d), each from its own random start."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    out = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(steps if len(x) else 0):
            b = np.where(x @ r >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(x.T @ b)
            r = u @ vt
        out.append(r)
    return np.concatenate(out, axis=1)


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Codes as rows of 16-bit substrings, padded with zeros to whole 64-bit words."""
    bits = x @ rotation >= 0
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint16)


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with one more component that makes their norms equal, so that angles order inner products."""
    x = x / norm
    return np.concatenate([x, np.sqrt(np.maximum(1 - (x * x).sum(1, keepdims=True), 0))], axis=1)


def asked(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))], axis=1)


def _flips(reach: int) -> np.ndarray:
    """The 16-bit masks of up to `reach` bits."""
    every = np.arange(1 << 16, dtype=np.uint32)
    return every[np.bitwise_count(every) <= reach].astype(np.uint16)


class Index:
    """One index for each substring of the codes of a block of vectors: the rows in the order of its values, and the values' ends."""

    def __init__(self, code: np.ndarray, substrings: int | None = None) -> None:
        """substrings: how many of the codes' hold nothing but bits of the codes; only these are indexed."""
        self.code = code
        self.words = code.view(np.uint64)
        self.tables = []
        for s in range(code.shape[1] if substrings is None else substrings):
            order = np.argsort(code[:, s], kind="stable")
            values, start = np.unique(code[order, s], return_index=True)
            self.tables.append((order, values, np.append(start, len(code))))
        self.examined = 0

    def probe(self, s: int, query: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, row) of the rows whose substring s is within reach of the query's. The values asked for are listed
        and looked up, or where the list would be longer than that of the values there are, these are gone through."""
        order, values, ends = self.tables[s]
        flips = sum(comb(16, i) for i in range(reach + 1))
        if flips < len(values):
            asked = query[:, s, None] ^ _flips(reach)[None]
            at = np.minimum(np.searchsorted(values, asked), max(len(values) - 1, 0))
            q, hit = np.nonzero(values[at] == asked)
            value = at[q, hit]
        else:
            q, value = np.nonzero(np.bitwise_count(query[:, s, None] ^ values[None]) <= reach)
        n = ends[value + 1] - ends[value]
        at = np.repeat(ends[value] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
        return np.repeat(q, n), order[at]

    def within(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, row, distance) of every code within radius of queries' codes, each once."""
        m = len(self.tables)
        low, more = divmod(radius, m)
        reaches = [low if s <= more else low - 1 for s in range(m)]  # they plus one each sum to over the radius
        words = query.view(np.uint64)
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
        for s, reach in enumerate(reaches):
            if reach < 0 or not len(self.code) or not len(query):
                continue
            q, row = self.probe(s, query, reach)
            for t in range(s):  # a pair counts where it meets first
                fresh = np.bitwise_count(query[q, t] ^ self.code[row, t]) > reaches[t]
                q, row = q[fresh], row[fresh]
            self.examined += len(q)
            distance = np.zeros(len(q), np.int64)
            for w in range(words.shape[1]):
                distance += np.bitwise_count(words[q, w] ^ self.words[row, w])
            hit = distance <= radius
            for column, v in zip(out, (q[hit], row[hit], distance[hit])):
                column.append(v)
        return tuple(np.concatenate(c) for c in out)


def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best rows of each query: largest scores, ties to smaller ids."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores, distance = q[order], ids[order], scores[order], distance[order]
    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    top = rank < k
    return q[top], ids[top], scores[top], distance[top]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


FOUND = "query_id long, vec_id long, score double, distance long, examined long"


def _search(rows: DataFrame, queries: DataFrame, rotation: np.ndarray, norm: float, d: int, radius: int, k: int, sizes: tuple[int, int]) -> DataFrame:
    """The k best within radius of each query and block of rows, with the number of rows that the probes led to.

    Rows and queries (sizes: how many) are dealt to blocks by their ids; each block of rows meets each block of queries in a
    task of its own, which holds no more than the two. Neither passes through the driver.
    """
    row_blocks, query_blocks = (max(1, -(-n // size)) for n, size in zip(sizes, (ROW_BLOCK, QUERY_BLOCK)))
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "vector", block(row_blocks, 3).alias("rb"), spread(query_blocks).alias("qb"))
    right = queries.select("id", "vector", block(query_blocks, 4).alias("qb"), spread(row_blocks).alias("rb"))

    def run(mine: pa.Table, asking: pa.Table) -> pa.Table:
        own, x = mine.column("id").to_numpy(), _matrix(mine.column("vector").combine_chunks(), d)
        ids, vectors = asking.column("id").to_numpy(), _matrix(asking.column("vector").combine_chunks(), d)
        index, code = Index(codes(augmented(x, norm), rotation), rotation.shape[1] // 16), codes(asked(vectors), rotation)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))]
        for at in range(0, len(ids), 32):
            before = index.examined
            q, row, distance = index.within(code[at : at + 32], radius)
            q = q + at
            other = ids[q] != own[row]
            q, row, distance = q[other], row[other], distance[other]
            scores = [np.einsum("ij,ij->i", vectors[q[i : i + 50_000]], x[row[i : i + 50_000]]) for i in range(0, len(q), 50_000)]
            top = best(q, own[row], np.concatenate(scores) if scores else np.empty(0), distance, k)
            share = (index.examined - before) // max(min(32, len(ids) - at), 1)
            out.append((ids[top[0]], *top[1:], np.full(len(top[0]), share)))
        return pa.table([np.concatenate(c) for c in zip(*out)], names=["query_id", "vec_id", "score", "distance", "examined"])

    return left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, within: float = WITHIN) -> DataFrame:
    """query_id, rank, vec_id, score, examined: the k largest inner products found for each query, in double precision.

    vectors, queries: id long, vector array<float or double>. A candidate is any row with another id than the
    query's. Rows with a null id or vector, zero vectors, vectors with null or non-finite components, or of
    another length than most take no part. Rows that repeat an id and its vector are one; of vectors that share an
    id each is a candidate, and the smallest asks. Ties go to smaller ids. Fewer than k candidates give all of
    them; no queries or no vectors give an empty result. Columns beside these two are ignored.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, examined long")

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("vector").cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col("id").cast("long").alias("id"), v.alias("vector")).filter(F.col("id").isNotNull() & v.isNotNull() & fine)

    rows = materialize(usable(vectors).distinct())
    d_row = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if d_row is None:
        return empty
    d = d_row["d"]
    rows = rows.filter(F.size("vector") == d)
    asking = materialize(usable(queries).filter(F.size("vector") == d).groupBy("id").agg(F.min("vector").alias("vector")))
    norm = float(rows.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]) * (1 + 1e-12)
    sample = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(FIT_ROWS).toArrow().combine_chunks()
    rotation = learn(augmented(_matrix(sample.column(1).combine_chunks(), d), norm))
    everything = rotation.shape[1] + 64
    sizes = d_row["count"], asking.count()
    if not sizes[1]:
        return empty

    few = asking.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION)
    true = _ranked(_search(rows, few, rotation, norm, d, everything, k, (sizes[0], CALIBRATION)), k)
    radius = int(true.agg(F.percentile("distance", F.lit(within))).first()[0] or 0) + 1

    found = materialize(_ranked(_search(rows, asking, rotation, norm, d, radius, k, sizes), k))
    complete = found.groupBy("query_id").count().filter(F.col("count") >= k)
    short = materialize(asking.join(complete, F.col("id") == F.col("query_id"), "left_anti"))
    n_short = short.count()
    if n_short:
        again = _ranked(_search(rows, short, rotation, norm, d, everything, k, (sizes[0], n_short)), k)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "examined")
