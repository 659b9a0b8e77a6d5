"""Nearest neighbours by low-dimensional stable projections under a kd-tree.

Unit vectors are projected on a few Gaussian directions; the projected squared distance
of two vectors, over their true one, follows a chi-square law of that many degrees. Each
shard holds a kd-tree of its projected points. A query takes its leaves in the order of
projected distance, verifies their vectors by exact cosine, and stops when the law says that
a vector nearer than the k-th best so far would, with probability CONFIDENCE, have come up
already. The shards' answers are merged.

Of bit-equal vectors only the k + 1 smallest ids are indexed: with ties to the smaller id
no other can be among a query's k nearest. Scores are cosines in double precision on the
vectors as given.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, neither as queries nor as candidates; vectors of other dimensions are no
candidates; with fewer than k candidates all are returned; an id given twice is one
candidate per row and never its own; an empty table gives an empty result; other columns
of the input are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store
from .vectors import against_shards, cosine, first_of_equal, usable

NEAREST = 5
DIMENSIONS = 8
CONFIDENCE = 0.97
LEAF = 64
SHARD_ROWS = 200_000
LEAST_SHARDS = 6
SEED = 5
FOUND = "query_id long, vec_id long, score double"


def chi_square(x: np.ndarray | float, degrees: int) -> np.ndarray | float:
    """The distribution function for an even number of degrees of freedom."""
    half, term, total = np.asarray(x) / 2, 1.0, 1.0
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


class Tree:
    """A kd-tree over rows, split at medians of the widest dimension; equal rows are split
    by position, so a leaf never holds more than LEAF of them."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.leaves: list[tuple[int, int]] = []
        self._split(0, len(points))
        self.low = np.stack([points[self.order[a:b]].min(0) for a, b in self.leaves])
        self.high = np.stack([points[self.order[a:b]].max(0) for a, b in self.leaves])

    def _split(self, start: int, end: int) -> None:
        if end - start <= LEAF:
            self.leaves.append((start, end))
            return
        own, middle = self.points[self.order[start:end]], (end - start) // 2
        by = np.argpartition(own[:, int(np.argmax(own.max(0) - own.min(0)))], middle)
        self.order[start:end] = self.order[start:end][by]
        self._split(start, start + middle)
        self._split(start + middle, end)

    def nearest_first(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Rows by leaf, nearest boxes first, a few leaves and then twice as many at a time:
        no later row is nearer, by squared distance, than the bound given with them."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        distance = (gap * gap).sum(1)
        order = np.argsort(distance, kind="stable")
        at, many = 0, 4
        while at < len(order):
            rows = np.concatenate([self.order[slice(*self.leaves[leaf])] for leaf in order[at : at + many]])
            at, many = at + many, many * 2
            yield float(distance[order[at]]) if at < len(order) else np.inf, rows


def search(tree: Tree, unit: np.ndarray, ids: np.ndarray, vectors: np.ndarray, q_id: int, q: np.ndarray,
           directions: np.ndarray, k: int, confidence: float) -> list[tuple[float, int]]:
    """The k best (minus cosine, id) of one shard for one query."""
    best: list[tuple[float, int]] = []
    unit_q = q.astype(np.float64) / np.linalg.norm(q.astype(np.float64))
    for bound, rows in tree.nearest_first(unit_q @ directions):
        rows = rows[ids[rows] != q_id]
        if len(rows):
            near = unit[rows] @ unit_q
            floor = -best[-1][0] - 1e-9 if len(best) == k else -2.0
            rows = rows[near >= floor]
            exact = cosine(vectors[rows], np.broadcast_to(q, (len(rows), len(q))))
            best = sorted([*best, *zip((-exact).tolist(), ids[rows].tolist(), strict=True)])[:k]
        if len(best) == k and np.isfinite(bound):
            # squared distance of unit vectors from their cosine
            reach = max(2 * (1 + best[-1][0]), 1e-12)
            if chi_square(bound / reach, directions.shape[1]) > confidence:
                break
    return best


def nearest(embeddings: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding",
            k: int = NEAREST, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest; `is_query` is a
    condition on the column `id`."""
    points = store(usable(embeddings, vec_id, vector).withColumn("d", F.size("v")).withColumn("w", F.lit(1).cast("long")), "vectors")
    count = points.count()
    shards = max(LEAST_SHARDS, -(-count // SHARD_ROWS))

    def work(shard: int, held: dict[str, np.ndarray], asked: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        vectors, ids = held["v"], held["id"]
        unit = vectors.astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        directions = np.random.default_rng(SEED).standard_normal((vectors.shape[1], dimensions))
        tree = Tree(unit @ directions)
        for batch in asked:
            out = [
                (int(q_id), found, -minus)
                for q_id, q in zip(batch["id"], batch["v"], strict=True)
                for minus, found in search(tree, unit, ids, vectors, q_id, q, directions, k, confidence)
            ]
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])

    found = against_shards(first_of_equal(points, k + 1), points.where(is_query).dropDuplicates(["id"]), shards, work, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
