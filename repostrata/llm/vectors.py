"""Shared by the two vector searches: usable vectors, and rows dealt to shards and queries
streamed against each shard's index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow


def usable(embeddings: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v) of the rows whose vector is neither null, empty nor zero and whose
    components are all finite numbers."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.where(F.col(vec_id).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(
        F.col(vec_id).cast("long").alias("id"), v.cast("array<float>").alias("v")
    )


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows in double precision, on the vectors as they are given."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def against_shards(
    points: DataFrame, queries: DataFrame, shards: int,
    work: Callable[[int, dict[str, np.ndarray], Iterator[dict[str, np.ndarray]]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """Run every query against every shard.

    `points` (id, v, d = dimensions, w = a number of the caller's) are dealt to shards by hash; `queries` of the same
    columns go to all. A task gets its shard's points first and then its queries batch by
    batch, so that it holds one shard and one batch. `work` gets the shard's number, its
    points and the batches of queries. Vectors of different dimensions never meet.
    """

    def own(df: DataFrame, kind: int, shard) -> DataFrame:
        return df.select("d", shard.alias("shard"), F.lit(kind).alias("kind"), "id", "w", "v")

    dealt = own(points, 0, F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).unionByName(
        own(queries, 1, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    placed = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "d", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
            """Batches cut where shard, dimensions or kind change."""
            for batch in batches:
                marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "d", "kind")])
                ends = [*(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1), batch.num_rows]
                for start, end in zip([0, *ends[:-1]], ends, strict=True):
                    if end > start:
                        yield tuple(int(x) for x in marks[:, start]), batch.slice(start, end - start)

        def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "w")} | {"v": matrix(batch.column("v"))}

        stream = parts()
        ahead = next(stream, None)
        while ahead is not None:
            group = ahead[0][:2]
            held, waiting = [], []
            while ahead is not None and ahead[0] == (*group, 0):
                held.append(arrays(ahead[1]))
                ahead = next(stream, None)

            def asked() -> Iterator[dict[str, np.ndarray]]:
                nonlocal ahead
                while ahead is not None and ahead[0] == (*group, 1):
                    now = arrays(ahead[1])
                    ahead = next(stream, None)
                    yield now

            if held:
                whole = {c: np.concatenate([h[c] for h in held]) for c in ("id", "w", "v")}
                yield from work(group[0], whole, asked())
            for _ in asked():
                pass

    return map_arrow(placed, run, schema)


def first_of_equal(points: DataFrame, keep: int) -> DataFrame:
    """(id, v) without all but the `keep` smallest ids of bit-equal vectors."""
    order = Window.partitionBy("v").orderBy("id")
    return points.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).drop("_r")
