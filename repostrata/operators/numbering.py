"""Ranks over a whole table without one task that sees it all.

Rows are dealt to key ranges; each range is counted, and prefix sums of the counts tell
where its ranks begin. A task sorts its own range only. The dealt rows are stored, so that
every later read sees the same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Pages that end before this row are cheaper as a top-k.
SHALLOW = 10_000


def _ranges(df: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The rows with the number of their range, and (range, rows, rows of those before)."""
    placed = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    return placed, counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0).cast("long")))


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """With the rank of each row in the order, from `start` + 1, without gaps. Where the order
    is total, reruns agree."""
    placed, bases = _ranges(df, order)
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.withColumn("_inside", inside).join(bases, "_range").select(
        *[F.col(f"`{c}`") for c in df.columns], (F.lit(start).cast("long") + F.col("_before") + F.col("_inside")).alias(name)
    )


def page(df: DataFrame, order: list[Column], offset: int, limit: int, shallow: int = SHALLOW) -> DataFrame:
    """Rows `offset` + 1 to `offset` + `limit` in the order, sorted.

    A page near the front is a top-k. Beyond `shallow` only the ranges that the page touches
    are sorted, and no task holds more than its range, however deep the page lies.
    """
    if offset + limit <= shallow:
        return df.orderBy(*order).offset(offset).limit(limit)
    placed, bases = _ranges(df, order)
    touched = bases.filter((F.col("_before") < offset + limit) & (F.col("_before") + F.col("_rows") > offset))
    first = {r["_range"]: r["_before"] for r in touched.collect()}  # ranges of one page
    if not first:
        return df.limit(0)
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    before = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    ranked = placed.filter(F.col("_range").isin(*first)).withColumn("_rank", before[F.col("_range")] + inside)
    chosen = ranked.filter((F.col("_rank") > offset) & (F.col("_rank") <= offset + limit))
    return chosen.orderBy("_rank").select(*[F.col(f"`{c}`") for c in df.columns])
