"""Helpers of the training-data operators: shared storage, running totals, components, buckets."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_local_folder: list[str] = []
#: Whether files of shuffles go with the query that wrote them.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; all executors and the driver see it.

    Only a local session, whose executors are this process, gets a folder of its own
    where the setting is missing. Anything else fails rather than lose rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="repostrata-llm-"))
    return _local_folder[0]


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What a write in here shuffles leaves the disk as the write ends. Nobody reads it again, as the table
    is read instead, and otherwise it stays until the driver happens to collect its plans."""
    before = spark.conf.get(FILES_GO, None)
    spark.conf.set(FILES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(FILES_GO) if before is None else spark.conf.set(FILES_GO, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, so a lost
    executor costs at most the tasks it was running."""
    path = new_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """The same in buckets of a column: groups and joins by it leave the table where it lies."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)


def _ship(spark: SparkSession) -> None:
    """Give Python workers this package where they can't import it yet: a session that
    runs from a source tree sends it once, as spark-submit's --py-files would."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, name = os.path.split(package)
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    archive = f"{name}-{spark.sparkContext.applicationId}.zip"
    if root in known or not os.path.isdir(package) or archive in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="repostrata-code-"), archive)
    with zipfile.ZipFile(path, "w") as out:
        for folder in (package, os.path.join(package, "llm")):
            for file in sorted(f for f in os.listdir(folder) if f.endswith(".py")):
                out.write(os.path.join(folder, file), os.path.relpath(os.path.join(folder, file), root))
    spark.sparkContext.addPyFile(path)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """`mapInArrow` with this package at hand in the workers."""
    _ship(df.sparkSession)
    return df.mapInArrow(work, schema)


def all_of(df: DataFrame) -> list[Column]:
    """All columns by name, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def crc32_of_id(column: Column) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(column.cast("string").cast("binary"))


def running_totals(df: DataFrame, order: list[str], totals: dict[str, str]) -> DataFrame:
    """Inclusive running totals over the whole table in the given order.

    The rows are range-partitioned and sorted; each partition adds the totals of those
    before it, so no task sees more than its own range and one row per partition.
    """
    placed = store(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = placed.groupBy("_part").agg(*[F.sum(v).alias(f"_sum_{t}") for t, v in totals.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(
        "_part", *[F.coalesce(F.sum(f"_sum_{t}").over(earlier), F.lit(0)).alias(f"_base_{t}") for t in totals]
    )
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(base, "_part").select(
        *all_of(df), *[(F.col(f"_base_{t}") + F.sum(v).over(upto)).alias(t) for t, v in totals.items()]
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b), as (id, component = smallest id).

    Alternating large-star and small-star steps; every step is a grouped minimum with
    map-side combine and an equi-join, and is stored, so neither hubs nor long chains
    meet in one task. Rows with a null end or with a = b carry no connection: ids that
    have no other edge do not appear in the result.
    """
    now = store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    seen = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a")
        now = store(
            moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct(),
            "edges",
        )
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def bucket_links(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    near: Callable[[Column, Column], Column] | None = None,
    across: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Links (a, b) that connect all that any verified pair of a common bucket connects.

    `members` has (key, id), each pair once. First each member meets the smallest of its
    bucket. Then, in buckets of three and more that still hold several components, every
    member outside the bucket's largest component meets the members of other components.
    A pair inside one component would add nothing, so components come out as if all pairs
    had been verified, while a large group of copies costs only one pair per member.
    `near(a, b)` is a condition on two ids that every link meets; `verify` reduces pairs
    (a, b), a < b, each once, to the links among them. `across`, where given, takes the
    second step over: from the mixed buckets (key, id, component, major) to links.
    """

    def checked(pairs: DataFrame) -> DataFrame:
        if near is not None:
            pairs = pairs.where(near(F.col("a"), F.col("b")))
        once = store(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        return once if once.isEmpty() else store(verify(once), "links")

    dealt = members.repartition("key")  # one exchange for the count and for the join with it
    heads = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("head")).where("n > 1")
    crowded = store(dealt.join(heads, "key"), "crowded")
    links = checked(crowded.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")))
    parts = components(links)
    labelled = crowded.where("n > 2").select("key", "id").join(parts, "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    major = sizes.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("parts")
    ).where("parts > 1").select("key", "major")
    mixed = store(labelled.join(major, "key"), "mixed")
    if mixed.isEmpty():
        return links
    if across is not None:
        return links.unionByName(store(across(mixed), "links"))
    others = mixed.select("key", F.col("id").alias("b"), F.col("component").alias("other"))
    more = mixed.where("component <> major").select("key", F.col("id").alias("a"), "component").join(others, "key").where(
        "component <> other"
    )
    return links.unionByName(checked(more.select("a", "b")))
