"""A27-A29 kept up to date: each step folds only the commits that arrived since the last one.

A step writes what the new commits add: sums per repository, user and day (with the first
spelling seen), per language and per module. These rows merge by sum, minimum and maximum, so
the results of the whole history come from the steps' rows, and no commit is read twice.

The commits table is partitioned by `arrival`, a number that only grows. The mark is the last
arrival that was folded; the filter on arrivals above it prunes the folders of all others, so a
step reads what is new. Steps lie in folders named by their mark. A step that is lost on the way
leaves no mark and is written over by its rerun; `merge_steps` folds many into one.
"""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from . import contributions as co

PARTS = {"days": [*co.USER, "day"], "languages": [*co.USER, "language"], "modules": [*co.USER, "module"]}
MARKS = "step long, since long"


def steps(spark: SparkSession, store: str) -> list[tuple[int, int]]:
    """The steps as (mark, mark before), oldest first, that cover every folded arrival once."""
    try:
        marks = spark.read.schema(MARKS).parquet(f"{store}/marks").collect()  # one row a step
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    since: dict[int, int] = {}
    for r in marks:  # a merged step goes back further than the one it replaces
        since[r["step"]] = min(r["since"], since.get(r["step"], r["since"]))
    found, at = [], max(since, default=0)
    while at:
        found.append((at, since[at]))
        at = since[at]
    return found[::-1]


def mark(spark: SparkSession, store: str) -> int:
    """The last arrival that was folded, 0 for none."""
    return max((step for step, _ in steps(spark, store)), default=0)


def _write(rows: dict[str, DataFrame], spark: SparkSession, store: str, step: int, since: int) -> None:
    for name, part in rows.items():
        part.write.mode("overwrite").parquet(f"{store}/{name}/{step}-{since}")
    # written last: a step without its mark doesn't count
    done = spark.createDataFrame([(step, since)], MARKS).coalesce(1)
    done.write.mode("append").parquet(f"{store}/marks")


def fresh(commits: DataFrame, since: int) -> DataFrame:
    """Commits that arrived after `since`."""
    return commits.filter(F.col("arrival") > since)


def fold(commits: DataFrame, store: str, overrides: DataFrame | None = None) -> int:
    """Add the commits that arrived since the last step; returns the new mark.

    `commits` holds every arrival, each commit once; null and non-positive arrivals are
    refused by the filter. Without new commits nothing is written.
    """
    spark = commits.sparkSession
    since = mark(spark, store)
    new = fresh(commits, since)
    until = new.agg(F.max("arrival")).first()[0]
    if until is None:
        return since
    new = new.filter(F.col("arrival") <= until).drop("arrival")  # what arrives meanwhile is the next step's
    days = co.day_sums(new, overrides).withColumn("age", F.lit(-until).cast("long"))
    languages = co.change_sums(new, F.col("language"), "language", overrides)
    modules = co.change_sums(new, paths.top_module(F.col("path")), "module", overrides)
    _write({"days": days, "languages": languages, "modules": modules}, spark, store, until, since)
    return until


def merged(spark: SparkSession, store: str, name: str) -> DataFrame:
    """`days`, `languages` or `modules` over all steps, one row per key."""
    parts = [spark.read.parquet(f"{store}/{name}/{step}-{since}") for step, since in steps(spark, store)]
    if not parts:
        raise ValueError(f"no step was folded into {store}")
    rows = functools.reduce(DataFrame.unionByName, parts)
    found = [F.sum(c).alias(c) for c in rows.columns if c not in {*PARTS[name], "first", "last", "who", "age", "seq"}]
    if name != "days":
        return rows.groupBy(*PARTS[name]).agg(*found)
    # logs list the newest commit first, so what arrived later comes before
    seen = F.struct("age", "seq")
    found += [F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("who", seen).alias("who"), F.min(seen).alias("_seen")]
    return rows.groupBy(*PARTS[name]).agg(*found).select("*", "_seen.*").drop("_seen")


def merge_steps(spark: SparkSession, store: str) -> None:
    """Replace the steps by one, so that readers meet one row per key; old folders may be deleted."""
    if len(steps(spark, store)) > 1:
        _write({name: merged(spark, store, name) for name in PARTS}, spark, store, mark(spark, store), 0)


def contributions(spark: SparkSession, store: str) -> DataFrame:
    """A27, W7 over all arrivals folded so far."""
    return co.user_stats(merged(spark, store, "days").withColumn("seq", F.struct("age", "seq")))


def language_contributions(spark: SparkSession, store: str, head_languages: DataFrame | None = None) -> DataFrame:
    """A28 over all arrivals folded so far."""
    return co.language_stats(merged(spark, store, "languages"), head_languages)


def module_contributions(spark: SparkSession, store: str) -> DataFrame:
    """A29 over all arrivals folded so far."""
    return co.module_stats(merged(spark, store, "modules"))
