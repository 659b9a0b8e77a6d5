"""Differences between pairs of scans.

`pairs` holds (scan_a, scan_b) rows, so any number of comparisons is one job.
The pairs are exploded to one row per side, joined to the facts once, and the two sides
of a key meet in one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PAIR = ["scan_a", "scan_b"]


def _matched(rows: DataFrame, pairs: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Pairs and keys with the values of either side as structs `a` and `b`, null where missing.

    A key has a row or two in a pair, which a partial sum wouldn't shrink: a window needs no table
    of them all in memory, only a sort.
    """
    sides = pairs.select(
        *PAIR,
        F.inline(F.array(*[F.struct(F.col(s).alias("scan_id"), F.lit(s == "scan_a").alias("_a")) for s in PAIR])),
    )
    met = sides.join(rows.select("scan_id", key, *values).where(F.col(key).isNotNull()), "scan_id")
    of = {"a": F.col("_a"), "b": ~F.col("_a")}
    order = W.partitionBy(*PAIR, key).orderBy("_a")
    group = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    both = met.select(
        *PAIR, key,
        F.row_number().over(order).alias("_n"),
        *[F.max(own).over(group).alias(f"_has_{side}") for side, own in of.items()],
        *[F.max(F.when(own, F.col(v))).over(group).alias(f"_{side}_{v}") for side, own in of.items() for v in values],
    ).where(F.col("_n") == 1)
    return both.select(
        *PAIR, key,
        *[F.when(F.col(f"_has_{s}"), F.struct(F.lit(True).alias("there"), *[F.col(f"_{s}_{v}").alias(v) for v in values])).alias(s) for s in of],
    )


def metrics_diff(scans: DataFrame, pairs: DataFrame) -> DataFrame:
    """b - a, null when either is null."""
    names = ["total_files", "total_loc", "size_bytes"]
    a = scans.select(F.col("id").alias("scan_a"), *[F.col(n).alias(f"a_{n}") for n in names])
    b = scans.select(F.col("id").alias("scan_b"), *[F.col(n).alias(f"b_{n}") for n in names])
    return pairs.join(a, "scan_a").join(b, "scan_b").select(
        *PAIR, *[(F.col(f"b_{n}") - F.col(f"a_{n}")).alias(f"{n}_delta") for n in names]
    )


def language_diff(scan_languages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Added, removed and changed languages; equal line counts give no row."""
    m = _matched(scan_languages, pairs, "language", ["loc", "percentage"])
    change = (
        F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").otherwise("changed")
    )
    delta = F.when(F.col("a").isNull(), F.col("b.loc")).otherwise(F.col("b.loc") - F.col("a.loc"))
    percent = F.when(F.col("a").isNull(), F.col("b.percentage")).otherwise(
        F.bround(F.col("b.percentage") - F.col("a.percentage"), 2)
    )
    return m.select(
        *PAIR, "language", change.alias("change"), delta.alias("loc_delta"), percent.alias("percentage_delta")
    ).filter((F.col("change") != "changed") | (F.col("loc_delta") != 0))


def score_diff(scan_scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Missing scores count as 0."""
    m = _matched(scan_scores, pairs, "domain", ["score"])
    a, b = F.coalesce("a.score", F.lit(0.0)), F.coalesce("b.score", F.lit(0.0))
    return m.select(
        *PAIR, "domain", a.alias("score_a"), b.alias("score_b"), F.bround(b - a, 1).alias("delta")
    )


def risk_diff(scan_risks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Risk types only in b are new, only in a resolved; the last row gives the title."""
    compared = pairs.select(F.explode(F.array("scan_a", "scan_b")).alias("scan_id")).distinct()
    last = scan_risks.join(compared, "scan_id", "left_semi").groupBy("scan_id", "risk_type").agg(
        F.max(F.struct("id", "title", "severity")).alias("_r")
    ).select("scan_id", "risk_type", "_r.title", "_r.severity")
    m = _matched(last, pairs, "risk_type", ["title", "severity"])
    only_b = F.col("a").isNull()
    kept = F.coalesce("a", "b")
    return m.filter(only_b | F.col("b").isNull()).select(
        *PAIR,
        "risk_type",
        kept["title"].alias("title"),
        kept["severity"].alias("severity"),
        F.when(only_b, "new").otherwise("resolved").alias("change"),
    )


def developer_diff(contribs: DataFrame, profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """User names only in b joined, only in a left."""
    names = contribs.select("scan_id", F.col("profile_id").alias("id")).join(
        profiles.select("id", "canonical_username"), "id"
    ).select("scan_id", "canonical_username")
    m = _matched(names, pairs, "canonical_username", [])
    return m.filter(F.col("a").isNull() | F.col("b").isNull()).select(
        *PAIR,
        "canonical_username",
        F.when(F.col("a").isNull(), "joined").otherwise("left").alias("change"),
    )
