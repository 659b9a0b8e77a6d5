"""The scorecard of a repository.

Input is one wide row per repository (`repo_facts`): file profile, complexity,
stack flags and developer shares. Scores are plain arithmetic on that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.scalars import clamp


def _flag(cond: Column, points: float) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(float(points))).otherwise(F.lit(0.0))


def _rounded(score: Column) -> Column:
    return F.bround(clamp(score), 1)


def code_quality() -> Column:
    """R1."""
    large = F.least(F.col("files_above_threshold") * 5, F.lit(30)).cast("double")
    functions = F.least(F.col("functions_above_threshold") * 3, F.lit(20)).cast("double")
    return _rounded(
        F.lit(100.0)
        - large
        - functions
        - _flag(F.col("avg_file_loc") > 300, 10)
        + _flag(F.size("linters") > 0, 10)
        + _flag(F.size("formatters") > 0, 5)
    )


def test_ratio() -> Column:
    tests = F.col("file_count_test")
    return F.coalesce(F.try_divide(tests, F.col("file_count_source") + tests), F.lit(0.0))


def test_quality() -> Column:
    """R2."""
    ratio = test_ratio()
    bonus = F.when(ratio >= 0.3, 30.0).when(ratio >= 0.15, 15.0).when(ratio >= 0.05, 5.0).otherwise(0.0)
    return _rounded(F.when(F.col("file_count_test") > 0, F.lit(50.0) + bonus).otherwise(F.lit(0.0)))


def doc_quality() -> Column:
    """75 points at most, scaled to 100."""
    points = (
        _flag(F.col("has_readme"), 20)
        + _flag(F.col("has_install_docs"), 15)
        + _flag(F.col("has_architecture_docs"), 15)
        + _flag(F.col("has_changelog"), 15)
        + _flag(F.col("has_runbook"), 10)
    )
    return _rounded(points / F.lit(75.0) * F.lit(100.0))


def delivery_quality() -> Column:
    """R4."""
    return _rounded(
        _flag(F.col("ci_provider").isNotNull(), 40)
        + _flag(F.col("has_docker"), 30)
        + _flag(F.col("has_kubernetes") | F.col("has_helm") | F.col("has_terraform"), 20)
    )


def maintainability() -> Column:
    """R5."""
    developers = F.coalesce(F.col("developers"), F.lit(0))
    return _rounded(
        F.lit(60.0)
        + F.when(developers == 1, -20.0).when(developers >= 3, 10.0).otherwise(0.0)
        + F.when(F.col("top1_share") > 0.80, -20.0).when(F.col("top1_share") > 0.60, -10.0).otherwise(0.0)
        - _flag(F.col("files_above_threshold") > 10, 10)
        + _flag(F.col("file_count_test") > 0, 10)
    )


DOMAINS = {
    "code_quality": code_quality,
    "test_quality": test_quality,
    "doc_quality": doc_quality,
    "delivery_quality": delivery_quality,
    "maintainability": maintainability,
}


def score_columns(repo_facts: DataFrame, key: str = "repo_id") -> DataFrame:
    """R1-R6 as columns."""
    scored = repo_facts.select(key, *[make().alias(name) for name, make in DOMAINS.items()])
    weighted = None
    for name, weight in dims.SCORE_WEIGHTS.items():
        term = F.col(name) * F.lit(weight)
        weighted = term if weighted is None else weighted + term
    return scored.withColumn("overall", F.bround(weighted, 1))


def scorecard(repo_facts: DataFrame, key: str = "repo_id") -> DataFrame:
    """Six rows per repository (domain, score)."""
    wide = score_columns(repo_facts, key)
    domains = [c for c in wide.columns if c != key]
    return wide.unpivot([key], domains, "domain", "score")
