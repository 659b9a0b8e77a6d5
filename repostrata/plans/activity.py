"""Activity calendars and inactivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.scalars import elapsed_days, inactivity_score
from ..operators.latest import PR


def activity(repository_daily: DataFrame, prs: DataFrame) -> DataFrame:
    """A7-A9 at once: commits per day in all, per project and per repository.

    GROUPING SETS give the three levels from one read and one shuffle.
    """
    repos = prs.select(F.col("id").alias(PR), "project_id")
    rows = repository_daily.join(repos, PR)
    d, p, r = F.col("commit_date"), F.col("project_id"), F.col(PR)
    level = (
        F.when(F.grouping("project_id") == 1, "all")
        .when(F.grouping(PR) == 1, "project")
        .otherwise("repository")
    )
    return rows.groupingSets([[d], [p, d], [p, r, d]], d, p, r).agg(
        level.alias("level"), F.sum("commit_count").alias("commit_count")
    )


def activity_all(repository_daily: DataFrame) -> DataFrame:
    """A7."""
    return repository_daily.groupBy("commit_date").agg(F.sum("commit_count").alias("commit_count"))


def activity_project(repository_daily: DataFrame, prs: DataFrame) -> DataFrame:
    """Every project."""
    repos = prs.select(F.col("id").alias(PR), "project_id")
    return repository_daily.join(repos, PR).groupBy("project_id", "commit_date").agg(
        F.sum("commit_count").alias("commit_count")
    )


def activity_repository(repository_daily: DataFrame) -> DataFrame:
    """Stored rows, every repository."""
    return repository_daily.select(PR, "commit_date", "commit_count")


def calendar(daily: DataFrame, key: str, as_of: str) -> DataFrame:
    """The days of the last year and the largest count of the entity."""
    today = F.lit(as_of).cast("date")
    year = daily.filter((F.col("commit_date") >= F.add_months(today, -12)) & (F.col("commit_date") <= today))
    peak = daily.groupBy(key).agg(F.max("commit_count").alias("max_count"))
    return year.join(peak, key).select(key, "commit_date", "commit_count", "max_count")


def recent_commits(daily: DataFrame, key: str, as_of: str) -> DataFrame:
    """Commits in the last 90 days."""
    cutoff = F.date_sub(F.lit(as_of).cast("date"), dims.INACTIVITY_WINDOW_DAYS)
    inside = F.when(F.col("commit_date") >= cutoff, F.col("commit_count")).otherwise(F.lit(0))
    return daily.groupBy(key).agg(F.sum(inside).alias("recent_commits"))


def _status(score: Column, days: Column, tagged: Column, threshold: float, min_days: int,
            untag_active: bool) -> Column:
    inactive = (score >= threshold) & (days >= min_days)
    status = F.when(inactive, "inactive")
    if untag_active:
        status = status.when(tagged, "untagged")
    return status.when(score >= dims.BORDERLINE_SCORE, "borderline").otherwise("active")


def repository_span(repository_daily: DataFrame, as_of: str) -> DataFrame:
    """Span and recent commits of each repository in one aggregate."""
    cutoff = F.date_sub(F.lit(as_of).cast("date"), dims.INACTIVITY_WINDOW_DAYS)
    inside = F.when(F.col("commit_date") >= cutoff, F.col("commit_count")).otherwise(F.lit(0))
    return repository_daily.groupBy(PR).agg(
        F.min("commit_date").alias("first_date"),
        F.max("commit_date").alias("last_date"),
        F.count("commit_date").alias("active_days"),
        F.sum("commit_count").alias("commit_count"),
        F.sum(inside).alias("recent_commits"),
    )


def _day(c: Column) -> Column:
    return F.unix_date(c).cast("long")


def inactive_repositories(repository_daily: DataFrame, tags: DataFrame, as_of: str, threshold: float = dims.INACTIVITY_THRESHOLD,
                          min_days: int = 90, untag_active: bool = False) -> DataFrame:
    """Score, days since the last commit and status of each repository.

    `tags` holds (project_repository_id, tag); repositories without commits are left out.
    """
    span = repository_span(repository_daily, as_of).filter(F.col("commit_count") != 0)
    today = _day(F.lit(as_of).cast("date"))
    first, last = _day(F.col("first_date")), _day(F.col("last_date"))
    score = inactivity_score(
        today - last, last - first, today - first, F.greatest("active_days", F.lit(1)),
        F.col("commit_count"), F.col("recent_commits"),
    )
    tagged = tags.filter(F.col("tag") == dims.INACTIVE_TAG).select(PR).distinct().withColumn("tagged", F.lit(True))
    scored = (
        span.withColumn("score", score)
        .withColumn("days_since_last", today - _day(F.col("last_date")))
        .join(tagged, PR, "left")
        .withColumn("tagged", F.coalesce("tagged", F.lit(False)))
    )
    return scored.select(
        PR, "score", "days_since_last", "last_date",
        _status(F.col("score"), F.col("days_since_last"), F.col("tagged"), threshold, min_days, untag_active).alias("status"),
    )


def inactive_developers(contribs: DataFrame, profiles: DataFrame, developer_daily: DataFrame, tags: DataFrame,
                        as_of: str, threshold: float = dims.INACTIVITY_THRESHOLD, min_days: int = 30,
                        untag_active: bool = False) -> DataFrame:
    """The same for developers, from contributions (elapsed days) and daily rows."""
    keys = profiles.select(F.col("id").alias("profile_id"), "developer_id")
    stats = (
        contribs.join(keys, "profile_id")
        .groupBy("developer_id")
        .agg(
            F.min("first_commit_at").alias("first_commit_at"),
            F.max("last_commit_at").alias("last_commit_at"),
            F.sum("active_days").alias("active_days"),
            F.sum("commit_count").alias("commit_count"),
        )
        .filter(F.col("last_commit_at").isNotNull() & (F.col("commit_count") != 0))
    )
    recent = recent_commits(developer_daily.join(keys, "profile_id"), "developer_id", as_of)
    now = F.lit(as_of).cast("timestamp")
    first, last = F.col("first_commit_at"), F.col("last_commit_at")
    since_last = elapsed_days(last, now)
    active = F.when(F.coalesce(F.col("active_days"), F.lit(0)) == 0, 1).otherwise(F.col("active_days"))
    score = inactivity_score(
        since_last, elapsed_days(first, last), elapsed_days(first, now), active,
        F.col("commit_count"), F.coalesce("recent_commits", F.lit(0)),
    )
    tagged = tags.filter(F.col("tag") == dims.INACTIVE_TAG).select("developer_id").distinct().withColumn("tagged", F.lit(True))
    scored = (
        stats.join(recent, "developer_id", "left")
        .withColumn("score", score)
        .withColumn("days_since_last", since_last)
        .join(tagged, "developer_id", "left")
        .withColumn("tagged", F.coalesce("tagged", F.lit(False)))
    )
    return scored.select(
        "developer_id", "score", "days_since_last", last.cast("date").alias("last_date"),
        _status(F.col("score"), F.col("days_since_last"), F.col("tagged"), threshold, min_days, untag_active).alias("status"),
    )


def tags_after(tags: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """Tags once the decisions are applied: inactive added, untagged removed."""
    dropped = decided.filter(F.col("status") == "untagged").select(key, F.lit(dims.INACTIVE_TAG).alias("tag"))
    added = decided.filter(F.col("status") == "inactive").select(key, F.lit(dims.INACTIVE_TAG).alias("tag"))
    return tags.select(key, "tag").join(dropped, [key, "tag"], "left_anti").unionByName(added).distinct()
