"""Merging a new snapshot into kept tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered


def git_tags_merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Tags of the repositories in `incoming`, labelled by what happened.

    `change` is updated, inserted or deleted; a deleted row shows its old values.
    Repositories without incoming tags do not appear.
    """
    key = ["repository_id", "name"]
    values = [c for c in incoming.columns if c not in key]
    old = existing.join(incoming.select("repository_id").distinct(), "repository_id", "left_semi")
    joined = (
        old.select(*key, F.struct(*values).alias("old"))
        .join(incoming.select(*key, F.struct(*values).alias("new")), key, "full")
    )
    change = (
        F.when(F.col("new").isNull(), "deleted")
        .when(F.col("old").isNull(), "inserted")
        .otherwise("updated")
    )
    kept = F.coalesce("new", "old")
    return joined.select(*key, *[kept[v].alias(v) for v in values], change.alias("change"))


def git_tags_after(merged: DataFrame) -> DataFrame:
    """The tags left after the merge."""
    return merged.filter(F.col("change") != "deleted").drop("change")


def daily_upsert_max(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Per day keep the larger of the stored and the new count."""
    columns = [key, "commit_date", "commit_count"]
    return (
        existing.select(*columns)
        .unionByName(incoming.select(*columns))
        .groupBy(key, "commit_date")
        .agg(F.max("commit_count").alias("commit_count"))
    )


def natural_id(*columns: str) -> Column:
    """Surrogate key that needs no sequence: a 64-bit hash of the natural key. Two keys may
    share one, so stored tables number their rows instead (`numbered`)."""
    return F.xxhash64(*columns)


def largest(rows: DataFrame, column: str) -> int:
    """The largest id in use, 0 where there is none."""
    return rows.agg(F.max(column)).first()[0] or 0


def get_or_create(existing: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """`existing` plus a row for each key of `wanted` it lacks.

    New rows are numbered from the largest stored id on, in the order of their keys, so ids
    are unique and two runs agree. Columns that `wanted`
    does not have are null in the new rows. One row per key is kept, the smallest.
    """
    extra = [c for c in wanted.columns if c not in key]
    first = wanted.groupBy(*key).agg(
        *([F.min(F.struct(*extra)).alias("_v")] if extra else [F.count("*").alias("_n")])
    )
    rows = first.select(*key, *[F.col(f"_v.{c}").alias(c) for c in extra])
    new = numbered(rows.join(existing.select(*key), key, "left_anti"), [F.col(k) for k in key], "id", largest(existing, "id"))
    return existing.unionByName(new, allowMissingColumns=True)


def importable(listing: DataFrame, skip_archived: bool = True, skip_forks: bool = True) -> DataFrame:
    """Listed repositories with a clone URL, without archived ones and forks."""
    rows = listing.filter(F.coalesce(F.col("clone_url"), F.lit("")) != "")
    if skip_archived:
        rows = rows.filter(~F.coalesce(F.col("archived"), F.lit(False)))
    if skip_forks:
        rows = rows.filter(~F.coalesce(F.col("fork"), F.lit(False)))
    return rows


def import_new_repos(
    listing: DataFrame, repositories: DataFrame, prs: DataFrame, default_branch: str = "main"
) -> DataFrame:
    """Links to add, one per project and URL that is not linked yet.

    `repository_id` is that of the known URL, else the next free number in the order of URLs.
    """
    first = listing.groupBy("project_id", F.col("clone_url").alias("url")).agg(
        F.min(F.struct("position", "name", "default_branch")).alias("_r")
    )
    known = repositories.select("url", F.col("id").alias("_id"))
    linked = prs.join(
        repositories.select(F.col("id").alias("repository_id"), "url"), "repository_id"
    ).select("project_id", "url")
    wanted = first.join(linked, ["project_id", "url"], "left_anti")
    created = numbered(
        wanted.select("url").distinct().join(known, "url", "left_anti"), [F.col("url")], "_new", largest(repositories, "id")
    )
    return (
        wanted
        .join(known, "url", "left")
        .join(created, "url", "left")
        .select(
            "project_id",
            "url",
            F.coalesce("_id", "_new").alias("repository_id"),
            F.col("_id").isNull().alias("is_new_repository"),
            F.col("_r.name").alias("name"),
            F.coalesce(
                F.when(F.col("_r.default_branch") != "", F.col("_r.default_branch")),
                F.lit(default_branch),
            ).alias("default_branch"),
        )
    )


def orphan_repositories(repositories: DataFrame, prs: DataFrame) -> DataFrame:
    """Repositories that no project links any more."""
    return repositories.join(
        prs.select(F.col("repository_id").alias("id")).distinct(), "id", "left_anti"
    )
