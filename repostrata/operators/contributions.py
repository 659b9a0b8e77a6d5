"""Who changed what, from commits with nested changes.

Commits stay nested until a language or module row is needed, so per-commit sums
are array functions in the row. Every aggregate is keyed by repository and user
and starts with a partial aggregate, which absorbs a repository that owns a third
of the commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import paths
from ..functions.common import with_share
from ..functions.identity import name_key, resolve_identity
from ..functions.scalars import day_of

USER = ["repo_id", "username"]


def override_keys(overrides: DataFrame) -> DataFrame:
    """Overrides as (project_id, key, canonical): the last row naming a key wins."""
    keys = overrides.select(
        "project_id",
        "canonical_username",
        F.explode(
            F.array(
                F.struct(F.col("raw_name").alias("raw"), F.struct("id", F.lit(0)).alias("at")),
                F.struct(F.col("raw_email").alias("raw"), F.struct("id", F.lit(1)).alias("at")),
            )
        ).alias("k"),
    ).filter(F.coalesce(F.col("k.raw"), F.lit("")) != "")
    return keys.groupBy("project_id", name_key(F.col("k.raw")).alias("key")).agg(
        F.max_by("canonical_username", "k.at").alias("canonical")
    )


def with_identity(commits: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Commits with an `identity` struct and `username`.

    Without overrides this is a projection. With them the (small, hand-kept) table
    is joined by name and by e-mail; commits then carry a `project_id`.
    """
    none = F.lit(None).cast("string")
    if overrides is None:
        joined, by_name, by_email = commits, none, none
    else:
        keys = override_keys(overrides)
        joined = (
            commits.withColumn("_name", name_key(F.col("author_name")))
            .withColumn("_email", name_key(F.col("author_email")))
            .join(
                keys.select("project_id", F.col("key").alias("_name"), F.col("canonical").alias("_by_name")),
                ["project_id", "_name"],
                "left",
            )
            .join(
                keys.select("project_id", F.col("key").alias("_email"), F.col("canonical").alias("_by_email")),
                ["project_id", "_email"],
                "left",
            )
        )
        by_name, by_email = F.col("_by_name"), F.col("_by_email")
    identity = resolve_identity(F.col("author_name"), F.col("author_email"), by_name, by_email)
    return (
        joined.withColumn("identity", identity)
        .withColumn("username", F.col("identity.username"))
        .drop("_name", "_email", "_by_name", "_by_email")
    )


def _sum_of(field: str) -> Column:
    return F.aggregate(
        F.col(f"file_changes.{field}"), F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x, F.lit(0))
    )


def _keys(commits: DataFrame) -> list[str]:
    """What tells authors apart: the spelling, and what else of an identity is known by now."""
    known = [c for c in ("project_id", "username", "identity") if c in commits.columns]
    return ["repo_id", *known, "author_name", "author_email"]


def _identified(sums: DataFrame, keys: list[str], overrides: DataFrame | None) -> DataFrame:
    """Sums by spelling with their users, each spelling resolved once.

    An identity depends on the spelling only, so the sums of a spelling (days or languages of
    one author in one repository) are nested, the author is resolved, and they are taken out again.
    """
    if "username" in keys:
        return sums
    parts = F.collect_list(F.struct(*[c for c in sums.columns if c not in keys])).alias("parts")
    named = with_identity(sums.groupBy(*keys).agg(parts), overrides)
    return named.select(*USER, "author_name", "author_email", "identity", F.inline("parts"))


def day_sums(commits: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Sums per repository, user and author-local day, with the first spelling seen (`who`, `seq`).

    Numbers only, so the first step is a hash aggregate, and whatever follows sees a row
    per day. Rows of different commits add up: sums by sum, `who` by the least `seq`.
    """
    keys = _keys(commits)
    by_spelling = (
        commits.select(
            *keys,
            day_of(F.col("ts_raw")).alias("day"),
            "ts",
            _sum_of("insertions").alias("ins"),
            _sum_of("deletions").alias("del"),
            F.size(F.array_distinct("file_changes.path")).alias("files"),
            "seq",
        )
        .groupBy(*keys, "day")
        .agg(
            F.count("*").alias("commits"),
            F.sum("ins").alias("ins"),
            F.sum("del").alias("del"),
            F.sum("files").alias("files"),
            F.min("ts").alias("first"),
            F.max("ts").alias("last"),
            F.min("seq").alias("seq"),
        )
    )
    who = F.struct("author_name", "author_email", "identity.confidence", "identity.is_ambiguous")
    return _identified(by_spelling, keys, overrides).withColumn("who", who).groupBy(*USER, "day").agg(
        *[F.sum(c).alias(c) for c in ("commits", "ins", "del", "files")],
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.min_by("who", "seq").alias("who"),
        F.min("seq").alias("seq"),
    )


def user_stats(by_day: DataFrame) -> DataFrame:
    """A27, W7 from `day_sums`, one row per repository, user and day."""
    return (
        by_day.groupBy(*USER)
        .agg(
            F.sum("commits").alias("commit_count"),
            F.sum("ins").alias("insertions"),
            F.sum("del").alias("deletions"),
            F.sum("files").alias("files_changed"),
            F.count("*").alias("active_days"),
            F.min("first").alias("first_commit_at"),
            F.max("last").alias("last_commit_at"),
            F.min_by("who", "seq").alias("who"),
        )
        .select(
            *USER,
            "commit_count",
            "insertions",
            "deletions",
            "files_changed",
            "active_days",
            "first_commit_at",
            "last_commit_at",
            F.col("who.author_name").alias("display_name"),
            F.col("who.author_email").alias("primary_email"),
            F.col("who.confidence").alias("confidence"),
            F.col("who.is_ambiguous").alias("is_ambiguous"),
        )
    )


def contributions(commits: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One row per repository and user.

    `files_changed` adds up the distinct paths of each commit. Commits without a `username`
    are summed by author spelling before the authors are resolved.
    """
    return user_stats(day_sums(commits, overrides))


def raw_identities(commits: DataFrame) -> DataFrame:
    """Author spellings of each user, with the identity of the first one seen."""
    first = commits.groupBy(*USER, "author_name", "author_email").agg(
        F.min("seq").alias("seq"), F.min_by("identity", "seq").alias("identity")
    )
    lead = first.groupBy(*USER).agg(F.min_by("identity", "seq").alias("lead"))
    return first.join(lead, USER).select(
        *USER,
        F.col("author_name").alias("raw_name"),
        F.col("author_email").alias("raw_email"),
        F.col("lead.confidence").alias("confidence"),
        F.col("lead.is_ambiguous").alias("is_ambiguous"),
    )


def change_sums(commits: DataFrame, key: Column, name: str, overrides: DataFrame | None = None) -> DataFrame:
    """Changed files and lines per repository, user and `key`; changes whose key is null are left out.

    Rows of different commits add up. The outer form of inline keeps a parsed log from being
    parsed twice.
    """
    keys = _keys(commits)
    by_spelling = (
        commits.select(*keys, F.inline_outer("file_changes")).filter(F.col("path").isNotNull())
        .withColumn(name, key).filter(F.col(name).isNotNull())
        .groupBy(*keys, name)
        .agg(F.count("*").alias("changes"), F.sum("insertions").alias("loc_added"), F.sum("deletions").alias("loc_deleted"))
    )
    return _identified(by_spelling, keys, overrides).groupBy(*USER, name).agg(
        *[F.sum(c).alias(c) for c in ("changes", "loc_added", "loc_deleted")]
    )


def with_user_share(rows: DataFrame, part: str = "files_changed") -> DataFrame:
    """`part` as a percentage of the user's total."""
    return with_share(rows, USER, part)


def _counted(sums: DataFrame, name: str, *lines: str) -> DataFrame:
    counts = [F.col("changes").alias("commit_count"), F.col("changes").alias("files_changed")]
    return with_user_share(sums.select(*USER, name, *counts, *lines))


def language_stats(sums: DataFrame, head_languages: DataFrame | None = None) -> DataFrame:
    """A28 from `change_sums` by language.

    The share is taken over all languages of the user; languages that the current
    tree no longer has are dropped afterwards.
    """
    shared = _counted(sums, "language", "loc_added", "loc_deleted")
    if head_languages is None:
        return shared
    return shared.join(head_languages.select("repo_id", "language"), ["repo_id", "language"], "left_semi")


def module_stats(sums: DataFrame) -> DataFrame:
    """A29 from `change_sums` by module."""
    return _counted(sums, "module", "loc_added")


def language_contributions(commits: DataFrame, head_languages: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Changes by user and language."""
    return language_stats(change_sums(commits, F.col("language"), "language", overrides), head_languages)


def module_contributions(commits: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Changes by user and top-level module."""
    return module_stats(change_sums(commits, paths.top_module(F.col("path")), "module", overrides))


def developer_daily(commits: DataFrame) -> DataFrame:
    """Commits per user and author-local day."""
    return commits.groupBy("username", day_of(F.col("ts_raw")).alias("commit_date")).agg(
        F.count("*").alias("commit_count")
    )


def repo_daily(commits: DataFrame) -> DataFrame:
    """Commits per repository and author-local day."""
    return commits.groupBy("repo_id", day_of(F.col("ts_raw")).alias("commit_date")).agg(
        F.count("*").alias("commit_count")
    )


def owner_shares(rows: DataFrame, key: str, seen: str = "username") -> DataFrame:
    """Per repository and language/module the changes and the top owner.

    Ties go to the user who comes first in `seen` order.
    """
    return (
        rows.groupBy("repo_id", key)
        .agg(
            F.sum("files_changed").alias("total"),
            F.max("files_changed").alias("top_changes"),
            F.min_by("username", F.struct(-F.col("files_changed"), F.col(seen))).alias("top_owner"),
        )
        .withColumn("owner_share", F.col("top_changes") / F.col("total"))
    )


def top_shares(contribs: DataFrame) -> DataFrame:
    """Per repository the developers, commits and shares of the top one and two.

    The ranking keeps two rows per task and repository before it shuffles
    (`row_number <= 2` is a group limit); the totals are partial aggregates.
    """
    rank = F.row_number().over(
        W.partitionBy("repo_id").orderBy(F.desc("commit_count"), "username")
    )
    top = (
        contribs.select("repo_id", "username", "commit_count")
        .withColumn("rank", rank)
        .filter(F.col("rank") <= 2)
        .groupBy("repo_id")
        .agg(
            F.max("commit_count").alias("top1"),
            F.sum("commit_count").alias("top2"),
            F.min_by("username", "rank").alias("top_developer"),
        )
    )
    totals = contribs.groupBy("repo_id").agg(
        F.count("*").alias("developers"),
        F.sum("commit_count").alias("commits"),
        F.max("last_commit_at").alias("latest_commit_at"),
    )
    return totals.join(top, "repo_id").select(
        "repo_id",
        "developers",
        "commits",
        "top_developer",
        "latest_commit_at",
        F.try_divide("top1", "commits").alias("top1_share"),
        F.try_divide("top2", "commits").alias("top2_share"),
    )
