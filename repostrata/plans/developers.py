"""Developer queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import blank_to_null, share, total, with_share
from ..functions.scalars import ilike_any
from ..operators.latest import PR, latest_scan
from ..operators.numbering import SHALLOW, page

SUMS = {
    "total_commits": "commit_count",
    "total_insertions": "insertions",
    "total_deletions": "deletions",
    "files_changed": "files_changed",
    "active_days": "active_days",
}


def _totals() -> list[Column]:
    return [total(F.col(c)).alias(n) for n, c in SUMS.items()] + [
        F.min("first_commit_at").alias("first_commit_at"),
        F.max("last_commit_at").alias("last_commit_at"),
    ]


def profile_keys(profiles: DataFrame) -> DataFrame:
    return profiles.select(F.col("id").alias("profile_id"), "developer_id")


def contrib_by_project(contribs: DataFrame, profiles: DataFrame, scans: DataFrame, prs: DataFrame,
                       project_id: int | None = None) -> DataFrame:
    """Contributions with developer and project."""
    repos = prs.select(F.col("id").alias(PR), "project_id")
    if project_id is not None:
        repos = repos.filter(F.col("project_id") == project_id)
    in_scope = scans.select(F.col("id").alias("scan_id"), PR).join(repos, PR)
    return contribs.join(in_scope, "scan_id").join(profile_keys(profiles), "profile_id")


def contrib_all(contribs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every profile with its contributions, if any."""
    return profile_keys(profiles).join(contribs, "profile_id", "left")


def latest_contribs(contribs: DataFrame, scans: DataFrame) -> DataFrame:
    """Contributions of latest scans only, so that scanning again does not count twice."""
    latest = latest_scan(scans.select("id", PR, "status", "started_at"))
    return contribs.join(latest.select(F.col("id").alias("scan_id")), "scan_id", "left_semi")


def developer_totals(rows: DataFrame) -> DataFrame:
    """A1: one row per developer from J1 or J2 rows."""
    return rows.groupBy("developer_id").agg(*_totals())


def developer_totals_overall(totals: DataFrame) -> DataFrame:
    """A2."""
    return totals.agg(
        F.count("*").alias("developers"), total(F.col("total_commits")).alias("total_commits_all")
    )


def matching_developers(profiles: DataFrame, q: str) -> DataFrame:
    """Developers with a matching profile."""
    hit = ilike_any(q, F.col("display_name"), F.col("canonical_username"), F.col("primary_email"))
    return profiles.filter(hit).select("developer_id").distinct()


def restricted(rows: DataFrame, profiles: DataFrame, tags: DataFrame, q: str | None = None,
               tag: str | None = None) -> DataFrame:
    """Search and tag as semi joins."""
    if q and q.strip():
        rows = rows.join(matching_developers(profiles, q), "developer_id", "left_semi")
    if tag and tag.strip():
        rows = rows.join(tags.filter(F.col("tag") == tag.strip()), "developer_id", "left_semi")
    return rows


def display_names(profiles: DataFrame) -> DataFrame:
    """Display or user name of each developer's first profile, lower-cased."""
    name = F.lower(F.coalesce(blank_to_null(F.col("display_name")), F.col("canonical_username"), F.lit("")))
    return profiles.groupBy("developer_id").agg(F.min_by(name, "id").alias("sort_name"))


PAGE_SORTS = {
    "commits": "total_commits",
    "insertions": "total_insertions",
    "deletions": "total_deletions",
    "files_changed": "files_changed",
    "active_days": "active_days",
    "last_commit_at": "last_commit_at",
    "name": "sort_name",
}


def developers_page(totals: DataFrame, profiles: DataFrame, sort_by: str = "commits", order: str = "desc",
                    offset: int = 0, limit: int = 200, shallow: int = SHALLOW) -> DataFrame:
    """One page; an unknown sort means commits, ties go by developer."""
    if not (0 <= offset and 1 <= limit <= 1000):
        raise ValueError("offset must be 0 or more, limit between 1 and 1000")
    column = PAGE_SORTS.get(sort_by, "total_commits")
    rows = totals
    if column == "sort_name":
        rows = rows.join(display_names(profiles), "developer_id", "left")
    key = F.col(column).asc_nulls_first() if order.lower() == "asc" else F.col(column).desc_nulls_last()
    return page(rows, [key, F.col("developer_id")], offset, limit, shallow)


def page_info(totals: DataFrame, offset: int, limit: int) -> DataFrame:
    """total, has_more and the grand total beside a page."""
    return developer_totals_overall(totals).withColumn(
        "has_more", F.lit(offset + limit) < F.col("developers")
    )


def with_tags(rows: DataFrame, tags: DataFrame, key: str = "developer_id") -> DataFrame:
    """Parents with their sorted tags."""
    listed = tags.groupBy(key).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return rows.join(listed, key, "left").withColumn(
        "tags", F.coalesce("tags", F.array().cast("array<string>"))
    )


def with_profiles(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles of each developer as a sorted list."""
    one = F.struct("id", "canonical_username", "display_name", "primary_email")
    listed = profiles.groupBy("developer_id").agg(F.sort_array(F.collect_list(one)).alias("profiles"))
    return rows.join(listed, "developer_id", "left")


def developer_detail(profiles: DataFrame, tags: DataFrame) -> DataFrame:
    """E2."""
    developers = profiles.select("developer_id").distinct()
    return with_tags(with_profiles(developers, profiles), tags)


def developer_overrides(profiles: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides that lead to one of a developer's profiles."""
    names = profiles.select("developer_id", "canonical_username").distinct()
    return overrides.join(names, "canonical_username")


def developer_summary(contribs: DataFrame, profiles: DataFrame, scans: DataFrame, prs: DataFrame,
                      project_id: int | None = None, scoped: bool = False) -> DataFrame:
    """A3: totals of every developer and the share of a project's commits.

    The numerator takes all projects; `scoped` restricts it to the project too.
    """
    rows = contrib_all(contribs, profiles)
    if project_id is None:
        totals = developer_totals(rows)
        nothing = F.lit(None)
        return totals.withColumn("project_total_commits", nothing.cast("long")).withColumn(
            "share_pct", nothing.cast("double")
        )
    project_rows = contrib_by_project(contribs, profiles, scans, prs, project_id)
    totals = developer_totals(project_rows if scoped else rows)
    whole = project_rows.agg(total(F.col("commit_count")).alias("_whole"))
    counted = (F.col("total_commits") > 0) & (F.col("_whole") > 0)
    return (
        totals.withColumn("_whole", whole.scalar())
        .withColumn("project_total_commits", F.when(counted, F.col("_whole")))
        .withColumn("share_pct", F.when(counted, share(F.col("total_commits"), F.col("_whole"))))
        .drop("_whole")
    )


def _developer_share(rows: DataFrame) -> DataFrame:
    """Share of the developer's added lines."""
    return with_share(rows, ["developer_id"], "loc_added")


_SUMMED = ("commit_count", "files_changed", "loc_added")


def developer_languages(language_contribs: DataFrame, profiles: DataFrame) -> DataFrame:
    """A4: all-time, every developer."""
    rows = (
        language_contribs.join(profile_keys(profiles), "profile_id")
        .groupBy("developer_id", "language")
        .agg(*[total(F.col(c)).alias(c) for c in _SUMMED])
    )
    return _developer_share(rows)


def developer_languages_of_scan(language_contribs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Stored rows per scan, largest share first."""
    return (
        language_contribs.join(profile_keys(profiles), "profile_id")
        .select("scan_id", "developer_id", "profile_id", "language", *_SUMMED, "percentage")
    )


def module_names(modules: DataFrame, prs: DataFrame, projects: DataFrame) -> DataFrame:
    """Modules with repository and project names."""
    return (
        modules.select(F.col("id").alias("module_id"), PR, F.col("path").alias("module_path"), F.col("name").alias("module_name"))
        .join(prs.select(F.col("id").alias(PR), F.col("name").alias("repository_name"), "project_id"), PR)
        .join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id")
    )


def developer_modules(module_contribs: DataFrame, profiles: DataFrame, named_modules: DataFrame) -> DataFrame:
    """A5: aggregated by module before the names are joined."""
    rows = (
        module_contribs.join(profile_keys(profiles), "profile_id")
        .groupBy("developer_id", "module_id")
        .agg(*[total(F.col(c)).alias(c) for c in _SUMMED])
    )
    return _developer_share(rows).join(named_modules, "module_id")


def developer_modules_of_scan(module_contribs: DataFrame, profiles: DataFrame, named_modules: DataFrame) -> DataFrame:
    """Stored module rows per scan, joined through the module's repository."""
    return (
        module_contribs.join(profile_keys(profiles), "profile_id")
        .join(named_modules, "module_id")
        .select(
            "scan_id", "developer_id", "profile_id", "project_name", "repository_name", "module_path",
            "module_name", *_SUMMED, "percentage",
        )
    )


def developer_activity(developer_daily: DataFrame, profiles: DataFrame) -> DataFrame:
    """Commits per developer and day over all profiles."""
    return (
        developer_daily.join(profile_keys(profiles), "profile_id")
        .groupBy("developer_id", "commit_date")
        .agg(F.sum("commit_count").alias("commit_count"))
    )


def module_owners(module_contribs: DataFrame, profiles: DataFrame, modules: DataFrame) -> DataFrame:
    """Owners of each module."""
    return (
        module_contribs.join(
            profiles.select(F.col("id").alias("profile_id"), "developer_id", "canonical_username", "display_name"),
            "profile_id",
        )
        .join(modules.select(F.col("id").alias("module_id"), "path", "name"), "module_id")
        .select(
            "module_id", "path", "name", "scan_id", "developer_id", "profile_id", "canonical_username",
            "display_name", "commit_count", "files_changed", "percentage",
        )
    )


def project_developers(contribs: DataFrame, profiles: DataFrame, scans: DataFrame, prs: DataFrame) -> DataFrame:
    """Distinct (project, developer) pairs with a contribution."""
    scoped = contribs.select("scan_id", "profile_id").distinct()
    return contrib_by_project(scoped, profiles, scans, prs).select("project_id", "developer_id").distinct()


SCAN_DEVELOPER_SORTS = {
    "commits": "commit_count",
    "insertions": "insertions",
    "deletions": "deletions",
    "files_changed": "files_changed",
    "active_days": "active_days",
    "last_commit_at": "last_commit_at",
    "name": "_name",
}


def scan_developers(contribs: DataFrame, profiles: DataFrame, tags: DataFrame, q: str | None = None) -> DataFrame:
    """Contribution rows of every scan with profile and tags."""
    named = contribs.join(
        profiles.select(
            F.col("id").alias("profile_id"), "developer_id", "canonical_username", "display_name", "primary_email"
        ),
        "profile_id",
    )
    if q and q.strip():
        named = named.filter(
            ilike_any(q, F.col("display_name"), F.col("canonical_username"), F.col("primary_email"))
        )
    return with_tags(named, tags)


def scan_developers_sorted(rows: DataFrame, sort_by: str = "commits", order: str = "desc") -> DataFrame:
    """Within each scan; last commit puts nulls last upwards and first downwards."""
    column = SCAN_DEVELOPER_SORTS.get(sort_by, "commit_count")
    keyed = rows.withColumn("_name", F.coalesce("display_name", "canonical_username"))
    asc = order.lower() == "asc"
    if column == "last_commit_at":
        key = F.col(column).asc_nulls_last() if asc else F.col(column).desc_nulls_first()
    else:
        key = F.col(column).asc() if asc else F.col(column).desc()
    return keyed.orderBy("scan_id", key, "profile_id").drop("_name")


def distinct_tags(tags: DataFrame) -> DataFrame:
    """A35."""
    return tags.select("tag").distinct().orderBy("tag")
