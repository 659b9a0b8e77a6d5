"""Questions over the whole portfolio.

Repository and project tables are small next to the scans; they are joined without
hints, so Spark broadcasts them while their measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dims
from ..functions.common import choose
from ..functions.scalars import contains_any, json_list, month_ends
from ..operators.latest import PR, latest_scan

NODE = ["level", "id", "parent_id", "name", "value"]


def _overall(scan_scores: DataFrame) -> DataFrame:
    return scan_scores.filter(F.col("domain") == "overall").select(
        "scan_id", F.col("score").alias("overall_score")
    )


def sorted_by(df: DataFrame, column: Column, order: str, tie: str) -> DataFrame:
    """Nulls last in both directions, ties by id."""
    key = column.desc_nulls_last() if order.lower() == "desc" else column.asc_nulls_last()
    return df.orderBy(key, tie)


# --- projects and repositories ----------------------------------------------


def project_summary(projects: DataFrame, prs: DataFrame, scans: DataFrame, scan_scores: DataFrame) -> DataFrame:
    """A10: one row per project; size and score are null without a completed scan."""
    latest = latest_scan(
        scans.select("id", PR, "status", "started_at", "completed_at", "total_loc", "total_files")
    )
    scored = latest.join(_overall(scan_scores), latest["id"] == F.col("scan_id"), "left")
    repos = prs.select(F.col("id").alias(PR), "project_id").join(
        scored.select(PR, F.col("id").alias("scan"), "total_loc", "total_files", "completed_at", "overall_score"),
        PR,
        "left",
    )
    scanned = F.count("scan")
    totals = repos.groupBy("project_id").agg(
        F.count("*").alias("repo_count"),
        scanned.alias("repos_with_completed_scan"),
        F.when(scanned > 0, F.coalesce(F.sum("total_loc"), F.lit(0))).alias("total_loc"),
        F.when(scanned > 0, F.coalesce(F.sum("total_files"), F.lit(0))).alias("total_files"),
        F.avg("overall_score").alias("avg_score"),
        F.max("completed_at").alias("last_scan_at"),
    )
    return (
        projects.select("id", "name", "description")
        .join(totals.withColumnRenamed("project_id", "id"), "id", "left")
        .fillna(0, ["repo_count", "repos_with_completed_scan"])
    )


PROJECT_SORTS = {
    "name": lambda: F.lower("name"),
    "id": lambda: F.col("id"),
    "repo_count": lambda: F.col("repo_count"),
    "scanned": lambda: F.col("repos_with_completed_scan"),
    "loc": lambda: F.col("total_loc"),
    "files": lambda: F.col("total_files"),
    "avg_score": lambda: F.col("avg_score"),
    "last_scan_at": lambda: F.col("last_scan_at"),
}


def projects_summary(summary: DataFrame, sort_by: str = "name", order: str = "asc", q: str | None = None,
                     has_scans: bool = False) -> DataFrame:
    """Filtered and sorted `project_summary`; an unknown sort means name."""
    if q and q.strip():
        summary = summary.filter(contains_any(q, F.col("name"), F.col("description")))
    if has_scans:
        summary = summary.filter(F.col("repos_with_completed_scan") > 0)
    key = PROJECT_SORTS.get(sort_by, PROJECT_SORTS["name"])()
    return sorted_by(summary, key, order, "id")


def repos_with_latest_scan(prs: DataFrame, repositories: DataFrame, scans: DataFrame,
                           scan_scores: DataFrame) -> DataFrame:
    """Every linked repository with its latest scan, if any."""
    latest = latest_scan(
        scans.select(
            "id", PR, "status", "started_at", "completed_at", "total_loc", "total_files",
            "project_type", "primary_language",
        )
    ).withColumnRenamed("id", "scan_id").drop("status")
    return (
        prs.select("id", "project_id", "repository_id", "name", "default_branch")
        .join(
            repositories.select(F.col("id").alias("repository_id"), "url", "provider"), "repository_id", "left"
        )
        .join(latest.withColumnRenamed(PR, "id"), "id", "left")
        .join(_overall(scan_scores), "scan_id", "left")
    )


REPO_SORTS = {
    "name": lambda: F.lower("name"),
    "id": lambda: F.col("id"),
    "loc": lambda: F.col("total_loc"),
    "files": lambda: F.col("total_files"),
    "project_type": lambda: F.when(F.col("scan_id").isNotNull(), F.lower(F.coalesce("project_type", F.lit("")))),
    "last_updated": lambda: F.coalesce("completed_at", "started_at"),
    "primary_language": lambda: F.when(
        F.col("scan_id").isNotNull(), F.lower(F.coalesce("primary_language", F.lit("")))
    ),
    "score": lambda: F.col("overall_score"),
}


def repos_sorted(repos: DataFrame, sort_by: str = "name", order: str = "asc", q: str | None = None,
                 has_scans: bool = False, project_id: int | None = None) -> DataFrame:
    """T5, P9, P10."""
    if project_id is not None:
        repos = repos.filter(F.col("project_id") == project_id)
    if q and q.strip():
        repos = repos.filter(contains_any(q, F.col("name"), F.col("url")))
    if has_scans:
        repos = repos.filter(F.col("scan_id").isNotNull())
    key = REPO_SORTS.get(sort_by, REPO_SORTS["name"])()
    return sorted_by(repos, key, order, "id")


# --- trees -------------------------------------------------------------------


def _tree(projects: DataFrame, repos: DataFrame, keep_empty: bool) -> DataFrame:
    """root, project and repository nodes from repository values.

    `repos` has project_id, id, name and value. ROLLUP adds the two upper levels.
    """
    rolled = repos.rollup("project_id", "id").agg(
        F.sum("value").alias("value"), F.max("name").alias("name"), F.grouping_id().alias("g")
    )
    upper = rolled.filter(F.col("g") == 1).select(F.col("project_id").alias("id"), "value")
    project_nodes = projects.select("id", "name").join(upper, "id", "left" if keep_empty else "inner")
    nodes = [
        rolled.filter(F.col("g") == 0).select(
            F.lit("repository").alias("level"), "id", F.col("project_id").alias("parent_id"), "name", "value"
        ),
        project_nodes.select(
            F.lit("project").alias("level"),
            "id",
            F.lit(None).cast("long").alias("parent_id"),
            "name",
            F.coalesce("value", F.lit(0)).alias("value"),
        ),
        project_nodes.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")).select(
            F.lit("root").alias("level"),
            F.lit(None).cast("long").alias("id"),
            F.lit(None).cast("long").alias("parent_id"),
            F.lit("root").alias("name"),
            "value",
        ),
    ]
    return nodes[0].unionByName(nodes[1]).unionByName(nodes[2]).select(*NODE)


def treemap(projects: DataFrame, prs: DataFrame, scans: DataFrame, metric: str = "loc",
            project_id: int | None = None) -> DataFrame:
    """Size tree; projects without scans stay with 0."""
    column = {"loc": "total_loc", "files": "total_files"}[choose("metric", metric, ["loc", "files"])]
    if project_id is not None:
        projects = projects.filter(F.col("id") == project_id)
        prs = prs.filter(F.col("project_id") == project_id)
    latest = latest_scan(scans.select("id", PR, "status", "started_at", column))
    repos = (
        prs.select("id", "project_id", "name")
        .join(latest.select(F.col(PR).alias("id"), F.coalesce(column, F.lit(0)).alias("value")), "id")
        .join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi")
    )
    return _tree(projects, repos, keep_empty=True)


def commit_activity(repository_daily: DataFrame, as_of: str, period: str) -> DataFrame:
    """Commits of each repository inside the period."""
    days = dims.PERIOD_DAYS[choose("period", period, dims.PERIOD_DAYS)]
    cutoff = F.date_sub(F.lit(as_of).cast("date"), days)
    return (
        repository_daily.filter(F.col("commit_date") >= cutoff)
        .groupBy(F.col(PR).alias("id"))
        .agg(F.sum("commit_count").alias("value"))
    )


def line_activity(scans: DataFrame, contribs: DataFrame) -> DataFrame:
    """Inserted lines recorded by the latest scan; the period has no say here."""
    latest = latest_scan(scans.select("id", PR, "status", "started_at"))
    return (
        latest.select(F.col(PR).alias("repo"), F.col("id").alias("scan_id"))
        .join(contribs.select("scan_id", "insertions"), "scan_id")
        .groupBy(F.col("repo").alias("id"))
        .agg(F.sum("insertions").alias("value"))
    )


def activity_tree(projects: DataFrame, prs: DataFrame, activity: DataFrame) -> DataFrame:
    """Tree of active repositories; zero nodes and empty projects are dropped."""
    repos = prs.select("id", "project_id", "name").join(activity.filter(F.col("value") > 0), "id")
    return _tree(projects, repos, keep_empty=False)


def nested_tree(nodes: DataFrame) -> DataFrame:
    """The tree as one nested row, for clients that want it whole."""
    child = F.struct("id", "name", "value", F.lit("repository").alias("type"))
    repos = nodes.filter(F.col("level") == "repository").groupBy(F.col("parent_id").alias("pid")).agg(
        F.sort_array(F.collect_list(child)).alias("children")
    )
    projects = (
        nodes.filter(F.col("level") == "project")
        .join(repos, F.col("id") == F.col("pid"), "left")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("id", "name", "value", F.lit("project").alias("type"), "children"))
            ).alias("children")
        )
    )
    root = nodes.filter(F.col("level") == "root").select("name", "value", F.lit("root").alias("type"))
    return root.withColumn("children", projects.scalar())


# --- technology --------------------------------------------------------------


def tech_repos(projects: DataFrame, prs: DataFrame, scans: DataFrame) -> DataFrame:
    """Stack of each repository from its latest scan; JSON lists are parsed here."""
    latest = latest_scan(scans)
    lists = ["frameworks", "package_managers", "infra_tools", "linters"]
    return (
        prs.select(F.col("id").alias(PR), F.col("name").alias("repo_name"), "project_id")
        .join(latest, PR)
        .join(
            projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")),
            "project_id",
        )
        .select(
            F.col(PR).alias("repo_id"),
            "repo_name",
            "project_id",
            "project_name",
            F.col("id").alias("scan_id"),
            "primary_language",
            "project_type",
            *[json_list(F.col(f"{c}_json")).alias(c) for c in lists],
            "ci_provider",
            *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_docker", "has_kubernetes", "has_terraform")],
        )
    )


def scan_language_names(scan_languages: DataFrame, languages: DataFrame) -> DataFrame:
    """Language rows of a scan, by language id, with the names of the dimension."""
    names = languages.select(F.col("id").alias("language_id"), F.col("name").alias("language"))
    return scan_languages.join(names, "language_id").select("scan_id", "language", "file_count", "loc", "percentage")


def repository_modules(modules: DataFrame, prs: DataFrame) -> DataFrame:
    """The modules of each repository, by path."""
    named = prs.select(F.col("id").alias("project_repository_id"), "repository_id", F.col("name").alias("repository_name"))
    return modules.join(named, "project_repository_id").select("repository_id", "repository_name", "id", "path", "name")


def tech_lang_stats(repos: DataFrame, scan_languages: DataFrame) -> DataFrame:
    """Lines, files and repositories by language over latest scans."""
    return (
        repos.select("scan_id")
        .join(scan_languages.select("scan_id", "language", "loc", "file_count"), "scan_id")
        .groupBy("language")
        .agg(
            F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"),
            F.coalesce(F.sum("file_count"), F.lit(0)).alias("total_files"),
            F.count("*").alias("repo_count"),
        )
    )


def tech_counts(repos: DataFrame) -> DataFrame:
    """(kind, name, count) in one pass: each list is tagged and exploded once."""

    def tagged(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("name")))

    ci = F.when(F.coalesce(F.col("ci_provider"), F.lit("")) != "", F.array("ci_provider")).otherwise(
        F.array().cast("array<string>")
    )
    items = F.concat(
        tagged("framework", F.col("frameworks")),
        tagged("ci_provider", ci),
        tagged("package_manager", F.col("package_managers")),
        tagged("infra_tool", F.col("infra_tools")),
    )
    return repos.select(F.inline(items)).groupBy("kind", "name").agg(F.count("*").alias("count"))


def count_maps_desc(counts: DataFrame) -> DataFrame:
    """One row per kind, names by count descending, then name."""
    entry = F.struct((-F.col("count")).alias("o"), "name", "count")
    return counts.groupBy("kind").agg(
        F.transform(
            F.sort_array(F.collect_list(entry)), lambda e: F.struct(e["name"].alias("name"), e["count"].alias("count"))
        ).alias("counts")
    )


def top_languages(repos: DataFrame, scan_languages: DataFrame, n: int = 4) -> DataFrame:
    """The n languages with most lines of each repository."""
    rank = F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc("loc"), "language"))
    return (
        repos.select("repo_id", "scan_id")
        .join(scan_languages.select("scan_id", "language", "loc"), "scan_id")
        .withColumn("rank", rank)
        .filter(F.col("rank") <= n)
        .select("repo_id", "language", "loc", "rank")
    )


# --- size over time ----------------------------------------------------------


def size_months(scans: DataFrame, as_of: str, years: int, metric: str = "loc") -> DataFrame:
    """(repository, month_end, value) with the last known value carried on.

    Scans are reduced to the last one of each repository and month first; all
    scans before the period share one slot. Whatever the number of scans, the
    window then sees at most years x 12 + 1 rows per repository.
    """
    choose("years", str(years), ["1", "2", "3", "5"])
    column = {"loc": "total_loc", "files": "total_files", "bytes": "size_bytes"}[
        choose("metric", metric, ["loc", "files", "bytes"])
    ]
    ends = month_ends(as_of, years)
    before = F.add_months(F.get(ends, F.lit(0)), -1)
    slot = F.greatest(F.last_day(F.to_date("created_at")), F.last_day(before))
    last_of_month = (
        scans.filter((F.col("status") == "completed") & (F.to_date("created_at") <= F.element_at(ends, -1)))
        .groupBy(PR, slot.alias("month_end"))
        .agg(F.max_by(F.coalesce(column, F.lit(0)), F.struct("created_at", "id")).alias("value"))
    )
    repos = scans.filter(F.col("status") == "completed").select(PR).distinct()
    grid = repos.select(PR, F.explode(ends).alias("month_end"), F.lit(None).cast("long").alias("value"), F.lit(1).alias("g"))
    carried = F.last("value", ignorenulls=True).over(
        W.partitionBy(PR).orderBy("month_end").rowsBetween(W.unboundedPreceding, 0)
    )
    merged = (
        last_of_month.withColumn("g", F.lit(0))
        .unionByName(grid)
        .groupBy(PR, "month_end")
        .agg(F.max("value").alias("value"), F.max("g").alias("g"))
    )
    return merged.withColumn("value", carried).filter("g = 1").drop("g")


def size_history(months: DataFrame, prs: DataFrame, projects: DataFrame, group_by: str = "repository") -> DataFrame:
    """Monthly series per repository or project; an empty project month is null."""
    choose("group_by", group_by, ["repository", "project"])
    named = months.join(
        prs.select(F.col("id").alias(PR), F.col("name").alias("repo_name"), "project_id"), PR, "left"
    )
    month = F.date_format("month_end", "yyyy-MM").alias("month")
    if group_by == "repository":
        return named.select(
            F.col(PR).alias("id"),
            F.coalesce("repo_name", F.col(PR).cast("string")).alias("name"),
            month,
            "value",
        )
    by_project = named.groupBy(F.coalesce("project_id", F.lit(0)).alias("id"), "month_end").agg(
        F.sum("value").alias("value")
    )
    return by_project.join(projects.select("id", "name"), "id", "left").select(
        "id", F.coalesce("name", F.col("id").cast("string")).alias("name"), month,
        F.when(F.col("value") > 0, F.col("value")).alias("value"),
    )


def size_totals(months: DataFrame) -> DataFrame:
    """Portfolio total per month."""
    return months.groupBy(F.date_format("month_end", "yyyy-MM").alias("month")).agg(
        F.coalesce(F.sum("value"), F.lit(0)).alias("total")
    )
