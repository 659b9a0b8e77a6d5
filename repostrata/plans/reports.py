"""Scan views and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.links import scan_ref, source_url
from ..functions.scalars import duration_days
from ..operators.latest import PR, latest_scan, queue_rows
from ..operators.numbering import SHALLOW, page


def _repository_scans(prs: DataFrame, projects: DataFrame, scans: DataFrame) -> DataFrame:
    """Latest scan of each repository with names, one row per repository."""
    latest = latest_scan(
        scans.select("id", PR, "status", "started_at", "completed_at", "commit_sha", "branch")
    ).withColumnRenamed("id", "scan_id")
    return (
        prs.select(
            F.col("id").alias(PR), "repository_id", F.col("name").alias("repository_name"), "project_id",
            "default_branch",
        )
        .join(latest, PR)
        .join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id")
    )


# --- licences and dependencies ----------------------------------------------


def license_dependencies_report(prs: DataFrame, projects: DataFrame, scans: DataFrame, deps: DataFrame) -> DataFrame:
    """Counts per repository's latest scan; repositories without dependencies show 0."""
    repos = _repository_scans(prs, projects, scans)
    risk = F.col("license_risk")
    counts = (
        deps.join(repos.select("scan_id"), "scan_id", "left_semi")
        .groupBy("scan_id")
        .agg(
            F.count("*").alias("total"),
            F.count_if("is_direct").alias("direct_count"),
            F.count_if(risk == "safe").alias("safe_count"),
            F.count_if(risk == "risky").alias("risky_count"),
        )
    )
    filled = repos.join(counts, "scan_id", "left").fillna(
        0, ["total", "direct_count", "safe_count", "risky_count"]
    )
    return filled.select(
        "project_id", "project_name", F.col(PR).alias("repository_id"), "repository_name", "scan_id",
        F.col("started_at").alias("scan_started_at"),
        F.col("completed_at").alias("scan_completed_at"),
        "total", "direct_count",
        (F.col("total") - F.col("direct_count")).alias("transitive_count"),
        "safe_count", "risky_count",
        (F.col("total") - F.col("safe_count") - F.col("risky_count")).alias("unknown_count"),
        F.when(F.col("total") > 0, F.bround(F.col("risky_count") * 100 / F.col("total"), 0))
        .otherwise(0)
        .cast("long")
        .alias("risk_score"),
    )


def ecosystem_counts(report: DataFrame, deps: DataFrame) -> DataFrame:
    """Packages by ecosystem for the scans of the report."""
    return (
        deps.filter(F.coalesce(F.col("ecosystem"), F.lit("")) != "")
        .join(report.select("scan_id"), "scan_id", "left_semi")
        .groupBy("scan_id", "ecosystem")
        .agg(F.count("*").alias("packages"))
    )


def risky_dependencies(report: DataFrame, deps: DataFrame) -> DataFrame:
    """The risky packages of those scans."""
    return (
        deps.filter(F.col("license_risk") == "risky")
        .join(report.select("scan_id"), "scan_id", "left_semi")
        .select("scan_id", "name", "version", "ecosystem", "license_spdx", "license_raw")
    )


def only_risky(report: DataFrame) -> DataFrame:
    """P13."""
    return report.filter(F.col("risky_count") > 0)


def license_totals(report: DataFrame) -> DataFrame:
    """A21."""
    return report.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_dependencies"),
        F.coalesce(F.sum("risky_count"), F.lit(0)).alias("total_risky"),
        F.count_if(F.col("risky_count") > 0).alias("repositories_with_risky"),
    )


# --- personal data -----------------------------------------------------------


def personal_data_counts(findings: DataFrame) -> DataFrame:
    """Findings by scan and type."""
    return findings.groupBy("scan_id", "pdn_type").agg(F.count("*").alias("count"))


def personal_data_report(prs: DataFrame, projects: DataFrame, repositories: DataFrame, scans: DataFrame,
                         findings: DataFrame) -> DataFrame:
    """Per repository's latest scan the findings in all and by type."""
    repos = _repository_scans(prs, projects, scans)
    counts = (
        personal_data_counts(findings.join(repos.select("scan_id"), "scan_id", "left_semi"))
        .groupBy("scan_id")
        .agg(
            F.sum("count").alias("findings"),
            F.sort_array(F.collect_list(F.struct("pdn_type", "count"))).alias("counts"),
        )
    )
    ref = scan_ref(F.col("commit_sha"), F.col("branch"), F.col("default_branch"))
    null = F.lit(None)
    return (
        repos.join(counts, "scan_id", "left")
        .join(repositories.select(F.col("id").alias("repository_id"), "url", "provider"), "repository_id")
        .select(
            "project_id", "project_name", F.col(PR).alias("repository_id"), "repository_name", "scan_id",
            F.col("started_at").alias("scan_started_at"),
            F.col("completed_at").alias("scan_completed_at"),
            F.coalesce("findings", F.lit(0)).alias("findings"),
            F.coalesce("counts", F.array().cast("array<struct<pdn_type:string,count:bigint>>")).alias("counts"),
            source_url(
                F.col("url"), F.col("provider"), ref, null.cast("string"), null.cast("long")
            ).alias("repository_source_url"),
        )
    )


def only_with_findings(report: DataFrame) -> DataFrame:
    """P13."""
    return report.filter(F.col("findings") > 0)


def pdn_totals(report: DataFrame) -> DataFrame:
    """A21."""
    found = F.col("findings") > 0
    return report.agg(
        F.count_distinct(F.when(found, F.col("project_id"))).alias("projects_with_findings"),
        F.count_if(found).alias("repositories_with_findings"),
        F.coalesce(F.sum("findings"), F.lit(0)).alias("total_findings"),
    )


def scan_personal_data(findings: DataFrame, scans: DataFrame, prs: DataFrame, repositories: DataFrame) -> DataFrame:
    """Findings of every scan with a link to the line."""
    where = (
        scans.select(F.col("id").alias("scan_id"), PR, "commit_sha", "branch")
        .join(prs.select(F.col("id").alias(PR), "repository_id", "default_branch"), PR, "left")
        .join(repositories.select(F.col("id").alias("repository_id"), "url", "provider"), "repository_id", "left")
    )
    ref = scan_ref(F.col("commit_sha"), F.col("branch"), F.col("default_branch"))
    return findings.join(where, "scan_id").select(
        "scan_id", "pdn_type", "matched_identifier", "file_path", "line_number",
        source_url(F.col("url"), F.col("provider"), ref, F.col("file_path"), F.col("line_number")).alias("source_url"),
    )


def findings_ordered(findings: DataFrame) -> DataFrame:
    """T8."""
    return findings.orderBy("scan_id", "pdn_type", "file_path", "line_number", "matched_identifier")


# --- scans -------------------------------------------------------------------

QUEUE_SORTS = {
    "id": lambda as_of: F.col("id"),
    "queued": lambda as_of: F.col("created_at"),
    "started": lambda as_of: F.col("started_at"),
    "duration": lambda as_of: duration_days(F.col("started_at"), F.col("completed_at"), as_of),
    "status": lambda as_of: F.col("status"),
}


def scan_queue(scans: DataFrame, prs: DataFrame, projects: DataFrame, as_of: str, sort_by: str = "id",
               sort_order: str = "desc", project: str | None = None, repository: str | None = None,
               status: str | None = None, offset: int = 0, limit: int = 100, shallow: int = SHALLOW) -> DataFrame:
    """One page of scans; nulls come last upwards and first downwards."""
    if not (0 <= offset and 1 <= limit <= 500):
        raise ValueError("offset must be 0 or more, limit between 1 and 500")
    rows = queue_filtered(queue_rows(scans, prs, projects), project, repository, status)
    clock = F.lit(as_of).cast("timestamp")
    key = QUEUE_SORTS.get(sort_by, QUEUE_SORTS["id"])(clock)
    return page(rows.withColumn("_key", key), [F.col("_key").asc_nulls_last() if sort_order == "asc" else F.col("_key").desc_nulls_first(), F.col("id")],
                offset, limit, shallow).drop("_key")


def queue_filtered(rows: DataFrame, project: str | None = None, repository: str | None = None,
                   status: str | None = None) -> DataFrame:
    """P12."""
    if project:
        rows = rows.filter(F.col("project_name").ilike(f"%{project}%"))
    if repository:
        rows = rows.filter(F.col("repository_name").ilike(f"%{repository}%"))
    if status:
        rows = rows.filter(F.col("status") == status)
    return rows


def oldest_pending(scans: DataFrame) -> DataFrame:
    """T12."""
    return (
        scans.filter(F.col("status") == "pending")
        .orderBy("created_at", "id")
        .limit(1)
    )


def risk_counts(scan_risks: DataFrame) -> DataFrame:
    """A22."""
    return scan_risks.groupBy("scan_id", "severity").agg(F.count("*").alias("count"))


def ui_sort(rows: DataFrame, column: str, order: str, tie: str) -> DataFrame:
    """Nulls as '', strings lower-cased."""
    is_text = dict(rows.dtypes)[column] == "string"
    key = F.lower(F.coalesce(F.col(column), F.lit(""))) if is_text else F.col(column)
    ordered = key.asc_nulls_first() if order == "asc" else key.desc_nulls_last()
    return rows.orderBy(ordered, tie)
