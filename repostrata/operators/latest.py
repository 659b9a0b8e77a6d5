"""The latest completed scan and the joins around scans.

Only the ids of the latest scans are aggregated, with a partial step, so a repository
that owns most of the scans sends one row per task. The wide rows are then picked by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PR = "project_repository_id"


def latest_scan_ids(scans: DataFrame) -> DataFrame:
    """Per repository the id of the completed scan with the greatest (started_at, id).

    A missing start comes before any other; ids may be negative.
    """
    return (
        scans.filter(F.col("status") == "completed")
        .groupBy(PR)
        .agg(F.max(F.struct("started_at", "id")).alias("key"))
        .select("key.id")
    )


def latest_scan(scans: DataFrame) -> DataFrame:
    """The rows of the latest completed scans, at most one per repository."""
    return scans.join(latest_scan_ids(scans), "id", "left_semi").select(*scans.columns)


def pr_latest_scan(prs: DataFrame, scans: DataFrame, how: str = "left") -> DataFrame:
    """Repositories with their latest scan under `scan_*` free names."""
    latest = latest_scan(scans).withColumnRenamed("id", "scan_id")
    return prs.withColumnRenamed("id", PR).join(latest, PR, how)


def queue_rows(scans: DataFrame, prs: DataFrame, projects: DataFrame) -> DataFrame:
    """Scans with repository and project names."""
    return scans.join(
        prs.select(
            F.col("id").alias(PR), F.col("name").alias("repository_name"), "project_id"
        ),
        PR,
    ).join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id")
