"""Licence inventory of scanned dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.licensing import classify_license

# Columns of the CSV export, in order.
CSV_COLUMNS = [
    "name", "version", "ecosystem", "package_manager",
    "dependency_type", "is_direct", "is_transitive",
    "is_dev_dependency", "is_optional_dependency", "is_private",
    "source_manifest", "discovery_mode",
    "license_raw", "license_normalized", "license_expression",
    "license_confidence", "license_source", "license_notes",
    "license_classification", "license_risk",
]
# Wording of the problem list and version of the report.
PRIVATE_UNKNOWN = "Private/internal package with no license metadata"
MISSING = "No license metadata found"
LOW_CONFIDENCE = "License identification has low confidence"
REPORT_VERSION = "1.0.0"


def license_packages(deps: DataFrame) -> DataFrame:
    """scan_id and the 20 report fields of each package."""
    return deps.select(
        "scan_id",
        "name",
        "version",
        "ecosystem",
        F.coalesce("package_manager", "ecosystem").alias("package_manager"),
        F.col("dep_type").alias("dependency_type"),
        "is_direct",
        (~F.col("is_direct")).alias("is_transitive"),
        F.col("dep_type").isin("dev", "test").alias("is_dev_dependency"),
        "is_optional_dependency",
        "is_private",
        F.col("manifest_file").alias("source_manifest"),
        "discovery_mode",
        "license_raw",
        F.col("license_spdx").alias("license_normalized"),
        "license_expression",
        "license_confidence",
        "license_source",
        "license_notes",
        classify_license(F.col("license_spdx")).alias("license_classification"),
        "license_risk",
    )


def license_problems(deps: DataFrame) -> DataFrame:
    """The first problem of each package."""
    no_spdx = F.col("license_spdx").isNull()
    kind = (
        F.when(F.col("is_private") & no_spdx, "private_unknown_license")
        .when(no_spdx & F.col("license_raw").isNull(), "missing_license")
        .when(F.col("license_confidence") == "low", "ambiguous_license")
    )
    details = (
        F.when(kind == "private_unknown_license", PRIVATE_UNKNOWN)
        .when(kind == "missing_license", MISSING)
        .otherwise(F.coalesce(F.when(F.col("license_notes") != "", F.col("license_notes")), F.lit(LOW_CONFIDENCE)))
    )
    return deps.withColumn("type", kind).filter(F.col("type").isNotNull()).select(
        "scan_id", "type", F.col("name").alias("package"), "ecosystem", details.alias("details")
    )


def _class_counts() -> list[Column]:
    cls = classify_license(F.col("license_spdx"))
    return [F.count_if(cls == name).alias(f"{name}_count") for name in dims.LICENSE_CLASSES[:3]]


def license_summary(deps: DataFrame, key: str = "scan_id") -> DataFrame:
    """Totals, classes and risk score of each scan."""
    risky = F.count_if(F.col("license_risk") == "risky")
    safe = F.count_if(F.col("license_risk") == "safe")
    total = F.count("*")
    return deps.groupBy(key).agg(
        total.alias("total"),
        F.count_if("is_direct").alias("direct_count"),
        (total - F.count_if("is_direct")).alias("transitive_count"),
        (total - risky - safe).alias("unknown_count"),
        risky.alias("risky_count"),
        safe.alias("safe_count"),
        F.least(F.lit(100), F.bround(risky / F.greatest(total, F.lit(1)) * 100, 0).cast("long")).alias(
            "risk_score"
        ),
        *_class_counts(),
    )


def license_counts(deps: DataFrame, key: str = "scan_id") -> DataFrame:
    """Packages by licence, unknown for none."""
    spdx = F.coalesce(F.when(F.col("license_spdx") != "", F.col("license_spdx")), F.lit("unknown"))
    return deps.groupBy(key, spdx.alias("license")).agg(F.count("*").alias("packages"))


def top_licenses(deps: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent licences over all given dependencies."""
    spdx = F.coalesce(F.when(F.col("license_spdx") != "", F.col("license_spdx")), F.lit("unknown"))
    return (
        deps.groupBy(spdx.alias("license"))
        .agg(F.count("*").alias("packages"))
        .orderBy(F.desc("packages"), "license")
        .limit(n)
    )


def license_report_summary(deps: DataFrame) -> DataFrame:
    """Summary block of the report, one row per scan."""
    total, direct = F.count("*"), F.count_if("is_direct")
    return deps.groupBy("scan_id").agg(
        total.alias("total_packages"),
        direct.alias("direct_packages"),
        (total - direct).alias("transitive_packages"),
        F.count("license_spdx").alias("licensed_packages"),
        F.count_if(F.col("license_spdx").isNull()).alias("unknown_license_packages"),
        F.count_if(F.col("license_risk") == "risky").alias("risky_count"),
        F.count_if(F.col("license_risk") == "safe").alias("safe_count"),
        *_class_counts(),
        F.count_if(classify_license(F.col("license_spdx")) == "unknown").alias("unknown_class_count"),
    )


def license_csv(deps: DataFrame) -> DataFrame:
    """The export columns with nulls as ''."""
    packages = license_packages(deps)
    booleans = {f.name for f in packages.schema if f.dataType.typeName() == "boolean"}
    return packages.select(
        "scan_id",
        *[
            F.col(c) if c in booleans else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
            for c in CSV_COLUMNS
        ],
    )


def write_license_csv(deps: DataFrame, target: str) -> None:
    """CSV files with a header, one folder per scan range."""
    license_csv(deps).write.mode("overwrite").option("header", True).option(
        "escape", '"'
    ).option("emptyValue", "").csv(target)


def license_documents(deps: DataFrame, scans: DataFrame, prs: DataFrame) -> DataFrame:
    """Per scan one row with nested packages, summary maps and problems.

    A report is one document by definition, so its packages end up in one row.
    """
    packages = license_packages(deps)
    fields = [c for c in packages.columns if c != "scan_id"]
    listed = packages.groupBy("scan_id").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("packages"),
        F.sort_array(F.collect_set("ecosystem")).alias("ecosystems"),
    )
    by_license = license_counts(deps).groupBy("scan_id").agg(
        F.map_from_entries(
            F.transform(
                F.sort_array(F.collect_list(F.struct((-F.col("packages")).alias("o"), "license", "packages"))),
                lambda e: F.struct(e["license"], e["packages"]),
            )
        ).alias("by_license")
    )
    problems = license_problems(deps).groupBy("scan_id").agg(
        F.sort_array(F.collect_list(F.struct("type", "package", "ecosystem", "details"))).alias("problems")
    )
    summary = license_report_summary(deps)
    blocks = [c for c in summary.columns if c != "scan_id"]
    head = scans.select(
        F.col("id").alias("scan_id"),
        F.col("project_repository_id"),
        F.coalesce("completed_at", "started_at").alias("scan_time"),
        "commit_sha",
        "branch",
    ).join(prs.select(F.col("id").alias("project_repository_id"), F.col("name").alias("repository")), "project_repository_id", "left")
    return (
        head.join(listed, "scan_id")
        .join(summary.select("scan_id", F.struct(*blocks).alias("summary")), "scan_id")
        .join(by_license, "scan_id")
        .join(problems, "scan_id", "left")
        .select(
            F.coalesce("repository", F.concat(F.lit("repository-"), "project_repository_id")).alias("repository"),
            "scan_id",
            "scan_time",
            F.lit(REPORT_VERSION).alias("scanner_version"),
            "commit_sha",
            "branch",
            "ecosystems",
            "packages",
            "summary",
            "by_license",
            "problems",
        )
    )


def write_license_json(documents: DataFrame, target: str) -> None:
    """One JSON document per line."""
    documents.write.mode("overwrite").json(target)
