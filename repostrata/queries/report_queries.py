"""Scan views, licence and personal-data reports, queue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..bindings import AS_OF, Tables
from ..operators import inventory as inv
from ..operators.latest import queue_rows
from ..plans import reports as r
from ..session import checkpoint_dir
from ..sources import layout
from ..sources import tables as st
from .canonical_sql import oracle


def _licences(t: Tables):
    return r.license_dependencies_report(t.project_repositories(), t.projects(), t.scans(), t.dependencies())


def _personal(t: Tables):
    return r.personal_data_report(
        t.project_repositories(), t.projects(), t.repositories(), t.scans(), t.findings()
    ).withColumn(
        "counts", F.array_join(F.transform("counts", lambda c: F.concat_ws("=", c["pdn_type"], c["count"].cast("string"))), ",")
    )


def _queue(t: Tables, **options):
    return r.scan_queue(t.scans(), t.project_repositories(), t.projects(), AS_OF, **options).select(*QUEUE)


QUEUE = ["id", "project_name", "repository_name", "status", "branch", "created_at", "started_at", "completed_at"]
QUEUE_SQL = """
SELECT s.id, p.name AS project_name, r.name AS repository_name, s.status, s.branch, s.created_at, s.started_at, s.completed_at
FROM scans s JOIN prs r ON r.id = s.project_repository_id JOIN projects p ON p.id = r.project_id
"""
REPO_SCANS = """
SELECT p.id AS project_id, p.name AS project_name, r.id AS repository_id, r.name AS repository_name, l.id AS scan_id,
       l.started_at AS scan_started_at, l.completed_at AS scan_completed_at, r.repository_id AS rid,
       coalesce(nullif(l.commit_sha, ''), nullif(l.branch, ''), r.default_branch, 'HEAD') AS ref
FROM latest l JOIN prs r ON r.id = l.project_repository_id JOIN projects p ON p.id = r.project_id
"""
LICENCE_REPORT = f"""
SELECT project_id, project_name, repository_id, repository_name, x.scan_id, scan_started_at, scan_completed_at,
  count(d.scan_id) AS total, count(*) FILTER (is_direct) AS direct_count, count(d.scan_id) - count(*) FILTER (is_direct) AS transitive_count,
  count(*) FILTER (license_risk = 'safe') AS safe_count, count(*) FILTER (license_risk = 'risky') AS risky_count,
  count(d.scan_id) - count(*) FILTER (license_risk IN ('safe', 'risky')) AS unknown_count,
  CASE WHEN count(d.scan_id) > 0 THEN round_even(count(*) FILTER (license_risk = 'risky') * 100 / count(d.scan_id), 0)::BIGINT ELSE 0 END AS risk_score
FROM ({REPO_SCANS}) x LEFT JOIN dependencies d ON d.scan_id = x.scan_id GROUP BY ALL
"""
# Browse URLs of the bound repositories.
WEB = """CASE WHEN g.id % 2 = 0 THEN 'https://git.example.org/team/repo_' || g.id ELSE 'https://github.com/team/repo_' || g.id END"""
TREE = "CASE g.provider WHEN 'github' THEN '/tree/' WHEN 'gitlab' THEN '/-/tree/' ELSE '/src/' END"
BLOB = "CASE g.provider WHEN 'github' THEN '/blob/' WHEN 'gitlab' THEN '/-/blob/' ELSE '/src/' END"
MARK = "CASE g.provider WHEN 'bitbucket' THEN '#lines-' ELSE '#L' END"
PERSONAL_REPORT = f"""
SELECT project_id, project_name, repository_id, repository_name, x.scan_id, scan_started_at, scan_completed_at,
  coalesce(c.findings, 0)::BIGINT AS findings, coalesce(c.counts, '') AS counts,
  {WEB} || {TREE} || replace(ref, '/', '%2F') AS repository_source_url
FROM ({REPO_SCANS}) x JOIN repositories g ON g.id = x.rid LEFT JOIN
  (SELECT scan_id, sum(n) AS findings, string_agg(pdn_type || '=' || n, ',' ORDER BY pdn_type) AS counts
   FROM (SELECT scan_id, pdn_type, count(*) AS n FROM findings GROUP BY ALL) GROUP BY scan_id) c ON c.scan_id = x.scan_id
"""
SUMMARY = """
SELECT scan_id, count(*) AS total, count(*) FILTER (is_direct) AS direct_count, count(*) FILTER (NOT is_direct) AS transitive_count,
  count(*) FILTER (license_risk NOT IN ('risky', 'safe')) AS unknown_count, count(*) FILTER (license_risk = 'risky') AS risky_count,
  count(*) FILTER (license_risk = 'safe') AS safe_count,
  least(100, round_even(count(*) FILTER (license_risk = 'risky') / greatest(count(*), 1) * 100, 0)::BIGINT) AS risk_score,
  count(*) FILTER (class = 'permissive') AS permissive_count, count(*) FILTER (class = 'weak_copyleft') AS weak_copyleft_count,
  count(*) FILTER (class = 'strong_copyleft') AS strong_copyleft_count
FROM classified GROUP BY scan_id
"""
PACKAGES = """
SELECT scan_id, name, version, ecosystem, coalesce(package_manager, ecosystem) AS package_manager, dep_type AS dependency_type,
  is_direct, NOT is_direct AS is_transitive, dep_type IN ('dev', 'test') AS is_dev_dependency, is_optional_dependency, is_private,
  manifest_file AS source_manifest, discovery_mode, license_raw, license_spdx AS license_normalized, license_expression,
  license_confidence, license_source, license_notes, class AS license_classification, license_risk
FROM classified
"""
CSV = f"""
SELECT scan_id, name, coalesce(version, '') AS version, ecosystem, package_manager, dependency_type, is_direct, is_transitive,
  is_dev_dependency, is_optional_dependency, is_private, source_manifest, discovery_mode, coalesce(license_raw, '') AS license_raw,
  coalesce(license_normalized, '') AS license_normalized, coalesce(license_expression, '') AS license_expression, license_confidence,
  coalesce(license_source, '') AS license_source, coalesce(license_notes, '') AS license_notes, license_classification, license_risk
FROM ({PACKAGES})
"""
PROBLEMS = """
SELECT scan_id, CASE WHEN is_private AND license_spdx IS NULL THEN 'private_unknown_license'
    WHEN license_spdx IS NULL AND license_raw IS NULL THEN 'missing_license' ELSE 'ambiguous_license' END AS type,
  name AS package, ecosystem, CASE WHEN is_private AND license_spdx IS NULL THEN 'Private/internal package with no license metadata'
    WHEN license_spdx IS NULL AND license_raw IS NULL THEN 'No license metadata found'
    ELSE coalesce(license_notes, 'License identification has low confidence') END AS details
FROM dependencies WHERE (is_private AND license_spdx IS NULL) OR (license_spdx IS NULL AND license_raw IS NULL) OR license_confidence = 'low'
"""
REPORT_SUMMARY = """
SELECT scan_id, count(*) AS total_packages, count(*) FILTER (is_direct) AS direct_packages,
  count(*) FILTER (NOT is_direct) AS transitive_packages, count(license_spdx) AS licensed_packages,
  count(*) FILTER (license_spdx IS NULL) AS unknown_license_packages, count(*) FILTER (license_risk = 'risky') AS risky_count,
  count(*) FILTER (license_risk = 'safe') AS safe_count, count(*) FILTER (class = 'permissive') AS permissive_count,
  count(*) FILTER (class = 'weak_copyleft') AS weak_copyleft_count, count(*) FILTER (class = 'strong_copyleft') AS strong_copyleft_count,
  count(*) FILTER (class = 'unknown') AS unknown_class_count
FROM classified GROUP BY scan_id
"""


def _documents(t: Tables):
    docs = inv.license_documents(t.dependencies(), t.scans(), t.project_repositories())
    return docs.select(
        "repository", "scan_id", "scan_time", "commit_sha", "branch",
        F.array_join("ecosystems", ",").alias("ecosystems"),
        F.size("packages").cast("long").alias("packages"),
        F.array_join(F.transform("packages", lambda p: p["name"]), ",").alias("package_names"),
        F.col("summary.licensed_packages").alias("licensed_packages"),
        F.array_join(F.map_keys("by_license"), ",").alias("licenses"),
        F.greatest(F.size(F.coalesce("problems", F.array())), F.lit(0)).cast("long").alias("problems"),
    )


def _laid_out(t: Tables, facts) -> str:
    """Facts stored by scan, under a name of their own."""
    name = f"facts_{uuid.uuid4().hex}"
    layout.write_laid_out(facts, name, f"{checkpoint_dir(t.spark)}/{name}", 8)
    return name


QUERIES = {
    "a18_license_dependencies_report": (_licences, oracle(LICENCE_REPORT)),
    "a18_ecosystem_counts": (
        lambda t: r.ecosystem_counts(_licences(t), t.dependencies()),
        oracle("SELECT scan_id, ecosystem, count(*) AS packages FROM dependencies WHERE scan_id IN (SELECT id FROM latest) GROUP BY ALL"),
    ),
    "a18_risky_dependencies": (
        lambda t: r.risky_dependencies(_licences(t), t.dependencies()),
        oracle("""SELECT scan_id, name, version, ecosystem, license_spdx, license_raw FROM dependencies
                  WHERE license_risk = 'risky' AND scan_id IN (SELECT id FROM latest)"""),
    ),
    "p13_only_risky": (
        lambda t: r.only_risky(_licences(t)),
        oracle(f"SELECT * FROM ({LICENCE_REPORT}) WHERE risky_count > 0"),
    ),
    "a21_license_totals": (
        lambda t: r.license_totals(_licences(t)),
        oracle(f"""SELECT sum(total)::BIGINT AS total_dependencies, sum(risky_count)::BIGINT AS total_risky,
                   count(*) FILTER (risky_count > 0) AS repositories_with_risky FROM ({LICENCE_REPORT})"""),
    ),
    "e16_license_report_sorted": (
        lambda t: r.ui_sort(_licences(t), "repository_name", "asc", "scan_id").select("repository_name", "risky_count"),
        oracle(f"SELECT repository_name, risky_count FROM ({LICENCE_REPORT})"),
    ),
    "t11_ui_sorts": (
        lambda t: r.ui_sort(t.profiles(), "display_name", "asc", "id").select("id", "display_name"),
        oracle("SELECT id, display_name FROM profiles"),
    ),
    "a19_personal_data_counts": (
        lambda t: r.personal_data_counts(t.findings()),
        oracle("SELECT scan_id, pdn_type, count(*) AS count FROM findings GROUP BY ALL"),
    ),
    "a20_personal_data_report": (_personal, oracle(PERSONAL_REPORT)),
    "p13_only_with_findings": (
        lambda t: r.only_with_findings(_personal(t)).select("repository_id", "findings"),
        oracle(f"SELECT repository_id, findings FROM ({PERSONAL_REPORT}) WHERE findings > 0"),
    ),
    "a21_pdn_totals": (
        lambda t: r.pdn_totals(_personal(t)),
        oracle(f"""SELECT count(DISTINCT project_id) FILTER (findings > 0) AS projects_with_findings,
                   count(*) FILTER (findings > 0) AS repositories_with_findings, sum(findings)::BIGINT AS total_findings FROM ({PERSONAL_REPORT})"""),
    ),
    "e12_scan_personal_data": (
        lambda t: r.scan_personal_data(t.findings(), t.scans(), t.project_repositories(), t.repositories()),
        oracle(f"""SELECT scan_id, pdn_type, matched_identifier, file_path, line_number,
                     {WEB} || {BLOB} || replace(coalesce(s.commit_sha, s.branch, 'main'), '/', '%2F') || '/' ||
                     replace(file_path, ' ', '%20') || CASE WHEN line_number > 0 THEN {MARK} || line_number ELSE '' END AS source_url
                   FROM findings f JOIN scans s ON s.id = f.scan_id JOIN prs r ON r.id = s.project_repository_id
                   JOIN repositories g ON g.id = r.repository_id"""),
    ),
    "t8_findings_ordered": (
        lambda t: r.findings_ordered(t.findings()),
        oracle("SELECT * FROM findings"),
    ),
    "t8_scans_by_created": (
        lambda t: t.scans().orderBy(F.desc("created_at"), "id").select("id", "created_at"),
        oracle("SELECT id, created_at FROM scans"),
    ),
    "j7_queue_rows": (
        lambda t: queue_rows(t.scans(), t.project_repositories(), t.projects()).select(*QUEUE),
        oracle(QUEUE_SQL),
    ),
    "p12_queue_filters": (
        lambda t: r.queue_filtered(
            queue_rows(t.scans(), t.project_repositories(), t.projects()), "ia", "_1", "running"
        ).select(*QUEUE),
        oracle(QUEUE_SQL + "WHERE p.name ILIKE '%ia%' AND r.name ILIKE '%_1%' AND s.status = 'running'"),
    ),
    "e14_scan_queue": (
        lambda t: _queue(t, sort_by="started", sort_order="desc", status="completed", offset=10, limit=50),
        oracle(QUEUE_SQL + "WHERE s.status = 'completed' ORDER BY s.started_at DESC NULLS FIRST, s.id LIMIT 50 OFFSET 10"),
    ),
    "t6_deep_page": (
        lambda t: _queue(t, sort_by="queued", sort_order="desc", offset=12_000, limit=500),
        oracle(QUEUE_SQL + "ORDER BY s.created_at DESC NULLS FIRST, s.id LIMIT 500 OFFSET 12000"),
    ),
    "t6_queue_page": (
        lambda t: _queue(t, sort_by="duration", sort_order="asc", limit=500),
        oracle(QUEUE_SQL + f"""ORDER BY epoch_us(coalesce(s.completed_at, TIMESTAMP '{AS_OF}')) - epoch_us(s.started_at)
                               ASC NULLS LAST, s.id LIMIT 500"""),
    ),
    "t12_oldest_pending": (
        lambda t: r.oldest_pending(t.scans()).select("id", "created_at"),
        oracle("SELECT id, created_at FROM scans WHERE status = 'pending' ORDER BY created_at, id LIMIT 1"),
    ),
    "a22_risk_counts": (
        lambda t: r.risk_counts(t.scan_risks()),
        oracle("SELECT scan_id, severity, count(*) AS count FROM scan_risks GROUP BY ALL"),
    ),
    "a16_license_summary": (lambda t: inv.license_summary(t.dependencies()), oracle(SUMMARY)),
    "a16_license_summary_laid_out": (
        lambda t: inv.license_summary(layout.read_laid_out(t.spark, _laid_out(t, t.dependencies())).drop(layout.RANGE)),
        oracle(SUMMARY),
    ),
    "a13_latest_facts_laid_out": (
        lambda t: layout.of_latest_scans(t.spark, _laid_out(t, t.scan_languages()), t.scans()).groupBy("language").agg(
            F.sum("loc").alias("total_loc"), F.sum("file_count").alias("total_files"), F.count("*").alias("repo_count")),
        oracle("""SELECT language, sum(loc)::BIGINT AS total_loc, sum(file_count)::BIGINT AS total_files, count(*) AS repo_count
                  FROM scan_languages WHERE scan_id IN (SELECT id FROM latest) GROUP BY ALL""", "scan_languages", "latest"),
    ),
    "a16_license_counts": (
        lambda t: inv.license_counts(t.dependencies()),
        oracle("SELECT scan_id, coalesce(license_spdx, 'unknown') AS license, count(*) AS packages FROM dependencies GROUP BY ALL"),
    ),
    "t9_top_licenses": (
        lambda t: inv.top_licenses(t.dependencies()),
        oracle("""SELECT coalesce(license_spdx, 'unknown') AS license, count(*) AS packages FROM dependencies GROUP BY ALL
                  ORDER BY packages DESC, license LIMIT 10"""),
    ),
    "a17_license_report_summary": (lambda t: inv.license_report_summary(t.dependencies()), oracle(REPORT_SUMMARY)),
    "l11_license_packages": (lambda t: inv.license_packages(t.dependencies()), oracle(PACKAGES)),
    "l12_license_problems": (lambda t: inv.license_problems(t.dependencies()), oracle(PROBLEMS)),
    "s7_license_csv": (lambda t: inv.license_csv(t.dependencies()), oracle(CSV)),
    "s8_license_json": (
        _documents,
        oracle(f"""SELECT r.name AS repository, s.id AS scan_id, coalesce(s.completed_at, s.started_at) AS scan_time, commit_sha, branch,
                     ecosystems, packages, package_names, licensed, licenses, problems
                   FROM scans s JOIN prs r ON r.id = s.project_repository_id
                   JOIN (SELECT scan_id, string_agg(DISTINCT ecosystem, ',' ORDER BY ecosystem) AS ecosystems, count(*) AS packages,
                           string_agg(name, ',' ORDER BY name) AS package_names, count(license_spdx) AS licensed
                         FROM dependencies GROUP BY scan_id) d ON d.scan_id = s.id
                   JOIN (SELECT scan_id, string_agg(l, ',' ORDER BY n DESC, l) AS licenses FROM
                           (SELECT scan_id, coalesce(license_spdx, 'unknown') AS l, count(*) AS n FROM dependencies GROUP BY ALL) GROUP BY scan_id) x
                     ON x.scan_id = s.id
                   JOIN (SELECT d.scan_id, count(p.scan_id) AS problems FROM (SELECT DISTINCT scan_id FROM dependencies) d
                         LEFT JOIN ({PROBLEMS}) p USING (scan_id) GROUP BY d.scan_id) q ON q.scan_id = s.id""").replace(
            "licensed, licenses", "licensed AS licensed_packages, licenses"),
    ),
    "s10_replace_children": (
        lambda t: st.replace_children(
            t.developer_tags(),
            t.profiles().select("developer_id", F.when(F.col("developer_id") % 2 == 0, F.lit("team")).alias("tag"))
            .filter(F.col("developer_id") % 3 == 0).distinct(),
            "developer_id",
        ),
        oracle("""SELECT developer_id, tag FROM developer_tags WHERE developer_id % 3 <> 0
                  UNION ALL SELECT DISTINCT developer_id, 'team' FROM profiles WHERE developer_id % 6 = 0"""),
    ),
    "p11_eq_filters": (
        lambda t: t.scan_scores().filter(F.col("domain") == "overall").select("scan_id", "score"),
        oracle("SELECT scan_id, score FROM scan_scores WHERE domain = 'overall'"),
    ),
    "e10_scan_views": (
        lambda t: t.scans().select(F.col("id").alias("scan_id"), "status", "total_loc")
        .join(t.scan_scores(), "scan_id").join(t.scan_risks().groupBy("scan_id").agg(F.count("*").alias("risks")), "scan_id"),
        oracle("""SELECT s.id AS scan_id, status, total_loc, domain, score, risks FROM scans s JOIN scan_scores c ON c.scan_id = s.id
                  JOIN (SELECT scan_id, count(*) AS risks FROM scan_risks GROUP BY 1) r ON r.scan_id = s.id"""),
    ),
}
