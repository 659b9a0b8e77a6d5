"""Projects, repositories, trees, technology and size history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import AS_OF, Tables
from ..operators import latest
from ..operators.merges import natural_id
from ..plans import portfolio as p
from .canonical_sql import oracle


def _summary(t: Tables):
    return p.project_summary(t.projects(), t.project_repositories(), t.scans(), t.scan_scores())


def _repos(t: Tables):
    return p.repos_with_latest_scan(t.project_repositories(), t.repositories(), t.scans(), t.scan_scores())


def _tech(t: Tables):
    return p.tech_repos(t.projects(), t.project_repositories(), t.scans())


SUMMARY = """
SELECT p.id, p.name, p.description, count(r.id) AS repo_count, count(l.id) AS repos_with_completed_scan,
       CASE WHEN count(l.id) > 0 THEN coalesce(sum(l.total_loc), 0)::BIGINT END AS total_loc,
       CASE WHEN count(l.id) > 0 THEN coalesce(sum(l.total_files), 0)::BIGINT END AS total_files,
       avg(s.score) AS avg_score, max(l.completed_at) AS last_scan_at
FROM projects p LEFT JOIN prs r ON r.project_id = p.id
LEFT JOIN latest l ON l.project_repository_id = r.id
LEFT JOIN scan_scores s ON s.scan_id = l.id AND s.domain = 'overall'
GROUP BY p.id, p.name, p.description
"""

REPOS = """
SELECT r.id, r.project_id, r.repository_id, r.name, r.default_branch, g.url, g.provider, l.id AS scan_id, l.started_at,
       l.completed_at, l.total_loc, l.total_files, l.project_type, l.primary_language, s.score AS overall_score
FROM prs r LEFT JOIN repositories g ON g.id = r.repository_id
LEFT JOIN latest l ON l.project_repository_id = r.id
LEFT JOIN scan_scores s ON s.scan_id = l.id AND s.domain = 'overall'
"""


def _tree_sql(values: str, keep: str) -> str:
    return f"""
WITH v AS ({values}),
pv AS (SELECT p.id, p.name, coalesce(sum(v.value), 0)::BIGINT AS value FROM projects p {keep} JOIN v ON v.project_id = p.id
       GROUP BY p.id, p.name)
SELECT 'repository' AS level, id, project_id AS parent_id, name, value::BIGINT AS value FROM v
UNION ALL SELECT 'project', id, NULL, name, value FROM pv
UNION ALL SELECT 'root', NULL, NULL, 'root', coalesce(sum(value), 0)::BIGINT FROM pv
"""


def _size_sql(value: str) -> str:
    return f"""
WITH months AS (SELECT unnest(generate_series(TIMESTAMP '1996-09-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH))::DATE AS m),
done AS (SELECT * FROM scans WHERE status = 'completed'),
grid AS (SELECT project_repository_id, last_day(m) AS month_end
         FROM (SELECT DISTINCT project_repository_id FROM done) CROSS JOIN months),
months_filled AS (
  SELECT g.project_repository_id, g.month_end, arg_max(coalesce(d.{value}, 0), (d.created_at, d.id)) AS value
  FROM grid g LEFT JOIN done d ON d.project_repository_id = g.project_repository_id AND d.created_at::DATE <= g.month_end
  GROUP BY ALL)
"""


_MONTHS_LOC = _size_sql("total_loc").replace(
    "arg_max(coalesce(d.total_loc, 0), (d.created_at, d.id))",
    "CASE WHEN count(d.id) > 0 THEN arg_max(coalesce(d.total_loc, 0), (d.created_at, d.id)) END",
)
_MONTHS_FILES = _size_sql("total_files").replace(
    "arg_max(coalesce(d.total_files, 0), (d.created_at, d.id))",
    "CASE WHEN count(d.id) > 0 THEN arg_max(coalesce(d.total_files, 0), (d.created_at, d.id)) END",
)


def _months(t: Tables, metric: str = "loc"):
    return p.size_months(t.scans(), AS_OF, 5, metric)


TECH_ITEMS = """
SELECT 'framework' AS kind, unnest(frameworks) AS name FROM tech
UNION ALL SELECT 'ci_provider', ci_provider FROM tech WHERE ci_provider IS NOT NULL
UNION ALL SELECT 'package_manager', unnest(package_managers) FROM tech
UNION ALL SELECT 'infra_tool', unnest(infra_tools) FROM tech
"""
TECH = "SELECT l.* FROM latest l JOIN prs r ON r.id = l.project_repository_id JOIN projects p ON p.id = r.project_id"

QUERIES = {
    "w1_latest_scan": (
        lambda t: latest.latest_scan(t.scans()).select(
            "id", "project_repository_id", "branch", "commit_sha", "total_loc", "started_at", "completed_at"
        ),
        oracle("SELECT id, project_repository_id, branch, commit_sha, total_loc, started_at, completed_at FROM latest"),
    ),
    "j3_pr_latest_scan": (
        lambda t: latest.pr_latest_scan(
            t.project_repositories(), t.scans().select("id", "project_repository_id", "status", "started_at", "total_loc")
        ).select("project_repository_id", "name", "scan_id", "started_at", "total_loc"),
        oracle("""SELECT r.id AS project_repository_id, r.name, l.id AS scan_id, l.started_at, l.total_loc
                  FROM prs r LEFT JOIN latest l ON l.project_repository_id = r.id"""),
    ),
    "s6_table_scan": (
        lambda t: t.scans().filter(F.col("status") == "completed").select("id", "project_repository_id", "total_loc"),
        oracle("SELECT id, project_repository_id, total_loc FROM scans WHERE status = 'completed'"),
    ),
    "a10_project_summary": (_summary, oracle(SUMMARY)),
    "e6_projects_summary": (
        lambda t: p.projects_summary(_summary(t), "avg_score", "desc", q="a", has_scans=True),
        oracle(f"""SELECT * FROM ({SUMMARY}) WHERE repos_with_completed_scan > 0
                   AND (contains(lower(coalesce(name, '')), 'a') OR contains(lower(coalesce(description, '')), 'a'))"""),
    ),
    "t4_projects_sorted": (
        lambda t: p.projects_summary(_summary(t), "loc", "desc"),
        oracle(f"SELECT * FROM ({SUMMARY})"),
    ),
    "p9_contains_any": (
        lambda t: p.projects_summary(_summary(t), q="folio").select("id", "name"),
        oracle("SELECT id, name FROM projects WHERE contains(lower(coalesce(description, '')), 'folio') OR contains(lower(name), 'folio')"),
    ),
    "p10_has_scans": (
        lambda t: p.repos_sorted(_repos(t), has_scans=True).select("id", "name", "scan_id"),
        oracle(f"SELECT id, name, scan_id FROM ({REPOS}) WHERE scan_id IS NOT NULL"),
    ),
    "e7_repos_with_latest_scan": (_repos, oracle(REPOS)),
    "t5_repos_sorted": (
        lambda t: p.repos_sorted(_repos(t), "last_updated", "desc").select("id", "name", "completed_at"),
        oracle(f"""SELECT id, name, completed_at FROM ({REPOS})"""),
    ),
    "a11_treemap": (
        lambda t: p.treemap(t.projects(), t.project_repositories(), t.scans(), "loc"),
        oracle(_tree_sql("""SELECT r.id, r.project_id, r.name, coalesce(l.total_loc, 0) AS value FROM prs r
                            JOIN latest l ON l.project_repository_id = r.id""", "LEFT")),
    ),
    "j27_treemap_join": (
        lambda t: p.treemap(t.projects(), t.project_repositories(), t.scans(), "files"),
        oracle(_tree_sql("""SELECT r.id, r.project_id, r.name, coalesce(l.total_files, 0) AS value FROM prs r
                            JOIN latest l ON l.project_repository_id = r.id""", "LEFT")),
    ),
    "a12_activity_tree": (
        lambda t: p.activity_tree(
            t.projects(), t.project_repositories(), p.commit_activity(t.repository_daily(), AS_OF, "3m")
        ),
        oracle(_tree_sql("""SELECT r.id, r.project_id, r.name, sum(d.commit_count)::BIGINT AS value FROM prs r
                            JOIN repository_daily d ON d.project_repository_id = r.id
                            WHERE d.commit_date >= DATE '2001-08-01' - 90 GROUP BY ALL HAVING sum(d.commit_count) > 0""", "")),
    ),
    "a12_activity_tree_lines": (
        lambda t: p.activity_tree(
            t.projects(), t.project_repositories(), p.line_activity(t.scans(), t.contributions())
        ),
        oracle(_tree_sql("""SELECT r.id, r.project_id, r.name, sum(c.insertions)::BIGINT AS value FROM prs r
                            JOIN latest l ON l.project_repository_id = r.id
                            JOIN contributions c ON c.scan_id = l.id GROUP BY ALL HAVING sum(c.insertions) > 0""", "")),
    ),
    "p15_date_cutoff": (
        lambda t: p.commit_activity(t.repository_daily(), AS_OF, "1m"),
        oracle("""SELECT project_repository_id AS id, sum(commit_count)::BIGINT AS value FROM repository_daily
                  WHERE commit_date >= DATE '2001-08-01' - 30 GROUP BY ALL"""),
    ),
    "a13_tech_lang_stats": (
        lambda t: p.tech_lang_stats(_tech(t), t.scan_languages()),
        oracle(f"""WITH tech AS ({TECH}) SELECT language, sum(loc)::BIGINT AS total_loc, sum(file_count)::BIGINT AS total_files,
                   count(*) AS repo_count FROM tech JOIN scan_languages s ON s.scan_id = tech.id GROUP BY ALL"""),
    ),
    "a14_tech_counts": (
        lambda t: p.tech_counts(_tech(t)),
        oracle(f"WITH tech AS ({TECH}) SELECT kind, name, count(*) AS count FROM ({TECH_ITEMS}) GROUP BY ALL"),
    ),
    "t10_count_maps_desc": (
        lambda t: p.count_maps_desc(p.tech_counts(_tech(t))).select("kind", F.to_json("counts").alias("counts")),
        oracle(f"""WITH tech AS ({TECH}), n AS (SELECT kind, name, count(*) AS c FROM ({TECH_ITEMS}) GROUP BY ALL)
                   SELECT kind, '[' || string_agg('{{"name":"' || name || '","count":' || c || '}}', ',' ORDER BY c DESC, name) || ']' AS counts
                   FROM n GROUP BY kind"""),
    ),
    "t11_top_languages": (
        lambda t: p.top_languages(_tech(t), t.scan_languages()).withColumn("rank", F.col("rank").cast("long")),
        oracle("""SELECT * FROM (SELECT l.project_repository_id AS repo_id, language, loc,
                    row_number() OVER (PARTITION BY l.project_repository_id ORDER BY loc DESC, language) AS rank
                  FROM latest l JOIN scan_languages s ON s.scan_id = l.id) WHERE rank <= 4"""),
    ),
    "e17_tech_map": (
        lambda t: _tech(t).select(
            "repo_id", "repo_name", "project_id", "project_name", "primary_language", "project_type",
            F.array_join("frameworks", ",").alias("frameworks"),
            F.array_join("package_managers", ",").alias("package_managers"),
            F.array_join("infra_tools", ",").alias("infra_tools"), "ci_provider", "has_docker", "has_kubernetes", "has_terraform",
        ),
        oracle("""SELECT r.id AS repo_id, r.name AS repo_name, r.project_id, p.name AS project_name, primary_language, project_type,
                    array_to_string(frameworks, ',') AS frameworks, array_to_string(package_managers, ',') AS package_managers,
                    array_to_string(infra_tools, ',') AS infra_tools, ci_provider, has_docker, has_kubernetes, has_terraform
                  FROM latest l JOIN prs r ON r.id = l.project_repository_id JOIN projects p ON p.id = r.project_id"""),
    ),
    "j4_scan_lang_names": (
        lambda t: p.scan_language_names(
            t.scan_languages().withColumn("language_id", natural_id("language")).drop("language"),
            t.raw("part").select(F.col("p_brand").alias("name")).distinct().withColumn("id", natural_id("name"))),
        oracle("SELECT scan_id, language, file_count, loc, percentage FROM scan_languages"),
    ),
    "j20_size_asof": (
        lambda t: _months(t, "files"),
        oracle(_MONTHS_FILES + "SELECT project_repository_id, month_end, value FROM months_filled"),
    ),
    "w4_carry_forward": (
        lambda t: _months(t, "loc"),
        oracle(_MONTHS_LOC + "SELECT project_repository_id, month_end, value FROM months_filled"),
    ),
    "a15_size_history_repository": (
        lambda t: p.size_history(_months(t), t.project_repositories(), t.projects()),
        oracle(_MONTHS_LOC + """SELECT r.id, r.name, strftime(month_end, '%Y-%m') AS month, value FROM months_filled m
                                JOIN prs r ON r.id = m.project_repository_id"""),
    ),
    "a15_size_history_project": (
        lambda t: p.size_history(_months(t), t.project_repositories(), t.projects(), "project"),
        oracle(_MONTHS_LOC + """SELECT p.id, p.name, strftime(month_end, '%Y-%m') AS month,
                                  CASE WHEN sum(value) > 0 THEN sum(value)::BIGINT END AS value
                                FROM months_filled m JOIN prs r ON r.id = m.project_repository_id
                                JOIN projects p ON p.id = r.project_id GROUP BY p.id, p.name, month_end"""),
    ),
    "a15_size_totals": (
        lambda t: p.size_totals(_months(t)),
        oracle(_MONTHS_LOC + "SELECT strftime(month_end, '%Y-%m') AS month, coalesce(sum(value), 0)::BIGINT AS total FROM months_filled GROUP BY month_end"),
    ),
}
