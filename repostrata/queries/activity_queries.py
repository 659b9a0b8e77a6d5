"""Calendars and inactivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import AS_OF, EVENTS_AS_OF, Tables
from ..plans import activity as a
from .canonical_sql import oracle

SCORE = """
round_even((since / greatest(greatest(span, 0) / greatest(active_days - 1, 1), 1.0))
  * (1.0 - least(recent / greatest(commit_count / greatest(age, 1) * 90, 1.0), 1.0)), 2)
"""


def _repo_tags(t: Tables):
    """Every fourth repository already carries the tag."""
    prs = t.project_repositories()
    return prs.filter(F.col("id") % 4 == 0).select(
        F.col("id").alias("project_repository_id"), F.lit("inactive").alias("tag")
    )


def _dev_tags(t: Tables):
    tags = t.developer_tags()
    return tags.unionByName(
        tags.select("developer_id").distinct().filter(F.col("developer_id") % 2 == 0).withColumn("tag", F.lit("inactive"))
    )


def _status(min_days: int, tagged: str) -> str:
    return f"""CASE WHEN score >= 4.0 AND days_since_last >= {min_days} THEN 'inactive' WHEN {tagged} THEN 'untagged'
               WHEN score >= 2.0 THEN 'borderline' ELSE 'active' END"""


REPO_INACTIVE = f"""
WITH span AS (SELECT project_repository_id, min(commit_date) AS first_date, max(commit_date) AS last_date, count(*) AS active_days,
  sum(commit_count)::BIGINT AS commit_count,
  coalesce(sum(commit_count) FILTER (commit_date >= DATE '{AS_OF}' - 90), 0)::BIGINT AS recent
  FROM repository_daily GROUP BY ALL),
scored AS (SELECT *, DATE '{AS_OF}' - last_date AS days_since_last, {SCORE} AS score
  FROM (SELECT *, DATE '{AS_OF}' - last_date AS since, last_date - first_date AS span, DATE '{AS_OF}' - first_date AS age FROM span))
"""
DEV_INACTIVE = f"""
WITH stats AS (SELECT developer_id, min(first_commit_at) AS f, max(last_commit_at) AS l, sum(c.active_days)::BIGINT AS active_days,
  sum(commit_count)::BIGINT AS commit_count FROM contributions c JOIN profiles p ON p.id = c.profile_id GROUP BY ALL),
r AS (SELECT developer_id, sum(commit_count)::BIGINT AS recent FROM developer_daily d JOIN profiles p ON p.id = d.profile_id
  WHERE commit_date >= DATE '{EVENTS_AS_OF}' - 90 GROUP BY ALL),
scored AS (SELECT *, since AS days_since_last, {SCORE} AS score
  FROM (SELECT stats.*, coalesce(r.recent, 0) AS recent, date_diff('day', l, TIMESTAMP '{EVENTS_AS_OF}') AS since,
        date_diff('day', f, l) AS span, date_diff('day', f, TIMESTAMP '{EVENTS_AS_OF}') AS age
        FROM stats LEFT JOIN r USING (developer_id)))
"""


def _inactive_repositories(t: Tables):
    return a.inactive_repositories(t.repository_daily(), _repo_tags(t), AS_OF, untag_active=True)


def _inactive_developers(t: Tables):
    return a.inactive_developers(
        t.contributions(), t.profiles(), t.developer_daily(), _dev_tags(t), EVENTS_AS_OF, untag_active=True
    )


QUERIES = {
    "a7_activity_all": (
        lambda t: a.activity_all(t.repository_daily()),
        oracle("SELECT commit_date, sum(commit_count)::BIGINT AS commit_count FROM repository_daily GROUP BY ALL"),
    ),
    "a8_activity_project": (
        lambda t: a.activity_project(t.repository_daily(), t.project_repositories()),
        oracle("""SELECT project_id, commit_date, sum(commit_count)::BIGINT AS commit_count FROM repository_daily d
                  JOIN prs r ON r.id = d.project_repository_id GROUP BY ALL"""),
    ),
    "a9_activity_repository": (
        lambda t: a.activity_repository(t.repository_daily()),
        oracle("SELECT project_repository_id, commit_date, commit_count FROM repository_daily"),
    ),
    "e9_activity_levels": (
        lambda t: a.activity(t.repository_daily(), t.project_repositories()),
        oracle("""SELECT commit_date, project_id, project_repository_id,
                    CASE WHEN grouping(project_id) = 1 THEN 'all' WHEN grouping(project_repository_id) = 1 THEN 'project' ELSE 'repository' END AS level,
                    sum(commit_count)::BIGINT AS commit_count
                  FROM repository_daily d JOIN prs r ON r.id = d.project_repository_id
                  GROUP BY GROUPING SETS ((commit_date), (project_id, commit_date), (project_id, project_repository_id, commit_date))"""),
    ),
    "e21_calendar_heatmap": (
        lambda t: a.calendar(t.repository_daily(), "project_repository_id", AS_OF),
        oracle("""SELECT project_repository_id, commit_date, commit_count, max_count FROM
                  (SELECT *, max(commit_count) OVER (PARTITION BY project_repository_id) AS max_count FROM repository_daily)
                  WHERE commit_date BETWEEN DATE '2000-08-01' AND DATE '2001-08-01'"""),
    ),
    "a33_activity_span": (
        lambda t: a.repository_span(t.repository_daily(), AS_OF),
        oracle(REPO_INACTIVE + """SELECT project_repository_id, first_date, last_date, active_days, commit_count,
                                  recent AS recent_commits FROM span"""),
    ),
    "a34_recent_commits": (
        lambda t: a.recent_commits(t.developer_daily(), "profile_id", "2024-04-15"),
        oracle("""SELECT profile_id, coalesce(sum(commit_count) FILTER (commit_date >= DATE '2024-04-15' - 90), 0)::BIGINT AS recent_commits
                  FROM developer_daily GROUP BY ALL"""),
    ),
    "f25_inactivity_score": (
        lambda t: a.inactive_repositories(
            t.repository_daily(), _repo_tags(t), "2001-12-31"
        ).select("project_repository_id", "score"),
        oracle(REPO_INACTIVE.replace(AS_OF, "2001-12-31") + "SELECT project_repository_id, score FROM scored"),
    ),
    "e19_tag_inactive_developers": (
        _inactive_developers,
        oracle(DEV_INACTIVE + f"SELECT developer_id, score, days_since_last, l::DATE AS last_date, {_status(30, 'developer_id % 2 = 0')} AS status FROM scored"),
    ),
    "e19_tags_after": (
        lambda t: a.tags_after(_dev_tags(t), _inactive_developers(t), "developer_id"),
        oracle(DEV_INACTIVE + f""", d AS (SELECT developer_id, {_status(30, 'developer_id % 2 = 0')} AS status FROM scored)
                SELECT developer_id, tag FROM developer_tags
                UNION SELECT developer_id, 'inactive' FROM developer_tags WHERE developer_id % 2 = 0
                  AND developer_id NOT IN (SELECT developer_id FROM d WHERE status = 'untagged')
                UNION SELECT developer_id, 'inactive' FROM d WHERE status = 'inactive'"""),
    ),
    "e20_tag_inactive_repositories": (
        _inactive_repositories,
        oracle(REPO_INACTIVE + f"SELECT project_repository_id, score, days_since_last, last_date, {_status(90, 'project_repository_id % 4 = 0')} AS status FROM scored"),
    ),
}
