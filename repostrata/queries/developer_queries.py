"""Developers: totals, pages, shares, modules and owners."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import Tables
from ..operators import postings as po
from ..plans import developers as d
from ..plans.portfolio import repository_modules
from .canonical_sql import oracle, share_sql

TOTALS = """
coalesce(sum(commit_count), 0)::BIGINT AS total_commits, coalesce(sum(insertions), 0)::BIGINT AS total_insertions,
coalesce(sum(deletions), 0)::BIGINT AS total_deletions, coalesce(sum(files_changed), 0)::BIGINT AS files_changed,
coalesce(sum(active_days), 0)::BIGINT AS active_days, min(first_commit_at) AS first_commit_at, max(last_commit_at) AS last_commit_at
"""
ALL = f"SELECT developer_id, {TOTALS} FROM profiles p LEFT JOIN contributions c ON c.profile_id = p.id GROUP BY developer_id"
PROJECT = f"""SELECT p.developer_id, {TOTALS} FROM profiles p JOIN contributions c ON c.profile_id = p.id
  JOIN scans s ON s.id = c.scan_id JOIN prs r ON r.id = s.project_repository_id WHERE r.project_id = 2 GROUP BY p.developer_id"""
LATEST = f"""SELECT p.developer_id, {TOTALS} FROM profiles p JOIN contributions c ON c.profile_id = p.id
  JOIN latest l ON l.id = c.scan_id GROUP BY p.developer_id"""
NAMED_MODULES = """SELECT m.id AS module_id, m.path AS module_path, m.name AS module_name, r.name AS repository_name,
  m.project_repository_id, p.id AS project_id, p.name AS project_name
  FROM modules m JOIN prs r ON r.id = m.project_repository_id JOIN projects p ON p.id = r.project_id"""


def _all(t: Tables):
    return d.developer_totals(d.contrib_all(t.contributions(), t.profiles()))


def _project(t: Tables, project_id: int | None = 2):
    return d.contrib_by_project(t.contributions(), t.profiles(), t.scans(), t.project_repositories(), project_id)


def _modules(t: Tables):
    return d.module_names(t.modules(), t.project_repositories(), t.projects())


def _tags(rows):
    return rows.withColumn("tags", F.array_join("tags", ","))


def _strings(t: Tables):
    """Search strings made of parts and customers: whole words, ends of names, two digits, absent ones."""
    of_parts = t.raw("part").filter(F.col("p_partkey") % 20 == 0).select(F.substring("p_name", 2, 6).alias("q"))
    of_names = t.raw("customer").filter(F.col("c_custkey") % 100 == 7).select(F.upper(F.substring("c_name", -4, 4)).alias("q"))
    few = t.raw("nation").select(F.explode(F.array(F.upper(F.substring("n_name", 1, 4)), F.col("n_nationkey").cast("string"))).alias("q"))
    return of_parts.unionByName(of_names).unionByName(few)


STRINGS = """SELECT DISTINCT q FROM (SELECT substr(p_name, 2, 6) AS q FROM part WHERE p_partkey % 20 = 0
  UNION ALL SELECT upper(right(c_name, 4)) FROM customer WHERE c_custkey % 100 = 7
  UNION ALL SELECT upper(substr(n_name, 1, 4)) FROM nation UNION ALL SELECT n_nationkey::VARCHAR FROM nation) WHERE q <> ''"""


def _pieces(t: Tables):
    """Search strings of two and four characters from names of nations, regions and parts."""
    names = [t.raw(table).select(F.col(name).alias("name")) for table, name in (("nation", "n_name"), ("region", "r_name"), ("part", "p_name"))]
    every = names[0].unionByName(names[1]).unionByName(names[2])
    return every.select(F.explode(F.array(F.substring("name", 2, 2), F.substring("name", 1, 4), F.substring("name", -2, 2))).alias("q")).distinct()


PIECES = """SELECT DISTINCT unnest([substr(name, 2, 2), substr(name, 1, 4), right(name, 2)]) AS q FROM (
  SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT p_name FROM part)"""


QUERIES = {
    "a1_developer_totals": (_all, oracle(ALL)),
    "j1_contrib_by_project": (lambda t: d.developer_totals(_project(t)), oracle(PROJECT)),
    "j2_contrib_all": (
        lambda t: d.contrib_all(t.contributions(), t.profiles()).select("profile_id", "developer_id", "scan_id", "commit_count"),
        oracle("""SELECT p.id AS profile_id, developer_id, scan_id, commit_count FROM profiles p
                  LEFT JOIN contributions c ON c.profile_id = p.id"""),
    ),
    "a1_developer_totals_latest": (
        lambda t: d.developer_totals(
            d.latest_contribs(t.contributions(), t.scans()).join(d.profile_keys(t.profiles()), "profile_id")
        ),
        oracle(LATEST),
    ),
    "a2_developer_totals_overall": (
        lambda t: d.developer_totals_overall(_all(t)),
        oracle(f"SELECT count(*) AS developers, sum(total_commits)::BIGINT AS total_commits_all FROM ({ALL})"),
    ),
    "t1_developers_page": (
        lambda t: d.developers_page(_all(t), t.profiles(), "insertions", "desc", 5, 20),
        oracle(f"SELECT * FROM ({ALL}) ORDER BY total_insertions DESC, developer_id LIMIT 20 OFFSET 5"),
    ),
    "t1_deep_page": (
        lambda t: d.developers_page(_all(t), t.profiles(), "insertions", "desc", 300, 100, shallow=0),
        oracle(f"SELECT * FROM ({ALL}) ORDER BY total_insertions DESC, developer_id LIMIT 100 OFFSET 300"),
    ),
    "t1_page_info": (
        lambda t: d.page_info(_all(t), 5, 20),
        oracle(f"SELECT count(*) AS developers, sum(total_commits)::BIGINT AS total_commits_all, 25 < count(*) AS has_more FROM ({ALL})"),
    ),
    "t2_sort_by_name": (
        lambda t: d.developers_page(_all(t), t.profiles(), "name", "asc", 0, 50).select("developer_id", "sort_name", "total_commits"),
        oracle(f"""SELECT developer_id, sort_name, total_commits FROM ({ALL}) JOIN
                   (SELECT developer_id, lower(coalesce(nullif(arg_min(coalesce(display_name, ''), id), ''), arg_min(canonical_username, id))) AS sort_name
                    FROM profiles GROUP BY developer_id) USING (developer_id) ORDER BY sort_name, developer_id LIMIT 50"""),
    ),
    "p8_ilike_any": (
        lambda t: d.matching_developers(t.profiles(), "machinery"),
        oracle("""SELECT DISTINCT developer_id FROM profiles WHERE display_name ILIKE '%machinery%'
                  OR canonical_username ILIKE '%machinery%' OR primary_email ILIKE '%machinery%'"""),
    ),
    "p8_search_table": (
        lambda t: po.search(
            t.profiles(), "id", ["display_name", "canonical_username", "primary_email"], _strings(t), "q"
        ),
        oracle(f"""SELECT q, id FROM profiles, ({STRINGS}) WHERE contains(lower(display_name), lower(q))
                   OR contains(lower(canonical_username), lower(q)) OR contains(lower(primary_email), lower(q))"""),
    ),
    "p9_search_table": (
        lambda t: po.search(t.projects(), "id", ["name", "description"], _pieces(t), "q"),
        oracle(f"""SELECT q, id FROM projects, ({PIECES}) WHERE contains(lower(name), lower(q)) OR contains(lower(description), lower(q))"""),
    ),
    "p12_search_table": (
        lambda t: po.search(t.project_repositories(), "id", ["name"], _pieces(t), "q"),
        oracle(f"""SELECT q, id FROM prs, ({PIECES}) WHERE contains(lower(name), lower(q))"""),
    ),
    "j8_in_subquery": (
        lambda t: d.developer_totals(
            d.restricted(d.contrib_all(t.contributions(), t.profiles()), t.profiles(), t.developer_tags(), "9", "BUILDING")
        ),
        oracle(f"""SELECT * FROM ({ALL}) WHERE developer_id IN (SELECT developer_id FROM profiles WHERE display_name ILIKE '%9%'
                   OR canonical_username ILIKE '%9%' OR primary_email ILIKE '%9%')
                   AND developer_id IN (SELECT developer_id FROM developer_tags WHERE tag = 'BUILDING')"""),
    ),
    "e1_list_developers": (
        lambda t: _tags(d.with_tags(d.developers_page(
            d.developer_totals(d.restricted(_project(t), t.profiles(), t.developer_tags(), "customer")),
            t.profiles(), "last_commit_at", "desc", 0, 100), t.developer_tags())),
        oracle(f"""SELECT x.*, tags FROM (SELECT * FROM ({PROJECT}) ORDER BY last_commit_at DESC NULLS LAST, developer_id LIMIT 100) x
                   JOIN (SELECT developer_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM developer_tags GROUP BY 1) USING (developer_id)"""),
    ),
    "j10_with_tags": (
        lambda t: _tags(d.with_tags(t.profiles().select("developer_id").distinct(), t.developer_tags())),
        oracle("SELECT developer_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM developer_tags GROUP BY 1"),
    ),
    "e2_developer_detail": (
        lambda t: d.developer_detail(t.profiles(), t.developer_tags()).select(
            "developer_id",
            F.array_join(F.transform("profiles", lambda p: p["canonical_username"]), ",").alias("profiles"),
            F.array_join("tags", ",").alias("tags"),
        ),
        oracle("""SELECT * FROM (SELECT developer_id, string_agg(canonical_username, ',' ORDER BY id) AS profiles FROM profiles GROUP BY 1)
                  JOIN (SELECT developer_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM developer_tags GROUP BY 1) USING (developer_id)"""),
    ),
    "a3_developer_summary": (
        lambda t: d.developer_summary(t.contributions(), t.profiles(), t.scans(), t.project_repositories(), 2),
        oracle(f"""WITH whole AS (SELECT sum(total_commits)::BIGINT AS w FROM ({PROJECT}))
                   SELECT a.*, CASE WHEN total_commits > 0 AND w > 0 THEN w END AS project_total_commits,
                     CASE WHEN total_commits > 0 AND w > 0 THEN round_even(100.0::DOUBLE * total_commits / w, 2) END AS share_pct
                   FROM ({ALL}) a, whole"""),
    ),
    "e3_developer_contributions_scoped": (
        lambda t: d.developer_summary(t.contributions(), t.profiles(), t.scans(), t.project_repositories(), 2, scoped=True),
        oracle(f"""WITH whole AS (SELECT sum(total_commits)::BIGINT AS w FROM ({PROJECT}))
                   SELECT a.*, w AS project_total_commits, round_even(100.0::DOUBLE * total_commits / w, 2) AS share_pct
                   FROM ({PROJECT}) a, whole"""),
    ),
    "a4_developer_languages": (
        lambda t: d.developer_languages(t.language_contributions(), t.profiles()),
        oracle(f"""SELECT *, {share_sql('loc_added', 'sum(loc_added) OVER (PARTITION BY developer_id)')} AS percentage FROM
                   (SELECT developer_id, language, sum(commit_count)::BIGINT AS commit_count, sum(files_changed)::BIGINT AS files_changed,
                           sum(loc_added)::BIGINT AS loc_added
                    FROM language_contributions c JOIN profiles p ON p.id = c.profile_id GROUP BY ALL)"""),
    ),
    "e4_developer_languages_of_scan": (
        lambda t: d.developer_languages_of_scan(t.language_contributions(), t.profiles()),
        oracle("""SELECT scan_id, developer_id, profile_id, language, commit_count, files_changed, loc_added, percentage
                  FROM language_contributions c JOIN profiles p ON p.id = c.profile_id"""),
    ),
    "j5_dev_modules": (
        lambda t: d.developer_modules_of_scan(t.module_contributions(), t.profiles(), _modules(t)),
        oracle(f"""SELECT scan_id, developer_id, profile_id, project_name, repository_name, m.module_path, module_name, commit_count,
                     files_changed, loc_added, percentage
                   FROM module_contributions c JOIN profiles p ON p.id = c.profile_id JOIN ({NAMED_MODULES}) m USING (module_id)"""),
    ),
    "a5_developer_modules": (
        lambda t: d.developer_modules(t.module_contributions(), t.profiles(), _modules(t)).drop("project_id", "project_repository_id"),
        oracle(f"""SELECT x.*, {share_sql('loc_added', 'sum(loc_added) OVER (PARTITION BY developer_id)')} AS percentage,
                     project_name, repository_name, module_path, module_name FROM
                   (SELECT developer_id, module_id, sum(commit_count)::BIGINT AS commit_count, sum(files_changed)::BIGINT AS files_changed,
                           sum(loc_added)::BIGINT AS loc_added
                    FROM module_contributions c JOIN profiles p ON p.id = c.profile_id GROUP BY ALL) x JOIN ({NAMED_MODULES}) m USING (module_id)"""),
    ),
    "a6_developer_activity": (
        lambda t: d.developer_activity(t.developer_daily(), t.profiles()),
        oracle("""SELECT developer_id, commit_date, sum(commit_count)::BIGINT AS commit_count FROM developer_daily d
                  JOIN profiles p ON p.id = d.profile_id GROUP BY ALL"""),
    ),
    "j6_module_owners": (
        lambda t: d.module_owners(t.module_contributions(), t.profiles(), t.modules()),
        oracle("""SELECT module_id, m.path, m.name, scan_id, developer_id, profile_id, canonical_username, display_name, commit_count,
                    files_changed, percentage
                  FROM module_contributions c JOIN profiles p ON p.id = c.profile_id JOIN modules m ON m.id = c.module_id"""),
    ),
    "e18_modules_of_repository": (
        lambda t: repository_modules(t.modules(), t.project_repositories()),
        oracle("""SELECT r.repository_id, r.name AS repository_name, m.id, m.path, m.name FROM modules m
                  JOIN prs r ON r.id = m.project_repository_id"""),
    ),
    "j9_project_developers": (
        lambda t: d.project_developers(t.contributions(), t.profiles(), t.scans(), t.project_repositories()),
        oracle("""SELECT DISTINCT project_id, developer_id FROM contributions c JOIN profiles p ON p.id = c.profile_id
                  JOIN scans s ON s.id = c.scan_id JOIN prs r ON r.id = s.project_repository_id"""),
    ),
    "e8_project_developers": (
        lambda t: _tags(d.with_tags(
            d.project_developers(t.contributions(), t.profiles(), t.scans(), t.project_repositories()), t.developer_tags())),
        oracle("""SELECT project_id, developer_id, tags FROM (SELECT DISTINCT project_id, developer_id FROM contributions c
                    JOIN profiles p ON p.id = c.profile_id JOIN scans s ON s.id = c.scan_id JOIN prs r ON r.id = s.project_repository_id)
                  JOIN (SELECT developer_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM developer_tags GROUP BY 1) USING (developer_id)"""),
    ),
    "e11_scan_developers": (
        lambda t: _tags(d.scan_developers(t.contributions(), t.profiles(), t.developer_tags(), "automobile")),
        oracle("""SELECT c.*, developer_id, canonical_username, display_name, primary_email, tags
                  FROM contributions c JOIN profiles p ON p.id = c.profile_id
                  JOIN (SELECT developer_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM developer_tags GROUP BY 1) USING (developer_id)
                  WHERE display_name ILIKE '%automobile%' OR canonical_username ILIKE '%automobile%' OR primary_email ILIKE '%automobile%'"""),
    ),
    "t7_scan_developers_sorted": (
        lambda t: d.scan_developers_sorted(
            d.scan_developers(t.contributions(), t.profiles(), t.developer_tags()), "name", "asc"
        ).select("scan_id", "profile_id", "canonical_username", "commit_count"),
        oracle("""SELECT scan_id, profile_id, canonical_username, commit_count FROM contributions c
                  JOIN profiles p ON p.id = c.profile_id ORDER BY scan_id, coalesce(display_name, canonical_username)"""),
    ),
    "a35_distinct_tags": (
        lambda t: d.distinct_tags(t.developer_tags()),
        oracle("SELECT DISTINCT tag FROM developer_tags ORDER BY tag"),
    ),
    "w6_pct_of_total": (
        lambda t: t.module_contributions().select("scan_id", "profile_id", "module_id", "percentage"),
        oracle("SELECT scan_id, profile_id, module_id, percentage FROM module_contributions"),
    ),
}
