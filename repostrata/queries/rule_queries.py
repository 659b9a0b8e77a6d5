"""Scores and risks: the wide row of facts per scanned tree, owners and modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import Tables
from ..operators import contributions as co
from ..operators import risks, scores
from ..operators.files import large_files, top_large_files
from .canonical_sql import oracle


def _scan_contributions(t: Tables):
    return t.contributions().select(
        F.col("scan_id").alias("repo_id"), F.col("profile_id").cast("string").alias("username"), "commit_count", "last_commit_at"
    )


def facts(t: Tables):
    """A wide row per order; developer shares come from its order lines."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    none = F.array().cast("array<string>")
    base = t.raw("orders").select(
        k.alias("repo_id"),
        (c % 25).alias("files_above_threshold"),
        (k % 15).alias("functions_above_threshold"),
        (k % 500).cast("double").alias("avg_file_loc"),
        F.when(k % 2 == 0, F.array(F.lit("Ruff"))).otherwise(none).alias("linters"),
        F.when(k % 5 == 0, F.array(F.lit("Black"))).otherwise(none).alias("formatters"),
        F.greatest((c % 9) - 3, F.lit(0)).alias("file_count_test"),
        (k % 200).alias("file_count_source"),
        (k % 40).alias("doc_loc"),
        (k % 2 == 0).alias("has_readme"),
        (k % 3 == 0).alias("has_install_docs"),
        (k % 5 == 0).alias("has_architecture_docs"),
        (k % 7 == 0).alias("has_changelog"),
        (k % 11 == 0).alias("has_runbook"),
        (c % 3 == 0).alias("has_lockfile"),
        F.when(k % 4 != 0, "gitlab").alias("ci_provider"),
        (k % 3 == 0).alias("has_docker"),
        (k % 7 == 0).alias("has_kubernetes"),
        (k % 8 == 0).alias("has_helm"),
        (k % 9 == 0).alias("has_terraform"),
        F.when(k % 3 == 0, F.array(F.lit("pip/poetry"))).when(k % 3 == 1, F.array(F.lit("maven"), F.lit("pip"))).otherwise(none).alias("package_managers"),
    )
    return base.join(co.top_shares(_scan_contributions(t)), "repo_id", "left")


FACTS = """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY commit_count DESC, profile_id::VARCHAR) AS n FROM contributions),
shares AS (SELECT scan_id, count(*) AS developers, sum(commit_count)::BIGINT AS commits, arg_min(profile_id::VARCHAR, n) AS top_developer,
  max(last_commit_at) AS latest_commit_at, max(commit_count) / sum(commit_count) AS top1_share,
  sum(commit_count) FILTER (n <= 2) / sum(commit_count) AS top2_share FROM ranked GROUP BY scan_id),
facts AS (SELECT o_orderkey AS repo_id, o_custkey % 25 AS files_above_threshold, o_orderkey % 15 AS functions_above_threshold,
  (o_orderkey % 500)::DOUBLE AS avg_file_loc, o_orderkey % 2 = 0 AS linted, o_orderkey % 5 = 0 AS formatted,
  greatest(o_custkey % 9 - 3, 0) AS file_count_test, o_orderkey % 200 AS file_count_source, o_orderkey % 40 AS doc_loc,
  o_custkey % 3 = 0 AS has_lockfile, o_orderkey AS k, s.* FROM orders LEFT JOIN shares s ON s.scan_id = o_orderkey)
"""
CODE = """round_even(greatest(0, least(100, 100.0::DOUBLE - least(files_above_threshold * 5, 30) - least(functions_above_threshold * 3, 20)
  - CASE WHEN avg_file_loc > 300 THEN 10 ELSE 0 END + CASE WHEN linted THEN 10 ELSE 0 END + CASE WHEN formatted THEN 5 ELSE 0 END)), 1)"""
RATIO = "CASE WHEN file_count_test + file_count_source > 0 THEN file_count_test / (file_count_test + file_count_source) ELSE 0 END"
TEST = f"""CASE WHEN file_count_test > 0 THEN 50.0::DOUBLE + CASE WHEN {RATIO} >= 0.3 THEN 30 WHEN {RATIO} >= 0.15 THEN 15
  WHEN {RATIO} >= 0.05 THEN 5 ELSE 0 END ELSE 0.0::DOUBLE END"""
DOC = """round_even((CASE WHEN k % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 15 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 15 ELSE 0 END
  + CASE WHEN k % 7 = 0 THEN 15 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 10 ELSE 0 END) / 75.0::DOUBLE * 100.0, 1)"""
DELIVERY = """(CASE WHEN k % 4 <> 0 THEN 40 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 30 ELSE 0 END
  + CASE WHEN k % 7 = 0 OR k % 8 = 0 OR k % 9 = 0 THEN 20 ELSE 0 END)::DOUBLE"""
MAINTAIN = """(greatest(0, least(100, 60 + CASE WHEN coalesce(developers, 0) = 1 THEN -20 WHEN developers >= 3 THEN 10 ELSE 0 END
  + CASE WHEN top1_share > 0.80 THEN -20 WHEN top1_share > 0.60 THEN -10 ELSE 0 END
  - CASE WHEN files_above_threshold > 10 THEN 10 ELSE 0 END + CASE WHEN file_count_test > 0 THEN 10 ELSE 0 END)))::DOUBLE"""
DOMAINS = f"""
, s AS (SELECT repo_id, {CODE} AS code_quality, {TEST} AS test_quality, {DOC} AS doc_quality, {DELIVERY} AS delivery_quality,
        {MAINTAIN} AS maintainability FROM facts)
, o AS (SELECT *, round_even(code_quality * 0.25::DOUBLE + test_quality * 0.20::DOUBLE + doc_quality * 0.15::DOUBLE
        + delivery_quality * 0.20::DOUBLE + maintainability * 0.20::DOUBLE, 1) AS overall FROM s)
"""

# Risk type, condition, severity, title, entity type and reference of each rule.
RULES = {
    "k1_no_tests": ("no_tests", [
        ("file_count_test = 0", "high", "'No test files detected'"),
        (f"{RATIO} < 0.05", "medium", "'Very low test coverage (< 5% test files)'"),
    ]),
    "k2_weak_documentation": ("weak_documentation", [
        ("doc_loc = 0", "medium", "'No documentation files detected'"), ("doc_loc < 30", "low", "'Minimal documentation'"),
    ]),
    "k3_no_ci_pipeline": ("no_ci_pipeline", [("k % 4 = 0", "high", "'No CI/CD pipeline configuration found'")]),
    "k4_no_lockfile": ("no_lockfile", [("k % 3 = 0 AND NOT has_lockfile", "medium", "'No dependency lockfile found'")]),
    "k5_oversized_file": ("oversized_file", [
        ("files_above_threshold >= 20", "high", "files_above_threshold || ' files exceed 500 lines'"),
        ("files_above_threshold >= 5", "medium", "files_above_threshold || ' files exceed 500 lines'"),
    ]),
    "k6_oversized_function": ("oversized_function", [
        ("functions_above_threshold >= 10", "medium", "functions_above_threshold || ' functions exceed 50 lines'"),
    ]),
    "k8_low_bus_factor": ("low_bus_factor", [
        ("coalesce(developers, 0) <= 1", "critical", "'Bus factor = 1: only one contributor found'"),
        ("developers = 2", "medium", "'Bus factor = 2: only two contributors'"),
    ]),
}


def _rule_sql(name: str) -> str:
    kind, cases = RULES[name]
    severity = " ".join(f"WHEN {c} THEN '{s}'" for c, s, _ in cases)
    title = " ".join(f"WHEN {c} THEN {x}" for c, _, x in cases)
    fires = " OR ".join(f"({c})" for c, _, _ in cases)
    return f"""SELECT repo_id, '{kind}' AS risk_type, CASE {severity} END AS severity, CASE {title} END AS title,
               'project' AS entity_type, NULL::VARCHAR AS entity_ref FROM facts WHERE {fires}"""


CONCENTRATION = """
SELECT repo_id, 'knowledge_concentration' AS risk_type, CASE WHEN top1_share > 0.70 THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN top1_share > 0.70 THEN 'High knowledge concentration: ' || top_developer || ' owns ' || round_even(top1_share * 100, 0)::BIGINT || '% of commits'
       ELSE 'Top 2 developers own ' || round_even(top2_share * 100, 0)::BIGINT || '% of commits' END AS title,
  CASE WHEN top1_share > 0.70 THEN 'developer' ELSE 'project' END AS entity_type, CASE WHEN top1_share > 0.70 THEN top_developer END AS entity_ref
FROM facts WHERE top1_share > 0.70 OR (top2_share > 0.90 AND developers >= 2)
"""


def _rule(name: str):
    kind = RULES[name][0] if name in RULES else "knowledge_concentration"
    return lambda t: risks.repo_risks(facts(t), [kind])


def _domain(name: str):
    return lambda t: scores.score_columns(facts(t)).select("repo_id", name)


def _domain_sql(name: str) -> str:
    return oracle(FACTS + DOMAINS + f"SELECT repo_id, {name} FROM o", "contributions")


# --- owners and modules over the whole history -------------------------------


def _history(t: Tables):
    return co.with_identity(t.commits())


def _languages(t: Tables):
    return co.language_contributions(_history(t))


def _modules(t: Tables):
    """Changes by module and, to have many owners, by part and module."""
    return co.module_contributions(_history(t))


def _part_owners(t: Tables):
    """Owners of small units: a part is a repository, touched by two users."""
    return t.lines().groupBy(
        F.col("l_partkey").alias("repo_id"), F.lower("p_type").alias("module"), F.col("p_brand").alias("language"),
        F.when(F.col("l_suppkey") % 10 < 9, "u0").otherwise("u1").alias("username"),
    ).agg(F.count("*").alias("files_changed"))


OWNERS = """
SELECT repo_id, {key}, sum(files_changed)::BIGINT AS total, max(files_changed) AS top_changes,
  arg_min(username, (-files_changed, username)) AS top_owner, max(files_changed) / sum(files_changed) AS owner_share
FROM {rows} GROUP BY repo_id, {key}
"""
LANGUAGE_ROWS = "(SELECT repo_id, username, language, count(*) AS files_changed FROM user_changes WHERE language IS NOT NULL GROUP BY ALL)"
MODULE_ROWS = "(SELECT repo_id, username, module, count(*) AS files_changed FROM user_changes GROUP BY ALL)"
PART_ROWS = """(SELECT l_partkey AS repo_id, lower(p_type) AS module, p_brand AS language, CASE WHEN l_suppkey % 10 < 9 THEN 'u0' ELSE 'u1' END AS username,
  count(*) AS files_changed FROM lines GROUP BY ALL)"""


def _mono_sql(key: str, least: int) -> str:
    title = {
        "language": "top_owner || ' is sole owner of ' || language || ' (' || p || '% of changes)'",
        "module": "top_owner || ' is sole owner of module ''' || module || ''' (' || p || '%)'",
    }[key]
    return f"""SELECT repo_id, 'mono_owner_{key}' AS risk_type, 'medium' AS severity, {title} AS title, '{key}' AS entity_type, {key} AS entity_ref
      FROM (SELECT *, round_even(owner_share * 100, 0)::BIGINT AS p FROM ({OWNERS.format(key=key, rows=PART_ROWS)}))
      WHERE owner_share > 0.8 AND total >= {least}"""


def _top_files(t: Tables):
    """Ten largest changed files of each part type, as (repo, path, lines)."""
    return top_large_files(_sizes(t), "lines")


def _sizes(t: Tables):
    return t.change_rows().join(
        t.scans().select(F.col("id").alias("sha_key"), F.col("project_repository_id").alias("repo_id")), "sha_key"
    ).groupBy("repo_id", "path").agg((F.sum("insertions") * 10).alias("lines"))


TOP_FILES = """
WITH sizes AS (SELECT project_repository_id AS repo_id, path, (sum(insertions) * 10)::BIGINT AS lines FROM changes c
               JOIN scans s ON s.id = c.sha_key GROUP BY ALL),
top_files AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY lines DESC, path) AS rank FROM sizes WHERE lines >= 500)
              WHERE rank <= 10),
avg_files AS (SELECT repo_id, split_part(path, '/', 1) AS module, count(*) AS files, sum(lines)::BIGINT AS total_lines, sum(lines) / count(*) AS avg_lines
              FROM sizes WHERE lines >= 500 AND path LIKE '%/%' GROUP BY ALL)
"""
COMPLEX = """
SELECT repo_id, 'high_complexity_module' AS risk_type, 'high' AS severity,
  'Module ''' || module || ''' has high average file size (' || floor(avg_lines)::BIGINT || ' LOC avg)' AS title, 'module' AS entity_type, module AS entity_ref
FROM avg_files WHERE files >= 3 AND avg_lines > 400
"""


def _orphans(t: Tables):
    """Modules are part names, so that some fall silent; a repository is a supplier."""
    rows = t.lines().select(
        F.col("l_suppkey").alias("repo_id"), F.col("p_name").alias("module"),
        F.concat_ws("-", "l_partkey").alias("username"), F.col("l_shipdate").alias("ts"),
    )
    contribs = rows.groupBy("repo_id", "username").agg(F.max("ts").alias("last_commit_at"))
    return risks.orphan_modules(rows.select("repo_id", "username", "module").distinct(), contribs)


ORPHANS = """
WITH rows AS (SELECT l_suppkey AS repo_id, p_name AS module, l_partkey::VARCHAR AS username, l_shipdate AS ts FROM lines),
users AS (SELECT repo_id, username, max(ts) AS last FROM rows GROUP BY ALL),
active AS (SELECT DISTINCT r.repo_id, r.module FROM rows r JOIN users u USING (repo_id, username)
           JOIN (SELECT repo_id, max(ts) AS latest FROM rows GROUP BY ALL) x ON x.repo_id = r.repo_id
           WHERE u.last >= x.latest - INTERVAL 180 DAY),
orphans AS (SELECT repo_id, module, max(last) AS last_active FROM (SELECT DISTINCT repo_id, module, username FROM rows) JOIN users USING (repo_id, username)
            WHERE (repo_id, module) NOT IN (SELECT (repo_id, module) FROM active) GROUP BY ALL)
"""
ORPHAN_RISKS = """SELECT repo_id, 'orphan_module' AS risk_type, 'medium' AS severity,
  'Module ''' || module || ''' has no commits in the last 6 months' AS title, 'module' AS entity_type, module AS entity_ref FROM orphans"""

ALL_RULES = " UNION ALL ".join(f"({_rule_sql(n)})" for n in RULES) + f" UNION ALL ({CONCENTRATION})"

QUERIES = {
    "r1_code_quality": (_domain("code_quality"), _domain_sql("code_quality")),
    "r2_test_quality": (_domain("test_quality"), _domain_sql("test_quality")),
    "r3_doc_quality": (_domain("doc_quality"), _domain_sql("doc_quality")),
    "r4_delivery_quality": (_domain("delivery_quality"), _domain_sql("delivery_quality")),
    "r5_maintainability": (_domain("maintainability"), _domain_sql("maintainability")),
    "r6_overall": (
        lambda t: scores.scorecard(facts(t)),
        oracle(FACTS + DOMAINS + "SELECT repo_id, domain, score FROM (UNPIVOT o ON code_quality, test_quality, doc_quality, delivery_quality, maintainability, overall INTO NAME domain VALUE score)", "contributions"),
    ),
    "w5_top_share": (
        lambda t: co.top_shares(_scan_contributions(t)),
        oracle(FACTS + """SELECT scan_id AS repo_id, developers, commits, top_developer, latest_commit_at, top1_share, top2_share FROM shares""", "contributions"),
    ),
    **{name: (_rule(name), oracle(FACTS + _rule_sql(name), "contributions")) for name in RULES},
    "k7_knowledge_concentration": (_rule("k7"), oracle(FACTS + CONCENTRATION, "contributions")),
    "u2_all_risks": (
        lambda t: risks.repo_risks(facts(t)),
        oracle(FACTS + ALL_RULES, "contributions"),
    ),
    "a31_owner_shares": (
        lambda t: co.owner_shares(_languages(t), "language"),
        oracle(OWNERS.format(key="language", rows=LANGUAGE_ROWS)),
    ),
    "a31_module_owner_shares": (
        lambda t: co.owner_shares(_modules(t), "module"),
        oracle(OWNERS.format(key="module", rows=MODULE_ROWS)),
    ),
    "k9_mono_owner_language": (
        lambda t: risks.mono_owner_risks(co.owner_shares(_part_owners(t), "language"), "language"),
        oracle(_mono_sql("language", 3)),
    ),
    "k10_mono_owner_module": (
        lambda t: risks.mono_owner_risks(co.owner_shares(_part_owners(t), "module"), "module"),
        oracle(_mono_sql("module", 5)),
    ),
    "a32_module_avg_loc": (
        lambda t: risks.module_avg_loc(large_files(_sizes(t), "lines")),
        oracle(TOP_FILES + "SELECT repo_id, module, files, total_lines, avg_lines FROM avg_files"),
    ),
    "k11_high_complexity_module": (
        lambda t: risks.high_complexity_modules(risks.module_avg_loc(large_files(_sizes(t), "lines"))),
        oracle(TOP_FILES + COMPLEX),
    ),
    "j19_orphan_modules": (_orphans, oracle(ORPHANS + "SELECT repo_id, module, last_active FROM orphans")),
    "k12_orphan_module": (
        lambda t: risks.orphan_module_risks(_orphans(t)), oracle(ORPHANS + ORPHAN_RISKS),
    ),
    "t3_top_large_files": (
        lambda t: _top_files(t).withColumn("rank", F.col("rank").cast("long")),
        oracle(TOP_FILES + "SELECT repo_id, path, lines, rank FROM top_files"),
    ),
    "q10_severity_rank": (
        lambda t: t.scan_risks().groupBy("severity").agg(F.count("*").alias("risks")).withColumn(
            "rank", risks.severity_rank(F.col("severity")).cast("long")),
        oracle("""SELECT severity, count(*) AS risks, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END::BIGINT AS rank
                  FROM scan_risks GROUP BY severity"""),
    ),
}
