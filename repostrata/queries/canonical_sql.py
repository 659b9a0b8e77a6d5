"""The canonical tables as SQL over the driver tables, for the oracle queries."""

from __future__ import annotations

import re


def sql_case(key: str, values: list[str], otherwise: str | None = None) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    tail = f" ELSE '{otherwise}'" if otherwise is not None else ""
    return f"CASE {key} {whens}{tail} END"


def share_sql(part: str, total: str) -> str:
    return f"CASE WHEN coalesce({total}, 0) <> 0 THEN round_even({part} * 100.0::DOUBLE / {total}, 2) ELSE 0.0 END"


LATEST = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY project_repository_id
                               ORDER BY started_at DESC NULLS LAST, id DESC) AS latest_rank
  FROM scans WHERE status = 'completed') WHERE latest_rank = 1
"""

TABLES = {
    "projects": """
SELECT r_regionkey::BIGINT AS id, r_name AS name,
       CASE WHEN r_regionkey % 2 = 0 THEN 'Portfolio of ' || r_name END AS description FROM region
""",
    "prs": """
SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS project_id, n_nationkey::BIGINT % 20 AS repository_id,
       n_name AS name, 'main' AS default_branch FROM nation
""",
    "repositories": """
SELECT id, CASE WHEN id % 2 = 0 THEN 'https://user@git.example.org/team/repo_' || id || '.git'
                ELSE 'git@github.com:team/repo_' || id || '.git' END AS url,
       CASE id % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'bitbucket' END AS provider
FROM (SELECT DISTINCT CASE WHEN n_nationkey >= 23 THEN n_nationkey + 7 ELSE n_nationkey % 20 END::BIGINT AS id FROM nation)
""",
    "profiles": """
SELECT c_custkey AS id, c_custkey // 3 AS developer_id, c_name AS canonical_username,
       CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment || ' ' || c_custkey END AS display_name,
       'user' || c_custkey || '@' || lower(c_mktsegment) || '.example.com' AS primary_email FROM customer
""",
    "developer_tags": "SELECT DISTINCT c_custkey // 3 AS developer_id, c_mktsegment AS tag FROM customer",
    "scans": """
SELECT o_orderkey AS id, c_nationkey::BIGINT AS project_repository_id,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
       CASE WHEN o_orderkey % 5 <> 0 THEN 'release/' || (o_orderkey % 3) END AS branch,
       CASE WHEN o_orderkey % 4 = 0 THEN 'abc' || o_orderkey END AS commit_sha,
       CASE WHEN o_orderkey % 97 <> 0 THEN floor(o_totalprice)::BIGINT END AS total_loc,
       o_custkey % 1000 AS total_files,
       CASE WHEN o_orderkey % 97 <> 0 THEN floor(o_totalprice)::BIGINT * 40 END AS size_bytes,
       CASE o_orderkey % 6 WHEN 0 THEN 'library' WHEN 1 THEN 'monolith' WHEN 2 THEN 'backend_service' END AS project_type,
       CASE o_orderkey % 3 WHEN 0 THEN 'Python' WHEN 1 THEN 'Go' END AS primary_language,
       CASE o_orderkey % 4 WHEN 0 THEN ['React', 'Express'] WHEN 1 THEN ['Django'] ELSE []::VARCHAR[] END AS frameworks,
       CASE o_orderkey % 3 WHEN 0 THEN ['npm', 'pip'] WHEN 1 THEN ['pip'] ELSE []::VARCHAR[] END AS package_managers,
       CASE o_orderkey % 2 WHEN 0 THEN ['terraform'] ELSE ['terraform', 'helm'] END AS infra_tools,
       CASE o_orderkey % 3 WHEN 0 THEN 'gitlab' WHEN 1 THEN 'jenkins' END AS ci_provider,
       o_orderkey % 2 = 0 AS has_docker, o_orderkey % 3 = 0 AS has_kubernetes, o_orderkey % 5 = 0 AS has_terraform,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS started_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_hours(o_orderkey % 72) END AS completed_at,
       o_orderdate AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey
""",
    "latest": LATEST,
    "lines": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, l_quantity::BIGINT AS qty,
       l_returnflag, l_linestatus, l_shipdate, p_name, p_brand, p_type, p_size::BIGINT AS p_size
FROM lineitem JOIN part ON l_partkey = p_partkey
""",
    "scan_languages": f"""
SELECT scan_id, language, file_count, loc, {share_sql('loc', 'sum(loc) OVER (PARTITION BY scan_id)')} AS percentage
FROM (SELECT l_orderkey AS scan_id, p_brand AS language, count(*) AS file_count, (sum(qty) * 10)::BIGINT AS loc
      FROM lines GROUP BY ALL)
""",
    "scan_scores": """
SELECT o_orderkey AS scan_id, 'overall' AS domain, (floor(o_totalprice)::BIGINT % 1000) / 10.0::DOUBLE AS score
FROM orders WHERE o_orderkey % 11 <> 0
UNION ALL
SELECT o_orderkey, 'code_quality', (o_custkey % 100)::DOUBLE FROM orders WHERE o_orderkey % 3 <> 0
""",
    "scan_risks": """
SELECT l_orderkey * 10000000 + l_partkey AS id, l_orderkey AS scan_id,
       'risk_' || l_returnflag || '_' || l_linestatus AS risk_type,
       CASE l_linenumber % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
       'Risk in ' || p_name AS title FROM lines
""",
    "contributions": """
SELECT l_orderkey AS scan_id, l_suppkey AS profile_id, count(*) AS commit_count, sum(qty)::BIGINT AS insertions,
       sum(l_linenumber)::BIGINT AS deletions, count(DISTINCT l_partkey) AS files_changed,
       count(DISTINCT l_shipdate) AS active_days, min(l_shipdate) AS first_commit_at, max(l_shipdate) AS last_commit_at
FROM lines GROUP BY ALL
""",
    "language_contributions": f"""
SELECT *, {share_sql('files_changed', 'sum(files_changed) OVER (PARTITION BY scan_id, profile_id)')} AS percentage
FROM (SELECT l_orderkey AS scan_id, l_suppkey AS profile_id, p_brand AS language, count(*) AS commit_count,
             count(*) AS files_changed, sum(qty)::BIGINT AS loc_added, sum(l_linenumber)::BIGINT AS loc_deleted
      FROM lines GROUP BY ALL)
""",
    "module_contributions": f"""
SELECT m.*, s.project_repository_id * 100 + length(module_path) * 10 + instr(module_path, 'A') AS module_id
FROM (SELECT *, {share_sql('files_changed', 'sum(files_changed) OVER (PARTITION BY scan_id, profile_id)')} AS percentage
      FROM (SELECT l_orderkey AS scan_id, l_suppkey AS profile_id, p_type AS module_path, count(*) AS commit_count,
                   count(*) AS files_changed, sum(qty)::BIGINT AS loc_added
            FROM lines GROUP BY ALL)) m JOIN scans s ON m.scan_id = s.id
""",
    "modules": """
SELECT DISTINCT project_repository_id * 100 + length(p_type) * 10 + instr(p_type, 'A') AS id, project_repository_id,
       p_type AS path, lower(p_type) AS name FROM lines JOIN scans ON l_orderkey = scans.id
""",
    "dependencies": f"""
SELECT *, CASE WHEN p12 = 10 OR license_spdx IS NOT NULL THEN 'raw ' || p12 END AS license_raw FROM (
SELECT l_orderkey AS scan_id, p_name AS name, p_size::VARCHAR AS version,
       CASE l_returnflag WHEN 'A' THEN 'prod' WHEN 'N' THEN 'dev' ELSE 'test' END AS dep_type,
       lower(p_type) || '.lock' AS manifest_file, lower(p_type) AS ecosystem,
       CASE WHEN p_size % 3 = 0 THEN 'tool' END AS package_manager,
       {sql_case('l_partkey % 12', ["MIT", "Apache-2.0", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0", "BSD-3-Clause", "AGPL-3.0-only", "CDDL-1.0", "GPL-9.9", "EUPL-1.2"])} AS license_spdx,
       l_partkey % 12 AS p12,
       {sql_case('l_partkey % 12', ["safe", "safe", "risky", "risky", "safe", "safe", "risky", "unknown", "risky", "risky"], "unknown")} AS license_risk,
       l_linestatus = 'O' AS is_direct,
       CASE WHEN l_partkey % 12 = 1 THEN 'Apache-2.0 OR MIT' END AS license_expression,
       CASE WHEN l_partkey % 5 = 0 THEN 'low' ELSE 'high' END AS license_confidence,
       CASE WHEN l_partkey % 2 = 0 THEN 'lockfile' END AS license_source,
       CASE WHEN l_partkey % 10 = 0 THEN 'Ambiguous, see file' END AS license_notes,
       CASE WHEN p_size % 2 = 0 THEN 'locked' ELSE 'declared_only' END AS discovery_mode,
       p_size % 7 = 0 AS is_optional_dependency, p_size % 11 = 0 AS is_private
FROM lines)
""",
    "classified": """
SELECT *, CASE
  WHEN license_spdx IN ('MIT','Apache-2.0','BSD-2-Clause','BSD-3-Clause','BSD-4-Clause','ISC','CC0-1.0','Unlicense','WTFPL','0BSD','Zlib','Python-2.0','PSF-2.0','Artistic-2.0','EPL-1.0','EPL-2.0') THEN 'permissive'
  WHEN license_spdx IN ('MPL-2.0','LGPL-2.0-only','LGPL-2.0-or-later','LGPL-2.1-only','LGPL-2.1-or-later','LGPL-3.0-only','LGPL-3.0-or-later','EUPL-1.1','EUPL-1.2','CDDL-1.0') THEN 'weak_copyleft'
  WHEN license_spdx IN ('OSL-3.0','CPAL-1.0','RPSL-1.0') OR license_spdx LIKE 'GPL-%' OR license_spdx LIKE 'AGPL-%' THEN 'strong_copyleft'
  WHEN license_spdx LIKE 'LGPL-%' OR license_spdx LIKE 'MPL-%' OR license_spdx LIKE 'EUPL-%' THEN 'weak_copyleft'
  ELSE 'unknown' END AS class FROM dependencies
""",
    "findings": """
SELECT l_orderkey AS scan_id, CASE l_returnflag WHEN 'A' THEN 'email' WHEN 'N' THEN 'phone' ELSE 'inn' END AS pdn_type,
       'src/' || lower(p_type) || '/' || p_name || '.py' AS file_path, qty AS line_number,
       'id_' || l_linestatus AS matched_identifier FROM lines
""",
    "repository_daily": """
SELECT project_repository_id, created_at::DATE AS commit_date, count(*) AS commit_count FROM scans GROUP BY ALL
""",
    "developer_daily": "SELECT user_id AS profile_id, ts::DATE AS commit_date, count(*) AS commit_count FROM events GROUP BY ALL",
    "changes": f"""
SELECT l_orderkey AS sha_key, CASE WHEN p_size % 13 = 0 THEN file ELSE lower(p_type) || '/' || file END AS path,
       CASE WHEN p_size % 13 = 0 THEN 'root' ELSE lower(p_type) END AS module, qty AS insertions,
       l_linenumber AS deletions, {sql_case('p_size % 6', ['Python', 'JavaScript', 'Java', 'Go', 'Markdown'])} AS language
FROM (SELECT *, replace(p_name, ' ', '_') || {sql_case('p_size % 6', ['.py', '.js', '.java', '.go', '.md'], '.zzz')} AS file FROM lines)
""",
    "commits": f"""
SELECT *, (strptime(substr(ts_raw, 1, 19), '%Y-%m-%dT%H:%M:%S') - to_hours(off)) AS ts,
       CASE WHEN author_email IS NULL THEN 'c_' || substr(author_name, 10)
            ELSE 'd_' || substr(author_email, 5, instr(author_email, '@') - 5) END AS username
FROM (SELECT c_nationkey::BIGINT AS repo_id, o_orderkey AS sha_key,
  date_diff('day', o_orderdate, TIMESTAMP '2100-01-01') * 100000000000 + o_orderkey AS seq, c_name AS author_name,
  CASE WHEN o_custkey % 3 = 0 THEN 'dev.team' || (o_custkey % 200) || '@example.com' END AS author_email,
  strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':30:00' ||
    {sql_case('o_orderkey % 3', ['+03:00', '-05:00'], '+00:00')} AS ts_raw,
  CASE o_orderkey % 3 WHEN 0 THEN 3 WHEN 1 THEN -5 ELSE 0 END AS off, o_orderdate::DATE AS day
  FROM orders JOIN customer ON o_custkey = c_custkey)
""",
    "user_changes": "SELECT c.repo_id, c.username, x.* FROM commits c JOIN changes x USING (sha_key)",
    "user_stats": """
SELECT repo_id, username, count(*) AS commit_count, coalesce(sum(ins), 0)::BIGINT AS insertions,
       coalesce(sum(del), 0)::BIGINT AS deletions, coalesce(sum(files), 0)::BIGINT AS files_changed,
       count(DISTINCT day) AS active_days, min(ts) AS first_commit_at, max(ts) AS last_commit_at
FROM commits LEFT JOIN (SELECT sha_key, sum(insertions) AS ins, sum(deletions) AS del, count(DISTINCT path) AS files
                        FROM changes GROUP BY sha_key) USING (sha_key)
GROUP BY repo_id, username
""",
    "files": f"""
SELECT source AS repo_id, doc_id, folder || lang || '/' || stem || ext AS path, folder, stem, ext, n_chars AS size_bytes,
       text AS content
FROM (SELECT *, {sql_case('doc_id % 11', ['src/', 'tests/', '', 'docs/', 'node_modules/x/', 'lib/core/', '.github/', 'app/', 'pkg/spec/'], 'src/main/')} AS folder,
             {sql_case('doc_id % 9', ['.py', '.js', '.md', '.java', '.go', '.sql', '.txt', '.rb'], '.yaml')} AS ext,
             CASE WHEN doc_id % 17 = 0 THEN 'README' WHEN doc_id % 19 = 0 THEN 'test_' || doc_id ELSE lang || '_' || doc_id END AS stem
      FROM documents)
""",
    "analysed": r"""
SELECT *, CASE WHEN language IS NOT NULL THEN
         len(regexp_extract_all(content, '\r\n|\r|\n')) + CASE WHEN content <> '' AND NOT regexp_matches(content, '[\r\n]$') THEN 1 ELSE 0 END
       END AS loc
FROM (SELECT *, CASE ext WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.md' THEN 'Markdown' WHEN '.java' THEN 'Java'
                 WHEN '.go' THEN 'Go' WHEN '.sql' THEN 'SQL' WHEN '.rb' THEN 'Ruby' WHEN '.yaml' THEN 'YAML' END AS language,
             folder IN ('tests/', 'pkg/spec/') OR stem LIKE 'test\_%' ESCAPE '\' AS is_test,
             ext = '.yaml' AS is_config, stem = 'README' AS is_doc
      FROM files WHERE folder NOT IN ('node_modules/x/', '.github/'))
""",
    "repo_languages": """
SELECT repo_id, language, count(*) AS file_count, sum(loc)::BIGINT AS loc FROM analysed WHERE language IS NOT NULL GROUP BY ALL
""",
    "split_lines": r"""
SELECT repo_id, path, folder, ext, generate_subscripts(lines, 1) AS line_number, unnest(lines) AS line
FROM (SELECT *, CASE WHEN content LIKE '%' || chr(10) THEN list_slice(parts, 1, len(parts) - 1) ELSE parts END AS lines
      FROM (SELECT *, string_split_regex(content, '\r\n?|\n') AS parts FROM files WHERE content <> ''))
""",
}


def oracle(main: str, *names: str) -> str:
    """`main` with the canonical tables it needs in front, dependencies first."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in needed:
            return
        for other in TABLES:
            if other != name and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b", TABLES[name]):
                add(other)
        needed.append(name)

    used = set(names) | {t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", main)}
    for t in TABLES:
        if t in used:
            add(t)
    ctes = ",\n".join(f"{n} AS ({TABLES[n].strip()})" for n in needed)
    body = main.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
