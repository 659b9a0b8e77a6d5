"""Commit history: log text, contributions, identities and merges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..bindings import Tables
from ..functions import paths
from ..operators import contributions as co
from ..operators import increments as inc
from ..operators import merges as mg
from ..plans.developers import developer_overrides
from ..session import checkpoint_dir
from ..sources import history as hs
from ..sources import tables
from ..streaming import seen
from .canonical_sql import oracle, share_sql


def _history(t: Tables):
    return co.with_identity(t.commits())


def _overrides(t: Tables):
    """Hand-made overrides: some customers by name, some by e-mail, one project per region."""
    n = t.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("long").alias("project_id"))
    c = t.raw("customer").join(n, "c_nationkey")
    k = F.col("c_custkey")
    by_name = c.filter(k % 10 == 1).select(
        k.alias("id"), "project_id", F.concat(F.lit("  "), F.upper("c_name")).alias("raw_name"), F.lit("").alias("raw_email"),
        F.concat(F.lit("named_"), k.cast("string")).alias("canonical_username"))
    by_email = c.filter(k % 30 == 3).select(
        (k + 10_000_000).alias("id"), "project_id", F.lit(None).cast("string").alias("raw_name"),
        F.concat(F.lit("Dev.Team"), (k % 200).cast("string"), F.lit("@example.com")).alias("raw_email"),
        F.concat(F.lit("mailed_"), k.cast("string")).alias("canonical_username"))
    return by_name.unionByName(by_email)


def _projected(t: Tables):
    n = t.raw("nation").select(F.col("n_nationkey").cast("long").alias("repo_id"), F.col("n_regionkey").cast("long").alias("project_id"))
    return t.commits().join(n, "repo_id")


OVERRIDES = """
WITH pc AS (SELECT c.*, n_regionkey::BIGINT AS project_id FROM customer c JOIN nation ON n_nationkey = c_nationkey),
names AS (SELECT project_id, lower(c_name) AS key, 'named_' || c_custkey AS u FROM pc WHERE c_custkey % 10 = 1),
mails AS (SELECT project_id, key, arg_max(u, id) AS u FROM (SELECT project_id, 'dev.team' || (c_custkey % 200) || '@example.com' AS key,
            'mailed_' || c_custkey AS u, c_custkey AS id FROM pc WHERE c_custkey % 30 = 3) GROUP BY ALL),
resolved AS (SELECT c.*, n_regionkey::BIGINT AS project_id, coalesce(a.u, b.u, c.username) AS who,
  CASE WHEN coalesce(a.u, b.u) IS NOT NULL THEN 1.0 WHEN author_email IS NOT NULL THEN 0.9 ELSE 0.85 END::DOUBLE AS confidence,
  CASE WHEN coalesce(a.u, b.u) IS NOT NULL THEN 'override' WHEN author_email IS NOT NULL THEN 'email' ELSE 'name' END AS source
  FROM commits c JOIN nation ON n_nationkey = repo_id LEFT JOIN names a ON a.project_id = n_regionkey AND a.key = lower(author_name)
  LEFT JOIN mails b ON b.project_id = n_regionkey AND b.key = author_email)
"""


def _log_blocks(t: Tables):
    """Orders written out as commit-log text, one block per commit, newest first."""
    lines = F.transform(
        "file_changes",
        lambda c: F.concat_ws("\t", c["insertions"].cast("string"), c["deletions"].cast("string"), c["path"]),
    )
    noise = F.array(
        F.lit("-\t-\tassets/logo.png"), F.lit("3\t1\tnode_modules/x/index.js"), F.lit("x\t1\tbad.py"),
        F.lit("5\t2\tsrc/{old => new}/moved.py"),
    )
    key = F.col("sha").cast("long")
    head = F.array(
        F.when(key % 50 == 0, "abc").otherwise(F.col("sha")), F.col("author_name"),
        F.coalesce("author_email", F.lit("none@example.com")), F.when(key % 60 == 7, "no time").otherwise(F.col("ts_raw")), F.lit(""),
    )
    return t.commits().select("repo_id", "seq", F.array_join(F.concat(head, lines, noise), "\n").alias("value"))


def _parsed(t: Tables):
    return hs.parse_log(_log_blocks(t))


LOG = """
WITH good AS (SELECT * FROM commits WHERE sha_key % 50 <> 0 AND sha_key % 60 <> 7),
log_changes AS (SELECT sha_key, path, insertions, deletions, language FROM changes
  UNION ALL SELECT sha_key, 'assets/logo.png', 0, 0, NULL FROM good UNION ALL SELECT sha_key, 'src/new/moved.py', 5, 2, 'Python' FROM good)
"""


def _tag_lines(t: Tables):
    """Tag lists made of parts: annotated ones name their commit, some dates are broken."""
    k = F.col("p_partkey")
    return t.raw("part").select(
        (k % 25).alias("repository_id"),
        F.concat_ws(
            "\t",
            F.concat(F.lit("v"), k.cast("string")),
            F.when(k % 2 == 0, "tag").otherwise("commit"),
            F.lpad(k.cast("string"), 45, "a"),
            F.when(k % 7 == 0, "someday").otherwise(F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00+02:00"))),
            F.when(k % 3 == 0, "").otherwise(F.col("p_brand")),
            F.when(k % 3 == 0, "").otherwise(F.lit("<dev@example.com>")),
            *[F.when(k % 11 != 0, F.col("p_name"))],
        ).alias("value"),
        F.when(k % 4 == 0, F.lpad(k.cast("string"), 40, "c")).alias("commit_sha"),
    )


TAGS = """
SELECT p_partkey % 25 AS repository_id, 'v' || p_partkey AS name,
  CASE WHEN p_partkey % 2 = 0 AND p_partkey % 4 = 0 THEN lpad(p_partkey::VARCHAR, 40, 'c') ELSE lpad(p_partkey::VARCHAR, 45, 'a') END AS sha,
  p_name AS message, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS tagger_name,
  CASE WHEN p_partkey % 3 <> 0 THEN 'dev@example.com' END AS tagger_email,
  CASE WHEN p_partkey % 7 <> 0 THEN make_timestamp(2024, 1, p_partkey % 28 + 1, 8, 0, 0) END AS tagged_at
FROM part WHERE p_partkey % 11 <> 0
"""


def _tag_change(t: Tables):
    tags = hs.parse_tags(_tag_lines(t))
    number = F.substring("name", 2, 12).cast("long")
    existing = tags.filter(number % 3 != 0).withColumn("message", F.lit("old"))
    incoming = tags.filter((number % 4 != 0) & (F.col("repository_id") != 5))
    return mg.git_tags_merge(existing, incoming)


MERGED = f"""
WITH t AS ({TAGS}), k AS (SELECT *, substr(name, 2)::BIGINT AS n FROM t WHERE repository_id <> 5)
SELECT repository_id, name, sha, CASE WHEN n % 4 <> 0 THEN message ELSE 'old' END AS message, tagger_name, tagger_email, tagged_at,
  CASE WHEN n % 4 = 0 THEN 'deleted' WHEN n % 3 = 0 THEN 'inserted' ELSE 'updated' END AS change
FROM k WHERE n % 3 <> 0 OR n % 4 <> 0
"""


def _listing(t: Tables):
    """Provider listings made of customers: clone URLs repeat, some rows are unusable."""
    k = F.col("c_custkey")
    n = t.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("long").alias("project_id"))
    even = F.concat(F.lit("https://user@git.example.org/team/repo_"), (k % 60).cast("string"), F.lit(".git"))
    return t.raw("customer").join(n, "c_nationkey").select(
        "project_id", k.alias("position"), F.col("c_name").alias("name"),
        F.when(k % 13 != 0, F.when(k % 60 % 2 == 0, even).otherwise(F.concat(F.lit("git@github.com:team/repo_"), (k % 60).cast("string"), F.lit(".git")))).alias("clone_url"),
        (k % 17 == 0).alias("archived"),
        F.when(k % 2 == 0, k % 19 == 0).alias("fork"),
        F.when(k % 3 == 0, "develop").alias("default_branch"),
    )


LISTING = """
WITH listing AS (SELECT n_regionkey::BIGINT AS project_id, c_custkey AS position, c_name AS name, c_custkey % 60 AS r,
  CASE WHEN c_custkey % 13 <> 0 THEN CASE WHEN c_custkey % 60 % 2 = 0 THEN 'https://user@git.example.org/team/repo_' || (c_custkey % 60) || '.git'
       ELSE 'git@github.com:team/repo_' || (c_custkey % 60) || '.git' END END AS clone_url,
  c_custkey % 17 = 0 AS archived, c_custkey % 2 = 0 AND c_custkey % 19 = 0 AS fork, CASE WHEN c_custkey % 3 = 0 THEN 'develop' END AS default_branch
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
usable AS (SELECT * FROM listing WHERE clone_url IS NOT NULL AND NOT archived AND NOT fork)
"""


def _rerun_scans(t: Tables):
    """Facts of all scans written, then of some scans anew with fewer rows, then of some with none."""
    target = f"{checkpoint_dir(t.spark)}/facts-{uuid.uuid4().hex}"
    facts = t.scan_languages().select("scan_id", "language", "loc")
    tables.append_facts(facts, target)
    tables.append_facts(facts.filter((F.col("scan_id") % 3 == 0) & (F.col("loc") % 20 == 0)), target, scans=facts.filter(F.col("scan_id") % 3 == 0).select("scan_id"))
    tables.append_facts(facts.filter("false"), target, scans=facts.filter(F.col("scan_id") % 7 == 0).select("scan_id"))
    return tables.read_facts(t.spark, target)


def _steps(t: Tables) -> str:
    """The history in three arrivals, oldest commits first, each folded when it is there."""
    store = f"{checkpoint_dir(t.spark)}/increments-{uuid.uuid4().hex}"
    day = F.to_date(F.substring("ts_raw", 1, 10))
    arrival = F.when(day < "1994-06-01", 1).when(day < "1997-01-01", 2).otherwise(3).cast("long")
    t.commits().withColumn("arrival", arrival).write.partitionBy("arrival").parquet(f"{store}/commits")
    commits = t.spark.read.parquet(f"{store}/commits")
    for there in (1, 2, 3):
        inc.fold(commits.filter(F.col("arrival") <= there), store)
    return store


def _streamed(t: Tables):
    """Events as commits that arrive in two logs; the second brings ten days again, four of them finished by then."""
    home = f"{checkpoint_dir(t.spark)}/seen-{uuid.uuid4().hex}"
    e = t.raw("events")
    rows = e.select(
        (F.col("user_id") % 25).alias("repo_id"), F.col("event_id").cast("string").alias("commit_id"),
        F.to_date("ts").alias("commit_date"),
    )
    for arrived, part in (("2024-01-20", F.col("commit_date") < "2024-01-20"), ("2024-02-02", F.col("commit_date") >= "2024-01-10")):
        rows.filter(part).withColumn("arrived", F.lit(arrived).cast("timestamp")).write.mode("append").parquet(f"{home}/logs")
        logs = t.spark.readStream.schema("repo_id long, commit_id string, commit_date date, arrived timestamp").parquet(f"{home}/logs")
        seen.count_commits(logs, f"{home}/counts", f"{home}/state", keep_days=5, shares=4, every=2).awaitTermination()
    return seen.counted_daily(t.spark, f"{home}/counts")


RERUN = oracle("""SELECT scan_id, language, loc FROM scan_languages WHERE scan_id % 7 <> 0 AND (scan_id % 3 <> 0 OR loc % 20 = 0)""")


QUERIES = {
    "a27_contributions": (
        lambda t: co.contributions(t.commits()).select(
            "repo_id", "username", "commit_count", "insertions", "deletions", "files_changed", "active_days", "first_commit_at", "last_commit_at"),
        oracle("SELECT * FROM user_stats"),
    ),
    "w7_first_seen": (
        lambda t: co.contributions(t.commits()).select("repo_id", "username", "display_name", "primary_email", "confidence", "is_ambiguous"),
        oracle("""SELECT repo_id, username, arg_min(author_name, seq) AS display_name, arg_min(author_email, seq) AS primary_email,
                    CASE WHEN arg_min(author_email, seq) IS NOT NULL THEN 0.9 ELSE 0.85 END::DOUBLE AS confidence, false AS is_ambiguous
                  FROM commits GROUP BY ALL""".replace(
            "arg_min(author_email, seq) AS primary_email",
            "any_value(author_email) FILTER (seq = first) AS primary_email").replace(
            "arg_min(author_name, seq) AS display_name", "any_value(author_name) FILTER (seq = first) AS display_name").replace(
            "arg_min(author_email, seq) IS NOT NULL", "any_value(author_email) FILTER (seq = first) IS NOT NULL").replace(
            "FROM commits GROUP BY ALL",
            "FROM (SELECT *, min(seq) OVER (PARTITION BY repo_id, username) AS first FROM commits) GROUP BY repo_id, username"), "commits"),
    ),
    "a28_contrib_languages": (
        lambda t: co.language_contributions(t.commits()),
        oracle(f"""SELECT *, {share_sql('files_changed', 'sum(files_changed) OVER (PARTITION BY repo_id, username)')} AS percentage FROM
                   (SELECT repo_id, username, language, count(*) AS commit_count, count(*) AS files_changed, sum(insertions)::BIGINT AS loc_added,
                      sum(deletions)::BIGINT AS loc_deleted FROM user_changes WHERE language IS NOT NULL GROUP BY ALL)"""),
    ),
    "a28_contrib_languages_at_head": (
        lambda t: co.language_contributions(
            t.commits(),
            t.commits().select("repo_id", F.explode("file_changes.language").alias("language")).filter(
                F.col("language").isNotNull() & ~((F.col("language") == "Java") & (F.col("repo_id") % 2 == 0))).distinct()),
        oracle(f"""SELECT * FROM (SELECT *, {share_sql('files_changed', 'sum(files_changed) OVER (PARTITION BY repo_id, username)')} AS percentage FROM
                   (SELECT repo_id, username, language, count(*) AS commit_count, count(*) AS files_changed, sum(insertions)::BIGINT AS loc_added,
                      sum(deletions)::BIGINT AS loc_deleted FROM user_changes WHERE language IS NOT NULL GROUP BY ALL))
                   WHERE NOT (language = 'Java' AND repo_id % 2 = 0)"""),
    ),
    "a29_contrib_modules": (
        lambda t: co.module_contributions(t.commits()),
        oracle(f"""SELECT *, {share_sql('files_changed', 'sum(files_changed) OVER (PARTITION BY repo_id, username)')} AS percentage FROM
                   (SELECT repo_id, username, module, count(*) AS commit_count, count(*) AS files_changed, sum(insertions)::BIGINT AS loc_added
                    FROM user_changes GROUP BY ALL)"""),
    ),
    "a27_in_steps": (
        lambda t: inc.contributions(t.spark, _steps(t)).select(
            "repo_id", "username", "commit_count", "insertions", "deletions", "files_changed", "active_days", "first_commit_at", "last_commit_at"),
        oracle("SELECT * FROM user_stats"),
    ),
    "a28_in_steps": (
        lambda t: inc.language_contributions(t.spark, _steps(t)),
        oracle(f"""SELECT *, {share_sql('files_changed', 'sum(files_changed) OVER (PARTITION BY repo_id, username)')} AS percentage FROM
                   (SELECT repo_id, username, language, count(*) AS commit_count, count(*) AS files_changed, sum(insertions)::BIGINT AS loc_added,
                      sum(deletions)::BIGINT AS loc_deleted FROM user_changes WHERE language IS NOT NULL GROUP BY ALL)"""),
    ),
    "a29_in_steps": (
        lambda t: inc.module_contributions(t.spark, _steps(t)),
        oracle(f"""SELECT *, {share_sql('files_changed', 'sum(files_changed) OVER (PARTITION BY repo_id, username)')} AS percentage FROM
                   (SELECT repo_id, username, module, count(*) AS commit_count, count(*) AS files_changed, sum(insertions)::BIGINT AS loc_added
                    FROM user_changes GROUP BY ALL)"""),
    ),
    "a30_developer_daily": (
        lambda t: co.developer_daily(_history(t)),
        oracle("SELECT username, day AS commit_date, count(*) AS commit_count FROM commits GROUP BY ALL"),
    ),
    "a30_repo_daily": (
        lambda t: co.repo_daily(t.commits()),
        oracle("SELECT repo_id, day AS commit_date, count(*) AS commit_count FROM commits GROUP BY ALL"),
    ),
    "raw_identities": (
        lambda t: co.raw_identities(_history(t)).select("repo_id", "username", "raw_name", "raw_email"),
        oracle("SELECT DISTINCT repo_id, username, author_name AS raw_name, author_email AS raw_email FROM commits"),
    ),
    "j11_override_lookup": (
        lambda t: co.with_identity(_projected(t), _overrides(t)).select(
            "repo_id", "project_id", F.col("sha").cast("long").alias("sha_key"), "username", "identity.confidence", "identity.source"),
        oracle(OVERRIDES + "SELECT repo_id, project_id, sha_key, who AS username, confidence, source FROM resolved", "commits"),
    ),
    "f6_resolve_identity": (
        lambda t: co.with_identity(_projected(t), _overrides(t)).groupBy("project_id", "username", "identity.source").agg(F.count("*").alias("commits")),
        oracle(OVERRIDES + "SELECT project_id, who AS username, source, count(*) AS commits FROM resolved GROUP BY ALL", "commits"),
    ),
    "e2_developer_overrides": (
        lambda t: developer_overrides(
            t.profiles().withColumn("canonical_username", F.concat(F.lit("named_"), F.col("id").cast("string"))), _overrides(t)
        ).select("developer_id", "canonical_username", "project_id"),
        oracle(OVERRIDES + "SELECT c_custkey // 3 AS developer_id, 'named_' || c_custkey AS canonical_username, project_id FROM pc WHERE c_custkey % 10 = 1", "commits"),
    ),
    "s2_git_log": (
        lambda t: _parsed(t).select(
            "repo_id", F.col("sha").cast("long").alias("sha_key"), "author_name", "ts", F.size("file_changes").cast("long").alias("changes"),
            F.aggregate("file_changes.insertions", F.lit(0).cast("long"), lambda a, x: a + x).alias("insertions"),
            F.size(F.filter("file_changes", lambda c: c["language"].isNotNull())).cast("long").alias("with_language")),
        oracle(LOG + """SELECT repo_id, g.sha_key, author_name, ts, count(l.sha_key) AS changes, coalesce(sum(insertions), 0)::BIGINT AS insertions,
                          count(language) AS with_language FROM good g LEFT JOIN log_changes l USING (sha_key) GROUP BY ALL""", "commits", "changes"),
    ),
    "s2_git_log_changes": (
        lambda t: _parsed(t).select(F.col("sha").cast("long").alias("sha_key"), F.inline_outer("file_changes")).filter(F.col("path").isNotNull()),
        oracle(LOG + "SELECT l.* FROM log_changes l JOIN good USING (sha_key)", "commits", "changes"),
    ),
    "s3_history_limit": (
        lambda t: hs.history_limit(t.commits(), 100).select("repo_id", "seq"),
        oracle("SELECT repo_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY seq) AS n FROM commits) WHERE n <= 100"),
    ),
    "s4_git_tags": (lambda t: hs.parse_tags(_tag_lines(t)), TAGS.strip()),
    "s9_append_facts": (_rerun_scans, RERUN.strip()),
    "e18_git_tags_of_repository": (
        lambda t: hs.parse_tags(_tag_lines(t)).orderBy(F.desc_nulls_last("tagged_at"), "name").select("name", "tagged_at"),
        f"SELECT name, tagged_at FROM ({TAGS})",
    ),
    "j22_git_tags_merge": (_tag_change, MERGED.strip()),
    "j22_git_tags_after": (
        lambda t: mg.git_tags_after(_tag_change(t)),
        f"SELECT * EXCLUDE (change) FROM ({MERGED}) WHERE change <> 'deleted'",
    ),
    "j23_daily_upsert_max": (
        lambda t: mg.daily_upsert_max(
            t.repository_daily().filter(F.dayofmonth("commit_date") <= 20),
            t.repository_daily().filter(F.dayofmonth("commit_date") >= 10).withColumn("commit_count", F.col("commit_count") + F.dayofmonth("commit_date") - 15),
            "project_repository_id"),
        oracle("""SELECT project_repository_id, commit_date, max(n)::BIGINT AS commit_count FROM (
                  SELECT project_repository_id, commit_date, commit_count AS n FROM repository_daily WHERE day(commit_date) <= 20
                  UNION ALL SELECT project_repository_id, commit_date, commit_count + day(commit_date) - 15 FROM repository_daily
                  WHERE day(commit_date) >= 10) GROUP BY ALL"""),
    ),
    "j23_daily_stream": (
        _streamed,
        """SELECT user_id % 25 AS repo_id, ts::DATE AS commit_date, count(*) AS commit_count FROM events
           WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL""",
    ),
    "j24_dim_get_or_create": (
        lambda t: mg.get_or_create(
            t.profiles().filter(F.col("id") % 2 == 0).select("id", "canonical_username"),
            t.profiles().filter(F.col("id") % 3 == 0).select("canonical_username"), ["canonical_username"]
        ).select("canonical_username", "id"),
        oracle("""WITH old AS (SELECT id, canonical_username FROM profiles WHERE id % 2 = 0)
                  SELECT canonical_username, id FROM old UNION ALL
                  SELECT canonical_username, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY canonical_username)
                  FROM profiles WHERE id % 3 = 0 AND id % 2 <> 0"""),
    ),
    "j24_ids_are_unique": (
        lambda t: mg.get_or_create(
            t.profiles().filter(F.col("id") % 2 == 0).select("id", "canonical_username"), t.profiles().select("canonical_username"), ["canonical_username"]
        ).agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.max("id").alias("largest")),
        oracle("""SELECT count(*) AS rows, count(*) AS ids, max(id) FILTER (id % 2 = 0) + count(*) FILTER (id % 2 <> 0) AS largest FROM profiles"""),
    ),
    "p14_skip_archived_forks": (
        lambda t: mg.importable(_listing(t)).select("project_id", "position", "clone_url"),
        LISTING.strip() + " SELECT project_id, position, clone_url FROM usable",
    ),
    "j25_import_new_repos": (
        lambda t: mg.import_new_repos(mg.importable(_listing(t)), t.repositories(), t.project_repositories()),
        oracle(LISTING + """SELECT u.project_id, coalesce(g.id, (SELECT max(id) FROM repositories) + dense_rank() OVER (PARTITION BY g.id IS NULL ORDER BY u.clone_url)) AS repository_id, u.clone_url AS url, g.id IS NULL AS is_new_repository, name, coalesce(default_branch, 'main') AS default_branch
              FROM (SELECT *, row_number() OVER (PARTITION BY project_id, clone_url ORDER BY position) AS n FROM usable) u
              LEFT JOIN repositories g ON g.url = u.clone_url
              WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM prs p JOIN repositories x ON x.id = p.repository_id
                WHERE p.project_id = u.project_id AND x.url = u.clone_url)""", "repositories", "prs"),
    ),
    "j26_orphan_repositories": (
        lambda t: mg.orphan_repositories(t.repositories(), t.project_repositories()),
        oracle("SELECT id, url, provider FROM repositories WHERE id NOT IN (SELECT repository_id FROM prs)"),
    ),
    "f8_top_module": (
        lambda t: t.change_rows().groupBy(paths.top_module(F.col("path")).alias("module")).agg(F.count("*").alias("changes")),
        oracle("SELECT module, count(*) AS changes FROM changes GROUP BY ALL"),
    ),
    "f10_detect_language": (
        lambda t: t.change_rows().groupBy(paths.detect_language(F.col("path")).alias("language")).agg(F.count("*").alias("changes")),
        oracle("SELECT language, count(*) AS changes FROM changes GROUP BY ALL"),
    ),
}
