"""Differences between a scan and the next one of the same repository."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..bindings import Tables
from ..operators import compare as c
from .canonical_sql import oracle


def _pairs(t: Tables):
    """Every scan with the next scan of its repository."""
    key = W.partitionBy("project_repository_id").orderBy("created_at", "id")
    return (
        t.scans().withColumn("scan_b", F.lead("id").over(key))
        .filter(F.col("scan_b").isNotNull())
        .select(F.col("id").alias("scan_a"), "scan_b")
    )


PAIRS = """
WITH pairs AS (SELECT scan_a, scan_b FROM (SELECT id AS scan_a, lead(id) OVER (
  PARTITION BY project_repository_id ORDER BY created_at, id) AS scan_b FROM scans)
  WHERE scan_b IS NOT NULL)
"""


def _matched(rows: str, key: str) -> str:
    return f"""
, a AS (SELECT p.scan_a, p.scan_b, x.* FROM pairs p JOIN {rows} x ON x.scan_id = p.scan_a)
, b AS (SELECT p.scan_a, p.scan_b, x.* FROM pairs p JOIN {rows} x ON x.scan_id = p.scan_b)
, m AS (SELECT coalesce(a.scan_a, b.scan_a) AS scan_a, coalesce(a.scan_b, b.scan_b) AS scan_b,
        coalesce(a.{key}, b.{key}) AS {key}, a, b, a.scan_id IS NULL AS no_a, b.scan_id IS NULL AS no_b
        FROM a FULL JOIN b ON a.scan_a = b.scan_a AND a.scan_b = b.scan_b AND a.{key} = b.{key})
"""


QUERIES = {
    "f30_safe_delta": (
        lambda t: c.metrics_diff(t.scans(), _pairs(t)),
        oracle(PAIRS + """SELECT scan_a, scan_b, b.total_files - a.total_files AS total_files_delta, b.total_loc - a.total_loc AS total_loc_delta,
                          b.size_bytes - a.size_bytes AS size_bytes_delta FROM pairs JOIN scans a ON a.id = scan_a JOIN scans b ON b.id = scan_b"""),
    ),
    "j15_lang_diff": (
        lambda t: c.language_diff(t.scan_languages(), _pairs(t)),
        oracle(PAIRS + _matched("scan_languages", "language") + """
            SELECT scan_a, scan_b, language, CASE WHEN no_b THEN 'removed' WHEN no_a THEN 'added' ELSE 'changed' END AS change,
              CASE WHEN no_a THEN b.loc ELSE b.loc - a.loc END AS loc_delta,
              CASE WHEN no_a THEN b.percentage ELSE round_even(b.percentage - a.percentage, 2) END AS percentage_delta
            FROM m WHERE no_a OR no_b OR b.loc <> a.loc""", "scan_languages", "scans"),
    ),
    "j16_score_diff": (
        lambda t: c.score_diff(t.scan_scores(), _pairs(t)),
        oracle(PAIRS + _matched("scan_scores", "domain") + """
            SELECT scan_a, scan_b, domain, coalesce(a.score, 0.0) AS score_a, coalesce(b.score, 0.0) AS score_b,
              round_even(coalesce(b.score, 0.0) - coalesce(a.score, 0.0), 1) AS delta FROM m""", "scan_scores", "scans"),
    ),
    "j17_risk_diff": (
        lambda t: c.risk_diff(t.scan_risks(), _pairs(t)),
        oracle(PAIRS + """, last_risks AS (SELECT scan_id, risk_type, title, severity FROM (SELECT *, row_number() OVER (
              PARTITION BY scan_id, risk_type ORDER BY id DESC, title DESC, severity DESC) AS n FROM scan_risks) WHERE n = 1)"""
            + _matched("last_risks", "risk_type") + """
            SELECT scan_a, scan_b, risk_type, CASE WHEN no_a THEN b.title ELSE a.title END AS title,
              CASE WHEN no_a THEN b.severity ELSE a.severity END AS severity, CASE WHEN no_a THEN 'new' ELSE 'resolved' END AS change
            FROM m WHERE no_a OR no_b""", "scan_risks", "scans"),
    ),
    "j18_dev_diff": (
        lambda t: c.developer_diff(t.contributions(), t.profiles(), _pairs(t)),
        oracle(PAIRS + """, names AS (SELECT DISTINCT scan_id, canonical_username FROM contributions c JOIN profiles p ON p.id = c.profile_id)"""
            + _matched("names", "canonical_username") + """
            SELECT scan_a, scan_b, canonical_username, CASE WHEN no_a THEN 'joined' ELSE 'left' END AS change
            FROM m WHERE no_a OR no_b""", "scans", "contributions", "profiles"),
    ),
    "u3_keys_union": (
        lambda t: c.score_diff(t.scan_scores(), _pairs(t)).select("scan_a", "scan_b", "domain"),
        oracle(PAIRS + """SELECT scan_a, scan_b, domain FROM pairs JOIN scan_scores ON scan_id = scan_a
                          UNION SELECT scan_a, scan_b, domain FROM pairs JOIN scan_scores ON scan_id = scan_b"""),
    ),
    "u4_keys_except": (
        lambda t: c.developer_diff(t.contributions(), t.profiles(), _pairs(t)).filter(F.col("change") == "joined")
        .select("scan_a", "scan_b", "canonical_username"),
        oracle(PAIRS + """, names AS (SELECT DISTINCT scan_id, canonical_username FROM contributions c JOIN profiles p ON p.id = c.profile_id)
            SELECT scan_a, scan_b, canonical_username FROM pairs JOIN names ON scan_id = scan_b
            EXCEPT SELECT scan_a, scan_b, canonical_username FROM pairs JOIN names ON scan_id = scan_a"""),
    ),
    "e13_scan_compare": (
        lambda t: c.metrics_diff(t.scans(), _pairs(t))
        .join(c.language_diff(t.scan_languages(), _pairs(t)).groupBy("scan_a", "scan_b").agg(F.count("*").alias("languages")), ["scan_a", "scan_b"], "left")
        .join(c.risk_diff(t.scan_risks(), _pairs(t)).groupBy("scan_a", "scan_b").agg(F.count("*").alias("risks")), ["scan_a", "scan_b"], "left")
        .select("scan_a", "scan_b", "total_loc_delta", "languages", "risks"),
        oracle(PAIRS + """, k AS (SELECT DISTINCT scan_id, risk_type FROM scan_risks),
            r AS (SELECT scan_a, scan_b, count(*) AS risks FROM (
              (SELECT scan_a, scan_b, risk_type FROM pairs JOIN k ON scan_id = scan_a EXCEPT SELECT scan_a, scan_b, risk_type FROM pairs JOIN k ON scan_id = scan_b)
              UNION ALL (SELECT scan_a, scan_b, risk_type FROM pairs JOIN k ON scan_id = scan_b EXCEPT SELECT scan_a, scan_b, risk_type FROM pairs JOIN k ON scan_id = scan_a)) GROUP BY ALL),
            l AS (SELECT scan_a, scan_b, count(*) AS languages FROM (
              SELECT scan_a, scan_b, language FROM (SELECT scan_a, scan_b, language, loc, 'a' AS side FROM pairs JOIN scan_languages ON scan_id = scan_a
                UNION ALL SELECT scan_a, scan_b, language, loc, 'b' FROM pairs JOIN scan_languages ON scan_id = scan_b)
              GROUP BY scan_a, scan_b, language HAVING count(*) = 1 OR min(loc) <> max(loc)) GROUP BY ALL)
            SELECT p.scan_a, p.scan_b, b.total_loc - a.total_loc AS total_loc_delta, languages, risks
            FROM pairs p JOIN scans a ON a.id = p.scan_a JOIN scans b ON b.id = p.scan_b LEFT JOIN l ON l.scan_a = p.scan_a AND l.scan_b = p.scan_b
            LEFT JOIN r ON r.scan_a = p.scan_a AND r.scan_b = p.scan_b"""),
    ),
}
