"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import AS_OF, Tables, case
from ..functions import identity as idn
from ..functions import links, paths, scalars
from .canonical_sql import oracle, sql_case

# Latin letters and the Cyrillic ones that stand in for them in the transliteration check.
CYRILLIC = {"a": "ж", "e": "Щ", "i": "ь", "o": "ю", "r": "р", "t": "Т", "l": "л", "n": "ё", "s": "Ш", "d": "я", "g": "х"}
LATIN = {"a": "zh", "e": "shch", "i": "", "o": "yu", "r": "r", "t": "t", "l": "l", "n": "yo", "s": "sh", "d": "ya", "g": "kh"}
EMAILS = ["D.Ivanov@x.org", "john-smith+", "..@x.org", "@x.org", "a_word@x.org", "Solo!@x.org"]
NAMES = ["Ivan Petrov", "Д. Иванов", "solo", "???", "Élodie  de la Tour", "J Smith"]
USERS = ["i_petrov", "d_ivanov", "solo", "unknown", "e_tour", "j_smith"]
CONFIDENCE = ["0.85", "0.7", "0.5", "0.1", "0.85", "0.7"]
PATHS = ["src/{old => new}/", "old.py => ", "{a/b => c}/x/", "src/{old => }/", "  plain/", "   "]
ACCENTS = r"regexp_replace(strip_accents(lower(text)), '[^\x00-\x7F]', '', 'g')"


def _part(t: Tables):
    return t.raw("part").select(F.col("p_partkey").alias("k"), "p_name", "p_size")


def _urls(t: Tables):
    k = F.col("page_id")
    host_path = F.regexp_replace("url", "^https?://", "")
    ssh = F.concat(F.lit("git@"), F.regexp_replace(host_path, "/", ":"), F.lit(".git"))
    return t.raw("pages").select(
        k.alias("k"),
        F.when(k % 3 == 0, F.concat("url", F.lit(".git"))).when(k % 3 == 1, F.regexp_replace(ssh, "^(git@[^:]+:)(.*?)$", "$1$2")).otherwise(F.col("url")).alias("url"),
        case(k % 4, ["github", "gitlab", "bitbucket"], "other").alias("provider"),
        F.when(k % 5 != 0, F.concat(F.lit("feature/x "), k.cast("string"))).otherwise("").alias("ref"),
        F.when(k % 3 != 2, F.concat(F.lit("/src\\a b/*~ü"), k.cast("string"), F.lit(".py"))).alias("path"),
        (k % 7).alias("line"),
    )


URLS = r"""
WITH u AS (SELECT page_id AS k, CASE page_id % 3 WHEN 0 THEN url || '.git'
    WHEN 1 THEN 'git@' || regexp_replace(regexp_replace(url, '^https?://', ''), '/', ':', 'g') || '.git' ELSE url END AS url FROM pages),
b AS (SELECT k, CASE WHEN regexp_matches(url, '(?i)^https?://(?:[^@]+@)?([^/]+)/(.+?)(?:\.git)?/?$')
    THEN 'https://' || regexp_extract(url, '(?i)^https?://(?:[^@]+@)?([^/]+)/(.+?)(?:\.git)?/?$', 1) || '/'
      || rtrim(regexp_extract(url, '(?i)^https?://(?:[^@]+@)?([^/]+)/(.+?)(?:\.git)?/?$', 2), '/')
    WHEN regexp_matches(url, '^git@([^:]+):(.+?)(?:\.git)?/?$') THEN 'https://' || regexp_extract(url, '^git@([^:]+):(.+?)(?:\.git)?/?$', 1) || '/'
      || rtrim(regexp_extract(url, '^git@([^:]+):(.+?)(?:\.git)?/?$', 2), '/') END AS base FROM u)
"""
SOURCE_URL = URLS + """
SELECT k, CASE WHEN k % 4 = 3 THEN NULL ELSE base || CASE WHEN k % 3 = 2
    THEN CASE k % 4 WHEN 0 THEN '/tree/' WHEN 1 THEN '/-/tree/' ELSE '/src/' END || ref
    ELSE CASE k % 4 WHEN 0 THEN '/blob/' WHEN 1 THEN '/-/blob/' ELSE '/src/' END || ref || '/src/a%20b/%2A~%C3%BC' || k || '.py'
      || CASE WHEN k % 7 > 0 THEN CASE k % 4 WHEN 2 THEN '#lines-' ELSE '#L' END || (k % 7) ELSE '' END END END AS url
FROM (SELECT *, CASE WHEN k % 5 <> 0 THEN 'feature%2Fx%20' || k ELSE 'HEAD' END AS ref FROM b)
"""

QUERIES = {
    "f1_transliterate": (
        lambda t: _part(t).select("k", idn.transliterate(F.translate("p_name", "".join(CYRILLIC), "".join(CYRILLIC.values()))).alias("latin")),
        "SELECT p_partkey AS k, array_to_string([CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LATIN.items())
        + " ELSE c END FOR c IN string_split(p_name, '')], '') AS latin FROM part",
    ),
    "f2_strip_diacritics": (
        lambda t: t.raw("documents").select("doc_id", idn.strip_diacritics(F.lower("text")).alias("ascii")),
        f"SELECT doc_id, {ACCENTS} AS ascii FROM documents",
    ),
    "f3_clean_name": (
        lambda t: t.raw("documents").select("doc_id", idn.clean_name(F.col("text")).alias("clean")),
        f"SELECT doc_id, trim(regexp_replace({ACCENTS}, '[^a-z0-9]+', ' ', 'g')) AS clean FROM documents",
    ),
    "f4_email_to_username": (
        lambda t: _part(t).select("k", idn.email_to_username(F.concat(
            case(F.col("k") % 6, EMAILS), F.when(F.col("k") % 6 == 1, F.concat(F.col("k").cast("string"), F.lit("@x.org"))).otherwise(""))).alias("username")),
        """SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'd_ivanov' WHEN 1 THEN 'j_' || p_partkey WHEN 2 THEN '__' WHEN 4 THEN 'a_word'
             WHEN 5 THEN 'solo' END AS username FROM part""",
    ),
    "f5_name_to_username": (
        lambda t: _part(t).select("k", idn.name_to_identity(case(F.col("k") % 6, NAMES)).alias("i")).select("k", "i.username", "i.confidence", "i.is_ambiguous"),
        f"""SELECT p_partkey AS k, {sql_case('p_partkey % 6', USERS)} AS username, {sql_case('p_partkey % 6', CONFIDENCE)}::DOUBLE AS confidence,
              p_partkey % 6 IN (1, 2, 3, 5) AS is_ambiguous FROM part""",
    ),
    "f7_clean_filepath": (
        lambda t: _part(t).select("k", paths.clean_filepath(F.concat(case(F.col("k") % 6, PATHS), F.when(F.col("k") % 6 != 5, F.col("p_name")).otherwise(""))).alias("path")),
        """SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'src/new/' || p_name WHEN 1 THEN p_name WHEN 2 THEN 'c/x/' || p_name
             WHEN 3 THEN 'src//' || p_name WHEN 4 THEN 'plain/' || p_name END AS path FROM part""",
    ),
    "f23_web_base": (lambda t: _urls(t).select("k", links.web_base(F.col("url")).alias("base")), URLS.strip() + " SELECT k, base FROM b"),
    "f23_source_url": (
        lambda t: _urls(t).select("k", links.source_url(F.col("url"), F.col("provider"), F.col("ref"), F.col("path"), F.col("line")).alias("url")),
        SOURCE_URL.strip(),
    ),
    "f24_normalise_tags": (
        lambda t: _part(t).select("k", F.array_join(scalars.normalise_tags(F.array(
            F.concat(F.lit("  "), "p_name"), F.lit(""), F.col("p_name"), F.repeat(F.lit("x"), F.col("p_size") * 10), F.lit(None).cast("string"), F.lit("core"))), "|").alias("tags")),
        "SELECT p_partkey AS k, p_name || '|' || repeat('x', p_size * 10) || '|core' AS tags FROM part",
    ),
    "f26_clamp": (
        lambda t: t.raw("customer").select(F.col("c_custkey").alias("k"), scalars.clamp(F.col("c_acctbal") / 50).alias("score")),
        "SELECT c_custkey AS k, greatest(0.0, least(100.0, c_acctbal / 50)) AS score FROM customer",
    ),
    "f27_iso_parse_day_string": (
        lambda t: t.commits().select(F.col("sha").cast("long").alias("sha_key"), scalars.iso_parse(F.col("ts_raw")).alias("ts"), scalars.day_of(F.col("ts_raw")).alias("day")),
        oracle("SELECT sha_key, ts, day FROM commits"),
    ),
    "f28_month_ends": (
        lambda t: t.project_repositories().select("id", F.explode(scalars.month_ends(AS_OF, 2)).alias("month_end")),
        oracle("SELECT id, last_day(unnest(generate_series(TIMESTAMP '1999-09-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH))::DATE) AS month_end FROM prs"),
    ),
    "f29_duration_days": (
        lambda t: t.scans().select("id", scalars.duration_days(F.col("started_at"), F.col("completed_at"), F.lit("2001-09-01").cast("timestamp")).alias("days")),
        oracle("SELECT id, (epoch_us(coalesce(completed_at, TIMESTAMP '2001-09-01')) - epoch_us(started_at)) / 86400000000.0::DOUBLE AS days FROM scans"),
    ),
    "f31_json_list": (
        lambda t: t.scans().select("id", F.array_join(scalars.json_list(F.col("frameworks_json")), ",").alias("frameworks"), F.array_join(scalars.json_list(F.col("package_managers_json")), ",").alias("managers")),
        oracle("SELECT id, array_to_string(frameworks, ',') AS frameworks, array_to_string(package_managers, ',') AS managers FROM scans"),
    ),
    "f32_score_class": (
        lambda t: t.scan_scores().groupBy(scalars.score_class(F.col("score")).alias("class")).agg(F.count("*").alias("scores")),
        oracle("SELECT CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'mid' ELSE 'low' END AS class, count(*) AS scores FROM scan_scores GROUP BY ALL"),
    ),
    "f33_requirement_split": (
        lambda t: _part(t).select("k", F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), case(F.col("k") % 4, [" >= ", "==", "~="], " # ")
                                               , F.col("p_size").cast("string"), F.lit(" ")).alias("line")).select(
            "k", scalars.requirement_name(F.col("line")).alias("name"), scalars.requirement_version(F.col("line")).alias("version")),
        """SELECT p_partkey AS k, replace(p_name, ' ', '-') AS name, CASE p_partkey % 4 WHEN 0 THEN '>= ' || p_size WHEN 1 THEN '==' || p_size
             WHEN 2 THEN '~=' || p_size END AS version FROM part""",
    ),
}
