"""Licence strings, licence sources and their precedence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import Tables, case
from ..functions import dims
from ..functions import licensing as ln
from ..operators import licences as li
from ..operators import manifests as ma
from .canonical_sql import oracle, sql_case

# Licence spellings met in manifests; which one a part has follows from its number.
SPELLINGS = [
    "MIT", " mit license ", "(Apache-2.0)", "BSD", "gpl", "MIT OR Apache-2.0", "GPL-2.0-only WITH Classpath-exception",
    "SEE LICENSE IN file.txt", "license in COPYING", "Custom License Text", "X-Own-1.0", "LGPL", "(ISC AND zlib)", "EUPL-1.2",
]
# What each spelling comes to: SPDX id, expression, notes.
EXPECTED = [
    ("MIT", None, None), ("MIT", None, None), ("Apache-2.0", None, None), ("BSD-2-Clause", None, None),
    (None, None, ln.NOTE_AMBIGUOUS[0] + "gpl" + ln.NOTE_AMBIGUOUS[1]), ("MIT", "MIT OR Apache-2.0", ln.NOTE_COMPOUND),
    ("GPL-2.0-only", "GPL-2.0-only WITH Classpath-exception", ln.NOTE_COMPOUND),
    (None, None, ln.NOTE_FILE + "SEE LICENSE IN file.txt"), (None, None, ln.NOTE_FILE + "license in COPYING"),
    (None, None, None), ("X-Own-1.0", None, None), (None, None, ln.NOTE_AMBIGUOUS[0] + "LGPL" + ln.NOTE_AMBIGUOUS[1]),
    ("ISC", "ISC AND zlib", ln.NOTE_COMPOUND), ("EUPL-1.2", None, None),
]
RISK = ["safe", "safe", "safe", "safe", "unknown", "safe", "risky", "unknown", "unknown", "unknown", "unknown", "unknown", "safe", "risky"]
CLASS = [
    "permissive", "permissive", "permissive", "permissive", "unknown", "permissive", "strong_copyleft", "unknown", "unknown",
    "unknown", "unknown", "unknown", "permissive", "weak_copyleft",
]
N = len(SPELLINGS)
TROVE = list(dims.TROVE_LICENSES)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql(values, key: str = f"k % {N + 1}", otherwise: str | None = None) -> str:
    whens = " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values) if v is not None)
    return f"CASE {key} {whens}{f' ELSE {otherwise!r}' if otherwise else ''} END"


def _strings(t: Tables):
    k = F.col("p_partkey")
    return t.raw("part").select(k.alias("k"), case(k % (N + 1), SPELLINGS).alias("raw"))


def _normalised(t: Tables):
    return _strings(t).withColumn("n", ln.normalise_spdx(F.col("raw")))


INFO = f"""
SELECT k, {_sql([e[0] for e in EXPECTED])} AS spdx, {_sql(SPELLINGS)} AS raw, {_sql(RISK, otherwise='unknown')} AS risk,
  {_sql([e[1] for e in EXPECTED])} AS expression, CASE WHEN k % {N + 1} IN (4, 11) THEN 'low' ELSE 'medium' END AS confidence,
  {_sql([e[2] for e in EXPECTED])} AS notes FROM (SELECT p_partkey AS k FROM part)
"""


def licence_trees(t: Tables):
    """A tree per part with one file of every licence source.

    The licence spelling follows from the part's number; npm licence fields come as
    string, list or object.
    """
    k = F.col("p_partkey")
    ks = k.cast("string")
    spelling = F.coalesce(case(k % (N + 1), SPELLINGS), F.lit(""))
    quoted = F.to_json(F.struct(spelling.alias("license")))
    body = F.regexp_extract(quoted, r'^\{"license":(.*)\}$', 1)
    npm_field = (
        F.when(k % 4 == 0, F.concat(F.lit('[{"type": '), body, F.lit('}, "Zlib"]')))
        .when(k % 4 == 1, F.concat(F.lit('{"type": '), body, F.lit("}")))
        .otherwise(body)
    )
    trove = case(k % len(TROVE), TROVE)
    mit = "Permission is hereby granted, free of charge ... without restriction"
    files = {
        "pyproject.toml": F.concat(
            F.lit('[project]\nname = "py'), ks, F.lit('"\n'),
            F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("license = "), body, F.lit("\n"))),
            F.lit('classifiers = ["Topic :: X", "'), trove, F.lit('"]\n')),
        "sub/pom.xml": F.concat(
            F.lit('<project xmlns="http://maven.apache.org/POM/4.0.0"><parent><groupId>org.acme</groupId></parent><artifactId>lib'), ks,
            F.lit("</artifactId><licenses><license><name>"), spelling, F.lit("</name></license></licenses></project>")),
        "vendor/gems/x/x.gemspec": F.concat(F.lit("s.name = 'gem"), ks, F.lit("'\ns.license = \""), spelling, F.lit('"\n')),
        "Gemfile.lock": F.concat(F.lit("GEM\n  remote: x\n  specs:\n    gem"), ks, F.lit(" (1.0)\n    other (2.0)\n      dep (>= 1)\n")),
        "package.json": F.concat(F.lit('{"dependencies": {"npm'), ks, F.lit('": "1"}}')),
        "package-lock.json": F.when(
            k % 2 == 0,
            F.concat(F.lit('{"lockfileVersion": 3, "packages": {"": {}, "node_modules/npm'), ks, F.lit('": {"version": "1.0", "license": '), npm_field,
                     F.lit('}, "node_modules/a/node_modules/deep": {"version": "2", "licence": "ISC"}}}')),
        ).otherwise(
            F.concat(F.lit('{"lockfileVersion": 1, "dependencies": {"npm'), ks, F.lit('": {"version": "1.0", "license": '), npm_field,
                     F.lit(', "dependencies": {"deep": {"version": "2", "licence": "ISC", "dependencies": {"npm'), ks,
                     F.lit('": {"version": "9", "license": "Zlib"}}}}}}}'))),
        "vendor/crate/Cargo.toml": F.concat(F.lit('[package]\nname = "crate'), ks, F.lit('"\nlicense = '), body, F.lit("\n")),
        "vendor/modules.txt": F.concat(F.lit("# example.com/m"), ks, F.lit(" v1.0\n## explicit\nexample.com/m/sub\n# example.com/none v2\n")),
        "vendor/example.com/m/LICENSE.txt": F.lit("unused"),
        ".venv/lib/python3.12/site-packages/x.dist-info/METADATA": F.concat(
            F.lit("Metadata-Version: 2.1\nName: Py_"), ks, F.lit("\nLicense: "), spelling, F.lit("\nClassifier: Topic :: X\n"),
            F.when(k % 2 == 0, F.concat(F.lit("Classifier: "), F.regexp_replace(trove, "^license", "License"), F.lit("\n"))).otherwise(""),
            F.lit("\nName: body\n")),
    }
    listed = [F.struct(F.lit(p).alias("path"), c.alias("content")) for p, c in files.items()]
    licence = F.concat(F.lit("vendor/example.com/m"), ks, F.when(k % 2 == 0, "/LICENSE.md").otherwise("/COPYING"))
    listed.append(F.struct(licence.alias("path"), F.when(k % 5 == 0, "All rights reserved").otherwise(mit).alias("content")))
    return t.raw("part").select(k.alias("repo_id"), F.inline(F.array(*listed))).withColumn(
        "size_bytes", F.length("content").cast("long"))


def _source(build):
    return lambda t: build(licence_trees(t)).select("repo_id", "name", *_fields())


def _fields():
    return [F.col(f"license.{c}").alias(c) for c in ("spdx", "raw", "risk", "expression", "confidence", "source", "notes")]


def _expected(name: str, confidence: str, source: str, raw: str | None = None, table: str = "SELECT p_partkey AS k FROM part") -> str:
    """Rows of a source that normalises the spelling of part k."""
    raw = raw or f"nullif({_sql(SPELLINGS)}, '')"
    return f"""SELECT k AS repo_id, {name} AS name, {_sql([e[0] for e in EXPECTED])} AS spdx, {raw} AS raw, {_sql(RISK, otherwise='unknown')} AS risk,
      {_sql([e[1] for e in EXPECTED])} AS expression, CASE WHEN k % {N + 1} IN (4, 11) THEN 'low' ELSE '{confidence}' END AS confidence,
      '{source}' AS source, {_sql([e[2] for e in EXPECTED])} AS notes FROM ({table})"""


EMPTY_RAW = f"coalesce({_sql(SPELLINGS)}, '')"
TROVE_SPDX = _sql(list(dims.TROVE_LICENSES.values()), f"k % {len(TROVE)}")


def _risk_of(spdx: str) -> str:
    safe = ", ".join(f"'{s}'" for s in dims.SAFE_LICENSES)
    return f"CASE WHEN regexp_matches({spdx}, '^(GPL-|AGPL-|LGPL-|EUPL-|OSL-|CPAL-|RPSL-)') THEN 'risky' WHEN {spdx} IN ({safe}) THEN 'safe' ELSE 'unknown' END"


def _trove_rows(name: str, raw: str, source: str, where: str) -> str:
    return f"""SELECT k AS repo_id, {name} AS name, {TROVE_SPDX} AS spdx, {raw} AS raw, {_risk_of(TROVE_SPDX)} AS risk, NULL AS expression,
      'high' AS confidence, '{source}' AS source, NULL AS notes FROM (SELECT p_partkey AS k FROM part) WHERE {where}"""


PYPROJECT = f"""
{_trove_rows("'py' || k", _sql(TROVE, f'k % {len(TROVE)}'), 'manifest', f'k % 3 = 0 OR k % {N + 1} = {N}')}
UNION ALL {_expected("'py' || k", 'medium', 'manifest')} WHERE k % 3 <> 0 AND k % {N + 1} <> {N}
"""
POMS = _expected("'org.acme:lib' || k", "medium", "manifest", f"coalesce({_sql(SPELLINGS)}, '')")
GEM_LOCK = f"""SELECT k AS repo_id, unnest(['gem' || k, 'other']) AS name, NULL::VARCHAR AS spdx, NULL::VARCHAR AS raw, 'unknown' AS risk, NULL::VARCHAR AS expression,
  'unknown' AS confidence, 'lockfile' AS source, '{li.GEM_LOCK_NOTE}' AS notes FROM (SELECT p_partkey AS k FROM part)"""
GEMSPEC = _expected("'gem' || k", "medium", "vendor_gemspec")
# A list of two licences is a compound expression whose first part is looked up.
NPM_LIST = f"CASE WHEN k % 4 = 0 THEN {EMPTY_RAW} || ' OR Zlib' ELSE nullif({_sql(SPELLINGS)}, '') END"
CRATES = _expected("'crate' || k", "high", "vendor_manifest", EMPTY_RAW)
GO = """SELECT p_partkey AS repo_id, 'example.com/m' || p_partkey AS name, CASE WHEN p_partkey % 5 <> 0 THEN 'MIT' END AS spdx, NULL::VARCHAR AS raw,
  CASE WHEN p_partkey % 5 <> 0 THEN 'safe' ELSE 'unknown' END AS risk, NULL::VARCHAR AS expression, 'medium' AS confidence, 'license_file' AS source, NULL::VARCHAR AS notes FROM part"""
DIST = f"""
{_trove_rows("'py-' || k", f"trim({EMPTY_RAW})", 'dist_info', 'k % 2 = 0')}
UNION ALL {_expected("'py-' || k", 'high', 'dist_info', f"trim({EMPTY_RAW})")} WHERE k % 2 <> 0
"""


def _lookup_inputs(t: Tables):
    """Dependencies of orders and a licence table for parts, keyed by name and ecosystem."""
    deps = t.dependencies().select(
        F.col("scan_id").alias("repo_id"), "name", "version", F.lit("pip").alias("ecosystem"), "is_private", F.lit(True).alias("is_direct"))
    spdx = F.when(F.col("p_size") % 2 == 0, "MIT").otherwise("GPL-3.0-only")
    names = t.lines().select(F.col("l_orderkey").alias("repo_id"), F.col("p_name").alias("name"), F.lit("pip").alias("ecosystem"), "p_size").filter(
        F.col("name").startswith("r")).groupBy("repo_id", "name", "ecosystem").agg(F.min("p_size").alias("p_size"))
    licences = names.select(
        "repo_id", "name", "ecosystem", ln.known_license(spdx, spdx, "high", "dist_info").alias("license"), (F.col("p_size") % 3 != 0).alias("is_direct"))
    return deps, licences


LOOKUP = """
WITH lic AS (SELECT l_orderkey AS repo_id, p_name AS name, min(p_size) AS size FROM lines WHERE starts_with(p_name, 'r') GROUP BY ALL)
SELECT d.scan_id AS repo_id, d.name, version, 'pip' AS ecosystem, is_private, coalesce(size % 3 <> 0, true) AS is_direct,
  CASE WHEN size % 2 = 0 THEN 'MIT' WHEN size IS NOT NULL THEN 'GPL-3.0-only' END AS license_spdx,
  CASE WHEN size % 2 = 0 THEN 'safe' WHEN size IS NOT NULL THEN 'risky' ELSE 'unknown' END AS license_risk,
  CASE WHEN size IS NOT NULL THEN 'high' ELSE 'unknown' END AS license_confidence, CASE WHEN size IS NOT NULL THEN 'dist_info' END AS license_source,
  CASE WHEN size IS NULL AND is_private THEN 'Private/internal package' END AS license_notes
FROM dependencies d LEFT JOIN lic ON lic.repo_id = d.scan_id AND lic.name = d.name
"""
ECOSYSTEMS = ["pip", "cargo", "bundler", "maven", "npm", "go"]


def _registry(t: Tables):
    """Registry answers per part name; versions matter for maven only."""
    p = t.raw("part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    k = F.col("k")
    eco = F.explode(F.array(*[F.lit(e) for e in ECOSYSTEMS[:5]]))
    return p.select(eco.alias("ecosystem"), "k", "p_name").select(
        "ecosystem",
        F.when(F.col("ecosystem") == "maven", F.concat(F.lit("g:"), "p_name")).otherwise(F.col("p_name")).alias("name"),
        F.lit("7").alias("version"),
        F.when(k % 2 == 0, "MIT").otherwise("gpl").alias("license_raw"),
        F.when(k % 3 == 0, F.array(F.lit("License :: OSI Approved :: ISC License (ISCL)"))).otherwise(F.array().cast("array<string>")).alias("classifiers"),
        F.when(k % 5 == 0, F.array(F.lit("MIT"), F.lit("Ruby"))).otherwise(F.array(F.lit("ISC"))).alias("licenses"),
    )


def _registry_deps(t: Tables):
    eco = case(F.col("l_suppkey") % 6, ECOSYSTEMS)
    rows = t.lines().withColumn("ecosystem", eco)
    unknown = F.col("l_returnflag") != "A"
    null = F.lit(None).cast("string")
    return rows.select(
        F.col("l_orderkey").alias("repo_id"),
        F.when(F.col("ecosystem") == "maven", F.concat(F.lit("g:"), "p_name")).otherwise(F.col("p_name")).alias("name"),
        (F.col("p_size") % 10).cast("string").alias("version"), "ecosystem",
        (F.col("p_size") % 11 == 0).alias("is_private"), (F.col("l_linestatus") == "O").alias("is_direct"),
        F.when(~unknown, "MIT").alias("license_spdx"), null.alias("license_raw"),
        F.when(unknown, "unknown").otherwise("safe").alias("license_risk"), null.alias("license_expression"),
        F.lit("unknown").alias("license_confidence"), null.alias("license_source"), null.alias("license_notes"))


REGISTRY = f"""
WITH reg AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY ALL),
deps AS (SELECT l_orderkey AS repo_id, p_name, p_size % 10 AS v, {sql_case('l_suppkey % 6', ECOSYSTEMS)} AS ecosystem, p_size % 11 = 0 AS is_private,
  l_linestatus = 'O' AS is_direct, l_returnflag <> 'A' AS unknown FROM lines),
j AS (SELECT d.*, k, unknown AND NOT is_private AND ecosystem <> 'go' AND (ecosystem <> 'maven' OR v = 7) AS hit,
  ecosystem = 'pip' AND k % 3 = 0 AS trove, ecosystem = 'bundler' AS gem FROM deps d JOIN reg USING (p_name))
SELECT repo_id, CASE WHEN ecosystem = 'maven' THEN 'g:' || p_name ELSE p_name END AS name, v::VARCHAR AS version, ecosystem, is_private, is_direct,
  CASE WHEN NOT hit THEN CASE WHEN NOT unknown THEN 'MIT' END WHEN trove THEN 'ISC' WHEN gem THEN CASE WHEN k % 5 = 0 THEN 'MIT' ELSE 'ISC' END
       WHEN k % 2 = 0 THEN 'MIT' END AS license_spdx,
  CASE WHEN NOT hit THEN NULL WHEN gem THEN CASE WHEN k % 5 = 0 THEN 'MIT OR Ruby' ELSE 'ISC' END WHEN k % 2 = 0 THEN 'MIT' ELSE 'gpl' END AS license_raw,
  CASE WHEN NOT hit THEN CASE WHEN unknown THEN 'unknown' ELSE 'safe' END WHEN trove OR gem OR k % 2 = 0 THEN 'safe' ELSE 'unknown' END AS license_risk,
  CASE WHEN hit AND gem AND k % 5 = 0 THEN 'MIT OR Ruby' END AS license_expression,
  CASE WHEN hit THEN 'high' ELSE 'unknown' END AS license_confidence, CASE WHEN hit THEN 'api_enrichment' END AS license_source,
  CASE WHEN hit AND gem AND k % 5 = 0 THEN 'Dual-licensed gem' WHEN hit AND NOT gem AND NOT trove AND k % 2 <> 0
    THEN {quoted(ln.NOTE_AMBIGUOUS[0] + 'gpl' + ln.NOTE_AMBIGUOUS[1])} END AS license_notes
FROM j
"""

QUERIES = {
    "f16_normalise_spdx": (
        lambda t: _normalised(t).select("k", "raw", "n.spdx", "n.expression", "n.notes"),
        (f"SELECT k, raw, spdx, expression, notes FROM ({INFO})"),
    ),
    "f17_classify_risk": (
        lambda t: _normalised(t).select("k", ln.classify_risk(F.col("n.spdx")).alias("risk")), (f"SELECT k, risk FROM ({INFO})"),
    ),
    "f18_classify_license": (
        lambda t: _normalised(t).select("k", ln.classify_license(F.col("n.spdx")).alias("class")),
        f"SELECT k, {_sql(CLASS, otherwise='unknown')} AS class FROM (SELECT p_partkey AS k FROM part)",
    ),
    "f20_license_info": (
        lambda t: _strings(t).select("k", ln.license_info(F.col("raw"), "medium", "manifest").alias("i")).select(
            "k", "i.spdx", "i.raw", "i.risk", "i.expression", "i.confidence", "i.notes"),
        (INFO),
    ),
    "f21_trove_to_spdx": (
        lambda t: t.raw("part").select(F.col("p_partkey").alias("k"), ln.trove_to_spdx(F.concat(F.lit(" "), F.initcap(case(F.col("p_partkey") % (len(TROVE) + 1), TROVE)))).alias("spdx")),
        f"SELECT k, {_sql(list(dims.TROVE_LICENSES.values()), f'k % {len(TROVE) + 1}')} AS spdx FROM (SELECT p_partkey AS k FROM part)",
    ),
    "f22_license_field_text": (
        lambda t: t.raw("part").select(
            F.col("p_partkey").alias("k"),
            ln.license_field_text(F.concat(
                case(F.col("p_partkey") % 4, ['["', '{"name": "', '{"type": "']), F.col("p_brand"),
                case(F.col("p_partkey") % 4, ['", {"type": "ISC"}]', '"}', '", "url": "u"}']))).alias("license")),
        """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_brand || ' OR ISC' WHEN 3 THEN NULL ELSE p_brand END AS license FROM part""",
    ),
    "l1_pyproject_license": (_source(li.pyproject_license), (PYPROJECT)),
    "l2_pom_licenses": (_source(li.pom_licenses), POMS),
    "l3_gemfile_lock": (_source(li.gemfile_lock_placeholders), GEM_LOCK),
    "l4_gemspec_licenses": (_source(li.gemspec_licenses), (GEMSPEC)),
    "l5_npm_lock_licenses": (
        lambda t: li.license_precedence(li.npm_lock_licenses(licence_trees(t))).select("repo_id", "name", "license.raw", "license.source", "is_direct"),
        f"""SELECT k AS repo_id, 'npm' || k AS name, {NPM_LIST} AS raw, 'lockfile' AS source, true AS is_direct FROM (SELECT p_partkey AS k FROM part)
            UNION ALL SELECT p_partkey, 'deep', 'ISC', 'lockfile', false FROM part""",
    ),
    "l6_cargo_vendor_licenses": (_source(li.cargo_vendor_licenses), (CRATES)),
    "l7_go_vendor_licenses": (_source(li.go_vendor_licenses), GO),
    "l8_dist_info_licenses": (_source(li.dist_info_licenses), (DIST)),
    "w9_license_precedence": (
        lambda t: li.repository_licenses(li.license_files(licence_trees(t))).select("repo_id", "name", "ecosystem", "license.source"),
        """SELECT p_partkey AS repo_id, unnest(['py' || p_partkey, 'py-' || p_partkey, 'org.acme:lib' || p_partkey, 'gem' || p_partkey, 'other',
             'npm' || p_partkey, 'deep', 'crate' || p_partkey, 'example.com/m' || p_partkey]) AS name,
             unnest(['pip', 'pip', 'maven', 'bundler', 'bundler', 'npm', 'npm', 'cargo', 'go']) AS ecosystem,
             unnest(['manifest', 'dist_info', 'manifest', 'vendor_gemspec', 'lockfile', 'lockfile', 'lockfile', 'vendor_manifest', 'license_file']) AS source FROM part""",
    ),
    "j12_license_lookup": (
        lambda t: li.license_lookup(*_lookup_inputs(t)).drop("license_raw", "license_expression"), oracle(LOOKUP),
    ),
    "l9_placeholders": (
        lambda t: li.license_lookup(*_lookup_inputs(t)).filter(F.col("license_confidence") == "unknown").select("repo_id", "name", "license_risk", "license_notes"),
        oracle(LOOKUP.replace("SELECT d.scan_id", "SELECT repo_id, name, license_risk, license_notes FROM (SELECT d.scan_id") + ") WHERE license_confidence = 'unknown'"),
    ),
    "j14_registry_fallback": (
        lambda t: li.registry_fallback(_registry_deps(t), _registry(t)), oracle((REGISTRY)),
    ),
    "l10_registry_licenses": (
        lambda t: _registry(t).select("ecosystem", "name", li.registry_license().alias("l")).select("ecosystem", "name", "l.spdx", "l.raw", "l.notes"),
        (f"""WITH reg AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY ALL), e AS (SELECT *, unnest(['pip', 'cargo', 'bundler', 'maven', 'npm']) AS ecosystem FROM reg)
            SELECT ecosystem, CASE WHEN ecosystem = 'maven' THEN 'g:' || p_name ELSE p_name END AS name,
              CASE WHEN ecosystem = 'pip' AND k % 3 = 0 THEN 'ISC' WHEN ecosystem = 'bundler' THEN CASE WHEN k % 5 = 0 THEN 'MIT' ELSE 'ISC' END WHEN k % 2 = 0 THEN 'MIT' END AS spdx,
              CASE WHEN ecosystem = 'bundler' THEN CASE WHEN k % 5 = 0 THEN 'MIT OR Ruby' ELSE 'ISC' END WHEN k % 2 = 0 THEN 'MIT' ELSE 'gpl' END AS raw,
              CASE WHEN ecosystem = 'bundler' THEN CASE WHEN k % 5 = 0 THEN 'Dual-licensed gem' END WHEN k % 2 = 0 OR (ecosystem = 'pip' AND k % 3 = 0) THEN NULL
                ELSE {quoted(ln.NOTE_AMBIGUOUS[0] + 'gpl' + ln.NOTE_AMBIGUOUS[1])} END AS notes FROM e"""),
    ),
}
