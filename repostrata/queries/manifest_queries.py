"""Manifests and lockfiles written from order lines, read back by the dependency job.

Every order becomes a tree whose manifests list its parts; the SQL states the
expected packages straight from the order lines, without any text in between.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..bindings import Tables
from ..operators import manifests as ma
from .canonical_sql import oracle

A, N, R = "A", "N", "R"


def _items(t: Tables) -> DataFrame:
    """One row per order and part; `flag` decides the section it is listed in.

    Lines are dealt by order, which serves this grouping and the one of the trees.
    """
    return t.lines().select("l_orderkey", "l_partkey", "qty", "l_returnflag").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("repo_id"), "l_partkey").agg(
        F.min("qty").alias("qty"), F.min("l_returnflag").alias("flag")
    ).select(
        "repo_id", "flag", F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("name"),
        F.concat(F.col("qty").cast("string"), F.lit(".0")).alias("v"),
    )


ITEMS = """
WITH items AS (SELECT l_orderkey AS repo_id, l_partkey, 'n' || l_partkey AS name, min(qty) || '.0' AS v, min(l_returnflag) AS flag FROM lines GROUP BY ALL)
"""


def _fill(template: str, item: Column) -> Column:
    """A line with {n} and {v} replaced by name and version; null without either."""
    pieces = [x for x in re.split(r"(\{[nv]\})", template) if x]
    line = F.concat(*[item["name"] if x == "{n}" else item["v"] if x == "{v}" else F.lit(x) for x in pieces])
    return F.when(item["name"].isNotNull() & item["v"].isNotNull(), line)


class Part:
    """Lines for the packages of some flags, joined by a separator."""

    def __init__(self, flags: str, template: str, sep: str = ""):
        self.flags, self.template, self.sep = flags, template, sep


# Per file: literal text and package lines, in order.
FILES: dict[str, list] = {
    "package.json": [
        '{"name": "x", "dependencies": {', Part(A, '"{n}": "^{v}"', ","), '}, "devDependencies": {', Part(N, '"{n}": "^{v}"', ","),
        '}, "optionalDependencies": {', Part(R, '"{n}": "^{v}"', ","), "}}",
    ],
    "requirements.txt": ["# base\n-r other.txt\n\n", Part(A, "{n}=={v}\n"), Part(R, "  {n}\n")],
    "requirements-dev.txt": [Part(N, "{n} >={v},<99 \n")],
    "pyproject.toml": [
        '[project]\nname = "x"\ndependencies = [', Part(R, '"{n}>={v}"', ","), ']\n[tool.poetry.dependencies]\npython = "^3.12"\n',
        Part(A, '{n} = "{v}"\n'), "[tool.poetry.group.dev.dependencies]\n", Part(N, '{n} = {version = "{v}"}\n'),
    ],
    "go.mod": [
        "module x\n\ngo 1.22\n\nrequire (\n", Part(A, "\t{n} v{v}\n"), Part(N, "\t{n} v{v} // indirect\n"), ")\n\n", Part(R, "require {n} v{v}\n"),
    ],
    "Cargo.toml": [
        '[package]\nname = "x"\n[dependencies]\n', Part(A, '{n} = "{v}"\n'), "[dev-dependencies]\n",
        Part(N, '{n} = { version = "{v}", features = ["a"] }\n'), "[build-dependencies]\n", Part(R, '{n} = { path = "../{n}" }\n'),
    ],
    "pom.xml": [
        '<?xml version="1.0"?>\n<project xmlns="http://maven.apache.org/POM/4.0.0"><!-- <dependency><groupId>no</groupId></dependency> --><dependencies>',
        Part(A, "<dependency><groupId>g</groupId><artifactId>{n}</artifactId><version>{v}</version></dependency>"),
        Part(N, "<dependency><groupId>g</groupId><artifactId>{n}</artifactId><version>{v}</version><scope>test</scope><exclusions><exclusion><groupId>e</groupId></exclusion></exclusions></dependency>"),
        Part(R, "<dependency><groupId>g</groupId><artifactId>{n}</artifactId><scope>provided</scope><optional>true</optional></dependency>"),
        "</dependencies></project>",
    ],
    "Gemfile": [
        "source 'https://rubygems.org'\n", Part(A, "gem '{n}', '{v}'\n"), "group :development, :ci do\n", Part(N, '  gem "{n}", "{v}"\n'), "end\n", Part(R, "gem '{n}'\n"),
    ],
    "src/app.csproj": [
        '<Project Sdk="x"><ItemGroup>', Part(A, '<PackageReference Include="{n}" Version="{v}" />'),
        Part(N, '<PackageReference Include="{n}"><Version>{v}</Version><PrivateAssets>All</PrivateAssets></PackageReference>'),
        Part(R, '<PackageReference Update="{n}" />'), "</ItemGroup></Project>",
    ],
    "composer.json": [
        '{"require": {"php": ">=8"', Part(A, ', "{n}": "{v}"'), Part(R, ', "ext-{n}": "*"'), '}, "require-dev": {', Part(N, '"{n}": "{v}"', ","), "}}",
    ],
    "yarn.lock": [
        "# yarn lockfile v1\n\n\n", Part(A, '{n}@^1, {n}@^2:\n  version "{v}"\n  resolved "u"\n\n'),
        Part(N, '"{n}@^1":\n  version "{v}"\n  dependencies:\n    x "^1"\n\n'), Part(R, '"@s/{n}@^1":\n  version "{v}"\n\n'),
    ],
    "pnpm-lock.yaml": [
        "lockfileVersion: '6.0'\n\nimporters:\n\n  .:\n    dependencies:\n", Part(A, "      {n}:\n        specifier: ^1\n        version: {v}\n"),
        "    devDependencies:\n", Part(N, "      {n}:\n        specifier: ^1\n        version: {v}\n"), "\npackages:\n\n",
        Part(A, "  /{n}/{v}:\n    resolution: {integrity: x}\n    dev: false\n\n"), Part(N, "  {n}@{v}:\n    resolution: {integrity: x}\n    dev: true\n\n"),
        Part(R, "  /@s/{n}/{v}:\n    resolution: {integrity: x}\n\n"),
    ],
    "poetry.lock": [
        Part(A, '[[package]]\nname = "{n}"\nversion = "{v}"\n\n'), Part(N, '[[package]]\nname = "{n}"\nversion = "{v}"\ncategory = "dev"\n\n'),
        Part(R, '[[package]]\nname = "{n}"\nversion = "{v}"\noptional = true\n[package.dependencies]\nx = "*"\n\n'), '[metadata]\nlock-version = "2.0"\n',
    ],
    "Pipfile.lock": [
        '{"_meta": {}, "default": {"certifi": {"version": "==1.0"}', Part(A, ', "{n}": {"version": "=={v}"}'), Part(R, ', "{n}": {"git": "u"}'),
        '}, "develop": {', Part(N, '"{n}": {"version": "=={v}"}', ","), "}}",
    ],
    "Cargo.lock": ["version = 3\n", Part(A + N + R, '[[package]]\nname = "{n}"\nversion = "{v}"\n\n')],
    "Gemfile.lock": [
        "PATH\n  remote: .\n  specs:\n", Part(R, "    {n} ({v})\n"), "\nGEM\n  remote: https://rubygems.org/\n  specs:\n",
        Part(A + N, "    {n} ({v})\n      dep (>= 1.0)\n"), "\nPLATFORMS\n  ruby\n\nDEPENDENCIES\n", Part(A, "  {n}\n"),
    ],
    "composer.lock": [
        '{"packages": [{"version": "1"}', Part(A + R, ', {"name": "{n}", "version": "{v}"}'), '], "packages-dev": [', Part(N, '{"name": "{n}", "version": "{v}"}', ","), "]}",
    ],
    "go.sum": [Part(A + N + R, "{n} v{v} h1:x=\n{n} v{v}/go.mod h1:y=\n")],
}
LOCK_V3 = [
    '{"lockfileVersion": 3, "packages": {"": {"name": "x"}, "node_modules/parent": {"version": "1"}', Part(A, ', "node_modules/{n}": {"version": "{v}"}'),
    Part(N, ', "node_modules/{n}": {"version": "{v}", "dev": true}'), Part(R, ', "node_modules/parent/node_modules/{n}": {"version": "{v}"}'), "}}",
]
LOCK_V1 = [
    '{"lockfileVersion": 1, "dependencies": {"parent": {"version": "1", "dependencies": {', Part(R, '"{n}": {"version": "{v}"}', ","), "}}",
    Part(A, ', "{n}": {"version": "{v}"}'), Part(N, ', "{n}": {"version": "{v}", "dev": true}'), "}}",
]


def _listed(part: Part) -> Column:
    """The lines of a part, from the collected packages of an order."""
    own = F.filter("items", lambda p: p["flag"].isin(*part.flags))
    return F.transform(own, lambda p: _fill(part.template, p))


def manifest_trees(t: Tables, *names: str) -> DataFrame:
    """(repo_id, path, content) with the named files of every order.

    The packages of an order are collected once, a handful each; the texts are written from
    them afterwards, so none of them is shuffled.
    """
    layouts = {n: FILES[n] for n in names if n != "package-lock.json"}
    if "package-lock.json" in names:
        layouts |= {"lock3": LOCK_V3, "lock1": LOCK_V1}
    contents = []
    for name, pieces in layouts.items():
        joined = [F.lit(p) if isinstance(p, str) else F.array_join(_listed(p), p.sep) for p in pieces]
        path = F.lit("package-lock.json" if name.startswith("lock") else name)
        row = F.struct(path.alias("path"), F.concat(*joined).alias("content"))
        even = F.col("repo_id") % 2 == 0
        contents.append(F.when(even, row) if name == "lock3" else F.when(~even, row) if name == "lock1" else row)
    items = _items(t).groupBy("repo_id").agg(F.collect_list(F.struct("flag", "name", "v")).alias("items"))
    trees = items.select("repo_id", F.array(*contents).alias("files"))
    return trees.select("repo_id", F.inline_outer(F.filter("files", lambda f: f.isNotNull()))).filter(F.col("path").isNotNull())


OUT = ["repo_id", "name", "version", "dep_type", "is_direct", "is_optional"]


def _read(build, *files: str):
    return lambda t: build(manifest_trees(t, *files)).select(*OUT)


def _expect(prod: str, dev: str, other: str, extra: str = "") -> str:
    """Rows for the three flags; each is 'name, version, type, direct, optional' or '' for none."""
    parts = [
        f"SELECT repo_id, {row[0]} AS name, {row[1]} AS version, {row[2]} AS dep_type, {row[3]} AS is_direct, "
        f"{row[4]} AS is_optional FROM items WHERE flag = '{flag}'"
        for flag, spec in ((A, prod), (N, dev), (R, other)) if spec
        for row in [[c.strip() for c in spec.split(";")]]
    ]
    return ITEMS + " UNION ALL ".join(parts) + (f" UNION ALL {extra}" if extra else "")


NONE = "NULL::VARCHAR"
PROD = "name; v; 'prod'; true; false"
DEV = "name; v; 'dev'; true; false"
LOCKS = {
    "prod": "name; v; 'prod'; true; false", "dev": "name; v; 'dev'; false; false", "other": "name; v; 'prod'; false; false",
}
PARENT = "SELECT DISTINCT repo_id, 'parent', '1', 'prod', false, false FROM items"


def _case(key: str, build, files: list[str], *expected: str):
    return key, (_read(build, *files), oracle(_expect(*expected), "lines"))


QUERIES = dict([
    _case("m1_package_json", ma.package_json, ["package.json"], "name; '^' || v; 'prod'; true; false", "name; '^' || v; 'dev'; true; false", "name; '^' || v; 'prod'; true; true"),
    _case("m2_requirements", ma.requirements, ["requirements.txt", "requirements-dev.txt"], "name; '==' || v; 'prod'; true; false", "name; '>=' || v || ',<99'; 'dev'; true; false", f"name; {NONE}; 'prod'; true; false"),
    _case("m3_pyproject", ma.pyproject, ["pyproject.toml"], PROD, DEV, "name; '>=' || v; 'prod'; true; false"),
    _case("m4_go_mod", ma.go_mod, ["go.mod"], "name; 'v' || v; 'prod'; true; false", "name; 'v' || v; 'prod'; false; false", "name; 'v' || v; 'prod'; true; false"),
    _case("m4_go_mod_strict_compat", lambda f: ma.go_mod(f, strict_compat=True), ["go.mod"], *["name; 'v' || v; 'prod'; true; false"] * 3),
    _case("m5_cargo_toml", ma.cargo_toml, ["Cargo.toml"], PROD, DEV, f"name; {NONE}; 'prod'; true; false"),
    _case("m6_pom_xml", ma.pom_xml, ["pom.xml"], "'g:' || name; v; 'prod'; true; false", "'g:' || name; v; 'test'; true; false", f"'g:' || name; {NONE}; 'dev'; true; true"),
    _case("m7_gemfile", ma.gemfile, ["Gemfile"], PROD, DEV, f"name; {NONE}; 'prod'; true; false"),
    _case("m8_nuget", ma.nuget, ["src/app.csproj"], PROD, DEV, f"name; {NONE}; 'prod'; true; false"),
    _case("m9_composer_json", ma.composer_json, ["composer.json"], PROD, DEV, ""),
    _case("m10_package_lock", ma.package_lock, ["package-lock.json", "package.json"], PROD, DEV, LOCKS["other"], PARENT),
    _case("m11_yarn_lock", ma.yarn_lock, ["yarn.lock", "package.json"], PROD, DEV, "'@s/' || name; v; 'prod'; false; false", "SELECT repo_id, name, v, 'prod', true, false FROM items WHERE flag = 'A'"),
    _case("m12_pnpm_lock", ma.pnpm_lock, ["pnpm-lock.yaml"], PROD, DEV, "'@s/' || name; v; 'prod'; false; false"),
    _case("m13_poetry_lock", ma.poetry_lock, ["poetry.lock"], PROD, DEV, "name; v; 'prod'; true; true"),
    _case("m14_pipfile_lock", ma.pipfile_lock, ["Pipfile.lock"], PROD, DEV, f"name; {NONE}; 'prod'; true; false", "SELECT DISTINCT repo_id, 'certifi', '1.0', 'prod', true, false FROM items"),
    _case("m15_cargo_lock", ma.cargo_lock, ["Cargo.lock"], PROD, PROD, PROD),
    _case("m16_gemfile_lock", ma.gemfile_lock, ["Gemfile.lock"], PROD, PROD, PROD),
    _case("m17_composer_lock", ma.composer_lock, ["composer.lock"], PROD, DEV, PROD),
    _case("m18_go_sum", ma.go_sum, ["go.sum"], *["name; 'v' || v; 'prod'; true; false"] * 3),
    _case("w10_go_sum_distinct", lambda f: ma.go_sum(f).dropDuplicates(["repo_id", "name", "version"]), ["go.sum"], *["name; 'v' || v; 'prod'; true; false"] * 3),
    _case("w8_gemfile_blocks", ma.gemfile, ["Gemfile"], PROD, DEV, f"name; {NONE}; 'prod'; true; false"),
    _case("j13_direct_flag", lambda f: ma.package_lock(f).filter("is_direct"), ["package-lock.json", "package.json"], PROD, DEV, ""),
]) | {
    "w2_dedup_dependencies": (
        lambda t: ma.dependencies(manifest_trees(t, "package.json", "package-lock.json", "yarn.lock", "requirements.txt")).select(
            "repo_id", "name", "ecosystem", "version", "manifest_file", "discovery_mode", "package_manager", "dep_type", "is_direct"),
        oracle(ITEMS + """
            SELECT repo_id, name, 'npm' AS ecosystem, v AS version, 'package-lock.json' AS manifest_file, 'locked' AS discovery_mode, 'npm' AS package_manager,
              CASE flag WHEN 'N' THEN 'dev' ELSE 'prod' END AS dep_type, flag <> 'R' AS is_direct FROM items
            UNION ALL SELECT DISTINCT repo_id, 'parent', 'npm', '1', 'package-lock.json', 'locked', 'npm', 'prod', false FROM items
            UNION ALL SELECT repo_id, '@s/' || name, 'npm', v, 'yarn.lock', 'locked', 'yarn', 'prod', false FROM items WHERE flag = 'R'
            UNION ALL SELECT repo_id, name, 'pip', CASE flag WHEN 'A' THEN '==' || v END, 'requirements.txt', 'declared_only', NULL, 'prod', true FROM items WHERE flag <> 'N'""", "lines"),
    ),
    "u1_all_dependencies": (
        lambda t: ma.all_dependencies(ma.manifest_files(manifest_trees(t, *FILES, "package-lock.json"))).groupBy("ecosystem", "manifest_file", "discovery_mode").agg(
            F.count("*").alias("entries"), F.count_distinct("repo_id").alias("repositories")),
        oracle(ITEMS + ", f(ecosystem, manifest_file, discovery_mode, flags) AS (VALUES " + ", ".join(
            f"('{e}', '{m}', '{d}', '{fl}')" for e, m, d, fl in [
                ("npm", "package.json", "declared_only", "ANR"), ("pip", "requirements.txt", "declared_only", "AR"), ("pip", "requirements-dev.txt", "declared_only", "N"),
                ("pip", "pyproject.toml", "declared_only", "ANR"), ("go", "go.mod", "declared_only", "ANR"), ("cargo", "Cargo.toml", "declared_only", "ANR"),
                ("maven", "pom.xml", "declared_only", "ANR"), ("bundler", "Gemfile", "declared_only", "ANR"), ("nuget", "src/app.csproj", "declared_only", "ANR"),
                ("composer", "composer.json", "declared_only", "AN"), ("npm", "package-lock.json", "locked", "ANRP"), ("npm", "yarn.lock", "locked", "AANR"),
                ("npm", "pnpm-lock.yaml", "locked", "ANR"), ("pip", "poetry.lock", "locked", "ANR"), ("pip", "Pipfile.lock", "locked", "ANRP"),
                ("cargo", "Cargo.lock", "locked", "ANR"), ("bundler", "Gemfile.lock", "locked", "ANR"), ("composer", "composer.lock", "locked", "ANR"),
                ("go", "go.sum", "locked", "ANR")]) + """)
            SELECT ecosystem, manifest_file, discovery_mode, count(*) AS entries, count(DISTINCT repo_id) AS repositories FROM (
              SELECT f.*, repo_id FROM f JOIN items ON contains(flags, flag)
              UNION ALL SELECT f.*, repo_id FROM f JOIN items ON flags = 'AANR' AND flag = 'A'
              UNION ALL SELECT DISTINCT f.*, repo_id FROM f JOIN items ON contains(flags, 'P')) GROUP BY ALL""", "lines"),
    ),
}
