"""Sources, manifests, writers, rules and the whole profile on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from repostrata.operators import complexity, contributions, files as fl, licences, manifests, merges, risks, scores, stack
from repostrata.plans import portfolio, profile
from repostrata.sources import files as src, history, tables
from repostrata.operators import inventory

MARK = history.COMMIT_MARK


def block(sha, name, mail, ts, *changes):
    return f"{MARK}\n{sha}\n{name}\n{mail}\n{ts}\n\n" + "".join(c + "\n" for c in changes)


LOG = (
    block("a" * 40, "Ann Lee", "", "2024-03-01T23:30:00-05:00", "10\t2\tsrc/a.py", "-\t-\tsrc/x.png", "1\t1\tdist/o.js")
    + block("b" * 40, "Ann Lee", "", "2024-02-01T10:00:00+00:00", "5\t0\tsrc/a.py", "5\t0\tsrc/a.py", "x\t1\tbad")
    + block("abc", "Short Sha", "", "2024-02-01T10:00:00+00:00")
    + block("c" * 40, "No Time", "", "whenever")
    + block("d" * 40, "Bob", "bob.ray@x.org", "2023-01-01T00:00:00+00:00", "7\t1\tlib/{a => b}/c.go")
)


@pytest.fixture
def commits(spark, tmp_path):
    (tmp_path / "repo1.log").write_text(LOG)
    return history.parse_log(history.read_log_text(spark, str(tmp_path)))


def test_log(commits):
    rows = commits.orderBy("seq").collect()
    assert [r["sha"][0] for r in rows] == ["a", "b", "d"]
    assert rows[0]["repo_id"] == "repo1"
    assert [c["path"] for c in rows[0]["file_changes"]] == ["src/a.py", "src/x.png"]
    assert rows[2]["file_changes"][0]["path"] == "lib/b/c.go" and rows[2]["file_changes"][0]["language"] == "Go"
    assert [r["sha"][0] for r in history.history_limit(commits, 2).orderBy("seq").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        history.history_limit(commits, -1)


def test_contributions(commits):
    named = contributions.with_identity(commits)
    rows = {r["username"]: r for r in contributions.contributions(named).collect()}
    ann = rows["a_lee"]
    assert (ann["commit_count"], ann["insertions"], ann["files_changed"], ann["active_days"]) == (2, 20, 3, 2)
    assert rows["b_ray"]["confidence"] == 0.9
    days = {str(r["commit_date"]) for r in contributions.repo_daily(named).collect()}
    assert "2024-03-01" in days
    langs = {(r["username"], r["language"]): r for r in contributions.language_contributions(named).collect()}
    assert langs[("a_lee", "Python")]["files_changed"] == 3 and langs[("a_lee", "Python")]["percentage"] == 100.0


def test_overrides(spark, commits):
    overrides = spark.createDataFrame(
        [(1, 9, " ANN LEE ", None, "first"), (2, 9, "ann lee", "", "second"), (3, 9, "", "Bob.Ray@x.org", "bobby")],
        "id long, project_id long, raw_name string, raw_email string, canonical_username string")
    named = contributions.with_identity(commits.withColumn("project_id", F.lit(9).cast("long")), overrides)
    assert {r["username"] for r in named.collect()} == {"second", "bobby"}


def test_broken_manifests_give_no_rows(files):
    bad = [
        "package.json", "composer.json", "package-lock.json", "Pipfile.lock", "composer.lock", "pyproject.toml", "Cargo.toml",
        "poetry.lock", "Cargo.lock", "pom.xml", "a/b.csproj",
    ]
    table = files([("r", p, '{"dependencies": {"a": "1"}, <dependency> [x') for p in bad])
    assert manifests.all_dependencies(table).count() == 0


def test_manifest_details(files):
    table = files([
        ("r", "requirements.txt", "# c\n-e x\nFlask == 2.0\nplain\n\n[odd]\n"),
        ("r", "pyproject.toml", '[tool.poetry.dependencies]\npython="3"\na={version="1",optional=true}\n[tool.poetry.dev-dependencies]\nb="2"\n'
                                '[project]\nname="x"\n[project.optional-dependencies]\nextra=["c>=3"]\n'),
        ("r", "go.mod", "module m\nrequire (\n a v1 // indirect\n b v2 // note\n)\nrequire c v3\nexclude d v4\n"),
        ("r", "Gemfile", "gem 'a', '1'\ngroup :test do\ngem \"b\"\nend\n  gem 'c'\n"),
        ("r", "yarn.lock", '# x\n\n"@s/a@^1", "@s/a@^2":\n  version "1.5"\n\nb@1:\n  version "2"\nc@1:\n  version "3"\n'),
        ("r", "go.sum", "m v1 h1:\nm v1/go.mod h1:\nshort\n"),
        ("s", "sub/package.json", '{"dependencies": {"no": "1"}}'),
    ])
    rows = {(r["manifest_file"], r["name"]): r for r in manifests.all_dependencies(table).collect()}
    assert rows[("requirements.txt", "Flask")]["version"] == "== 2.0" and ("requirements.txt", "[odd]") not in rows
    assert rows[("pyproject.toml", "a")]["is_optional"] and rows[("pyproject.toml", "b")]["dep_type"] == "dev"
    assert rows[("pyproject.toml", "c")]["is_optional"]
    assert {n: rows[("go.mod", n)]["is_direct"] for n in "abc"} == {"a": False, "b": True, "c": True}
    assert ("go.mod", "d") not in rows
    assert {n: rows[("Gemfile", n)]["dep_type"] for n in "abc"} == {"a": "prod", "b": "dev", "c": "prod"}
    assert {rows[("yarn.lock", n)]["version"] for n in ("@s/a", "b", "c")} == {"1.5", "2", "3"}
    assert not [k for k in rows if k[1] == "no"]


def test_lock_tree_any_depth(files):
    tree = {"version": "0"}
    for i in range(30):
        tree = {"version": str(i), "dependencies": {f"n{i}": tree}}
    lock = json.dumps({"lockfileVersion": 1, "dependencies": {"top": tree}})
    rows = manifests.package_lock(files([("r", "package-lock.json", lock)])).collect()
    assert len(rows) == 31 and not any(r["is_direct"] for r in rows)


def test_locked_beats_declared(files):
    table = files([
        ("r", "package.json", '{"dependencies": {"a": "^1", "b": "^1"}}'),
        ("r", "package-lock.json", '{"lockfileVersion": 3, "packages": {"": {}, "node_modules/a": {"version": "1.2", "license": "MIT"}}}'),
    ])
    rows = {r["name"]: r for r in manifests.dependencies(table).collect()}
    assert rows["a"]["version"] == "1.2" and rows["a"]["is_direct"] and rows["b"]["version"] == "^1"
    lic = {r["name"]: r for r in licences.license_lookup(
        manifests.dependencies(table), licences.repository_licenses(table)).collect()}
    assert lic["a"]["license_spdx"] == "MIT" and lic["b"]["license_risk"] == "unknown"


def test_function_lengths(files):
    py = "import os\n\ndef a():\n" + "    x\n" * 49 + "def b():\n    y\n"
    table = files([("r", "m.py", py), ("r", "big.js", "z\n" * 500), ("r", "node_modules/x.js", "z\n" * 600)])
    langs = fl.language_stats(fl.analysed_files(table))
    row = complexity.complexity(complexity.complexity_files(table, langs)).first()
    assert (row["files_above_threshold"], row["functions_above_threshold"], row["fan_out"]) == (1, 1, 1)
    assert sum(r["percentage"] for r in langs.collect()) == pytest.approx(100, abs=0.02)


def test_stack(files):
    table = files([
        ("r", "package.json", '{"dependencies": {"react": "1"}, "main": "x"}'), ("r", "a.ts", "x"), ("r", ".gitlab-ci.yml", "x"),
        ("r", "bitbucket-pipelines.yml", "x"), ("q", "setup.py", "x"), ("q", "k8s/a.yaml", "apiVersion: 1\nkind: Pod"),
    ])
    rows = {r["repo_id"]: r for r in stack.stack(table, fl.language_stats(fl.analysed_files(table))).collect()}
    assert rows["r"]["project_type"] == "frontend_application" and rows["r"]["ci_provider"] == "bitbucket"
    assert rows["r"]["frameworks"] == ["React"]
    assert rows["q"]["project_type"] == "library" and rows["q"]["infra_tools"] == ["kubernetes"]


def test_append_facts_is_repeatable(spark, tmp_path):
    target = str(tmp_path / "facts")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "scan_id long, v string")
    tables.append_facts(one, target)
    tables.append_facts(spark.createDataFrame([(2, "c"), (5000, "d")], "scan_id long, v string"), target)
    got = {(r["scan_id"], r["v"]) for r in spark.read.parquet(target).collect()}
    assert got == {(1, "a"), (2, "c"), (5000, "d")}


def test_exports(spark, tmp_path, files):
    deps = spark.createDataFrame(
        [(1, 'na"me', "1", "prod", "m", "npm", None, "MIT", None, "safe", True, None, "high", None, "line, note", "locked", False, False)],
        "scan_id long, name string, version string, dep_type string, manifest_file string, ecosystem string, package_manager string, "
        "license_spdx string, license_raw string, license_risk string, is_direct boolean, license_expression string, license_confidence string, "
        "license_source string, license_notes string, discovery_mode string, is_optional_dependency boolean, is_private boolean")
    inventory.write_license_csv(deps, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert back["name"] == 'na"me' and back["license_notes"] == "line, note" and back["package_manager"] == "npm"


def test_read_tree(spark, tmp_path):
    root = tmp_path / "trees"
    (root / "r1" / "src").mkdir(parents=True)
    (root / "r1" / "src" / "a b.py").write_text("x = 1\n")
    rows = src.read_tree(spark, str(root)).collect()
    assert [(r["repo_id"], r["path"], r["size_bytes"], r["content"]) for r in rows] == [("r1", "src/a b.py", 6, "x = 1\n")]


def test_latest_scan_ties(spark):
    from repostrata.operators.latest import latest_scan

    scans = spark.sql("""
        SELECT * FROM VALUES (1L, 7L, 'completed', TIMESTAMP '2024-01-01'), (2L, 7L, 'completed', TIMESTAMP '2024-01-01'),
          (3L, 7L, 'completed', NULL), (4L, 7L, 'running', TIMESTAMP '2025-01-01'), (5L, 8L, 'completed', NULL)
        AS t(id, project_repository_id, status, started_at)""")
    assert {r["id"] for r in latest_scan(scans).collect()} == {2, 5}


def test_bad_parameters():
    for call in (
        lambda: portfolio.treemap(None, None, None, "bytes"),
        lambda: portfolio.commit_activity(None, "2024-01-01", "2y"),
        lambda: portfolio.size_months(None, "2024-01-01", 4),
    ):
        with pytest.raises(ValueError):
            call()


def test_merge_max(spark):
    old = spark.sql("SELECT 1L AS k, DATE '2024-01-01' AS commit_date, 5L AS commit_count")
    new = spark.sql("SELECT 1L AS k, DATE '2024-01-01' AS commit_date, 3L AS commit_count")
    assert merges.daily_upsert_max(old, new, "k").first()["commit_count"] == 5


def test_profile_end_to_end(spark, files, commits):
    table = files([
        ("repo1", "README.md", "hi\n"), ("repo1", "src/a.py", "import os\nemail = 1\n"), ("repo1", "requirements.txt", "flask==1\n"),
        ("empty", "notes.txt", "x"),
    ])
    out = profile.profile(table, commits, [("email", "email")])
    scored = {(r["repo_id"], r["domain"]): r["score"] for r in out["scores"].collect()}
    assert len(scored) == 12 and scored[("repo1", "doc_quality")] == 26.7
    kinds = {(r["repo_id"], r["risk_type"], r["severity"]) for r in out["risks"].collect()}
    assert ("empty", "low_bus_factor", "critical") in kinds and ("repo1", "low_bus_factor", "medium") in kinds
    assert ("repo1", "orphan_module", "medium") in kinds
    assert [r["name"] for r in out["dependencies"].collect()] == ["flask"]
    assert out["personal_data"].first()["line_number"] == 2


def test_skewed_repository(spark):
    """One repository with nearly all rows gives the same answer as the rest."""
    rows = spark.range(20000).select(
        F.when(F.col("id") % 100 < 99, 0).otherwise(F.col("id")).alias("repo_id"),
        F.concat(F.lit("u"), (F.col("id") % 7).cast("string")).alias("username"),
        F.lit(1).cast("long").alias("commit_count"), F.current_timestamp().alias("last_commit_at"))
    contribs = rows.groupBy("repo_id", "username").agg(F.sum("commit_count").alias("commit_count"), F.max("last_commit_at").alias("last_commit_at"))
    top = {r["repo_id"]: r for r in contributions.top_shares(contribs).collect()}
    assert top[0]["developers"] == 7 and top[0]["commits"] == 19800 and len(top) == 201
