"""Inputs that used to overflow a stack, fail to decode, overflow a key or lose rows."""

from pyspark.sql import functions as F

from repostrata.functions import identity
from repostrata.operators import complexity, latest, manifests, pdn
from repostrata.sources import files as source_files, tables


def test_long_blank_runs_in_code(spark, files):
    code = "class A {\n" + " " * 100_000 + "public int f (int a) {\n}\n  private static final String g (\n" + " " * 100_000 + "\n"
    tree = files([("r", "A.java", code), ("r", "B.cs", code)])
    languages = spark.createDataFrame([("r", "Java"), ("r", "C#")], "repo_id string, language string")
    found = complexity.complexity_files(tree, languages)
    assert sorted((r["language"], r["lines"]) for r in found.collect()) == [("C#", 5), ("Java", 5)]


def test_single_modifier_is_enough(spark):
    """One modifier before the type finds the same lines as any number of them."""
    lines = ["public int f(", "  private static final Map<String> g (", "f(", "return x(", "else if (", "int f(int a)", "new Foo(", "static f (", "public  f("]
    import re

    old = re.compile(r"(public|private|protected|static|final|\s)+[\w<>\[\]]+\s+\w+\s*\(")
    new = re.compile(r"(public|private|protected|static|final|\s)[\w<>\[\]]+\s+\w+\s*\(")
    assert [bool(old.search(x)) for x in lines] == [bool(new.search(x)) for x in lines]


def test_many_pnpm_dependencies(files):
    names = "".join(f"      p{i}:\n        specifier: 1.0.0\n        version: 1.0.0\n" for i in range(3000))
    packages = "".join(f"  p{i}@1.0.0:\n    resolution: x\n" for i in range(50))
    lock = "lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n" + names + "packages:\n" + packages
    rows = manifests.pnpm_lock(files([("r", "pnpm-lock.yaml", lock)])).collect()
    assert len(rows) == 50 and all(r["is_direct"] for r in rows)


def test_go_sum_keeps_first_of_each(files):
    text = "".join(f"m{i % 500} v1.{i % 3}.0/go.mod h1:x\n" for i in range(6000))
    rows = manifests.go_sum(files([("r", "go.sum", text)])).collect()
    assert len(rows) == 1500


def test_any_bytes_can_be_read(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.png").write_bytes(b"\x89PNG\r\n\xff\xfe\x00")
    (tmp_path / "r" / "b.txt").write_bytes("é".encode("latin-1"))
    got = {r["path"]: r["content"] for r in source_files.read_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.png", "b.txt"} and got["b.txt"] == "�"


def test_latest_scan_with_any_ids(spark):
    rows = [(-5, 1, "2024-01-01"), (-77, 1, "2024-01-01"), (-8_000_000_000_000_000_000, 2, "2024-01-01"), (9, 3, None), (8, 3, None)]
    scans = spark.createDataFrame([(i, r, "completed", s) for i, r, s in rows], "id long, project_repository_id long, status string, started_at string")
    scans = scans.withColumn("started_at", F.to_timestamp("started_at"))
    assert {r["id"] for r in latest.latest_scan(scans).collect()} == {-5, -8_000_000_000_000_000_000, 9}


def test_names_of_any_plane(column):
    assert column(identity.strip_diacritics, ["𝐣𝐨𝐡𝐧 smith", "ⅷ", "ﬁn", "㎏", "é"]) == ["john smith", "viii", "fin", "kg", "e"]
    assert [r["username"] for r in column(identity.name_to_identity, ["𝐣𝐨𝐡𝐧 Smith", "Ⅷ"])] == ["j_smith", "viii"]


def test_large_files_are_scanned_for_personal_data(files):
    text = "x = 1\n" * 110_000 + "passport = 1\nus/*x*/er = 2\n"
    found = pdn.pdn_findings(files([("r", "src/A.java", text + " " * 1_100_000)]), [("id", "passport"), ("name", "user")]).collect()
    assert {(r["line_number"], r["pdn_type"]) for r in found} == {(110_001, "id"), (110_002, "name")}


def test_a_scan_with_an_empty_result_loses_its_rows(spark, tmp_path):
    target = str(tmp_path / "facts")
    some = spark.createDataFrame([(1, "a"), (2, "b"), (5000, "c")], "scan_id long, v string")
    tables.append_facts(some, target)
    again = spark.createDataFrame([(1,), (5000,)], "scan_id long")
    tables.append_facts(some.where("false"), target, scans=again)
    assert [tuple(r) for r in tables.read_facts(spark, target).collect()] == [(2, "b")]
    tables.append_facts(spark.createDataFrame([(5001, "d")], "scan_id long, v string"), target)
    assert {tuple(r) for r in tables.read_facts(spark, target).collect()} == {(2, "b"), (5001, "d")}
