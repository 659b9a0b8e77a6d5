"""Steps whose moved bytes, memory or time grew faster than their input."""

from repostrata.operators import pdn


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_listed_identifiers_are_sent_to_the_lines(files):
    tree = files([("r", "src/a.py", "name = 1\nother\n")])
    found = pdn.pdn_findings(tree, [("who", "name"), ("who", None), ("x", "absent")])
    assert "SortMergeJoin" not in _plan(found) and "hashpartitioning" not in _plan(found)
    assert [(r["line_number"], r["matched_identifier"]) for r in found.collect()] == [(1, "name")]


def test_manifest_texts_are_written_after_the_shuffle(spark):
    import re

    from repostrata.bindings import Tables
    from repostrata.queries.manifest_queries import manifest_trees

    plan = _plan(manifest_trees(Tables(spark, "/root/testdata/sf0.001"), "yarn.lock", "go.mod"))
    collected = re.findall(r"collect_list\(([^)]*)", plan)
    assert collected and not any("replace" in c for c in collected)
    assert plan.count("hashpartitioning(l_orderkey") == 1 and "hashpartitioning(repo_id" not in plan


def test_code_lines_need_their_word_and_any_newline_counts(files):
    from pyspark.sql import functions as F

    from repostrata.functions import dims, text
    from repostrata.operators import complexity as cx

    body = "import a\r\ndef f():\x0b  x = 'define' async def g():\r pass\ndef h(): pass"
    found = files([("r", "a.py", body), ("r", "b.rb", "")]).select(
        "path", text.text_lines(F.col("content")).alias("lines"), F.when(F.col("path") == "a.py", "Python").otherwise("Ruby").alias("language")
    ).select("path", F.size("lines"), cx.function_starts(F.col("lines"), F.col("language")), cx.import_lines(F.col("lines"), F.col("language")))
    assert sorted(map(tuple, found.collect())) == [("a.py", 6, [1, 3, 5], ["import a"]), ("b.rb", 0, [], [])]
    assert dims.FUNCTION_WORDS.keys() == dims.FUNCTION_PATTERNS.keys() and dims.IMPORT_WORDS.keys() == dims.IMPORT_PATTERNS.keys()


def test_postings_and_hits_are_not_broadcast(spark):
    from repostrata.operators import postings

    rows = spark.createDataFrame([(i, f"name {i}") for i in range(300)], "id long, t string")
    queries = spark.createDataFrame([("E 1",), ("9",)], "q string")
    found = postings.search(rows, "id", ["t"], queries, "q")
    found.collect()
    assert _plan(found).split("Initial Plan")[0].count("SortMergeJoin") >= 2
    assert found.count() == sum(f"name {i}".startswith("name 1") for i in range(300)) + sum("9" in str(i) for i in range(300))


def test_a_folder_of_facts_is_one_file(spark, tmp_path):
    from repostrata.sources import tables

    target = str(tmp_path / "facts")
    rows = spark.range(0, 6000, 1, 8).selectExpr("pmod(id * 7, 3000) AS scan_id", "id AS v")
    tables.append_facts(rows, target)
    assert len(list((tmp_path / "facts").glob("key_bucket=*/*.parquet"))) == 3
    assert tables.read_facts(spark, target).count() == 6000


def test_days_and_parts_are_counted_without_tripling_the_lines(spark):
    from repostrata.bindings import Tables

    plan = _plan(Tables(spark, "/root/testdata/sf0.001").contributions())
    assert "Expand" not in plan and plan.count("hashpartitioning(l_orderkey") == 1


def test_buckets_and_folders_follow_the_rows(spark, tmp_path, monkeypatch):
    from repostrata.sources import layout

    monkeypatch.setattr(layout, "BUCKET_ROWS", 100)
    monkeypatch.setattr(layout, "FOLDERS", 3)
    rows = spark.range(1000).selectExpr("id * 50 AS scan_id", "id AS v")
    layout.write_laid_out(rows, "facts_growing", str(tmp_path / "facts_growing"), 2, 1000)
    try:
        assert "Num Buckets" in [r[0] for r in spark.sql("DESCRIBE FORMATTED facts_growing").collect()]
        buckets = spark.sql("DESCRIBE FORMATTED facts_growing").filter("col_name = 'Num Buckets'").first()["data_type"]
        assert buckets == "10" and len(list((tmp_path / "facts_growing").glob("scan_range=*"))) == 3
        assert layout.of_scans(spark, "facts_growing", spark.createDataFrame([(50,), (49950,)], "id long")).count() == 2
        assert layout.read_laid_out(spark, "facts_growing").count() == 1000
    finally:
        spark.sql("DROP TABLE facts_growing")


def test_long_forms_are_looked_up_once_a_character(spark):
    from pyspark.sql import functions as F

    from repostrata.functions import dims, identity

    single, ascii_, long_ = dims.diacritic_tables()
    every = "a\n" + "".join(long_) + single + "жZ中"
    rows = spark.createDataFrame([(0, every), (1, "½½ … é½"), (2, "plain ~"), (3, ""), (4, None), (5, "中")], "k int, t string")
    found = rows.select("k", identity.strip_diacritics(F.col("t")).alias("a"))
    assert "transform(split" not in _plan(found)
    assert dict(map(tuple, found.collect())) == {
        0: "a\n" + "".join(long_.values()) + ascii_ + "Z", 1: "1212 ... e12", 2: "plain ~", 3: "", 4: None, 5: ""}


def test_log_lines_are_split_once_and_read_without_patterns(spark):
    import re

    from pyspark.sql import functions as F

    from repostrata.functions import common, paths
    from repostrata.sources import history

    spaces = [chr(c) for c in range(0x3100) if re.fullmatch(r"\s", chr(c)) and not 0x1C <= c <= 0x1F]
    assert sorted(common.WHITE_SPACE) == spaces
    names = ["a.py", "", ".py", "x/.py", "x/..Py", "a.", "a.b/c", "a.b/c.JS", "a.py\n", "é.Go", "/", "x/a.b.rb", "...", "a..", " . "]
    rows = spark.createDataFrame([(n,) for n in [*names, None]], "p string").withColumn("s", paths.suffix(F.col("p")))
    assert {r["p"]: r["s"] for r in rows.collect()} == {
        n: (re.findall(r"(?<=[^/])(\.[^./]+)\Z", n) or [""])[0].lower() for n in names} | {None: None}
    raw = [" src/{old => new}/a.py ", "a => b.py", "x/{ => y}", "a =>", " ", "{a => }", None, "p�", "node_modules/a.py"]
    rows = spark.createDataFrame([(r,) for r in raw], "r string").withColumn("c", paths.clean_filepath(F.col("r")))
    assert [r["c"] for r in rows.collect()] == ["src/new/a.py", "b.py", "x/y", "a =>", None, None, None, None, "node_modules/a.py"]
    block = "\r\nabcdefg\rname\r\nmail\n2024-01-02T03:04:05+00:00\n\n1\t2\tx.py\n 3\t-\t.git/y\n4\t-\ta b.go  "
    logs = spark.createDataFrame([("r", 1, block), ("r", 2, "a\nb\nc"), ("r", 3, None)], "repo_id string, seq long, value string")
    parsed = history.parse_log(logs)
    assert "Generate explode(array(split(" in parsed._jdf.queryExecution().optimizedPlan().toString()
    [row] = parsed.collect()
    assert row["sha"] == "abcdefg" and [tuple(c) for c in row["file_changes"]] == [("x.py", 1, 2, "Python"), ("a b.go", 4, 0, "Go")]


def test_sides_of_a_pair_meet_without_a_table_in_memory(spark):
    from repostrata.operators import compare

    pairs = spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "scan_a long, scan_b long")
    profiles = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (4, "z")], "id long, canonical_username string")
    contribs = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (2, 3), (3, 4), (9, 1), (None, 1)], "scan_id long, profile_id long")
    found = compare.developer_diff(contribs, profiles, pairs)
    assert "HashAggregate" not in _plan(found) and "Window" in _plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, 2, "y", "joined"), (2, 3, "x", "left"), (2, 3, "y", "left"), (2, 3, "z", "joined")]


def test_contributions_keep_no_distinct_lines_and_are_dealt_by_scan(spark, tmp_path):
    import datetime as dt

    from repostrata.bindings import Tables

    days = [dt.datetime(2024, 1, d) for d in (1, 2)]
    lines = [(1, 1, 5, 1, 2.0, "A", "O", days[0]), (1, 1, 5, 2, 3.0, "A", "O", days[1]), (1, 2, 5, 3, 1.0, "A", "O", days[1]), (1, 2, 6, 4, 1.0, "A", "O", None),
             (1, 9, 5, 5, 1.0, "A", "O", days[0]), (None, 1, 5, 1, 4.0, "A", "O", days[0])]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = [(1, "a", "b", "t", 3), (1, "a", "b", "t", 3), (2, "c", "b", "t", 4)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    found = Tables(spark, str(tmp_path)).contributions()
    assert "distinct" not in _plan(found) and "hashpartitioning(l_orderkey" in _plan(found) and "hashpartitioning(scan_id" not in _plan(found)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([
        (1, 5, 5, 11, 9, 2, 2, days[0], days[1]), (1, 6, 1, 1, 4, 1, 0, None, None), (None, 5, 2, 8, 2, 1, 1, days[0], days[0])], key=str)


def test_names_beside_a_lockfile_are_not_collected_on_the_driver(files):
    from repostrata.operators import manifests as ma

    tree = files([("r", "package.json", '{"dependencies": {"a": "1"}}'), ("r", "package-lock.json", '{"lockfileVersion": 3, "packages": {"node_modules/a": {"version": "1"}}}')])
    locked = ma.package_lock(tree)
    assert "BroadcastHashJoin" not in _plan(locked) and "SortMergeJoin" in _plan(locked)
    assert [(r["name"], r["is_direct"]) for r in locked.collect()] == [("a", True)]


def test_both_forms_of_a_lockfile_are_read_in_one_pass(files):
    from repostrata.operators import manifests as ma

    tree = files([
        ("v1", "package-lock.json", '{"dependencies": {"a": {"version": "1", "dev": true, "dependencies": {"b": {"version": "2"}}}}}'),
        ("v2", "package-lock.json", '{"lockfileVersion": 2, "packages": {"": {}, "node_modules/a/node_modules/c": {"version": "3"}}, "dependencies": {"z": {}}}'),
        ("low", "package-lock.json", '{"lockfileVersion": 1, "packages": {"node_modules/x": {}}, "dependencies": {"y": {}}}'),
        ("bad", "package-lock.json", "{"), ("list", "package-lock.json", "[]"), ("v2", "package.json", '{"dependencies": {"c": "1"}}'),
    ])
    found = ma.package_lock(tree)
    # by now one join and one call of Python
    assert _plan(found).count("SortMergeJoin") == 1 and _plan(found).count("ArrowEvalPython") == 1
    rows = sorted((r["repo_id"], r["name"], r["version"], r["dep_type"], r["is_direct"], r["item_seq"]) for r in found.collect())
    assert rows == [
        ("low", "y", None, "prod", False, 0), ("v1", "a", "1", "dev", False, 0), ("v1", "b", "2", "prod", False, 1), ("v2", "c", "3", "prod", True, 0),
    ]
    assert {r["repo_id"]: r["is_v1"] for r in ma.npm_lock_packages(tree).collect()} == {"v1": True, "v2": False, "low": True, "list": True}


def test_a_project_file_is_parsed_once(files):
    from repostrata.operators import manifests as ma

    text = '[project]\ndependencies = ["p>=1", "q"]\n[tool.poetry.dependencies]\npython = "^3"\na = "1"\n[tool.poetry.group.test.dependencies]\nb = {version = "2"}\n'
    found = ma.pyproject(files([("r", "pyproject.toml", text), ("bad", "pyproject.toml", "[a")]))
    assert _plan(found).count("ArrowEvalPython") == 1
    rows = sorted((r["item_seq"], r["name"], r["version"], r["dep_type"], r["package_manager"]) for r in found.collect())
    assert rows == [(0, "a", "1", "prod", "poetry"), (1, "b", "2", "dev", "poetry"), (10_000_000, "p", ">=1", "prod", None), (10_000_001, "q", None, "prod", None)]


def test_plain_toml_is_read_as_by_the_library():
    import json
    import random
    import tomllib

    from repostrata.operators.manifests import plain_toml

    assert plain_toml('[a.b]\nc = { v = "1", f = ["x", "y",], o = true } # c\n[[p]]\nn = 3\n[p.d]\nx = "é"\n[[p]]\n') == {
        "a": {"b": {"c": {"v": "1", "f": ["x", "y"], "o": True}}}, "p": [{"n": 3, "d": {"x": "é"}}, {}]}
    lines = [
        "[a]", "[b]", "[a.b]", "[a.b.c]", "[[p]]", "[p.d]", "[p.d.e]", "[[a]]", "[ a ]", 'x = "1"', 'z = ["a", "b",]', "w = []", 'q = { v = "1", f = ["a"], o = true }', "t = true",
        "n = 3", "n = 03", "m = 1.5", 'k = "a\\n"', "# c", "", ' x="" # z', '"q" = "1"', "d.e = 'l'", 'u = """', "r = [1]", 'v = [\n "a"]', "bad", 'i = { a = "1", a = "2" }',
        'a = "v"', 'p = "v"', 'b = { c = "1" }', "[a.d]", 'h = "\x01"', "# \x01", "[c]\r", "x = tru", 'e = "a" "b"', "f = 1979-05-27", 'd = "p"', "n = -1", "b = {}",
    ]
    rng = random.Random(1)
    for _ in range(20_000):
        text = "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 6))) + rng.choice(["", "\n"])
        plain = plain_toml(text)
        if plain is not None:
            assert json.dumps(plain) == json.dumps(tomllib.loads(text)), text


def test_a_reader_of_manifests_reads_its_own_folder(files):
    from repostrata.operators import manifests as ma

    stored = ma.manifest_files(files([("r", "go.sum", "m v1/go.mod h\n"), ("r", "package.json", "{}"), ("r", "x/a.csproj", '<P><PackageReference Include="n" Version="1" /></P>'), ("r", "b.py", "")]))
    own = _plan(ma.go_sum(stored)).split("PartitionFilters: [")[1].split("]")[0]
    assert stored.count() == 3 and "manifest_kind" in own and "go.sum" in own
    assert [r["name"] for r in ma.all_dependencies(stored).orderBy("name").collect()] == ["m", "n"]
    assert ma.manifest_files(files([("r", "b.py", "")])).count() == 0


def test_lines_of_manifests_are_null_without_a_name_or_version(spark):
    from pyspark.sql import functions as F

    from repostrata.queries.manifest_queries import _fill

    rows = spark.createDataFrame([("n1", "2.0"), ("n2", None), (None, "3.0")], "name string, v string").select(F.struct("name", "v").alias("p"))
    found = rows.select(_fill("{n} = {v}, {n}\n", F.col("p")), _fill("gem '{n}'\n", F.col("p"))).collect()
    assert [tuple(r) for r in found] == [("n1 = 2.0, n1\n", "gem 'n1'\n"), (None, None), (None, None)]
