from pyspark.sql import functions as F

from repostrata.functions import identity, licensing, links, paths, scalars, text


def test_line_counts_match_python(column, tmp_path):
    samples = ["", "a", "a\n", "a\nb", "a\r\nb\r", "\n\n", "a\rb\nc\r\n", "x\n\ny", "a\x0bb\x85c", "l m"]
    f = tmp_path / "x"

    def by_file(s):
        f.write_text(s, newline="")
        with open(f, encoding="utf-8") as handle:
            return sum(1 for _ in handle)

    assert column(text.count_lines, samples) == [by_file(s) for s in samples]
    assert column(text.count_text_lines, samples) == [len(s.splitlines()) for s in samples]
    assert column(text.text_lines, samples) == [s.splitlines() for s in samples]


def test_suffix_and_stem(column):
    names = ["a/b.py", ".gitignore", "a/.env", "x.tar.gz", "Makefile", "a.b/c", "..x", "A.PY"]
    assert column(paths.suffix, names) == [".py", "", "", ".gz", "", "", ".x", ".py"]
    assert column(paths.stem, ["a/B.py", ".env", "x.tar.gz"]) == ["b", ".env", "x.tar"]


def test_languages(column):
    names = ["a.py", "Dockerfile", "x/Gemfile", "a.lock", "a.png", "a.unknown", "q.R", "a/Jenkinsfile"]
    assert column(paths.detect_language, names) == [
        "Python", "Dockerfile", "Ruby", None, None, None, "R", "Groovy",
    ]


def test_path_rules(column):
    assert column(paths.in_skipped_dir, ["a/node_modules/x.js", ".github/w.yml", "dist", ".env", "src/a.py"]) == [
        True, True, False, False, False,
    ]
    assert column(paths.is_test_file, ["tests/a.py", "Test/a.py", "a/test_x.py", "x_test.go", "a.spec.ts", "latest.py"]) == [
        True, True, True, True, True, False,
    ]
    assert column(paths.top_module, ["a/b.py", "b.py", "./a/b.py", "/x/y"]) == ["a", "root", "a", "/"]


def test_clean_filepath(column):
    raw = ["a.py", "  a.py ", "a\x00b", "a�b", "  ", "src/{old => new}/f.py", "src/{old => }/f.py", "a.py => b.py"]
    assert column(paths.clean_filepath, raw) == ["a.py", "a.py", None, None, None, "src/new/f.py", "src//f.py", "b.py"]


def test_identity(column):
    names = ["Dmitry Ivanov", "Дмитрий Щукин", "root", "", "J Smith", "Ælfgar Núñez", "ﬁnn ström"]
    got = column(identity.name_to_identity, names)
    assert [(g["username"], g["confidence"], g["is_ambiguous"]) for g in got] == [
        ("d_ivanov", 0.85, False), ("d_shchukin", 0.85, False), ("root", 0.5, True), ("unknown", 0.1, True),
        ("j_smith", 0.7, True), ("l_nunez", 0.85, False), ("f_strom", 0.85, False),
    ]
    mails = ["d.ivanov@x", "john-smith+a@x", "a_b@x", "@x", "solo@x", "..@x"]
    assert column(identity.email_to_username, mails) == ["d_ivanov", "j_a", "a_b", None, "solo", "__"]


def test_spdx(column):
    raw = ["MIT", "Apache License 2.0", "BSD", "MIT OR Apache-2.0", "(GPL-2.0 AND MIT)", "SEE LICENSE IN x", None, "", "Foo-1", "my licence", "gpl"]
    got = column(licensing.normalise_spdx, raw)
    assert [g["spdx"] for g in got] == [
        "MIT", "Apache-2.0", "BSD-2-Clause", "MIT", "GPL-2.0-only", None, None, None, "Foo-1", None, None,
    ]
    assert got[3]["expression"] == "MIT OR Apache-2.0"
    assert got[10]["notes"].startswith("Ambiguous")
    assert column(licensing.classify_risk, ["GPL-3.0-only", "LGPL-9", "MIT", "X", None]) == [
        "risky", "risky", "safe", "unknown", "unknown",
    ]
    assert column(licensing.classify_license, ["MIT", "MPL-9", "AGPL-9", "EUPL-9", None]) == [
        "permissive", "weak_copyleft", "strong_copyleft", "weak_copyleft", "unknown",
    ]


def test_license_fields(column):
    raw = ['"MIT"', '[{"type": "MIT"}, "ISC"]', '{"type": "MIT"}', '{"name": "ISC"}', "null", None, '{"type": "", "name": "X"}']
    assert column(licensing.license_field_text, raw) == ["MIT", "MIT OR ISC", "MIT", "ISC", None, None, "X"]


def test_web_base_and_links(spark, column):
    urls = ["https://github.com/o/r.git", "https://u:p@gitlab.com/o/r/", "git@bitbucket.org:o/r.git", "git@host.x:o/r", "", None, "ftp://x/y"]
    assert column(links.web_base, urls) == [
        "https://github.com/o/r", "https://gitlab.com/o/r", "https://bitbucket.org/o/r", "https://host.x/o/r", None, None, None,
    ]
    rows = [
        ("github", "main", None, None, "https://h/o/r/tree/main"),
        ("gitlab", "f/x", "a b.py", 3, "https://h/o/r/-/blob/f%2Fx/a%20b.py#L3"),
        ("bitbucket", "", "\\a\\b.py", 0, "https://h/o/r/src/HEAD//a/b.py"),
        ("bitbucket", "s", "/a.py", 2, "https://h/o/r/src/s/a.py#lines-2"),
        ("other", "s", "a.py", 1, None),
    ]
    df = spark.createDataFrame(rows, "p string, r string, f string, l long, want string").select(
        "want", links.source_url(F.lit("https://h/o/r.git"), F.col("p"), F.col("r"), F.col("f"), F.col("l")).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())


def test_tags_and_time(spark, column):
    df = spark.createDataFrame([([" a ", "a", "", None, "x" * 200],)], "t array<string>")
    assert df.select(scalars.normalise_tags(F.col("t"))).first()[0] == ["a", "x" * 200]
    assert [str(d) for d in column(scalars.day_of, ["2024-01-01T23:30:00-05:00", "bad"])] == ["2024-01-01", "None"]
    assert column(scalars.iso_parse, ["not a time"]) == [None]
    assert column(scalars.json_list, ['["a"]', "broken", None]) == [["a"], [], []]


def test_month_ends(spark):
    ends = spark.range(1).select(scalars.month_ends("2024-03-15", 1)).first()[0]
    assert len(ends) == 12 and str(ends[0]) == "2023-04-30" and str(ends[-1]) == "2024-03-31"
