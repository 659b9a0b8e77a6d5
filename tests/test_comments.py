"""Comment splitting against a line-by-line walk written for the tests."""

import random

from repostrata.operators import comments, pdn

PIECES = ["x", " ", "\n", "#", "//", "/*", "*/", "--", '"""', "'''", '"', "ab", "/", "*", "-", "\n\n", "id"]


def walk_hash(lines):
    quote = None
    for line in lines:
        if quote:
            at = line.find(quote)
            if at < 0:
                yield "", line
            else:
                yield line[at + 3:], line[: at + 3]
                quote = None
            continue
        code, comment, rest = "", "", line
        while rest:
            if rest[:3] in ('"""', "'''"):
                mark, rest = rest[:3], rest[3:]
                inner, found, tail = rest.partition(mark)
                if not found:
                    quote, comment = mark, mark + rest
                    break
                rest = tail
            elif rest[0] == "#":
                comment = rest[1:]
                break
            else:
                code, rest = code + rest[0], rest[1:]
        yield code, comment


def walk_c(lines):
    inside = False
    for line in lines:
        code, comment, rest = "", "", line
        if inside:
            head, found, rest = line.partition("*/")
            comment = head + found
            inside = not found
        while rest:
            if rest.startswith("//"):
                comment += rest[2:]
                break
            if rest.startswith("/*"):
                body, found, rest = rest[2:].partition("*/")
                comment += body
                inside = not found
            else:
                code, rest = code + rest[0], rest[1:]
        yield code, comment


def walk_sql(lines):
    inside = False
    for line in lines:
        if inside:
            head, found, line = line.partition("*/")
            if not found:
                yield "", head
                continue
            inside = False
        comment = ""
        before, opened, after = line.partition("/*")
        if opened:
            body, closed, tail = after.partition("*/")
            comment = body
            if not closed:
                inside = True
                yield before, comment
                continue
            line = before + tail
        code, _, dashes = line.partition("--")
        yield code, comment + dashes


def check(spark, files, ext, walk):
    rng = random.Random(ext)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    got = {}
    df = comments.comment_split(files([("r", f"f{i}{ext}", t) for i, t in enumerate(texts)]))
    for row in df.collect():
        got.setdefault(row["path"], {})[row["line_number"]] = (row["code"], row["comment"])
    for i, t in enumerate(texts):
        lines = t.split("\n")
        if lines[-1] == "":
            lines.pop()
        want = list(walk(lines))
        found = got.get(f"f{i}{ext}", {})
        have = [found.get(n + 1) for n in range(max(len(lines), len(found)))]
        assert have == want, (t, have, want)


def test_hash_style(spark, files):
    check(spark, files, ".py", walk_hash)


def test_c_style(spark, files):
    check(spark, files, ".js", walk_c)


def test_sql_style(spark, files):
    check(spark, files, ".sql", walk_sql)


def test_findings(spark, files):
    rows = [
        ("r", "src/a.py", "email = 1  # phone\nuser_email\nx = phone_number\n"),
        ("r", "src/b.md", "phone email\n"),
        ("r", "tests/a.py", "email\n"),
        ("r", "vendor/a.py", "email\n"),
        ("r", "a.bin", "email\n"),
        ("r", "a.txt", "личный email, эemail\n"),
    ]
    types = [("email", "email"), ("phone", "phone"), ("phone", "phone_number")]
    table = files(rows)
    code = {(r["path"], r["line_number"], r["matched_identifier"]) for r in pdn.pdn_findings(table, types).collect()}
    assert code == {
        ("src/a.py", 1, "email"), ("src/a.py", 3, "phone_number"), ("src/b.md", 1, "phone"), ("src/b.md", 1, "email"), ("a.txt", 1, "email"),
    }
    both = pdn.pdn_findings(table, types, include_comments=True).filter("part = 'comment'").collect()
    assert [(r["path"], r["line_number"], r["matched_identifier"]) for r in both] == [("src/a.py", 1, "phone")]
    assert pdn.pdn_findings(table, []).count() == 0
