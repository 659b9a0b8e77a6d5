"""Files, complexity, stack, comments and personal data, over the documents as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import Tables
from ..functions import dims, paths, text
from ..functions.licensing import classify_license_text
from ..operators import block_state as bs
from ..operators import comments as cm
from ..operators import complexity as cx
from ..operators import files as fl
from ..operators import pdn
from ..operators import stack as st
from ..sources import tables
from .canonical_sql import oracle, share_sql

# Identifiers searched in the documents: frequent words of several languages and a secret's name.
TYPES = [("secret", "token"), ("name", "the"), ("name", "que"), ("name", "und"), ("contact", "le"), ("contact", "reé")]
WORDS = "|".join(i for _, i in TYPES)


def _analysed(t: Tables):
    return fl.analysed_files(t.source_files())


def _languages(t: Tables):
    return fl.language_stats(_analysed(t))


def _code(t: Tables):
    return cx.complexity_files(t.source_files(), _languages(t))


# Lines that look like code inside prose, with Unicode word characters.
W = r"[\p{L}\p{N}_]"
SQL_FUNCTIONS = {
    "Python": rf"^\s{{0,4}}(async\s+)?def\s+{W}+",
    "JavaScript": rf"(function\s+{W}+|{W}+\s*[:=]\s*(async\s*)?(function|\([^)]*\)\s*=>))",
    "Java": rf"(public|private|protected|static|final|\s)+[\p{{L}}\p{{N}}_<>\[\]]+\s+{W}+\s*\(",
    "Go": r"^func\s+",
    "Ruby": rf"^\s*def\s+{W}+",
}
SQL_IMPORTS = {
    "Python": rf"^\s*(import|from)\s+{W}+",
    "JavaScript": r"(import .+ from|require\s*\()",
    "Go": r'^\s*"[\p{L}\p{N}_./-]+"',
    "Java": r"^import\s+[\p{L}\p{N}_.]+",
}


def _any(patterns: dict[str, str], line: str) -> str:
    return "CASE language " + " ".join(
        f"WHEN '{k}' THEN regexp_matches({line}, '{v}')" for k, v in patterns.items()
    ) + " ELSE false END"


CODE_FILES = f"""
WITH code AS (SELECT f.*, l.language FROM files f JOIN repo_languages l ON l.repo_id = f.repo_id AND l.language =
    CASE f.ext WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.java' THEN 'Java' WHEN '.go' THEN 'Go' WHEN '.rb' THEN 'Ruby' END
  WHERE f.folder <> 'node_modules/x/'),
cl AS (SELECT c.repo_id, c.path, c.language, s.line_number, s.line, count(*) OVER (PARTITION BY s.path, s.repo_id) AS n
  FROM code c JOIN split_lines s ON s.repo_id = c.repo_id AND s.path = c.path),
starts AS (SELECT *, coalesce(lead(line_number) OVER (PARTITION BY repo_id, path ORDER BY line_number), n + 1) - line_number AS length
  FROM cl WHERE {_any(SQL_FUNCTIONS, 'line')}),
imports AS (SELECT DISTINCT repo_id, path, trim(line, ' \t') AS imp FROM cl WHERE {_any(SQL_IMPORTS, 'line')}),
per_file AS (SELECT c.repo_id, c.path, c.language, coalesce(max(n), 0) AS lines FROM code c LEFT JOIN cl USING (repo_id, path) GROUP BY ALL)
"""

PER_FILE = CODE_FILES + """
SELECT p.repo_id, p.path, p.language, p.lines, (SELECT count(*) FROM starts s WHERE s.repo_id = p.repo_id AND s.path = p.path AND length >= 50) AS large_functions,
  (SELECT count(*) FROM imports i WHERE i.repo_id = p.repo_id AND i.path = p.path) AS imports FROM per_file p
"""

# Hash-style and plain lines of the documents: no quotes or block comments occur in them,
# so a line splits at its first mark (checked by a brute-force test on a fixture).
SPLIT = r"""
SELECT repo_id, path, line_number,
  CASE WHEN ext IN ('.py', '.rb', '.yaml') AND instr(line, '#') > 0 THEN substr(line, 1, instr(line, '#') - 1) ELSE line END AS code,
  CASE WHEN ext IN ('.py', '.rb', '.yaml') AND instr(line, '#') > 0 THEN substr(line, instr(line, '#') + 1) ELSE '' END AS comment
FROM split_lines
"""
TYPES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TYPES) + ") AS y(pdn_type, ident)"


def _findings_sql(part: str, name: str) -> str:
    return f"""SELECT s.repo_id, s.path, s.line_number, pdn_type, ident AS matched_identifier, '{name}' AS part
      FROM (SELECT s.* FROM ({SPLIT}) s JOIN files f ON f.repo_id = s.repo_id AND f.path = s.path
          WHERE f.folder NOT IN ('node_modules/x/', '.github/') AND NOT contains(lower(f.path), 'test') AND {part} <> '') s JOIN {TYPES_SQL}
        ON contains({part}, ident)
      WHERE regexp_matches({part}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])' || ident || '($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')"""


def _item_words(t: Tables):
    """Identifiers of a table: words and pairs of words of the benchmark's texts, by their number."""
    own = F.array_distinct(F.filter(F.split("text", r"[^\p{L}]+"), lambda w: F.length(w) > 4))
    pairs = F.regexp_extract_all("text", F.lit(r"[a-z]+, [a-z]+"), F.lit(0))
    return t.raw("benchmark").select(
        F.concat(F.lit("item"), (F.col("item_id") % 7).cast("string")).alias("pdn_type"), F.explode(F.concat(own, pairs)).alias("identifier")
    ).distinct()


# Words by equality with the runs of a line, pairs by search for their text.
ITEM_WORDS = r"""
WITH idents AS (SELECT DISTINCT 'item' || (item_id % 7) AS pdn_type, ident FROM (
  SELECT item_id, unnest(list_concat([w FOR w IN regexp_split_to_array(text, '[^\p{L}]+') IF length(w) > 4], regexp_extract_all(text, '[a-z]+, [a-z]+'))) AS ident FROM benchmark)),
code AS (SELECT s.repo_id, s.path, s.line_number, s.code FROM (""" + SPLIT + r""") s JOIN files f ON f.repo_id = s.repo_id AND f.path = s.path
  WHERE f.folder NOT IN ('node_modules/x/', '.github/') AND NOT contains(lower(f.path), 'test')),
runs AS (SELECT DISTINCT repo_id, path, line_number, code, unnest(regexp_extract_all(code, '[\p{L}\p{M}\p{N}_]+')) AS run FROM code)
SELECT repo_id, path, line_number, pdn_type, ident AS matched_identifier, 'code' AS part FROM runs JOIN idents ON ident = run
UNION ALL SELECT DISTINCT repo_id, path, line_number, pdn_type, ident, 'code' FROM runs JOIN (SELECT *, split_part(ident, ', ', 1) AS head FROM idents WHERE contains(ident, ', ')) ON run = head
  WHERE contains(code, ident) AND regexp_matches(code, '(^|[^\p{L}\p{M}\p{N}_])' || ident || '($|[^\p{L}\p{M}\p{N}_])')
"""




def _trees(t: Tables):
    """A small tree per order: which marker files it has follows from its number."""
    k = F.col("o_orderkey")
    yes = F.lit(True)
    options = [
        (k % 2 == 0, "package-lock.json", F.lit("{}")),
        (k % 3 == 0, "requirements.txt", F.concat(F.lit("Django==4\n# "), "o_orderpriority")),
        (k % 5 == 0, "pyproject.toml", F.lit("[tool.black]\n[tool.ruff]\n[tool.poetry]\npackages = []\n")),
        (k % 7 == 0, "go.mod", F.lit("module x\nrequire github.com/gin-gonic/gin v1.9.0\n")),
        (k % 4 == 0, "package.json", F.lit('{"main": "index.js", "dependencies": {"react": "1", "@nestjs/core": "2"}, "devDependencies": {"koa": "1"}}')),
        (k % 11 == 0, "pom.xml", F.lit("<project><artifactId>Spring-Boot-starter</artifactId></project>")),
        (k % 6 == 0, ".github/workflows/ci.yml", F.lit("on: push")),
        (k % 10 == 0, ".gitlab-ci.yml", F.lit("stages: []")),
        (k % 13 == 0, "Dockerfile", F.lit("FROM scratch")),
        (k % 8 == 0, "deploy/app.yaml", F.lit("apiVersion: v1\nkind: Pod\n")),
        (k % 9 == 0, "infra/main.tf", F.lit("resource {}")),
        (k % 14 == 0, "charts/x/Chart.yaml", F.lit("name: x")),
        (k % 15 == 0, ".flake8", F.lit("[flake8]")),
        (k % 16 == 0, ".prettierrc", F.lit("{}")),
        (k % 17 == 0, "packages/a/a.txt", F.lit("a")),
        (k % 17 == 0, "apps/b/b.txt", F.lit("b")),
        (k % 3 == 1, "src/main.go", F.lit("package main")),
        (k % 3 == 2, "cli.py", F.lit("print(1)")),
        (k % 5 == 1, "web/app.ts", F.lit("let x = 1")),
        (k % 19 == 0, "setup.py", F.lit("setup()")),
        (yes, "notes.txt", F.col("o_orderpriority")),
    ]
    files = F.array(*[F.when(c, F.struct(F.lit(p).alias("path"), text_.alias("content"))) for c, p, text_ in options])
    return t.raw("orders").select(
        k.alias("repo_id"), F.inline(F.filter(files, lambda f: f.isNotNull()))
    ).withColumn("size_bytes", F.length("content").cast("long"))


def _list(*pairs: tuple[str, str]) -> str:
    items = ", ".join(f"CASE WHEN {c} THEN '{v}' END" for c, v in pairs)
    return f"array_to_string([x FOR x IN [{items}] IF x IS NOT NULL], ',')"


STACK = f"""
WITH k AS (SELECT o_orderkey AS repo_id, o_orderkey AS k,
  o_orderkey % 3 = 2 OR o_orderkey % 19 = 0 AS py, o_orderkey % 3 = 1 AS go, o_orderkey % 5 = 1 AS ts FROM orders)
SELECT repo_id, CASE WHEN k % 17 = 0 THEN 'monorepo'
    WHEN (k % 10 = 0 OR k % 8 = 0 OR k % 9 = 0 OR k % 14 = 0) AND NOT py AND NOT go AND NOT ts AND k % 10 <> 0 THEN 'infra_config'
    WHEN ts AND NOT py AND NOT go THEN 'frontend_application'
    WHEN (py OR go) AND NOT ts THEN CASE WHEN k % 3 = 2 THEN 'cli_tool' WHEN k % 19 = 0 OR k % 4 = 0 OR k % 5 = 0 THEN 'library' ELSE 'backend_service' END
    WHEN py OR go THEN 'monolith'
    WHEN k % 8 = 0 OR k % 9 = 0 OR k % 14 = 0 OR k % 10 = 0 THEN 'infra_config' ELSE 'unknown' END AS project_type,
  {_list(("k % 4 = 0", "React"), ("k % 4 = 0", "NestJS"), ("k % 4 = 0", "Koa"), ("k % 3 = 0", "Django"), ("k % 7 = 0", "Gin"), ("k % 11 = 0", "Spring Boot"))} AS frameworks,
  {_list(("k % 2 = 0", "npm"), ("k % 3 = 0", "pip"), ("k % 5 = 0", "pip/poetry"), ("k % 7 = 0", "go modules"), ("k % 11 = 0", "maven"))} AS package_managers,
  CASE WHEN k % 10 = 0 THEN 'gitlab' WHEN k % 6 = 0 THEN 'github_actions' END AS ci_provider,
  k % 13 = 0 AS has_docker, k % 8 = 0 AS has_kubernetes, k % 9 = 0 AS has_terraform, k % 14 = 0 AS has_helm,
  {_list(("k % 9 = 0", "terraform"), ("k % 8 = 0", "kubernetes"), ("k % 14 = 0", "helm"))} AS infra_tools,
  {_list(("k % 15 = 0", "Flake8"), ("k % 5 = 0", "Ruff"))} AS linters,
  {_list(("k % 16 = 0", "Prettier"), ("k % 5 = 0", "Black"))} AS formatters
FROM k
"""


def _stack(t: Tables):
    trees = _trees(t)
    out = st.stack(trees, fl.language_stats(fl.analysed_files(trees)))
    lists = ["frameworks", "package_managers", "infra_tools", "linters", "formatters"]
    return out.drop("primary_language").select(
        *[F.array_join(c, ",").alias(c) if c in lists else F.col(c) for c in out.columns if c != "primary_language"]
    )


def _stack_column(*columns: str):
    names = ["repo_id", *columns]
    return (lambda t: _stack(t).select(*names), oracle(f"SELECT {', '.join(names)} FROM ({STACK})"))


def _code_trees(t: Tables):
    """A source file per order: an import per line, then a function per line.

    A function's body is twice the line's quantity; even orders are Python, odd
    ones JavaScript; a repository is the customer's nation.
    """
    k = F.col("l_orderkey")
    even = k % 2 == 0

    def module(line):
        name = F.concat(F.lit("import m"), (line["l_partkey"] % 300).cast("string"))
        return F.concat(name, F.when(even, "\n").otherwise(" from 'm'\n"))

    def function(line):
        part = line["l_partkey"].cast("string")
        head = F.when(even, F.concat(F.lit("def f"), part, F.lit("():\n"))).otherwise(
            F.concat(F.lit("function f"), part, F.lit("() {\n")))
        return F.concat(head, F.repeat(F.lit("    step()\n"), (line["qty"] * 2).cast("int")))

    # The lines move as numbers; the texts are written where the files end up.
    files = t.lines().groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "qty")).alias("lines"))
    where = t.scans().select(F.col("id").alias("l_orderkey"), F.col("project_repository_id").alias("repo_id"))
    content = F.concat(*[F.array_join(F.transform("lines", f), "") for f in (module, function)])
    return files.join(where, "l_orderkey").select(
        "repo_id",
        F.concat(F.lit("m"), (k % 7).cast("string"), F.lit("/f"), k.cast("string"), F.when(even, ".py").otherwise(".js")).alias("path"),
        content.alias("content"),
    ).select("repo_id", "path", F.length("content").cast("long").alias("size_bytes"), "content")


def _tree_code(t: Tables):
    trees = _code_trees(t)
    return cx.complexity_files(trees, fl.language_stats(fl.analysed_files(trees)))


TREE_FILES = """
WITH tree AS (SELECT project_repository_id AS repo_id, l_orderkey AS k,
  'm' || (l_orderkey % 7) || '/f' || l_orderkey || CASE WHEN l_orderkey % 2 = 0 THEN '.py' ELSE '.js' END AS path,
  (sum(2 + 2 * qty))::BIGINT AS lines, count(*) FILTER (qty * 2 + 1 >= 50) AS large_functions, count(DISTINCT l_partkey % 300) AS imports
  FROM lines JOIN scans ON scans.id = l_orderkey GROUP BY ALL),
fans AS (SELECT project_repository_id AS repo_id, count(DISTINCT (l_partkey % 300) * 2 + l_orderkey % 2) AS fan_out
  FROM lines JOIN scans ON scans.id = l_orderkey GROUP BY ALL)
"""

LICENCE_CASES = " ".join(
    f"WHEN regexp_matches(head, '(?is){p}') THEN '{s}'" for p, s in dims.LICENSE_TEXT_PATTERNS
)


def _nested_blocks(t: Tables):
    """Depth after every line of the documents: a line that begins with a vowel opens a block,
    one that holds `on` closes one, and three is the deepest."""
    lines = t.raw("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")
    step = bs.nesting(F.col("line").rlike("^[AEIOUaeiou]"), F.col("line").contains("on"), 3)
    return bs.block_state(lines, ["doc_id"], "line_no", step, 4, segment=8, fan=4).select("doc_id", "line_no", F.col("state").cast("long").alias("depth"))


NESTED = """
WITH RECURSIVE lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
steps AS (SELECT doc_id, line_no, CASE WHEN o AND NOT c THEN 1 WHEN c AND NOT o THEN -1 ELSE 0 END AS step FROM (
  SELECT doc_id, line_no, regexp_matches(line, '^[AEIOUaeiou]') AS o, contains(line, 'on') AS c FROM lines)),
walk(doc_id, line_no, depth) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, 0::BIGINT FROM lines
  UNION ALL SELECT w.doc_id, s.line_no, greatest(0, least(3, w.depth + s.step))::BIGINT FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.line_no = w.line_no + 1)
SELECT * FROM walk WHERE line_no > 0
"""


def _flags(t: Tables):
    """Path predicates of every file, side by side."""
    p = F.col("path")
    return t.source_files().select(
        "repo_id", "path",
        paths.in_skipped_dir(p).alias("skipped"),
        paths.in_complexity_skipped_dir(p).alias("skipped_cx"),
        paths.in_history_skipped_dir(p).alias("skipped_git"),
        paths.is_source_file(p).alias("is_source"),
        paths.is_pdn_target(p).alias("is_target"),
        paths.not_test_path(p).alias("not_test"),
        paths.is_test_file(p).alias("is_test"),
        paths.is_config_file(p).alias("is_config"),
        paths.is_doc_file(p).alias("is_doc"),
        paths.is_lockfile(p).alias("is_lockfile"),
        paths.suffix(p).alias("suffix"),
        paths.basename(p).alias("basename"),
        paths.stem(p).alias("stem"),
        paths.detect_language(p).alias("language"),
        paths.top_module(p).alias("module"),
    )


FLAGS = """
SELECT f.repo_id, f.path, folder IN ('node_modules/x/', '.github/') AS skipped, folder = 'node_modules/x/' AS skipped_cx,
  folder = 'node_modules/x/' AS skipped_git, ext <> '.txt' AS is_source, true AS is_target, NOT contains(lower(path), 'test') AS not_test,
  folder IN ('tests/', 'pkg/spec/') OR starts_with(stem, 'test_') AS is_test, ext = '.yaml' AS is_config, stem = 'README' AS is_doc, false AS is_lockfile,
  ext AS suffix, stem || ext AS basename, lower(stem) AS stem,
  CASE ext WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.md' THEN 'Markdown' WHEN '.java' THEN 'Java'
    WHEN '.go' THEN 'Go' WHEN '.sql' THEN 'SQL' WHEN '.rb' THEN 'Ruby' WHEN '.yaml' THEN 'YAML' END AS language,
  split_part(path, '/', 1) AS module FROM files f
"""


def _flag(*columns: str):
    names = ["repo_id", "path", *columns]
    return (lambda t: _flags(t).select(*names), oracle(f"SELECT {', '.join(names)} FROM ({FLAGS})"))


QUERIES = {
    "s1_source_files": (
        lambda t: t.source_files().select("repo_id", "path", "size_bytes"),
        oracle("SELECT repo_id, path, size_bytes FROM files"),
    ),
    "p1_skip_dirs": _flag("skipped"),
    "p2_skip_dirs_cx": _flag("skipped_cx"),
    "p3_skip_dirs_git": _flag("skipped_git"),
    "p4_is_source_file": _flag("is_source"),
    "p5_is_pdn_target": _flag("is_target"),
    "p6_size_cap": (
        lambda t: pdn.within_size(t.source_files(), 1048576).select("repo_id", "path"),
        oracle("SELECT repo_id, path FROM files WHERE size_bytes <= 1048576"),
    ),
    "p7_not_test_path": _flag("not_test"),
    "f9_suffix_stem_basename": _flag("suffix", "stem", "basename"),
    "f11_is_test_file": _flag("is_test"),
    "f12_is_config_file": _flag("is_config"),
    "f13_is_doc_file": _flag("is_doc"),
    "f14_is_lockfile": _flag("is_lockfile"),
    "u5_keys_intersect": _flag("is_test", "module"),
    "f15_count_lines": (
        lambda t: t.source_files().select("repo_id", "path", text.count_lines(F.col("content")).alias("lines")),
        oracle("""SELECT f.repo_id, f.path, count(s.path) AS lines FROM files f LEFT JOIN split_lines s ON s.repo_id = f.repo_id AND s.path = f.path
                  GROUP BY ALL"""),
    ),
    "a23_language_stats": (
        _languages,
        oracle(f"SELECT *, {share_sql('loc', 'sum(loc) OVER (PARTITION BY repo_id)')} AS percentage FROM repo_languages"),
    ),
    "a24_file_totals": (
        lambda t: fl.file_totals(_analysed(t)).drop("has_install_docs", "has_architecture_docs", "has_changelog", "has_runbook"),
        oracle("""SELECT repo_id, count(*) AS total_files, coalesce(sum(loc), 0)::BIGINT AS total_loc, sum(size_bytes)::BIGINT AS size_bytes,
                    count(*) FILTER (language IS NOT NULL AND NOT is_test AND NOT is_config) AS file_count_source,
                    count(*) FILTER (language IS NOT NULL AND is_test) AS file_count_test,
                    count(*) FILTER (language IS NOT NULL AND NOT is_test AND is_config) AS file_count_config,
                    count(*) FILTER (loc >= 500) AS large_files_count, coalesce(avg(loc), 0.0) AS avg_file_loc, false AS has_lockfile,
                    coalesce(sum(loc) FILTER (language = 'Markdown'), 0)::BIGINT AS doc_loc, coalesce(bool_or(is_doc), false) AS has_readme
                  FROM analysed GROUP BY repo_id"""),
    ),
    "a25_dir_count": (
        lambda t: fl.dir_count(t.source_files()),
        oracle("""SELECT repo_id, count(*) AS dir_count FROM (
                    SELECT DISTINCT repo_id, array_to_string(list_slice(parts, 1, n), '/') AS dir FROM (
                      SELECT repo_id, parts, unnest(generate_series(1, len(parts) - 1)) AS n
                      FROM (SELECT repo_id, string_split(path, '/') AS parts FROM files)))
                  WHERE dir NOT LIKE 'node_modules%' AND dir NOT LIKE '.github%' GROUP BY repo_id"""),
    ),
    "c1_file_profile": (
        lambda t: fl.file_profile(t.source_files()).select("repo_id", "total_files", "total_loc", "dir_count"),
        oracle("""SELECT a.repo_id, count(*) AS total_files, coalesce(sum(loc), 0)::BIGINT AS total_loc, any_value(dirs) AS dir_count FROM analysed a
                  JOIN (SELECT repo_id, count(DISTINCT d) AS dirs FROM (SELECT repo_id, array_to_string(list_slice(parts, 1, n), '/') AS d FROM (
                      SELECT repo_id, parts, unnest(generate_series(1, len(parts) - 1)) AS n
                      FROM (SELECT repo_id, string_split(path, '/') AS parts FROM files WHERE folder NOT IN ('node_modules/x/', '.github/')))) GROUP BY repo_id) d
                    ON d.repo_id = a.repo_id GROUP BY a.repo_id"""),
    ),
    "c1_doc_files": (
        lambda t: fl.doc_files(_analysed(t)),
        oracle("SELECT repo_id, path FROM analysed WHERE is_doc"),
    ),
    "c1_top_large_files": (
        lambda t: fl.top_large_files(fl.analysed_files(_code_trees(t))).withColumn("rank", F.col("rank").cast("long")),
        oracle(TREE_FILES + """SELECT repo_id, path, lines AS loc, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY lines DESC, path) AS rank
                  FROM tree WHERE lines >= 500) WHERE rank <= 10""", "lines", "scans"),
    ),
    "c3_primary_language": (
        lambda t: st.primary_language(_languages(t)),
        oracle("SELECT repo_id, arg_min(language, (-loc, language)) AS primary_language FROM repo_languages GROUP BY repo_id"),
    ),
    "w3_function_length": (
        lambda t: _tree_code(t).select("repo_id", "path", "lines", "large_functions", F.size("imports").cast("long").alias("imports")),
        oracle(TREE_FILES + "SELECT repo_id, path, lines, large_functions, imports FROM tree", "lines", "scans"),
    ),
    "w3_function_length_of_documents": (
        lambda t: _code(t).withColumn("imports", F.size("imports").cast("long")), oracle(PER_FILE),
    ),
    "a26_fan_out": (
        lambda t: cx.fan_out(_tree_code(t)),
        oracle(TREE_FILES + "SELECT repo_id, fan_out FROM fans", "lines", "scans"),
    ),
    "c2_complexity": (
        lambda t: cx.complexity(_tree_code(t)),
        oracle(TREE_FILES + """SELECT t.repo_id, count(*) FILTER (lines >= 500) AS files_above_threshold, sum(large_functions)::BIGINT AS functions_above_threshold,
             any_value(fan_out) AS fan_out FROM tree t JOIN fans f ON f.repo_id = t.repo_id GROUP BY t.repo_id""", "lines", "scans"),
    ),
    "c2_complexity_of_documents": (
        lambda t: cx.complexity(_code(t)),
        oracle(CODE_FILES + """SELECT p.repo_id, count(*) FILTER (lines >= 500) AS files_above_threshold,
             (SELECT count(*) FROM starts s WHERE s.repo_id = p.repo_id AND length >= 50) AS functions_above_threshold,
             (SELECT count(DISTINCT imp) FROM imports i WHERE i.repo_id = p.repo_id) AS fan_out
           FROM per_file p GROUP BY p.repo_id""", "files", "repo_languages", "split_lines"),
    ),
    "c4_project_type": _stack_column("project_type"),
    "c5_package_managers": _stack_column("package_managers"),
    "c6_frameworks": _stack_column("frameworks"),
    "c7_docker_ci": _stack_column("has_docker", "ci_provider"),
    "c8_linters_formatters": _stack_column("linters", "formatters"),
    "c9_infra_tools": _stack_column("has_kubernetes", "has_terraform", "has_helm", "infra_tools"),
    "w8_block_state": (_nested_blocks, NESTED.strip()),
    "c10_comment_split": (lambda t: cm.comment_split(t.source_files()), oracle(SPLIT)),
    "c11_pdn_findings": (
        lambda t: pdn.pdn_findings(t.source_files(), TYPES), oracle(_findings_sql("code", "code")),
    ),
    "c11_pdn_findings_with_comments": (
        lambda t: pdn.pdn_findings(t.source_files(), TYPES, include_comments=True),
        oracle(_findings_sql("code", "code") + " UNION ALL " + _findings_sql("comment", "comment")),
    ),
    "c11_pdn_findings_of_table": (
        lambda t: pdn.pdn_findings(t.source_files(), _item_words(t)), oracle(ITEM_WORDS),
    ),
    "j21_pdn_match": (
        lambda t: pdn.pdn_findings(t.source_files(), TYPES).groupBy("repo_id", "pdn_type", "matched_identifier").agg(F.count("*").alias("findings")),
        oracle(f"SELECT repo_id, pdn_type, matched_identifier, count(*) AS findings FROM ({_findings_sql('code', 'code')}) GROUP BY ALL"),
    ),
    "s5_pdn_types": (
        lambda t: tables.explode_types(
            t.raw("part").groupBy(F.col("p_brand").alias("name")).agg(
                F.array_distinct(F.collect_list(F.concat(F.lit(" "), F.when(F.col("p_size") % 10 != 0, F.col("p_type")).otherwise("")))).alias("identifiers"))),
        "SELECT DISTINCT p_brand AS pdn_type, p_type AS identifier FROM part WHERE p_size % 10 <> 0",
    ),
    "f19_classify_license_text": (
        lambda t: t.raw("documents").select("doc_id", classify_license_text(F.col("text")).alias("spdx")),
        f"SELECT doc_id, CASE {LICENCE_CASES} END AS spdx FROM (SELECT doc_id, text AS head FROM documents)",
    ),
}
