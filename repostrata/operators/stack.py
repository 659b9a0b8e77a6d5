"""Primary language, project type, tools and infrastructure of a repository.

All markers are tested in one pass over the files: each file raises the flags its
path or content proves, and one aggregate per repository collects them. Content
is only read for the few files whose text is a marker.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, paths
from ..functions.common import pick

# Files whose text decides something, and needles in that text.
TEXT_FILES = [
    "package.json", "pyproject.toml", "requirements.txt", "go.mod",
    "pom.xml", "build.gradle", "build.gradle.kts", "setup.cfg",
]
CI_FILES = [("bitbucket-pipelines.yml", "bitbucket"), (".gitlab-ci.yml", "gitlab"),
            (".github/workflows", "github_actions"), ("Jenkinsfile", "jenkins")]
CLI_FILES = ["cli.py", "main.py", "cmd/main.go", "src/cli.py", "src/main.py"]
SETUP_FILES = ["setup.py", "setup.cfg"]
FABRIC_PATHS = ["fabfile.py", "fabfile", "minifab"]
HELM_DIRS = ["helm", "charts"]


def primary_language(language_stats: DataFrame) -> DataFrame:
    """Most lines; ties go to the alphabetically first."""
    return language_stats.groupBy("repo_id").agg(
        F.min_by("language", F.struct(-F.col("loc"), F.col("language"))).alias("primary_language")
    )


def exists(*names: str) -> Column:
    """A file or directory of that path at the root of the repository."""
    path = F.col("path")
    return reduce(lambda a, b: a | b, [(path == n) | path.startswith(n + "/") for n in names])


def is_dir(name: str) -> Column:
    return F.col("path").startswith(name + "/")


def _flags() -> dict[str, Column]:
    """Per-file tests on the path alone."""
    name = paths.basename(F.col("path"))
    flags = {f"pm_{i}": exists(f) for i, (f, _) in enumerate(dims.PACKAGE_MANAGER_FILES)}
    flags |= {f"lint_{i}": exists(*f) for i, (f, _) in enumerate(dims.LINTER_FILES)}
    flags |= {f"fmt_{i}": exists(*f) for i, (f, _) in enumerate(dims.FORMATTER_FILES)}
    flags |= {f"ci_{i}": exists(f) for i, (f, _) in enumerate(CI_FILES)}
    flags |= {f"mono_{d}": is_dir(d) for d in dims.MONOREPO_DIRS}
    flags |= {
        "docker": exists(*dims.DOCKER_FILES),
        "cli": exists(*CLI_FILES),
        "setup": exists(*SETUP_FILES),
        "terraform": exists("terraform") | F.col("path").endswith(".tf"),
        "helm": exists(*HELM_DIRS) | (name == "Chart.yaml"),
        "fabric": exists(*FABRIC_PATHS),
        "kubernetes": F.col("path").endswith(".yaml")
        & F.col("content").contains("apiVersion:")
        & F.col("content").contains("kind:"),
    }
    return flags


def _text_flags() -> dict[str, Column]:
    """Per-file tests on the text of a root file."""
    path, text, lowered = F.col("path"), F.col("content"), F.col("lowered")

    def of(*names: str) -> Column:
        return path.isin(*names)

    def npm(key: str) -> Column:
        return of("package.json") & F.array_contains("npm_names", key)

    pyproject, python = of("pyproject.toml"), of("requirements.txt", "pyproject.toml")
    flags = {f"js_{i}": npm(k) for i, (k, _) in enumerate(dims.NPM_FRAMEWORKS)}
    flags |= {f"py_{i}": python & lowered.contains(k) for i, (k, _) in enumerate(dims.PYTHON_FRAMEWORKS)}
    flags |= {f"go_{i}": of("go.mod") & text.contains(k) for i, (k, _) in enumerate(dims.GO_FRAMEWORKS)}
    flags |= {
        f"jvm_{i}": of("pom.xml", "build.gradle", "build.gradle.kts") & lowered.contains(k)
        for i, (k, _) in enumerate(dims.JVM_FRAMEWORKS)
    }
    flags |= {
        "ruff": pyproject & text.contains("ruff"),
        "flake8_cfg": of("setup.cfg") & text.contains("[flake8]"),
        "mypy_toml": pyproject & text.contains("[mypy]"),
        "black": pyproject & text.contains("[tool.black]"),
        "isort": pyproject & text.contains("[tool.isort]"),
        "npm_library": of("package.json") & _has_value("$.main", "$.exports"),
        "poetry_library": pyproject & text.contains("[tool.poetry]") & text.contains("packages"),
    }
    return flags


def _npm_names() -> Column:
    """Packages named by a package.json, read once per file."""
    sections = [
        F.map_keys(F.from_json(F.get_json_object("content", f"$.{s}"), "map<string,string>"))
        for s in ("dependencies", "devDependencies")
    ]
    none = F.array().cast("array<string>")
    both = F.concat(*[F.coalesce(s, none) for s in sections])
    return F.when(F.col("path") == "package.json", both)


def _has_value(*json_paths: str) -> Column:
    values = [F.get_json_object("content", p) for p in json_paths]
    return reduce(
        lambda a, b: a | b,
        [F.coalesce(~v.isin("", "false", "0", "null", "{}", "[]"), F.lit(False)) for v in values],
    )


def stack_flags(source_files: DataFrame) -> DataFrame:
    """One row per repository with every marker as a boolean."""
    by_path = source_files.groupBy("repo_id").agg(
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in _flags().items()]
    )
    by_text = (
        source_files.filter(F.col("path").isin(*TEXT_FILES))
        .select("repo_id", "path", "content", F.lower("content").alias("lowered"), _npm_names().alias("npm_names"))
        .groupBy("repo_id")
        .agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in _text_flags().items()])
    )
    return by_path.join(by_text, "repo_id", "left").fillna(False)


def _named(prefix: str, table: list) -> list[tuple[Column, Column]]:
    return [(F.col(f"{prefix}_{i}"), F.lit(name)) for i, (_, name) in enumerate(table)]


def _has_language(names: list[str]) -> Column:
    return F.exists("languages", lambda l: l.isin(*names))


def project_type() -> Column:
    """C4: first rule that holds."""
    front, back = _has_language(dims.FRONTEND_LANGUAGES), _has_language(dims.BACKEND_LANGUAGES)
    infra = _has_language(dims.INFRA_LANGUAGES)
    groups = reduce(lambda a, b: a + b, [F.col(f"mono_{d}").cast("int") for d in dims.MONOREPO_DIRS])
    library = F.col("setup") | F.col("npm_library") | F.col("poetry_library")
    return (
        F.when(groups >= 2, "monorepo")
        .when(infra & ~back & ~front, "infra_config")
        .when(front & ~back, "frontend_application")
        .when(back & ~front & F.col("cli"), "cli_tool")
        .when(back & ~front & library, "library")
        .when(back & ~front, "backend_service")
        .when(back & front, "monolith")
        .otherwise("unknown")
    )


def stack(source_files: DataFrame, language_stats: DataFrame) -> DataFrame:
    """One row per repository."""
    languages = language_stats.groupBy("repo_id").agg(
        F.min_by("language", F.struct(-F.col("loc"), F.col("language"))).alias("primary_language"),
        F.collect_set("language").alias("languages"),
    )
    flags = (
        stack_flags(source_files)
        .join(languages, "repo_id", "left")
        .withColumn("languages", F.coalesce("languages", F.array().cast("array<string>")))
    )
    frameworks = pick(
        _named("js", dims.NPM_FRAMEWORKS)
        + _named("py", dims.PYTHON_FRAMEWORKS)
        + _named("go", dims.GO_FRAMEWORKS)
        + _named("jvm", dims.JVM_FRAMEWORKS)
    )
    linters = pick(
        _named("lint", dims.LINTER_FILES)
        + [
            (F.col("ruff"), F.lit("Ruff")),
            (F.col("flake8_cfg"), F.lit("Flake8")),
            (F.col("mypy_toml"), F.lit("MyPy")),
        ]
    )
    formatters = pick(
        _named("fmt", dims.FORMATTER_FILES)
        + [(F.col("black"), F.lit("Black")), (F.col("isort"), F.lit("isort"))]
    )
    infra = pick([(F.col(n), F.lit(n)) for n in ("terraform", "kubernetes", "helm", "fabric")])
    ci = F.coalesce(*[F.when(F.col(f"ci_{i}"), F.lit(name)) for i, (_, name) in enumerate(CI_FILES)])
    return flags.select(
        "repo_id",
        "primary_language",
        project_type().alias("project_type"),
        F.array_distinct(frameworks).alias("frameworks"),
        pick(_named("pm", dims.PACKAGE_MANAGER_FILES)).alias("package_managers"),
        ci.alias("ci_provider"),
        F.col("docker").alias("has_docker"),
        F.col("kubernetes").alias("has_kubernetes"),
        F.col("terraform").alias("has_terraform"),
        F.col("helm").alias("has_helm"),
        infra.alias("infra_tools"),
        F.array_distinct(linters).alias("linters"),
        formatters.alias("formatters"),
    )
