"""The risks of a repository.

Rules over the wide `repo_facts` row are one array expression that is exploded
once; rules over owners, large files and modules work on their aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from .scores import test_ratio

COLUMNS = ["repo_id", "risk_type", "severity", "title", "entity_type", "entity_ref"]


def _risk(risk_type, severity, title, entity_type="project", entity_ref=None) -> Column:
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v).cast("string")

    return F.struct(
        lit(risk_type).alias("risk_type"),
        lit(severity).alias("severity"),
        lit(title).alias("title"),
        lit(entity_type).alias("entity_type"),
        lit(entity_ref).alias("entity_ref"),
    )


def _percent(x: Column) -> Column:
    """Share as whole percent, half to even."""
    return F.concat(F.bround(x * 100, 0).cast("long").cast("string"), F.lit("%"))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def tests_rule() -> Column:
    """K1."""
    return F.when(
        F.col("file_count_test") == 0, _risk("no_tests", "high", "No test files detected")
    ).when(
        test_ratio() < 0.05,
        _risk("no_tests", "medium", "Very low test coverage (< 5% test files)"),
    )


def documentation_rule() -> Column:
    """K2."""
    return F.when(
        F.col("doc_loc") == 0,
        _risk("weak_documentation", "medium", "No documentation files detected"),
    ).when(F.col("doc_loc") < 30, _risk("weak_documentation", "low", "Minimal documentation"))


def ci_rule() -> Column:
    """K3."""
    return F.when(
        F.col("ci_provider").isNull(),
        _risk("no_ci_pipeline", "high", "No CI/CD pipeline configuration found"),
    )


def lockfile_rule() -> Column:
    """K4."""
    locking = F.exists("package_managers", lambda m: m.rlike("|".join(dims.LOCKFILE_MANAGERS)))
    return F.when(
        locking & ~F.col("has_lockfile"),
        _risk("no_lockfile", "medium", "No dependency lockfile found"),
    )


def oversized_file_rule() -> Column:
    """K5."""
    files = F.col("files_above_threshold")
    title = _text(files.cast("string"), " files exceed 500 lines")
    return F.when(files >= 20, _risk("oversized_file", "high", title)).when(
        files >= 5, _risk("oversized_file", "medium", title)
    )


def oversized_function_rule() -> Column:
    """K6."""
    functions = F.col("functions_above_threshold")
    title = _text(functions.cast("string"), " functions exceed 50 lines")
    return F.when(functions >= 10, _risk("oversized_function", "medium", title))


def concentration_rule() -> Column:
    """K7."""
    top1, top2 = F.col("top1_share"), F.col("top2_share")
    owner = F.col("top_developer")
    return F.when(
        top1 > dims.TOP1_SHARE,
        _risk(
            "knowledge_concentration",
            "high",
            _text("High knowledge concentration: ", owner, " owns ", _percent(top1), " of commits"),
            "developer",
            owner,
        ),
    ).when(
        (top2 > dims.TOP2_SHARE) & (F.col("developers") >= 2),
        _risk(
            "knowledge_concentration",
            "medium",
            _text("Top 2 developers own ", _percent(top2), " of commits"),
        ),
    )


def bus_factor_rule() -> Column:
    """K8: a repository without developers counts as one."""
    developers = F.coalesce(F.col("developers"), F.lit(0))
    return F.when(
        developers <= 1,
        _risk("low_bus_factor", "critical", "Bus factor = 1: only one contributor found"),
    ).when(
        developers == 2,
        _risk("low_bus_factor", "medium", "Bus factor = 2: only two contributors"),
    )


REPO_RULES = {
    "no_tests": tests_rule,
    "weak_documentation": documentation_rule,
    "no_ci_pipeline": ci_rule,
    "no_lockfile": lockfile_rule,
    "oversized_file": oversized_file_rule,
    "oversized_function": oversized_function_rule,
    "knowledge_concentration": concentration_rule,
    "low_bus_factor": bus_factor_rule,
}


def repo_risks(repo_facts: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """K1-K8: every rule on the wide row."""
    chosen = [REPO_RULES[r]() for r in (rules or REPO_RULES)]
    fired = F.filter(F.array(*chosen), lambda r: r.isNotNull())
    return repo_facts.select("repo_id", F.inline(fired))


def mono_owner_risks(owners: DataFrame, key: str) -> DataFrame:
    """K9 (`language`, 3 changes at least) and K10 (`module`, 5 at least)."""
    least = {"language": 3, "module": 5}[key]
    share = _percent(F.col("owner_share"))
    title = {
        "language": _text(F.col("top_owner"), " is sole owner of ", F.col(key), " (", share, " of changes)"),
        "module": _text(F.col("top_owner"), " is sole owner of module '", F.col(key), "' (", share, ")"),
    }[key]
    return owners.filter(
        (F.col("owner_share") > dims.MONO_OWNER_SHARE) & (F.col("total") >= least)
    ).select("repo_id", _risk(f"mono_owner_{key}", "medium", title, key, F.col(key)).alias("r")).select(
        "repo_id", "r.*"
    )


def module_avg_loc(large_files: DataFrame, lines: str = "lines") -> DataFrame:
    """Files and mean lines of each module, over all its large files."""
    parts = F.split("path", "/")
    return (
        large_files.filter((F.size(parts) > 1) & (F.get(parts, F.lit(0)) != ""))
        .groupBy("repo_id", F.get(parts, F.lit(0)).alias("module"))
        .agg(F.count("*").alias("files"), F.sum(lines).alias("total_lines"))
        .withColumn("avg_lines", F.col("total_lines") / F.col("files"))
    )


def high_complexity_modules(modules: DataFrame) -> DataFrame:
    """K11."""
    whole = F.floor(F.col("avg_lines")).cast("string")
    title = _text("Module '", F.col("module"), "' has high average file size (", whole, " LOC avg)")
    return (
        modules.filter((F.col("files") >= 3) & (F.col("avg_lines") > 400))
        .select("repo_id", _risk("high_complexity_module", "high", title, "module", F.col("module")).alias("r"))
        .select("repo_id", "r.*")
    )


def orphan_modules(module_rows: DataFrame, contribs: DataFrame) -> DataFrame:
    """Modules none of whose users was active in the 180 days before the latest commit.

    One aggregate per module decides it, instead of an anti-join of two sets: the
    latest activity of the users who touched the module against the repository's.
    """
    active = contribs.select("repo_id", "username", "last_commit_at")
    latest = contribs.groupBy("repo_id").agg(F.max("last_commit_at").alias("latest"))
    return (
        module_rows.select("repo_id", "username", "module")
        .join(active, ["repo_id", "username"])
        .groupBy("repo_id", "module")
        .agg(F.max("last_commit_at").alias("last_active"))
        .join(latest, "repo_id")
        .filter(
            (F.col("module") != "")
            & (F.col("last_active") < F.col("latest") - F.expr(f"interval {dims.ORPHAN_DAYS} days"))
        )
        .select("repo_id", "module", "last_active")
    )


def orphan_module_risks(orphans: DataFrame) -> DataFrame:
    """K12."""
    title = _text("Module '", F.col("module"), "' has no commits in the last 6 months")
    return orphans.select(
        "repo_id", _risk("orphan_module", "medium", title, "module", F.col("module")).alias("r")
    ).select("repo_id", "r.*")


def all_risks(*parts: DataFrame) -> DataFrame:
    """U2."""
    return reduce(lambda a, b: a.unionByName(b), [p.select(*COLUMNS) for p in parts])


def severity_rank(severity: Column) -> Column:
    """Order by weight; the raw string order is alphabetical."""
    rank = F.lit(0)
    for name, value in dims.SEVERITY_RANK.items():
        rank = F.when(severity == name, value).otherwise(rank)
    return rank
