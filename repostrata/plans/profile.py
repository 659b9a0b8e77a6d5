"""The scan as one batch job: files, logs and configuration in, fact tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import complexity as cx
from ..operators import contributions as co
from ..operators import files as fl
from ..operators import licences as li
from ..operators import manifests as ma
from ..operators import pdn, risks, scores
from ..operators import stack as st
from ..session import cut


def repo_facts(source_files: DataFrame, commits: DataFrame, overrides: DataFrame | None = None) -> dict[str, DataFrame]:
    """The wide row per repository and the tables it is built from.

    Repositories come from the files; one without commits keeps null shares, so
    the bus-factor rule still sees it.
    """
    files = cut(fl.analysed_files(source_files))
    languages = fl.language_stats(files)
    code = cx.complexity_files(source_files, languages)
    contribs = co.contributions(commits, overrides)
    facts = (
        fl.file_totals(files)
        .join(fl.dir_count(source_files), "repo_id", "left")
        .join(cx.complexity(code), "repo_id", "left")
        .join(st.stack(source_files, languages), "repo_id", "left")
        .join(co.top_shares(contribs), "repo_id", "left")
        .fillna(0, ["dir_count", "files_above_threshold", "functions_above_threshold", "fan_out"])
    )
    return {"facts": facts, "files": files, "languages": languages, "code": code, "contributions": contribs}


def profile(source_files: DataFrame, commits: DataFrame, pdn_types: list[tuple[str, str]],
            overrides: DataFrame | None = None, registry: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every fact table of the portfolio; write each with `append_facts`.

    The files table is read by four jobs: line counts (kept without the text), the
    few manifests and licence files (kept with it), code lines, and personal data.
    """
    named = co.with_identity(commits, overrides)
    base = repo_facts(source_files, commits, overrides)
    modules = co.module_contributions(commits, overrides)
    all_languages = co.language_contributions(commits, overrides=overrides)
    contribs = base["contributions"]
    special = li.license_files(source_files)
    inventory = ma.dedup_dependencies(ma.all_dependencies(special))
    deps = li.license_lookup(inventory, li.repository_licenses(special))
    if registry is not None:
        deps = li.registry_fallback(deps, registry)
    largest = fl.top_large_files(base["code"], "lines")
    found_risks = risks.all_risks(
        risks.repo_risks(base["facts"]),
        risks.mono_owner_risks(co.owner_shares(all_languages, "language"), "language"),
        risks.mono_owner_risks(co.owner_shares(modules, "module"), "module"),
        risks.high_complexity_modules(risks.module_avg_loc(fl.large_files(base["code"], "lines"))),
        risks.orphan_module_risks(risks.orphan_modules(modules, contribs)),
    )
    return {
        "facts": base["facts"],
        "languages": base["languages"].withColumn("percentage", F.bround("percentage", 2)),
        "large_files": largest,
        "dependencies": deps,
        "contributions": contribs,
        "language_contributions": all_languages.join(
            base["languages"].select("repo_id", "language"), ["repo_id", "language"], "left_semi"
        ),
        "module_contributions": modules,
        "developer_daily": co.developer_daily(named),
        "repository_daily": co.repo_daily(named),
        "scores": scores.scorecard(base["facts"]),
        "risks": found_risks,
        "personal_data": pdn.pdn_findings(source_files, pdn_types),
    }
