"""Licences of the dependencies.

Each reader gives (repo_id, name, ecosystem, license struct, is_direct) rows with
the rank of its source and an order inside it; W9 keeps the best row per package.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, text
from ..functions.common import blank_to_null, strip
from ..functions.licensing import (
    LICENSE_INFO,
    classify_license_text,
    classify_risk,
    first_trove,
    known_license,
    license_field_text,
    license_info,
    normalise_spdx,
    trove_to_spdx,
)
from ..session import cut, stored
from . import manifests as m
from .lookup import lookup

KEY = ["repo_id", "name", "ecosystem"]
GEM_LOCK_NOTE = "License not recorded in Gemfile.lock; requires API enrichment"
PRIVATE_NOTE = "Private/internal package"


def _source(rows: DataFrame, ecosystem: str, rank: int, name: Column, lic: Column, seq: Column,
            is_direct: Column | None = None) -> DataFrame:
    return rows.select(
        "repo_id",
        name.alias("name"),
        F.lit(ecosystem).alias("ecosystem"),
        lic.alias("license"),
        (F.lit(True) if is_direct is None else is_direct).alias("is_direct"),
        F.lit(rank).alias("source_rank"),
        seq.alias("source_seq"),
    )


def _at(*parts) -> Column:
    """Order inside a source: (path, position)."""
    path, pos = (list(parts) + [F.lit(0)])[:2]
    return F.struct(path.alias("path"), pos.cast("long").alias("pos"))


def pyproject_license(source_files: DataFrame, toml: DataFrame | None = None) -> DataFrame:
    """L1: the project's own licence field, else the first known classifier."""
    files = m.toml_files(source_files, "pyproject.toml") if toml is None else toml.filter(
        F.col("path") == "pyproject.toml"
    )
    field = F.get_json_object("content", "$.project.license")
    raw = F.when(
        field.startswith("{"),
        F.coalesce(
            blank_to_null(F.get_json_object(field, "$.text")),
            blank_to_null(F.get_json_object(field, "$.file")),
        ),
    ).otherwise(blank_to_null(field))
    classifiers = m.json_list("$.project.classifiers", "string")
    chosen = F.get(F.filter(classifiers, lambda c: trove_to_spdx(c).isNotNull()), F.lit(0))
    lic = F.when(
        raw.isNull() & chosen.isNotNull(),
        known_license(trove_to_spdx(chosen), chosen, "high", "manifest"),
    ).otherwise(license_info(raw, "medium", "manifest"))
    name = F.get_json_object("content", "$.project.name")
    return _source(files.filter(F.coalesce(name, F.lit("")) != ""), "pip", 1, name, lic, _at(F.col("path")))


POM_SELF = (
    "struct<groupId:string,artifactId:string,parent:struct<groupId:string>,"
    "licenses:struct<license:array<struct<name:string>>>>"
)


def pom_licenses(source_files: DataFrame) -> DataFrame:
    """L2: every pom.xml of the tree names itself and its first licence."""
    files = m.pom_files(source_files, root_only=False).withColumn(
        "pom", F.from_xml("content", POM_SELF, m.XML_OPTIONS)
    )
    group = F.coalesce(
        blank_to_null(F.col("pom.groupId")), blank_to_null(F.col("pom.parent.groupId")), F.lit("")
    )
    raw = F.get(F.col("pom.licenses.license"), F.lit(0))["name"]
    lic = license_info(raw, "medium", "manifest")
    named = files.filter(F.coalesce(F.col("pom.artifactId"), F.lit("")) != "")
    return _source(
        named, "maven", 2, F.concat(group, F.lit(":"), F.col("pom.artifactId")), lic, _at(F.col("path"))
    )


def gemfile_lock_placeholders(source_files: DataFrame) -> DataFrame:
    """L3."""
    null = F.lit(None).cast("string")
    lic = known_license(null, null, "unknown", "lockfile", GEM_LOCK_NOTE)
    return _source(
        m.gemfile_lock(source_files), "bundler", 3, F.col("name"), lic,
        _at(F.col("manifest_file"), F.col("item_seq")),
    )


def gemspec_licenses(source_files: DataFrame) -> DataFrame:
    """L4: vendored gem specifications."""
    files = source_files.filter(F.col("path").rlike(r"^vendor/gems/(.*/)?[^/]*\.gemspec$"))
    name = F.regexp_extract("content", r"\.name\s*=\s*[\"']([^\"']+)[\"']", 1)
    raw = blank_to_null(F.regexp_extract("content", r"\.license\s*=\s*[\"']([^\"']+)[\"']", 1))
    return _source(
        files.filter(name != ""), "bundler", 4, name,
        license_info(raw, "medium", "vendor_gemspec"), _at(F.col("path")),
    )


def npm_lock_licenses(source_files: DataFrame) -> DataFrame:
    """Licence fields of package-lock.json; in version 1 the first entry counts."""
    rows = m.npm_lock_packages(source_files).select(
        "repo_id", "path", "direct_names", "is_v1", F.posexplode_outer("packages").alias("pos", "p")
    ).filter(F.col("pos").isNotNull())
    order = F.when(F.col("is_v1"), -F.col("pos")).otherwise(F.col("pos"))
    lic = license_info(license_field_text(F.col("p.license")), "high", "lockfile")
    direct = F.col("p.top") & F.array_contains("direct_names", F.col("p.name"))
    return _source(rows, "npm", 5, F.col("p.name"), lic, _at(F.col("path"), order), direct)


def cargo_vendor_licenses(source_files: DataFrame) -> DataFrame:
    """vendor/<crate>/Cargo.toml."""
    files = source_files.filter(F.col("path").rlike(r"^vendor/[^/]+/Cargo\.toml$")).select(
        "repo_id", "path", m.toml_to_json("content").alias("content")
    ).filter(F.col("content").isNotNull())
    name = F.get_json_object("content", "$.package.name")
    raw = F.get_json_object("content", "$.package.license")
    return _source(
        files.filter(F.coalesce(name, F.lit("")) != ""), "cargo", 6, name,
        license_info(raw, "high", "vendor_manifest"), _at(F.col("path")),
    )


def go_vendor_licenses(source_files: DataFrame) -> DataFrame:
    """Modules of vendor/modules.txt with the text of their licence file.

    The licence file is found by joining module directories to the directories of
    licence files; among the accepted names the first one wins.
    """
    lines = F.filter(
        text.text_lines(F.col("content")), lambda l: l.startswith("# ") & (strip(F.substring(l, 3, 1 << 20)) != "")
    )
    modules = source_files.filter(F.col("path") == "vendor/modules.txt").select(
        "repo_id",
        F.explode(F.array_distinct(F.transform(
            lines, lambda l: F.get(F.split(strip(F.regexp_replace(l, "^# ", "")), r"\s+"), F.lit(0))
        ))).alias("module"),
    )
    parts = F.split("path", "/")
    rank = F.array_position(F.array(*[F.lit(n) for n in dims.LICENSE_FILE_NAMES]), F.element_at(parts, -1))
    texts = (
        source_files.filter(
            F.col("path").startswith("vendor/")
            & F.element_at(parts, -1).isin(*dims.LICENSE_FILE_NAMES)
        )
        .select(
            "repo_id",
            F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 2), "/").alias("module"),
            classify_license_text(F.col("content")).alias("spdx"),
            rank.alias("rank"),
        )
        .groupBy("repo_id", "module")
        .agg(F.min_by("spdx", "rank").alias("spdx"))
    )
    null = F.lit(None).cast("string")
    return _source(
        modules.join(texts, ["repo_id", "module"]), "go", 7, F.col("module"),
        known_license(F.col("spdx"), null, "medium", "license_file"), _at(F.col("module")),
    )


def dist_info_licenses(source_files: DataFrame) -> DataFrame:
    """Installed package metadata, classifiers before the licence header."""
    files = source_files.filter(
        F.col("path").rlike(r"^(venv|\.venv|env|\.env)/lib/python[^/]*/site-packages/[^/]*\.dist-info/METADATA$")
    )
    # Headers end at the first empty line after the name.
    head = F.regexp_extract(
        text.unix_newlines(F.col("content")), r"(?s)^(.*?^Name:[^\n]*(?:\n.*?)?)(?:\n\n|\z)".replace("^Name", "(?m:^)Name"), 1
    )

    def last(header: str) -> Column:
        found = F.regexp_extract_all(F.col("head"), F.lit(rf"(?m)^{header}:([^\n]*)$"), F.lit(1))
        return F.when(F.size(found) > 0, strip(F.element_at(found, -1)))

    rows = files.select("repo_id", "path", head.alias("head")).select(
        "repo_id",
        "path",
        F.translate(F.lower(last("Name")), "_.", "--").alias("name"),
        last("License").alias("raw"),
        F.transform(
            F.regexp_extract_all(F.col("head"), F.lit(r"(?m)^Classifier:([ \t]*License[^\n]*)$"), F.lit(1)), strip
        ).alias("classifiers"),
    ).filter(F.coalesce(F.col("name"), F.lit("")) != "")
    spdx = first_trove(F.col("classifiers"))
    lic = F.when(
        spdx.isNotNull(), known_license(spdx, F.col("raw"), "high", "dist_info")
    ).otherwise(license_info(F.col("raw"), "high", "dist_info"))
    return _source(rows, "pip", 8, F.col("name"), lic, _at(F.col("path")))


def license_precedence(*sources: DataFrame) -> DataFrame:
    """Per package the row of the highest source, the last one inside it."""
    rows = reduce(lambda a, b: a.unionByName(b), sources)
    order = F.struct("source_rank", "source_seq")
    return rows.groupBy(*KEY).agg(
        F.max_by(F.struct("license", "is_direct"), order).alias("_l")
    ).select(*KEY, "_l.*")


def license_files(source_files: DataFrame) -> DataFrame:
    """The files that any licence source reads, stored once for its eight readers."""
    path = F.col("path")
    wanted = (
        m.is_manifest(path)
        | path.endswith("/pom.xml")
        | path.rlike(r"^vendor/(gems/.*\.gemspec|[^/]+/Cargo\.toml|modules\.txt)$")
        | (path.startswith("vendor/") & F.substring_index(path, "/", -1).isin(*dims.LICENSE_FILE_NAMES))
        | path.rlike(r"\.dist-info/METADATA$")
    )
    return stored(source_files.filter(wanted).select("repo_id", "path", "content"))


def repository_licenses(source_files: DataFrame) -> DataFrame:
    """Offline licences of every package of every repository (of `license_files`)."""
    return license_precedence(
        pyproject_license(source_files), pom_licenses(source_files),
        gemfile_lock_placeholders(source_files), gemspec_licenses(source_files),
        npm_lock_licenses(source_files), cargo_vendor_licenses(source_files),
        go_vendor_licenses(source_files), dist_info_licenses(source_files),
    )


def license_lookup(deps: DataFrame, licenses: DataFrame, normalise_pip: bool = False) -> DataFrame:
    """Dependencies with licence columns, placeholders when unknown.

    Installed pip packages have normalised names; `normalise_pip` compares pip
    names in that form, without it names must be equal.
    """
    name = F.col("name")
    key = (
        F.when(F.col("ecosystem") == "pip", F.translate(F.lower(name), "_.", "--")).otherwise(name)
        if normalise_pip
        else name
    )
    found = licenses.select(
        "repo_id", key.alias("_key"), "ecosystem", "license", F.col("is_direct").alias("_direct")
    )
    if normalise_pip:
        found = found.groupBy("repo_id", "_key", "ecosystem").agg(
            F.max_by(F.struct("license", "_direct"), "_direct").alias("_f")
        ).select("repo_id", "_key", "ecosystem", "_f.*")
    joined = deps.withColumn("_key", key).join(found, ["repo_id", "_key", "ecosystem"], "left")
    private = F.when(F.col("is_private"), F.lit(PRIVATE_NOTE))
    lic = F.col("license")
    return joined.select(
        *[c for c in deps.columns if c != "is_direct"],
        F.coalesce("_direct", F.lit(True)).alias("is_direct"),
        *_license_columns(lic, private),
    )


def _license_columns(lic: Column, missing_note: Column) -> list[Column]:
    return [
        lic["spdx"].alias("license_spdx"),
        lic["raw"].alias("license_raw"),
        F.coalesce(lic["risk"], F.lit("unknown")).alias("license_risk"),
        lic["expression"].alias("license_expression"),
        F.coalesce(lic["confidence"], F.lit("unknown")).alias("license_confidence"),
        lic["source"].alias("license_source"),
        F.when(lic.isNull(), missing_note).otherwise(lic["notes"]).alias("license_notes"),
    ]


def registry_license() -> Column:
    """Licence struct of one registry row (ecosystem, license_raw, classifiers, licenses).

    pip prefers classifiers to the text; gems with several licences join them.
    """
    many = F.size("licenses") > 1
    gem_raw = F.when(many, F.array_join("licenses", " OR ")).otherwise(F.get("licenses", F.lit(0)))
    is_gem, is_pip = F.col("ecosystem") == "bundler", F.col("ecosystem") == "pip"
    raw = F.when(is_gem, gem_raw).otherwise(blank_to_null(F.col("license_raw")))
    norm = normalise_spdx(raw)
    trove = F.when(is_pip, first_trove(F.col("classifiers")))
    spdx = F.coalesce(trove, norm["spdx"])
    expression = F.when(trove.isNull(), norm["expression"])
    return F.struct(
        spdx.alias("spdx"),
        raw.alias("raw"),
        classify_risk(spdx).alias("risk"),
        F.when(is_gem & many, F.coalesce(expression, raw)).otherwise(expression).alias("expression"),
        F.lit("high").alias("confidence"),
        F.lit("api_enrichment").alias("source"),
        F.when(is_gem, F.when(many, F.lit("Dual-licensed gem")))
        .when(trove.isNull(), norm["notes"])
        .alias("notes"),
    ).cast(LICENSE_INFO)


def registry_fallback(deps: DataFrame, registry: DataFrame, parts: int | None = None) -> DataFrame:
    """Unknown licences are looked up in a table of registry answers.

    Applies to public packages of the five registry ecosystems; Maven packages
    need a version and a group. `is_direct` of the dependency is kept. Packages that
    many repositories use are dealt over several tasks (`lookup`).
    """
    wanted = (
        (F.col("license_risk") == "unknown")
        & F.col("ecosystem").isin(*dims.REGISTRY_ECOSYSTEMS)
        & ~F.col("is_private")
        & (
            (F.col("ecosystem") != "maven")
            | (F.col("name").contains(":") & (F.coalesce(F.col("version"), F.lit("")) != ""))
        )
    )
    # one answer per package; only Maven asks by version
    by_version = F.when(F.col("ecosystem") == "maven", F.col("version")).otherwise("")
    answers = registry.withColumn("license", registry_license()).groupBy("ecosystem", "name", by_version.alias("_version")).agg(
        F.max_by("license", "version").alias("_answer")
    )
    asking = cut(deps.withColumn("_version", by_version))
    joined = lookup(asking, answers, ["ecosystem", "name", "_version"], wanted, parts)
    answer = F.col("_answer")
    columns = {
        "license_spdx": "spdx", "license_raw": "raw", "license_risk": "risk",
        "license_expression": "expression", "license_confidence": "confidence",
        "license_source": "source", "license_notes": "notes",
    }
    return joined.select(
        *[
            F.when(answer.isNotNull(), answer[columns[c]]).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in deps.columns
        ]
    )
