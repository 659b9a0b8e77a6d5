"""Dependencies from manifests and lockfiles.

One job over the files table. A manifest is one row; its entries are found with
JSON, XML and regular-expression functions inside the row and exploded once. The
only Python stage turns TOML into JSON. Broken files give no rows.

Each reader returns columns `repo_id` plus ENTRY, and carries `parser_seq` and
`item_seq`, which decide between two entries of equal quality (W2).
"""

from __future__ import annotations

import json
import re
import tomllib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import dims, text
from ..functions.common import blank_to_null, strip
from ..functions.scalars import requirement_name, requirement_version
from ..session import stored

ENTRY = (
    "array<struct<name:string,version:string,dep_type:string,is_direct:boolean,is_optional:boolean>>"
)
COLUMNS = [
    "repo_id", "name", "version", "dep_type", "manifest_file", "ecosystem", "is_direct",
    "is_optional", "is_private", "discovery_mode", "package_manager", "parser_seq", "item_seq",
]


def _entry(name, version, dep_type="prod", is_direct=None, is_optional=None) -> Column:
    kind = dep_type if isinstance(dep_type, Column) else F.lit(dep_type)
    return F.struct(
        name.alias("name"),
        version.cast("string").alias("version"),
        kind.alias("dep_type"),
        (F.lit(True) if is_direct is None else is_direct).alias("is_direct"),
        (F.lit(False) if is_optional is None else is_optional).alias("is_optional"),
    )


def _rows(files: DataFrame, entries: Column, seq: int, ecosystem: str, mode: str, manager=None,
          manifest=None) -> DataFrame:
    """Explode the entries of each file and add the constant columns."""
    pm = manager if isinstance(manager, Column) else F.lit(manager).cast("string")
    listed = files.select(
        "repo_id",
        (F.col("path") if manifest is None else manifest).alias("manifest_file"),
        pm.alias("package_manager"),
        entries.cast(ENTRY).alias("entries"),
    )
    # The outer form, because the plain one parses every file a second time to
    # test for emptiness.
    return (
        listed.select("repo_id", "manifest_file", "package_manager", F.posexplode_outer("entries").alias("item_seq", "e"))
        .filter(F.col("item_seq").isNotNull())
        .select(
            "repo_id",
            "e.name",
            "e.version",
            "e.dep_type",
            "manifest_file",
            F.lit(ecosystem).alias("ecosystem"),
            "e.is_direct",
            "e.is_optional",
            F.lit(False).alias("is_private"),
            F.lit(mode).alias("discovery_mode"),
            "package_manager",
            F.lit(seq).alias("parser_seq"),
            F.col("item_seq").cast("long").alias("item_seq"),
        )
    )


#: Folder of a stored manifest: its name, or one for project files anywhere in the tree.
KIND, PROJECTS = "manifest_kind", "projects"


def _of_kind(source_files: DataFrame, *kinds: str) -> DataFrame:
    """Only the folders of some kinds, where the files are `manifest_files`."""
    return source_files.filter(F.col(KIND).isin(*kinds)) if KIND in source_files.columns else source_files


def at_root(source_files: DataFrame, *names: str) -> DataFrame:
    return _of_kind(source_files, *names).filter(F.col("path").isin(*names)).select("repo_id", "path", "content")


def _well_formed_json(files: DataFrame) -> DataFrame:
    return files.filter(F.try_parse_json("content").isNotNull())


def json_map(path: str, values: str = "string", content: Column | str = "content") -> Column:
    """Object at a JSON path as map entries, empty when missing."""
    raw = F.get_json_object(content, path)
    parsed = F.from_json(raw, f"map<string,{values}>")
    return F.coalesce(
        F.map_entries(parsed), F.array().cast(f"array<struct<key:string,value:{values}>>")
    )


def json_list(path: str, item: str, content: Column | str = "content") -> Column:
    raw = F.get_json_object(content, path)
    return F.coalesce(F.from_json(raw, f"array<{item}>"), F.array().cast(f"array<{item}>"))


def _plain_entries(pairs: Column, kind: str, optional: Column | None = None) -> Column:
    """Name to version pairs as entries of one type."""
    return F.transform(pairs, lambda e: _entry(e["key"], e["value"], kind, None, optional))


def _named_entries(items: Column, kind: str) -> Column:
    """Objects with name and version as entries of one type."""
    named = F.filter(items, lambda p: F.coalesce(p["name"], F.lit("")) != "")
    return F.transform(named, lambda p: _entry(p["name"], p["version"], kind))


# --- manifests ---------------------------------------------------------------


def package_json(source_files: DataFrame) -> DataFrame:
    """M1."""
    sections = [("dependencies", "prod", F.lit(False)), ("devDependencies", "dev", F.lit(False)),
                ("peerDependencies", "prod", F.lit(False)), ("optionalDependencies", "prod", F.lit(True))]
    entries = F.concat(*[_plain_entries(json_map(f"$.{n}"), kind, opt) for n, kind, opt in sections])
    return _rows(_well_formed_json(at_root(source_files, "package.json")), entries, 1, "npm", "declared_only")


def requirements(source_files: DataFrame) -> DataFrame:
    """The file name gives the type; files are read in a fixed order."""
    files = at_root(source_files, *dims.REQUIREMENT_FILES)
    kind = F.when(F.col("path").contains("dev"), "dev").when(
        F.col("path").contains("test"), "test"
    ).otherwise("prod")
    usable = F.filter(
        F.transform(text.text_lines(F.col("content")), strip),
        lambda l: (l != "") & ~l.startswith("#") & ~l.startswith("-") & (requirement_name(l) != ""),
    )
    entries = F.transform(usable, lambda l: _entry(requirement_name(l), requirement_version(l), kind))
    order = F.array_position(F.array(*[F.lit(n) for n in dims.REQUIREMENT_FILES]), F.col("manifest_file"))
    rows = _rows(files, entries, 2, "pip", "declared_only")
    return rows.withColumn("item_seq", (order * 10_000_000 + F.col("item_seq")).cast("long"))


# One line of plain TOML: a bare key with a plain value, a header, or nothing.
_KEY, _STRING, _BLANK = r"[A-Za-z0-9_-]+", r'"[^"\\\x00-\x08\x0a-\x1f\x7f]*"', r"[ \t]*"
_LIST = rf"\[{_BLANK}(?:{_STRING}{_BLANK}(?:,{_BLANK}{_STRING}{_BLANK})*(?:,{_BLANK})?)?\]"
_FIELD = rf"{_KEY}{_BLANK}={_BLANK}(?:{_STRING}|{_LIST}|true|false)"
_INLINE = rf"\{{{_BLANK}(?:{_FIELD}{_BLANK}(?:,{_BLANK}{_FIELD}{_BLANK})*)?\}}"
TOML_LINE = re.compile(
    rf"{_BLANK}(?:({_KEY}){_BLANK}={_BLANK}(?:({_STRING})|({_LIST})|({_INLINE})|(true|false|0|[1-9][0-9]{{0,14}}))"
    rf"|\[({_KEY}(?:\.{_KEY})*)\]|\[\[({_KEY})\]\])?{_BLANK}(?:#[^\x00-\x08\x0a-\x1f\x7f]*)?(?:\n|\Z)"
)
TOML_STRING = re.compile(_STRING)
TOML_FIELD = re.compile(rf"({_KEY}){_BLANK}={_BLANK}(?:({_STRING})|({_LIST})|(true|false))")


def _plain_toml_reader():
    """`plain_toml`, made in here so that it is sent to Python workers as it is, which needn't have this package."""

    def strings(items: str) -> list[str]:
        return [x[1:-1] for x in TOML_STRING.findall(items)]

    def plain_toml(value: str) -> dict | None:
        """What `tomllib.loads` returns, for text of plain lines only; None for any other.

        Names that come twice, and headers that tables or values before them may forbid, are left
        to `tomllib` too, which knows which of them are errors.
        """
        out: dict = {}
        table, tables, lists = out, {}, {}
        at, match = 0, TOML_LINE.match
        while at < len(value):
            line = match(value, at)
            if line is None:
                return None
            at = line.end()
            key, string, items, inline, word, header, item = line.groups()
            if key is not None:
                if key in table:
                    return None
                if string is not None:
                    table[key] = string[1:-1]
                elif items is not None:
                    table[key] = strings(items)
                elif inline is not None:
                    fields = TOML_FIELD.findall(inline)
                    table[key] = {k: s[1:-1] if s else strings(i) if i else w == "true" for k, s, i, w in fields}
                    if len(table[key]) < len(fields):
                        return None
                else:
                    table[key] = word == "true" if word in ("true", "false") else int(word)
            elif header is not None:
                *above, last = header.split(".")
                table = out
                if len(above) == 1 and above[0] in lists:
                    table = lists[above[0]][-1]
                else:
                    for i, name in enumerate(above, 1):
                        path = ".".join(above[:i])
                        if path not in tables:
                            if name in table:
                                return None
                            table[name] = tables[path] = {}
                        table = tables[path]
                    tables[header] = {}
                if last in table:
                    return None
                table[last] = table = tables.get(header, {})
            elif item is not None:
                if item not in lists:
                    if item in out:
                        return None
                    out[item] = lists[item] = []
                table = {}
                lists[item].append(table)
        return out

    return plain_toml


plain_toml = _plain_toml_reader()


@F.pandas_udf(StringType())
def toml_to_json(content: pd.Series) -> pd.Series:
    """TOML text as JSON text, null when it is broken."""

    def convert(value):
        try:
            plain = plain_toml(value)
            return json.dumps(tomllib.loads(value) if plain is None else plain, default=str)
        except (tomllib.TOMLDecodeError, TypeError, AttributeError):
            return None

    return content.map(convert)


def toml_files(source_files: DataFrame, *names: str) -> DataFrame:
    """Root TOML files with their content as JSON; the one Python stage."""
    made = at_root(source_files, *names).select("repo_id", "path", toml_to_json("content").alias("json"))
    # Filters stay above the explode; below it, each would have the text parsed once more.
    return made.select("repo_id", "path", F.explode_outer(F.array("json")).alias("content")).filter(
        F.col("content").isNotNull()
    )


def _toml_version(raw: Column) -> Column:
    """Version of a table entry: a plain string or its `version` field."""
    value = F.try_variant_get(F.try_parse_json(raw), "$.version", "string")
    return F.when(raw.startswith("{"), value).when(~raw.startswith("["), raw)


def _toml_optional(raw: Column) -> Column:
    flag = F.get_json_object(raw, "$.optional")
    return raw.startswith("{") & (F.coalesce(flag, F.lit("false")) == "true")


def _requirement_entries(path: str, optional: Column) -> Column:
    found = F.filter(json_list(path, "string"), lambda d: requirement_name(d) != "")
    return F.transform(
        found, lambda d: _entry(requirement_name(d), requirement_version(d), "prod", None, optional)
    )


def pyproject(source_files: DataFrame, toml: DataFrame | None = None) -> DataFrame:
    """M3: poetry tables, then the standard project table."""
    files = toml_files(source_files, "pyproject.toml") if toml is None else toml.filter(
        F.col("path") == "pyproject.toml"
    )
    main = F.transform(
        F.filter(json_map("$.tool.poetry.dependencies"), lambda e: e["key"] != "python"),
        lambda e: _entry(e["key"], _toml_version(e["value"]), "prod", None, _toml_optional(e["value"])),
    )
    dev = F.transform(
        json_map("$.tool.poetry.dev-dependencies"),
        lambda e: _entry(e["key"], F.when(~e["value"].rlike(r"^[{\[]"), e["value"]), "dev"),
    )
    groups = F.flatten(F.transform(
        json_map("$.tool.poetry.group"),
        lambda g: F.transform(
            json_map("$.dependencies", content=g["value"]),
            lambda e: _entry(
                e["key"],
                _toml_version(e["value"]),
                F.when(g["key"].isin("dev", "test", "lint"), "dev").otherwise("prod"),
            ),
        ),
    ))
    extras = F.flatten(F.transform(
        json_map("$.project.optional-dependencies", "array<string>"),
        lambda g: F.transform(
            F.filter(g["value"], lambda d: requirement_name(d) != ""),
            lambda d: _entry(requirement_name(d), requirement_version(d), "prod", None, F.lit(True)),
        ),
    ))
    standard = F.concat(_requirement_entries("$.project.dependencies", F.lit(False)), extras)
    # both parts of a file are rows of one pass, so its text is read once
    parts = files.select("repo_id", "path", F.inline_outer(F.array(
        F.struct(F.lit("poetry").alias("manager"), F.concat(main, dev, groups).cast(ENTRY).alias("entries")),
        F.struct(F.lit(None).cast("string").alias("manager"), standard.cast(ENTRY).alias("entries")),
    )))
    rows = _rows(parts, F.col("entries"), 3, "pip", "declared_only", F.col("manager"))
    later = F.when(F.col("package_manager").isNull(), F.lit(10_000_000)).otherwise(F.lit(0))
    return rows.withColumn("item_seq", F.col("item_seq") + later)


def go_mod(source_files: DataFrame, strict_compat: bool = False) -> DataFrame:
    """M4: single requires and require blocks; `// indirect` marks transitive ones.

    With `strict_compat` every module counts as direct.
    """
    # A block runs to its closing line; blocks and single lines keep their order.
    token = r"(?m)^[ \t]*require \((?s:.*?)(?:^[ \t]*\)[ \t]*$|\z)|^[ \t]*require [^\n]*$"
    pieces = F.regexp_extract_all(text.unix_newlines(F.col("content")), F.lit(token), F.lit(0))
    lines = F.flatten(F.transform(
        pieces,
        lambda p: F.when(
            p.rlike(r"^[ \t]*require \("),
            F.filter(F.split(p, "\n"), lambda l: ~l.rlike(r"^\s*(require \(.*|\))\s*$")),
        ).otherwise(F.array(F.regexp_replace(p, r"^\s*require ", ""))),
    ))

    def words(l: Column) -> Column:
        return F.split(strip(F.regexp_replace(F.regexp_replace(strip(l), "^require ", ""), "//.*$", "")), r"\s+")

    usable = F.filter(lines, lambda l: F.size(words(l)) >= 2)
    entries = F.transform(
        usable,
        lambda l: _entry(
            F.get(words(l), F.lit(0)),
            F.get(words(l), F.lit(1)),
            "prod",
            F.lit(True) if strict_compat else ~l.rlike(r"//\s*indirect\b"),
        ),
    )
    return _rows(at_root(source_files, "go.mod"), entries, 4, "go", "declared_only")


def cargo_toml(source_files: DataFrame, toml: DataFrame | None = None) -> DataFrame:
    """M5."""
    files = toml_files(source_files, "Cargo.toml") if toml is None else toml.filter(
        F.col("path") == "Cargo.toml"
    )
    main = F.transform(
        json_map("$.dependencies"),
        lambda e: _entry(e["key"], _toml_version(e["value"]), "prod", None, _toml_optional(e["value"])),
    )
    dev = F.transform(
        json_map("$.dev-dependencies"), lambda e: _entry(e["key"], _toml_version(e["value"]), "dev")
    )
    build = F.transform(
        json_map("$.build-dependencies"), lambda e: _entry(e["key"], _toml_version(e["value"]), "prod")
    )
    return _rows(files, F.concat(main, dev, build), 5, "cargo", "declared_only")


def _xml_body() -> Column:
    return F.regexp_replace("content", r"(?s)<!--.*?-->", "")


def _well_formed_xml(files: DataFrame) -> DataFrame:
    probe = F.from_xml("content", "struct<_broken:string>", {"columnNameOfCorruptRecord": "_broken"})
    return files.filter(probe["_broken"].isNull())


XML_OPTIONS = {"ignoreSurroundingSpaces": "false"}
POM_NAMESPACE = r"xmlns\s*=\s*[\"']http://maven\.apache\.org/POM/4\.0\.0[\"']"
POM_DEPENDENCY = "struct<groupId:string,artifactId:string,version:string,scope:string,optional:string>"


def pom_files(source_files: DataFrame, root_only: bool = True) -> DataFrame:
    path = F.col("path")
    named = (path == "pom.xml") if root_only else ((path == "pom.xml") | path.endswith("/pom.xml"))
    files = (_of_kind(source_files, "pom.xml") if root_only else source_files).filter(
        named & F.col("content").rlike(POM_NAMESPACE)
    ).select("repo_id", "path", "content")
    return _well_formed_xml(files).withColumn("content", _xml_body())


def pom_xml(source_files: DataFrame) -> DataFrame:
    """M6: every <dependency> element, in document order."""
    pieces = F.regexp_extract_all(
        "content", F.lit(r"(?s)<dependency(?:\s[^>]*)?>.*?</dependency>"), F.lit(0)
    )
    found = F.transform(pieces, lambda p: F.from_xml(p, POM_DEPENDENCY, XML_OPTIONS))
    entries = F.transform(
        found,
        lambda d: _entry(
            F.concat(F.coalesce(d["groupId"], F.lit("")), F.lit(":"), F.coalesce(d["artifactId"], F.lit(""))),
            d["version"],
            F.when(d["scope"] == "test", "test")
            .when(d["scope"].isin("provided", "optional"), "dev")
            .otherwise("prod"),
            None,
            F.coalesce(F.lower(d["optional"]) == "true", F.lit(False)),
        ),
    )
    return _rows(pom_files(source_files), entries, 6, "maven", "declared_only")


def gemfile(source_files: DataFrame) -> DataFrame:
    """M7: gems of a development or test group are dev.

    The text is cut at each `group ... do` and `end` line; the head of a piece
    says which groups its gems are in.
    """
    lines = F.transform(text.text_lines(F.col("content")), strip)
    joined = F.array_join(lines, "\n")
    pieces = F.split(joined, r"(?m)(?=^group\s+.+\s+do)|^end$")

    def groups(piece: Column) -> Column:
        head = F.regexp_extract(piece, r"^group\s+(.+)\s+do", 1)
        return F.transform(F.split(head, ","), lambda g: F.regexp_replace(strip(g), "^[:,]+|[:,]+$", ""))

    def gems(piece: Column) -> Column:
        dev = F.exists(groups(piece), lambda g: g.isin("development", "test"))
        kind = F.when(dev, "dev").otherwise("prod")
        quoted = r"'([^']+)'|\"([^\"]+)\""
        return F.filter(
            F.transform(
                F.filter(F.split(piece, "\n"), lambda l: l.startswith("gem ")),
                lambda l: F.transform(
                    F.array(F.regexp_extract_all(l, F.lit(quoted), F.lit(0))),
                    lambda q: _entry(_unquote(F.get(q, F.lit(0))), _unquote(F.get(q, F.lit(1))), kind),
                )[0],
            ),
            lambda e: e["name"].isNotNull(),
        )

    entries = F.flatten(F.transform(pieces, gems))
    return _rows(at_root(source_files, "Gemfile"), entries, 7, "bundler", "declared_only")


def _unquote(c: Column) -> Column:
    return F.substring(c, F.lit(2), F.length(c) - 2)


PROJECT_FILES = r"\.(cs|fs|vb)proj$|(^|/)Directory\.Packages\.props$"
NUGET_REFERENCE = (
    "struct<_Include:string,_Update:string,_Version:string,_PrivateAssets:string,"
    "Version:string,PrivateAssets:string>"
)


def nuget(source_files: DataFrame) -> DataFrame:
    """M8: project files anywhere in the tree."""
    path = F.col("path")
    files = _of_kind(source_files, PROJECTS).filter(path.rlike(PROJECT_FILES)).select("repo_id", "path", "content")
    plain = _well_formed_xml(files).withColumn("content", _xml_body()).filter(
        ~F.col("content").rlike(r"<Project[^>]*\sxmlns\s*=")
    )
    pieces = F.regexp_extract_all(
        "content",
        F.lit(r"(?s)<PackageReference\b[^>]*/>|<PackageReference\b[^>]*>.*?</PackageReference>"),
        F.lit(0),
    )
    found = F.transform(pieces, lambda p: F.from_xml(p, NUGET_REFERENCE, XML_OPTIONS))

    def name(r: Column) -> Column:
        return F.coalesce(blank_to_null(r["_Include"]), blank_to_null(r["_Update"]))

    entries = F.transform(
        F.filter(found, lambda r: name(r).isNotNull()),
        lambda r: _entry(
            name(r),
            F.coalesce(blank_to_null(r["_Version"]), r["Version"]),
            F.when(
                F.lower(F.coalesce(blank_to_null(r["_PrivateAssets"]), r["PrivateAssets"])).contains("all"),
                "dev",
            ).otherwise("prod"),
        ),
    )
    return _rows(plain, entries, 8, "nuget", "declared_only")


def composer_json(source_files: DataFrame) -> DataFrame:
    """M9: without the platform entries."""

    def packages(section: str) -> Column:
        return F.filter(
            json_map(f"$.{section}"), lambda e: (e["key"] != "php") & ~e["key"].startswith("ext-")
        )

    entries = F.concat(
        _plain_entries(packages("require"), "prod"), _plain_entries(packages("require-dev"), "dev")
    )
    return _rows(
        _well_formed_json(at_root(source_files, "composer.json")), entries, 9, "composer", "declared_only"
    )


# --- lockfiles ---------------------------------------------------------------


def with_direct_names(lock_files: DataFrame, source_files: DataFrame) -> DataFrame:
    """Names declared by the package.json beside a lockfile.

    The join is between files, one to one; entries are looked up in the row.
    """
    declared = _well_formed_json(at_root(source_files, "package.json")).select(
        "repo_id",
        *[
            F.transform(json_map(f"$.{s}"), lambda e: e["key"]).alias(s)
            for s in ("dependencies", "peerDependencies", "devDependencies")
        ],
    ).select(
        "repo_id",
        F.concat("dependencies", "peerDependencies", "devDependencies").alias("direct_names"),
        F.col("devDependencies").alias("dev_names"),
    )
    none = F.array().cast("array<string>")
    # Spark knows no size of names read from text and may take those of a whole portfolio for a
    # table small enough to collect on the driver
    return lock_files.join(declared.hint("merge"), "repo_id", "left").select(
        *lock_files.columns,
        F.coalesce("direct_names", none).alias("direct_names"),
        F.coalesce("dev_names", none).alias("dev_names"),
    )


@F.pandas_udf(StringType())
def flatten_lock_tree(content: pd.Series) -> pd.Series:
    """Nested v1 `dependencies` tree as a flat JSON list, parents first, any depth."""

    def flat(value):
        out, stack = [], []
        try:
            stack.append((iter((json.loads(value).get("dependencies") or {}).items()), True))
        except (ValueError, AttributeError, TypeError):
            return None
        while stack:
            items, top = stack[-1]
            name, info = next(items, (None, None))
            if name is None:
                stack.pop()
            elif isinstance(info, dict):
                out.append({
                    "name": name, "top": top, "version": info.get("version"),
                    "dev": bool(info.get("dev")),
                    "license": info.get("license") or info.get("licence"),
                })
                if isinstance(info.get("dependencies"), dict):
                    stack.append((iter(info["dependencies"].items()), False))
        return json.dumps(out)

    return content.map(flat)


LOCK_PACKAGE = "struct<version:string,dev:string,license:string,licence:string>"
FLAT_PACKAGE = "struct<name:string,top:boolean,version:string,dev:boolean,license:string>"


def npm_lock_packages(source_files: DataFrame) -> DataFrame:
    """package-lock.json as (repo_id, path, direct_names, packages[]).

    Versions 2 and 3 list packages by path; version 1 nests them. Both end up as
    an array of (name, top, version, dev, license).
    """
    locks = with_direct_names(
        _well_formed_json(at_root(source_files, "package-lock.json")), source_files
    )
    version = F.coalesce(F.get_json_object("content", "$.lockfileVersion").try_cast("int"), F.lit(1))
    by_path = F.get_json_object("content", "$.packages").isNotNull() & (version >= 2)
    listed = F.transform(
        F.filter(
            json_map("$.packages", LOCK_PACKAGE), lambda e: (e["key"] != "") & e["value"].isNotNull()
        ),
        lambda e: F.struct(
            F.element_at(F.split(F.regexp_replace(e["key"], "^node_modules/", ""), "node_modules/"), -1).alias("name"),
            F.lit(True).alias("top"),
            e["value"]["version"].alias("version"),
            F.coalesce(e["value"]["dev"] == "true", F.lit(False)).alias("dev"),
            F.coalesce(blank_to_null(e["value"]["license"]), e["value"]["licence"]).alias("license"),
        ),
    )
    # one pass for both forms: with a branch each, files would be made, parsed and joined twice
    told = locks.withColumn("is_v1", ~by_path)
    tree = flatten_lock_tree(F.when(F.col("is_v1"), F.col("content")))
    packages = F.when(F.col("is_v1"), F.from_json(tree, f"array<{FLAT_PACKAGE}>")).otherwise(listed.cast(f"array<{FLAT_PACKAGE}>"))
    return told.select("repo_id", "path", "direct_names", packages.alias("packages"), "is_v1")


def package_lock(source_files: DataFrame) -> DataFrame:
    """M10."""
    entries = F.transform(
        "packages",
        lambda p: _entry(
            p["name"],
            p["version"],
            F.when(p["dev"], "dev").otherwise("prod"),
            p["top"] & F.array_contains("direct_names", p["name"]),
        ),
    )
    return _rows(npm_lock_packages(source_files), entries, 10, "npm", "locked", "npm")


def _blocks(content: Column, start: str) -> Column:
    """Text cut in front of every line that matches `start`."""
    return F.split(text.unix_newlines(content), f"(?m)(?={start})")


def yarn_lock(source_files: DataFrame) -> DataFrame:
    """A header names the packages, its indented body the version.

    A blank or comment line ends a block; the last version line in it counts.
    """
    files = with_direct_names(at_root(source_files, "yarn.lock"), source_files)
    blocks = F.transform(
        _blocks(F.col("content"), r"^[^ \n#][^\n]*:[ \t]*$"),
        lambda b: F.get(F.split(b, r"(?m)^(?:#[^\n]*|[ \t]*)$", 2), F.lit(0)),
    )

    def header(b: Column) -> Column:
        return F.regexp_extract(b, r"^([^ \n#][^\n]*?):+[ \t]*(?:\n|\z)", 1)

    def version(b: Column) -> Column:
        found = F.regexp_extract_all(b, F.lit(r'(?m)^  version\s+"?([^"\n]+)"?'), F.lit(1))
        return F.when(F.size(found) > 0, F.element_at(found, -1))

    def name(raw: Column) -> Column:
        return strip(F.regexp_extract(F.regexp_replace(strip(raw), '^"+|"+$', ""), r'^"?(@?[^@"]+)', 1))

    # step by step, as a lambda's expressions are evaluated wherever they stand
    heads = F.transform(blocks, lambda b: F.struct(header(b).alias("h"), b.alias("b")))
    read = F.transform(F.filter(heads, lambda x: x["h"] != ""), lambda x: F.struct(
        F.transform(F.split(x["h"], ","), name).alias("names"), version(x["b"]).alias("version"),
    ))
    entries = F.flatten(F.transform(
        F.filter(read, lambda x: x["version"].isNotNull()),
        lambda x: F.transform(
            F.filter(x["names"], lambda n: n != ""),
            lambda n: _entry(
                n,
                x["version"],
                F.when(F.array_contains("dev_names", n), "dev").otherwise("prod"),
                F.array_contains("direct_names", n),
            ),
        ),
    ))
    return _rows(files, entries, 11, "npm", "locked", "yarn")


def yaml_section(content: Column, name: str) -> Column:
    """Indented body of a top-level YAML key."""
    return F.regexp_extract(
        text.unix_newlines(content), rf"(?m)^{name}:[ \t]*\n((?s:.*?))(?=^[^\s#]|\z)", 1
    )


def pnpm_lock(source_files: DataFrame) -> DataFrame:
    """`packages` keys at two spaces; importers name the direct ones."""
    files = at_root(source_files, "pnpm-lock.yaml").select(
        "repo_id",
        "path",
        yaml_section(F.col("content"), "packages").alias("packages"),
        yaml_section(F.col("content"), "importers").alias("importers"),
    )
    # Names below dependencies / devDependencies of an importer: six spaces deep.
    # The section is cut at the shallower keys; a repeated group would overflow Java's stack.
    listed = F.filter(
        F.split("importers", r"(?m)(?=^ {0,4}\S)"),
        lambda b: b.rlike(r"\A    (?:dependencies|devDependencies):[ \t]*\n"),
    )
    direct = F.flatten(F.transform(
        listed,
        lambda s: F.regexp_extract_all(s, F.lit(r"(?m)^      ['\"]?([^'\" \n:]+(?::[^'\" \n:]+)*)['\"]?:"), F.lit(1)),
    ))

    def key(b: Column) -> Column:
        return F.regexp_extract(b, r"^  (['\"]?)(\S[^\n]*?)\1:[ \t]*(?:\{[^\n]*\})?[ \t]*(?:\n|\z)", 2)

    by_slash = r"^/?(@?[^/@]+(?:/[^/@]+)?)/([^/]+)$"
    by_at = r"^(@?[^@]+)@(.+)$"

    def parts(k: Column) -> Column:
        """Name and version of a key, null for other keys."""

        def by(form: str) -> Column:
            return F.when(k.rlike(form), F.struct(
                F.regexp_extract(k, form, 1).alias("name"), F.regexp_extract(k, form, 2).alias("version")
            ))

        return F.coalesce(by(by_slash), by(by_at))

    # step by step, as a lambda's expressions are evaluated wherever they stand
    keyed = F.transform(F.split("packages", r"(?m)(?=^  \S)"), lambda b: F.struct(key(b).alias("k"), b.alias("b")))
    told = F.transform(keyed, lambda x: F.struct(parts(x["k"]).alias("k"), x["b"].alias("b")))
    entries = F.transform(
        F.filter(told, lambda x: x["k"].isNotNull()),
        lambda x: _entry(
            x["k"]["name"],
            x["k"]["version"],
            F.when(x["b"].rlike(r"(?m)^    dev: true[ \t]*$|\{[^\n]*\bdev: true\b"), "dev").otherwise("prod"),
            F.array_contains("direct", x["k"]["name"]),
        ),
    )
    return _rows(files.withColumn("direct", direct), entries, 12, "npm", "locked", "pnpm")


TOML_PACKAGE = "struct<name:string,version:string,category:string,optional:boolean>"


def _toml_lock(source_files, toml, file_name, seq, ecosystem, manager) -> DataFrame:
    files = toml_files(source_files, file_name) if toml is None else toml.filter(F.col("path") == file_name)
    dev = manager == "poetry"
    entries = F.transform(
        F.filter(json_list("$.package", TOML_PACKAGE), lambda p: F.coalesce(p["name"], F.lit("")) != ""),
        lambda p: _entry(
            p["name"],
            p["version"],
            F.when((p["category"] == "dev") & F.lit(dev), "dev").otherwise("prod"),
            None,
            F.coalesce(p["optional"], F.lit(False)) & F.lit(dev),
        ),
    )
    return _rows(files, entries, seq, ecosystem, "locked", manager)


def poetry_lock(source_files: DataFrame, toml: DataFrame | None = None) -> DataFrame:
    """M13."""
    return _toml_lock(source_files, toml, "poetry.lock", 13, "pip", "poetry")


def pipfile_lock(source_files: DataFrame) -> DataFrame:
    """M14."""

    def pinned(section: str, kind: str) -> Column:
        return F.transform(
            json_map(f"$.{section}", "struct<version:string>"),
            lambda e: _entry(
                e["key"], blank_to_null(F.regexp_replace(e["value"]["version"], "^=+", "")), kind
            ),
        )

    entries = F.concat(pinned("default", "prod"), pinned("develop", "dev"))
    return _rows(
        _well_formed_json(at_root(source_files, "Pipfile.lock")), entries, 14, "pip", "locked", "pipenv"
    )


def cargo_lock(source_files: DataFrame, toml: DataFrame | None = None) -> DataFrame:
    """M15."""
    return _toml_lock(source_files, toml, "Cargo.lock", 15, "cargo", None)


def gem_specs(content: Column) -> Column:
    """Lines `    name (version)` inside `specs:` sections, in order."""
    sections = F.filter(
        F.split(text.unix_newlines(content), r"(?m)^[ \t]*(?=(?:GEM|PATH|GIT|specs:)[ \t]*$)"),
        lambda s: s.startswith("specs:"),
    )
    return F.flatten(F.transform(
        sections,
        lambda s: F.filter(F.split(s, "\n"), lambda l: l.rlike(r"^ {4}(?!  )\S*\s*\S+\s+\([^)]+\)")),
    ))


GEM_SPEC = r"^\s{4}(\S+)\s+\(([^)]+)\)"


def gemfile_lock(source_files: DataFrame) -> DataFrame:
    """M16."""
    entries = F.transform(
        F.filter(gem_specs(F.col("content")), lambda l: l.rlike(GEM_SPEC)),
        lambda l: _entry(F.regexp_extract(l, GEM_SPEC, 1), F.regexp_extract(l, GEM_SPEC, 2)),
    )
    return _rows(at_root(source_files, "Gemfile.lock"), entries, 16, "bundler", "locked")


def composer_lock(source_files: DataFrame) -> DataFrame:
    """M17."""
    entries = F.concat(*[
        _named_entries(json_list(f"$.{section}", "struct<name:string,version:string>"), kind)
        for section, kind in (("packages", "prod"), ("packages-dev", "dev"))
    ])
    return _rows(
        _well_formed_json(at_root(source_files, "composer.lock")), entries, 17, "composer", "locked"
    )


def go_sum(source_files: DataFrame) -> DataFrame:
    """Distinct (module, version) of a file, first appearance first."""
    words = F.transform(text.text_lines(F.col("content")), lambda l: F.split(strip(l), r"\s+"))
    # one string per pair: Spark finds distinct strings by hash, distinct structs by comparing all
    pairs = F.array_distinct(F.transform(
        F.filter(words, lambda w: F.size(w) >= 2),
        lambda w: F.concat(F.get(w, F.lit(0)), F.lit(" "), F.substring_index(F.get(w, F.lit(1)), "/", 1)),
    ))
    entries = F.transform(
        pairs, lambda p: _entry(F.substring_index(p, " ", 1), F.substring_index(p, " ", -1))
    )
    return _rows(at_root(source_files, "go.sum"), entries, 18, "go", "locked")


def manifest_files(source_files: DataFrame) -> DataFrame:
    """The manifests of every repository, stored once, in a folder for each name.

    They are a sliver of the files table but have eighteen readers; without this
    each reader would scan the whole table for its own file name.
    """
    path = F.col("path")
    kind = F.when(path.isin(*ROOT_MANIFESTS), path).otherwise(PROJECTS)
    return stored(source_files.filter(is_manifest(path)).select("repo_id", "path", "content", kind.alias(KIND)), KIND)


def all_dependencies(manifests: DataFrame, strict_compat: bool = False) -> DataFrame:
    """Every reader over the manifests."""
    parts = [
        package_json(manifests), requirements(manifests), pyproject(manifests),
        go_mod(manifests, strict_compat), cargo_toml(manifests), pom_xml(manifests),
        gemfile(manifests), nuget(manifests), composer_json(manifests), package_lock(manifests),
        yarn_lock(manifests), pnpm_lock(manifests), poetry_lock(manifests),
        pipfile_lock(manifests), cargo_lock(manifests), gemfile_lock(manifests),
        composer_lock(manifests), go_sum(manifests),
    ]
    return reduce(lambda a, b: a.unionByName(b), [p.select(*COLUMNS) for p in parts])


# Root files that are manifests.
ROOT_MANIFESTS = [
    "package.json", *dims.REQUIREMENT_FILES, "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml",
    "Gemfile", "composer.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock",
    "Pipfile.lock", "Cargo.lock", "Gemfile.lock", "composer.lock", "go.sum",
]


def is_manifest(path: Column) -> Column:
    return path.isin(*ROOT_MANIFESTS) | path.rlike(PROJECT_FILES)


def dedup_dependencies(rows: DataFrame) -> DataFrame:
    """One row per repository, name and ecosystem.

    Best discovery mode, then the reader that comes first, then the entry that
    comes first. An aggregate, so a partial result is built before the shuffle.
    """
    rank = F.lit(0)
    for mode, value in dims.DISCOVERY_RANK.items():
        rank = F.when(F.col("discovery_mode") == mode, value).otherwise(rank)
    key = ["repo_id", "name", "ecosystem"]
    values = [c for c in rows.columns if c not in key]
    order = F.struct((-rank).alias("r"), F.col("parser_seq"), F.col("item_seq"))
    return (
        rows.groupBy(*key)
        .agg(F.min_by(F.struct(*values), order).alias("_r"))
        .select(*key, "_r.*")
        .drop("parser_seq", "item_seq")
    )


def dependencies(source_files: DataFrame, strict_compat: bool = False) -> DataFrame:
    """The dependency inventory of every repository."""
    return dedup_dependencies(all_dependencies(manifest_files(source_files), strict_compat))
