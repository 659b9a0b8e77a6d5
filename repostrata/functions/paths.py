"""Path predicates and languages: F7-F14, P1-P5, P7."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims
from .common import literal_array, lookup, strip

_TEXT_LANGUAGES = {e: v for e, v in dims.EXTENSION_LANGUAGES.items() if e not in dims.BINARY_EXTENSIONS}


def segments(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-cased last extension with its dot; '' for none and for dot files."""
    base = basename(path)
    last = F.substring_index(base, ".", -1)
    found = F.substring(base, 2, 2**31 - 1).contains(".") & (last != "")
    return F.when(found, F.lower(F.concat(F.lit("."), last))).when(path.isNotNull(), "")


def stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", ""))


def in_skipped_dir(path: Column) -> Column:
    """A parent directory is on the skip list or hidden."""
    parts = segments(path)
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.exists(
        parents, lambda p: p.isin(*dims.SKIP_DIRS) | p.startswith(".")
    )


def in_complexity_skipped_dir(path: Column) -> Column:
    """Any segment is on the short skip list."""
    return F.arrays_overlap(segments(path), literal_array(dims.COMPLEXITY_SKIP_DIRS))


def in_history_skipped_dir(path: Column) -> Column:
    """Any segment of a changed path is on the skip list."""
    return F.exists(segments(path), lambda p: p.isin(*dims.SKIP_DIRS))


def detect_language(path: Column) -> Column:
    """by whole name, else by extension unless the extension is binary."""
    by_ext = lookup(_TEXT_LANGUAGES, suffix(path))
    return F.coalesce(lookup(dims.FILENAME_LANGUAGES, basename(path)), by_ext)


def is_source_file(path: Column) -> Column:
    """P4."""
    return detect_language(path).isNotNull()


def is_pdn_target(path: Column) -> Column:
    """P5."""
    return is_source_file(path) | suffix(path).isin(*dims.PLAIN_DOC_EXTENSIONS)


def not_test_path(path: Column) -> Column:
    """P7."""
    return ~F.lower(path).contains("test")


def is_test_file(path: Column) -> Column:
    """F11 with U5: a test segment anywhere, or a test-like stem."""
    lowered = F.transform(segments(path), F.lower)
    return F.arrays_overlap(lowered, literal_array(dims.TEST_SEGMENTS)) | stem(path).rlike(
        r"^test_|_test$|\.test$|\.spec$"
    )


def is_config_file(path: Column) -> Column:
    """F12."""
    return suffix(path).isin(*dims.CONFIG_EXTENSIONS)


def is_doc_file(path: Column) -> Column:
    """F13."""
    return stem(path).rlike("^(" + "|".join(dims.DOC_STEMS) + ")")


def is_lockfile(path: Column) -> Column:
    """F14."""
    return basename(path).isin(*dims.LOCKFILES)


def clean_filepath(raw: Column) -> Column:
    """new side of a rename, null for unusable paths."""
    braces = F.regexp_replace(raw, r"\{[^}]* => ([^}]*)\}", "$1")
    renamed = F.when(raw.contains(" => "), F.element_at(F.split(braces, " => "), -1))
    cleaned = strip(F.coalesce(renamed, raw))
    usable = ~raw.contains("\x00") & ~raw.contains("\ufffd") & (cleaned != "")
    return F.when(usable, cleaned)


def top_module(path: Column) -> Column:
    """F8: first directory, 'root' for files at the top."""
    parts = F.filter(segments(path), lambda p: (p != "") & (p != "."))
    return (
        F.when(path.startswith("/") & (F.size(parts) >= 1), F.lit("/"))
        .when(F.size(parts) >= 2, F.get(parts, F.lit(0)))
        .otherwise(F.lit("root"))
    )
