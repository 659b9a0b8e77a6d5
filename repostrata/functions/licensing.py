"""Licence strings and texts: F16-F22."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims
from .common import blank_to_null, let, lookup, strip

# Shapes of a licence string and notes attached to it.
COMPOUND = r"\bOR\b|\bAND\b|\bWITH\b"
COMPOUND_SPLIT = r"\s+(?:OR|AND|WITH)\s+"
SPDX_TOKEN = r"^[A-Za-z0-9.\-+]+$"
SEE_FILE = r"(?i)^see\s+license|^license\s+in\s+"
AMBIGUOUS = ["bsd", "gpl", "lgpl"]
NOTE_COMPOUND = "Dual/compound license expression preserved"
NOTE_AMBIGUOUS = ("Ambiguous license string '", "' — exact version not determinable")
NOTE_FILE = "License defined in file: "


def _bare(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"^[()]+|[()]+$", "")


def normalise_spdx(raw: Column) -> Column:
    """F16: struct(spdx, expression, notes)."""
    return let(_bare(F.coalesce(raw, F.lit(""))), lambda c: _normalised(c))


def _normalised(cleaned: Column) -> Column:
    compound = cleaned.rlike(COMPOUND)
    first = _bare(F.get(F.split(cleaned, COMPOUND_SPLIT, 2), F.lit(0)))
    token = F.when(first.rlike(SPDX_TOKEN), first)
    alias = lookup(dims.SPDX_ALIASES, F.lower(cleaned))

    def result(spdx, expression=None, notes=None) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(
            F.coalesce(spdx, null).alias("spdx"),
            (null if expression is None else expression).alias("expression"),
            (null if notes is None else notes).alias("notes"),
        )

    none = F.lit(None).cast("string")
    ambiguous = F.concat(F.lit(NOTE_AMBIGUOUS[0]), cleaned, F.lit(NOTE_AMBIGUOUS[1]))
    return (
        F.when(cleaned == "", result(none))
        .when(
            compound,
            result(
                F.coalesce(lookup(dims.SPDX_ALIASES, F.lower(first)), token),
                cleaned,
                F.lit(NOTE_COMPOUND),
            ),
        )
        .when(alias.isNotNull(), result(alias))
        .when(F.lower(cleaned).isin(*AMBIGUOUS), result(none, None, ambiguous))
        .when(cleaned.rlike(SEE_FILE), result(none, None, F.concat(F.lit(NOTE_FILE), cleaned)))
        .when(cleaned.rlike(SPDX_TOKEN), result(cleaned))
        .otherwise(result(none))
    )


def _any_prefix(spdx: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [spdx.startswith(p) for p in prefixes])


def classify_risk(spdx: Column) -> Column:
    """F17."""
    return (
        F.when(_any_prefix(spdx, dims.RISKY_PREFIXES), "risky")
        .when(spdx.isin(*dims.SAFE_LICENSES), "safe")
        .otherwise("unknown")
    )


def classify_license(spdx: Column) -> Column:
    """F18."""
    return (
        F.when(spdx.isin(*dims.PERMISSIVE), "permissive")
        .when(spdx.isin(*dims.WEAK_COPYLEFT), "weak_copyleft")
        .when(spdx.isin(*dims.STRONG_COPYLEFT), "strong_copyleft")
        .when(_any_prefix(spdx, dims.STRONG_PREFIXES), "strong_copyleft")
        .when(_any_prefix(spdx, dims.WEAK_PREFIXES), "weak_copyleft")
        .otherwise("unknown")
    )


def classify_license_text(text: Column) -> Column:
    """the first pattern that a licence text matches, anywhere in it."""
    return F.coalesce(
        *[F.when(text.rlike("(?is)" + p), F.lit(spdx)) for p, spdx in dims.LICENSE_TEXT_PATTERNS]
    )


def trove_to_spdx(classifier: Column) -> Column:
    """F21."""
    return lookup(dims.TROVE_LICENSES, F.lower(strip(classifier)))


def first_trove(classifiers: Column) -> Column:
    """SPDX of the first classifier that has one, null otherwise."""
    known = F.filter(F.transform(classifiers, trove_to_spdx), lambda s: s.isNotNull())
    return F.get(known, F.lit(0))


LICENSE_INFO = (
    "struct<spdx:string,raw:string,risk:string,expression:string,"
    "confidence:string,source:string,notes:string>"
)


def license_info(raw: Column, confidence: str, source: str | None) -> Column:
    """normalised licence with risk; ambiguity lowers the confidence."""
    return let(
        F.struct(raw.alias("raw"), normalise_spdx(raw).alias("norm")),
        lambda x: _license_struct(x["raw"], x["norm"], confidence, source),
    )


def _license_struct(raw: Column, norm: Column, confidence: str, source: str | None) -> Column:
    return F.struct(
        norm["spdx"].alias("spdx"),
        raw.alias("raw"),
        classify_risk(norm["spdx"]).alias("risk"),
        norm["expression"].alias("expression"),
        F.when(F.lower(norm["notes"]).contains("ambiguous"), "low")
        .otherwise(confidence)
        .alias("confidence"),
        F.lit(source).cast("string").alias("source"),
        norm["notes"].alias("notes"),
    ).cast(LICENSE_INFO)


def known_license(spdx: Column, raw: Column, confidence: str, source: str, notes=None) -> Column:
    """Licence taken as it is, without normalising the raw string."""
    return F.struct(
        spdx.alias("spdx"),
        raw.alias("raw"),
        classify_risk(spdx).alias("risk"),
        F.lit(None).cast("string").alias("expression"),
        F.lit(confidence).alias("confidence"),
        F.lit(source).cast("string").alias("source"),
        F.lit(notes).cast("string").alias("notes"),
    ).cast(LICENSE_INFO)


def license_field_text(field: Column) -> Column:
    """licence field (a JSON fragment: string, list or object) as one text."""
    text = F.try_variant_get(F.try_parse_json(field), "$", "string")
    as_list = F.try_variant_get(F.try_parse_json(field), "$", "array<variant>")
    items = F.transform(
        as_list,
        lambda v: F.coalesce(F.try_variant_get(v, "$.type", "string"), v.cast("string")),
    )
    as_object = F.coalesce(
        blank_to_null(F.get_json_object(field, "$.type")), F.get_json_object(field, "$.name")
    )
    lead = F.substring(F.ltrim(field), 1, 1)
    return (
        F.when(lead == "[", F.array_join(items, " OR "))
        .when(lead == "{", as_object)
        .when(field.isNull() | (F.trim(field) == "null"), F.lit(None).cast("string"))
        .otherwise(F.coalesce(text, field))
    )
