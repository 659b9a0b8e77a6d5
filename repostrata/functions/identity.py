"""Author names and e-mails to canonical user names: F1-F6."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims
from .common import blank_to_null, let, literal_array, strip

_ONE = {k: v for k, v in dims.CYRILLIC_TO_LATIN.items() if len(v) == 1}
_MANY = {k: v for k, v in dims.CYRILLIC_TO_LATIN.items() if len(v) > 1}
_GONE = "".join(k for k, v in dims.CYRILLIC_TO_LATIN.items() if v == "")
_FROM, _TO, _LONG = dims.diacritic_tables()


def transliterate(name: Column) -> Column:
    """F1."""
    single = F.translate(F.lower(name), "".join(_ONE) + _GONE, "".join(_ONE.values()))
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), _MANY.items(), single)


def strip_diacritics(name: Column) -> Column:
    """ASCII letters of the compatibility decomposition, the rest dropped."""
    return let(name, _ascii)


def _ascii(name: Column) -> Column:
    # characters with a longer form are looked up once each, among those beyond ASCII
    beyond = F.regexp_replace(name, r"[\x00-\x7F]+", "")
    return F.when(name.rlike(r"[^\x00-\x7F]"), let(beyond, lambda b: _latin(name, b))).otherwise(name)


def _latin(name: Column, beyond: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in _LONG.items() for x in kv])
    found = F.array_intersect(F.split(beyond, ""), literal_array(list(_LONG)))
    long_forms = F.aggregate(found, name, lambda text, c: F.replace(text, c, F.try_element_at(table, c)))
    has_long = F.translate(beyond, "".join(_LONG), "") != beyond
    plain = F.translate(F.when(has_long, long_forms).otherwise(name), _FROM, _TO)
    return F.regexp_replace(plain, r"[^\x00-\x7F]", "")


def clean_name(name: Column) -> Column:
    """F3."""
    return F.trim(F.regexp_replace(strip_diacritics(transliterate(name)), "[^a-z0-9]+", " "))


def email_to_username(email: Column) -> Column:
    """null when nothing usable is left of the local part."""
    local = F.regexp_replace(
        F.regexp_replace(F.lower(F.substring_index(email, "@", 1)), r"[.\-+]", "_"), "[^a-z0-9_]", ""
    )
    return let(local, _from_local_part)


def _from_local_part(local: Column) -> Column:
    parts = F.split(local, "_")
    initial = F.substring(F.get(parts, F.lit(0)), 1, 1)
    last = F.element_at(parts, -1)
    short = F.when(
        (F.size(parts) >= 2) & (initial != "") & (last != ""), F.concat_ws("_", initial, last)
    )
    return F.when(local.rlike("^[a-z]_[a-z]+$"), local).otherwise(
        F.coalesce(short, blank_to_null(local))
    )


def _identity(username, confidence, ambiguous, source) -> Column:
    return F.struct(
        username.alias("username"),
        confidence.cast("double").alias("confidence"),
        ambiguous.alias("is_ambiguous"),
        F.lit(source).alias("source"),
    )


def name_to_identity(name: Column) -> Column:
    """struct(username, confidence, is_ambiguous, source)."""
    return let(clean_name(F.coalesce(name, F.lit(""))), _from_clean_name)


def _from_clean_name(cleaned: Column) -> Column:
    parts = F.split(cleaned, " ")
    first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    initial_only = F.length(first) == 1
    return (
        F.when(cleaned == "", _identity(F.lit("unknown"), F.lit(0.1), F.lit(True), "name"))
        .when(F.size(parts) == 1, _identity(cleaned, F.lit(0.5), F.lit(True), "name"))
        .otherwise(
            _identity(
                F.concat_ws("_", F.substring(first, 1, 1), last),
                F.when(initial_only, F.lit(0.7)).otherwise(F.lit(0.85)),
                initial_only,
                "name",
            )
        )
    )


def name_key(name: Column) -> Column:
    return F.lower(strip(F.coalesce(name, F.lit(""))))


def resolve_identity(name: Column, email: Column, by_name: Column, by_email: Column) -> Column:
    """override by name, override by e-mail, e-mail, then name."""
    override = F.coalesce(by_name, by_email)
    known = F.coalesce(
        F.when(override.isNotNull(), _identity(override, F.lit(1.0), F.lit(False), "override")),
        let(
            email_to_username(email),
            lambda u: F.when(u.isNotNull(), _identity(u, F.lit(0.9), F.lit(False), "email")),
        ),
    )
    return F.coalesce(known, name_to_identity(name))
