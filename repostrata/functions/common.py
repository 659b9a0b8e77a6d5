"""Small helpers shared by the column functions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of `key` in a fixed map, null when absent (or when the key is null).

    The map travels as one JSON literal, which the optimizer folds to a map literal;
    spelling it out would make plans with hundreds of nodes per lookup.
    """
    table = F.from_json(F.lit(json.dumps(mapping)), "map<string,string>")
    return F.try_element_at(table, key)


#: What Unicode calls white space.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def choose(parameter: str, value: str, allowed) -> str:
    """Reject an unknown parameter value when the DataFrame is built."""
    if value not in allowed:
        raise ValueError(f"{parameter} must be one of {', '.join(sorted(allowed))}")
    return value


def share(part: Column, total: Column, digits: int = 2) -> Column:
    """Percentage rounded half to even; 0 when the total is 0 or missing."""
    return F.when(
        F.coalesce(total, F.lit(0)) != 0, F.bround(part * F.lit(100.0) / total, digits)
    ).otherwise(F.lit(0.0))


def total(c: Column) -> Column:
    """Sum with nulls and empty groups as 0."""
    return F.coalesce(F.sum(c), F.lit(0))


def pick(flags: list[tuple[Column, Column]]) -> Column:
    """Array of the values whose condition holds, in the given order."""
    options = F.array(*[F.when(cond, value) for cond, value in flags])
    return F.filter(options, lambda x: x.isNotNull())


def let(value: Column, body) -> Column:
    """`body(x)` with x bound to `value`, so a long expression is evaluated once.

    Column expressions have no variables; a one-element array with `transform` is
    one, and it keeps plans small where a value is needed many times.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_share(rows: DataFrame, keys: list[str], part: str) -> DataFrame:
    """`part` as a percentage of its sum over the keys.

    The rows are grouped already, one per member of a key, so a window sum costs one
    exchange and no second reading of what they were made from.
    """
    whole = F.sum(part).over(Window.partitionBy(*keys))
    return rows.withColumn("_whole", whole).withColumn("percentage", share(F.col(part), F.col("_whole"))).drop("_whole")
