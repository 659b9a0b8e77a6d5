"""A state carried from line to line, as a segmented scan.

What a line does is a function from state to state, written as the array of the states
that 0, 1, 2, ... become. Functions compose, so a file needs no single task: lines are cut
into segments, each segment is folded into one function, the functions of a file's
segments are composed in order (one short row per segment), and each segment then starts
from the state that those before it leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SEGMENT = 4096
#: Segments whose functions are composed at a time, level by level.
FAN = 256


def identity(states: int) -> Column:
    return F.array(*[F.lit(s) for s in range(states)]).cast("array<int>")


def then(first: Column, second: Column) -> Column:
    """The function that does one and then the other."""
    return F.transform(first, lambda s: F.element_at(second, s + 1))


def nesting(opens: Column, closes: Column, deepest: int) -> Column:
    """Function of a line in a grammar of nested blocks: a line that opens one goes one deeper, up to
    `deepest`, one that closes one comes one up, and others change nothing."""
    return (
        F.when(opens & ~closes, F.array(*[F.lit(min(s + 1, deepest)) for s in range(deepest + 1)]))
        .when(closes & ~opens, F.array(*[F.lit(max(s - 1, 0)) for s in range(deepest + 1)]))
        .otherwise(identity(deepest + 1))
    )


def _folded(rows: DataFrame, keys: list[str], number: str, step: str, states: int) -> DataFrame:
    """One function per group: its steps composed by number. A group holds a bounded number of rows."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct(number, step))), lambda x: x[step])
    return rows.groupBy(*keys).agg(F.aggregate(steps, identity(states), then).alias(step))


def _starts(segments: DataFrame, file: list[str], states: int, fan: int) -> DataFrame:
    """(file, segment, start): the state in which each segment begins, from 0. Segments are
    folded in groups of `fan` until a file has one group; the way back gives the starts."""
    groups = segments.withColumn("group", F.floor(F.col("segment") / fan).cast("long"))
    top = groups.agg(F.max("group")).first()[0]
    if top:
        above = _folded(groups, [*file, "group"], "segment", "step", states)
        begun = _starts(above.withColumnRenamed("group", "segment"), file, states, fan).select(
            *file, F.col("segment").alias("group"), F.col("start").alias("from")
        )
    else:
        begun = groups.select(*file, "group").distinct().withColumn("from", F.lit(0))
    before = Window.partitionBy(*file, "group").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.transform(F.array_sort(F.collect_list(F.struct("segment", "step")).over(before)), lambda x: x["step"])
    reached = groups.withColumn("earlier", earlier).join(begun, [*file, "group"])
    start = F.aggregate("earlier", F.col("from"), lambda s, f: F.element_at(f, s + 1))
    return reached.select(*file, "segment", start.alias("start"))


def block_state(lines: DataFrame, file: list[str], number: str, step: Column, states: int, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """`lines` (of `file`, numbered from 1 without gaps by `number`) with `state`, the state
    after each line; a file begins in state 0. `step` is each line's function."""
    rows = lines.withColumn("step", step).withColumn("segment", F.floor((F.col(number) - 1) / segment).cast("long"))
    folded = cut(_folded(rows, [*file, "segment"], number, "step", states))
    begun = _starts(folded, file, states, fan)
    # inside a segment: the function so far of every line, from which its state follows
    packed = rows.groupBy(*file, "segment").agg(
        F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.struct(*[c for c in lines.columns if c not in file]).alias("line"), "step"))).alias("own")
    ).join(begun, [*file, "segment"])
    walked = F.aggregate(
        F.transform("own", lambda x: x["step"]), F.array(F.col("start")),
        lambda seen, f: F.concat(seen, F.array(F.element_at(f, F.element_at(seen, -1) + 1))),
    )
    out = packed.select(*file, F.explode(F.arrays_zip(F.col("own"), F.slice(walked, 2, F.size("own")).alias("state"))).alias("x"))
    return out.select(*[F.col(c) if c in file else F.col(f"x.own.line.{c}").alias(c) for c in lines.columns], F.col("x.state").alias("state"))
