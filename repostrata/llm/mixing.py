"""Mixing sources to target weights.

Documents get a hash-random key; within each source they are ordered by it, and running
totals of their sizes over key ranges say where the source's budget of words ends. A
budget beyond the source repeats it in whole epochs first. Only (source, key, id, size)
is shuffled, never text: a source's decision is one cut point, joined back to its rows.

Defined cases: a null or blank text has size 0 and nothing is taken of it; a null source
is a source of its own, last in order; identical rows share what falls on them equally;
an empty table gives an empty result; other columns of the input are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_totals, store

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20261
#: Key ranges per source; each is summed by itself.
RANGE_BITS = 12
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    plain = F.translate(text, "\t\n\u000b\u000c\r", "     ")
    return F.when(text.isNull() | (F.trim(plain) == ""), F.lit(0)).otherwise(
        F.size(F.split(F.trim(plain), " +"))
    ).cast("long")


def _row_key(docs: DataFrame, doc_id: str, text: str, seed: int) -> Column:
    key = F.xxhash64(F.lit(seed), F.col(doc_id)).bitwiseAND(F.lit((1 << 63) - 1))
    return F.struct(key.alias("key"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with each source's target in words.

    Sources by code point, null last, have the weights in turn. A target is the share of
    the grand total by weight, at most max_epochs times the source, where what is above
    goes to the others by weight: min(cap, level * weight) for one common level.
    """
    ordered = sizes.withColumn("_null", F.col("source").isNull().cast("int")).withColumn("_one", F.lit(1))
    ranked = running_totals(ordered, ["_null", "source"], {"_rank": "_one"})
    weight = F.array(*[F.lit(w) for w in weights])[((F.col("_rank") - 1) % len(weights)).cast("int")]
    capped = ranked.select(
        "source", "source_size", weight.cast("long").alias("_weight"),
        (F.col("source_size") * max_epochs).alias("_cap"),
    ).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    summed = store(running_totals(capped, ["_ratio", "source"], {"_caps": "_cap", "_weights": "_weight"}), "levels")
    total = summed.agg(F.sum("source_size")).scalar()
    all_weights = summed.agg(F.sum("_weight")).scalar()
    full = summed.withColumn(
        "_full", F.col("_caps") + F.col("_ratio") * (all_weights - F.col("_weights")) <= total
    )
    level = full.agg(
        (F.sum("source_size") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)))
        / F.nullif(F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_weight"))), F.lit(0))
    ).scalar()
    return full.select(
        "source", "source_size",
        F.when(F.col("_full"), F.col("_cap").cast("double"))
        .otherwise(F.least(level * F.col("_weight"), F.col("_cap").cast("double"))).alias("target"),
    )


def cuts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """One row per source: its size and target, the whole epochs, and the row where the rest ends."""
    thin = store(
        docs.select(F.col(source).alias("source"), words(F.col(text)).alias("size"), _row_key(docs, doc_id, text, seed).alias("k"))
        .groupBy("source", "k", "size").agg(F.count("*").alias("twins")),
        "sizes",
    )
    sizes = thin.groupBy("source").agg(F.sum(F.col("size") * F.col("twins")).alias("source_size"))
    goals = targets(sizes, weights, max_epochs).withColumn("_budget", F.round("target").cast("long")).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.expr("_budget div source_size"))).otherwise(0).alias("epochs"),
        F.when(F.col("source_size") > 0, F.col("_budget") % F.col("source_size")).otherwise(0).alias("rest"),
    )
    goals = store(goals, "goals")
    ranges = thin.select(
        "source", "k", "size", "twins", (F.col("size") * F.col("twins")).alias("mass"),
        F.shiftright(F.col("k.key"), 63 - RANGE_BITS).alias("range"),
    ).where("mass > 0")
    per_range = ranges.groupBy("source", "range").agg(F.sum("mass").alias("range_mass"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_range.select("source", "range", F.coalesce(F.sum("range_mass").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "range").orderBy("k.key", "k.id", "k.text_hash").rowsBetween(Window.unboundedPreceding, 0)
    running = ranges.withColumn("upto", F.sum("mass").over(inside)).alias("r").join(
        bases.alias("b"), F.expr("r.source <=> b.source and r.range = b.range")
    ).select("r.source", "k", "twins", (F.col("base") + F.col("upto")).alias("end"), "mass")
    ends = running.alias("x").join(goals.alias("g"), F.expr("x.source <=> g.source")).where(
        "end > rest and end - mass <= rest"
    ).select("x.source", F.col("k").alias("cut"), F.expr("(rest - (end - mass)) div twins").alias("cut_words"))
    return store(
        goals.alias("g").join(ends.alias("e"), F.expr("g.source <=> e.source"), "left").select(
            "g.source", "source_size", "target", "epochs", "cut", F.coalesce("cut_words", F.lit(0)).alias("cut_words")
        ),
        "cuts",
    )


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """Every input row as the struct `row`, with size, source_size, target, epochs (whole
    passes), part (words of one more pass; null where that pass leaves the row out) and
    taken (words in all)."""
    plan = cuts(docs, doc_id, text, source, weights, max_epochs, seed)
    keyed = docs.select(
        F.struct("*").alias("row"), F.col(source).alias("_source"),
        words(F.col(text)).alias("size"), _row_key(docs, doc_id, text, seed).alias("k"),
    )
    part = F.when(F.col("k") < F.col("cut"), F.col("size")).when(F.col("k") == F.col("cut"), F.col("cut_words"))
    return keyed.alias("d").join(plan.alias("p"), F.expr("d._source <=> p.source")).select(
        "row", "size", "source_size", "target", F.col("epochs").cast("int").alias("epochs"),
        F.when(part > 0, part).alias("part"),
    ).withColumn("taken", F.col("epochs") * F.col("size") + F.coalesce("part", F.lit(0)))


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its count-th word."""
    lead = text.rlike(r"^[\x20\x09-\x0D]").cast("int")
    pieces = F.split(text, SPACES, (count + lead + 1).cast("int"))
    rest = F.when(F.size(pieces) > count + lead, F.length(F.element_at(pieces, -1))).otherwise(0)
    return F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - rest), r"[\x20\x09-\x0D]+\z", "")


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents of the mix: one row per whole pass and one, cut after its last word,
    for the part of a pass in which a source's budget ends. Columns are the input's."""
    mixed = mix(docs, text=text, **options)
    copies = F.transform(F.sequence(F.lit(1), F.col("epochs")), lambda i: F.col("size"))
    copies = F.when((F.col("epochs") > 0) & (F.col("size") > 0), copies).otherwise(F.array().cast("array<long>"))
    parts = F.when(F.col("part").isNotNull(), F.array("part")).otherwise(F.array().cast("array<long>"))
    rows = mixed.select("row", "size", F.explode(F.concat(copies, parts)).alias("_words"))
    body = F.col(f"row.{text}")
    return rows.select(*[
        (F.when(F.col("_words") < F.col("size"), first_words(body, F.col("_words"))).otherwise(body) if c == text else F.col(f"row.`{c}`")).alias(c)
        for c in docs.columns
    ])
