"""Secret scans over an incremental ledger of blobs.

Every version of a file is addressed by the hash of its content. A ledger, a table in a
folder of the caller's, remembers each (blob, rule, rule version) that was scanned and
what was found. A run scans only pairs the ledger lacks, each distinct content once,
appends them, and joins all findings back to every path and version that holds the blob.
Only built-in functions are used: matches come from the regular-expression functions,
their positions from running sums of piece lengths.

Defined cases: a null text is an empty one; equal texts are one blob; a blob without
findings is remembered with none; an empty table gives an empty result; other columns of
the input are never looked at. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts, and its least length."""

    name: str
    version: int
    pattern: str
    group: int
    least: int


#: The base kinds in their listed order.
BASE = [
    Rule("assign", 1, r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),  # maximal runs, so the shorter ones may be left out at once
]
#: More kinds, after the base ones.
MORE = [
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
]
RULES = [*BASE, *MORE]

LEDGER_COLUMNS = ["blob binary", "rule string", "version int", "spans array<struct<start:int,end:int>>"]
LEDGER = ", ".join(LEDGER_COLUMNS)


def blob_id(text: Column) -> Column:
    """Content address: SHA-256 of the UTF-8 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Spans of each rule in (blob, text, todo = names of rules to run), as ledger rows."""

    def of(make) -> Column:
        chosen = F
        for r in rules:
            chosen = chosen.when(F.col("rule") == r.name, make(r))
        return chosen

    tried = blobs.select("blob", "text", F.explode("todo").alias("rule"))
    matched = tried.select(
        "blob", "text", "rule",
        of(lambda r: F.when(F.col("text").rlike(r.pattern), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)))).alias("hits"),
    )
    cut = matched.select(
        "blob", "rule",
        F.when(F.size("hits") > 0, F.arrays_zip(
            F.transform("hits", F.length).alias("width"),
            F.transform(F.slice(of(lambda r: F.split("text", r.pattern, -1)), F.lit(1), F.size("hits")), F.length).alias("gap"),
            F.transform("hits", lambda m: of(lambda r: F.length(F.regexp_extract(m, r.pattern, r.group)) >= r.least)).alias("valid"),
        )).alias("steps"),
    )
    upto = Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.where("steps is not null").select("blob", "rule", F.posexplode("steps").alias("pos", "s")).select(
        "blob", "rule", "s.valid", "s.width", F.sum(F.expr("s.gap + s.width")).over(upto).alias("end")
    ).where("valid").groupBy("blob", "rule").agg(
        F.array_sort(F.collect_list(F.struct(F.expr("int(end - width)").alias("start"), F.expr("int(end)").alias("end")))).alias("spans")
    )
    return placed.select("blob", "rule", of(lambda r: F.lit(r.version)).alias("version"), "spans")


def update_ledger(docs: DataFrame, ledger: str, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Scan what the ledger lacks, append it, and return the whole ledger.

    Appending is one Parquet write, committed at its end; a run that is repeated after a
    failure scans again what was not committed. Pairs without findings are kept too.
    """
    spark = docs.sparkSession
    versions = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", blob_id(F.col("text")))
    current = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    # an empty append makes the folder a table on the first run
    empty = spark.range(0).selectExpr(*[f"cast(null as {kind}) as `{name}`" for name, kind in (c.split(" ", 1) for c in LEDGER_COLUMNS)])
    empty.write.mode("append").parquet(ledger)
    known = spark.read.schema(LEDGER).parquet(ledger).groupBy("blob").agg(
        F.collect_set(F.struct("rule", "version")).alias("known")
    )
    unseen = versions.groupBy("blob").agg(F.first("text").alias("text")).join(known, "blob", "left").select(
        "blob", "text",
        F.transform(F.array_except(current, F.coalesce("known", F.array().cast("array<struct<rule:string,version:int>>"))), lambda x: x["rule"]).alias("todo"),
    ).where(F.size("todo") > 0)
    path = new_path(spark, "unseen")
    unseen.write.option("compression", "zstd").parquet(path)
    fresh = spark.read.schema(unseen.schema).parquet(path)
    found = scan(fresh, rules)
    version = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.version)])
    pairs = fresh.select("blob", F.explode("todo").alias("rule")).withColumn("version", version[F.col("rule")])
    pairs.join(found, ["blob", "rule", "version"], "left").select(
        "blob", "rule", "version", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans")
    ).write.mode("append").option("compression", "zstd").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger)


def find_secrets(docs: DataFrame, ledger: str, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Every input row's id and blob with `found`, an array of (start, kind number, kind, end)
    by start and then by the order of the rules."""
    book = update_ledger(docs, ledger, text, rules)
    number = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    current = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.version)])
    per_blob = book.where(F.col("version") == current[F.col("rule")]).where(F.size("spans") > 0).select(
        "blob", F.explode(F.transform("spans", lambda s: F.struct(
            s["start"].alias("start"), number[F.col("rule")].alias("number"), F.col("rule").alias("kind"), s["end"].alias("end")
        ))).alias("f")
    ).groupBy("blob").agg(F.array_sort(F.collect_set("f")).alias("found"))
    paths = docs.select(F.col(doc_id).alias("doc_id"), blob_id(F.col(text)).alias("blob"))
    none = F.array().cast("array<struct<start:int,number:int,kind:string,end:int>>")
    return paths.join(per_blob, "blob", "left").select("doc_id", "blob", F.coalesce("found", none).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    def n(kind: str) -> Column:
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda f: f["number"] < len(BASE))
    return found.select(
        "doc_id", *[n(r.name) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans")
    )
