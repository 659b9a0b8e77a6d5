"""Token index, lookups with hot keys, distributed ranks and segmented scans against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from repostrata.operators import block_state, lookup, merges, numbering, token_index

TEXTS = [
    "user name = user.name", "first-name, e-mail and E-mail", "é_1 über-straße", "a@@b @@ c", "passport", "passports pass_port", "", None,
    "x.y.z $user user$", "日本 日本語", "tab\tuser\n", "u" * 5000 + " user",
]
WORDS = ["user", "user.name", "first-name", "e-mail", "mail", "über-straße", "straße", "@@", "passport", "日本", "$user", "user$", "x.y", "absent", "", None, "-", " "]


def test_token_index_finds_what_a_search_finds(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    table = spark.createDataFrame([(w,) for w in WORDS], "word string")
    got = {(r["i"], r["word"]) for r in token_index.whole_word_matches(texts, "t", table, "word").collect()}

    def found(text, word):
        return re.search(r"\b" + re.escape(word) + r"\b", text) is not None

    assert got == {(i, w) for i, t in enumerate(TEXTS) for w in WORDS if t and w and found(t, w)}


def test_ten_thousand_identifiers(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(10_000)]
    table = spark.createDataFrame([(w,) for w in words] + [(f"{a} {b}",) for a, b in zip(words[:500], words[1:501])], "word string")
    lines = [" ".join(rng.choice(words[:3000]) for _ in range(8)) for _ in range(300)] + ["w1 w2 w3"]
    texts = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    found = token_index.whole_word_matches(texts, "t", table, "word")
    want = sum(len(set(x.split())) + len({p for p in zip(x.split(), x.split()[1:]) if p[0] in words[:500] and int(p[1][1:]) == int(p[0][1:]) + 1}) for x in lines)
    assert found.count() == want
    few = token_index.whole_word_matches(texts, "t", table.limit(10), "word")
    size = [len(d._jdf.queryExecution().optimizedPlan().toString()) for d in (found, few)]
    assert size[0] < 1.5 * size[1]


def test_lookup_spreads_hot_keys(spark):
    """One key holds 40 % of the rows; no task of the join reads more than three times its share."""
    rows = spark.range(20_000).select(
        F.col("id"), F.when(F.col("id") % 5 < 2, "react").otherwise(F.concat(F.lit("p"), F.col("id") % 997)).alias("name"),
        F.lit("npm").alias("eco"), (F.col("id") % 3 != 0).alias("ask"),
    ).withColumn("name", F.when(F.col("id") % 1000 != 7, F.col("name")))
    answers = spark.createDataFrame([("npm", "react", 1), ("npm", "p5", 2), ("pip", "p6", 3)], "eco string, name string, v int")
    plain = rows.join(answers, ["eco", "name"], "left").select("id", F.when(F.col("ask"), F.col("v")).alias("v"))
    found = lookup.lookup(rows, answers, ["eco", "name"], F.col("ask"), parts=16)
    assert found.columns == [*rows.columns, "v"]
    assert sorted(map(tuple, found.select("id", "v").collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    hot = lookup.hot_keys(rows.filter("ask"), ["eco", "name"], 16)
    assert list(hot) == ["3:npm5:react"] and hot["3:npm5:react"] >= 6
    salts = rows.filter("ask and name = 'react'").groupBy(F.pmod(F.xxhash64(*rows.columns), F.lit(hot["3:npm5:react"]))).count().collect()
    assert max(r["count"] for r in salts) < 3 * (rows.filter("ask").count() / 16)


def test_lookup_without_rows_or_answers(spark):
    rows = spark.createDataFrame([], "k string, n int")
    answers = spark.createDataFrame([("a", 1)], "k string, v int")
    assert lookup.lookup(rows, answers, ["k"], F.lit(True)).count() == 0
    some = spark.createDataFrame([("a", 1), (None, 2), ("b", None)], "k string, n int")
    got = lookup.lookup(some, answers.where("false"), ["k"], F.col("n") > 0).collect()
    assert sorted(str(r["k"]) for r in got) == ["None", "a", "b"] and all(r["v"] is None for r in got)


@pytest.mark.parametrize("offset, limit", [(0, 5), (37, 20), (95, 20), (100, 3), (500, 10)])
def test_pages(spark, offset, limit):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 2, 3, 4, 5])) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(5)
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[offset : offset + limit]
    assert [tuple(r) for r in numbering.page(df, order, offset, limit, shallow=0).collect()] == want
    assert [tuple(r) for r in numbering.page(df, order, offset, limit).collect()] == want


def test_numbers_are_dense_and_repeat(spark):
    df = spark.createDataFrame([(f"k{i * 7 % 100:03}",) for i in range(100)], "k string").repartition(7)
    first = {r["k"]: r["n"] for r in numbering.numbered(df, [F.col("k")], "n", 40).collect()}
    assert first == {f"k{i:03}": 41 + i for i in range(100)}
    assert first == {r["k"]: r["n"] for r in numbering.numbered(df.repartition(3), [F.col("k")], "n", 40).collect()}
    assert numbering.numbered(df.where("false"), [F.col("k")], "n").count() == 0


def test_new_rows_get_free_ids(spark):
    """Ids go on from the largest stored one; an empty table starts at 1."""
    have = spark.createDataFrame([(5, "a"), (900, "b")], "id long, name string")
    want = spark.createDataFrame([("c",), ("a",), ("c",), ("d",)], "name string")
    assert {(r["id"], r["name"]) for r in merges.get_or_create(have, want, ["name"]).collect()} == {(5, "a"), (900, "b"), (901, "c"), (902, "d")}
    assert {(r["id"], r["name"]) for r in merges.get_or_create(have.where("false"), want, ["name"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


@pytest.mark.parametrize("segment, fan", [(1, 2), (3, 2), (4, 4), (4096, 256)])
def test_block_state(spark, segment, fan):
    """Files of any length, cut anywhere, come to the state that a walk from line to line gives."""
    rng = random.Random(4)
    files = {f: [rng.choice(["do", "end", "x", "do end"]) for _ in range(n)] for f, n in (("a", 1), ("b", 40), ("c", 133), ("d", 7))}
    rows = [(f, i, x, i) for f, lines in files.items() for i, x in enumerate(lines, 1)]
    df = spark.createDataFrame(rows, "f string, n long, line string, other int").repartition(6)
    step = block_state.nesting(F.col("line").contains("do"), F.col("line").contains("end"), 2)
    got = {(r["f"], r["n"], r["line"]): r["state"] for r in block_state.block_state(df, ["f"], "n", step, 3, segment, fan).collect()}
    want = {}
    for f, lines in files.items():
        now = 0
        for i, x in enumerate(lines, 1):
            now = min(now + 1, 2) if x == "do" else max(now - 1, 0) if x == "end" else now
            want[f, i, x] = now
    assert got == want
    assert block_state.block_state(df.where("false"), ["f"], "n", step, 3).count() == 0
