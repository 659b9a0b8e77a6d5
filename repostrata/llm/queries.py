"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, collocations, dartminhash, fmindex, hnsw, langid, licences, linedup, mixing, packing, quality, ranking, secrets
from .common import crc32_of_id, new_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = linedup.line_groups(_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "line_no", F.col("group").alias("group_id"), "kept")


def op2_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(_table(spark, folder, "embeddings"), F.col("id") % 50 == 0)


def op4_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return hnsw.near_vectors(_table(spark, folder, "embeddings"))


def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dartminhash.near_duplicates(_table(spark, folder, "documents"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, folder, "documents"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, folder, "documents"), new_path(spark, "ledger"))
    return secrets.digest(found)


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = crc32_of_id(F.col("doc_id")) % 4 == 2
    model = langid.train(docs, ~held_out)
    predicted = langid.predict(docs, model, carry=["doc_id"])
    ids = predicted.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score")
    return ids.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan(_table(spark, folder, "documents").select("doc_id", "text"))
    best = F.array_sort("found", lambda a, b: F.when(a["dice"] != b["dice"], F.signum(b["dice"] - a["dice"])).otherwise(a["template"] - b["template"]).cast("int"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.try_element_at(best, F.lit(1))["license"].alias("license"),
        F.try_element_at(best, F.lit(1))["dice"].alias("dice"), F.size("found").alias("n_templates"), "found",
    )


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    learned = quality.train(docs, _table(spark, folder, "labels"), crc32_of_id(F.col("id")) % 5 != 0)
    ids = quality.score(docs, learned).select(F.col("row.doc_id").alias("doc_id"), "score")
    return ids.select(
        "doc_id", (crc32_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = fmindex.find(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), ["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_nearest": op2_nearest,
    "op3_near_dedup": op3_near_dedup,
    "op4_near_vectors": op4_near_vectors,
    "op5_mixing": op5_mixing,
    "op6_secrets": op6_secrets,
    "op7_language": op7_language,
    "op8_packing": op8_packing,
    "op9_licences": op9_licences,
    "op10_quality": op10_quality,
    "op11_decontamination": op11_decontamination,
    "op12_ranked_search": op12_ranked_search,
    "op13_collocations": op13_collocations,
}


def _spans_sql() -> str:
    """Each kind's hits and the pieces between them; positions are running sums of lengths."""
    kinds = []
    for number, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        kinds.append(f"""SELECT doc_id, {number} AS number, '{rule.name}' AS kind, i, hit,
            end_at - length(hit) AS start_at, end_at FROM (
          SELECT doc_id, i, hits[i] AS hit, (list_sum([length(x) FOR x IN hits[1:i]]) + list_sum([length(x) FOR x IN gaps[1:i]]))::BIGINT AS end_at FROM (
            SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
              SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d WHERE regexp_matches(t, '{pattern}'))))
          WHERE length(regexp_extract(hit, '{pattern}', {rule.group})) >= {rule.least}""")
    return " UNION ALL ".join(kinds)


SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_spans_sql()}),
told AS (SELECT doc_id, string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, number) AS spans,
    string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, number) FILTER (number < {len(secrets.BASE)}) AS base,
    {", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in secrets.BASE)}
  FROM found GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.name}, 0) AS n_{r.name}" for r in secrets.BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (doc_id)
"""

#: All links by brute force, and the smallest id that they reach.
NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM parts
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

#: Every window of every document, joined with those of the items.
DECONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, w, least({fmindex.WINDOW}, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, list_slice(w, p, p + k - 1) AS phrase FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM b)),
places AS (SELECT i, k, p, list_slice(w, p, p + k - 1) AS phrase FROM (
  SELECT i, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM windows))),
hits AS (SELECT i, p, k, item_id FROM places JOIN windows USING (k, phrase)),
words AS (SELECT i, count(DISTINCT place) AS n_hit FROM (SELECT i, unnest(range(p, p + k)) AS place FROM (SELECT DISTINCT i, p, k FROM hits)) GROUP BY i),
items AS (SELECT i, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT i, item_id FROM hits) GROUP BY i)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (i) LEFT JOIN items USING (i)
"""

#: Every document scored for every item.
RANKED_SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS big_n, sum(len(w))::BIGINT AS big_l FROM d),
m AS (SELECT i, doc_id, 10 + (90 * len(w) * big_n) // big_l AS m FROM d, t WHERE len(w) > 0),
tf AS (SELECT i, word, count(*) AS tf FROM (SELECT i, unnest(w) AS word FROM d) GROUP BY ALL),
weights AS (SELECT word, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM (SELECT word, count(*) AS df FROM tf GROUP BY word), t),
items AS (SELECT DISTINCT k, item_id, word FROM (SELECT k, item_id, unnest(w) AS word FROM (SELECT row_number() OVER () AS k, item_id, {_WORDS} AS w FROM benchmark))),
scores AS (SELECT k, item_id, doc_id, i, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM items JOIN weights USING (word) JOIN tf USING (word) JOIN m USING (i) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= {ranking.TOP}
"""

#: All phrases counted, whatever their number.
COLLOCATIONS_SQL = rf"""
WITH pieces AS (SELECT row_number() OVER () AS i, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (SELECT lang, k, list_slice(w, p, p + k - 1) AS g FROM (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM pieces, (SELECT unnest(range(1, {collocations.LONGEST + 1})) AS k))),
f AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
c AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1),
inner_parts AS (SELECT lang, list_slice(g, p, p + s - 1) AS g, max(a) AS longer FROM (
  SELECT *, unnest(range(1, k - s + 2)) AS p FROM (SELECT *, unnest(range(2, k)) AS s FROM c WHERE k > 2)) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inner_parts USING (lang, g) WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (SELECT kept.*, cut, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) kept JOIN n USING (lang)
  JOIN f x ON x.lang = kept.lang AND x.g = list_slice(kept.g, 1, cut) JOIN f y ON y.lang = kept.lang AND y.g = list_slice(kept.g, cut + 1, kept.k)),
best AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best) WHERE rank <= {collocations.TOP}
"""

SQL: dict[str, str] = {
    "op4_near_vectors": NEAR_VECTORS_SQL,
    "op6_secrets": SECRETS_SQL,
    "op11_decontamination": DECONTAMINATION_SQL,
    "op12_ranked_search": RANKED_SEARCH_SQL,
    "op13_collocations": COLLOCATIONS_SQL,
}
