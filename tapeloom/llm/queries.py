"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import (ann, chats, decontam, exact_search, hard_negatives, langid, mixing, near_dups, pieces, secrets, sharding, toxicity,
                          turn_repair)
from tapeloom.plans.registry import Query

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


SQL["op4_near_duplicates"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
                      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
sized AS (SELECT doc_id, s, CAST(len(s) AS BIGINT) AS n FROM sets),
single AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS total, count(*) AS common
  FROM single a JOIN single b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (SELECT x, y FROM shared WHERE 100 * common >= 85 * (total - common)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sized UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
named AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN named USING (doc_id)
"""


@register
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: fixed formats and what the Markov models add."""
    return secrets.scan(table(spark, sf_dir, "documents"))


@register
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


@register
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    rows = plan.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@register
def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document under merge-dropout, and the round trip back to its text."""
    return pieces.summary(table(spark, sf_dir, "documents"))


@register
def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of near equal bytes."""
    return sharding.text_shards(table(spark, sf_dir, "documents"))


@register
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector, components in steps of 1/256."""
    steps = F.transform("v", lambda x: F.floor(x * 256).cast("double"))
    found = exact_search.exact_top_k(table(spark, sf_dir, "embeddings"), 50, 5, prepare=steps)
    return found.withColumn("score", F.col("score").cast("long"))


SQL["op3_exact_top_k"] = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@register
def op9_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the twenty largest inner products of every twentieth vector."""
    return ann.approximate_top_k(table(spark, sf_dir, "embeddings"), 20, 20)


@register
def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the windows of each conversation hold, read back from them; with a conversation made of control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = rows.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chats.read_back(chats.windows(rows.unionByName(hard))).withColumnRenamed("conv", "conv_id")


@register
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What benchmark windows hit in every document."""
    return decontam.summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op11_decontaminate"] = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, CAST(least(len(w), 10) AS BIGINT) AS n,
         unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS g
  FROM bw WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM grams),
placed AS (
  SELECT r, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: struct_pack(i := i, g := array_to_string(w[i:i + n - 1], ' ')))) AS p
  FROM dw, lengths WHERE len(w) >= n),
hits AS (SELECT r, p.i AS i, n, item_id FROM placed JOIN grams USING (n) WHERE p.g = g),
words AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS word FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


@register
def op12_repair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of every conversation after damage."""
    rows = table(spark, sf_dir, "conversations")
    return turn_repair.report(turn_repair.damage(rows), rows.select(F.col("conv_id").alias("conv")), "conv").withColumnRenamed("conv", "conv_id")


@register
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten hardest negatives inside the window of each of the five positives of every hundredth vector."""
    steps = F.transform("v", lambda x: F.floor(x * 256).cast("double"))
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=label, prepare=steps)


SQL["op13_hard_negatives"] = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
