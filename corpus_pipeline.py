"""From raw documents to pieces: language, near duplicates, secrets, mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before kept. All but the last return the
columns of ``docs``; the last adds ``piece_ids``. Null and empty texts have no language and go in the first stage;
empty tables pass through; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import langid, mixing, near_dups, pieces, secrets
from tapeloom.llm.common import stored

# Below this calibrated probability no language is taken as identified.
LEAST_SCORE = 0.35
_PREDICTED = ("_lang_pred_", "_lang_score_")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told (`und`, or a score below LEAST_SCORE)."""
    judged = langid.predict(docs, langid.learned(docs), "text", _PREDICTED)
    sure = (F.col(_PREDICTED[0]) != langid.UNDETERMINED) & (F.col(_PREDICTED[1]) >= LEAST_SCORE)
    return judged.where(sure).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near duplicates (80 % or more of the five-word shingles)."""
    return near_dups.one_of_each(docs, **near_dups.PERCENT_80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; keeps all documents."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources wants it: not at all, once or twice."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of the text's pieces under merge-dropout."""
    return pieces.encode(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("merge_dropout", encode_pieces),
]

# Learned language and Markov models, signatures and merge-dropout cannot be written in SQL; tests/llm compares the
# stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
