"""From raw documents to a training mix, in five stages; each is written as Parquet and read again by the next.

Stages work on documents (doc_id, text, lang, source, n_chars). All but the last return those columns:

1. language_id drops documents without a language: no letters, or no language that carries MIN_SCORE of the words.
2. near_dedup keeps one document of each group of near copies (five words, similarity 0.8).
3. decontaminate drops documents that hold a window of a benchmark item.
4. secret_scan replaces secrets in the texts; no document goes.
5. mix_sources gives each document its share of the mix and its training positions.

Defined cases, whatever columns hold: a null or blank text, or one without letters, has no language and goes in stage 1; rows
without an id are kept and told apart by their text, equal ones count as copies; of equal rows one stays, as of all
copies; ids on several texts lose none of them that is no copy; a null source is a source of its own; ties are broken by id
and hash; other columns, whatever their names, pass through the first four stages unread; an empty table gives none.
Very long texts are walked in linear time and in pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import decontam, langid, mixing, neardup, secrets
from rosterlake.llm.common import remainder, stored, sweep, table, written

MIN_SCORE = 0.35

#: SQL cannot express the learned and the sketched stages; tests hold the stages against plain Python.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.filter(remainder(F.col("doc_id"), 4) != 2))
    return langid.retain(docs, model, min_score=MIN_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.curriculum(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row. A stage's own tables, and its input, are removed once its output is written."""
    docs, since = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        sweep(docs, since)
    return docs
