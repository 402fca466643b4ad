"""Corpus pipeline over ``documents``: language ID, exact de-duplication,
near-duplicate removal, benchmark decontamination, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes each result as Parquet in the shared folder and reads it back as the next
stage's input, so a lost executor costs at most the stage at hand. All stages
but the last return the columns of their input, extra ones included.

Defined results: an empty table passes through all stages; if no row can teach a
language (all labels null, or only on rows kept aside), the first stage keeps
every text that has a letter; rows with a null text
are rejected by the first stage (their language is ``und``); see the operators
for null ids and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import bpe, decontaminate, exact_dedup, language_id, near_dedup
from vigil.llm.common import is_written, materialise, scratch, small_batches, unused

MIN_LANGUAGE_SCORE = 0.3
SHINGLE_WORDS = 5


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: texts without a letter and texts whose
    best language scores under ``MIN_LANGUAGE_SCORE`` go. Without a language to
    tell, only texts without a letter go."""
    model = language_id.fit(language_id.training_rows(docs))
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score = unused(docs, "lang", "score")
    return language_id.identify(docs, model, lang, score).filter(
        (F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).drop(lang, score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, whatever its white space."""
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a shingle similarity of 0.8 or more."""
    return near_dedup.drop_near(docs, SHINGLE_WORDS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised ones included."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding them gives the text back."""
    rows = bpe.checked(docs.select("doc_id", "lang", "source", "text"), bpe.default_tokenizer(spark))
    rows = rows.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"),
                       "token_ids", "round_trip")
    # Written here, so that the batches are small while workers and caches are large;
    # texts and decoded bytes never come back from the workers.
    with small_batches(spark, 500, 4_000_000):
        return materialise(rows, "tokens")


STAGES = [
    ("language_id", keep_identified),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("byte_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as results:
        for name, stage in STAGES:
            # The stage's own tables go as soon as its result is written.
            with scratch(spark) as inner:
                out = stage(spark, docs, sf_dir)
                docs = inner.keep(out if is_written(out) else materialise(out, f"pipeline-{name}"))
        return results.keep(docs)


# A trained model decides in the first stage, so SQL cannot express the rows;
# tests/llm holds run() against a brute-force version.
ORACLE_SQL = None
