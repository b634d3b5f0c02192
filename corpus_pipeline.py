"""From raw documents to token files: toxicity, near copies, benchmark leaks, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the last return the
columns of documents; the mixing stage returns a row for each copy it takes. Stages are written as Parquet in the
shared folder and read again, so that a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import decontam, jaccard, mixing, tokens, toxicity
from tidemill.llm.store import fold, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 4) != 2)
    return toxicity.clean(docs, machine)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.without_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, marks=False)


def write_token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.token_file(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_output", write_token_file),
]
ORACLE_SQL: str | None = None  # the first stage is a trained model, which SQL cannot express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
