"""A corpus made ready for training: five stages over ``documents``, each on all that the last one kept.

language_id       documents without a known language go
near_duplicates   of each group of near-duplicates the document with the smallest id stays
decontamination   documents that overlap the benchmark go
secrets           secrets are replaced by a mark; all documents stay
packing           the rest is packed into windows; one row per piece

Each stage returns the columns of ``documents`` but for the last. A repeated
id counts as one document from near_duplicates on; rows with a null id stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortry.llm import decontaminate, language, packing, secrets, simhash
from cohortry.llm.common import stored, table

LEAST_LANGUAGE_SCORE = 0.2
WINDOW = 4096
END_ID = 2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, language.train(docs.where(~language.held_out())), LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_marks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, length="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), WINDOW, END_ID)


STAGES = [
    ("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("secrets", secret_marks), ("packing", pack),
]

ORACLE_SQL = None  # SQL can't express the stages; tests/llm compares the run with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
