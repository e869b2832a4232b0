"""A training-data pipeline over ``documents``: language, near-duplicates, benchmark passages, tokens.

Each stage takes the documents that its predecessor kept and, but for the last,
returns the same columns.  Rows are judged by their texts, so rows without a
doc_id and repeated rows are treated like the others; an empty table passes
through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pixloom.llm import bpe, decontam, jaccard_join, lang_id
from pixloom.llm.common import ensure_checkpoint_dir, remove
from pixloom.llm.queries import TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised; the labelled ones teach the model."""
    model = lang_id.fit(docs)
    return lang_id.predict(docs.select(*COLUMNS), model).where("NOT lang_rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component, that of the smallest doc_id; documents without words have no duplicates."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark passage."""
    return decontam.without_passages(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left: one row of token ids and digests for each document."""
    return bpe.bpe_encode(docs, TOKENIZER)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", benchmark_passages),
    ("bpe", tokens),
]

#: Languages are learnt and merges are sequential: SQL cannot say the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it wrote is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
