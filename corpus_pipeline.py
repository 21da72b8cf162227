"""A training-data pipeline over ``documents`` out of the operators of statlens.llm.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of ``docs``, whatever they are.
NULL, empty and repeated rows are handled as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statlens.llm import decontaminate as _decontaminate
from statlens.llm import language_id as _language_id
from statlens.llm import line_dedup as _line_dedup
from statlens.llm import ngram_join as _ngram_join
from statlens.llm import packing as _packing
from statlens.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go."""
    return _language_id.known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts; ``n_chars`` follows."""
    return _line_dedup.dedup_stage(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 80 per cent of their 5-word shingles one stays."""
    return _ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token sequences: one row per piece."""
    return _packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_join", ngram_join),
          ("decontaminate", decontaminate), ("packing", packing)]

#: A trained model, tokens and alignments can't be said in SQL; the tests hold
#: each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
