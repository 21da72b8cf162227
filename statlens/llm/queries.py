"""The registered queries of the operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statlens.llm import decontaminate as _decontaminate
from statlens.llm import language_id as _language_id
from statlens.llm import line_dedup as _line_dedup
from statlens.llm import lm_score as _lm_score
from statlens.llm import main_text as _main_text
from statlens.llm import nearest as _nearest
from statlens.llm import ngram_join as _ngram_join
from statlens.llm import packing as _packing
from statlens.llm import quality as _quality
from statlens.llm import resampling as _resampling
from statlens.llm import secrets as _secrets
from statlens.llm import spelling as _spelling
from statlens.llm import substring_dedup as _substring_dedup


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at 90 per cent of common 3-word shingles."""
    return (_ngram_join.ngram_join(_t(spark, sf_dir, "documents"), width=3, percent=90)
            .select("doc_id", "n_shingles", "component_id"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every vector whose id is divisible by 20."""
    return _nearest.nearest(_t(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three folds of four."""
    return _language_id.language_id(_t(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, digest of the base spans, all spans."""
    return _secrets.secrets(_t(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from four folds of five of the labels."""
    return _quality.quality(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with later repeated runs of lines deleted."""
    return (_line_dedup.line_dedup(_t(spark, sf_dir, "documents"))
            .select("doc_id", "text", F.col("_ld_deleted").alias("deleted_lines")))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's stupid-backoff score under the whole corpus."""
    return (_lm_score.lm_score(_t(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"),
                    F.round("mean_log_score", 6).alias("mean_log_score"), "backed_off"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return _packing.pack(_t(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return _main_text.main_text(_t(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the best alignment of each."""
    return (_decontaminate.contaminated(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))
            .select("doc_id", "item_id", "score", "item_words", "similarity", "end_word"))


def op11_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with its near words' number, form and root."""
    return (_spelling.spelling_forms(_t(spark, sf_dir, "documents"))
            .select("word", "form", "root", "n", "n_near", "form_n"))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's words, and the rank of the drawn ones."""
    return (_resampling.importance_resample(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))
            .select("doc_id", "n_features", "weight", "score", "rank"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words without those of passages of 35 words that stand elsewhere too."""
    return (_substring_dedup.substring_dedup(_t(spark, sf_dir, "documents"))
            .select("doc_id", F.col("_sd_words").alias("n_words"), F.col("_sd_removed").alias("n_removed"),
                    F.col("_sd_sha256").alias("kept_sha256")))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_nearest": op2_nearest,
    "op3_language_id": op3_language_id,
    "op4_secrets": op4_secrets,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_packing": op8_packing,
    "op9_main_text": op9_main_text,
    "op10_decontaminate": op10_decontaminate,
    "op11_spelling_forms": op11_spelling_forms,
    "op12_importance_resample": op12_importance_resample,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLE_SQL = {
    "op1_ngram_join": _ngram_join.ORACLE_SQL,
    "op2_nearest": _nearest.ORACLE_SQL,
    "op6_line_dedup": _line_dedup.ORACLE_SQL,
    "op7_lm_score": _lm_score.ORACLE_SQL,
    "op11_spelling_forms": _spelling.ORACLE_SQL,
    "op12_importance_resample": _resampling.ORACLE_SQL,
    "op13_substring_dedup": _substring_dedup.ORACLE_SQL,
}
