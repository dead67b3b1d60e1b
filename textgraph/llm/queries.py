"""The queries of this subpackage, by name; each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgraph.llm import sql
from textgraph.llm.common import table
from textgraph.llm.line_dedup import line_dedup_digest
from textgraph.llm.maxent_lm import lm_query
from textgraph.llm.near_dedup import near_duplicates
from textgraph.llm.packing import packing_digest
from textgraph.llm.sentence_pieces import pieces_digest
from textgraph.llm.spann import nearest
from textgraph.llm.token_files import token_ids_digest
from textgraph.llm.toxicity import toxicity_query
from textgraph.llm.va_topk import exact_top_k
from textgraph.llm.warc import warc_digest


def tokenizer(name: str) -> str:
    """Where a file of a public tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids_digest(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 256).cast("double"))
    finite = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(1.0))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.when(~F.exists(finite, lambda x: x.isNull()), whole).alias("embedding"))
    return exact_top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digest(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digest(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_digest(spark, table(spark, sf_dir, "pages"))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_digest(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85)


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_query(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_ids, op2_exact_top_k, op3_line_dedup, op4_packing, op5_warc, op6_sentence_pieces, op7_toxicity, op8_near_duplicates, op9_language_model, op10_nearest)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_top_k": sql.EXACT_TOP_K, "op5_warc": sql.WARC, "op8_near_duplicates": sql.NEAR_DUPLICATES}
