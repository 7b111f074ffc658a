"""One query per operator over its whole table, plus the corpus pipeline."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from changegrid.llm import extraction, lattice, mixing, neardup, negatives, packing, pii, piece_counts, quality, repair, repetition, topk, variants
from changegrid.plans.lineage import shared_folder


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(_docs(spark, sf)).drop("fp")


def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf)).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    repair.write_ids(_docs(spark, sf), path)
    return repair.read_ids(spark, path).selectExpr("doc_id", "start", "n_tokens", "crc32(ids) as ids_crc32")


def op4_repetition_rules(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.repetition_rules(_docs(spark, sf))


def op5_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.score_documents(spark, _docs(spark, sf), "pmod(crc32(cast(cast(doc_id as string) as binary)), 7) = 2")


def op6_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_data(_docs(spark, sf))


def op7_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id % 50 = 0")


HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0"


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score_quality(_docs(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), HELD_OUT)


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return piece_counts.count_tokens(_docs(spark, sf))


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_docs(spark, sf)).selectExpr(
        "doc_id", "start", "length", "crc32(ids) as ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return variants.spelling_variants(_docs(spark, sf))


def op12_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.main_text(spark.read.parquet(f"{sf}/pages.parquet"))


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    moved = "if(vec_id % 7 = 0, (label + 1) % 10, label)"
    return negatives.hard_negatives(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id % 50 = 0", moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_token_files": op3_token_files,
    "op4_repetition_rules": op4_repetition_rules,
    "op5_lm_scores": op5_lm_scores,
    "op6_personal_data": op6_personal_data,
    "op7_top_k": op7_top_k,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_html_extraction": op12_html_extraction,
    "op13_hard_negatives": op13_hard_negatives,
}
