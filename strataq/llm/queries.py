"""Queries of the training-data problems, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm.chunking import split_oversized
from strataq.llm.defects import defective_pairs
from strataq.llm.mixing import budgets, mix_sources, mixture_report
from strataq.llm.packing import container_fill, pack_documents
from strataq.llm.readability import fitted_levels
from strataq.llm.tokens import token_sizes
from strataq.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves that the splitter cut."""
    return split_oversized(table(spark, sf_dir, "chunk")).where("part = 1").select("chunk_id")


def p2_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunk"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defective_pairs(table(spark, sf_dir, "api_request"), table(spark, sf_dir, "api_response"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = table(spark, sf_dir, "container_spec").where("capacity > 0").distinct().collect()  # a fixed table of three rows
    return pack_documents(token_sizes(table(spark, sf_dir, "documents")), [(r["spec_name"], r["capacity"]) for r in specs])


def p5_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p5_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_fill(_packed(spark, sf_dir))


def p6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(token_sizes(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_target"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = token_sizes(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_target")
    return mixture_report(mix_sources(sizes, targets), budgets(sizes, targets))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_label"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).where("band IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("band").alias("band"))


def p7_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("doc_id", F.round("grade", 3).alias("grade"), "band", "english_words", "english_sentences")


QUERIES = {f.__name__: f for f in (p2_found, p2_parts, p3_found, p5_containers, p5_fill, p6_mixture, p6_report, p7_found, p7_levels)}

ORACLES = {
    "p2_found": """SELECT DISTINCT chunk_id FROM (SELECT chunk_id, arg_max(leaf_text, ingested_at) AS t FROM chunk GROUP BY chunk_id)
        WHERE len(regexp_extract_all(t, '[^ \\n]+')) > 1000""",
}
