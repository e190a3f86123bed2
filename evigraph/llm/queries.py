"""The registered queries of this subpackage and the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evigraph.llm import decontaminate, line_dedup, multiset_fp, packing, pii, quality, secrets, simhash, toxicity, warc
from evigraph.runtime import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later copies of line runs of 50 words or more; null texts stay null."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; null and empty texts are one empty line, ties of score are predicted 1 from 0.5."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; null and empty texts get the score of a text without terms."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in length buckets and batches; null and empty texts have one piece of no tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it; null and empty texts match nothing."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced under the demonstration key; null texts become empty."""
    return pii.pseudonymize(table(spark, sf_dir, "documents"), pii.DEMO_KEY)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document; null texts are empty and have none."""
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null, empty and blank texts share the fingerprint zero."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edit and their likenesses; null texts are empty."""
    return multiset_fp.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives; null html is an empty payload, null ids are kept."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_quality": op2_quality,
        "op3_toxicity": op3_toxicity,
        "op4_packing": op4_packing,
        "op5_decontamination": op5_decontamination,
        "op6_pii": op6_pii,
        "op7_secrets": op7_secrets,
        "op8_simhash": op8_simhash,
        "op9_fingerprints": op9_fingerprints,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.ORACLE, "op4_packing": packing.oracle_sql()}
