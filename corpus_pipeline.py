"""Preparing training text: toxicity, line dedup, near-dedup, decontamination, packing.

``STAGES`` lists the stages; each takes ``(spark, docs, sf_dir)`` and returns a DataFrame
that is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import decontaminate, line_dedup, packing, simhash, toxicity
from evigraph.runtime import materialize, release, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not reject, row by row.

    Null and empty texts get the score of a text without terms and stay; with no usable labels
    nothing is rejected.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without later copies of repeated line runs; ``n_chars`` is counted anew.

    A document that consists of such copies stays with an empty text, for the next stage to
    merge with its like. A null text stays null with a null ``n_chars``; rows equal in id and
    text are one document and all keep its result.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    clean = line_dedup.dedup_lines(docs, carry=others)
    kind = dict(docs.dtypes).get("n_chars", "bigint")
    return clean.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Null and empty texts are equal; repeated rows count once; null ids come last.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in length buckets and token-budget batches.

    Null and empty texts have one piece of no tokens; null ids come first.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot express the classifier, the fingerprints or the latent search; tests compare
#: the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's output written to the shared folder.

    An empty table passes through every stage; columns beyond those of ``documents`` are kept
    until packing, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
