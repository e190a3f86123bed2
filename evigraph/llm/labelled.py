"""Training rows from a table of labels: all of them, or a bounded, reproducible sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.runtime import bound_batches, hash_sample


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Documents whose labels may not be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, limit: int | None) -> DataFrame:
    """``(doc_id, text, y)`` of the labelled documents that are not held out, at most ``limit`` if it is given.

    A sample is the ``limit`` smallest hashes of doc_id, so it does not depend on how the
    tables are laid out. A document labelled twice takes the larger label; a repeated id
    gives one text.
    """
    marks = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    marks = marks.groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if limit is None:
        texts, sample = texts.where(~held_out()), marks
    else:
        sample = F.broadcast(hash_sample(marks, ["doc_id"], limit))  # ``limit`` rows at most
    return texts.join(sample, "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text")).select("doc_id", "text", "y")


def fit_in_one_task(sample: DataFrame, features: Callable, shape: str, fit: Callable) -> bytes | None:
    """The model that ``fit`` yields from the features of a bounded sample, in order of doc_id.

    Features are made where the texts are; the fit takes the memory of an executor's worker
    instead of the driver's, is repeated if that executor is lost, and gives one row
    ``model``. None if there is no row to learn from.
    """
    bound_batches(sample.sparkSession)
    kind = sample.schema["doc_id"].dataType.simpleString()
    made = sample.select("text", "y", "doc_id").mapInArrow(features, f"{shape}, y int, doc_id {kind}")
    row = made.repartition(1).sortWithinPartitions("doc_id").mapInArrow(fit, "model binary").first()
    return bytes(row.model) if row else None
