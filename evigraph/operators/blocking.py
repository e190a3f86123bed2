"""Candidate generation: blocking keys, block sizes, distinct candidate pairs.

Records are a DataFrame with ``pos`` (a unique long that orders them) and one column per
normalized property.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.functions.normalize import soundex
from evigraph.ontology import BlockingRule, EntityType
from evigraph.runtime import materialize

#: Blocks with more records have lost their selectivity and are left out.
MAX_BLOCK = 400


def rule_key(rule: BlockingRule, records: DataFrame) -> Column:
    """The record's key under a rule; NULL if a property is missing."""
    parts = []
    for name in rule.properties:
        value = F.try_element_at(name, F.lit(1)) if isinstance(records.schema[name].dataType, T.ArrayType) else F.col(name)
        plain = text = F.nullif(value.cast("string"), F.lit(""))
        if rule.strategy == "prefix":
            text = F.substring(text, 1, rule.length)
        elif rule.strategy == "soundex":
            words = F.filter(F.split(text, " "), lambda w: w != "")
            long = F.filter(words, lambda w: F.length(w) > 1)
            words = F.when(F.size(long) > 0, long).otherwise(words)
            text = F.concat(soundex(F.try_element_at(words, F.lit(1))), soundex(F.try_element_at(words, F.lit(-1))))
        elif rule.strategy == "sorted_tokens":
            letters = F.array_sort(F.filter(F.split(F.replace(text, F.lit(" "), F.lit("")), ""), lambda c: c != ""))
            text = F.array_join(F.slice(letters, 1, rule.length), "")
        parts.append(F.when(plain.isNotNull(), text))
    missing = parts[0].isNull()
    for p in parts[1:]:
        missing = missing | p.isNull()
    return F.when(~missing, F.concat(F.lit(f"{rule.name}:"), F.concat_ws("|", *parts)))


def blocking_keys(records: DataFrame, entity: EntityType) -> DataFrame:
    """``(pos, rule, block)`` for every key of every record."""
    keys = F.array(*[F.struct(F.lit(i).alias("rule"), rule_key(r, records).alias("block")) for i, r in enumerate(entity.blocking)])
    return (
        records.select("pos", F.explode(F.filter(keys, lambda k: k["block"].isNotNull())).alias("k"))
        .select("pos", F.col("k.rule").alias("rule"), F.col("k.block").alias("block"))
    )


def block_sizes(keys: DataFrame) -> DataFrame:
    """``(block, n, first_pos)`` per block."""
    return keys.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def candidate_pairs(records: DataFrame, entity: EntityType, max_block: int = MAX_BLOCK) -> DataFrame:
    """``(l, r, first_pos, rule)``: distinct pairs, l before r, with the block that made them first.

    Sizes are counted before members meet, so a block over ``max_block`` never expands.
    """
    keys = materialize(blocking_keys(records, entity), "block-keys", compact=True)
    usable = block_sizes(keys).where((F.col("n") >= 2) & (F.col("n") <= max_block)).select("block", "first_pos")
    kept = keys.join(usable, "block")
    left = kept.select("block", "first_pos", "rule", F.col("pos").alias("l"))
    right = kept.select("block", F.col("pos").alias("r"))
    return (
        left.join(right, "block")
        .where("l < r")
        .groupBy("l", "r")
        .agg(F.min("first_pos").alias("first_pos"), F.min_by("rule", F.struct("first_pos", "rule")).alias("rule"))
    )


def block_statistics(records: DataFrame, entity: EntityType, max_block: int = MAX_BLOCK) -> DataFrame:
    """One row: blocks, largest_block, skipped_blocks."""
    return block_sizes(blocking_keys(records, entity)).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest_block"),
        F.count_if(F.col("n") > max_block).alias("skipped_blocks"),
    )
