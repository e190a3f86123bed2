"""Incremental intake: records normalized and keyed as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.normalize import normalize
from evigraph.ontology import EntityType
from evigraph.operators.blocking import MAX_BLOCK, block_sizes, rule_key


def normalized_stream(raw: DataFrame, entity: EntityType) -> DataFrame:
    """A stream of raw records (key, source and property columns) with known properties normalized."""
    kept = [p for p in entity.properties.values() if p.name in raw.columns]
    return raw.select("key", "source", *[normalize(p.kind, F.col(p.name)).alias(p.name) for p in kept])


def keyed_stream(records: DataFrame, entity: EntityType) -> DataFrame:
    """A stream of ``(key, block)``: the blocks each arriving record falls into, to be joined with stored ones."""
    keys = F.array(*[rule_key(r, records) for r in entity.blocking])
    return records.select("key", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("block"))


def candidate_stream(keyed: DataFrame, stored: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """A stream of ``(key, pos)``: each arriving record with the stored ones that share a block.

    ``stored`` has the blocking keys of known records (``blocking_keys``: pos, rule, block). As
    in batches, blocks of more than ``max_block`` stored records are left out before anything
    meets. A pair that several blocks make comes once for each.
    """
    usable = block_sizes(stored).where(F.col("n") <= max_block).select("block")
    return keyed.join(stored.join(usable, "block", "left_semi").select("block", "pos"), "block").select("key", "pos")
