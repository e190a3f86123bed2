"""Entity resolution over all types, its statistics and its evaluation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators.blocking import MAX_BLOCK, block_statistics, candidate_pairs
from evigraph.operators.clustering import cluster
from evigraph.operators.merge import build_entities
from evigraph.operators.scoring import score_pairs
from evigraph.ontology import Ontology
from evigraph.runtime import count_rows, materialize

REVIEW_LIMIT = 500


@dataclass
class Resolution:
    """What resolution produces; frames are written to shared storage once."""

    entities: DataFrame
    assignment: DataFrame
    review_queue: DataFrame
    stats: dict[str, dict[str, int]] = field(default_factory=dict)

    def total(self) -> dict[str, int]:
        """Sums over types, but the largest block is the largest of all."""
        keys = next(iter(self.stats.values()), {})
        return {k: (max if k == "largest_block" else sum)(s[k] for s in self.stats.values()) for k in keys}


def resolve_type(records: DataFrame, ontology: Ontology, type_name: str, max_block: int = MAX_BLOCK) -> Resolution:
    """Resolve the records of one type (columns key, source, pos and the properties)."""
    entity = ontology.entity(type_name)
    records = materialize(records, f"records-{type_name}")
    stats = {"records": count_rows(records), "blocks": 0, "largest_block": 0, "skipped_blocks": 0, "candidate_pairs": 0, "matches": 0, "review": 0, "conflicts_blocked": 0}
    none = records.select(F.col("key").alias("left"), F.col("key").alias("right"), F.lit(0.0).alias("score")).limit(0)
    if entity.resolvable:
        stats |= {k: int(v) for k, v in block_statistics(records, entity, max_block).first().asDict().items()}
        scored = materialize(score_pairs(records, candidate_pairs(records, entity, max_block), entity), f"pairs-{type_name}")
        counts = {r.verdict: r["count"] for r in scored.groupBy("verdict").count().collect()}
        stats |= {"candidate_pairs": sum(counts.values()), "matches": counts.get("match", 0), "review": counts.get("review", 0)}
        clusters, vetoed = cluster(records, scored.where("verdict = 'match'"), entity)
        stats["conflicts_blocked"] = int(vetoed.agg(F.coalesce(F.sum("vetoes"), F.lit(0))).first()[0])
        keys = records.select("pos", "key")
        review = (
            scored.where("verdict = 'review'")
            .join(keys.withColumnsRenamed({"pos": "l", "key": "left"}), "l")
            .join(keys.withColumnsRenamed({"pos": "r", "key": "right"}), "r")
            .select("left", "right", "score")
        )
    else:
        clusters, review = records.select("pos", F.col("pos").alias("cluster")), none
    entities, assignment = build_entities(records, materialize(clusters, f"clusters-{type_name}"), entity)
    entities, assignment = materialize(entities, f"entities-{type_name}"), materialize(assignment, f"assignment-{type_name}")
    stats["entities"] = count_rows(entities)
    return Resolution(entities, assignment, review, {type_name: stats})


def resolve(records_by_type: dict[str, DataFrame], ontology: Ontology, max_block: int = MAX_BLOCK) -> Resolution:
    """Resolve every type; at most ``REVIEW_LIMIT`` undecided pairs are queued, best first."""
    done = [resolve_type(records_by_type[t], ontology, t, max_block) for t in sorted(records_by_type)]
    out = done[0]
    for more in done[1:]:
        out = Resolution(out.entities.unionByName(more.entities), out.assignment.unionByName(more.assignment), out.review_queue.unionByName(more.review_queue), out.stats | more.stats)
    out.review_queue = out.review_queue.orderBy(F.desc("score"), "left", "right").limit(REVIEW_LIMIT)
    return out


def evaluate(labelled: DataFrame) -> DataFrame:
    """Pairwise precision, recall and F1 per type and overall.

    ``labelled`` has entity_type, entity_id and truth_id for each labelled record. Pairs are
    counted from group sizes, never enumerated.
    """
    rows = labelled.where("truth_id IS NOT NULL AND entity_id IS NOT NULL")
    pairs = F.sum(F.expr("n * (n - 1) div 2"))
    cells = materialize(rows.groupBy("entity_type", "entity_id", "truth_id").agg(F.count(F.lit(1)).alias("n")), "cells", compact=True)
    found = cells.groupBy("entity_type", "entity_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("truths"), F.min("truth_id").alias("truth_id"))
    true = cells.groupBy("entity_type", "truth_id").agg(F.sum("n").alias("n"))
    exact = found.where("truths = 1").join(true, ["entity_type", "truth_id", "n"]).groupBy("entity_type").agg(F.count(F.lit(1)).alias("exact_clusters"))
    per_type = (
        cells.groupBy("entity_type").agg(pairs.alias("tp"), F.sum("n").alias("records"))
        .join(found.groupBy("entity_type").agg(pairs.alias("predicted"), F.count(F.lit(1)).alias("found_entities")), "entity_type")
        .join(true.groupBy("entity_type").agg(pairs.alias("actual"), F.count(F.lit(1)).alias("true_entities")), "entity_type")
        .join(exact, "entity_type", "left")
        .na.fill(0, ["exact_clusters"])
    )
    sums = [F.sum(c).alias(c) for c in ("tp", "records", "predicted", "found_entities", "actual", "true_entities", "exact_clusters")]
    both = per_type.unionByName(per_type.agg(F.lit("overall").alias("entity_type"), *sums))
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(1.0))
    recall = F.when(F.col("actual") > 0, F.col("tp") / F.col("actual")).otherwise(F.lit(1.0))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return both.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1).where("records IS NOT NULL")


def find_errors(labelled: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """False merges (one entity, several truths) and splits (one truth, several entities)."""
    rows = labelled.where("truth_id IS NOT NULL AND entity_id IS NOT NULL")
    merges = rows.groupBy("entity_type", "entity_id").agg(F.array_sort(F.collect_set("truth_id")).alias("truths"), F.count(F.lit(1)).alias("records"))
    splits = rows.groupBy("entity_type", "truth_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"), F.count(F.lit(1)).alias("records"))
    return (
        merges.where(F.size("truths") > 1).orderBy("entity_type", "entity_id").limit(limit),
        splits.where(F.size("entities") > 1).orderBy("entity_type", "truth_id").limit(limit),
    )
