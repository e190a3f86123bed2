"""From a folder of sources to an analysed graph."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import risk
from evigraph.operators.graph import KnowledgeGraph, dangling_links, fold, graph_stats, observations, rewire
from evigraph.operators.resolve import Resolution, evaluate, find_errors, resolve
from evigraph.ontology import Ontology, default_ontology
from evigraph.runtime import count_rows, materialize, release
from evigraph.sources.adapters import ingest, read_truth

RISK_FLAG = 0.5


@dataclass
class Run:
    """All outputs of one run."""

    graph: KnowledgeGraph
    resolution: Resolution
    assignment: DataFrame
    seeds: DataFrame
    findings: DataFrame
    attributed: DataFrame
    risk: DataFrame
    communities: DataFrame
    modularity: DataFrame
    cases: DataFrame
    flags: DataFrame
    labelled: DataFrame | None = None
    ingested: dict[str, int] = field(default_factory=dict)
    timings: dict[str, float] = field(default_factory=dict)

    def evaluation(self) -> DataFrame | None:
        return None if self.labelled is None else evaluate(self.labelled)

    def errors(self, limit: int = 10):
        return None if self.labelled is None else find_errors(self.labelled, limit)

    def save(self, path: str) -> None:
        """The graph, findings, cases, evaluation and statistics."""
        self.graph.save(f"{path}/graph")
        tables = {"findings": self.findings.withColumn("severity", F.round("severity", 3)), "cases": self.cases, "risk": self.risk, "communities": self.communities, "graph_stats": graph_stats(self.graph.entities, self.graph.edges, self.graph.dangling)}
        if self.labelled is not None:
            tables["evaluation"] = self.evaluation()
        for name, frame in tables.items():
            frame.write.mode("overwrite").json(f"{path}/{name}")
        spark = self.findings.sparkSession
        rows = [(t, k, int(v)) for t, s in {**self.resolution.stats, "total": self.resolution.total()}.items() for k, v in s.items()]
        spark.createDataFrame(rows, "entity_type string, measure string, n long").write.mode("overwrite").json(f"{path}/resolution_stats")


def watchlisted(entities: DataFrame) -> DataFrame:
    """``(node)``: entities with a record from the watchlist."""
    return entities.where(F.exists("members", lambda m: m.startswith("watch:"))).select(F.col("id").alias("node"))


def entity_flags(entities: DataFrame, seeds: DataFrame, scores: DataFrame, attributed: DataFrame) -> DataFrame:
    """``(entity_id, flags)``: watchlisted, risk (rounded, from ``RISK_FLAG``), typologies."""
    kinds = attributed.where("hops = 0").groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("finding_id")), ",").alias("typologies"))
    joined = (
        entities.select(F.col("id").alias("entity_id"))
        .join(seeds.select(F.col("node").alias("entity_id"), F.lit("true").alias("watchlisted")), "entity_id", "left")
        .join(scores, "entity_id", "left")
        .join(kinds, "entity_id", "left")
    )
    high = F.when(F.col("risk") >= RISK_FLAG, F.round("risk", 3).cast("string"))
    table = F.create_map(F.lit("watchlisted"), F.col("watchlisted"), F.lit("risk"), high, F.lit("typologies"), F.col("typologies"))
    return joined.select("entity_id", F.map_filter(table, lambda k, v: v.isNotNull()).alias("flags"))


def run(spark: SparkSession, folder: str, ontology: Ontology | None = None) -> Run:
    """Ingest, resolve, build the graph, analyse; evaluate where the folder has truth."""
    ontology, timings, began = ontology or default_ontology(), {}, time.time()

    def lap(name: str) -> None:
        nonlocal began
        timings[name] = round(time.time() - began, 3)
        began = time.time()

    data = ingest(spark, folder, ontology)
    if not data.records:
        raise FileNotFoundError(f"no known source in {folder}")
    lap("ingest")
    resolution = resolve(data.records, ontology)
    lap("resolve")
    wired = materialize(rewire(data.links, resolution.assignment), "wired")
    seen = materialize(observations(wired, ontology), "observations")
    graph = KnowledgeGraph(ontology, resolution.entities, materialize(fold(seen), "edges"), count_rows(dangling_links(wired, ontology)), seen)
    release(wired)
    lap("graph")
    seeds = materialize(watchlisted(graph.entities), "seeds")
    found = risk.run_all(graph.entities, graph.edges, seen, ontology, seeds)
    flags = materialize(entity_flags(graph.entities, seeds, found["risk"], found["attributed"]), "flags")
    lap("analytics")
    labelled, known = None, read_truth(spark, folder)
    if known is not None:
        kinds = graph.entities.select(F.col("id").alias("entity_id"), "entity_type")
        labelled = materialize(resolution.assignment.join(known, "key").join(kinds, "entity_id").select("key", "entity_type", "entity_id", "truth_id"), "labelled")
    lap("evaluate")
    return Run(graph, resolution, resolution.assignment, seeds, found["findings"], found["attributed"], found["risk"], found["communities"], found["modularity"], found["cases"], flags, labelled, data.report, timings)
