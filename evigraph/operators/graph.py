"""The typed knowledge graph: edges from links, adjacency, degrees, lookups, storage.

``edges``: id, link_type, src, dst, count, total_amount. What stands behind them is a table of
its own, ``observations``: edge_id, link_type, src, dst, ord, link_key, amount, date, attrs; an
edge's row stays small however often it is seen. ``entities``: id, entity_type, ord, props,
members, sources, confidence.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.ontology import Ontology
from evigraph.runtime import exists

PROVENANCE = 25
LABELS = ("full_name", "legal_name", "account_number", "address", "label")


def rewire(links: DataFrame, assignment: DataFrame) -> DataFrame:
    """Links with both record keys replaced by entity ids, NULL where a key is unknown."""
    ids = assignment.select("key", "entity_id")
    return (
        links.join(ids.withColumnsRenamed({"key": "source_key", "entity_id": "src"}), "source_key", "left")
        .join(ids.withColumnsRenamed({"key": "target_key", "entity_id": "dst"}), "target_key", "left")
    )


def dangling_links(rewired: DataFrame, ontology: Ontology) -> DataFrame:
    """Links of a known type with an end that no record has."""
    return rewired.where(F.col("link_type").isin(list(ontology.links)) & (F.col("src").isNull() | F.col("dst").isNull()))


def observations(rewired: DataFrame, ontology: Ontology) -> DataFrame:
    """Every link between two known entities, with the id and ends of its edge.

    Symmetric types are stored with the smaller end first; unknown types, dangling links and
    links within one entity are left out.
    """
    symmetric = [k.name for k in ontology.links.values() if k.symmetric] or [""]
    known = rewired.where(F.col("link_type").isin(list(ontology.links)) & F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    flip = F.col("link_type").isin(symmetric) & (F.col("src") > F.col("dst"))
    ends = known.withColumns({"a": F.when(flip, F.col("dst")).otherwise(F.col("src")), "b": F.when(flip, F.col("src")).otherwise(F.col("dst"))})
    return ends.select(F.concat_ws("|", "link_type", "a", "b").alias("edge_id"), "link_type", F.col("a").alias("src"), F.col("b").alias("dst"), "ord", "link_key", "amount", "date", "attrs")


def fold(seen: DataFrame) -> DataFrame:
    """One edge per (link type, source, target) of the observations."""
    edges = seen.groupBy("link_type", "src", "dst").agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_amount"))
    return edges.select(F.concat_ws("|", "link_type", "src", "dst").alias("id"), "link_type", "src", "dst", "count", "total_amount")


def build_edges(rewired: DataFrame, ontology: Ontology) -> DataFrame:
    return fold(observations(rewired, ontology))


def provenance(seen: DataFrame, most: int = PROVENANCE) -> DataFrame:
    """``(edge_id, provenance)``: the keys of each edge's first links, ``most`` at most."""
    first = Window.partitionBy("edge_id").orderBy("ord", "link_key")
    few = seen.select("edge_id", "ord", "link_key").withColumn("k", F.row_number().over(first)).where(F.col("k") <= most)
    return few.groupBy("edge_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "link_key"))), lambda x: x["link_key"]).alias("provenance"))


def edge_dates(seen: DataFrame) -> DataFrame:
    """``(id, dates)``: the sorted dates of each edge's observations."""
    return seen.groupBy(F.col("edge_id").alias("id")).agg(F.array_sort(F.collect_list("date")).alias("dates"))


def adjacency(edges: DataFrame, link_types: Iterable[str] | None = None, direction: str = "both") -> DataFrame:
    """``(node, other, edge_id, link_type, outgoing, count)``: each edge from both of its ends."""
    if link_types is not None:
        edges = edges.where(F.col("link_type").isin(list(link_types)))
    base = ["edge_id", "link_type", "count"]
    flat = edges.select("src", "dst", F.col("id").alias("edge_id"), "link_type", "count")
    out = flat.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(True).alias("outgoing"), *base)
    into = flat.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(False).alias("outgoing"), *base)
    return out if direction == "out" else into if direction == "in" else out.unionByName(into)


def neighbours(edges: DataFrame, node: str, link_types: Iterable[str] | None = None, direction: str = "both") -> DataFrame:
    return adjacency(edges, link_types, direction).where(F.col("node") == node)


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree)``: parallel edges of different types count separately."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def graph_stats(entities: DataFrame, edges: DataFrame, dangling: int | None = None) -> DataFrame:
    """``(section, name, n)``: entities and edges by type, observations in all, and dangling links if they are known."""
    counted = (
        entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("entity").alias("section"), F.col("entity_type").alias("name"), "n")
        .unionByName(edges.groupBy("link_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("section"), F.col("link_type").alias("name"), "n"))
        .unionByName(edges.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).select(F.lit("total").alias("section"), F.lit("observations").alias("name"), "n"))
    )
    if dangling is None:
        return counted
    return counted.unionByName(entities.sparkSession.createDataFrame([("total", "dangling_links", dangling)], "section string, name string, n long"))


def label() -> Column:
    """What to call an entity: its name, number or address, else its id."""
    parts = []
    for p in LABELS:
        value = F.try_element_at(F.try_element_at("props", F.lit(p)), F.lit(1))
        parts.append(F.initcap(value) if p.endswith("_name") else value)
    return F.coalesce(*parts, F.col("id"))


def of_type(entities: DataFrame, entity_type: str) -> DataFrame:
    return entities.where(F.col("entity_type") == entity_type)


def find(entities: DataFrame, entity_type: str | None = None, **values: object) -> DataFrame:
    """Entities whose properties hold the given values."""
    out = entities if entity_type is None else of_type(entities, entity_type)
    for prop, value in values.items():
        out = out.where(F.coalesce(F.array_contains(F.try_element_at("props", F.lit(prop)), str(value)), F.lit(False)))
    return out


def search(entities: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Entities with a property value that contains the text, in entity order."""
    values = F.concat_ws(" ", F.flatten(F.map_values("props")))
    return entities.where(F.contains(F.lower(values), F.lit(text.lower()))).orderBy("entity_type", "ord").limit(limit)


def subgraph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes`` (column node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


@dataclass
class KnowledgeGraph:
    """Entities, edges, the observations behind them and the schema they follow."""

    ontology: Ontology
    entities: DataFrame
    edges: DataFrame
    dangling: int = 0
    observations: DataFrame | None = None

    def save(self, path: str) -> None:
        """Entities, edges and observations as Parquet, the schema's name and the dangling links, and a JSON export."""
        spark = self.entities.sparkSession
        self.entities.write.mode("overwrite").parquet(f"{path}/entities")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")
        exported = self.edges
        if self.observations is not None:
            self.observations.write.mode("overwrite").parquet(f"{path}/observations")
            exported = exported.join(provenance(self.observations).withColumnRenamed("edge_id", "id"), "id", "left")
        spark.createDataFrame([(self.ontology.name, self.dangling)], "ontology string, dangling_links long").write.mode("overwrite").json(f"{path}/graph")
        rounded = self.entities.withColumn("confidence", F.round("confidence", 4)).withColumn("label", label())
        rounded.write.mode("overwrite").json(f"{path}/json/entities")
        exported.write.mode("overwrite").json(f"{path}/json/edges")

    @classmethod
    def load(cls, spark: SparkSession, path: str, ontology: Ontology) -> KnowledgeGraph:
        """What ``save`` wrote; the schema must be the one it was saved with."""
        head = spark.read.schema("ontology string, dangling_links long").json(f"{path}/graph").first()
        if head.ontology != ontology.name:
            raise ValueError(f"the graph follows {head.ontology}, not {ontology.name}")
        seen = spark.read.parquet(f"{path}/observations") if exists(spark, f"{path}/observations") else None
        return cls(ontology, spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/edges"), head.dangling_links, seen)
