"""Compiling parsed queries to DataFrame plans over a query view.

``query_view`` joins entities with risk, degree, community and flags; Catalyst prunes what a
query does not touch. Predicates never are NULL: a missing field satisfies ``!=`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.operators.graph import KnowledgeGraph, degrees, label, search
from evigraph.operators.traversal import all_paths, ego
from evigraph.plans.language import Comparison, FindQuery, Junction, Negation, PathQuery, QueryError, ShowQuery, parse

COMPUTED = ("risk", "degree", "type", "id", "label", "sources", "records", "community")


def query_view(graph: KnowledgeGraph, risk: DataFrame | None = None, communities: DataFrame | None = None, flags: DataFrame | None = None) -> DataFrame:
    """Entities with every computed field. ``flags``: entity_id and a map column flags."""
    view = graph.entities.join(degrees(graph.edges).withColumnRenamed("node", "id"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    view = view.join(risk.withColumnRenamed("entity_id", "id"), "id", "left") if risk is not None else view.withColumn("risk", F.lit(0.0))
    view = view.join(communities.withColumnRenamed("node", "id"), "id", "left") if communities is not None else view.withColumn("community", F.lit(None).cast("string"))
    view = view.join(flags.withColumnRenamed("entity_id", "id"), "id", "left") if flags is not None else view.withColumn("flags", F.lit(None).cast("map<string,string>"))
    return view.withColumns({"risk": F.coalesce("risk", F.lit(0.0)), "label": label(), "records": F.size("members").cast("long")})


def field_values(name: str) -> Column:
    """A field as an array of strings, NULL if it is missing."""
    if name == "sources":
        return F.col("sources")
    if name == "type":
        return F.array("entity_type")
    if name in COMPUTED:
        value = F.col(name).cast("string")
    elif name.startswith("flags."):
        value = F.try_element_at("flags", F.lit(name.split(".", 1)[1]))
    else:
        return F.try_element_at("props", F.lit(name))
    return F.when(value.isNotNull(), F.array(value))


def sort_key(name: str) -> list[Column]:
    """A number to sort by, then the text; texts that are not numbers share one number."""
    text = F.array_join(field_values(name), " ")
    number = text.try_cast("double")
    return [F.when(text.isNotNull(), F.coalesce(number, F.lit(0.0))), F.when(number.isNull(), text)]


def compare(values: Column, op: str, wanted: str | float) -> Column:
    """True if any value satisfies the comparison; a missing field satisfies ``!=`` only."""
    text = f"{wanted:.15g}" if isinstance(wanted, float) else wanted
    number = F.lit(text).try_cast("double")
    if op == "~":
        test = lambda v: F.contains(F.lower(v), F.lit(text.lower()))
    elif op in ("=", "!="):
        # numbers are compared as numbers, so that degree = 2 holds for a degree of 2
        same = lambda v: F.coalesce(v.try_cast("double") == number, F.lit(False)) | (F.lower(v) == F.lit(text.lower()))
        test = same if op == "=" else lambda v: ~same(v)
    else:
        order = {"<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}[op]
        test = lambda v: F.coalesce(order(v.try_cast("double"), number), order(v, F.lit(text)))
    return F.coalesce(F.exists(values, test), F.lit(op == "!="))


def predicate(node: object) -> Column:
    if isinstance(node, Comparison):
        return compare(field_values(node.field), node.op, node.value)
    if isinstance(node, Negation):
        return ~predicate(node.term)
    assert isinstance(node, Junction)
    out = predicate(node.terms[0])
    for t in node.terms[1:]:
        out = out & predicate(t) if node.op == "and" else out | predicate(t)
    return out


class Engine:
    """Runs queries over one graph; every answer is a DataFrame."""

    def __init__(self, graph: KnowledgeGraph, risk: DataFrame | None = None, communities: DataFrame | None = None, flags: DataFrame | None = None) -> None:
        self.graph, self.view = graph, query_view(graph, risk, communities, flags)

    def resolve(self, ref: str) -> str:
        """An entity id: the reference itself, in any case, or the first entity that mentions it."""
        entities = self.graph.entities
        named = entities.where(F.lower("id") == ref.lower()).orderBy(F.col("id") != ref, "id").select("id").first()
        hit = named or search(entities, ref, 1).select("id").first()
        if hit is None:
            raise QueryError(f"nothing is called {ref!r}")
        return hit.id

    def query(self, text: str) -> DataFrame:
        return self.run(parse(text))

    def run(self, q: FindQuery | PathQuery | ShowQuery) -> DataFrame:
        if isinstance(q, ShowQuery):
            return self.view.where(F.col("id") == self.resolve(q.ref))
        if isinstance(q, PathQuery):
            return all_paths(self.graph.edges, self.resolve(q.start), self.resolve(q.end), q.within, q.limit)
        out = self.view
        if q.entity_type is not None:
            if q.entity_type not in self.graph.ontology.entities:
                raise QueryError(f"no entity type {q.entity_type}")
            out = out.where(F.col("entity_type") == q.entity_type)
        if q.linked is not None:
            for name in q.via or ():
                if name not in self.graph.ontology.links:
                    raise QueryError(f"no link type {name}")
            start = self.resolve(q.linked)
            near = ego(self.graph.edges, start, q.within, q.via).where(F.col("node") != start)
            out = out.join(near.select(F.col("node").alias("id")), "id", "left_semi")
        if q.where is not None:
            out = out.where(predicate(q.where))
        keys = []
        if q.order is not None:
            keys = [k.desc_nulls_last() if q.descending else k.asc_nulls_first() for k in sort_key(q.order)]
        out = out.orderBy(*keys, "entity_type", "ord")
        return out if q.limit is None else out.limit(q.limit)
