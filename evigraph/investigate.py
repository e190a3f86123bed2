"""The analyst's view: one entity's dossier, connections, cases, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators.graph import label
from evigraph.operators.traversal import all_paths, nearest, shortest_path
from evigraph.plans.compiler import Engine
from evigraph.plans.language import QueryError

#: Neighbours of each link type that a dossier names, and the risk that it marks.
SHOWN, RISKY = 6, 0.5


def provenance(entities: DataFrame) -> DataFrame:
    """``(source, records)``: how many source records stand behind the given entities."""
    return entities.select(F.explode("members").alias("m")).groupBy(F.split_part("m", F.lit(":"), F.lit(1)).alias("source")).agg(F.count(F.lit(1)).alias("records"))


def bar(share: float, width: int = 20) -> str:
    full = round(max(0.0, min(1.0, share)) * width)
    return "#" * full + "." * (width - full)


class Investigation:
    """Reports over one analysed graph; every report collects a few rows only."""

    def __init__(self, run) -> None:
        self.run, self.graph = run, run.graph
        self.engine = Engine(run.graph, run.risk, run.communities, run.flags)

    def resolve_ref(self, ref: str) -> str:
        """An entity by id, by the key of one of its records, or by name."""
        hit = self.run.assignment.where(F.col("key") == ref).select("entity_id").first()
        return hit.entity_id if hit else self.engine.resolve(ref)

    def _names(self, ids: list[str]) -> dict[str, str]:
        some = self.graph.entities.where(F.col("id").isin(sorted(set(ids))))
        return {r.id: r.label for r in some.select("id", label().alias("label")).collect()}

    def describe_path(self, path: list[str], edge_ids: list[str]) -> str:
        """A path line by line: each step's link type, direction, observations and amount."""
        names = self._names(path)
        edges = {e.id: e for e in self.graph.edges.where(F.col("id").isin(edge_ids)).collect()}
        lines = [names.get(path[0], path[0])]
        for here, there, key in zip(path[:-1], path[1:], edge_ids, strict=True):
            e = edges[key]
            link = self.graph.ontology.link(e.link_type)
            mark = ("--", "--") if link.symmetric else ("--", "->") if e.src == here else ("<-", "--")
            money = f", {e.total_amount:,.0f}" if e.total_amount else ""
            lines.append(f"  {mark[0]} {link.label} x{e['count']}{money} {mark[1]} {names.get(there, there)}")
        return "\n".join(lines)

    def _relations(self, ident: str) -> list[str]:
        """Counts per link type, the riskiest six of each, and how many more there are."""
        near = self.graph.edges.where((F.col("src") == ident) | (F.col("dst") == ident))
        near = near.select("link_type", "count", "total_amount", F.when(F.col("src") == ident, F.col("dst")).otherwise(F.col("src")).alias("id"))
        ranked = near.join(self.engine.view.select("id", "label", "risk"), "id").withColumns({
            "place": F.row_number().over(Window.partitionBy("link_type").orderBy(F.desc("risk"), "id")), "all": F.count(F.lit(1)).over(Window.partitionBy("link_type")),
        })
        lines: list[str] = []
        for r in ranked.where(F.col("place") <= SHOWN).orderBy("link_type", "place").collect():
            if r.place == 1:
                lines.append(f"  {r.link_type} ({r['all']})")
            seen = f" x{r['count']}" if r["count"] > 1 else ""
            lines.append(f"    {'!' if r.risk >= RISKY else ' '} {r.label} [{r.id}]{seen}{f', {r.total_amount:,.0f}' if r.total_amount else ''}, risk {r.risk:.3f}")
            if r.place == min(SHOWN, r["all"]) and r["all"] > SHOWN:
                lines.append(f"      and {r['all'] - SHOWN} more")
        return lines

    def dossier(self, ref: str) -> str:
        """One entity: properties, records by source, relations, all its findings, the nearest listed entity."""
        ident = self.resolve_ref(ref)
        e = self.engine.view.where(F.col("id") == ident).first()
        flags = e.flags or {}
        lines = [f"{e.label}  [{e.id}, {e.entity_type}]", f"risk {e.risk:.3f} {bar(e.risk)}  confidence {e.confidence:.2f}  degree {e.degree}"]
        lines += [f"! {k}: {v}" for k, v in sorted(flags.items())]
        lines += ["", "properties", *[f"  {k}: {', '.join(v)}" for k, v in sorted(e.props.items())]]
        lines += ["", f"records by source ({e.records})"]
        for r in provenance(self.graph.entities.where(F.col("id") == ident)).orderBy(F.desc("records"), "source").collect():
            some = [m for m in e.members if m.startswith(f"{r.source}:")][:3]
            lines.append(f"  {r.source}: {r.records}, such as {', '.join(some)}")
        lines += ["", "relations", *(self._relations(ident) or ["  none"])]
        hits = self.run.findings.where(F.array_contains("entities", ident)).orderBy(F.desc("severity"), "finding_id").collect()
        lines += ["", "findings"]
        for h in hits:
            lines.append(f"  {h.kind} {h.severity:.2f}: {h.title}")
            lines.append("    " + "; ".join(f"{k} {v}" for k, v in sorted(h.evidence.items()) if v))
        if not hits:
            lines.append("  none")
        if not flags.get("watchlisted") and (found := nearest(self.graph.edges, ident, self.run.seeds)):
            steps = shortest_path(self.graph.edges, ident, found[0], found[1]).orderBy("step").collect()
            lines += ["", f"nearest watchlisted: {found[0]}, {found[1]} hops", self.describe_path([s.node for s in steps], [s.edge_id for s in steps[1:]])]
        return "\n".join(lines)

    def connect(self, left: str, right: str, hops: int = 4, limit: int = 5) -> str:
        a, b = self.resolve_ref(left), self.resolve_ref(right)
        rows = all_paths(self.graph.edges, a, b, hops, limit).collect()
        if not rows:
            return f"no connection between {a} and {b} within {hops} hops"
        return "\n\n".join(f"{r.hops} hops\n{self.describe_path(r.path, r.edge_ids)}" for r in rows)

    def case_report(self, limit: int = 3) -> str:
        lines = []
        for c in self.run.cases.orderBy("case_id").limit(limit).collect():
            lines += [f"case {c.case_id}, score {c.score:.3f}: {', '.join(c.kinds)}", f"  {len(c.findings)} findings, {len(c.entities)} entities", f"  people: {', '.join(c.people[:8]) or 'none'}", f"  organizations: {', '.join(c.organizations[:8]) or 'none'}"]
        return "\n".join(lines) or "no cases"

    def top_risk(self, entity_type: str = "person", limit: int = 15) -> DataFrame:
        if entity_type not in self.graph.ontology.entities:
            raise QueryError(f"no entity type {entity_type}")
        return self.engine.view.where(F.col("entity_type") == entity_type).select("id", "label", "risk", "records").orderBy(F.desc("risk"), "id").limit(limit)
