import dataclasses
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.ontology import default_ontology
from evigraph.operators import analytics, graph, risk, traversal, typologies
from evigraph.plans.compiler import Engine
from evigraph.plans.english import CallableProvider, NaturalLanguage
from evigraph.plans.language import Comparison, Junction, Negation, QueryError, parse

ONTOLOGY = default_ontology()
NAMES = {"PER-0": "alice ashford", "PER-1": "bob brennan", "PER-2": "cara calloway", "PER-3": "dan duarte", "ORG-0": "kestrel trading"}
LINKS = [("communicated", "PER-0", "PER-1"), ("communicated", "PER-2", "PER-1"), ("communicated", "PER-2", "PER-3"), ("officer_of", "PER-0", "ORG-0"), ("officer_of", "PER-3", "ORG-0")]


def links_frame(spark, rows):
    full = [(t, a, b, k, f"x:{k}", float(m) if m is not None else None, "2024-01-01", {}) for k, (t, a, b, *rest) in enumerate(rows) for m in [rest[0] if rest else None]]
    return spark.createDataFrame(full, "link_type string, source_key string, target_key string, ord long, link_key string, amount double, date string, attrs map<string,string>")


def edges_of(spark, rows):
    ids = sorted({x for r in rows for x in r[1:3]})
    keys = spark.createDataFrame([(i, i) for i in ids], "key string, entity_id string")
    return graph.build_edges(graph.rewire(links_frame(spark, rows), keys), ONTOLOGY)


def observed(spark, rows):
    ids = sorted({x for r in rows for x in r[1:3]})
    keys = spark.createDataFrame([(i, i) for i in ids], "key string, entity_id string")
    return graph.observations(graph.rewire(links_frame(spark, rows), keys), ONTOLOGY)


def entities_of(spark, ids):
    kind = {"PER": "person", "ORG": "organization", "ACC": "account", "LOC": "location"}
    rows = [(i, kind[i[:3]], k, {("full_name" if i[:3] == "PER" else "legal_name"): [NAMES.get(i, i)]}, [f"t:{i}"], ["t"], 0.7) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "id string, entity_type string, ord long, props map<string,array<string>>, members array<string>, sources array<string>, confidence double")


@pytest.fixture(scope="module")
def toy(spark):
    return graph.KnowledgeGraph(ONTOLOGY, entities_of(spark, NAMES).cache(), edges_of(spark, LINKS).cache())


def test_build(spark, toy):
    rows = [*LINKS, ("communicated", "PER-1", "PER-0", 5), ("communicated", "PER-0", "PER-0"), ("unheard_of", "PER-0", "PER-1")]
    got = {(r.link_type, r.src, r.dst): (r["count"], r.total_amount) for r in edges_of(spark, rows).collect()}
    assert got["communicated", "PER-0", "PER-1"] == (2, 5.0) and len(got) == 5
    seen = observed(spark, rows + [("communicated", "PER-0", "PER-1")] * 40)
    keys = {r.edge_id: r.provenance for r in graph.provenance(seen).collect()}
    assert keys["communicated|PER-0|PER-1"] == ["x:0", "x:5", *[f"x:{k}" for k in range(8, 31)]] and len(keys) == 5
    assert {r.id: len(r.dates) for r in graph.edge_dates(seen).collect()}["communicated|PER-0|PER-1"] == 42
    keys = spark.createDataFrame([("PER-0", "PER-0")], "key string, entity_id string")
    assert graph.dangling_links(graph.rewire(links_frame(spark, rows), keys), ONTOLOGY).count() == 6
    assert {r.node: r.degree for r in graph.degrees(toy.edges).collect()} == {"PER-0": 2, "PER-1": 2, "PER-2": 2, "PER-3": 2, "ORG-0": 2}


def test_save_and_load(spark, toy, tmp_path):
    whole = graph.KnowledgeGraph(ONTOLOGY, toy.entities, toy.edges, 3, observed(spark, LINKS))
    whole.save(f"file://{tmp_path}/g")
    again = graph.KnowledgeGraph.load(spark, f"file://{tmp_path}/g", ONTOLOGY)
    assert again.dangling == 3 and again.observations.count() == len(LINKS)
    with pytest.raises(ValueError, match="follows"):
        graph.KnowledgeGraph.load(spark, f"file://{tmp_path}/g", dataclasses.replace(ONTOLOGY, name="other"))
    assert again.entities.count() == 5 and sorted(r.id for r in again.edges.collect()) == sorted(r.id for r in toy.edges.collect())


def test_traversal(toy):
    assert [r.node for r in traversal.shortest_path(toy.edges, "PER-0", "PER-3").collect()] == ["PER-0", "ORG-0", "PER-3"]
    assert traversal.shortest_path(toy.edges, "PER-0", "PER-3", link_types=["communicated"]).count() == 4
    assert traversal.shortest_path(toy.edges, "PER-0", "PER-0").count() == 0 and traversal.shortest_path(toy.edges, "PER-0", "nobody").count() == 0
    assert {r.node for r in traversal.ego(toy.edges, "PER-1", 1).collect()} == {"PER-0", "PER-1", "PER-2"}
    paths = [(r.hops, r.path) for r in traversal.all_paths(toy.edges, "PER-0", "PER-3").collect()]
    assert paths == [(2, ["PER-0", "ORG-0", "PER-3"]), (3, ["PER-0", "PER-1", "PER-2", "PER-3"])]


def slow_betweenness(nodes, pairs):
    near = {n: [] for n in nodes}
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)

    def paths(s, t):
        level, best = [[s]], []
        while level and not best:
            best = [p for p in level if p[-1] == t]
            level = [[*p, n] for p in level for n in near[p[-1]] if n not in p]
        return best

    out = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        found = paths(s, t)
        for n in nodes:
            if n not in (s, t) and found:
                out[n] += sum(n in p for p in found) / len(found)
    return {n: v / ((len(nodes) - 1) * (len(nodes) - 2)) for n, v in out.items()}


def test_centrality(spark, toy):
    ids = [f"PER-{i}" for i in range(7)]
    pairs = [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 5), (2, 5)]
    edges = edges_of(spark, [("communicated", ids[a], ids[b]) for a, b in pairs])
    got = {r.node: r.betweenness for r in analytics.betweenness(entities_of(spark, ids), edges).collect()}
    assert got == pytest.approx(slow_betweenness(ids, [(ids[a], ids[b]) for a, b in pairs]))
    ranks = {r.node: r.rank for r in analytics.pagerank(entities_of(spark, ids), edges, ONTOLOGY, spark.createDataFrame([("PER-0",)], "node string"), iterations=15).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and max(ranks, key=ranks.get) == "PER-0" and ranks["PER-6"] == 0


def brandes(n, pairs):
    near, out = {i: [] for i in range(n)}, [0.0] * n
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    for s in range(n):
        depth, paths, order, delta = {s: 0}, {s: 1.0}, [s], {}
        for x in order:
            for y in near[x]:
                if y not in depth:
                    depth[y], paths[y] = depth[x] + 1, 0.0
                    order.append(y)
                if depth[y] == depth[x] + 1:
                    paths[y] += paths[x]
        for y in reversed(order[1:]):
            out[y] += delta.get(y, 0.0)
            for x in near[y]:
                if depth[x] == depth[y] - 1:
                    delta[x] = delta.get(x, 0.0) + paths[x] / paths[y] * (1 + delta.get(y, 0.0))
    return [v / ((n - 1) * (n - 2)) for v in out]


def test_betweenness_takes_every_source_at_any_size(spark):
    rng, n = random.Random(3), 640
    ids = [f"PER-{i}" for i in range(n)]
    pairs = sorted({(rng.randrange(600), rng.randrange(600)) for _ in range(900)} | {(600 + i, 601 + i) for i in range(30)} | {(1, 0)})
    pairs = [(a, b) for a, b in pairs if a != b]
    edges = edges_of(spark, [("communicated", ids[a], ids[b]) for a, b in pairs])
    got = {r.node: r.betweenness for r in analytics.betweenness(entities_of(spark, ids), edges).collect()}
    assert got == pytest.approx(dict(zip(ids, brandes(n, edges_in(edges, ids)), strict=True)))


def edges_in(edges, ids):
    at = {x: i for i, x in enumerate(ids)}
    return [(at[r.src], at[r.dst]) for r in edges.select("src", "dst").collect()]


@pytest.mark.parametrize("cells", [1, 50, 4000])
def test_betweenness_in_slices(cells):
    rng, n = random.Random(4), 90
    pairs = [(a, b) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(130)) if a != b] + [(80 + i, 81 + i) for i in range(6)]
    ways = Counter(x for a, b in pairs for x in ((a, b), (b, a)))
    rows = sorted(ways)
    start = np.concatenate([[0], np.cumsum(np.bincount([a for a, _ in rows], minlength=n))])
    found = analytics.dependencies(start, np.array([b for _, b in rows]), np.array([ways[r] for r in rows]), np.arange(n), cells)
    assert list(found / ((n - 1) * (n - 2))) == pytest.approx(brandes(n, pairs))


def test_betweenness_of_graphs_too_large_to_copy(spark, monkeypatch):
    monkeypatch.setattr(analytics, "JOINED_ROWS", 40)
    ids = [f"PER-{i}" for i in range(10)]
    pairs = [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 5), (2, 5), (7, 8)]
    edges = edges_of(spark, [("communicated", ids[a], ids[b]) for a, b in pairs])
    got = {r.node: r.betweenness for r in analytics.betweenness(entities_of(spark, ids), edges, copied=0).collect()}
    assert got == pytest.approx(dict(zip(ids, brandes(10, pairs), strict=True)))


def test_communities(spark):
    ids = [f"PER-{i}" for i in range(8)]
    pairs = [*itertools.combinations(range(4), 2), *itertools.combinations(range(4, 8), 2), (3, 4)]
    edges = edges_of(spark, [("communicated", ids[a], ids[b]) for a, b in pairs])
    labels = analytics.communities(entities_of(spark, [*ids, "PER-9"]), edges, ONTOLOGY).cache()
    got = {r.node: r.community for r in labels.collect()}
    assert len({got[i] for i in ids[:4]}) == 1 and len({got[i] for i in ids[4:]}) == 1 and got["PER-0"] != got["PER-7"] and got["PER-9"] == "PER-9"
    assert analytics.modularity(edges, labels).first().modularity == pytest.approx(2 * (6 / 13 - 0.25))


def weighted_modularity(pairs, home):
    """Of ``(a, b, w)`` rows and a community for every node."""
    total, inside, strength = sum(w for *_, w in pairs), {}, {}
    for a, b, w in pairs:
        for x in (a, b):
            strength[home[x]] = strength.get(home[x], 0) + w
        if home[a] == home[b]:
            inside[home[a]] = inside.get(home[a], 0) + w
    return sum(inside.get(c, 0) / total - (k / (2 * total)) ** 2 for c, k in strength.items())


def test_communities_find_planted_groups(spark):
    rng = random.Random(3)
    ids = [f"PER-{i:02d}" for i in range(48)]
    inside = [(a, b) for a, b in itertools.combinations(range(48), 2) if a // 8 == b // 8 and rng.random() < 0.8]
    pairs = inside + [(i, i + 1) for i in (7, 15, 31, 39)]
    edges, entities = edges_of(spark, [("communicated", ids[a], ids[b]) for a, b in pairs]).cache(), entities_of(spark, ids).cache()
    got = {r.node: r.community for r in analytics.communities(entities, edges, ONTOLOGY).collect()}
    planted = weighted_modularity([(ids[a], ids[b], 1.0) for a, b in pairs], {x: i // 8 for i, x in enumerate(ids)})
    assert weighted_modularity([(ids[a], ids[b], 1.0) for a, b in pairs], got) >= planted - 0.02


def test_patterns(spark):
    pay = lambda a, b, *amounts: [("transacted", f"ACC-{a}", f"ACC-{b}", m) for m in amounts]
    rows = pay(0, 1, 1, 2, 3) + pay(1, 2, 1, 2, 3) + pay(2, 0, 1, 2, 3) + pay(2, 3, 5, 5, 5) + pay(5, 6, 9000, 9500, 9900, 8600, 100) + pay(6, 7, 9000, 9500)
    edges = edges_of(spark, rows)
    ring = typologies.circular_flows(edges).collect()
    assert len(ring) == 1 and ring[0].entities == ["ACC-0", "ACC-1", "ACC-2"] and float(ring[0].evidence["total_amount"]) == 18 and ring[0].severity == pytest.approx(0.79)
    near = typologies.structuring(observed(spark, rows)).collect()
    assert [r.entities for r in near] == [["ACC-5", "ACC-6"]] and near[0].severity == pytest.approx(0.88) and near[0].evidence["above"] == "0"


def slow_cycles(arcs, most):
    """Of every set of nodes that a cycle can pass, the first path in order."""
    out = {}

    def walk(path):
        for b in sorted(arcs.get(path[-1], ())):
            if b == path[0] and len(path) >= 3:
                key = tuple(sorted(path))
                out[key] = min(out.get(key, tuple(path)), tuple(path))
            elif b > path[0] and b not in path and len(path) < most:
                walk([*path, b])

    for a in arcs:
        walk([a])
    return set(out.values())


@pytest.mark.parametrize("most", [3, 5, 8])
def test_cycles_match_enumeration(spark, most):
    rng = random.Random(most)
    nodes = [f"ACC-{i}" for i in range(9)]
    arcs = {a: {b for b in nodes if a != b and rng.random() < 0.35} for a in nodes}
    edges = edges_of(spark, [("transacted", a, b, 1) for a in arcs for b in arcs[a]])
    found = typologies.cycles(edges, min_observations=1, max_length=most).collect()
    assert {tuple(r.path) for r in found} == slow_cycles(arcs, most) and all(r.total_amount == len(r.path) for r in found)


def test_shells_risk_and_cases(spark):
    orgs, people = [f"ORG-{i}" for i in range(4)], [f"PER-{i}" for i in range(4)]
    rows = [("registered_at", o, "LOC-0") for o in orgs] + [("officer_of", people[i], orgs[(i + k) % 4]) for i in range(4) for k in (0, 1)] + [("owns_account", "PER-0", "ACC-0"), ("controls_account", "ORG-1", "ACC-1")]
    entities = entities_of(spark, [*orgs, *people, "LOC-0", "ACC-0", "ACC-1"]).cache()
    edges = edges_of(spark, rows).cache()
    dates = spark.createDataFrame([(o, f"2022-06-{1 + 9 * i:02d}") for i, o in enumerate(orgs[:3])] + [(orgs[3], "2010-01-01")], "org string, incorporated string").withColumn("incorporated", F.to_date("incorporated"))
    shared, rapid = typologies.shared_registration(entities, edges), typologies.rapid_incorporation(entities, edges, dates=dates)
    assert shared.first().severity == 1.0 and shared.first().entities == ["LOC-0", *orgs]
    assert rapid.first().evidence["companies"] == "ORG-0,ORG-1,ORG-2" and rapid.first().evidence["span_days"] == "18"
    who = {(r.node, r.principal): r.hops for r in risk.principals(entities, edges).collect()}
    assert who["ACC-0", "PER-0"] == 1 and who["ACC-1", "ORG-1"] == 1 and who["ACC-1", "PER-1"] == 2
    findings = shared.unionByName(rapid)
    attributed = risk.attribute(entities, edges, findings).cache()
    scores = {r.entity_id: r.risk for r in risk.risk_scores(entities, entities.select(F.col("id").alias("node"), F.lit(0.0).alias("rank")), findings, attributed).collect()}
    assert scores["ORG-0"] > scores["PER-3"] > scores["ACC-0"] == 0
    cases = risk.correlate_frame(risk.with_attribution(findings, attributed), spark.createDataFrame([(k, v) for k, v in scores.items()], "entity_id string, risk double"), entities).collect()
    assert len(cases) == 1 and cases[0].kinds == ["rapid_incorporation", "shared_registration"] and set(cases[0].people) == set(people)


def test_parser():
    q = parse("FIND person where not risk > .5".replace(".5", "0.5") + " and (a = 1 or b ~ 'x y') linked to \"Bob\" via officer_of, communicated within 2 order by risk asc limit 7")
    assert q.where == Junction("and", (Negation(Comparison("risk", ">", 0.5)), Junction("or", (Comparison("a", "=", 1.0), Comparison("b", "~", "x y")))))
    assert (q.linked, q.via, q.within, q.order, q.descending, q.limit) == ("Bob", ("officer_of", "communicated"), 2, "risk", False, 7)
    assert parse("find").limit == 25 and parse("path a to b").within == 4
    for bad in ("", "fetch x", "find person where", "find person limit 2.5", "find person limit -1", "show", "show a b", "path a b", "find person where a = (", "find % x"):
        with pytest.raises(QueryError):
            parse(bad)


def test_queries(toy):
    engine = Engine(toy)
    ids = lambda text: [r.id for r in engine.query(text).collect()]
    assert ids("find person where full_name ~ 'CALLO'") == ["PER-2"] and ids("find where degree = 2 limit 9") == ["ORG-0", "PER-0", "PER-1", "PER-2", "PER-3"]
    assert ids("find person where missing != x limit 2") == ["PER-0", "PER-1"] and ids("find person where missing = x") == []
    assert ids("find person linked to 'kestrel' via officer_of") == ["PER-0", "PER-3"] and ids("find person linked to PER-0 within 2 order by label desc") == ["PER-3", "PER-2", "PER-1"]
    assert ids("show alice") == ["PER-0"] and engine.query("path alice to dan within 2").count() == 1
    for bad in ("find boat", "show nobody", "find linked to PER-0 via flies_with"):
        with pytest.raises(QueryError):
            engine.query(bad)


def test_english():
    nl = NaturalLanguage(ONTOLOGY)
    for question, want in {
        "How is Alice connected to Kestrel?": 'path "alice" to "kestrel" within 4', "What is the connection between A B and C?": 'path "a b" to "c" within 4', "show the riskiest companies": "find organization order by risk desc limit 15",
        "top 5 risky people": "find person order by risk desc limit 5", "who is connected to Bob?": 'find linked to "bob" within 1 order by risk desc', "who is on the watchlist": 'find person where flags.watchlisted = "true" order by risk desc limit 25',
        "Who is Cara Calloway?": 'show "cara calloway"', "companies registered in cy": 'find organization where country = "cy" limit 25', "tell me about dan": 'show "dan"',
    }.items():
        assert nl.translate(question).query == want
    with pytest.raises(QueryError):
        nl.translate("zzz")
    assert NaturalLanguage(ONTOLOGY, CallableProvider(lambda s, q: "find person limit 3")).translate("x").provider == "model"
    assert NaturalLanguage(ONTOLOGY, CallableProvider(lambda s, q: '{"query": "show bob", "reasoning": "why"}')).translate("x").reasoning == "why"
    with pytest.raises(QueryError):  # an error in the model's query is not hidden
        NaturalLanguage(ONTOLOGY, CallableProvider(lambda s, q: "nonsense")).translate("show bob")
    for broken in (lambda s, q: None, lambda s, q: {"refusal": "no"}, lambda s, q: {}[s], lambda s, q: "{"):
        assert NaturalLanguage(ONTOLOGY, CallableProvider(broken)).translate("show bob").provider == "rules"
