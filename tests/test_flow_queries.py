import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evigraph import queries as Q

from tests.test_graph import weighted_modularity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def flow():
    """Observations of every edge between different users, counted from the events."""
    events = pd.read_parquet(f"{FOLDER}/events.parquet").sort_values(["event_type", "ts", "event_id"])
    after = events.groupby("event_type").user_id.shift(-1)
    return Counter((f"U-{a}", f"U-{int(b)}") for a, b in zip(events.user_id, after, strict=True) if b == b and a != b)


@pytest.fixture(scope="module")
def users():
    return sorted({f"U-{u}" for u in pd.read_parquet(f"{FOLDER}/events.parquet").user_id})


def test_communities_use_every_edge(spark, flow, users):
    import math

    weight = Counter()
    for (a, b), n in flow.items():
        weight[min(a, b), max(a, b)] += Q.TRADE.links["transacted"].weight * (1 + math.log1p(n))
    pairs = [(a, b, w) for (a, b), w in weight.items()]
    got = {r.node: r.community for r in Q.queries()["communities"](spark, FOLDER).collect()}
    assert set(got) == set(users) and all(min(u for u in users if got[u] == c) == c for c in got.values())
    # single nodes moved one by one, from any start, do no better
    near, strength, total = {u: {} for u in users}, Counter(), sum(weight.values())
    for a, b, w in pairs:
        near[a][b] = near[b][a] = w
        strength[a] += w
        strength[b] += w
    best, rng = 0.0, random.Random(1)
    for _ in range(5):
        home, order = {u: u for u in users}, list(users)
        held = Counter(strength)
        for _ in range(20):
            rng.shuffle(order)
            for x in order:
                pull = Counter()
                for y, w in near[x].items():
                    pull[home[y]] += w
                held[home[x]] -= strength[x]
                home[x] = max([home[x], *pull], key=lambda c: pull[c] - held[c] * strength[x] / (2 * total))
                held[home[x]] += strength[x]
        best = max(best, weighted_modularity(pairs, home))
    assert weighted_modularity(pairs, got) >= 0.9 * best


def test_betweenness_is_exact_up_to_the_operators_bound(spark, flow, users):
    near = {u: [] for u in users}
    for a, b in flow:  # edges in both directions are two ways
        near[a].append(b)
        near[b].append(a)
    want = dict.fromkeys(users, 0.0)
    for source in users:
        paths, depth, order = Counter({source: 1.0}), {source: 0}, [source]
        for x in order:
            for y in near[x]:
                if y not in depth:
                    depth[y] = depth[x] + 1
                    order.append(y)
                if depth[y] == depth[x] + 1:
                    paths[y] += paths[x]
        delta = Counter()
        for y in reversed(order):
            for x in near[y]:
                if depth[x] == depth[y] - 1:
                    delta[x] += paths[x] / paths[y] * (1 + delta[y])
            if y != source:
                want[y] += delta[y]
    n = len(users)
    got = {r.node: r.betweenness for r in Q.queries()["betweenness"](spark, FOLDER).collect()}
    assert got == pytest.approx({u: b / ((n - 1) * (n - 2)) for u, b in want.items()}, abs=1e-6)


@pytest.mark.parametrize("name", [q for q in Q.queries() if q.startswith(("find_where_", "find_linked_"))])
def test_find_queries_without_sql_limit_have_none(spark, name):
    plan = Q.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in plan


def test_vetoed_clusters_match_the_strict_order(spark):
    """``cluster_docs_veto`` over a whole table: pairs scored by SQL, merged one by one, strongest first."""
    import duckdb

    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    source = Q._DOC_ID.properties["source"]
    docs = dict(duck.execute("SELECT doc_id, source FROM documents").fetchall())
    pairs = []
    for left, right, st, sl, wt, wl, first in duck.execute(f"WITH {Q._DOCS_SQL} SELECT p.l, p.r, st, sl, wt, wl, first_pos FROM pairs p JOIN cand USING (l, r)").fetchall():
        score = float(wt) + float(wl)
        if docs[left] and docs[right]:
            score += source.agree if docs[left] == docs[right] else source.disagree
        if score >= 9.0:
            pairs.append((-score, first, left, right))
    home, held = {d: d for d in docs}, {d: {v} if v else set() for d, v in docs.items()}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for _, _, left, right in sorted(pairs):
        a, b = sorted((find(left), find(right)))
        if a != b and not (held[a] and held[b] and held[a].isdisjoint(held[b])):
            home[b] = a
            held[a] |= held[b]
    got = {r.pos: r.cluster for r in Q.queries()["cluster_docs_veto"](spark, folder).collect()}
    assert got == {d: find(d) for d in docs} and len(set(got.values())) < len(docs)


def test_cases_match_a_slow_grouping(spark):
    """``correlate_cases`` over a whole table: findings joined by shared entities until nothing more joins."""
    from evigraph.operators import risk, typologies

    folder = "/root/testdata/sf0.01"
    entities, edges, findings, _ = Q._attributed(spark, folder)
    more = findings.unionByName(typologies.rapid_incorporation(entities, edges, dates=Q._first_shipments(spark, folder)))
    whole = risk.with_attribution(more, risk.attribute(entities, edges, more)).orderBy(F.desc("severity"), "finding_id").collect()
    left, want = list(whole), []
    while left:
        group, union = [left.pop(0)], set()
        size = 0
        while size != len(group):
            size = len(group)
            union = {e for f in group for e in f.entities}
            group += [f for f in left if len(union & set(f.entities)) >= 2]
            left = [f for f in left if f not in group]
        if len(group) > 1:
            kinds = sorted({f.kind for f in group})
            want.append((",".join(kinds), sorted(f.finding_id for f in group), len(union), round(min(1.0, 0.6 + 0.2 * len(kinds)) * sum(f.severity for f in group) / len(group), 3)))
    got = [(r.kinds, sorted(r.findings.split(",")), r.entities, r.score) for r in Q.queries()["correlate_cases"](spark, folder).collect()]
    assert sorted(got) == sorted(want) and got
