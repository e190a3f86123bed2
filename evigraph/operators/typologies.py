"""Financial-crime patterns as graph queries.

Each returns findings ``(finding_id, kind, severity, entities, title, evidence)``; evidence is
a map of strings, severity lies in [0, 1].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.normalize import norm_date
from evigraph.operators.components import connected_components
from evigraph.runtime import count_rows, materialize, release

COLUMNS = ("finding_id", "kind", "severity", "entities", "title", "evidence")


def _finding(kind: str, key: Column, severity: Column, entities: Column, title: Column, **evidence: Column) -> list[Column]:
    facts = F.map_from_arrays(F.array(*[F.lit(k) for k in evidence]), F.array(*[F.coalesce(v.cast("string"), F.lit("")) for v in evidence.values()]))
    return [
        F.concat(F.lit(f"{kind}:"), key).alias("finding_id"), F.lit(kind).alias("kind"), F.least(F.lit(1.0), severity).alias("severity"),
        entities.alias("entities"), title.alias("title"), facts.alias("evidence"),
    ]


def _top(found: DataFrame, limit: int | None) -> DataFrame:
    found = found.orderBy(F.desc("severity"), "finding_id")
    return found if limit is None else found.limit(limit)


def _trimmed(flow: DataFrame, rounds: int = 5) -> DataFrame:
    """Edges without those that begin or end where a cycle cannot pass, some rounds of it."""
    size = count_rows(flow)
    for _ in range(rounds):
        some = flow.join(flow.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(flow.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        some = materialize(some.select("src", "dst", "total_amount"), "flow", compact=True)
        release(flow)
        flow, left = some, count_rows(some)
        if left == size:
            break
        size = left
    return flow


def _first_of_each(walks: DataFrame) -> DataFrame:
    """Of walks between the same two nodes over the same nodes the first."""
    best = walks.groupBy("start", "node", F.array_sort("path").alias("nodes")).agg(F.min(F.struct("path", "total")).alias("m"))
    return best.select("start", "node", "m.path", "m.total")


def cycles(edges: DataFrame, link_type: str = "transacted", min_observations: int = 3, max_length: int = 8) -> DataFrame:
    """``(path, total_amount)``: directed simple cycles of 3 to ``max_length`` nodes on repeated edges.

    A cycle starts at its smallest node. Half of it is walked forward and half backward from
    there, through larger nodes only, and the halves meet where they end; of halves, as of
    cycles, over the same nodes the first path is kept, so dense graphs cost sets of nodes
    instead of paths.
    """
    flow = edges.where((F.col("link_type") == link_type) & (F.col("count") >= min_observations)).select("src", "dst", "total_amount")
    flow = _trimmed(materialize(flow, "flow", compact=True))
    step = flow.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("total_amount").alias("t"))
    ahead = {1: flow.where("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src", "dst").alias("path"), F.col("total_amount").alias("total"))}
    back = {1: flow.where("src > dst").select(F.col("dst").alias("start"), F.col("src").alias("node"), F.array("src").alias("path"), F.col("total_amount").alias("total"))}
    unseen = lambda c: (F.col(c) > F.col("start")) & ~F.array_contains("path", F.col(c))
    for size in range(2, (max_length + 1) // 2 + 1):
        more = ahead[size - 1].join(step, F.col("node") == F.col("a")).where(unseen("b"))
        more = more.select("start", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"), (F.col("total") + F.col("t")).alias("total"))
        ahead[size] = materialize(_first_of_each(more), f"ahead-{size}", compact=True)
        if size <= max_length // 2:
            more = back[size - 1].join(step, F.col("node") == F.col("b")).where(unseen("a"))
            more = more.select("start", F.col("a").alias("node"), F.concat(F.array("a"), "path").alias("path"), (F.col("total") + F.col("t")).alias("total"))
            back[size] = materialize(_first_of_each(more), f"back-{size}", compact=True)
    found = None
    for size in range(3, max_length + 1):
        first, rest = ahead[(size + 1) // 2], back[size // 2].withColumnsRenamed({"path": "rest", "total": "more"})
        closed = first.join(rest, ["start", "node"]).withColumn("rest", F.slice("rest", 2, max_length)).where(~F.arrays_overlap("path", "rest"))
        closed = closed.select(F.concat("path", "rest").alias("path"), (F.col("total") + F.col("more")).alias("total_amount"))
        found = closed if found is None else found.unionByName(closed)
    return found.groupBy(F.array_sort("path").alias("nodes")).agg(F.min(F.struct("path", "total_amount")).alias("m")).select("m.path", "m.total_amount")


def circular_flows(edges: DataFrame, link_type: str = "transacted", min_observations: int = 3, max_length: int = 8, limit: int | None = 20) -> DataFrame:
    """Value that leaves an account and comes back along edges that are used again and again."""
    n = F.size("path")
    found = cycles(edges, link_type, min_observations, max_length)
    return _top(
        found.select(
            *_finding(
                "circular_flow", F.concat_ws(">", "path"), 0.55 + 0.08 * n, F.col("path"), F.format_string("Value returns to its origin through %d accounts", n),
                length=n, total_amount=F.round("total_amount", 2), cycle=F.concat_ws(",", "path"),
            )
        ),
        limit,
    )


def near_threshold(observations: DataFrame, threshold: float = 10_000.0, band: float = 0.15, min_count: int = 4, min_share: float = 0.35, link_type: str = "transacted") -> DataFrame:
    """Per account: payments just under the threshold, their share, range and counterparties."""
    paid = observations.where((F.col("link_type") == link_type) & F.col("amount").isNotNull()).select("src", "dst", "amount")
    hit = (F.col("amount") >= threshold * (1 - band)) & (F.col("amount") < threshold)
    amount = F.when(hit, F.col("amount"))
    per = paid.groupBy("src").agg(
        F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("outgoing"), F.count_if(F.col("amount") >= threshold).alias("above"),
        F.min(amount).alias("least"), F.max(amount).alias("most"), F.avg(amount).alias("mean"), F.array_sort(F.collect_set(F.when(hit, F.col("dst")))).alias("counterparties"),
    )
    return per.withColumn("share", F.col("hits") / F.col("outgoing")).where((F.col("hits") >= min_count) & (F.col("share") >= min_share))


def structuring(observations: DataFrame, threshold: float = 10_000.0, band: float = 0.15, min_count: int = 4, limit: int | None = 20, min_share: float = 0.35, link_type: str = "transacted") -> DataFrame:
    """Payments sized to stay under a reporting threshold that dominate an account's payments."""
    found = near_threshold(observations, threshold, band, min_count, min_share, link_type)
    return _top(
        found.select(
            *_finding(
                "structuring", F.col("src"), 0.4 + 0.6 * F.col("share"), F.concat(F.array("src"), "counterparties"), F.format_string("%d payments just below the threshold", F.col("hits")),
                count=F.col("hits"), outgoing=F.col("outgoing"), above=F.col("above"), min=F.round("least", 2), max=F.round("most", 2), mean=F.round("mean", 2),
            )
        ),
        limit,
    )


def shared_registration(entities: DataFrame, edges: DataFrame, min_orgs: int = 3, limit: int | None = 20) -> DataFrame:
    """Addresses with many registered companies, worse when these share officers."""
    places = entities.where("entity_type = 'location'").select(F.col("id").alias("dst"))
    orgs = entities.where("entity_type = 'organization'").select(F.col("id").alias("src"))
    at = edges.where("link_type = 'registered_at'").join(places, "dst", "left_semi").join(orgs, "src", "left_semi").select(F.col("src").alias("org"), F.col("dst").alias("place")).distinct()
    groups = at.groupBy("place").agg(F.array_sort(F.collect_set("org")).alias("orgs")).where(F.size("orgs") >= min_orgs)
    officers = edges.where("link_type = 'officer_of'").select(F.col("src").alias("officer"), F.col("dst").alias("org"))
    shared = (
        at.join(officers, "org").groupBy("place", "officer").agg(F.count_distinct("org").alias("n")).where("n > 1")
        .groupBy("place").agg(F.array_sort(F.collect_set("officer")).alias("officers"))
    )
    found = groups.join(shared, "place", "left").withColumn("officers", F.coalesce("officers", F.array().cast("array<string>")))
    n, k = F.size("orgs"), F.size("officers")
    return _top(
        found.select(
            *_finding(
                "shared_registration", F.col("place"), 0.3 + 0.1 * n + 0.12 * k, F.concat(F.array("place"), "orgs"), F.format_string("%d companies registered at one address", n),
                companies=F.concat_ws(",", "orgs"), shared_officers=F.concat_ws(",", "officers"),
            )
        ),
        limit,
    )


def close_pairs(edges: DataFrame, dates: DataFrame, window_days: int = 90) -> DataFrame:
    """``(a, b, officer)``: companies with a common officer, founded within the window.

    ``dates`` has org and incorporated. Officers join companies bucketed by window, so an
    officer of many companies is not paired with all of them.
    """
    held = edges.where("link_type = 'officer_of'").select(F.col("src").alias("officer"), F.col("dst").alias("org")).distinct()
    dated = held.join(dates.where("incorporated IS NOT NULL"), "org").withColumn("bucket", F.floor(F.unix_date("incorporated") / max(1, window_days)))
    left = dated.select("officer", F.col("org").alias("a"), F.col("incorporated").alias("da"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    right = dated.select("officer", F.col("org").alias("b"), F.col("incorporated").alias("db"), "bucket")
    return left.join(right, ["officer", "bucket"]).where((F.col("a") < F.col("b")) & (F.abs(F.datediff("da", "db")) <= window_days)).select("a", "b", "officer").distinct()


def incorporation_dates(entities: DataFrame) -> DataFrame:
    value = F.try_element_at(F.try_element_at("props", F.lit("incorporated")), F.lit(1))
    return entities.where("entity_type = 'organization'").select(F.col("id").alias("org"), norm_date(value).alias("incorporated"))


def rapid_incorporation(entities: DataFrame, edges: DataFrame, window_days: int = 90, min_orgs: int = 3, limit: int | None = 10, dates: DataFrame | None = None) -> DataFrame:
    """Companies chained by shared officers and close founding dates; the real span is reported."""
    dates = incorporation_dates(entities) if dates is None else dates
    pairs = materialize(close_pairs(edges, dates, window_days), "close")
    parts = materialize(connected_components(pairs.select("a", "b").distinct(), "a", "b").withColumnsRenamed({"node": "org"}), "close-parts")
    orgs = parts.join(dates, "org").groupBy("component").agg(F.array_sort(F.collect_set("org")).alias("orgs"), F.datediff(F.max("incorporated"), F.min("incorporated")).alias("span"))
    officers = pairs.join(parts.withColumnRenamed("org", "a"), "a").groupBy("component").agg(F.array_sort(F.collect_set("officer")).alias("officers"))
    found = orgs.join(officers, "component").where(F.size("orgs") >= min_orgs)
    n, k = F.size("orgs"), F.size("officers")
    return _top(
        found.select(
            *_finding(
                "rapid_incorporation", F.col("component"), 0.45 + 0.1 * n + 0.1 * k, F.concat("orgs", "officers"), F.format_string("%d companies with shared officers founded within %d days", n, F.col("span")),
                companies=F.concat_ws(",", "orgs"), officers=F.concat_ws(",", "officers"), span_days=F.col("span"),
            )
        ),
        limit,
    )
