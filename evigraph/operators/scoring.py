"""Fellegi-Sunter scoring of candidate pairs, with evidence."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.functions.similarity import NATIVE_KINDS, compare, hashed_jaccard, is_full_for_equals, token_hashes
from evigraph.ontology import EntityType, PropertyDef
from evigraph.runtime import materialize, release

EXACT = {"exact", "email", "phone", "id"}


def evidence_weight(prop: PropertyDef, similarity: Column) -> Column:
    """Signed weight: agreement at the threshold, disagreement at the floor, linear between."""
    span = prop.threshold - prop.partial_floor
    share = (similarity - prop.partial_floor) / span if span else F.lit(0.0)
    return (
        F.when(similarity >= prop.threshold, F.lit(prop.agree))
        .when(similarity <= prop.partial_floor, F.lit(prop.disagree))
        .otherwise(F.lit(prop.disagree) + share * (prop.agree - prop.disagree))
    )


def _prepared(records: DataFrame, entity: EntityType, names: list[str]) -> DataFrame:
    """``pos`` and each property in the form that is compared: texts of the address kind as word hashes."""
    columns = []
    for n in names:
        value, listed = F.col(n), isinstance(records.schema[n].dataType, T.ArrayType)
        filled = F.size(value) > 0 if listed else value.cast("string") != ""
        if entity.properties[n].compare_kind == "address" and "address" in NATIVE_KINDS:
            value = F.transform(value, token_hashes) if listed else token_hashes(value)
        columns.append(F.when(filled, value).alias(n))
    return records.select("pos", *columns)


def _best_of_arrays(a: Column, b: Column, one: Callable[[Column, Column], Column]) -> Column:
    """The similarity of the best pair of elements, by SQL functions alone."""
    return F.array_max(F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: one(x, y)))))


def _best_of_lists(both: DataFrame, kind: str, n: str) -> DataFrame:
    """``(l, r, s_<n>)``: the similarity of the best pair of elements, each distinct pair of values compared once.

    Lists that share a value are settled by it where the comparator says 1 for equal values.
    """
    whole = both.select("l", "r", F.col(f"l_{n}").alias("xs"), F.col(f"r_{n}").alias("ys")).where("xs IS NOT NULL AND ys IS NOT NULL")
    alike = lambda c: F.filter(c, lambda x: x.isNotNull() & (x.cast("string") != ""))
    equal = F.coalesce(F.arrays_overlap(alike(F.col("xs")), alike(F.col("ys"))), F.lit(False)) if is_full_for_equals(kind) else F.lit(False)
    found = whole.where(equal).select("l", "r", F.lit(1.0).alias("s"))
    open_ = whole.where(~equal).select("l", "r", F.explode(F.array_distinct("xs")).alias("a"), "ys").select("l", "r", "a", F.explode(F.array_distinct("ys")).alias("b"))
    values = materialize(open_.select("a", "b").distinct(), "value-pairs", compact=True)
    scored = materialize(values.select("a", "b", compare(kind, F.col("a"), F.col("b")).alias("s")), "value-similarities", compact=True)
    same = F.col("x.a").eqNullSafe(F.col("y.a")) & F.col("x.b").eqNullSafe(F.col("y.b"))
    best = open_.alias("x").join(scored.alias("y"), same).select("l", "r", "s").groupBy("l", "r").agg(F.max("s").alias("s"))
    release(values)
    return found.unionByName(best).withColumnRenamed("s", f"s_{n}")


def similarities(records: DataFrame, pairs: DataFrame, entity: EntityType) -> DataFrame:
    """``pairs`` with ``s_<property>`` for each property of the records, written once.

    Values meet by position, texts as hashes of their words. NULL where a side has no value.
    """
    names = [p for p in entity.properties if p in records.columns]
    ready = materialize(_prepared(records, entity, names), "score-values")
    side = lambda tag: ready.select(F.col("pos").alias(tag), *[F.col(n).alias(f"{tag}_{n}") for n in names])
    both = pairs.join(side("l"), "l").join(side("r"), "r")
    here, lists = [], []
    for n in names:
        kind, a, b = entity.properties[n].compare_kind, F.col(f"l_{n}"), F.col(f"r_{n}")
        if not isinstance(records.schema[n].dataType, T.ArrayType):
            same = hashed_jaccard(a, b) if kind == "address" and kind in NATIVE_KINDS else compare(kind, a, b)
        elif kind in EXACT & NATIVE_KINDS:
            same = F.arrays_overlap(a, b).cast("double")
        elif kind in NATIVE_KINDS:
            same = _best_of_arrays(a, b, hashed_jaccard if kind == "address" else partial(compare, kind))
        else:  # functions that may run in Python cannot be called on elements of arrays
            lists.append((n, kind))
            continue
        here.append(F.when(a.isNotNull() & b.isNotNull(), same).alias(f"s_{n}"))
    found = both.select(*pairs.columns, *here)
    for n, kind in lists:
        found = found.join(_best_of_lists(both, kind, n), ["l", "r"], "left")
    found = materialize(found, "similarities")
    release(ready)
    return found


def score_pairs(records: DataFrame, pairs: DataFrame, entity: EntityType) -> DataFrame:
    """``pairs`` with ``score``, ``verdict`` and ``evidence`` (array of prop, sim, weight).

    A property missing on either side says nothing. ``pairs`` names each l and r once.
    """
    found = similarities(records, pairs, entity)
    names = [p for p in entity.properties if f"s_{p}" in found.columns]
    weights = {f"w_{n}": F.when(F.col(f"s_{n}").isNotNull(), evidence_weight(entity.properties[n], F.col(f"s_{n}"))) for n in names}
    items = [F.struct(F.lit(n).alias("prop"), F.col(f"s_{n}").alias("sim"), F.col(f"w_{n}").alias("weight")) for n in names]
    total = sum((F.coalesce(F.col(f"w_{n}"), F.lit(0.0)) for n in names), F.lit(0.0))
    verdict = F.when(F.col("score") >= entity.match, "match").when(F.col("score") >= entity.review, "review").otherwise("no-match")
    evidence = F.filter(F.array(*items), lambda e: e["sim"].isNotNull())
    return found.withColumns(weights).withColumns({"score": total, "evidence": evidence}).withColumn("verdict", verdict).select(*pairs.columns, "score", "verdict", "evidence")


def explain(evidence: list, score: float, verdict: str) -> str:
    """Readable evidence of one decision, strongest first."""
    lines = [f"{verdict} at {score:+.2f}"]
    for e in sorted(evidence, key=lambda e: -abs(e["weight"])):
        lines.append(f"  {'supports' if e['weight'] > 0 else 'opposes '} {e['prop']}: similarity {e['sim']:.3f}, weight {e['weight']:+.2f}")
    return "\n".join(lines)
