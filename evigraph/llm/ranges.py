"""Rows dealt by ranges of their id, for ids of any type."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _key(rows: DataFrame, column: str) -> Column:
    """A double that never falls where the column rises.

    Texts give the 48 bits after the beginning that all of them share.
    """
    kind = rows.schema[column].dataType
    if isinstance(kind, T.NumericType):
        return F.col(column).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    text = F.col(column).cast("string")
    ends = rows.agg(F.min(text).alias("a"), F.max(text).alias("b")).first()
    a, b = ((x or "").encode("utf-8", "surrogatepass") for x in (ends.a, ends.b))
    shared = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    following = F.rpad(F.substring(F.hex(text), 2 * shared + 1, 12), 12, "0")
    return F.conv(following, 16, 10).cast("double")


def ranged(rows: DataFrame, column: str, parts: int) -> DataFrame:
    """``rows`` with ``range``: -1 for null ids, else a number that never falls where the id rises.

    Cuts are approximate quantiles (one number for each reaches the driver). An id that several
    quantiles name has a range of its own.
    """
    keyed = rows.withColumn("__k", _key(rows, column))
    cuts = keyed.agg(F.percentile_approx("__k", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    cuts = [float(c) for c in cuts or []]
    own = {c for a, c in zip(cuts, cuts[1:], strict=False) if a == c}
    splits = sorted({*cuts, *(math.nextafter(c, math.inf) for c in own)})
    splits = [float("-inf"), *(splits or [0.0]), float("inf")]
    made = Bucketizer(splits=splits, inputCol="__k", outputCol="__b", handleInvalid="keep").transform(keyed.withColumn("__k", F.coalesce("__k", F.lit(float("nan")))))
    # NaN, for null ids, gets the bucket after all others: make it the least
    return made.withColumn("range", F.when(F.col(column).isNull(), -1).otherwise(F.col("__b").cast("int"))).drop("__k", "__b")
