"""Packing: optimal length buckets and token-budget batches.

Documents are cut into pieces of at most ``MAX_LEN`` tokens (nothing is dropped), so the
global histogram of piece lengths has at most ``MAX_LEN + 1`` entries, whatever the corpus.
Dynamic programming over it chooses at most ``BUCKETS`` boundaries such that padding every
piece to the boundary above it costs the fewest tokens in total. Within a bucket pieces are
numbered by (doc_id, piece), and every ``TOKEN_BUDGET // boundary`` of them form a batch.

The numbering is global and exact without a single task per bucket: ids are cut into ranges
by approximate quantiles, pieces are numbered within (bucket, range), and each group starts
at the count of the pieces before it.

A token is a run of non-blank characters unless ``length`` gives a column of token counts,
such as one made by ``vocabulary_lengths``. Empty and null texts have one piece of no tokens.
Null ids come first. Rows that repeat an id keep their own pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.ranges import ranged
from evigraph.runtime import bound_batches, materialize, shuffle_width

MAX_LEN = 2048
BUCKETS = 8
TOKEN_BUDGET = 65_536


def optimal_boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of the length buckets with the least padding; ties go to the shorter cut."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.concatenate([[0], np.cumsum([histogram[int(x)] for x in lengths])]).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum([histogram[int(x)] * int(x) for x in lengths])]).astype(np.int64)
    n, k = len(lengths), min(buckets, len(lengths))
    best = lengths * counts[1:] - sums[1:]  # one bucket up to each length
    cuts = []
    for level in range(1, k):
        now, cut = np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
        for j in range(level, n):
            i = np.arange(level - 1, j)
            cost = best[i] + lengths[j] * (counts[j + 1] - counts[i + 1]) - (sums[j + 1] - sums[i + 1])
            at = int(cost.argmin())
            now[j], cut[j] = cost[at], i[at]
        best = now
        cuts.append(cut)
    out, j = [], n - 1
    for cut in reversed(cuts):
        out.append(int(lengths[j]))
        j = int(cut[j])
    return [*reversed([*out, int(lengths[j])])]


def vocabulary_lengths(docs: DataFrame, tokenizer_file: str, text: str = "text") -> DataFrame:
    """``docs`` with column ``n_tokens`` counted by a ``tokenizers`` JSON file on every executor."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def count(parts: Iterator) -> Iterator:
        import pandas as pd
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer_file)
        model.encode_special_tokens = True
        for part in parts:
            encoded = model.encode_batch(part.fillna("").tolist(), add_special_tokens=False)
            yield pd.Series([len(e.ids) for e in encoded], dtype="int64")

    return docs.withColumn("n_tokens", count(F.col(text).cast("string")))


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^ \t\r\n\f\x0B]+")), F.lit(0)).cast("long")


def pack(
    docs: DataFrame,
    length: Column | None = None,
    doc_id: str = "doc_id",
    max_len: int = MAX_LEN,
    buckets: int = BUCKETS,
    token_budget: int = TOKEN_BUDGET,
) -> DataFrame:
    """``(doc_id, piece, start_token, n_tokens, bucket, batch, slot)`` for every piece.

    ``bucket`` is the boundary the piece is padded to, ``batch`` the batch's number within
    its bucket, ``slot`` the piece's place in the batch. Empty and null texts have one piece of
    no tokens, null ids come first, ids may be of any type that has an order, and rows that
    repeat an id keep their own pieces. Other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    sized = materialize(docs.select(F.col(doc_id).alias("doc_id"), (word_count() if length is None else length).cast("long").alias("n")), "lengths", compact=True)
    pieces = sized.select(
        "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / max_len).cast("long") - 1, F.lit(0).cast("long")))).alias("piece")
    ).select("doc_id", "piece", (F.col("piece") * max_len).alias("start_token"), F.least(F.lit(max_len), F.col("n") - F.col("piece") * max_len).cast("long").alias("n_tokens"))
    histogram = {r.n_tokens: r.count_ for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("count_")).collect()}  # max_len + 1 rows at most
    bounds = optimal_boundaries(histogram, buckets) or [max_len]
    bucket = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(bucket)

    keyed = ranged(pieces.withColumn("bucket", bucket.cast("long")), "doc_id", 4 * shuffle_width(spark)).withColumnRenamed("range", "part")
    counts = keyed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("m")).collect()  # buckets x ranges rows at most
    starts, at = [], {}
    for b, p, m in sorted((r.bucket, r.part, r.m) for r in counts):
        starts.append((b, p, at.get(b, 0)))
        at[b] = at.get(b, 0) + m
    begin = spark.createDataFrame(starts, "bucket long, part int, begin long")
    order = Window.partitionBy("bucket", "part").orderBy("doc_id", "piece", "n_tokens")
    place = F.col("begin") + F.row_number().over(order) - 1
    fit = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket"), F.lit(1)))).cast("long")
    return (
        keyed.join(F.broadcast(begin), ["bucket", "part"])
        .withColumns({"place": place.cast("long"), "fit": fit})
        .select("doc_id", "piece", "start_token", "n_tokens", "bucket", F.floor(F.col("place") / F.col("fit")).cast("long").alias("batch"), (F.col("place") % F.col("fit")).cast("long").alias("slot"))
    )


def oracle_sql(max_len: int = MAX_LEN, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, source: str = "documents") -> str:
    """The same in DuckDB SQL, for corpora with at least ``buckets`` distinct piece lengths."""
    levels = ["d1 AS (SELECT j, len * c - s AS cost, 0 AS cut FROM h)"]
    for k in range(2, buckets + 1):
        levels.append(
            f"d{k} AS (SELECT j, CAST(v // 8192 AS BIGINT) AS cost, CAST(v % 8192 AS BIGINT) AS cut FROM (SELECT b.j AS j, min((d.cost + b.len * (b.c - a.c) - (b.s - a.s))::HUGEINT * 8192 + a.j) AS v "
            f"FROM h b JOIN h a ON a.j < b.j JOIN d{k - 1} d ON d.j = a.j GROUP BY b.j))"
        )
    back = [f"p{buckets} AS (SELECT max(j) AS j FROM h)"]
    for k in range(buckets, 1, -1):
        back.append(f"p{k - 1} AS (SELECT cut AS j FROM d{k} JOIN p{k} USING (j))")
    bounds = " UNION ".join(f"SELECT j FROM p{k}" for k in range(1, buckets + 1))
    return f"""
WITH sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n\\f\\x0B]+')), 0) AS n FROM {source}
), pieces AS (
  SELECT doc_id, piece, piece * {max_len} AS start_token, CAST(least({max_len}, n - piece * {max_len}) AS BIGINT) AS n_tokens
  FROM (SELECT doc_id, n, unnest(range(CAST(greatest(1, ceil(n / {max_len})) AS BIGINT))) AS piece FROM sized)
), g AS (
  SELECT n_tokens AS len, count(*) AS m FROM pieces GROUP BY 1
), h AS (
  SELECT row_number() OVER (ORDER BY len) AS j, len, CAST(sum(m) OVER (ORDER BY len) AS BIGINT) AS c, CAST(sum(m * len) OVER (ORDER BY len) AS BIGINT) AS s FROM g
), {", ".join(levels)}, {", ".join(back)}, bounds AS (
  SELECT len AS bucket FROM h WHERE j IN ({bounds})
), placed AS (
  SELECT p.*, (SELECT min(bucket) FROM bounds b WHERE b.bucket >= p.n_tokens) AS bucket FROM pieces p
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, piece, n_tokens) - 1 AS place,
         CAST(greatest(1, {token_budget} // greatest(bucket, 1)) AS BIGINT) AS fit FROM placed
)
SELECT doc_id, piece, start_token, n_tokens, bucket, CAST(place // fit AS BIGINT) AS batch, CAST(place % fit AS BIGINT) AS slot FROM ordered
"""
