"""Line dedup: bounded suffix sorting of line-id sequences by prefix doubling.

Every document is its sequence of line ids, a line's id being the rank of its 128-bit hash
among the lines that occur at more than one position. Prefix doubling then ranks runs of
2, 4, 8, ... lines: a run's rank is that of the pair of ranks of its halves in sorted
order, so ranks order the suffixes by their first 2^k lines, and positions of equal rank
form the longest-common-prefix intervals of that depth. Runs that occur once drop out at
the level where that shows.

A line is deleted when it lies in a run of consecutive lines of ``MIN_WORDS`` or more words
that also occurs at an earlier position (documents by id, then lines). A maximal repeated
run of that size is the union of its shortest stretches of ``MIN_WORDS`` words, taken
forward from each line and backward from its end, so suffixes need ranks to that depth
only: a stretch of n lines is named by n and the ranks of its first and last 2^k lines
(2^k <= n < 2^(k+1)). Deleted copies are later ones, hence the first copy of every line
stays.

All of it is DataFrame operations. Classes are aggregated to their first and last position
before anything is joined; no group of equal lines is ever gathered.

Defined cases: a null text stays null; an empty text is one empty line; rows equal in id and
text are one document (each gets its result); rows with one id and different texts are
different documents; null ids come last. Extra columns are returned only if named in
``carry``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.runtime import materialize, release, spread_join

MIN_WORDS = 50
_LAST = (1 << 63) - 1


def _keyed(docs: DataFrame, text: str, doc_id: str) -> tuple:
    """Key columns of a document: its id (nulls last) and a hash of its text."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST))
    return key, F.xxhash64(F.col(text).cast("string"), F.col(doc_id).isNull())


def _lines(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    d, t = _keyed(docs, text, doc_id)
    parts = docs.where(F.col(text).isNotNull()).select(
        d.alias("d"), t.alias("t"), F.posexplode(F.split(F.col(text).cast("string"), "\n")).alias("i", "line")
    )
    return parts.select(
        "d",
        "t",
        "i",
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(7), "line").alias("h2"),
        F.regexp_count("line", F.lit(r"[^ \t\r\f\x0B]+")).alias("w"),
    )


def _classes(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``keys`` values at more than one position, with rank ``r`` in sorted order, first position ``f`` and number of positions."""
    at = F.struct("d", "t", "i")
    found = rows.groupBy(*keys).agg(F.min(at).alias("f"), F.max(at).alias("l"), F.count(F.lit(1)).alias("times")).where("f < l").select(*keys, "f", "times")
    # after a global sort the id grows with the key: a rank with gaps, made without a single task
    return materialize(found.orderBy(*keys).withColumn("r", F.monotonically_increasing_id()), label)


def _stretches(level: DataFrame, min_words: int) -> DataFrame:
    """Shortest stretches ``(d, t, s, e)`` of ``min_words`` words, forward and backward."""
    doc = Window.partitionBy("d", "t").orderBy("i")
    runs = level.select("d", "t", "i", "w", (F.col("i") - F.row_number().over(doc)).alias("g"))
    run = Window.partitionBy("d", "t", "g")
    runs = runs.withColumn("total", F.sum("w").over(run)).where(F.col("total") >= min_words)
    runs = runs.withColumn("c", F.sum("w").over(run.orderBy("i"))).withColumn("p", F.col("c") - F.col("w"))
    runs = runs.withColumns({"first": F.min("i").over(run), "last": F.max("i").over(run)})
    runs = runs.withColumn("x", F.min("i").over(run.orderBy("p").rangeBetween(min_words, Window.unboundedFollowing)))
    runs = runs.withColumn("y", F.max("i").over(run.orderBy("c").rangeBetween(Window.unboundedPreceding, -min_words)))
    forward = F.when(F.col("total") - F.col("p") >= min_words, F.coalesce(F.col("x") - 1, F.col("last")))
    backward = F.when(F.col("c") >= min_words, F.coalesce(F.col("y") + 1, F.col("first")))
    both = runs.select(
        "d", "t", F.explode(F.array(F.struct(F.col("i").alias("s"), forward.alias("e")), F.struct(backward.alias("s"), F.col("i").alias("e")))).alias("x")
    )
    both = both.select("d", "t", F.col("x.s").alias("s"), F.col("x.e").alias("e")).where("s IS NOT NULL AND e IS NOT NULL")
    return both.distinct().withColumn("n", F.col("e") - F.col("s") + 1)


def repeated_ranges(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``(d, t, s, e)``: stretches of lines that occur earlier as well."""
    lines = materialize(_lines(docs, text, doc_id), "lines")
    classes = _classes(lines, ["h1", "h2"], "line-ids")
    level = materialize(spread_join(lines, classes, ["h1", "h2"], "times").select("d", "t", "i", "w", "r", "f"), "rank-1")
    release(lines)
    release(classes)
    stretches = materialize(_stretches(level, min_words), "stretches")
    longest = stretches.agg(F.max("n")).first()[0] or 0

    here = F.struct(F.col("d"), F.col("t"), F.col("s").alias("i"))
    found, k = [], 0
    while (1 << k) <= longest:
        size = 1 << k
        if k:
            ahead = Window.partitionBy("d", "t").orderBy("i").rangeBetween(size // 2, size // 2)
            pairs = level.select("d", "t", "i", F.col("r").alias("a"), F.first("r").over(ahead).alias("b")).where("b IS NOT NULL")
            pairs = materialize(pairs, f"pairs-{size}")
            release(level)
            classes = _classes(pairs, ["a", "b"], "rank-classes")
            level = materialize(spread_join(pairs, classes, ["a", "b"], "times").select("d", "t", "i", "r", "f"), f"rank-{size}")
            release(classes)
            release(pairs)
        # the stretch is one run of this size: its class has the first position already
        whole = stretches.where(F.col("n") == size).join(level.withColumnRenamed("i", "s"), ["d", "t", "s"])
        found.append(whole.where(here > F.col("f")).select("d", "t", "s", "e"))
        if size > 1:  # lengths in between: two overlapping runs of this size
            between = stretches.where((F.col("n") > size) & (F.col("n") < 2 * size)).withColumn("z", F.col("e") - size + 1)
            named = materialize(
                between.join(level.select("d", "t", F.col("i").alias("s"), F.col("r").alias("a")), ["d", "t", "s"]).join(
                    level.select("d", "t", F.col("i").alias("z"), F.col("r").alias("b")), ["d", "t", "z"]
                ),
                "named",
            )
            firsts = named.groupBy("n", "a", "b").agg(F.min(here).alias("f"), F.max(here).alias("l")).where("f < l")
            found.append(named.join(firsts, ["n", "a", "b"]).where(here > F.col("f")).select("d", "t", "s", "e"))
            found[-2:] = [materialize(found[-2].unionByName(found[-1]), "ranges")]
            release(named)
        else:
            found[-1] = materialize(found[-1], "ranges")
        k += 1
    release(level)
    release(stretches)
    out = stretches.select("d", "t", "s", "e").limit(0) if not found else found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _merged(ranges: DataFrame) -> DataFrame:
    """Per document the sorted, disjoint ranges to delete."""
    upto = Window.partitionBy("d", "t").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("d", "t").orderBy("s", "e")
    cut = ranges.withColumn("new", F.when(F.col("s") <= F.max("e").over(upto) + 1, 0).otherwise(1))
    islands = cut.withColumn("island", F.sum("new").over(order)).groupBy("d", "t", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return islands.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("gone"))  # no more than a document's lines


def dedup_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, carry: Sequence[str] = ()
) -> DataFrame:
    """``(doc_id, text, n_lines, n_deleted, *carry)``, one row per input row, later copies deleted."""
    gone = _merged(repeated_ranges(docs, text, doc_id, min_words))
    d, t = _keyed(docs, text, doc_id)
    joined = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), d.alias("d"), t.alias("t"), F.struct(F.lit(0), *carry).alias("carry")
    ).join(gone, ["d", "t"], "left")
    lines = F.split("text", "\n")
    # the pieces between deleted ranges, each a slice: linear in the document's lines
    kept = F.transform(
        "gone",
        lambda x, j: F.struct(
            F.when(j == 0, F.lit(0)).otherwise(F.element_at("gone", F.greatest(j, F.lit(1)))["e"] + 1).alias("a"),
            x["s"].alias("b"),
        ),
    )
    kept = F.concat(kept, F.array(F.struct((F.element_at("gone", -1)["e"] + 1).alias("a"), F.size("lines").alias("b"))))
    pieces = F.flatten(F.transform(F.filter(kept, lambda x: x["b"] > x["a"]), lambda x: F.slice("lines", x["a"] + 1, x["b"] - x["a"])))
    deleted = F.aggregate("gone", F.lit(0), lambda acc, x: acc + x["e"] - x["s"] + 1)
    return joined.withColumn("lines", lines).select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(pieces, "\n")).alias("text"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(deleted, F.lit(0)).cast("long").alias("n_deleted"),
        *[F.col("carry")[c].alias(c) for c in carry],
    )


ORACLE = """
WITH l AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '[^ \\t\\r\\f\\x0B]+')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
), c AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM l
), win AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= 50 GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= 50 GROUP BY 1, 3
), runs AS (
  SELECT win.doc_id, s, e, list_slice(string_split(text, chr(10)), s + 1, e + 1) AS content FROM win JOIN documents USING (doc_id)
), later AS (
  SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS k FROM runs) WHERE k > 1
), gone AS (
  SELECT DISTINCT l.doc_id, l.i FROM l JOIN later ON l.doc_id = later.doc_id AND l.i BETWEEN later.s AND later.e
)
SELECT l.doc_id,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL), '') AS text,
       count(*) AS n_lines, count(gone.i) AS n_deleted
FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i
GROUP BY l.doc_id
"""
