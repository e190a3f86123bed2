"""SimHash near-duplicates: pigeonhole blocks, exact Hamming check, components.

Fingerprints. A text is lower-cased (A-Z only) and cut into words at ASCII white space;
its shingles of three words (all of them, repeats included; one shorter shingle if there
are fewer words) are hashed with XXH64, seed 42. A bit of the fingerprint is set if it is
set in more than half of the hashes. Null and empty texts have the fingerprint zero.

Links. Two fingerprints link when at most two bits differ. The 64 bits are split into five
blocks; two differing bits spoil at most two of them, so a linked pair agrees on some three
blocks. Distinct fingerprints (never documents) meet on each of the ten block triples:

* a bucket of up to ``PAIR_LIMIT`` distinct fingerprints is compared pair by pair;
* a larger bucket is linked exactly without pairs. Each member stands for itself and for
  every fingerprint one bit away (outside the bucket's own bits). Two members share such a
  stand-in if and only if they differ in at most two bits, and a stand-in has no more than
  about forty distinct members, so linking each to the smallest is linear in the bucket.

Copies share a fingerprint and cost one row, however many there are.

The near-dedup stage of the pipeline (``keep_one``) links documents whose sets of five-word
shingles have a Jaccard similarity of 0.8 or more. Such pairs differ in about ten bits of a
64-bit SimHash and in up to eighteen, and blocks that must agree would have three bits each:
they select nothing. The stage keeps the scheme and changes the symbols. Its fingerprint is
``SYMBOLS`` min-wise hashes of the set, split into blocks of ``BLOCK_SYMBOLS``; close pairs
share a block (a pair of similarity 0.8 shares none with probability 3e-6) and meet on equal
blocks; the Hamming distance of the fingerprints' one-bit code is 16 of 160 bits on average at
similarity 0.8 and over ``FAR_BITS`` with probability 3e-7.
What is left is compared exactly, set by set, and no bucket is expanded into its pairs: sets
that hang together by shared blocks are compared part by part within tasks that return links
alone. In a group of more than ``GROUP`` sets each first meets the most central one of its
bucket, where the Hamming distance of the code is verified before the sets are compared, and
only what this leaves in different components is compared part by part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.operators.components import connected_components
from evigraph.runtime import bound_batches, materialize, release, spread_join

SEED = 42
SHINGLE = 3
MAX_BITS = 2
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PAIR_LIMIT = 48

#: The near-dedup stage.
NEAR_SHINGLE = 5
SYMBOLS, BLOCK_SYMBOLS, FAR_BITS = 160, 5, 38
WANTED_BITS = 1 << 23
GROUP, PART = 1 << 14, 256

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The eight bits of a byte as eight one-byte lanes of a word, bit 0 in the lowest lane.
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype="<u8")


def shingle_hashes(raw: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle of a UTF-8 text."""
    words = raw.translate(_LOWER).split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= size:
        return [digest(joined, SEED)]
    ends, at = [], -1
    for n in map(len, words):
        at += n + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(words) - size]]]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)]


def lane_counts(hashes: np.ndarray) -> np.ndarray:
    """For uint64 hashes, how often each of the 64 bits is set."""
    spread = _LANES[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    total = np.zeros(64, dtype=np.int64)
    if not len(spread):
        return total
    # one-byte lanes hold sums of up to 255 rows
    sums = np.add.reduceat(spread, np.arange(0, len(spread), 255), axis=0)
    return sums.astype("<u8").view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)


def fingerprint(raw: bytes | None) -> int:
    """Unsigned 64-bit fingerprint of one UTF-8 text."""
    hashes = shingle_hashes(raw or b"")
    if not hashes:
        return 0
    counts = lane_counts(np.array(hashes, dtype=np.uint64))
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fp)`` per row, ``fp`` as the signed long with the fingerprint's bits."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(marks, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, fp long")


def _mask(triple: tuple[int, ...]) -> int:
    bits = sum(((1 << n) - 1) << at for at, n in (BLOCKS[i] for i in triple))
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def hamming_links(distinct: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges ``(u, v)`` that connect exactly the fingerprints at most two bits apart.

    ``distinct`` has one row per fingerprint in column ``fp``. Not every linked pair is
    returned, but any two linked fingerprints are joined by returned edges.
    """
    triples = list(combinations(range(len(BLOCKS)), len(BLOCKS) - MAX_BITS))
    keyed = distinct.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(_mask(t))).alias("bits"))
                    for i, t in enumerate(triples)
                ]
            )
        ).alias("k"),
    ).select("fp", F.col("k.block").alias("block"), F.col("k.bits").alias("bits"))
    sizes = keyed.groupBy("block", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(keyed.join(sizes, ["block", "bits"]), "simhash-blocks")

    few = met.where(F.col("n") <= pair_limit).select("block", "bits", "fp")
    pairs = (
        few.withColumnRenamed("fp", "u")
        .join(few.withColumnRenamed("fp", "v"), ["block", "bits"])
        .where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS))
        .select("u", "v")
    )

    flips = F.array(
        *[
            F.array(F.lit(0).cast("long"), *[F.lit(f - (1 << 64) if f >= 1 << 63 else f).cast("long") for f in (1 << b for b in range(64)) if not f & (_mask(t) % (1 << 64))])
            for t in triples
        ]
    )
    many = met.where(F.col("n") > pair_limit).select("block", "fp", F.explode(F.element_at(flips, F.col("block") + 1)).alias("flip"))
    many = many.select("block", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    stars = (
        many.groupBy("block", "near")
        .agg(F.min("fp").alias("u"), F.collect_list("fp").alias("vs"))  # at most 41 distinct members
        .where(F.size("vs") > 1)
        .select("u", F.explode("vs").alias("v"))
        .where("u <> v")
    )
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for every row of ``docs``.

    ``component_id`` is the smallest non-null id among the documents reachable over links,
    the document's own included (null only if all of them are null). Repeated rows and ids
    each keep their own output row; null and empty texts share the fingerprint zero. Other
    columns of ``docs`` are ignored.
    """
    marks = materialize(fingerprints(docs, text, doc_id), "simhash-marks")
    distinct = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("times")), "simhash-distinct")
    parts = connected_components(hamming_links(distinct.select("fp")))
    labelled = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", "times", F.coalesce("component", "fp").alias("component")
    )
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = materialize(labelled.join(ids, "component").select("fp", "times", "component_id"), "simhash-classes", compact=True)
    release(distinct)
    return spread_join(marks, classes, ["fp"], "times").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_set(raw: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of ``NEAR_SHINGLE`` words."""
    return np.unique(np.array(shingle_hashes(raw or b"", NEAR_SHINGLE), dtype=np.uint64))


_DRAW = np.random.default_rng(SEED)
_XOR, _TIMES = (_DRAW.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32)[:, None] for _ in range(2))
_TIMES |= np.uint32(1)
_WEIGHTS = _DRAW.integers(0, 1 << 63, (SYMBOLS // BLOCK_SYMBOLS, BLOCK_SYMBOLS + 1), dtype=np.uint64) | np.uint64(1)
_SCATTER = np.uint32(0x9E3779B1)


def min_wise(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's block keys and its code: one bit of each of ``SYMBOLS`` min-wise hashes, as three longs."""
    small = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    least = np.full(SYMBOLS, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(small), 1024):
        np.minimum(least, ((small[None, a : a + 1024] ^ _XOR) * _TIMES).min(axis=1), out=least)
    keys = (least.reshape(_WEIGHTS.shape[0], BLOCK_SYMBOLS).astype(np.uint64) * _WEIGHTS[:, 1:]).sum(axis=1, dtype=np.uint64) ^ _WEIGHTS[:, 0]
    bits = np.zeros(192, dtype=np.uint8)
    bits[:SYMBOLS] = (least * _SCATTER) >> np.uint32(31)
    return keys.view(np.int64), np.packbits(bits).view(np.int64)


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes(), SEED)


def _marks(named: DataFrame) -> DataFrame:
    """``(doc_id, a, b, digest, n, keys, c0, c1, c2)`` per row: hash and size of its shingle set, block keys, code."""
    bound_batches(named.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, keys, codes = [], [], [], []
            for raw in batch.column(3).cast(pa.binary()).to_pylist():
                found = shingle_set(raw)
                blocks, code = min_wise(found)
                digests.append(_digest(found))
                sizes.append(len(found))
                keys.append(blocks if len(found) else blocks[:0])
                codes.append(code)
            code = np.array(codes, dtype=np.int64).reshape(-1, 3)
            columns = [*batch.columns[:3], pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), *[pa.array(code[:, i]) for i in range(3)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a", "b", "digest", "n", "keys", "c0", "c1", "c2"])

    key = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(run, f"doc_id {key}, a long, b long, digest binary, n int, keys array<long>, c0 long, c1 long, c2 long")


def _close(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Those of the pairs ``(u, v)`` whose sizes and codes allow a similarity of 0.8."""
    side = lambda tag: facts.select(F.col("id").alias(tag), *[F.col(c).alias(f"{tag}_{c}") for c in ("n", "c0", "c1", "c2")])
    return pairs.join(side("u"), "u").join(side("v"), "v").where(_may_match("u", "v")).select("u", "v")


def _may_match(u: str, v: str) -> Column:
    sizes = (5 * F.col(f"{u}_n") >= 4 * F.col(f"{v}_n")) & (5 * F.col(f"{v}_n") >= 4 * F.col(f"{u}_n"))
    apart = sum((F.bit_count(F.col(f"{u}_{c}").bitwiseXOR(F.col(f"{v}_{c}"))) for c in ("c0", "c1", "c2")), F.lit(0))
    return sizes & (apart <= FAR_BITS)


def _sets(wanted: DataFrame, named: DataFrame) -> DataFrame:
    """``(id, x)``: the sets of the ids and digests in ``wanted`` as sorted 32-bit hashes.

    Sets are made again from the texts that are wanted, which have the hashes ``a``: a bitmap
    of ``WANTED_BITS`` bits tells most of them, whatever their number, a join by digest the rest.
    """
    slot = F.pmod("a", F.lit(WANTED_BITS))
    words = wanted.select(F.expr(f"pmod(a, {WANTED_BITS})").alias("slot")).groupBy(F.expr("slot div 32").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 AS int)))").alias("bits"))
    bitmap = np.zeros(WANTED_BITS // 32, dtype=np.uint32)
    got = words.toArrow()  # WANTED_BITS / 32 words at most
    bitmap[got["w"].to_numpy()] = got["bits"].to_numpy()
    shared = named.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            some = np.flatnonzero(held[at >> 5] >> (at & 31).astype(np.uint32) & 1)
            found = [shingle_set(x) for x in batch.column(1).take(pa.array(some)).cast(pa.binary()).to_pylist()]
            packed = [np.unique(x.astype(np.uint32)).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in found], pa.binary()), pa.array(packed, pa.binary())], names=["digest", "x"])

    sets = named.select(slot.alias("slot"), "text").mapInArrow(run, "digest binary, x binary").join(wanted.select("digest", "id"), "digest")
    sets = materialize(sets.groupBy("id").agg(F.first("x").alias("x")), "near-sets")
    shared.destroy()
    return sets


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``(u, v)`` of ids whose whole sets have a Jaccard similarity of 0.8 or more."""
    both = pairs.join(sets.withColumnsRenamed({"id": "u", "x": "a"}), "u").join(sets.withColumnsRenamed({"id": "v", "x": "b"}), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(c.as_buffer(), dtype=np.uint32) for c in (a, b))
                keep.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _joined(labels: list[int], sets: list[np.ndarray], left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Pairs of labels of similar sets, one where several would join the same; each of ``left`` meets the ``right`` after it."""
    root = {x: x for x in labels}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(sets[j]) for j in right])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    names, places = np.unique(np.concatenate([sets[j] for j in right]), return_inverse=True)
    here, links = np.zeros(len(names) + 1, dtype=np.int32), []
    for k, i in enumerate(left):
        at = np.minimum(np.searchsorted(names, sets[i]), len(names) - 1)
        at = at[names[at] == sets[i]]
        here[at] = 1
        shared = np.add.reduceat(here[places], starts)
        here[at] = 0
        for m in np.flatnonzero(9 * shared >= 4 * (sizes + len(sets[i]))):
            j = right[m]
            if (left is not right or m > k) and (a := find(labels[i])) != (b := find(labels[j])):
                root[b] = a
                links.append((labels[i], labels[j]))
    return links


def _across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(u, v)`` between the components of similar sets that are members of one block.

    ``members`` has block, id and component. A block is dealt into parts of about ``PART``
    sets, and each two parts meet in one task that compares whole sets and returns no more
    links than it takes to join them.
    """
    dealt = members.join(members.groupBy("block").agg(F.count(F.lit(1)).alias("size")), "block").withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
    dealt = dealt.withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = dealt.select("block", "id", "component", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")).select("block", "id", "component", "p", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))

    def run(group: pa.Table) -> pa.Table:
        labels, parts = (group.column(c).to_pylist() for c in ("component", "p"))
        found = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in group.column("x")]
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = ([k for k, p in enumerate(parts) if p == x] for x in (i, j))
        links = _joined(labels, found, left, left if i == j else right) if left and right else []
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return met.join(sets, "id").groupBy("block", "i", "j").applyInArrow(run, "u long, v long")


def _starred(led: DataFrame, facts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(u, v)`` in groups too large to compare in parts.

    Each set first meets the central set of its blocks; only blocks with sets of different
    components are then compared in parts, sets of one component not with each other. Where
    a block has many components of sets that are less than similar, this costs the square of
    its size.
    """
    stars = led.where("id <> centre").select(F.least("id", "centre").alias("u"), F.greatest("id", "centre").alias("v")).distinct()
    links = materialize(_similar(_close(stars, facts), sets), "near-links", compact=True)
    parts = materialize(connected_components(links).withColumnRenamed("node", "id"), "near-parts", compact=True)
    of = lambda c: parts.withColumnsRenamed({"id": c, "component": f"{c}_part"})
    labelled = led.join(of("id"), "id", "left").join(of("centre"), "centre", "left")
    labelled = labelled.select("key", "id", F.coalesce("id_part", "id").alias("component"), F.coalesce("centre_part", "centre").alias("centre"))
    mixed = labelled.where("component <> centre").select("key").distinct()
    open_ = materialize(labelled.join(mixed, "key", "left_semi").select(F.col("key").alias("block"), "id", "component"), "near-open", compact=True)
    more = materialize(_across(open_, sets), "near-links", compact=True)
    release(open_)
    release(parts)
    return links.unionByName(more)


def similar_components(distinct: DataFrame, named: DataFrame) -> DataFrame:
    """``(id, component)`` of the sets that are linked by Jaccard similarities of 0.8 or more.

    ``distinct`` has one row ``(id, digest, rep, n, keys, c0, c1, c2)`` for each set. Not
    every similar pair becomes a link, but any two similar sets are joined by links. Sets that
    hang together by shared blocks are a group; groups of up to ``GROUP`` sets are compared
    whole, larger ones by way of the central sets of their blocks.
    """
    rows = distinct.select("id", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = materialize(rows.join(sizes, "key").select("key", "id", "size"), "near-met", compact=True)
    # the set with the most company is the likeliest to be similar to all others of its buckets
    weight = met.groupBy("id").agg(F.sum("size").alias("weight"))
    centre = met.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", "id"))["id"].alias("centre"))
    led = materialize(met.join(centre, "key").select("key", "id", "centre"), "near-led", compact=True)
    release(met)
    groups = connected_components(led.select("id", "centre").distinct(), "id", "centre").select(F.col("node").alias("id"), F.col("component").alias("block"))
    facts = materialize(groups.join(distinct, "id").select("id", "block", "digest", "rep.a", "n", "c0", "c1", "c2"), "near-facts", compact=True)
    sets = _sets(facts.select("id", "digest", "a"), named)
    large = materialize(facts.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > GROUP).select("block"), "near-large", compact=True)
    links = _across(facts.join(large, "block", "left_anti").select("block", "id", F.col("id").alias("component")), sets)
    if large.limit(1).count():
        held = facts.join(large, "block", "left_semi").select("id")
        links = links.unionByName(_starred(materialize(led.join(held, "id", "left_semi"), "near-led", compact=True), facts, sets))
    parts = materialize(connected_components(links), "near-parts", compact=True)
    for done in (led, facts, sets, large):
        release(done)
    return parts.withColumnRenamed("node", "id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each group of near-duplicates, with all its columns.

    Near-duplicates are documents reachable over pairs with a Jaccard similarity of
    ``NEAR_SHINGLE``-word shingles of 0.8 or more; texts that differ only in case or white
    space, and null and empty texts, are equal. The smallest id stays, null ids last; of texts
    that share it, the one of the smallest hash. Rows equal in id and text count once.
    """
    whole = F.col(text).cast("string")
    key = {"__a": F.xxhash64(F.col(doc_id), whole, F.col(doc_id).isNull()), "__b": F.xxhash64(F.lit(SEED), whole, F.col(doc_id))}
    named = docs.select(F.col(doc_id).alias("doc_id"), key["__a"].alias("a"), key["__b"].alias("b"), whole.alias("text"))
    marks = materialize(_marks(named), "near-marks")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")).alias("rep")
    distinct = materialize(marks.groupBy("digest").agg(rep, *[F.first(c).alias(c) for c in ("n", "keys", "c0", "c1", "c2")]).withColumn("id", F.monotonically_increasing_id()), "near-distinct")
    release(marks)
    labelled = distinct.select("id", "rep").join(similar_components(distinct, named), "id", "left")
    kept = materialize(labelled.groupBy(F.coalesce("component", "id").alias("c")).agg(F.min("rep").alias("rep")).select(F.col("rep.a").alias("__a"), F.col("rep.b").alias("__b")), "near-kept", compact=True)
    release(distinct)
    return docs.withColumns(key).join(kept, ["__a", "__b"], "left_semi").dropDuplicates(["__a", "__b"]).select(*docs.columns)
