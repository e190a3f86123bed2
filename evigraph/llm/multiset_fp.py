"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is a non-empty piece between newlines. It is hashed to one wide vector, and a
document's fingerprint is the sum of its paragraphs' vectors, lane by lane:

* ``STRONG`` lanes modulo 2^32, from BLAKE2b of the paragraph's bytes. They make equality of
  fingerprints mean equality of the paragraph multisets (1024 bits).
* ``SKETCH`` lanes modulo 2^32, each the sum of +1 or -1 over the paragraph's shingles of
  three words (a tug-of-war sketch). Squared differences of these lanes estimate how far the
  shingle multisets of two documents are apart, which gives a graded likeness.

Both are sums in a group, so paragraphs in any order give the same fingerprint, and a
paragraph is inserted or deleted by adding or subtracting its vector alone; the query
derives the edited text's fingerprint in that way. Texts that are equal have equal
fingerprints; null counts as the empty text, whose fingerprint is all zeros.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.ranges import ranged
from evigraph.runtime import bound_batches, shuffle_width

STRONG, SKETCH, SHINGLE, SEED = 32, 256, 3, 1009
COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

#: The eight bits of a byte as eight one-byte lanes of a word.
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype="<u8")


def _shingles(words: list[bytes]) -> Iterator[bytes]:
    if len(words) <= SHINGLE:
        if words:
            yield b" ".join(words)
        return
    for i in range(len(words) - SHINGLE + 1):
        yield b" ".join(words[i : i + SHINGLE])


def _signs(hashes: list[int]) -> np.ndarray:
    """Sum over hashes of SKETCH values +1 or -1, modulo 2^32."""
    out = np.zeros(SKETCH, dtype=np.int64)
    if hashes:
        base = np.array(hashes, dtype=np.uint64)
        for i in range(SKETCH // 64):
            x = base + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            spread = _LANES[x.view(np.uint8).reshape(-1, 8)]
            sums = np.add.reduceat(spread, np.arange(0, len(spread), 255), axis=0)
            out[64 * i : 64 * i + 64] = sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    return (2 * out - len(hashes)).astype(np.uint32)


class Fingerprint:
    """A sum of paragraph vectors that texts can be added to and taken from."""

    __slots__ = ("sketch", "strong")

    def __init__(self, strong: np.ndarray | None = None, sketch: np.ndarray | None = None) -> None:
        self.strong = np.zeros(STRONG, dtype=np.uint32) if strong is None else strong
        self.sketch = np.zeros(SKETCH, dtype=np.uint32) if sketch is None else sketch

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        out = cls()
        if not text:
            return out
        digest, hashes, blobs = xxhash.xxh64_intdigest, [], []
        for paragraph in text.encode("utf-8", "surrogatepass").split(b"\n"):
            if paragraph:
                blobs.append(hashlib.blake2b(paragraph, salt=b"strong-0").digest())
                blobs.append(hashlib.blake2b(paragraph, salt=b"strong-1").digest())
                hashes.extend([digest(s, SEED) for s in _shingles(paragraph.split())])
        if blobs:
            lanes = np.frombuffer(b"".join(blobs), dtype="<u4").reshape(-1, STRONG)
            out.strong = lanes.sum(axis=0, dtype=np.uint64).astype(np.uint32)
        out.sketch = _signs(hashes)
        return out

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.strong + other.strong, self.sketch + other.sketch)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.strong - other.strong, self.sketch - other.sketch)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.strong == other.strong).all() and (self.sketch == other.sketch).all())

    __hash__ = None

    def text(self) -> str:
        return base64.b64encode(self.strong.astype("<u4").tobytes() + self.sketch.astype("<u4").tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw[: 4 * STRONG], "<u4").astype(np.uint32), np.frombuffer(raw[4 * STRONG :], "<u4").astype(np.uint32))

    def likeness(self, other: Fingerprint) -> float:
        """Estimate of 2<a,b> / (<a,a> + <b,b>) of the shingle counts, within 0 and 1; 1 if equal."""
        if self == other:
            return 1.0
        mine, theirs = (x.sketch.astype(np.int32).astype(np.float64) for x in (self, other))
        apart = (self.sketch - other.sketch).astype(np.int32).astype(np.float64)
        whole = float(mine @ mine + theirs @ theirs)
        return min(1.0, max(0.0, 1.0 - float(apart @ apart) / whole)) if whole else 0.0


def edit(text: str, following: str) -> tuple[str, int]:
    """The text with its last third replaced from ``following``; and where the edit begins."""
    k = len(text) // 3
    cut = len(text) - k
    return text[:cut] + following[:k], cut


def _row(text: str, mine: Fingerprint, following: str, theirs: Fingerprint) -> tuple:
    changed, cut = edit(text, following)
    at = text.rfind("\n", 0, cut) + 1  # paragraphs before stay as they are
    edited = mine - Fingerprint.of(text[at:]) + Fingerprint.of(changed[at:]) if changed != text else mine
    return (
        len(text),
        hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        mine.text(),
        edited.text(),
        mine.likeness(edited),
        mine.likeness(theirs),
    )


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows in partitions, by descending id, each run ending with a copy of what follows it.

    Rows are dealt by ranges of the id; a range of one id that holds far more rows than others
    is dealt again by the hash of the text. The first row of each run is copied to the end of
    the one before; the first of all follows the last. Ties of the id go by the hash of the
    text, then the text, descending; null ids come last.
    """
    spark = docs.sparkSession
    parts = 4 * shuffle_width(spark)
    keyed = ranged(docs, "doc_id", parts).withColumn("h", F.xxhash64("text"))
    sizes = keyed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), (F.min("doc_id").eqNullSafe(F.max("doc_id"))).alias("single")).collect()  # parts rows or so
    fair = max(1, sum(r.n for r in sizes) // parts)
    split = [(r.range, min(parts, r.n // fair)) for r in sizes if r.single and r.n > 2 * fair]
    parted = keyed.join(F.broadcast(spark.createDataFrame(split, "range int, times int")), "range", "left")
    # the hash's upper 31 bits, 0 to 2^31 - 1 in order, cut evenly
    part = F.floor(F.shiftright(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 33).bitwiseAND(F.lit((1 << 31) - 1)) * F.coalesce("times", F.lit(1)) / (1 << 31))
    bucketed = parted.select((F.col("range").cast("long") * parts + part.cast("long")).alias("bucket"), "doc_id", "h", "text")
    heads = bucketed.groupBy("bucket").agg(F.max(F.struct("doc_id", "h", "text")).alias("head"))
    order = sorted((r.bucket for r in bucketed.select("bucket").distinct().collect()), reverse=True)  # a few numbers for each part
    before = {b: order[i - 1] for i, b in enumerate(order)}
    moved = spark.createDataFrame(list(before.items()), "bucket long, target long")
    ends = heads.join(F.broadcast(moved), "bucket").select(F.col("target").alias("bucket"), "head.doc_id", "head.h", "head.text", F.lit(1).alias("end"))
    return (
        bucketed.withColumn("end", F.lit(0))
        .unionByName(ends)
        .repartition(shuffle_width(spark), "bucket")
        .sortWithinPartitions(F.col("bucket").desc(), "end", F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc())
    )


def fingerprint_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edit, with likenesses, one row per input row.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Null texts are empty; a lone document is its own next. Ids may be of any type
    that has an order; repeated rows keep a row each (ties of doc_id are ordered by the hash
    of the text, descending). Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (id, text, fingerprint) that waits for what follows it
        for batch in batches:
            rows = []
            for end, key, now in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                mark = Fingerprint.of(now)
                if held is not None:
                    rows.append((held[0], *_row(held[1], held[2], now, mark)))
                held = None if end else (key, now, mark)
            if rows:
                kinds = (batch.column(1).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=COLUMNS)

    return _in_order(narrow).select("end", "doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
