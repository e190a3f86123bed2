"""Benchmark decontamination by latent semantic retrieval.

1. Every text is hashed to its terms once; document frequencies over all documents give
   inverse frequencies.
2. A randomised SVD of TF-IDF passages gives ``RANK`` latent directions. Its rows are the
   benchmark's passages (weighted) and every passage of every document (together they weigh as
   ``SAMPLE_DOCS`` passages do, however many there are). Its columns are the benchmark's terms:
   no other word counts in the checks. Tasks add up products of columns, which are as many
   however many the rows; the sums lie on the executors by ranges of columns, every round
   multiplies there, and the driver sees one table of terms x rank.
3. Every document is cut into blocks of ``BLOCK`` words; a passage is two adjacent blocks, so
   all words of all texts are in some passage. Passages and benchmark items meet by the
   cosine of their latent vectors; an item's bound is scaled by the share of its length that
   the latent space holds, so that items it holds badly are not missed. A passage is much
   longer than an item of fewer than ``SHORT_WORDS`` words, whose cosine is therefore small
   however complete its copy: such items meet passages that hold ``CONTAINED`` of them.
4. Candidates are checked: the longest common subsequence of words with the surrounding
   text must cover ``LCS_SURE`` of the item, or ``LCS_LEAST`` of it with the item's answer (its
   last sentence) present, within a span not much longer than the item. An item of fewer
   than ``LEAST_WORDS`` words must stand there word for word.

The benchmark is handled in blocks of about ``QUERY_BLOCK`` passages or ``TERMS`` terms, one after
the other, each against all documents; items longer than ``ITEM_WORDS`` are split into passages and an item
counts as found if one of them is. Items without words match nothing.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.runtime import bound_batches, materialize, release

BUCKETS = 1 << 18
RANK, OVERSAMPLE, POWER = 256, 8, 2
#: So many passages weigh in the fit what all passages of the documents weigh together.
SAMPLE_DOCS = 2048
#: Terms in one range of the products of columns, and pieces in which sums over the ranges are made.
SPAN, SUMS = 64, 8
#: Products that a task adds up at a time: more of them take several passes over the hashed texts.
CELLS = 1 << 23
BLOCK = 24
QUERY_BLOCK, TERMS = 1024, 8192
#: Words whose products are made at a time.
SOME_WORDS = 1 << 15
ITEM_WORDS, PASSAGE_WORDS, SHORT_WORDS, LEAST_WORDS = 96, 64, 16, 5
COSINE, CONTAINED = 0.25, 0.45
LCS_SURE, LCS_LEAST, ANSWER = 0.8, 0.6, 0.6
WEIGHT = 4.0

_BLANK = bytes(32 if chr(b) in "\t\n\r\x0b\x0c.,;:!?\"'()[]{}<>|*#$%&+=/\\`~^_-" else b for b in range(256))
_SENTENCE = re.compile(r"[.!?]+(?:\s+|$)")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_BLANK).split()


def term_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)) & np.uint32(BUCKETS - 1)


def lcs(masks: dict[bytes, int], size: int, text: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    full = (1 << size) - 1
    row = full
    for w in text:
        hit = masks.get(w)
        if hit:
            part = row & hit
            row = ((row + part) | (row - part)) & full
    return size - row.bit_count()


def word_masks(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Passage:
    """One benchmark passage with what its checks need."""

    def __init__(self, item: object, words: list[bytes], answer: list[bytes]) -> None:
        self.item, self.words, self.answer = item, words, answer
        self.masks, self.answer_masks = word_masks(words), word_masks(answer)
        self.times = {w: m.bit_count() for w, m in self.masks.items()}

    def check(self, text: list[bytes], a: int, b: int) -> tuple[float, bool, int, int] | None:
        """Compare with the words around ``text[a:b]``: (share, answer found, start, end) or None."""
        n = len(self.words)
        lo, hi = max(0, a - n), min(len(text), b + n)
        near = text[lo:hi]
        if n < LEAST_WORDS:
            at = next((i for i in range(len(near) - n + 1) if near[i : i + n] == self.words), None)
            return None if at is None else (1.0, True, lo + at, lo + at + n)
        # no subsequence is longer than the item's words that occur here at all
        if sum(map(self.times.__getitem__, self.times.keys() & set(near))) < LCS_LEAST * n:
            return None
        if lcs(self.masks, n, near) < LCS_LEAST * n:
            return None
        # the best stretch of about the item's own length, found by sliding half its length
        size, best, at = n + max(4, n // 2), -1, 0
        for start in range(0, max(1, len(near) - size // 2), max(1, n // 4)):
            got = lcs(self.masks, n, near[start : start + size])
            if got > best:
                best, at = got, start
        share = best / n
        found = not self.answer or lcs(self.answer_masks, len(self.answer), near[at : at + size]) >= ANSWER * len(self.answer)
        if share >= LCS_SURE or share >= LCS_LEAST and found:
            return share, found, lo + at, min(hi, lo + at + size)
        return None


def passages_of(item: object, text: str | None) -> list[Passage]:
    words = words_of(text or "")
    if not words:
        return []
    sentences = [s for s in _SENTENCE.split(text or "") if words_of(s)]
    answer = words_of(sentences[-1]) if len(sentences) > 1 else words[-max(1, len(words) // 4) :]
    if len(words) <= ITEM_WORDS:
        return [Passage(item, words, answer)]
    cut = [words[i : i + PASSAGE_WORDS] for i in range(0, len(words), PASSAGE_WORDS)]
    if len(cut[-1]) < PASSAGE_WORDS // 2:
        cut[-2:] = [cut[-2] + cut[-1]]
    return [Passage(item, c, answer if k == len(cut) - 1 else []) for k, c in enumerate(cut)]


def hashed_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``terms``: the hash buckets of every text's words in order, four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_hashes(words_of(t or "")).astype("<u4").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["terms"])

    return materialize(docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "terms binary"), "term-hashes")


def inverse_frequencies(hashed: DataFrame) -> tuple[np.ndarray, int]:
    """Smoothed inverse document frequency of every hash bucket, and the number of passages, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, last, seen, passages = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64), 0, 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                terms = np.frombuffer(t, dtype="<u4")
                blocks = -(-len(terms) // BLOCK)
                seen += 1
                passages += blocks - (blocks > 1)
                place = np.arange(len(terms))
                last[terms] = place
                counts[terms[last[terms] == place]] += 1  # every term at its last place
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1, -2], pa.int32()), pa.array([*counts[at], seen, passages], pa.int64())], names=["term", "n"])

    some = hashed.coalesce(hashed.sparkSession.sparkContext.defaultParallelism)
    sums = some.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = sums.toArrow()  # BUCKETS + 2 rows at most
    terms, counts = got["term"].to_numpy(), got["n"].to_numpy()
    total = int(counts[terms == -1].sum())
    out = np.full(BUCKETS, math.log(total + 1.0) + 1.0, dtype=np.float32)
    out[terms[terms >= 0]] = np.log((total + 1.0) / (counts[terms >= 0] + 0.5)) + 0.01
    return np.maximum(out, 0.01), int(counts[terms == -2].sum())


def _unit_row(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms, tf = np.unique(hashes, return_counts=True)
    value = tf * idf[terms]
    return terms, (value / max(float(np.linalg.norm(value)), 1e-9)).astype(np.float32)


class ColumnProducts:
    """Sums over rows of the products of columns ``first..end`` with themselves and later ones.

    The half of each square is kept, so the whole table is that of the sums plus its transpose.
    """

    def __init__(self, first: int, end: int, terms: int) -> None:
        self.first, self.end, self.whole = first, end, first == 0 and end == terms
        widths = terms - np.arange(first, end)
        ends = np.cumsum(widths)
        # a column and the later ones lie one after the other: their places are start + later column
        self.starts, self.terms = ends - widths - np.arange(first, end), terms
        self.sums = np.zeros(int(ends[-1]))

    def add(self, a: np.ndarray, b: np.ndarray, products: np.ndarray) -> None:
        low, high = np.minimum(a, b), np.maximum(a, b)
        if not self.whole:
            some = (low >= self.first) & (low < self.end)
            low, high, products = low[some] - self.first, high[some], products[some]
        np.add.at(self.sums, self.starts[low] + high, products)

    def parts(self) -> Iterator[pa.RecordBatch]:
        for k in range(self.first, self.end, SPAN):
            here = range(k, min(self.end, k + SPAN))
            part = np.zeros((len(here), self.terms - k), dtype=np.float32)
            for i, c in enumerate(here):
                at = self.starts[c - self.first]
                part[i, i:] = self.sums[at + c : at + self.terms]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // SPAN], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["at", "part"])


def add_passages(texts: list[np.ndarray], where: np.ndarray, idf: np.ndarray, weight: float, to: ColumnProducts) -> None:
    """Add ``weight`` times the products of the unit TF-IDF rows of every passage of ``texts``.

    A pair of words is looked at once: it is in the passages that begin at its first word's
    block or the block before. Blocks are numbered with a gap after every text.
    """
    texts = [t for t in texts if len(t)]
    if not texts:
        return
    sizes = np.array([len(t) for t in texts])
    blocks = -(-sizes // BLOCK)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    block = np.repeat(np.cumsum(blocks + 1) - blocks, sizes) + place // BLOCK
    keys, times = np.unique(block * BUCKETS + np.concatenate(texts), return_counts=True)
    block, term = keys // BUCKETS, keys % BUCKETS
    value = times * idf[term].astype(np.float64)
    wide = int(block[-1]) + 2
    length = np.bincount(block, value**2, wide)
    at = np.minimum(np.searchsorted(keys, keys + BUCKETS), len(keys) - 1)
    both = keys[at] == keys + BUCKETS
    shared = np.bincount(block[both], value[both] * value[at[both]], wide)
    following, before = np.append(length[1:], 0), np.append(0, length[:-1])
    begins = (following > 0) | (length > 0) & (before == 0)  # the last block of several begins none
    one = np.where(begins & (length > 0), weight / np.maximum(length + following + 2 * shared, 1e-18), 0)
    two = one + np.append(0, one[:-1])
    column = where[term] - 1
    known = column >= 0
    column, block, value = column[known].astype(np.int64), block[known], value[known]
    within, across = two[block] * value, one[block] * value
    block = block.astype(np.int32)
    to.add(column, column, 0.5 * within * value)
    for d in range(1, len(column)):
        apart = block[d:] - block[:-d]
        near = np.flatnonzero(apart <= 1)
        if not len(near):
            break
        later = near + d
        to.add(column[near], column[later], np.where(apart[near] == 0, within[near], across[near]) * value[later])


def _passes(terms: int) -> Iterator[tuple[int, int]]:
    """Ranges of columns, each with at most ``CELLS`` products or ``SPAN`` columns."""
    first = end = cells = 0
    while end < terms:
        after = min(terms, end + SPAN)
        more = sum(range(terms - after + 1, terms - end + 1))
        if end > first and cells + more > CELLS:
            yield first, end
            first, cells = end, 0
        end, cells = after, cells + more
    if end > first:
        yield first, end


def passage_products(hashed: DataFrame, where: np.ndarray, idf: np.ndarray, weight: float, terms: int) -> DataFrame:
    """``(at, part)``: column products of every passage of every text, in parts to be added up."""
    spark = hashed.sparkSession
    shared = spark.sparkContext.broadcast((where, idf))

    def of(first: int, end: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            where, idf = shared.value
            sums = ColumnProducts(first, end, terms)
            some, size = [], 0
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    some.append(np.frombuffer(t, dtype="<u4"))
                    size += len(some[-1])
                    if size >= SOME_WORDS:
                        add_passages(some, where, idf, weight, sums)
                        some, size = [], 0
            add_passages(some, where, idf, weight, sums)
            yield from sums.parts()

        # sums are as large however many texts a task has: one task for each core
        return hashed.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(run, "at int, part binary")

    out, *more = (of(*x) for x in _passes(terms))
    for x in more:
        out = out.unionByName(x)
    return out


def entry_products(entries: DataFrame, terms: int) -> DataFrame:
    """``(at, part)``: column products of the rows ``(row, term, value)``, in parts to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(c.values.field("term").to_numpy(), c.values.field("value").to_numpy().astype(np.float64)) for batch in batches for c in batch.column(0)]
        for first, end in _passes(terms):
            sums = ColumnProducts(first, end, terms)
            for term, value in rows:
                a, b = np.triu_indices(len(term))
                sums.add(term[a].astype(np.int64), term[b].astype(np.int64), np.where(a == b, 0.5, 1.0) * value[a] * value[b])
            yield from sums.parts()

    cell = F.struct(F.col("term").cast("int").alias("term"), F.col("value").cast("float").alias("value"))
    return entries.groupBy("row").agg(F.collect_list(cell).alias("cells")).select("cells").coalesce(1).mapInArrow(run, "at int, part binary")


def randomised_svd(entries: DataFrame, rows: int, rank: int, seed: int = 5, terms: int | None = None, more: DataFrame | None = None) -> DataFrame:
    """``(term, vector)``: the vectors of ``leading_vectors`` as rows."""
    found = leading_vectors(entries, rows, rank, seed, terms, more)
    return entries.sparkSession.createDataFrame(pa.table({"term": pa.array(range(len(found)), pa.int32()), "vector": pa.array([v.tobytes() for v in found], pa.binary())}))


def leading_vectors(entries: DataFrame, rows: int, rank: int, seed: int = 5, terms: int | None = None, more: DataFrame | None = None) -> np.ndarray:
    """Leading right singular vectors of the matrix ``(row, term, value)``, one row for each term.

    ``rows`` rows are given as entries, a bounded number; of any number of others ``more`` has the
    column products. A range finder with ``POWER`` power rounds on the side of the terms,
    whose number is bounded. Each executor multiplies its ranges of the products of columns; the
    results are added up in ``SUMS`` groups.
    """
    spark = entries.sparkSession
    terms = entries.agg(F.max("term")).first()[0] + 1 if terms is None else terms
    parts = entry_products(entries, terms) if more is None else more.unionByName(entry_products(entries, terms))

    def add(group: pa.Table) -> pa.Table:
        total = 0
        for p in group.column("part"):
            total = total + np.frombuffer(p.as_buffer(), dtype=np.float32)
        return pa.table({"at": group.column("at").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    ranges = materialize(parts.groupBy("at").applyInArrow(add, "at int, part binary"), "svd-products", compact=True)
    slices = [slice(terms * k // SUMS, terms * (k + 1) // SUMS) for k in range(SUMS)]

    def product(y: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(y)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y = shared.value
            total = np.zeros_like(y)
            for batch in batches:
                for at, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    here = slice(at * SPAN, min(terms, (at + 1) * SPAN))
                    half = np.frombuffer(part.as_buffer(), dtype=np.float32).reshape(-1, terms - here.start)
                    total[here] += half @ y[here.start :]
                    total[here.start :] += half.T @ y[here]
            yield pa.RecordBatch.from_arrays([pa.array(range(SUMS), pa.int32()), pa.array([total[x].tobytes() for x in slices], pa.binary())], names=["at", "part"])

        # SUMS rows, which come as Arrow batches: the driver's JVM passes them on without making rows or pickles of them
        got = ranges.mapInArrow(run, "at int, part binary").groupBy("at").applyInArrow(add, "at int, part binary").toArrow()
        shared.destroy()
        total = np.zeros(y.shape, dtype=np.float32)
        for at, part in zip(got["at"].to_pylist(), got["part"], strict=True):
            total[slices[at]] = np.frombuffer(part.as_buffer(), dtype=np.float32).reshape(-1, y.shape[1])
        return total

    y = np.random.default_rng(seed).standard_normal((terms, min(terms, rank + OVERSAMPLE) if more is not None else min(rows, terms, rank + OVERSAMPLE)), dtype=np.float32)
    for _ in range(1 + POWER):
        y = np.linalg.qr(product(y))[0]
    values, vectors = np.linalg.eigh((small := y.T @ product(y)) + small.T)
    values = values / 2
    release(ranges)
    order = [i for i in np.argsort(-values)[:rank] if values[i] > 1e-6 * max(float(values.max()), 1e-30)]
    return y @ vectors[:, order].astype(np.float32)


def _space(hashed: DataFrame, count: int, passages: list[Passage], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(term -> row, rows)``: latent vectors of the benchmark's terms, times idf; row 0 is zero.

    Fit on the ``count`` passages of all documents and on the benchmark's.
    """
    made = [_unit_row(term_hashes(p.words), idf) for p in passages]  # QUERY_BLOCK passages or one item at a time
    active = np.unique(np.concatenate([t for t, _ in made]))
    where = np.zeros(BUCKETS, dtype=np.int32)
    where[active] = np.arange(1, len(active) + 1)
    items = [(k, t, v) for k, (terms, value) in enumerate(made) for t, v in zip((where[terms] - 1).tolist(), (WEIGHT * value).tolist(), strict=True)]
    entries = hashed.sparkSession.createDataFrame(items, "row long, term int, value float")
    more = passage_products(hashed, where, idf, SAMPLE_DOCS / max(1, count), len(active))
    basis = leading_vectors(entries, len(passages), RANK, terms=len(active), more=more)
    latent = np.zeros((len(active) + 1, basis.shape[1]), dtype=np.float32)
    latent[1:] = basis * idf[active][:, None]
    return where, latent


def _matcher(docs: DataFrame, passages: list[Passage], idf: np.ndarray, where: np.ndarray, latent: np.ndarray):
    """A function from a batch's texts to hits ``(row, item, cosine, lcs, answer, start, end)``."""
    query = np.zeros((len(passages), latent.shape[1]), dtype=np.float32)
    bound, floor = np.zeros(len(passages), dtype=np.float32), np.zeros(len(passages), dtype=np.float32)
    for i, p in enumerate(passages):
        h = term_hashes(p.words)
        query[i] = latent[where[h]].sum(axis=0)
        norm = float(np.linalg.norm(_tf_idf(h, idf)))
        held = float(np.linalg.norm(query[i]))
        # <p,q> >= COSINE |p| |q|, with the inner product scaled by the part of |q|^2 that is held
        bound[i] = COSINE * held * held / max(norm, 1e-9)
        floor[i] = CONTAINED * held * held if len(p.words) < SHORT_WORDS else 0.0

    def most(of: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """What a term can add to any item's score, in units of that item's limit.

        Passages whose terms cannot add up to one have no candidate and are not projected at all.
        """
        reach = np.zeros(len(latent), dtype=np.float32)
        for a in range(0, len(latent) if len(of) else 0, 8192):
            reach[a : a + 8192] = np.maximum(0, (latent[a : a + 8192] @ of.T / limit).max(axis=1, initial=0)) * 1.0001
        return reach

    long, short = (bound > 0) & (floor == 0), floor > 0
    parts = ([(p.item, p.words, p.answer) for p in passages], idf, where, latent, query, np.where(long, bound, np.inf), np.where(short, floor, np.inf), most(query[long], bound[long]), most(query[short], floor[short]))
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # bounded by QUERY_BLOCK, TERMS, RANK
    ready: list = []

    def match(texts: list[str | None]) -> list[tuple]:
        if not ready:
            packed, idf, *rest = shared.value
            ready.append(([Passage(*p) for p in packed], idf * idf, *rest))
        out: list[tuple] = []
        for row, t in enumerate(texts):
            words = words_of(t or "")
            if words:
                _scan(row, words, *ready[0], out)
        return out

    return match


def _matchers(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str) -> Iterator:
    """One matcher after the other for blocks of benchmark passages; an item is in one block."""
    hashed, block, held = None, [], set()

    def made():
        nonlocal hashed, idf, count
        if hashed is None:
            hashed = hashed_texts(docs, text)
            idf, count = inverse_frequencies(hashed)
        return _matcher(docs, list(block), idf, *_space(hashed, count, block, idf))

    idf = count = None
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t")).dropDuplicates().orderBy("i", "t")
    for r in items.toLocalIterator():
        more = passages_of(r.i, r.t)
        new = {w for p in more for w in p.masks}
        if block and (len(block) + len(more) > QUERY_BLOCK or len(held | new) > TERMS):
            yield made()
            block.clear()
            held.clear()
        block.extend(more)
        held |= new
    if block:
        last = made()
        release(hashed)
        yield last


def _tf_idf(hashes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    terms, tf = np.unique(hashes, return_counts=True)
    return tf * idf[terms]


def _scan(row: int, words: list[bytes], targets, square, where, latent, query, bound, floor, reach, reach_short, out: list[tuple]) -> None:
    """Append the checked hits of one text to ``out``, the best for each item."""
    hashes = term_hashes(words)
    places = where[hashes]
    starts = np.arange(0, len(words), BLOCK)
    single = len(starts) == 1
    sums = (np.add.reduceat(x, starts) for x in (reach[places], reach_short[places], square[hashes]))
    able, able_short, weight = sums if single else (x[:-1] + x[1:] for x in sums)
    norm = np.sqrt(weight)
    open_ = np.flatnonzero((able >= norm) | (able_short >= 1))
    if not len(open_):
        return
    best: dict = {}
    # words without a vector add nothing; the first of each block stays so that no block is empty
    held = places > 0
    held[starts] = True
    ends = np.cumsum(np.add.reduceat(held, starts, dtype=np.int64)).tolist()
    places = places[held]
    for a in range(0, len(open_), 256):  # some passages at a time, so memory is bounded
        some = open_[a : a + 256]
        blocks = np.unique(some if single else np.concatenate([some, some + 1]))
        spans = [places[ends[b - 1] if b else 0 : ends[b]] for b in blocks.tolist()]
        cuts = np.cumsum([0, *map(len, spans[:-1])])
        vectors = np.add.reduceat(latent[np.concatenate(spans)], cuts, axis=0)
        at = np.searchsorted(blocks, some)
        score = (vectors[at] if single else vectors[at] + vectors[np.searchsorted(blocks, some + 1)]) @ query.T
        need = np.minimum(norm[some][:, None] * bound[None, :], floor[None, :])
        for i, k in zip(*np.nonzero(score >= need), strict=True):
            target, start = targets[k], int(some[i]) * BLOCK
            hit = target.check(words, start, start + 2 * BLOCK)
            if hit and hit[0] > best.get(target.item, (0.0,))[0]:
                held = float(np.linalg.norm(query[k])) * max(float(np.linalg.norm(vectors[at[i]] if single else vectors[at[i]] + vectors[at[i] + 1])), 1e-9)
                best[target.item] = (*hit, float(score[i, k]) / max(held, 1e-9))
    out.extend((row, item, min(1.0, c), share, found, lo, hi) for item, (share, found, lo, hi, c) in best.items())


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, cosine, lcs, answer, start_word, end_word)``: the best hit per row and item.

    ``cosine`` is that of the latent vectors of item and passage. Null texts are empty and match
    nothing; repeated rows each give their own hits, repeated items count once; with an empty
    benchmark nothing is found. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind, item_kind = (f.schema[c].dataType.simpleString() for f, c in ((docs, doc_id), (benchmark, item_id)))
    shape = f"doc_id {kind}, item_id string, cosine double, lcs double, answer boolean, start_word long, end_word long"

    def searched(match) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = (pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64())
            for batch in batches:
                best: dict = {}
                for hit in match(batch.column(1).to_pylist()):  # an item split into passages may be hit through several
                    if hit[3] > best.get(hit[:2], hit[:3] + (0.0,))[3]:
                        best[hit[:2]] = hit
                if best:
                    rows, items, *rest = zip(*best.values(), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array([None if i is None else str(i) for i in items], pa.string()), *[pa.array(c, k) for c, k in zip(rest, kinds, strict=True)]],
                        names=["doc_id", "item_id", "cosine", "lcs", "answer", "start_word", "end_word"],
                    )

        return narrow.mapInArrow(run, shape)

    hits = last = None
    for match in _matchers(docs, benchmark, text, item_id, item_text):
        if last is not None:  # only one block's vectors are held at a time
            done = materialize(last, "contaminated", compact=True)
            hits = done if hits is None else hits.unionByName(done)
        last = searched(match)
    if last is None:
        return docs.sparkSession.createDataFrame([], shape).withColumn("item_id", F.col("item_id").cast(item_kind))
    hits = last if hits is None else hits.unionByName(last)
    return hits.withColumn("item_id", F.col("item_id").cast(item_kind))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns, decided row by row.

    Null and empty texts hold none; repeated rows are all kept or all dropped.
    """
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def cleared(frame: DataFrame, match) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [None if t is None else str(t) for t in batch.column(at).to_pylist()]
                hit = {h[0] for h in match(texts)}
                yield batch.filter(pa.array([i not in hit for i in range(len(texts))], pa.bool_()))

        return frame.mapInArrow(run, docs.schema)

    kept, last = docs, None
    for match in _matchers(docs, benchmark, text, "item_id", "text"):
        if last is not None:
            kept = materialize(cleared(kept, last), "cleared")
        last = match
    return kept if last is None else cleared(kept, last)
