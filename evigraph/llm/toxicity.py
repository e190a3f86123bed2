"""Toxicity: a factorization machine over hashed terms.

A text is the set of its terms: lower-cased words, and prefixes of four to six letters of
longer words, so that inflected forms of one stem share terms. Each term is hashed to one of
``BUCKETS`` features. The machine scores

    b + sum_i w_i + 1/2 sum_f ((sum_i v_if)^2 - sum_i v_if^2)

over the features present: besides a weight for each term it learns a vector for each, and
the products of the vectors say how much two terms mean together (an insult with a group
mention) beyond what they mean alone. No term is left out for meaning nothing alone: an L1
fit over all terms chooses weights, every pair of stems in a document is then tallied with
what that fit leaves unexplained, and both the weighted terms and the members of pairs
with evidence get weights and vectors, fitted together. Most features stay exactly zero, so
scoring a document looks at few. The fit takes every labelled document that is not held out:
tasks add up counts, slopes and sums over pairs where the documents are, and documents that
hold the same of the chosen features and have the same label are one row with their number. Tables
as long as the features lie on the executors in pieces; the driver sees what each piece selects,
at most a number for each feature that enough documents hold. Scoring covers every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.labelled import held_out, training_rows
from evigraph.runtime import bound_batches, materialize, release

BUCKETS = 1 << 20
FACTORS = 4
MIN_DOCS = 3
#: So many documents must speak for a term before it gets a weight of its own.
EVIDENCE = 2.0
#: And so many deviations of what chance would give it.
CHANCE = 3.0
#: Evidence a pair of stems needs: documents whose labels the weights leave unexplained, and deviations.
PAIR_EVIDENCE, PAIR_Z = 10.0, 6.0
RIDGE = 0.1
STEPS = 200
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
CACHE_WORDS = 200_000
#: Numbers in one piece of a sum, and sums over pairs that a task makes at a time.
PIECE, PAIR_CELLS = 1 << 16, 1 << 22
#: So many bytes of distinct rows of the chosen features are brought to the driver; more stay where they are.
HELD_BYTES = 1 << 22

_WORD = re.compile(r"[^\W\d_]+")


def _hash(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def word_features(word: str) -> list[int]:
    """The feature numbers of one lower-case word."""
    return [_hash(word), *[_hash(f"^{word[:n]}") for n in PREFIXES if len(word) > n]]


def stem_feature(word: str) -> int:
    """The feature that the inflected forms of a word share."""
    return _hash(f"^{word[: PREFIXES[-1]]}") if len(word) > PREFIXES[-1] else _hash(word)


def text_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


class FactorizationMachine:
    """The nonzero part of a fitted machine."""

    def __init__(self, bias: float, active: dict[int, int], weights: np.ndarray, vectors: np.ndarray) -> None:
        self.bias, self.active, self.weights, self.vectors = bias, active, weights, vectors
        self._seen: dict[str, tuple[int, ...]] = {}

    def parts(self) -> tuple:
        return self.bias, self.active, self.weights, self.vectors

    def _rows(self, word: str) -> tuple[int, ...]:
        rows = self._seen.get(word)
        if rows is None:
            if len(self._seen) >= CACHE_WORDS:
                self._seen.clear()
            rows = self._seen[word] = tuple(self.active[f] for f in word_features(word) if f in self.active)
        return rows

    def margin(self, text: str) -> float:
        rows: set[int] = set()
        for word in text_words(text):
            rows.update(self._rows(word))
        if not rows:
            return self.bias
        at = np.fromiter(rows, dtype=np.int64)
        at.sort()
        total = self.vectors[at].sum(axis=0)
        return float(self.bias + self.weights[at].sum() + 0.5 * (total @ total - (self.vectors[at] ** 2).sum()))

    def probability(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.margin(text or ""), -30, 30))))


class Rows(NamedTuple):
    """Some documents: places of their features and of their stems, labels and how many times each counts."""

    row: np.ndarray
    feature: np.ndarray
    y: np.ndarray
    times: np.ndarray
    stem_row: np.ndarray
    stem: np.ndarray


def _rows(x: list[np.ndarray], stems: list[np.ndarray], y: object, times: object) -> Rows:
    def flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(v) for v in lists]), np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, dtype=np.int64)

    row, feature = flat(x)
    return Rows(row, feature, np.asarray(y, dtype=float), np.asarray(times, dtype=float), *flat(stems))


def _places(names: np.ndarray) -> np.ndarray:
    """The place of every feature in ``names``, or -1."""
    where = np.full(BUCKETS, -1, dtype=np.int64)
    where[names] = np.arange(len(names))
    return where


def _labelled(cells: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Cells of a table and their whole numbers of less than 2^40, eight bytes for both."""
    return cells.astype(np.int64) << 40 | np.rint(numbers).astype(np.int64)


def _unlabelled(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells in order, and the numbers, of ``_labelled``."""
    packed = np.sort(packed)
    return packed >> 40, packed & (1 << 40) - 1


#: Makes a table of sums, and the function that adds some documents to it.
Work = Callable[[], tuple[np.ndarray, Callable[[Rows], None]]]


class Held:
    """Documents in memory."""

    def __init__(self, rows: Rows) -> None:
        self.rows = rows

    def sums(self, work: Work, length: int, select: Callable | None = None) -> np.ndarray:
        total, add = work()
        add(self.rows)
        return total if select is None else select(0, total)

    def only(self, names: np.ndarray) -> Held:
        at = _places(names)[self.rows.feature]
        none = np.zeros(0, dtype=np.int64)
        return Held(self.rows._replace(row=self.rows.row[at >= 0], feature=at[at >= 0], stem_row=none, stem=none))

    def release(self) -> None:
        pass


class Dealt:
    """Documents ``(x, stems, y, times)`` in a written table, added up where they are."""

    def __init__(self, frame: DataFrame) -> None:
        self.frame = frame

    def sums(self, work: Work, length: int, select: Callable | None = None) -> np.ndarray:
        """The table of ``length`` columns added up over all documents, or what ``select`` finds in its pieces."""
        few = length <= PIECE // 4

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, add = work()
            for batch in batches:
                x, stems = ([np.frombuffer(v, dtype="<i4") for v in batch.column(k).to_pylist()] for k in (0, 1))
                if x:
                    add(_rows(x, stems, batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            for k in range(0, length, PIECE):
                part = total[:, k : k + PIECE].astype(np.float64 if few else np.float32)
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k // PIECE], pa.int32()), pa.array([len(part)], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["piece", "deep", "part"])

        def add_up(group: pa.Table) -> pa.Table:
            piece, deep = group.column("piece")[0].as_py(), group.column("deep")[0].as_py()
            total = 0
            for p in group.column("part"):
                total = total + np.frombuffer(p.as_buffer(), dtype=np.float32).astype(np.float64)
            total = total.reshape(deep, -1)
            out = total if select is None else select(piece * PIECE, total)
            return pa.table({"piece": pa.array([piece], pa.int32()), "deep": pa.array([deep], pa.int32()), "part": pa.array([out.tobytes()], pa.binary())})

        shape = "piece int, deep int, part binary"
        # the table is as large however many documents a task has: one task for each core
        parts = self.frame.coalesce(self.frame.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, shape)
        got = (parts if few else parts.groupBy("piece").applyInArrow(add_up, shape)).toArrow().to_pylist()  # a short table, or what was selected
        if select is not None and not (few and got):
            return np.concatenate([np.zeros(0, dtype=np.int64), *[np.frombuffer(r["part"], dtype=np.int64) for r in got]])
        total = np.zeros((got[0]["deep"] if got else 1, length))
        for r in got:
            part = np.frombuffer(r["part"]).reshape(r["deep"], -1)
            total[:, r["piece"] * PIECE : r["piece"] * PIECE + part.shape[1]] += part
        return total if select is None else select(0, total)

    def only(self, names: np.ndarray) -> Held | Dealt:
        """The documents with the features ``names`` alone, equal ones as one row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            where = _places(names)
            for batch in batches:
                found = (where[np.frombuffer(v, dtype="<i4")] for v in batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([f[f >= 0].astype("<i4").tobytes() for f in found], pa.binary()), batch.column(1), batch.column(2)], names=["x", "y", "n"])

        some = self.frame.select("x", "y", "times").mapInArrow(run, "x binary, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("times"))
        some = materialize(some.select("x", F.lit(b"").alias("stems"), "y", "times"), "toxic-rows", compact=True)
        size = some.agg(F.sum(F.length("x") + 32)).first()[0] or 0
        if size > HELD_BYTES:
            return Dealt(some)
        rows = some.orderBy("x", "y").toArrow()  # HELD_BYTES at most
        release(some)
        return Held(_rows([np.frombuffer(x, dtype="<i4") for x in rows["x"].to_pylist()], [np.zeros(0)] * len(rows), rows["y"].to_pylist(), rows["times"].to_pylist()))

    def release(self) -> None:
        release(self.frame)


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _margin(rows: Rows, where: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores by the weights of the features that have a place; the last weight is the bias."""
    at = where[rows.feature]
    return weights[-1] + np.bincount(rows.row[at >= 0], weights[at[at >= 0]], len(rows.y))


def _curve(some: Held | Dealt, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, slopes and curvatures of logistic regression in ``weights``, the last of which is the bias."""
    size = len(weights)

    def work() -> tuple[np.ndarray, Callable[[Rows], None]]:
        total = np.zeros((1, 1 + size + size * size))

        def add(rows: Rows) -> None:
            for a in range(0, len(rows.y), 1024):
                b = min(len(rows.y), a + 1024)
                lo, hi = np.searchsorted(rows.row, [a, b])
                x = np.zeros((b - a, size))
                x[rows.row[lo:hi] - a, rows.feature[lo:hi]] = 1
                x[:, -1] = 1
                margin, y, times = x @ weights, rows.y[a:b], rows.times[a:b]
                p = _chance(margin)
                total[0, 0] += times @ (np.logaddexp(0, margin) - y * margin)
                total[0, 1 : 1 + size] += x.T @ (times * (p - y))
                total[0, 1 + size :] += ((x * (times * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x).ravel()

        return total, add

    total = some.sums(work, 1 + size + size * size)[0]
    return float(total[0]), total[1 : 1 + size], total[1 + size :].reshape(size, size)


def _shrunk(weights: np.ndarray, slope: np.ndarray, curve: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The least of the quadratic around ``weights`` plus the L1 penalty, one weight after the other."""
    w, slope = weights.copy(), slope.copy()
    steep = np.maximum(np.diag(curve), 1e-9)
    for _ in range(200):
        most = 0.0
        for k in range(len(w)):
            aim = w[k] - slope[k] / steep[k]
            move = math.copysign(max(0.0, abs(aim) - penalty[k] / steep[k]), aim) - w[k]
            if move:
                w[k] += move
                slope += move * curve[:, k]
                most = max(most, abs(move))
        if most < 1e-6:
            break
    return w


def _lasso(data: Held | Dealt, names: np.ndarray, base: float, penalty: np.ndarray, rounds: int = 12, grow: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression with an L1 penalty (of each feature) by a growing working set: places in ``names``, weights and bias."""
    active, w = np.zeros(0, dtype=np.int64), np.array([math.log(base / (1 - base))])
    for _ in range(rounds):
        features = names[active]

        def work(features: np.ndarray = features, w: np.ndarray = w) -> tuple[np.ndarray, Callable[[Rows], None]]:
            where, places, total = _places(features), _places(names), np.zeros((1, len(names) + 1))

            def add(rows: Rows) -> None:
                off = rows.times * (_chance(_margin(rows, where, w)) - rows.y)
                total[0] += np.bincount(places[rows.feature] + 1, off[rows.row], len(names) + 1)

            return total, add

        bound = np.append(np.inf, penalty)
        bound[1 + active] = np.inf

        def most(offset: int, total: np.ndarray, bound: np.ndarray = bound) -> np.ndarray:
            excess = np.abs(total[0]) - bound[offset : offset + total.shape[1]]
            cells = np.flatnonzero(excess > 0)
            cells = cells[np.argsort(-np.round(excess[cells], 3), kind="stable")[:grow]]
            return _labelled(offset + cells, 1000 * excess[cells])

        fresh, excess = _unlabelled(data.sums(work, len(names) + 1, most))
        if not len(fresh):
            break
        fresh = fresh[np.argsort(-excess, kind="stable")[:grow]] - 1  # equal columns in order, however sums were rounded
        active, w = np.concatenate([active, fresh]), np.concatenate([w[:-1], np.zeros(len(fresh)), w[-1:]])
        some, cost = data.only(names[active]), np.append(penalty[active], 0)
        loss, slopes, curve = _curve(some, w)
        for _ in range(30):
            value, move = loss + cost @ np.abs(w), _shrunk(w, slopes, curve, cost) - w
            for _ in range(10):  # shorter steps until the loss falls
                loss, slopes, curve = _curve(some, w + move)
                if loss + cost @ np.abs(w + move) <= value + 1e-9 * abs(value):
                    break
                move = move / 2
            w = w + move
            if np.abs(move).max() < 1e-4:
                break
        some.release()
        kept = w[:-1] != 0
        active, w = active[kept], np.append(w[:-1][kept], w[-1])
    return active, w


def _refit(some: Held | Dealt, w: np.ndarray) -> np.ndarray:
    """Newton steps without the L1 penalty, whose shrinkage would look like evidence of pairs."""
    ridge = np.append(np.full(len(w) - 1, RIDGE), 1e-6)
    for _ in range(15):
        _, slope, curve = _curve(some, w)
        step = np.linalg.solve(curve + np.diag(ridge), -slope - ridge * w)
        w = w + step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def paired_terms(data: Held | Dealt, names: np.ndarray, features: np.ndarray, weights: np.ndarray, least: float = PAIR_EVIDENCE, least_z: float = PAIR_Z) -> np.ndarray:
    """Stems of the pairs whose documents the residuals of ``weights`` favour or disfavour clearly.

    A pair counts when the residuals of the documents that hold both sum to ``least`` or more
    and to ``least_z`` deviations of their sum. A stem whose own documents have less in all
    has no such pair; the sums of all other pairs are made ``PAIR_CELLS`` at a time.
    """

    def single() -> tuple[np.ndarray, Callable[[Rows], None]]:
        where, places, total = _places(features), _places(names), np.zeros((3, len(names) + 1))

        def add(rows: Rows) -> None:
            left = rows.y - _chance(_margin(rows, where, weights))
            at = places[rows.stem] + 1
            for k, each in enumerate((np.maximum(left, 0), np.maximum(-left, 0), np.ones(len(left)))):
                total[k] += np.bincount(at, (rows.times * each)[rows.stem_row], len(names) + 1)

        return total, add

    def enough(offset: int, total: np.ndarray) -> np.ndarray:
        for_, against, docs = total
        cells = offset + np.flatnonzero((np.maximum(for_, against) >= least * (1 - 1e-6)) & (docs >= least_z * least_z))
        return cells[cells > 0]

    able = names[np.sort(data.sums(single, len(names) + 1, enough)) - 1]
    found, first = np.zeros(len(able), dtype=bool), 0
    while first < len(able) - 1:
        wide = len(able) - first
        end = min(len(able), first + max(1, PAIR_CELLS // wide))

        def pairs(first: int = first, end: int = end, wide: int = wide) -> tuple[np.ndarray, Callable[[Rows], None]]:
            where, places, total = _places(features), _places(able), np.zeros((2, (end - first) * wide))

            def add(rows: Rows) -> None:
                left = rows.y - _chance(_margin(rows, where, weights))
                at = places[rows.stem] - first
                at, row = at[at >= 0], rows.stem_row[at >= 0]
                order = np.lexsort((at, row))
                at, row = at[order], row[order]
                for d in range(1, len(at)):
                    near = np.flatnonzero(row[d:] == row[:-d])
                    if not len(near):
                        break
                    near = near[at[near] < end - first]
                    cell, each = at[near] * wide + at[near + d], left[row[near]]
                    np.add.at(total[0], cell, rows.times[row[near]] * each)
                    np.add.at(total[1], cell, rows.times[row[near]] * each**2)

            return total, add

        def clear(offset: int, total: np.ndarray, wide: int = wide) -> np.ndarray:
            cells = offset + np.flatnonzero((np.abs(total[0]) >= least) & (np.abs(total[0]) >= least_z * np.sqrt(total[1])))
            return np.unique(np.concatenate([cells // wide, cells % wide])).astype(np.int64)

        found[first + data.sums(pairs, (end - first) * wide, clear)] = True
        first = end
    return able[found]


def _fit(data: Held | Dealt, seed: int) -> FactorizationMachine:
    def count() -> tuple[np.ndarray, Callable[[Rows], None]]:
        total = np.zeros((1, BUCKETS + 2))

        def add(rows: Rows) -> None:
            total[0, :BUCKETS] += np.bincount(rows.feature, rows.times[rows.row], BUCKETS)
            total[0, BUCKETS:] += rows.times.sum(), rows.times @ rows.y

        return total, add

    def held(offset: int, total: np.ndarray) -> np.ndarray:
        cells = np.flatnonzero((total[0] >= MIN_DOCS) | (offset + np.arange(total.shape[1]) >= BUCKETS))
        return _labelled(offset + cells, total[0, cells])

    cells, counts = _unlabelled(data.sums(count, BUCKETS + 2, held))
    docs, toxic = (float(counts[cells == k].sum()) for k in (BUCKETS, BUCKETS + 1))
    names, counts = cells[cells < BUCKETS], counts[cells < BUCKETS]
    base = float(np.clip(toxic / docs if docs else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(base / (1 - base)))
    if not len(names) or toxic in (0, docs):
        return FactorizationMachine(bias, {}, np.zeros(0), np.zeros((0, FACTORS)))
    active, weights = _lasso(data, names, float(toxic / docs), np.maximum(EVIDENCE, CHANCE * np.sqrt(counts * base * (1 - base))))
    some = data.only(names[active])
    weights = _refit(some, weights)
    some.release()
    paired = np.searchsorted(names, paired_terms(data, names, names[active], weights))
    chosen = np.union1d(active, paired)
    bias = float(weights[-1])
    if not len(chosen):
        return FactorizationMachine(bias, {}, np.zeros(0), np.zeros((0, FACTORS)))
    some, size = data.only(names[chosen]), len(chosen)
    w = np.zeros(size)
    w[np.searchsorted(chosen, active)] = weights[:-1]
    v = np.random.default_rng(seed).normal(0, 0.05, (size, FACTORS))
    m, s = np.zeros((size, FACTORS + 1)), np.zeros((size, FACTORS + 1))
    mb = sb = 0.0
    for step in range(1, STEPS + 1):

        def work(w: np.ndarray = w, v: np.ndarray = v, bias: float = bias) -> tuple[np.ndarray, Callable[[Rows], None]]:
            out = np.zeros((1, 1 + size * (FACTORS + 1)))

            def add(rows: Rows) -> None:
                flat, row, n = rows.feature, rows.row, len(rows.y)
                vf = v[flat]
                total = np.stack([np.bincount(row, vf[:, f], n) for f in range(FACTORS)], axis=1)
                margin = bias + np.bincount(row, w[flat], n) + 0.5 * ((total**2).sum(axis=1) - np.bincount(row, (vf**2).sum(axis=1), n))
                off = rows.times * (_chance(margin) - rows.y)
                each = off[row][:, None] * (total[row] - vf)
                slopes = np.stack([np.bincount(flat, off[row], size), *[np.bincount(flat, each[:, f], size) for f in range(FACTORS)]], axis=1)
                out[0] += np.append(off.sum(), slopes)

            return out, add

        got = some.sums(work, 1 + size * (FACTORS + 1))[0]
        off, grad = float(got[0]), got[1:].reshape(size, FACTORS + 1)
        grad[:, 0] += RIDGE * w
        grad[:, 1:] += 1.0 * v
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        mb, sb = 0.9 * mb + 0.1 * off, 0.99 * sb + 0.01 * off**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        w, v = w - move[:, 0], v - move[:, 1:]
        bias -= 0.05 * (mb / (1 - 0.9**step)) / (math.sqrt(sb / (1 - 0.99**step)) + 1e-6)
    some.release()
    v[np.linalg.norm(v, axis=1) < 0.1] = 0  # what is left of the random start
    keep = np.flatnonzero((np.abs(w) > 1e-4) | (v != 0).any(axis=1))
    return FactorizationMachine(float(bias), {int(names[chosen[k]]): i for i, k in enumerate(keep)}, w[keep], v[keep])


def fit_machine(rows: list[np.ndarray], y: np.ndarray, stems: list[np.ndarray] | None = None, seed: int = 7) -> FactorizationMachine:
    """Fit on documents given as arrays of distinct feature numbers, and of those that are stems.

    An L1 fit of the linear part, whose penalty is the evidence of ``EVIDENCE`` documents or
    ``CHANCE`` deviations of a term without meaning, finds the terms that matter alone, ``paired_terms`` those that matter together. All their
    weights and vectors are then fitted together.
    """
    return _fit(Held(_rows(rows, rows if stems is None else stems, y, np.ones(len(y)))), seed)


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", seed: int = 7) -> FactorizationMachine:
    """``fit_machine`` on every labelled document that is not held out, wherever its features are."""
    bound_batches(docs.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda found: np.array(sorted(found), dtype="<i4").tobytes()
        for batch in batches:
            words = [text_words(t or "") for t in batch.column(0).to_pylist()]
            x = [pack({f for w in ws for f in word_features(w)}) for ws in words]
            stems = [pack({stem_feature(w) for w in ws}) for ws in words]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(stems, pa.binary()), batch.column(1), pa.array(np.ones(len(x)), pa.int64())], names=["x", "stems", "y", "times"])

    made = training_rows(docs, labels, target, None).select("text", "y").mapInArrow(features, "x binary, stems binary, y int, times long")
    data = Dealt(materialize(made, "toxic-features"))
    machine = _fit(data, seed)
    data.release()
    return machine


def score(docs: DataFrame, machine: FactorizationMachine, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, score)`` for every row's whole text; null and empty texts get the base score."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine.parts())  # bounded by BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = FactorizationMachine(*shared.value)
        for batch in batches:
            out = pa.array([model.probability(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["doc_id", "score"])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    Other columns of either table are ignored; with no usable labels every score is 0.5.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``THRESHOLD``, with all their columns.

    The decision is made row by row, so null and repeated ids need no special care.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels).parts())
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = FactorizationMachine(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([model.probability(t) < THRESHOLD for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
