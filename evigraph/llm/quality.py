"""Quality: a linear-chain conditional random field over lines.

Each line of a document is good or bad. A line's features are its make-up (shares of
capitals, digits, symbols and white space, separators and exclamation marks per word,
distinct words, word and line length, closing mark) and the same of the lines before and
after; weights on pairs of neighbouring states let lines support each other. A document's
label stands for all its lines in fitting. Forward-backward gives each line's probability of
being good; the mean weighted by line length, put through a fitted logistic curve, is the
document's score. The fit takes at most ``TRAIN_DOCS`` labelled documents, none held out;
scoring covers every line of every text.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.labelled import fit_in_one_task, held_out, training_rows
from evigraph.runtime import bound_batches

TRAIN_DOCS = 8_000
STEPS = 200
THRESHOLD = 0.5
OWN = 12

_CLASS = bytes(
    85 if 65 <= b <= 90 else 76 if 97 <= b <= 122 or b >= 128 else 68 if 48 <= b <= 57 else 87 if b in b" \t\r\x0b\x0c" else 80 if b in b".,;:'\"-?()" else 83
    for b in range(256)
)  # Upper, Lower, Digit, White, Punctuation, Symbol


def line_features(line: bytes) -> tuple[float, ...]:
    """The ``OWN`` features of a UTF-8 line."""
    n = len(line)
    if not n:
        return (0.0,) * (OWN - 1) + (1.0,)
    kinds = line.translate(_CLASS)
    upper, digit, symbol = kinds.count(b"U"), kinds.count(b"D"), kinds.count(b"S")
    words = line.split()
    count = len(words) or 1
    distinct = len(set(words)) / count
    log = math.log1p(count)
    return (
        upper / n,
        digit / n,
        min(symbol / count, 4.0),
        kinds.count(b"P") / n,
        min(line.count(b"!") / count, 3.0),
        min(line.count(b"|") / count, 2.0),
        distinct,
        (1 - distinct) * log,
        log / 4,
        min((n - kinds.count(b"W")) / count, 20.0) / 8,
        1.0 if line.rstrip()[-1:] in (b".", b"?", b"!", b":", b'"') else 0.0,
        0.0,
    )


def document_features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(lines x features, line weights)`` of a text; neighbours' features included."""
    lines = raw.split(b"\n")
    own = np.array([line_features(x) for x in lines])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    edge = np.zeros((len(lines), 2))
    edge[0, 0] = edge[-1, 1] = 1.0
    return np.concatenate([own, before, after, edge], axis=1), np.array([len(x) for x in lines], dtype=float) + 1.0


def _forward_backward(emit: np.ndarray, move: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For padded log-odds ``emit`` (docs x lines): P(good), pair counts (docs x 2 x 2), log Z.

    State 1 is good and scores ``emit``, state 0 scores nothing; ``move`` scores pairs.
    """
    docs, length = emit.shape
    score = np.stack([np.zeros_like(emit), emit], axis=2)
    live = np.arange(length)[None, :] < sizes[:, None]
    alpha, beta = np.zeros((docs, length, 2)), np.zeros((docs, length, 2))
    alpha[:, 0] = score[:, 0]
    for t in range(1, length):
        step = np.logaddexp(alpha[:, t - 1, 0, None] + move[0], alpha[:, t - 1, 1, None] + move[1]) + score[:, t]
        alpha[:, t] = np.where(live[:, t, None], step, alpha[:, t - 1])
    for t in range(length - 2, -1, -1):
        ahead = score[:, t + 1] + beta[:, t + 1]
        step = np.logaddexp(ahead[:, 0, None] + move[:, 0], ahead[:, 1, None] + move[:, 1])
        beta[:, t] = np.where(live[:, t + 1, None], step, 0.0)
    log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    good = np.where(live, np.exp(np.clip(alpha[:, :, 1] + beta[:, :, 1] - log_z[:, None], -700, 0)), 0.0)
    pairs = np.zeros((docs, 2, 2))
    for a in range(2):
        for b in range(2):
            joint = alpha[:, :-1, a] + move[a, b] + score[:, 1:, b] + beta[:, 1:, b] - log_z[:, None]
            pairs[:, a, b] = np.where(live[:, 1:], np.exp(np.clip(joint, -700, 0)), 0.0).sum(axis=1)
    return good, pairs, log_z


def _padded(docs: list[np.ndarray], area: int = 1 << 16) -> Iterator[tuple[list[int], np.ndarray]]:
    """Indices of documents of like length, with their sizes, in blocks of bounded area."""
    order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
    block: list[int] = []
    for i in order:
        if block and (len(block) + 1) * len(docs[i]) > area:
            yield block, np.array([len(docs[k]) for k in block])
            block = []
        block.append(i)
    if block:
        yield block, np.array([len(docs[k]) for k in block])


def _pad(rows: list[np.ndarray], length: int) -> np.ndarray:
    out = np.zeros((len(rows), length))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


class LineField:
    """A fitted field: feature scaling, weights, pair scores and the final curve."""

    def __init__(self, mean, scale, weights, bias, move, curve) -> None:
        self.mean, self.scale, self.weights, self.bias, self.move, self.curve = mean, scale, weights, bias, move, curve

    def emit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def marginals(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """P(good) of each line of each document."""
        emits = [np.clip(self.emit(x), -30, 30) for x in docs]
        out: list[np.ndarray] = [np.zeros(0)] * len(docs)
        for block, sizes in _padded(emits):
            good, _, _ = _forward_backward(_pad([emits[i] for i in block], int(sizes.max())), self.move, sizes)
            for k, i in enumerate(block):
                out[i] = good[k, : sizes[k]]
        return out

    def scores(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        means = np.array([float((g * w).sum() / w.sum()) for g, (_, w) in zip(self.marginals([x for x, _ in docs]), docs, strict=True)])
        return 1 / (1 + np.exp(-(self.curve[0] * means + self.curve[1])))


def fit_field(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> LineField:
    """Maximum penalised likelihood by Adam; then the curve by Newton steps."""
    width = 3 * OWN + 2
    if not docs or len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 0.01), 0.99)
        return LineField(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)), (0.0, math.log(share / (1 - share))))
    flat = np.concatenate([x for x, _ in docs])
    mean, scale = flat.mean(axis=0, dtype=float), flat.std(axis=0, dtype=float) + 1e-3
    del flat
    xs = [(x - mean) / scale for x, _ in docs]
    blocks = [(b, s, np.concatenate([xs[i] for i in b]), np.arange(s.max())[None, :] < s[:, None]) for b, s in _padded(xs)]
    theta = np.zeros(width + 1 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = sum(len(x) for x in xs)
    for step in range(1, STEPS + 1):
        grad = np.zeros_like(theta)
        w, bias, move = theta[:width], theta[width], theta[width + 1 :].reshape(2, 2)
        for block, sizes, rows, live in blocks:
            emit = np.zeros(live.shape)
            emit[live] = rows @ w + bias
            good, pairs, _ = _forward_backward(emit, move, sizes)
            label = y[block]
            off = np.where(live, label[:, None] - good, 0.0)[live]
            grad[:width] += off @ rows
            grad[width] += off.sum()
            seen = np.zeros((2, 2))
            seen[1, 1], seen[0, 0] = ((sizes - 1) * label).sum(), ((sizes - 1) * (1 - label)).sum()
            grad[width + 1 :] += (seen - pairs.sum(axis=0)).ravel()
        grad = grad / total - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field = LineField(mean, scale, theta[:width], float(theta[width]), theta[width + 1 :].reshape(2, 2), (1.0, 0.0))
    means = np.array([float((g * w).sum() / w.sum()) for g, (_, w) in zip(field.marginals([x for x, _ in docs]), docs, strict=True)])
    curve = np.array([4.0, -2.0])
    design = np.stack([means, np.ones_like(means)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ curve, -30, 30)))
        slope = design.T @ (y - p) - 0.05 * curve
        curve = curve + np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2), slope)
    field.curve = (float(max(curve[0], 1e-3)), float(curve[1]))
    return field


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", limit: int = TRAIN_DOCS) -> LineField:
    """Fit in one executor task on every line of at most ``limit`` documents."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [document_features(t or b"") for t in batch.column(0).cast(pa.binary()).to_pylist()]
            x, w = ([f[i].astype("<f4").tobytes() for f in made] for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(w, pa.binary()), *batch.columns[1:]], names=["x", "w", "y", "doc_id"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, y = [], []
        for batch in batches:
            for x, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made.append((np.frombuffer(x, "<f4").reshape(-1, 3 * OWN + 2), np.frombuffer(w, "<f4")))
            y += batch.column(2).to_pylist()
        field = fit_field(made, np.array(y, dtype=float))
        parts = (field.mean, field.scale, field.weights, field.bias, field.move, field.curve)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(parts)], pa.binary())], names=["model"])

    blob = fit_in_one_task(training_rows(docs, labels, target, limit), features, "x binary, w binary", fit)
    return LineField(*pickle.loads(blob)) if blob else fit_field([], np.zeros(0))


def score(docs: DataFrame, field: LineField, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, score, n_lines, bad_lines)`` for every row; null texts are empty."""
    bound_batches(docs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [document_features(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            good = field.marginals([x for x, _ in made])
            means = np.array([float((g * w).sum() / w.sum()) for g, (_, w) in zip(good, made, strict=True)])
            out = 1 / (1 + np.exp(-(field.curve[0] * means + field.curve[1])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.float64()), pa.array([len(g) for g in good], pa.int64()), pa.array([int((g < 0.5).sum()) for g in good], pa.int64())],
                names=["doc_id", "score", "n_lines", "bad_lines"],
            )

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, score double, n_lines long, bad_lines long")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_lines, bad_lines)``, one row per row of ``docs``.

    Other columns of either table are ignored; with labels of one class every score is their
    share, with none 0.5.
    """
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_lines", "bad_lines"
    )
