"""Quality scores by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubitgrid.llm.common import held_out, labelled, map_batches, texts

MAX_TRAINING_ROWS = 20_000
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, BANG, BAR, SYMBOL, OTHER = range(10)
FAR = 0x250


def _classes() -> np.ndarray:
    out = np.full(FAR + 1, OTHER, "uint8")
    for i in range(FAR):
        c = chr(i)
        out[i] = BANG if c == "!" else BAR if c == "|" else STOP if c in ".,;:?" else LINE if c == "\n" else SPACE if c.isspace() else UPPER if c.isupper() else LOWER if c.isalpha() else DIGIT if c.isdigit() else SYMBOL
    return out


CLASSES = _classes()


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text: logs of counts, log odds of smoothed shares."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    counts = np.bincount(CLASSES[np.minimum(points, FAR)], minlength=10)
    words, lines = text.split(), text.split("\n")
    n, n_words = len(text), len(words)
    lengths = np.fromiter(map(len, words), "int64", n_words) if n_words else np.zeros(1)
    twice = sum(map(eq, words, words[1:]))
    odds = lambda part, whole, by=0.5: float(np.log((part + by) / (whole - part + by)))
    return [
        np.log1p(n),
        np.log1p(n_words),
        *(odds(counts[k], n) for k in (UPPER, DIGIT, LINE, STOP, BANG, BAR, SYMBOL, OTHER)),
        odds(len(set(words)), n_words),
        odds(twice, n_words),
        odds(len(set(lines)), len(lines)),
        odds(int((lengths <= 3).sum()) if n_words else 0, n_words),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        np.log1p(n_words / (1 + counts[STOP])),
        np.log1p(n / len(lines)),
    ]


N_STATISTICS = len(statistics(""))


class Discriminant:
    """Two Gaussian classes with shrunk covariances; their Cholesky factors are kept for scoring."""

    def __init__(self, x: np.ndarray, y: np.ndarray, to_pooled: float = 0.3, to_diagonal: float = 0.1) -> None:
        self.constant = None
        if len(x) < 4 or y.min() == y.max():  # nothing to tell apart: the smoothed share of label 1
            self.constant = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self._scaled(x)
        own = [np.cov(z[y == k].T, bias=True) if (y == k).sum() > 1 else np.eye(z.shape[1]) for k in (0, 1)]
        pooled = sum(c * (y == k).mean() for k, c in enumerate(own))
        self.means, self.factors, self.logs = [], [], []
        for k, c in enumerate(own):
            c = (1 - to_pooled) * c + to_pooled * pooled
            c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
            factor = np.linalg.cholesky(c)
            self.means.append(z[y == k].mean(0))
            self.factors.append(np.linalg.inv(factor))
            self.logs.append(2 * np.log(np.diag(factor)).sum() - 2 * np.log((y == k).mean()))
        self.slope, self.shift = platt(self.difference(x), y)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with priors, halved and squashed to a bounded range."""
        z = self._scaled(x)
        d = [((z - m) @ f.T) ** 2 for m, f in zip(self.means, self.factors, strict=True)]
        return np.arcsinh(0.5 * (d[0].sum(1) + self.logs[0] - d[1].sum(1) - self.logs[1]))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -30, 30)))


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve over margins, by Newton steps with a slight ridge."""
    a = np.stack([margin, np.ones_like(margin)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (p - y) + 1e-2 * (w - [1, 0]))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Discriminant:
    """From at most max_rows labelled rows outside the held-out fold; only their statistics reach the driver."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [statistics(t) for t in texts(batch.column("text"))]
        return pa.record_batch([pa.array(x, pa.list_(pa.float64())), batch.column("label")], names=["x", "label"])

    rows = map_batches(labelled(docs, labels, "quality", max_rows).select("text", "label"), run, "x array<double>, label int").toArrow()
    x = np.array(rows["x"].to_pylist(), "float64").reshape(-1, N_STATISTICS)
    y = np.array(rows["label"].to_pylist(), "float64")
    order = np.lexsort([*x.T, y])  # the same sums whatever order rows came in
    return Discriminant(x[order], y[order])


def score(docs: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, null and empty texts, null and repeated ids included."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(np.array([statistics(t) for t in texts(batch.column("text"))]).reshape(-1, N_STATISTICS))
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype("int32"))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return map_batches(rows, run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(np.array([statistics(t) for t in texts(batch.column("text"))]).reshape(-1, N_STATISTICS))
        return batch.filter(pa.array(s >= threshold))

    return map_batches(docs, run, docs.schema)
