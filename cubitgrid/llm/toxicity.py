"""Toxicity by a support vector machine on a gapped subsequence string kernel with Nyström landmarks.

A word's features are its normalised subsequence kernels to a few learned landmark words, so that endings,
inserted characters and letters spaced out still resemble an insult. A sentence adds up its words; the machine
is trained on the sentences of labelled documents under their document's label. A document is scored by how
densely, how strongly and how variedly its sentences lie on the toxic side.
"""

from __future__ import annotations

import re
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubitgrid.llm.common import held, held_out, labelled, map_batches, texts
from cubitgrid.plans.tables import Tables

MAX_TRAINING_ROWS = 4_000
LANDMARKS = 64
ORDER, DECAY = 3, 0.7
WINDOW = 24
#: Kernels below this are the resemblance of any two words and count as none.
FLOOR = 0.5
#: Subsequences that are looked up at a time.
HELD_SUBSEQUENCES = 400_000
SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str) -> list[str]:
    """Case-folded words; three or more single characters in a row are one word that was spaced out."""
    words = text.casefold().split()
    single = [i for i, w in enumerate(words) if len(w) == 1 and w.isalnum() or len(w) == 2 and w[0].isalnum() and not w[1].isalnum()]
    if len(single) > 2:
        out, last, run = [], 0, []
        for i in [*single, -1]:
            if run and i != run[-1] + 1:
                if len(run) > 2:
                    out += [*words[last : run[0]], "".join(words[run[0] : run[-1] + 1])]
                    last = run[-1] + 1
                run = []
            run.append(i)
        words = out + words[last:]
    return words


def bare(word: str) -> str:
    return word if word.isalnum() else "".join([c for c in word if c.isalnum()])


#: Stands before each word, so that where a word begins counts as a letter does.
START = "^"


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, a row each, padded by 0, and the lengths."""
    n = np.fromiter(map(len, words), "int64", len(words))
    out = np.zeros((len(words), max(int(n.max(initial=0)), 1)), "int32")
    flat = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<i4")
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out, n


def enumerated(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words of one length, a row each: every subsequence of ORDER letters as one number, and what each weighs, by the
    letters that it spans. Code points have 21 bits, so different subsequences have different numbers."""
    places = np.array(list(combinations(range(c.shape[1]), ORDER)), "int64").reshape(-1, ORDER)
    keys = np.zeros((len(c), len(places)), "int64")
    for k in range(ORDER):
        keys = (keys << 21) | c[:, places[:, k]]
    return keys, DECAY ** (places[:, -1] - places[:, 0] + 1)


def own_kernels(keys: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each word's kernel with itself: squares of what its equal subsequences weigh together."""
    order = np.argsort(keys, axis=1, kind="stable")
    sorted_keys, w = np.take_along_axis(keys, order, 1), weight[order]
    sums = np.zeros(len(keys))
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = sorted_keys[:, 1:] != sorted_keys[:, :-1]
    starts = np.flatnonzero(fresh.ravel())
    if len(starts):
        squares = np.add.reduceat(w.ravel(), starts) ** 2
        np.add.at(sums, starts // keys.shape[1], squares)
    return sums


class Landmarks:
    """Landmark words and the kernels of other words against them.

    A kernel is a product of sparse vectors, one number for each subsequence. Those of the landmarks are a table, in
    which another word's subsequences are looked up; so every kernel is exact, and none is left out.
    """

    def __init__(self, words: list[str], floor: float = FLOOR) -> None:
        self.words, self.floor = words, floor
        found: dict[int, np.ndarray] = {}
        for k, w in enumerate(words):
            c, _ = codes([START + w])
            keys, weight = enumerated(c)
            for key, x in zip(keys[0].tolist(), weight.tolist(), strict=True):
                found.setdefault(key, np.zeros(len(words)))[k] += x
        self.keys = np.array(sorted(found), "int64")
        table = np.array([found[k] for k in self.keys.tolist()]).reshape(-1, len(words))
        self.known = np.zeros(1 << 16, bool)
        self.known[self._slot(self.keys)] = True
        gram = table.T @ table
        table = table / np.sqrt(np.diag(gram))
        # of each subsequence the landmarks that have it and their shares, one after another
        key, self.mark = np.nonzero(table)
        self.share, self.ends = table[key, self.mark], np.r_[0, np.cumsum(np.bincount(key, minlength=len(table)))]
        self.most = table.max(1, initial=0)
        value, vector = np.linalg.eigh(table.T @ table)
        self.whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)

    def likeness(self, c: np.ndarray) -> np.ndarray:
        """Normalised kernels (words, landmarks) of words of one length; those that can't reach the floor are 0."""
        out = np.zeros((len(c), len(self.words)))
        if c.shape[1] < ORDER or not len(self.keys):
            return out
        keys, weight = enumerated(c)
        row, col = np.divmod(np.flatnonzero(self.known[self._slot(keys.ravel())]), keys.shape[1])
        at = np.minimum(np.searchsorted(self.keys, keys[row, col]), len(self.keys) - 1)
        same = self.keys[at] == keys[row, col]
        row, col, at = row[same], col[same], at[same]
        if not len(row):
            return out
        # a word's own kernel is at least the sum of its squared weights, and no landmark takes more of a subsequence than the
        # one that takes most of it: words that stay below the floor even so need no kernels
        least = self.floor * np.sqrt((weight**2).sum()) * (1 - 1e-9)
        hopeful = np.bincount(row, weight[col] * self.most[at], len(c)) > least
        some = hopeful[row]
        row, col, at = row[some], col[some], at[some]
        n = self.ends[at + 1] - self.ends[at]
        each = np.repeat(np.arange(len(at)), n)
        place = np.repeat(self.ends[at], n) + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        share = weight[col][each] * self.share[place]
        out = np.bincount(row[each] * len(self.words) + self.mark[place], share, out.size).reshape(out.shape)
        near = np.flatnonzero(out.max(1) > least)
        exact = out[near] / np.sqrt(own_kernels(keys[near], weight))[:, None]
        out[:] = 0
        out[near] = exact
        return out

    def features(self, words: list[str]) -> list[np.ndarray | None]:
        """For each word the kernels to the landmarks above the floor, rescaled; None if there is none.

        A word of over WINDOW letters counts as the largest of its overlapping windows.
        """
        parts: dict[int, tuple[list[str], list[int]]] = {}

        def add(part: str, k: int) -> None:
            some, of = parts.setdefault(len(part), ([], []))
            some.append(part)
            of.append(k)

        for k, w in enumerate(words):
            b = bare(w)
            if 3 <= len(b) <= WINDOW:
                add(START + b, k)
            elif len(b) > WINDOW:
                for at in range(0, len(b) - WINDOW // 2, WINDOW // 2):
                    add(START * (at == 0) + b[at : at + WINDOW], k)
        out: list[np.ndarray | None] = [None] * len(words)
        for length, (some, of) in parts.items():
            step = max(1, HELD_SUBSEQUENCES // max(1, comb(length, ORDER)))
            for at in range(0, len(some), step):
                s = np.maximum(0, (self.likeness(codes(some[at : at + step])[0]) - self.floor) / (1 - self.floor)).astype("float32")
                for r in np.flatnonzero(s.any(1)):
                    k = of[at + r]
                    out[k] = s[r] if out[k] is None else np.maximum(out[k], s[r])
        return out


class Values(dict):
    """The machine's value of each word, or None for 0; those not asked for since the last turn are forgotten."""

    def __init__(self, marks: Landmarks, weights: np.ndarray, most: int = 150_000) -> None:
        self.marks, self.weights, self.most, self.old = marks, weights, most, {}

    def learn(self, words: set[str]) -> None:
        new = words - self.keys()
        if len(self) + len(new) > self.most:
            self.old = dict(self)
            self.clear()
            new = words
        unknown = []
        for w in new:
            if w in self.old:
                self[w] = self.old[w]
            else:
                unknown.append(w)
        for at in range(0, len(unknown), 32_768):
            part = unknown[at : at + 32_768]
            self.update((w, None if f is None else float(f @ self.weights)) for w, f in zip(part, self.marks.features(part), strict=True))


def sentences(text: str) -> list[list[str]]:
    return [words_of(s) for s in SENTENCE.split(text)]


def pooled(n_words: int, doc: list[list[str]], values: dict) -> list[float]:
    """A document's features: density, strength and variety of what lies on the toxic side.

    Words that resemble no landmark have no value, and may be missing from its sentences.
    """
    n = n_words + 10
    toxic, most, seen = 0.0, 0.0, {}
    for words in doc:
        if hit := [(w, v) for w in words if (v := values[w]) is not None]:
            total = sum(v for _, v in hit)
            toxic += max(0.0, total)
            most = max(most, total)
            seen.update(hit)
    kinds = sum(v for v in seen.values() if v > 0)
    return [np.log(1e-3 + toxic / n), np.log(1e-3 + kinds / n), np.log1p(most), np.log1p(kinds), np.log(n)]


class Machine:
    """A linear machine over whitened sentence features, and a logistic curve over pooled sentence values.

    docs: of each training document its number of words and, sentence by sentence, those that resemble a landmark.
    """

    def __init__(self, marks: Landmarks | None, docs: list[tuple[int, list[list[str]]]], y: np.ndarray) -> None:
        self.constant = None
        if len(y) < 4 or y.min() == y.max():
            self.constant = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
            return
        self.marks = marks
        words = sorted({w for _, d in docs for s in d for w in s})
        known = dict(zip(words, self.marks.features(words), strict=True))
        rows, of = [], []
        for k, (_, d) in enumerate(docs):
            for s in d:
                if hit := [f for w in s if (f := known[w]) is not None]:
                    rows.append(np.sum(hit, 0))
                    of.append(k)
        x = np.reshape(rows, (-1, len(self.marks.words))).astype("float64") @ self.marks.whiten
        each = np.bincount(of, minlength=len(y))[of] if of else np.zeros(0)  # a document's sentences share its weight
        sign, n = 2 * y[of] - 1 if of else np.zeros(0), [max(1, (y == k).sum()) for k in (0, 1)]
        weight = 100 * np.where(sign > 0, 1 / n[1], 1 / n[0]) / np.sqrt(np.maximum(each, 1))
        w = squared_hinge(np.r_[np.c_[x, np.ones(len(x))], np.eye(1, x.shape[1] + 1, x.shape[1])], np.r_[sign, -1], np.r_[weight, 100.0])
        self.weights = self.marks.whiten @ w[:-1]
        values = {k: None if f is None else float(f @ self.weights) for k, f in known.items()}
        x = np.array([pooled(n, d, values) for n, d in docs])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.curve = logistic(np.c_[(x - self.mean) / self.scale, np.ones(len(x))], y)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.curve, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 100) -> np.ndarray:
    """Logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w = w - step * min(1.0, 2 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def squared_hinge(x: np.ndarray, sign: np.ndarray, weight: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Primal L2 machine with weighted squared hinge loss, by Newton steps on the support vectors."""
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    loss = lambda w: w @ ridge @ w / 2 + (weight * np.maximum(0, 1 - sign * (x @ w)) ** 2).sum()
    for _ in range(rounds):
        gap = 1 - sign * (x @ w)
        on = gap > 0
        grad = ridge @ w - 2 * (x[on] * (weight * sign * gap)[on, None]).sum(0)
        step = np.linalg.solve(ridge + 2 * (x[on] * weight[on, None]).T @ x[on], grad)
        rate = 1.0
        while loss(w - rate * step) > loss(w) and rate > 1e-6:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    return w


def choose(words: DataFrame, n: dict[int, int], most: int) -> list[str]:
    """Landmarks: the words that toxic training documents hold far more often than clean ones.

    words: (word, label), a row for each distinct word of a document; n: documents of each label. They are counted
    where they are; at most `most` words reach the driver.
    """
    each = words.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("c1"), F.count_if(F.col("label") == 0).alias("c0"))
    each = each.withColumns({"t": F.col("c1") / max(1, n.get(1, 0)), "c": (F.col("c0") + 0.5) / max(1, n.get(0, 0)), "n": F.char_length("word")})
    good = each.where(F.col("n").between(3, WINDOW // 2) & (F.col("c1") >= 2) & (F.col("t") > 3 * F.col("c"))).orderBy(F.desc(F.col("t") * F.log(F.col("t") / F.col("c"))), "word").limit(most)
    often = each.where("n >= 3 and c1 > 0").orderBy(F.desc("c1"), "word").limit(most)
    return [r.word for r in good.select("word").collect()] or [r.word for r in often.select("word").collect()] or ["landmark"]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, landmarks: int = LANDMARKS, floor: float = FLOOR) -> Machine:
    """From at most max_rows labelled rows outside the held-out fold, half of either label where there are so many.

    Their texts stay in the tasks: the driver gets the landmarks and, of each text, its words that resemble one.
    """
    tables = Tables(docs.sparkSession, "toxicity")
    half = [labelled(docs, labels.where(F.col("toxic") == k), "toxic", max_rows // 2) for k in (0, 1)]
    rows = tables.cut(half[0].unionByName(half[1]).select("text", "label"))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if sum(n.values()) < 4 or len(n) < 2:
        return Machine(None, [], np.repeat(list(n), list(n.values())).astype("float64"))

    def distinct(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [{b for s in sentences(t) for w in s if 3 <= len(b := bare(w)) <= WINDOW} for t in texts(batch.column("text"))]
        return pa.record_batch([pa.array([w for h in held for w in h], pa.string()), pa.array(np.repeat(batch.column("label").to_numpy(), [len(h) for h in held]), pa.int32())], names=["word", "label"])

    marks = Landmarks(choose(map_batches(rows, distinct, "word string, label int"), n, landmarks), floor)

    def resembling(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs = [sentences(t) for t in texts(batch.column("text"))]
        words = sorted({w for d in docs for s in d for w in s})
        known = {w for w, f in zip(words, marks.features(words), strict=True) if f is not None}
        near = [[h for s in d if (h := [w for w in s if w in known])] for d in docs]
        return pa.record_batch([batch.column("label"), pa.array([sum(map(len, d)) for d in docs], pa.int64()), pa.array(near, pa.list_(pa.list_(pa.string())))], names=["label", "n", "near"])

    got = map_batches(rows, resembling, "label int, n bigint, near array<array<string>>").toArrow()
    order = sorted(zip(got["n"].to_pylist(), got["near"].to_pylist(), got["label"].to_pylist(), strict=True))
    tables.drop(rows)
    return Machine(marks, [(k, d) for k, d, _ in order], np.array([label for _, _, label in order], "float64"))


def scores(batch: list[str], model: Machine) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(batch), model.constant)
    values = held(model.weights.tobytes(), lambda: Values(model.marks, model.weights))
    docs = [sentences(t) for t in batch]
    values.learn({w for d in docs for s in d for w in s})
    return model.score(np.array([pooled(sum(map(len, d)), d, values) for d in docs])) if docs else np.zeros(0)


def score(docs: DataFrame, model: Machine, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, null and empty texts, null and repeated ids included."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = scores(texts(batch.column("text")), model)
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype("int32"))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return map_batches(rows, run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under the threshold, with all their columns; all of them where the model had no
    labels of both kinds to learn from."""
    if model.constant is not None:
        return docs

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(scores(texts(batch.column("text")), model) < threshold))

    return map_batches(docs, run, docs.schema)
