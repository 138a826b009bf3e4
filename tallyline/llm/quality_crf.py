"""Quality classifier: a linear-chain CRF labels lines good or bad; length-weighted marginals make the document's quality."""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, each_batch, in_fold, labelled, labels, take

FOLDS, HELD_OUT = 3, 1
#: Bounds of what the model is fitted on: labelled documents of each class, the first by a hash of the id, of those with texts
#: of 1 to MAX_CHARS characters and up to MAX_LINES lines.
EXAMPLES = 1500
MAX_CHARS, MAX_LINES = 20_000, 400
ITERATIONS = 150
LAMBDA = 1e-3

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_ODD = b"#*$%&|<>{}[]\\^~=_@"
_MARKS = b"!?"
_SPACE = b" \t\x0b\x0c\r"
N = 14


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(a row of N features for each line, the lines' lengths in characters without outer spaces)."""
    rows, lengths = [], []
    seen: set[bytes] = set()
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        line = line.strip(_SPACE)
        size = len(line)
        if not size:
            rows.append((0.0,) * (N - 1) + (1.0,))
            lengths.append(0)
            continue
        ws = line.split()
        n = len(ws)
        share = lambda chars: 1 - len(line.translate(None, chars)) / size  # noqa: B023, E731
        upper, lower = share(_UPPER), share(_LOWER)
        rows.append((
            math.log1p(size), math.log1p(n), len(set(ws)) / n, sum(map(eq, ws, ws[1:])) / n, upper, lower, upper / (upper + lower + 1e-3), share(_DIGITS),
            share(_ODD), share(_MARKS), math.log1p(size / n), float(line in seen), float(line[-1:] in b".!?:;\"'"), 0.0,
        ))
        lengths.append(size)
        seen.add(line)
    return np.array(rows, np.float32), np.array(lengths, np.float64)


def with_neighbours(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it in its document; zeros where there is none."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:] = x[:-1]
    after[:-1] = x[1:]
    before[starts] = 0
    after[starts[1:] - 1] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1), x.dtype)])


class Chains:
    """Forward-backward of many documents at once: step t of all that have a line t."""

    def __init__(self, counts: np.ndarray):
        self.order = np.argsort(-counts, kind="stable")
        self.counts = counts[self.order]
        self.starts = np.concatenate(([0], np.cumsum(counts)))[:-1][self.order]
        self.longest = int(counts.max(initial=0))
        ascending = self.counts[::-1]
        self.active = [len(counts) - int(np.searchsorted(ascending, t, side="right")) for t in range(self.longest)]

    def run(self, emit: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, float, np.ndarray]:
        """(P(good) of each line, log of the partition functions' product, expected transitions, each by its line's weight). emit: score of good, bad has 0."""
        n = len(emit)
        e = np.column_stack([np.zeros(n), emit])
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        for t in range(self.longest):
            at = self.starts[: self.active[t]] + t
            alpha[at] = e[at] if t == 0 else e[at] + np.logaddexp(alpha[at - 1, :1] + trans[0], alpha[at - 1, 1:] + trans[1])
        for t in range(self.longest - 2, -1, -1):
            at = self.starts[: self.active[t + 1]] + t
            nxt = e[at + 1] + beta[at + 1]
            beta[at] = np.logaddexp(nxt[:, :1] + trans[:, 0], nxt[:, 1:] + trans[:, 1])
        both = alpha + beta
        z = np.logaddexp(both[:, 0], both[:, 1])
        moves = np.zeros((2, 2))
        inner = np.ones(n, bool)
        inner[self.starts] = False
        at = np.flatnonzero(inner)
        if len(at):
            pair = alpha[at - 1][:, :, None] + trans + (e[at] + beta[at])[:, None, :]
            moves = (np.exp(pair - z[at][:, None, None]) * (1.0 if weight is None else weight[at][:, None, None])).sum(0)
        return np.exp(both[:, 1] - z), float(z[self.starts].sum()), moves


class Model:
    def __init__(self, docs: list[tuple[int, np.ndarray, np.ndarray]], prior: float, iterations: int = ITERATIONS):
        """docs: (label, features of lines, lengths) of the examples; prior: share of good ones among all labelled rows."""
        self.prior = prior
        self.mean, self.scale = np.zeros(N, np.float32), np.ones(N, np.float32)
        self.weights, self.trans = np.zeros(3 * N + 1), np.zeros((2, 2))
        self.slope, self.shift = 1.0, 0.0
        y = np.array([d[0] for d in docs])
        if len(docs) == 0 or y.min() == y.max():
            self.weights[-1] = 0.0 if len(docs) == 0 else (4.0 if y[0] else -4.0)
            return
        counts = np.array([len(d[1]) for d in docs])
        x = np.vstack([d[1] for d in docs])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = with_neighbours((x - self.mean) / self.scale, np.concatenate(([0], np.cumsum(counts)))[:-1]).astype(np.float64)
        chains = Chains(counts)
        line_y = np.repeat(y, counts).astype(float)
        # each class and each document weighs the same, whatever its lines
        weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) / counts
        line_w = np.repeat(weight, counts)
        inner = np.ones(len(x), bool)
        inner[np.concatenate(([0], np.cumsum(counts)))[:-1]] = False
        seen = np.zeros((2, 2))
        np.add.at(seen, (line_y[inner].astype(int), line_y[inner].astype(int)), line_w[inner])
        theta = np.zeros(len(self.weights) + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, iterations + 1):
            p, _, moves = chains.run(x @ theta[:-4], theta[-4:].reshape(2, 2), line_w)
            g = np.concatenate([x.T @ (line_w * (p - line_y)), (moves - seen).ravel()]) + LAMBDA * np.concatenate([theta[:-4], 20 * theta[-4:]])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.trans = theta[:-4], theta[-4:].reshape(2, 2)
        self.calibrate(self.quality([(d[1], d[2]) for d in docs]), y)

    def calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling with the classes at their true shares."""
        a = np.column_stack([self.logit(raw), np.ones(len(raw))])
        w = np.where(y == 1, self.prior / (y == 1).sum(), (1 - self.prior) / (y == 0).sum()) * len(y)
        beta = np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
            beta = beta - np.linalg.solve((a.T * (w * p * (1 - p))) @ a + 0.5 * np.eye(2), a.T @ (w * (p - y)) + 0.5 * (beta - [1, 0]))
        self.slope, self.shift = map(float, beta)

    @staticmethod
    def logit(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    def marginals(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """P(good) of each line of each document."""
        if not docs:
            return []
        counts = np.array([len(d[0]) for d in docs])
        starts = np.concatenate(([0], np.cumsum(counts)))
        x = with_neighbours((np.vstack([d[0] for d in docs]) - self.mean) / self.scale, starts[:-1])
        p, _, _ = Chains(counts).run(x @ self.weights, self.trans)
        return np.split(p, starts[1:-1])

    def quality(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Mean of the marginals, weighted by the lines' lengths; 0 for a document without a character."""
        return np.array([float(p @ d[1] / d[1].sum()) if d[1].sum() else 0.0 for p, d in zip(self.marginals(docs), docs, strict=True)])

    def score(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logit(self.quality(docs)) + self.shift, -30, 30)))


def fit(docs: DataFrame, marks: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, examples: int = EXAMPLES) -> Model:
    """docs: (doc_id, text); marks: doc_id and a 0/1 label (null: none). Features of at most 2 * examples texts reach the driver."""
    usable = F.length("text").between(1, MAX_CHARS) & (F.size(F.split("text", "\n")) <= MAX_LINES)
    sample, prior = labelled(docs, marks, label, folds, held_out, examples, usable)

    def run(batch: pa.RecordBatch) -> dict:
        rows = [line_features(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "x": [r[0].tobytes() for r in rows], "n": [r[1].tobytes() for r in rows]}

    rows = each_batch(sample.select("doc_id", "label", "text"), run, "doc_id long, label int, x binary, n binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    return Model([(r["label"], np.frombuffer(r["x"], np.float32).reshape(-1, N), np.frombuffer(r["n"])) for r in rows], prior)


def score_quality(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, lines: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, with `lines` also good (P(good) of each line), and the columns in `keep`; a row for each input row.

    Null and empty texts have the quality 0, calibrated like the others. With no labelled rows, or one class only, the
    score follows that class or is that of an even chance. Repeated rows get equal scores; a row without an id is not held out.
    """
    rows = take(docs, id_col, text_col, *[c for c in keep if c not in ("doc_id", "text")])
    passed = rows.select(*keep).schema
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, marks, label, folds, held_out))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"score": [], "good": []}
        features = [line_features(t) for t in batch.column("text").to_pylist()]
        for i in range(0, len(features), 2000):
            part = features[i : i + 2000]
            out["score"] += model.value.score(part).tolist()
            if lines:
                out["good"] += [p.tolist() for p in model.value.marginals(part)]
        return {c: batch.column(c) for c in (*keep, "doc_id")} | out

    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in passed if f.name != "doc_id")
    scored = each_batch(rows, run, "doc_id long, score double" + ", good array<double>" * lines + more)
    return scored.select("doc_id", in_fold("doc_id", folds, held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *["good"] * lines, *[c for c in keep if c != "doc_id"])


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), labels(spark, sf_dir))
