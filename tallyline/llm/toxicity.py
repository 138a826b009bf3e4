"""Toxicity: nearest labelled examples by exact TF-IDF cosine over block-max inverted indexes, with distance-weighted votes."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, each_batch, in_fold, labelled, labels, table, take

FOLDS, HELD_OUT = 5, 0
#: Bounds of what the classifier is fitted on: labelled documents of each class, the first by a hash of the id, with texts of 1 to MAX_CHARS characters.
EXAMPLES = 2000
MAX_CHARS = 50_000
NEIGHBOURS = 15
BLOCK = 32
#: Weight of the share of toxic rows among all labelled ones beside the neighbours' votes.
PRIOR = 0.5
#: Least factor of a term that both classes have equally often.
LEAST = 0.05
#: Terms in more than this share of the examples have their weights in a matrix, others in postings.
OFTEN = 1 / 16

_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> Counter[str]:
    """How often each term stands in a text: words of letters in lower case."""
    return Counter(_WORD.findall(text.lower()))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + lengths[0] - 1, starts[1] .., one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class BlockMaxIndex:
    """Unit vectors by term and block of examples. Postings are cut into cells by term and block, and each cell knows its
    largest weight; the few terms that most examples have are columns of a matrix instead.

    The bound of a block is the largest product of its members over the matrix, plus the query's weights times the cells'
    maxima: no example there can be nearer. Blocks are scored in falling order of that bound until it is below the k-th
    best cosine, so the neighbours are exact.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK, often: float = OFTEN):
        """vectors: (terms, weights) of each example."""
        lead = [int(t[np.lexsort((t, -w))[0]]) if len(t) else -1 for t, w in vectors]
        self.block, self.n = block, len(vectors)
        self.n_blocks = max(1, -(-self.n // block))
        ids = sorted(range(self.n), key=lambda i: (lead[i], i))
        self.ids = np.array(ids + [-1] * (self.n_blocks * block - self.n), np.int64)
        sizes = [len(vectors[i][0]) for i in ids]
        join = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
        term, weight = (join([vectors[i][k] for i in ids], kind) for k, kind in ((0, np.int64), (1, np.float64)))
        place = np.repeat(np.arange(self.n), sizes)
        common = np.flatnonzero(np.bincount(term, minlength=n_terms) > often * self.n)
        self.column = np.full(n_terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        dense = self.column[term] >= 0
        self.matrix = np.zeros((len(common), len(self.ids)))
        self.matrix[self.column[term[dense]], place[dense]] = weight[dense]
        term, place, weight = term[~dense], place[~dense], weight[~dense]
        order = np.argsort(term, kind="stable")  # within a term by place, so by block
        term, self.place, self.weight = term[order], place[order].astype(np.int32), weight[order]
        cell = term * self.n_blocks + self.place // block
        self.starts = np.flatnonzero(np.diff(cell, prepend=-1))
        self.lengths = np.diff(np.append(self.starts, len(cell)))
        self.cell_block = (self.place[self.starts] // block).astype(np.int32)
        self.cell_max = np.maximum.reduceat(self.weight, self.starts) if len(cell) else np.empty(0)
        self.of_term = np.searchsorted(term[self.starts], np.arange(n_terms + 1))

    def products(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the matrix adds to the cosines: a row for each query, a column for each place."""
        q = np.zeros((len(queries), len(self.matrix)))
        for row, (ts, ws) in zip(q, queries, strict=True):
            at = self.column[ts]
            row[at[at >= 0]] = ws[at >= 0]
        return q @ self.matrix

    def nearest(self, query: tuple[np.ndarray, np.ndarray], k: int, but: int = -1, product: np.ndarray | None = None) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest to (terms, weights) with a positive cosine; of equal ones the smaller number first. but: an example to leave out."""
        ts, ws = query
        product = self.products([query])[0] if product is None else product
        rare = self.column[ts] < 0
        ts, ws = ts[rare], ws[rare]
        lengths = self.of_term[ts + 1] - self.of_term[ts]
        cells = _ranges(self.of_term[ts], lengths)
        mine = np.repeat(ws, lengths)
        block = self.cell_block[cells]
        bound = product.reshape(-1, self.block).max(1) + np.bincount(block, self.cell_max[cells] * mine, self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        top: list[tuple[float, int]] = []
        at, step = 0, 4
        while at < len(order):
            some = order[at : at + step]
            least = -top[-1][0] - 1e-12 if len(top) == k else 0.0
            some = some[bound[some] >= least]
            if not len(some):
                break
            wanted = np.zeros(self.n_blocks, bool)
            wanted[some] = True
            hit = wanted[block]
            n = self.lengths[cells[hit]]
            posts = _ranges(self.starts[cells[hit]], n)
            sums = np.bincount(self.place[posts], self.weight[posts] * np.repeat(mine[hit], n), len(self.ids))
            places = (some[:, None] * self.block + np.arange(self.block)).ravel()
            sums = sums[places] + product[places]
            good = (sums > 0) & (sums >= least)
            places, sums = places[good], sums[good]
            if len(sums) > 4 * k:  # all that tie with the k-th stay, and one more for the example to leave out
                good = sums >= np.partition(sums, -k - 1)[-k - 1]
                places, sums = places[good], sums[good]
            top = sorted(top + [(-s, i) for s, i in zip(sums.tolist(), self.ids[places].tolist(), strict=True) if i != but])[:k]
            at += step
            step *= 2
        return [(-s, i) for s, i in top]


class Model:
    """The index over all terms of the examples, the terms' weights and the calibration of votes.

    A term weighs (1 + log of its count) * idf * contrast; the contrast is the square root of its chi-square between the
    classes, so that of the thousands of words that texts share by chance few decide which example is near.
    """

    def __init__(self, rows: Iterable[tuple[int, int, dict[str, int]]], prior: float, k: int = NEIGHBOURS):
        """rows: (doc_id, label, counts of terms) of the examples; read once, and kept as arrays of numbers."""
        self.k, self.prior = k, prior
        self.vocabulary: dict[str, int] = {}
        self.doc_ids, self.labels, kept = [], [], []
        for doc, label, counts in rows:
            self.doc_ids.append(doc)
            self.labels.append(label)
            at = np.fromiter((self.vocabulary.setdefault(t, len(self.vocabulary)) for t in counts), np.int32, len(counts))
            kept.append((at, np.fromiter(counts.values(), np.int32, len(counts))))
        n, n1 = len(kept), sum(self.labels)
        n0 = n - n1
        a, b = np.zeros(len(self.vocabulary)), np.zeros(len(self.vocabulary))
        for label, (at, _) in zip(self.labels, kept, strict=True):
            (a if label else b)[at] += 1
        chi = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum(1.0, (a + b) * (n - a - b) * n1 * n0)
        contrast = np.maximum(LEAST, np.sqrt(chi)) if n1 and n0 else 1.0
        self.weights = (np.log((1 + n) / (1 + a + b)) + 1) * contrast
        vectors = [self.weighed(at, counts) for at, counts in kept]
        self.index = BlockMaxIndex(vectors, len(self.vocabulary))
        # the classes are sampled apart: a vote counts as much as its class has rows among all labelled ones
        self.weight = {1: prior / max(1, n1), 0: (1 - prior) / max(1, n0)}
        self.slope, self.shift = self.calibrate([self.vote(near) for near in self.nearest(vectors, range(n))])

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], but=None, size: int = 64) -> list[list[tuple[float, int]]]:
        """The neighbours of each vector; but: for each the example to leave out."""
        out = []
        for a in range(0, len(vectors), size):
            part = vectors[a : a + size]
            out += [self.index.nearest(v, self.k, -1 if but is None else but[a + j], p) for j, (v, p) in enumerate(zip(part, self.index.products(part), strict=True))]
        return out

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of unit length, by rising term; terms that no example has are left out."""
        at = np.fromiter(map(self.vocabulary.get, counts, repeat(-1)), np.int64, len(counts))
        n = np.fromiter(counts.values(), float, len(counts))
        return self.weighed(at[at >= 0], n[at >= 0])

    def weighed(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vector of terms by number, each n times."""
        order = np.argsort(at)
        ts = at[order].astype(np.int64)
        ws = (1 + np.log(n[order])) * self.weights[ts]
        return ts, ws / math.sqrt(float(ws @ ws)) if len(ws) else ws

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of the toxic votes, each weighted by 1 / (distance + 0.05) and its class; the prior has the weight PRIOR of a neighbour at distance 1."""
        base = (self.weight[1] + self.weight[0]) / 2 * PRIOR
        yes, total = base * self.prior, base
        for cosine, i in near:
            w = self.weight[self.labels[i]] / (math.sqrt(max(0.0, 2 - 2 * cosine)) + 0.05)
            yes += w * self.labels[i]
            total += w
        return yes / total if total else self.prior

    def calibrate(self, raw: list[float]) -> tuple[float, float]:
        """Platt scaling of leave-one-out votes, by Newton steps with the classes at their true shares."""
        x = np.array([self.logit(p) for p in raw])
        y = np.array(self.labels, float)
        if not len(x) or y.min() == y.max():
            return 1.0, 0.0
        w = np.where(y == 1, self.weight[1], self.weight[0])
        w = w / w.sum() * len(w)
        a = np.column_stack([x, np.ones(len(x))])
        beta = np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
            gradient = a.T @ (w * (p - y)) + 0.1 * (beta - [1, 0])
            beta = beta - np.linalg.solve((a.T * (w * p * (1 - p))) @ a + 0.1 * np.eye(2), gradient)
        return float(beta[0]), float(beta[1])

    @staticmethod
    def logit(p: float) -> float:
        p = min(max(p, 1e-4), 1 - 1e-4)
        return math.log(p / (1 - p))

    def score(self, counts: list[dict[str, int]]) -> list[tuple[float, list[int], list[float]]]:
        """(calibrated score, ids of the three nearest examples, their cosines) of each text's terms."""
        out = []
        for near in self.nearest(list(map(self.vector, counts))):
            z = self.slope * self.logit(self.vote(near)) + self.shift
            out.append((1 / (1 + math.exp(-min(max(z, -30), 30))), [self.doc_ids[i] for _, i in near[:3]], [c for c, _ in near[:3]]))
        return out


def fit(docs: DataFrame, marks: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, examples: int = EXAMPLES) -> Model:
    """docs: (doc_id, text); marks: doc_id and a 0/1 label (null: none). Terms of at most 2 * examples texts reach the driver, all of each."""
    sample, prior = labelled(docs, marks, label, folds, held_out, examples, F.length("text").between(1, MAX_CHARS))

    def run(batch: pa.RecordBatch) -> dict:
        counts = [terms(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "terms": [list(c) for c in counts], "counts": [list(c.values()) for c in counts]}

    rows = table(each_batch(sample.select("doc_id", "label", "text"), run, "doc_id long, label int, terms array<string>, counts array<int>"), "examples").orderBy("doc_id")
    return Model(((r["doc_id"], r["label"], dict(zip(r["terms"], r["counts"], strict=True))) for r in rows.toLocalIterator()), prior)


def score_toxicity(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the three nearest examples), similarity (their cosines); a row for each input row.

    Every term of the examples is in the index, so a text that shares any with one of them has neighbours. A text without
    such a term, null and empty ones among them, gets the calibrated prior and no evidence. Repeated rows get equal
    scores; a row without an id is not held out; with no labelled rows all scores are 0.5 or less.
    The model's size is bounded by EXAMPLES and MAX_CHARS; each text is read once, whole.
    """
    rows = take(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, marks, label, folds, held_out))

    def run(batch: pa.RecordBatch) -> dict:
        out = shared.value.score(list(map(terms, batch.column("text").to_pylist())))
        return {"doc_id": batch.column("doc_id"), "score": [x[0] for x in out], "evidence": [x[1] for x in out], "similarity": [x[2] for x in out]}

    scored = each_batch(rows, run, "doc_id long, score double, evidence array<long>, similarity array<double>")
    return scored.select("doc_id", in_fold("doc_id", folds, held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "similarity")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))
