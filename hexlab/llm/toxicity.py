"""Toxicity by a classifier chain of linear models.

The chain predicts its categories one after the other. Each link is a logistic regression with an L1 penalty
over word and letter-run features, and over the probabilities that the earlier links gave. For training, those
probabilities are out of fold: the rows of one fold get them from models that were fitted to the other folds,
so a later link learns from probabilities as noisy as those it will meet. The labels hold two categories, junk
(``quality`` is 0) and ``toxic``; junk comes first.

Features of a document are counted over its distinct words (runs of letters, case folded): the word itself and
its runs of four and five letters with the borders marked. Each fit keeps the ``FEATURES`` that tell its
classes apart best. The models are fitted on the driver to at most ``TRAIN_ROWS`` labelled rows (a bounded sample,
the rows of the smallest hashes of doc_id); scoring covers every whole text.

Defined cases: a null text is empty and has the score of no words; labels that are null are no examples;
with several labels for one doc_id each row is an example; a category without both classes in the sample has
its share of ones as probability everywhere; rows repeat in the result as in the input.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread
from .memo import Memo

TRAIN_ROWS = 4000
FEATURES = 800
FOLDS = 4
#: Name, label column, and the value that stands for the category.
CHAIN = (("junk", "quality", 0), ("toxic", "toxic", 1))
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """The distinct words of a whole text, in no order."""
    return list(set(WORD.findall((text or "").casefold())))


def runs(word: str) -> list[str]:
    """The word and its runs of four and five letters, each once."""
    marked = f"^{word}$"
    return list({marked, *(marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1))})


def features(word: str) -> list[int]:
    return [zlib.crc32(f.encode()) for f in runs(word)]


@dataclass
class Link:
    """One linear model: weights of features, of earlier probabilities, and a bias."""

    weights: dict[int, float] = field(default_factory=dict)
    earlier: list[float] = field(default_factory=list)
    bias: float = 0.0

    def probability(self, total: float, earlier: list[float]) -> float:
        v = self.bias + total + sum(a * b for a, b in zip(self.earlier, earlier, strict=True))
        return float(1 / (1 + np.exp(-np.clip(v, -40, 40))))


@dataclass
class Rows:
    """Features of documents: entries (row, feature number, count), and the hash of each number."""

    row: np.ndarray
    column: np.ndarray
    count: np.ndarray
    hashes: np.ndarray
    n: int

    @classmethod
    def of(cls, texts: list[str]) -> tuple[Rows, set[str]]:
        memo = Memo(lambda w: np.array(features(w), dtype=np.uint32), longest=10**9)
        parts = []
        for t in texts:
            found = words(t)
            parts.append(np.unique(np.concatenate([memo[w] for w in found]), return_counts=True) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64)))
        row = np.repeat(np.arange(len(texts)), [len(f) for f, _ in parts])
        flat = np.concatenate([f for f, _ in parts] or [np.zeros(0, np.uint32)])
        hashes, column = np.unique(flat, return_inverse=True)
        return cls(row, column, np.concatenate([c for _, c in parts] or [np.zeros(0)]), hashes, len(texts)), set(memo)


def fit(rows: Rows, at: np.ndarray, earlier: np.ndarray, y: np.ndarray, penalty: float = 2e-4, steps: int = 150) -> Link:
    """Logistic regression by accelerated proximal steps, on the documents ``at``."""
    y, earlier = y[at], earlier[at]
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Link({}, [0.0] * earlier.shape[1], float(np.clip(np.log((share + 1e-3) / (1 - share + 1e-3)), -7, 7)))
    place = np.full(rows.n, -1)
    place[at] = np.arange(len(at))
    mine = place[rows.row] >= 0
    row, column, count = place[rows.row[mine]], rows.column[mine], rows.count[mine]
    n1 = int(y.sum())
    n0 = len(y) - n1
    one = np.bincount(column, weights=y[row], minlength=len(rows.hashes))
    every = np.bincount(column, minlength=len(rows.hashes))
    p = every / len(y)
    apart = np.where(every >= 3, np.abs(one / n1 - (every - one) / n0) / np.sqrt(p * (1 - p) + 1e-4), -1.0)
    names = np.sort(np.lexsort((rows.hashes, -apart))[:FEATURES])
    names = names[apart[names] >= 0]
    slot = np.full(len(rows.hashes), -1)
    slot[names] = np.arange(len(names))
    x = np.zeros((len(y), len(names) + earlier.shape[1]), dtype=np.float32)
    used = slot[column] >= 0
    x[row[used], slot[column[used]]] = count[used]
    x[:, len(names) :] = earlier
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0).astype(np.float32)
    scale = np.maximum(np.sqrt((x * x).mean(axis=0)), 1e-3)
    x /= scale
    v = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(8):  # the largest curvature, for the step
        v = x.T @ (weight * (x @ v))
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * float(np.linalg.norm(x.T @ (weight * (x @ v)))) + 0.26)
    w, b, w1, b1, t1 = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 1.0
    for _ in range(steps):
        g = weight * (1 / (1 + np.exp(-np.clip(x @ w1.astype(np.float32) + b1, -40, 40))) - y)
        new = w1 - step * (x.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = b1 - step * float(g.sum())
        t2 = (1 + np.sqrt(1 + 4 * t1 * t1)) / 2
        w1, b1 = new + (t1 - 1) / t2 * (new - w), new_b + (t1 - 1) / t2 * (new_b - b)
        w, b, t1 = new, new_b, t2
    w = w / scale
    used = np.flatnonzero(w[: len(names)])
    return Link({int(rows.hashes[names[i]]): float(w[i]) for i in used}, w[len(names) :].tolist(), b)


class Chain:
    def __init__(self, names: list[str], links: list[Link], known: set[str]):
        """``known``: the words that the sample had; the runs with a weight are looked up as text."""
        self.names, self.links = names, links
        self.table: dict[str, tuple[float, ...]] = {}
        weights = [link.weights for link in links]
        for f in {f for w in known for f in runs(w)}:
            if any((h := zlib.crc32(f.encode())) in w for w in weights):
                self.table[f] = tuple(w.get(h, 0.0) for w in weights)

    @classmethod
    def train(cls, texts: list[str], labels: np.ndarray, ids: list[int], names: list[str]) -> Chain:
        """labels: a column for each category, -1 where it is not known."""
        rows, known = Rows.of(texts)
        fold = np.array([zlib.crc32(f"fold {i}".encode()) % FOLDS for i in ids], dtype=int)
        earlier, links = np.zeros((rows.n, 0)), []
        for c in range(len(names)):
            y = labels[:, c]
            links.append(fit(rows, np.flatnonzero(y >= 0), earlier, y))
            if c + 1 < len(names):
                out = np.zeros(rows.n)
                for f in range(FOLDS):
                    other = fit(rows, np.flatnonzero((y >= 0) & (fold != f)), earlier, y)
                    weights = np.array([other.weights.get(h, 0.0) for h in rows.hashes.tolist()])
                    total = np.bincount(rows.row, weights=weights[rows.column] * rows.count, minlength=rows.n)
                    for i in np.flatnonzero(fold == f).tolist():
                        out[i] = other.probability(total[i], earlier[i].tolist())
                earlier = np.column_stack([earlier, out])
        return cls(names, links, known)

    def scorer(self):
        """Probabilities of all categories for a whole text; the weights of a word are kept."""
        table, none = self.table, (0.0,) * len(self.links)

        def weigh(word: str) -> tuple[float, ...]:
            hits = [table[f] for f in runs(word) if f in table]
            return tuple(map(sum, zip(*hits, strict=True))) if hits else none

        memo = Memo(weigh, limit=500_000)

        def score(text: str | None) -> list[float]:
            total = list(map(sum, zip(*map(memo.__getitem__, words(text)), strict=True))) or list(none)
            memo.trim()
            out: list[float] = []
            for link, t in zip(self.links, total, strict=True):
                out.append(link.probability(t, out))
            return out

        return score


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN, rows: int = TRAIN_ROWS) -> Chain:
    marks = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *[F.when(F.col(c).isNull(), -1).otherwise((F.col(c) == v).cast("int")).alias(name) for name, c, v in chain])
    order = (F.xxhash64("doc_id"), "doc_id", *[name for name, _, _ in chain])
    picked = marks.orderBy(*order).limit(rows)  # a bounded table: it may be broadcast
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").collect()
    sample = sorted(sample, key=lambda r: (r["doc_id"], r["text"] or ""))
    names = [name for name, _, _ in chain]
    return Chain.train([r["text"] or "" for r in sample], np.array([[r[n] for n in names] for r in sample], dtype=int).reshape(-1, len(names)), [r["doc_id"] for r in sample], names)


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, and the probability of each category) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # some thousand weights, whatever the data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = shared.value.scorer()
        for x in batches:
            p = np.array([score(t) for t in x["text"]]).reshape(len(x), -1)
            yield pd.DataFrame({"doc_id": x["doc_id"].astype("Int64")} | {n: p[:, i] for i, n in enumerate(shared.value.names)})

    small_batches(docs.sparkSession)
    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInPandas(run, "doc_id long, " + ", ".join(f"{n} double" for n in chain.names))
