"""Quality classifier: histogram gradient-boosted trees over document statistics.

The texts are read once: a table of statistics goes to the shared folder, the labelled rows of that table train the
trees, and all its rows are scored. Training uses at most ``MAX_LABELLED`` rows, those with the smallest
hash of doc_id; beyond that bound more labels do not change the model much, and the driver's
memory stays bounded. Statistics are binned by their quantiles; each tree grows level by level from gradient
histograms, with the logistic loss. Finished trees are flattened into arrays
(feature, bin, value), which numpy walks for a whole Arrow batch at once.

Labels, languages, sources and ids are no input of a score. Null and empty texts have zero statistics and a score like
any other. Labelled rows whose label is null are left out; of several labels for a document the mean counts.
Without any label every score is 0.5.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewtrust.llm.common import text_of, workspace

MAX_LABELLED = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.1
SHRINK = 1.0
#: Words of a window whose repetition counts.
WINDOW = 8
MIN_HESSIAN = 2.0

STATISTICS = (
    "log_words", "word_length", "long_words", "unique_words", "top_word", "symbols", "marks", "pipes", "digits", "upper",
    "upper_words", "non_ascii", "log_lines", "line_words", "repeated_lines", "repeated_windows", "commas", "ends",
)
_SYMBOLS, _MARKS = re.compile(r"[#*$%&<>@=+^~_\\/{}\[\]]"), re.compile(r"[!?]")
_DIGITS, _UPPER = re.compile(r"[0-9]"), re.compile(r"[A-ZÀ-ÖØ-Þ]")


def _repeated_windows(words: list[str]) -> float:
    """The part of all eight-word windows, at every offset, that an earlier one equals (by 64-bit hashes)."""
    count = len(words) - WINDOW + 1
    if count < 1:
        return 0.0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(count, np.uint64)
    for k in range(WINDOW):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count]
    return 1.0 - len(np.unique(windows)) / count


def statistics(text: str) -> list[float]:
    """STATISTICS of one whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    letters = sum(map(len, words))
    return [
        float(np.log(n)),
        letters / n,
        sum(len(w) > 12 for w in counts) / len(counts),
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        len(_SYMBOLS.findall(text)) / letters,
        len(_MARKS.findall(text)) / n,
        text.count("|") / n,
        len(_DIGITS.findall(text)) / letters,
        len(_UPPER.findall(text)) / letters,
        sum(c for w, c in counts.items() if w.isupper()) / n,
        1.0 - len(text.encode("utf-8", "replace")) / (2.0 * len(text)),
        float(np.log1p(len(lines))),
        n / len(lines),
        1.0 - len(set(lines)) / len(lines),
        _repeated_windows(words),
        text.count(",") / n,
        sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = np.array([statistics(t) for t in part.column(1).to_pylist()])
                offsets = pa.array(np.arange(0, x.size + 1, len(STATISTICS), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["doc_id", "x"])

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, x array<double>")


@dataclass
class Forest:
    """Complete trees of one depth, flattened: node k has children 2k + 1 and 2k + 2."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def margins(self, x: np.ndarray) -> np.ndarray:
        rows, every = self.binned(x), np.arange(len(x))
        total = np.full(len(x), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int32)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[every, feature[node]] > cut[node])
            total += value[node - (2**DEPTH - 1)]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margins(x)))


def _split(gradient: np.ndarray, hessian: np.ndarray) -> tuple[int, int]:
    """Best (feature, bin) of histograms (feature, bin); (0, last bin), which sends all left, if none helps."""
    g, h = gradient.cumsum(1), hessian.cumsum(1)
    all_g, all_h = g[0, -1], h[0, -1]
    right_g, right_h = all_g - g, all_h - h
    gain = g**2 / (h + SHRINK) + right_g**2 / (right_h + SHRINK) - all_g**2 / (all_h + SHRINK)
    gain[(h < MIN_HESSIAN) | (right_h < MIN_HESSIAN)] = 0.0
    best = int(gain.argmax())
    return divmod(best, gain.shape[1]) if gain.flat[best] > 1e-9 else (0, gain.shape[1] - 1)


def boost(x: np.ndarray, y: np.ndarray) -> Forest:
    """Fit the trees to statistics x and labels y (0 to 1)."""
    inner, leaves, n_features = 2**DEPTH - 1, 2**DEPTH, len(STATISTICS)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(1) for j in range(n_features)]
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    forest = Forest(
        edges,
        np.zeros((TREES, inner), np.int32), np.full((TREES, inner), BINS, np.int32), np.zeros((TREES, leaves)),
        float(np.log(rate / (1 - rate))),
    )
    if not len(x):
        return forest
    rows, margin, every = forest.binned(x), np.full(len(x), forest.base), np.arange(len(x))
    cells = rows.astype(np.int64) + np.arange(n_features) * BINS
    for tree in range(TREES):
        p = 1.0 / (1.0 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, n_features * BINS
            flat = ((node - first)[:, None] * width + cells).ravel()
            shape = (2**level, n_features, BINS)
            sums = [np.bincount(flat, np.repeat(w, n_features), width * 2**level).reshape(shape) for w in (gradient, hessian)]
            for k in range(2**level):
                forest.feature[tree, first + k], forest.cut[tree, first + k] = _split(sums[0][k], sums[1][k])
            node = 2 * node + 1 + (rows[every, forest.feature[tree][node]] > forest.cut[tree][node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, hessian, leaves)
        forest.value[tree] = -RATE * g / (h + SHRINK)
        margin += forest.value[tree][leaf]
    return forest


def train(table: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> Forest:
    """The trees of ``labels(doc_id, label)`` over rows (doc_id, x): at most ``max_rows`` labels, by hash of doc_id."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # Several rows of one document are one training row: the least vector.
    rows = table.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("label").alias("label"))
    found = rows.orderBy("doc_id").select("x", "label").toPandas()
    x = np.array(found["x"].tolist(), float).reshape(-1, len(STATISTICS))
    return boost(x, found["label"].to_numpy(float))


def score(table: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and ``score`` (0 to 1, higher: label 1 likelier) of rows (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.scores(x))], ["doc_id", "score"])

    return table.select("doc_id", "x").mapInArrow(run, "doc_id bigint, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    table = workspace(docs.sparkSession, "quality").write(measured(docs))
    return score(table, train(table, labels))
