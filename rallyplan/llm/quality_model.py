"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 5).

Statistics come from the text alone. Training takes a bounded sample of labelled
rows, ``SAMPLE`` of those whose crc32(doc_id) mod 5 isn't 0, the ones with the
smallest hash of doc_id (then doc_id, label, statistics; what is left of ties is
equal); everything is scored. Values are put into at most
``BINS`` bins by quantiles of the sample; a tree's split is the best of the
histograms' gains (logistic loss, second order). The trees are full binary trees
of ``DEPTH`` levels, flattened into arrays (feature, bin, leaf value), which a
batch of documents descends level by level in numpy.

Defined results: null and empty texts have statistics of zero and are scored
like others; a null doc_id isn't held out (crc32 of no bytes, 0, would be) and
isn't learnt from; a label that is null is not learnt from; where a document has
several labels or rows each counts, up to SAMPLE in all; texts of any length are
scored whole; with no labels, or only one kind, the score
is that kind's share (0.5 without labels). Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyplan.llm.common import raw_texts, slices

#: Labelled rows that training takes at most.
SAMPLE = 20_000
BINS, DEPTH, TREES, RATE, SMOOTH, LEAST_ROWS = 64, 4, 60, 0.15, 1.0, 10
#: A document is predicted good from this score on.
GOOD = 0.3
FOLDS = 5

LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
UPPER, DIGITS, MARKS, STOPS = bytes(range(65, 91)), b"0123456789", b"#*$%&|<>", b".,;:!?"
STATISTICS = [
    "words", "word_bytes", "letters", "upper", "digits", "marks", "stops", "exclaims", "bars", "lines", "line_words", "repeated_lines", "distinct_words", "top_word", "next_word_equal",
    "repeated_pairs", "repeated_fours", "marked_words", "long_words", "short_words", "ended_lines", "other",
]
FOLDED = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def statistics(raw: bytes) -> list[float]:
    """The statistics of one text, in the order of STATISTICS."""
    n = len(raw)
    words = [w for w in raw.translate(FOLDED).split(b" ") if w]
    if not words:
        return [0.0] * len(STATISTICS)
    count = lambda some: (n - len(raw.translate(None, some))) / n
    k = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    of_word = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    fours = len(set(zip(words, words[1:], words[2:], words[3:], strict=False)))
    letters, upper, digits, marks, stops = map(count, (LETTERS, UPPER, DIGITS, MARKS, STOPS))
    lengths = [len(w) for w in words]
    return [
        float(k), sum(lengths) / k, letters, upper, digits, marks, stops, raw.count(b"!") / k, raw.count(b"|") / k, float(len(lines)), k / len(lines), 1 - len(set(lines)) / len(lines), len(of_word) / k,
        max(of_word.values()) / k, sum(map(bytes.__eq__, words, words[1:])) / k, 1 - pairs / max(1, k - 1), 1 - fours / max(1, k - 3) if k > 3 else 0.0, sum(w[-1:] in (b"#", b"*", b"$", b"%", b"&", b"!") for w in words) / k,
        sum(x > 14 for x in lengths) / k, sum(x < 3 for x in lengths) / k, sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), 1 - letters - digits - marks - stops,
    ]


class Trees:
    """Flattened trees: node i has children 2i+1 and 2i+2; the last level are leaves."""

    def __init__(self, edges: list[np.ndarray], start: float):
        self.edges, self.start = edges, start
        self.feature, self.bin, self.value = [], [], []

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.int16)
        for j, e in enumerate(self.edges):
            out[:, j] = np.searchsorted(e, x[:, j], side="left")
        return out

    def add(self, feature: np.ndarray, bin_: np.ndarray, value: np.ndarray) -> None:
        self.feature.append(feature)
        self.bin.append(bin_)
        self.value.append(value)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches."""
        return self.margin_of_bins(self.bins(x))

    def margin_of_bins(self, b: np.ndarray) -> np.ndarray:
        rows = np.arange(len(b))
        total = np.full(len(b), self.start)
        for feature, bin_, value in zip(self.feature, self.bin, self.value, strict=True):
            node = np.zeros(len(b), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, feature[node]] > bin_[node])
            total += value[node - len(feature)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost trees on the sample; deterministic."""
    if not len(y):
        return Trees([np.zeros(0)] * x.shape[1], 0.0)
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model = Trees(edges, float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    b = model.bins(x)
    width, features = BINS, x.shape[1]
    cell = b.astype(np.int64) + np.arange(features) * width
    margin = np.full(len(y), model.start)
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, bin_ = np.zeros(inner, np.int64), np.full(inner, width, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (features * width) + cell).ravel()
            size = nodes * features * width
            hist = lambda w: np.bincount(at, np.repeat(w, features), size).reshape(nodes, features, width).cumsum(axis=2)  # noqa: B023, E731
            g, h, c = hist(grad), hist(hess), hist(np.ones(len(y)))
            gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + SMOOTH) + (gt - g) ** 2 / (ht - h + SMOOTH) - gt**2 / (ht + SMOOTH)
            gain[(c < LEAST_ROWS) | (ct - c < LEAST_ROWS)] = 0
            flat = gain.reshape(nodes, -1)
            best = flat.argmax(axis=1)
            good = flat[np.arange(nodes), best] > 1e-9
            feature[first : first + nodes] = np.where(good, best // width, 0)
            bin_[first : first + nodes] = np.where(good, best % width, width)
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > bin_[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + SMOOTH)
        model.add(feature, bin_, value)
        margin += value[leaf]
    return model


def crc(doc_id: int | None) -> int:
    return zlib.crc32(str(doc_id).encode())


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most SAMPLE labelled rows; of training folds only."""
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS != 0))
    some = usable.select(key, F.col(label).cast("double").alias("y")).orderBy(F.xxhash64(key), key, "y").limit(SAMPLE)
    rows = docs.select(key, text).join(F.broadcast(some), key)  # SAMPLE rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stats = [statistics(x) for x in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64())), batch.column(2)], ["k", "x", "y"])

    told = rows.mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, x array<double>, y double")
    # however many rows share a doc_id, SAMPLE of them are learnt from
    got = told.orderBy(F.xxhash64("k"), "k", "y", "x").limit(SAMPLE).toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(STATISTICS))
    y = got["y"].to_numpy()
    order = np.lexsort([y, *x.T[::-1], np.array([crc(k) for k in got["k"].to_pylist()])])  # the same whatever order the rows came in
    return x[order], (y[order] > 0).astype(float)


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key, held_out, score, predicted of every whole text."""
    model = train(*sample(docs, labels, key, text, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            stats = np.array([statistics(x) for x in raw_texts(batch.column(1))]).reshape(-1, len(STATISTICS))
            score = np.round(model.score(stats), 9)
            held = [k is not None and crc(k) % FOLDS == 0 for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= GOOD).astype(np.int32))], [key, "held_out", "score", "predicted"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int")
