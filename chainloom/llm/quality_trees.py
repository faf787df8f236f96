"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees grow level by level from histograms of binned features, with the logistic loss. A trained ensemble is flattened
into arrays (feature, threshold, left child, value), and all rows of a batch go down a tree together in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import written
from .common import as_bytes, slices

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "lower", "upper", "digit", "space", "newline", "punctuation", "symbol", "high_byte",
    "exclamation", "pipe", "top_word", "distinct_lines", "mean_line", "byte_entropy", "repeated_pair", "longest_word",
)


def _classes() -> np.ndarray:
    """(256, 10) membership of bytes in the classes that statistics count."""
    b = np.arange(256)
    char = np.array([chr(i) for i in b])
    return np.stack([
        np.char.islower(char) & (b < 128), np.char.isupper(char) & (b < 128), np.char.isdigit(char) & (b < 128), b == 32, b == 10,
        np.isin(b, list(b".,;:?'\"()-")), np.isin(b, list(b"#*$%&|<>@^_~=+{}[]\\/")), b >= 128, b == 33, b == 124,
    ], axis=1).astype(np.float64)


_CLASSES = _classes()


def statistics(text: bytes | None) -> list[float]:
    """FEATURES of a whole text; of an empty or null one all 0."""
    text = text or b""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = counts / n
    some = share[share > 0]
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    k = max(1, len(words))
    of = (share @ _CLASSES).tolist()
    return [
        np.log1p(n), np.log1p(len(words)), (n - of[3] * n) / k, len(seen) / k, *of[:8], of[8], of[9],
        max(seen.values(), default=0) / k, len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), float(-(some * np.log2(some)).sum()),
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0, float(max(map(len, words), default=0)),
    ]


@dataclass
class Trees:
    """Node arrays of all trees; a node's children are left and left + 1, a leaf has feature -1."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x (N, features)."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                node = np.where(inner, self.left[node] + (x[rows, np.maximum(f, 0)] > self.threshold[node]), node)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 5, ridge: float = 1.0) -> Trees:
    """Boosted trees for 0/1 labels y. With no rows the score is 0.5; with one class it is near that class."""
    start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if len(x) else np.zeros(x.shape, int)
    roots, feature, threshold, left, value = [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    total, d = np.full(len(y), start), x.shape[1]
    for _ in range(rounds if len(x) and 0 < y.sum() < len(y) else 0):
        prob = 1 / (1 + np.exp(-total))
        grad, hess = y - prob, prob * (1 - prob)
        roots.append(node())
        at, open_nodes = np.full(len(y), roots[-1]), [roots[-1]]
        for level in range(depth + 1):
            place = {k: i for i, k in enumerate(open_nodes)}
            slot = np.full(len(feature), -1)
            slot[open_nodes] = range(len(open_nodes))
            live = np.flatnonzero(slot[at] >= 0)
            s = slot[at[live]]
            g, h = np.bincount(s, grad[live], len(open_nodes)), np.bincount(s, hess[live], len(open_nodes))
            for k, i in place.items():
                value[k] = rate * g[i] / (h[i] + ridge)
            if level == depth:
                break
            shape = (len(open_nodes), d, bins)
            key = (s[:, None] * d + np.arange(d)) * bins + binned[live]
            flat, size = key.ravel(), int(np.prod(shape))
            hist = [np.bincount(flat, np.repeat(w, d), size).reshape(shape).cumsum(axis=2) for w in (grad[live], hess[live], np.ones(len(live)))]
            gl, hl, nl = hist
            gr, hr, nr = g[:, None, None] - gl, h[:, None, None] - hl, nl[:, :, -1:] - nl
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (g**2 / (h + ridge))[:, None, None]
            gain[(nl < least) | (nr < least)] = -1
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = -1
            fresh = []
            for k, i in place.items():
                j, b = np.unravel_index(gain[i].argmax(), gain[i].shape)
                if gain[i, j, b] <= 1e-9:
                    continue
                feature[k], threshold[k], left[k] = int(j), float(cuts[j][b]), node()
                node()
                mine = live[s == i]
                at[mine] = left[k] + (binned[mine, j] > b)
                fresh += [left[k], left[k] + 1]
            open_nodes = fresh
            if not fresh:
                break
        total += np.array(value)[at]
    return Trees(np.array(roots, dtype=np.int64), np.array(feature or [-1]), np.array(threshold or [0.0]), np.array(left or [0]), np.array(value or [0.0]), start)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>): FEATURES of every row of docs, written to the shared folder.

    Texts are read whole, however long; null and empty ones have statistics 0. Repeated rows and null ids keep their rows; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([statistics(t) for t in as_bytes(b.column(1))], pa.list_(pa.float64()))], ["doc_id", "x"])

    return written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x array<double>"), "statistics")


def train(stats: DataFrame, labels: DataFrame, fit_rows: int = 20_000, label_col: str = "quality", **options) -> Trees:
    """Trees from about fit_rows labelled ids, taken by hash of the id; null ids and labels are left out.

    labels: (doc_id, label). An id counts once: of repeated labels the greatest, of repeated rows the greatest statistics in order. So what comes to
    the driver is bounded by fit_rows, whatever repeats.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, fit_rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else known
    rows = stats.join(picked, "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.max("x").alias("x")).toArrow()
    x = np.array(rows["x"].to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    y, key = rows["y"].to_numpy(), rows["doc_id"].to_numpy()
    order = np.lexsort((*x.T, y, key))
    return fit_trees(x[order], y[order], **options)


def classify(stats: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score): one row per row of stats, null and repeated ids too; equal statistics have equal scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.score(x))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")
