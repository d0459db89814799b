"""Document quality: histogram gradient-boosted trees over document statistics.

Training takes a bounded sample of labelled rows (``max_labelled``, by smallest hash of doc_id) to the
driver; scoring covers every text. The trees are complete binary heaps in flat arrays, so a batch of
documents walks all trees level by level in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import worker

_BYTE_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:?",
    "bang": b"!",
    "symbol": b"#$%&*@^~|<>{}[]\\_=+/`",
    "quote": b"\"'()-",
    "line": b"\n",
    "space": b" \t\r",
    "high": bytes(range(128, 256)),
}
_CLASS_MATRIX = np.array([[b in members for members in _BYTE_CLASSES.values()] for b in range(256)], float)
STATISTICS = [*(f"share_{k}" for k in _BYTE_CLASSES), "log_bytes", "log_words", "mean_word", "longest_word", "distinct_words", "top_word", "repeats", "distinct_pairs", "capitalised", "shouted", "ends_symbol", "ends_sentence", "letterless", "distinct_lines", "words_a_line"]


def statistics(text: str | None) -> list[float]:
    """The features of one text; all zeros for a null, empty or blank one."""
    data = (text or "").encode("utf-8", "replace")
    words = (text or "").split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, w = len(data), len(words)
    classes = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS_MATRIX / n
    counts: dict[str, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    repeats = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False))) if w > 1 else 1
    distinct = list(counts.items())
    share = lambda test: sum(c for x, c in distinct if test(x)) / w
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        *classes.tolist(),
        np.log1p(n),
        np.log1p(w),
        sum(map(len, words)) / w,
        max(map(len, counts)),
        len(counts) / w,
        max(counts.values()) / w,
        repeats / w,
        pairs / max(1, w - 1),
        share(lambda x: x[0].isupper()),
        share(str.isupper),
        share(lambda x: not x[-1].isalnum() and x[-1] not in ".,;:?\"')"),
        share(lambda x: x[-1] in ".?"),
        share(lambda x: not any(map(str.isalpha, x))),
        len(set(lines)) / len(lines),
        np.log1p(w / len(lines)),
    ]


@dataclass
class BoostedTrees:
    """Trees as arrays of shape (trees, nodes): heap order, children of node i at 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            at = np.zeros((len(part), len(trees)), np.int64)
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                at = 2 * at + 1 + (part[rows, self.feature[trees, at]] > self.threshold[trees, at])
            total[lo : lo + 4096] += self.value[trees, at].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.12, l2: float = 1.0, least: float = 2.0) -> BoostedTrees:
    """Logistic boosting on quantile histograms. Without both labels the score is a constant."""
    nodes, inner = 2 ** (depth + 1) - 1, 2**depth - 1
    empty = BoostedTrees(np.zeros((0, nodes), int), np.zeros((0, nodes)), np.zeros((0, nodes)), depth, 0.0)
    if len(y) == 0:
        return empty
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    empty.base = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return empty
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], axis=1)
    feature, threshold, value = np.zeros((trees, nodes), int), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    raw = np.full(n, empty.base)
    columns = np.arange(k) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            flat = ((node - first)[:, None] * (k * bins) + columns + binned).ravel()
            shape = (width, k, bins)
            gs = np.bincount(flat, np.repeat(g, k), width * k * bins).reshape(shape).cumsum(2)
            hs = np.bincount(flat, np.repeat(h, k), width * k * bins).reshape(shape).cumsum(2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
            gain[(hs < least) | (ha - hs < least)] = -1
            best = gain.reshape(width, -1).argmax(1)
            for i in range(width):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, first + i], threshold[t, first + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        gs, hs = np.bincount(node, g, nodes), np.bincount(node, h, nodes)
        value[t, inner:] = (-rate * gs / (hs + l2))[inner:]
        raw += value[t, node]
    return BoostedTrees(feature, threshold, value, depth, empty.base)


def bucket_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> BoostedTrees:
    """Fit on at most ``max_labelled`` labelled doc_ids outside the held-out third, those of least hash.

    Labels of one doc_id are averaged; a mean of exactly 0.5 counts as 1. Of rows that repeat a doc_id the one
    of least statistics is taken, so that no more rows than doc_ids reach the driver.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id")) != 1))
        .groupBy("doc_id")
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [statistics(t) for t in b["text"]]})

    got = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(known), "doc_id")
        .mapInPandas(rows, f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, y int, x array<double>")
        .groupBy("doc_id")
        .agg(F.min(F.struct("x", "y")).alias("one"))
        .select("doc_id", "one.*")
        .collect()
    )
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(STATISTICS))
    return fit(x, np.array([r["y"] for r in got], float))


def scorer(model: BoostedTrees):
    """A column function: text to score."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker.claim("quality")
        for part in parts:
            x = np.array([statistics(t) for t in part], float).reshape(len(part), len(STATISTICS))
            yield pd.Series(model.score(x))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Null, empty and blank texts share one feature vector (all zeros) and get its score. Rows are
    independent, so repeated rows get equal scores, and equal texts do; a text counts whole, however long.
    Rows without a doc_id are scored too and are not held out. Without labels every score is 0.5 and every
    document is predicted 1. An empty table gives an empty result. Extra columns are ignored.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), (bucket_of(F.col(id_col)) == 1).alias("held_out"), scorer(model)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
