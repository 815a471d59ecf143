"""Quality classifier: a generalised additive model with pairwise interactions over text measures.

Shape functions are lookup tables, one per feature and one per chosen pair of features, grown by cyclic boosting:
each cycle visits every table in turn and adds a shallow tree on the binned feature(s), fitted to the logistic
loss's gradients. A score is a sum of table entries, looked up for all documents of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, chunks, lets_go
from tidemark.llm.measures import FEATURES, features

#: Bytes of text that a task looks at at once.
BLOCK_BYTES = 1 << 19


@dataclass
class AdditiveModel:
    """Scores 1 / (1 + exp(-(intercept + sum of table entries)))."""

    edges: list[np.ndarray]
    intercept: float
    singles: np.ndarray  # (features, bins)
    pairs: list[tuple[int, int]]
    grids: np.ndarray  # (pairs, coarse bins, coarse bins)
    coarse: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j in range(b.shape[1]):
            total += self.singles[j, b[:, j]]
        for k, (i, j) in enumerate(self.pairs):
            total += self.grids[k, b[:, i] // self.coarse, b[:, j] // self.coarse]
        return 1 / (1 + np.exp(-total))


def _leaf(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return -g / (h + l2)


def _step_1d(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """A depth-2 tree over bins: the best cut, then the best cut on either side. Returns a value per bin."""
    out = np.zeros(len(g))

    def cut(a: int, b: int, depth: int) -> None:
        G, H = g[a:b].sum(), h[a:b].sum()
        if depth == 0 or b - a < 2:
            out[a:b] = _leaf(G, H, l2)
            return
        cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        gain = cg**2 / (ch + l2) + (G - cg) ** 2 / (H - ch + l2)
        k = a + 1 + int(gain.argmax())
        cut(a, k, depth - 1)
        cut(k, b, depth - 1)

    cut(0, len(g), 2)
    return out


def _step_2d(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """The best cross cut (one cut on either axis, four leaves) of a grid, and its gain."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = G[:-1, :-1], H[:-1, :-1]
    quads = [
        (a, b), (G[:-1, -1:] - a, H[:-1, -1:] - b), (G[-1:, :-1] - a, H[-1:, :-1] - b),
        (G[-1, -1] - G[:-1, -1:] - G[-1:, :-1] + a, H[-1, -1] - H[:-1, -1:] - H[-1:, :-1] + b),
    ]
    gain = sum(x**2 / (y + l2) for x, y in quads)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [float(_leaf(x[i, j], y[i, j], l2)) for x, y in quads]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gain[i, j] - G[-1, -1] ** 2 / (H[-1, -1] + l2))


def fit_additive(x: np.ndarray, y: np.ndarray, cycles: int = 60, rate: float = 0.2, n_bins: int = 32, n_pairs: int = 6, l2: float = 1.0) -> AdditiveModel:
    """Fit on rows x (n, features) and labels y in {0, 1}. With no rows or one class: a constant near the class share."""
    f = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(f)]
    coarse = 4
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(edges, float(np.log(share / (1 - share))), np.zeros((f, n_bins)), [], np.zeros((0, n_bins // coarse, n_bins // coarse)), coarse)
    if len(set(y.tolist())) < 2:
        return model
    b = model.bins(x)
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, np.maximum(p * (1 - p), 1e-9)

    for _ in range(cycles):
        for j in range(f):
            g, h = slopes()
            step = rate * _step_1d(np.bincount(b[:, j], g, n_bins), np.bincount(b[:, j], h, n_bins), l2)
            model.singles[j] += step
            total += step[b[:, j]]
    m = n_bins // coarse
    cells = lambda i, j: (b[:, i] // coarse) * m + b[:, j] // coarse
    grid = lambda i, j, w: np.bincount(cells(i, j), w, m * m).reshape(m, m)
    g, h = slopes()
    gains = sorted(((_step_2d(grid(i, j, g), grid(i, j, h), l2)[1], i, j) for i in range(f) for j in range(i)), reverse=True)[:n_pairs]
    model.pairs = [(i, j) for _, i, j in gains]
    model.grids = np.zeros((len(model.pairs), m, m))
    for _ in range(cycles // 2):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * _step_2d(grid(i, j, g), grid(i, j, h), l2)[0]
            model.grids[k] += step
            total += step.reshape(-1)[cells(i, j)]
    return model


def measure(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, x array<float>): the features of every whole text, in one scan."""
    kind = docs.schema[key].dataType.simpleString()

    @lets_go
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(buf, offs) for _, _, buf, offs in chunks(batch.column(1), BLOCK_BYTES)]
            flat = np.concatenate(got).reshape(-1) if got else np.zeros(0, np.float32)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["k", "x"])

    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, x array<float>")


def held_out(key: str) -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def labelled_sample(measured: DataFrame, labels: DataFrame, label_key: str, label: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` rows (features, label) that are not held out, chosen by a hash of the key."""
    said = labels.where(F.col(label).isNotNull() & F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("k")).agg(F.min(label).alias("y"))
    rows = measured.join(said.where(~F.coalesce(held_out("k"), F.lit(True))), "k")
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * most / n))
    got = rows.select("k", "x", "y").toArrow()
    order = np.argsort(np.asarray(got.column("k").to_numpy()), kind="stable")[:most]
    x = np.array(got.column("x").to_pylist(), np.float32).reshape(-1, len(FEATURES))
    return x[order], got.column("y").to_numpy()[order].astype(float)


def quality_scores(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text",
    label_key: str = "doc_id", label: str = "quality", threshold: float = 0.3, most_labelled: int = 20_000,
) -> DataFrame:
    """One row per document: key, held_out, score, predicted.

    The model is fitted on at most most_labelled labelled rows whose crc32(key as text) mod 5 is not 0; its inputs
    are measures of the whole text only. A null text is measured as an empty one; both get the score of all-zero
    measures. A null key is never learned from and has held_out null. Of several labels of one key the
    lowest counts. Without labels of both classes the score is a constant. Repeated rows are scored alike; an
    empty table gives no rows. Extra columns are ignored. Measures are written once; nothing else of a text moves.
    """
    measured = scratch.table(measure(docs, key, text), "measures")
    x, y = labelled_sample(measured, labels, label_key, label, most_labelled)
    model = docs.sparkSession.sparkContext.broadcast(fit_additive(x, y))
    kind = docs.schema[key].dataType.simpleString()

    @lets_go
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(values))], names=["k", "score"])

    out = measured.mapInArrow(run, f"k {kind}, score double")
    return out.select(F.col("k").alias(key), held_out("k").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
