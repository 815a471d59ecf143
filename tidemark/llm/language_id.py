"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text's subwords are its byte 3-grams and 4-grams (letters A-Z folded, white space as one sign), hashed to buckets;
its vector is the mean of their embeddings. Because mean and softmax layer are linear, the trained model folds into one
row of class scores per bucket, and a text is scored by look-ups and sums. Probabilities are calibrated by a temperature
on rows kept out of training, and so is the confidence below which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks

BUCKETS = 1 << 14
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_LETTER = regex.compile(r"\p{L}")


def subwords(buf: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 3 and 4 bytes: bucket of the gram that starts at each byte, and whether it lies within its text."""
    c = _FOLD[buf]
    n, left = len(c), np.repeat(offs[1:], np.diff(offs)) - np.arange(len(c))
    out, word = [], np.zeros(n, np.uint32)
    for k in range(4):
        word[: max(0, n - k)] |= c[k:] << np.uint32(8 * k)
        if k >= 2:
            h = (word * np.uint32(0x9E3779B1)) ^ np.uint32(k * 0x3C6EF372)
            h ^= h >> np.uint32(15)
            out.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(18), left > k))
    return out


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    c = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_ASCII[buf], out=c[1:])
    out = c[offs[1:]] > c[offs[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[i] = _LETTER.search(buf[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")) is not None
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    scores: np.ndarray  # (BUCKETS, langs): embedding table times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    floor: float = 0.0  # confidences below it are rejected

    def logits(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n, size = len(offs) - 1, np.diff(offs)
        full = np.flatnonzero(size > 0)
        total, grams = np.zeros((n, len(self.langs))), np.zeros(n)
        for bucket, inside in subwords(buf, offs):
            for j in range(len(self.langs)):
                total[full, j] += np.add.reduceat(np.where(inside, self.scores[bucket, j], np.float32(0)), offs[:-1][full], dtype=np.float64) if len(full) else 0
            if len(full):
                grams[full] += np.add.reduceat(inside, offs[:-1][full], dtype=np.int64)
        return total / np.maximum(grams, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True)) if z.size else z
        return z / z.sum(axis=1, keepdims=True) if z.size else z


def _bag(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = np.zeros(BUCKETS, np.int64)
    for bucket, inside in subwords(buf, np.array([0, len(buf)])):
        c += np.bincount(bucket[inside], minlength=BUCKETS)
    ids = np.flatnonzero(c)
    return ids.astype(np.int32), (c[ids] / max(1, c.sum())).astype(np.float32)


def fit_language_model(
    bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], dim: int = 16, epochs: int = 8, rate: float = 8.0, batch: int = 16, precision: float = 0.995, seed: int = 1,
) -> LanguageModel:
    """bags: (buckets, weights) per text. One text in ten is kept out for temperature and rejection."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], np.int64)
    rng = np.random.default_rng(seed)
    k, table = len(names), rng.normal(0, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, k), np.float32) + rng.normal(0, 0.1, (dim, k)).astype(np.float32), np.zeros(k, np.float32)
    order = rng.permutation(len(bags))
    aside, train = order[: len(bags) // 10], order[len(bags) // 10 :]
    steps, t = max(1, epochs * len(train)), 0
    for _ in range(epochs):
        rng.shuffle(train)
        for s in range(0, len(train), batch):
            rows = [i for i in train[s : s + batch] if len(bags[i][0])]
            t += batch
            if not rows:
                continue
            ids, w = np.concatenate([bags[i][0] for i in rows]), np.concatenate([bags[i][1] for i in rows])
            sizes = np.array([len(bags[i][0]) for i in rows])
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(table[ids] * w[:, None], at)
            z = mean @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            lr = rate * max(0.05, 1 - t / steps) / len(rows)
            back = p @ weights.T
            weights -= lr * (mean.T @ p)
            bias -= 0.1 * lr * p.sum(axis=0)
            np.subtract.at(table, ids, (lr * len(rows)) * np.repeat(back, sizes, axis=0) * w[:, None])
    model = LanguageModel(names, table @ weights, bias)
    full = [i for i in aside if len(bags[i][0])]
    if full and k > 1:
        z = np.stack([(model.scores[bags[i][0]] * bags[i][1][:, None]).sum(axis=0) + bias for i in full]).astype(float)
        loss = lambda s: -np.log(np.maximum(np.exp((z / s) - (z / s).max(1, keepdims=True))[np.arange(len(full)), y[full]] / np.exp((z / s) - (z / s).max(1, keepdims=True)).sum(1), 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
        p = model.probabilities(z)
        sure, right = p.max(axis=1), p.argmax(axis=1) == y[full]
        best = np.argsort(-sure)
        good = np.cumsum(right[best]) / np.arange(1, len(best) + 1)
        passed = np.flatnonzero(good >= precision)
        model.floor = float(sure[best[passed[-1]]]) if len(passed) else 1.0
    return model


def training_bags(docs: DataFrame, key: str, text: str, lang: str, most: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """Subword bags of at most `most` labelled texts, chosen by a hash of the key; bags, not texts, reach the driver."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0, F.lit(False)))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 20)) < int((1 << 20) * most / n))

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_bag(buf[offs[i] : offs[i + 1]]) for a, b, buf, offs in chunks(batch.column(2)) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array([x.tolist() for x, _ in got], pa.list_(pa.int32())), pa.array([w.tolist() for _, w in got], pa.list_(pa.float32()))], names=["k", "lang", "ids", "w"])

    got = rows.select(F.col(key).cast("string"), F.col(lang).cast("string"), F.col(text).cast("string")).mapInArrow(bag, "k string, lang string, ids array<int>, w array<float>").toArrow()
    keys, langs, ids, w = (got.column(x).combine_chunks() for x in ("k", "lang", "ids", "w"))
    order = sorted(range(len(keys)), key=lambda i: (keys[i].as_py(), langs[i].as_py()))[:most]
    return [(ids[i].values.to_numpy(), w[i].values.to_numpy()) for i in order], [langs[i].as_py() for i in order]


def identify_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most_labelled: int = 4000) -> DataFrame:
    """One row per document: key, held_out, lang_pred, score, accepted.

    The model learns from at most most_labelled texts with a lang whose crc32(key as text) mod 5 is not 0; only the
    text enters a prediction. A null or empty text, or one with no letter, is 'und' with score 0. accepted is
    false for those and where the calibrated probability is below the level at which kept-out training rows reached the wanted
    precision. Without any labelled text all rows are 'und'. A null key has held_out null and is never learned
    from. Texts of fewer than three bytes get the bias alone. Repeated rows are predicted alike; an empty table gives no rows.
    Extra columns are ignored. Nothing is shuffled; the model is BUCKETS rows by the number of languages.
    """
    spark = docs.sparkSession
    bags, langs = training_bags(docs, key, text, lang, most_labelled)
    model = spark.sparkContext.broadcast(fit_language_model(bags, langs) if bags else None)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            names, scores, sure = [], [], []
            for a, b, buf, offs in chunks(batch.column(1)):
                if m is None:
                    names += ["und"] * (b - a)
                    scores += [0.0] * (b - a)
                    sure += [False] * (b - a)
                    continue
                ok, p = has_letter(buf, offs), m.probabilities(m.logits(buf, offs))
                best = p.argmax(axis=1)
                top = np.where(ok, p[np.arange(b - a), best], 0.0)
                names += [m.langs[j] if good else "und" for j, good in zip(best.tolist(), ok.tolist(), strict=True)]
                scores += top.tolist()
                sure += (ok & (top >= m.floor)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())], names=["k", "lang_pred", "score", "accepted"])

    out = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, lang_pred string, score double, accepted boolean")
    return out.select(F.col("k").alias(key), (F.crc32(F.col("k").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "lang_pred", "score", "accepted")
