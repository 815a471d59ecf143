"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

The vocabulary holds the words that tell toxic examples from clean ones (signed log-likelihood ratio); document frequencies
come from all documents. The index holds the bounded sample of labelled examples and goes to the tasks whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, chunks
from tidemark.llm.kernels import Prefix, mix
from tidemark.llm.quality_model import held_out

_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Examples of a block of the index.
BLOCK = 64


def terms(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row from 0, term hash, count) of chunks of whole texts: the different words of each, runs of lower-cased letters and digits."""
    for s in range(0, len(text), 1024):
        for a, b, buf, offs in chunks(pc.utf8_lower(text.slice(s, 1024))):
            inside = np.append(_LETTER[buf], False)
            begin = inside.copy()
            begin[1:] &= ~inside[:-1]
            begin[offs[:-1]] = inside[offs[:-1]]
            stop = inside[:-1] & ~inside[1:]
            stop[offs[1:][offs[1:] > 0] - 1] = inside[:-1][offs[1:][offs[1:] > 0] - 1]
            x, y = np.flatnonzero(begin), np.flatnonzero(stop) + 1
            h, row = Prefix(buf).spans(x, y), np.searchsorted(offs, x, "right") - 1
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            yield s + a, s + b, row[at], h[at].view(np.int64), np.diff(np.append(at, len(h)))


def example_terms(rows: DataFrame) -> DataFrame:
    """(y, h) for each different word of each row (t, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for a, b, row, h, _ in terms(batch.column("t")):
                yield pa.RecordBatch.from_arrays([pa.array(y[a:b][row].astype(np.int32)), pa.array(h)], names=["y", "h"])

    return rows.select("t", "y").mapInArrow(run, "y int, h long")


def telling_terms(rows: DataFrame, n: tuple[int, int], most: int, ratio: float = 3.0) -> np.ndarray:
    """Sorted hashes of at most `most` words whose share of toxic examples differs from their share of clean ones much (one at
    least `ratio` times the other) and beyond chance (a log-likelihood ratio above 4 + 2 ln(words tried)). Frequent words that
    differ a little tell nothing of a text, and would bring every example to every document."""
    counted = example_terms(rows).groupBy("h").agg(F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("q")).where("p + q >= 3").persist()
    try:
        tried = counted.count()
        all_, pos, neg = float(sum(n)), float(n[1]), float(n[0])
        df = F.col("p") + F.col("q")
        part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
        g2 = 2 * (part(F.col("p"), df * pos / all_) + part(F.col("q"), df * neg / all_) + part(pos - F.col("p"), (all_ - df) * pos / all_) + part(neg - F.col("q"), (all_ - df) * neg / all_))
        much = F.abs(F.log((F.col("p") + 0.5) * (neg + 1) / ((F.col("q") + 0.5) * (pos + 1)))) >= np.log(ratio)
        got = counted.where(much).select("h", g2.alias("g")).where(F.col("g") > 4 + 2 * np.log(max(tried, 1))).orderBy(F.desc("g"), "h").limit(most).toArrow()
    finally:
        counted.unpersist()
    return np.sort(got.column("h").to_numpy())


def sparse(docs: DataFrame, key: str, text: str, words: np.ndarray, *more: str) -> DataFrame:
    """(k, w array<int>, f array<int>, more) of every whole text: places in the vocabulary, rising, and their counts."""
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, h, f in terms(batch.column(1)):
                at = np.searchsorted(words, h) if len(words) else np.zeros(len(h), np.int64)
                own = np.flatnonzero(words[np.minimum(at, len(words) - 1)] == h) if len(words) else at[:0]
                order = own[np.lexsort((at[own], row[own]))]
                offs = pa.array(np.searchsorted(row[order], np.arange(b - a + 1)).astype(np.int32))
                cols = [pa.ListArray.from_arrays(offs, pa.array(x[order].astype(np.int32))) for x in (at, f)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *cols, *(batch.column(c).slice(a, b - a) for c in more)], names=["k", "w", "f", *more])

    return docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), *more).mapInArrow(run, f"k {kind}, w array<int>, f array<int>{kinds}")


def weights(w: np.ndarray, f: np.ndarray, doc: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """Cosine-normed (1 + ln count) * idf."""
    x = (1 + np.log(f)) * idf[w]
    norm = np.sqrt(np.bincount(doc, x * x, n))
    return x / np.where(norm > 0, norm, 1)[doc]


@dataclass
class BlockMax:
    """Postings of normed examples by word; for each word and block of examples the largest weight bounds what the block can give."""

    y: np.ndarray
    name: list
    first: np.ndarray  # word -> its first (word, block) list
    block: np.ndarray  # of each list
    peak: np.ndarray
    start: np.ndarray  # of each list in the postings (lists + 1)
    example: np.ndarray
    weight: np.ndarray

    @classmethod
    def build(cls, n_words: int, doc: np.ndarray, w: np.ndarray, x: np.ndarray, y: np.ndarray, name: list) -> BlockMax:
        """Examples of like heaviest words stand together, so that few blocks hold a query's best."""
        n = len(y)
        lead = np.full(n, n_words)
        order = np.lexsort((x, doc))
        lead[doc[order]] = w[order]
        rank = np.empty(n, np.int64)
        new = np.argsort(lead, kind="stable")
        rank[new] = np.arange(n)
        doc = rank[doc]
        order = np.lexsort((doc, w))
        doc, w, x = doc[order], w[order], x[order]
        pair = w * (n // BLOCK + 1) + doc // BLOCK
        at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        peak = np.maximum.reduceat(x, at) if len(at) else np.zeros(0)
        return cls(y[new], [name[i] for i in new.tolist()], np.searchsorted(w[at], np.arange(n_words + 1)), doc[at] // BLOCK, peak, np.append(at, len(x)), doc, x)

    def vectors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, weights, first place of each example) of the examples themselves."""
        word = np.repeat(np.arange(len(self.first) - 1), np.diff(self.start[self.first]))
        order = np.lexsort((word, self.example))
        return word[order], self.weight[order], np.searchsorted(self.example[order], np.arange(len(self.y) + 1))

    def search(self, w: np.ndarray, x: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0, but for one; the best first, ties by number. Blocks are
        opened by falling bound until none can reach the k-th best: exact."""
        lists = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in w.tolist()]) if len(w) else np.zeros(0, np.int64)
        if not len(lists):
            return lists, np.zeros(0)
        q = np.repeat(x, self.first[w + 1] - self.first[w])
        blocks, back = np.unique(self.block[lists], return_inverse=True)
        bound = np.bincount(back, q * self.peak[lists]) * (1 + 1e-9) + 1e-12
        by_block = np.argsort(back, kind="stable")
        ends = np.searchsorted(back[by_block], np.arange(len(blocks) + 1))
        who, cos, kth = np.zeros(0, np.int64), np.zeros(0), 0.0
        turn, step, at = np.argsort(-bound, kind="stable"), max(1, k // 8), 0
        while at < len(turn) and (len(who) < k or bound[turn[at]] >= kth):
            mine = turn[at : at + step]
            if len(who) >= k:
                mine = mine[bound[mine] >= kth]
            at, step = at + step, step * 2
            use = np.concatenate([by_block[ends[b] : ends[b + 1]] for b in mine.tolist()])
            size = self.start[lists[use] + 1] - self.start[lists[use]]
            spot = np.repeat(self.start[lists[use]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            found, back2 = np.unique(self.example[spot], return_inverse=True)
            got = np.bincount(back2, np.repeat(q[use], size) * self.weight[spot])
            fresh = found != but
            who, cos = np.append(who, found[fresh]), np.append(cos, got[fresh])
            best = np.lexsort((who, -cos))[:k]
            who, cos = who[best], cos[best]
            kth = cos[-1] if len(cos) else 0.0
        return who, cos


def vote(y: np.ndarray, cos: np.ndarray, calm: float) -> float:
    """Share of toxic among neighbours weighted by cosine squared; `calm` is the weight of no evidence, which is not toxic."""
    w = cos * cos
    return float((w * y).sum() / (w.sum() + calm))


def calibrated(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a + b v))), by Newton steps on smoothed labels; with one class or none a constant."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    share = (n1 + 0.5) / (len(y) + 1)
    if not n1 or not n0:
        return float(np.log(share / (1 - share))), 0.0
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([np.ones(len(v)), v], axis=1), np.array([np.log(share / (1 - share)), 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (goal - p) - 1e-3 * beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(float(beta[1]), 0.0)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "toxic",
    threshold: float = 0.5, k: int = 15, calm: float = 0.5, most_labelled: int = 20_000, most_terms: int = 4096,
) -> DataFrame:
    """One row per document: key, held_out, score, predicted, vote, evidence (the neighbours: example, cosine, toxic).

    Examples are at most most_labelled labelled rows (chosen by a hash) whose crc32(key as text) mod 5 is not 0, on at most
    most_terms telling words; both bound the index that goes to every task. Of several labels of one key, or of copies of a text, the lowest counts; copies are one example.
    A document's neighbours are its k examples of largest cosine above 0 (equal cosines: by the example's place in the index),
    found exactly whatever the block bounds say. Their votes, weighted by squared cosine, become a probability by a logistic
    fit on the votes that the examples get from each other. A null or empty text, or one without telling words, has no
    neighbours and gets the score of an empty vote. A null key is never an example and has held_out null. Labels of one class
    or none: a constant score. Repeated rows are scored alike; an empty table gives no rows; long texts count whole; extra
    columns are ignored.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    said = labels.where(F.col(label).isNotNull() & F.col(label_key).isNotNull()).groupBy(F.col(label_key).cast(kind).alias("k")).agg(F.min(label).cast("int").alias("y"))
    chosen = said.where(~F.coalesce(held_out("k"), F.lit(True))).orderBy(F.xxhash64("k", F.lit(13)), "k").limit(most_labelled)
    chosen = scratch.table(chosen, "chosen")  # at most most_labelled rows, so they may be broadcast
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(chosen), "k")
    sample = scratch.table(rows.groupBy("t").agg(F.min("k").alias("k"), F.min("y").alias("y")), "sample")
    n = dict(sample.groupBy("y").count().collect())
    words = telling_terms(sample, (n.get(0, 0), n.get(1, 0)), most_terms) if len(n) > 1 else np.zeros(0, np.int64)
    vectors = scratch.table(sparse(docs, key, text, words), "vectors")
    df = np.zeros(len(words) + 1)
    for w, c in vectors.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*")).collect():  # a row a telling word
        df[w] = c
    idf = np.log((1 + vectors.count()) / (1 + df)) + 1
    got = sparse(sample, "k", "t", words, "y").toArrow().sort_by([("k", "ascending"), ("y", "ascending")])
    size = np.array([len(x) for x in got.column("w")], np.int64) if got.num_rows else np.zeros(0, np.int64)
    flat = lambda c: np.concatenate([np.asarray(x, np.int64) for x in got.column(c).to_pylist()]) if got.num_rows else np.zeros(0, np.int64)
    doc, w, f = np.repeat(np.arange(got.num_rows), size), flat("w"), flat("f")
    x = weights(w, f, doc, got.num_rows, idf)
    index = BlockMax.build(len(words), doc, w, x, got.column("y").to_numpy().astype(np.int64), got.column("k").to_pylist())
    shared = spark.sparkContext.broadcast((index, idf, index.vectors()))

    def other_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, _, (w, x, offs) = shared.value
        for batch in batches:
            own = batch.column(0).to_numpy()
            votes = [vote(index.y[near], c, calm) for i in own.tolist() for near, c in [index.search(w[offs[i] : offs[i + 1]], x[offs[i] : offs[i + 1]], k, i)]]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), pa.array(index.y[own], pa.int64())], names=["v", "y"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, idf, _ = shared.value
        for batch in batches:
            offs = batch.column("w").offsets.to_numpy()
            w, f = (batch.column(c).values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]].astype(np.int64) for c in ("w", "f"))
            offs = offs - offs[0]
            x = weights(w, f, np.repeat(np.arange(batch.num_rows), np.diff(offs)), batch.num_rows, idf)
            votes, who, cos = np.zeros(batch.num_rows), [], []
            for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                near, c = index.search(w[a:b], x[a:b], k)
                votes[i] = vote(index.y[near], c, calm)
                who.append(near)
                cos.append(c)
            near, c = np.concatenate(who).astype(np.int64) if who else np.zeros(0, np.int64), np.concatenate(cos) if cos else np.zeros(0)
            found = pa.StructArray.from_arrays([pa.array([index.name[j] for j in near.tolist()], batch.schema.field("k").type), pa.array(c), pa.array(index.y[near].astype(np.int32))], names=["example", "cosine", "toxic"])
            ends = pa.array(np.append(0, np.cumsum([len(z) for z in who])).astype(np.int32))
            score = 1 / (1 + np.exp(-(scale[0] + scale[1] * votes)))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(score), pa.array(votes), pa.ListArray.from_arrays(ends, found)], names=["k", "score", "vote", "evidence"])

    seen = spark.range(len(index.y)).mapInArrow(other_votes, "v double, y long").toArrow()
    scale = calibrated(seen.column("v").to_numpy(), seen.column("y").to_numpy().astype(float))
    out = vectors.mapInArrow(judge, f"k {kind}, score double, vote double, evidence array<struct<example:{kind},cosine:double,toxic:int>>")
    return out.select(F.col("k").alias(key), held_out("k").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "vote", "evidence")
