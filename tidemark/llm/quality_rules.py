"""Document quality rules: base counts, and perplexity bands of a modified Kneser-Ney model per language.

The model's symbols are full code points (case folded, digits as one), its grams GRAM of them, counted by Spark over all
different texts; nothing bounds their number. The estimate is made in Spark and kept as sorted hash arrays (gram hash ->
log probability) in files by hash range, which workers map and search.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, chunks, id_filter, lets_go, with_maybe
from tidemark.llm.kernels import mix
from tidemark.llm.measures import base

_U = np.uint64
#: Code points of a gram, the rows of grams that a task holds before it adds them up, and the bytes of text it looks at at once.
GRAM, MERGE_ROWS, CHUNK = 4, 1 << 19, 1 << 19


def _hashed(docs: DataFrame, text: str, lang: str, *more: Column) -> DataFrame:
    """`more`, l, t and h: the language, the text and its hash, never null."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(*more, F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("l"), t.alias("t"), F.xxhash64(t, F.length(t)).alias("h"))


def distinct_texts(docs: DataFrame, text: str, lang: str, scratch: Scratch) -> DataFrame:
    """(l, t) once for each different text of a language. Only texts whose hash stands in several rows (or shares a bit
    with one that does) are shuffled, copies of a task as one row."""
    rows = _hashed(docs, text, lang)
    repeated = scratch.table(rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "repeated")
    marked = with_maybe(rows, "h", repeated).select("row.*", "maybe")
    once = marked.where("maybe").groupBy("l", "h").agg(F.first("t").alias("t"))
    return marked.where("not maybe").select("l", "t").unionByName(once.select("l", "t"))


def symbols(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, offsets from 0) of chunks of texts: case folded, digits as 0, white space as one sign."""
    parts = ((s + a, s + b, buf, offs) for s in range(0, len(text), 256) for a, b, buf, offs in chunks(pc.utf8_lower(text.slice(s, 256)), CHUNK))
    for a, b, buf, offs in parts:
        lead = (buf & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        x, size = buf[at].astype(np.uint32), np.diff(np.append(at, len(buf)))
        cp = np.where(size == 1, x, np.where(size == 2, x & 0x1F, np.where(size == 3, x & 0x0F, x & 0x07)))
        for k in (1, 2, 3):
            more = size > k
            cp[more] = cp[more] << 6 | (buf[at[more] + k] & 0x3F)
        cp[(cp >= 9) & (cp <= 13)] = 32
        cp[(cp >= 48) & (cp <= 57)] = 48
        yield a, b, cp, np.append(0, np.cumsum(lead))[offs]


def windows(cp: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The GRAM symbols of the gram that ends at each place, the first ones first; before a text's start stands white space."""
    out = []
    for k in range(GRAM - 1, -1, -1):
        prev = np.full(len(cp), 32, np.uint32)
        prev[k:] = cp[: len(cp) - k]
        for j in range(k):
            spot = offs[:-1] + j
            prev[spot[spot < offs[1:]]] = 32
        out.append(prev)
    return out


def gram_hashes(grams: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    """Signed, so that Spark and numpy sort them alike; lang: the language's salt for each gram."""
    h = lang.copy()
    for x in grams:
        h *= _U(0xC2B2AE3D27D4EB4F)
        h += x + _U(1)
    return mix(h).view(np.int64)


def _salts(langs: list[str], sizes: np.ndarray) -> np.ndarray:
    own = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in set(langs)}
    return np.repeat(np.array([own[x] for x in langs], _U), sizes)


def count_grams(texts: DataFrame) -> DataFrame:
    """(lang, g, h, n) over all rows (l, t): grams of GRAM code points, their hashes, and how often they occur; each task adds up
    first."""

    def merged(parts: list[tuple]) -> tuple:
        h, n, who, g = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, first, back = np.unique(h, return_index=True, return_inverse=True)
        return h, np.bincount(back, weights=n).astype(np.int64), who[first], g[first]

    def rows(names: dict[str, int], parts: list[tuple]) -> pa.RecordBatch:
        h, n, who, g = merged(parts)
        width = 1 + (g >= 0x80).astype(np.int32) + (g >= 0x800) + (g >= 0x10000)
        offs = np.append(0, np.cumsum(width.sum(axis=1))).astype(np.int32)
        data = g.astype("<u4").tobytes().decode("utf-32-le").encode()
        grams = pa.StringArray.from_buffers(len(h), pa.py_buffer(offs), pa.py_buffer(data))
        langs = pa.DictionaryArray.from_arrays(pa.array(who), pa.array(list(names), pa.string())).cast(pa.string())
        return pa.RecordBatch.from_arrays([langs, grams, pa.array(h), pa.array(n)], names=["lang", "g", "h", "n"])

    @lets_go
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        parts: list[tuple] = []
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, cp, offs in symbols(batch.column(1)):
                if not len(cp):
                    continue
                sizes, grams = np.diff(offs), windows(cp, offs)
                who = np.repeat(np.array([names.setdefault(x, len(names)) for x in langs[a:b]], np.int32), sizes)
                own = gram_hashes(grams, _salts(langs[a:b], sizes))
                h, first, n = np.unique(own, return_index=True, return_counts=True)
                parts.append((h, n, who[first], np.stack([x[first] for x in grams], axis=1)))
                if sum(len(x[0]) for x in parts) > MERGE_ROWS:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > MERGE_ROWS // 2:
                        yield rows(names, parts)
                        parts = []
        if parts:
            yield rows(names, parts)

    return texts.mapInArrow(count, "lang string, g string, h long, n long").groupBy("lang", "g", "h").agg(F.sum("n").alias("n"))


def entry_hashes(grams: pa.Array, langs: pa.Array, kind: str) -> np.ndarray:
    """Hashes of the model's other entries: shorter grams ('p' and length) and contexts' back-off weights ('b' and length)."""
    size = int(kind[1:])
    cp = np.frombuffer("".join(grams.to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, size) if size else np.zeros((len(grams), 0), np.uint32)
    return gram_hashes(list(cp.T), _salts([f"{x}\0{kind}" for x in langs.to_pylist()], np.ones(len(grams), np.int64)))


def _entries(df: DataFrame, kind: str) -> DataFrame:
    """(h, log_p) of rows (lang, g, log_p)."""

    @lets_go
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(entry_hashes(batch.column("g"), batch.column("lang"), kind)), batch.column("log_p")], names=["h", "log_p"])

    return df.select("lang", "g", F.col("log_p").cast("float").alias("log_p")).mapInArrow(run, "h long, log_p float")


def fit_model(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, log_p): interpolated modified Kneser-Ney of order GRAM, level by level in Spark, as entries of one hash array: every gram's
    probability, those of its shorter ends, and each context's weight for backing off to them.

    Lower orders count the different symbols ahead of a gram; a symbol never seen has a uniform share."""
    levels = [scratch.table(grams, "grams")]
    for m in range(GRAM - 1, 0, -1):
        lower = levels[-1].groupBy("lang", F.substring("g", 2, m).alias("g")).agg(F.count("*").alias("n"))
        levels.append(scratch.table(lower, f"level{m}"))
    p, out = None, None
    for m, level in enumerate(reversed(levels), 1):
        found = level.groupBy("lang").agg(*(F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)), F.count("*").alias("types"))
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
        cut = [F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(f"n{k}", F.lit(1.0)), F.lit(0.05)), F.lit(k - 0.05)).alias(f"d{k}") for k in (1, 2, 3)]
        cuts = F.broadcast(found.select("lang", "types", *cut))  # a row a language
        kinds = (F.count_if(F.col("n") == 1).alias("k1"), F.count_if(F.col("n") == 2).alias("k2"), F.count_if(F.col("n") > 2).alias("k3"))
        level = level.withColumn("c", F.substring("g", 1, m - 1))
        gamma = F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")
        ctx = level.groupBy("lang", "c").agg(F.sum("n").alias("total"), *kinds).join(cuts, "lang").withColumn("weight", gamma / F.col("total"))
        ctx = scratch.table(ctx, f"contexts{m}")
        got = level.join(ctx, ["lang", "c"])
        if p is None:
            got = got.withColumn("below", 1 / F.col("types"))
            uniform = F.log(F.col("weight") / F.col("types"))
            out = _entries(ctx.select("lang", F.lit("").alias("g"), uniform.alias("log_p")), "p0")
        else:
            lower = p.select("lang", F.col("g").alias("s"), F.col("p").alias("below"))
            got = got.withColumn("s", F.substring("g", 2, m - 1)).join(lower, ["lang", "s"])
            out = out.unionByName(_entries(ctx.select("lang", F.col("c").alias("g"), F.log("weight").alias("log_p")), f"b{m - 1}"))
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        got = got.withColumn("p", (F.col("n") - d) / F.col("total") + F.col("weight") * F.col("below"))
        if m == GRAM:
            return out.unionByName(got.select("h", F.log("p").cast("float").alias("log_p")))
        p = scratch.table(got.select("lang", "g", "p"), f"p{m}")
        out = out.unionByName(_entries(p.select("lang", "g", F.log("p").alias("log_p")), f"p{m}"))
    raise AssertionError


def shard_model(model: DataFrame, scratch: Scratch, shard_rows: int = 1 << 22) -> list[tuple[int, str]]:
    """Sorted hash arrays in files by range of hashes: (least hash, file name). The driver holds one shard at a time; each
    executor gets the files once and its workers map them, so they take no memory of their own."""
    spark, n, bits = model.sparkSession, 0, 0
    kept = scratch.table(model, "model")
    n = kept.count()
    while n >> bits > shard_rows:
        bits += 1
    if bits:
        path = f"{scratch.root}/shards"
        kept.withColumn("shard", F.shiftright("h", 64 - bits)).write.partitionBy("shard").parquet(path)
        kept = spark.read.parquet(path)
    folder, out = tempfile.mkdtemp(prefix="tidemark-model-"), []
    for k in range(-(1 << bits) // 2, (1 << bits) // 2) if bits else [0]:
        got = (kept.where(F.col("shard") == k) if bits else kept).select("h", "log_p").toArrow()
        h, v = got.column("h").to_numpy(), got.column("log_p").to_numpy()
        order = np.argsort(h)
        name = uuid.uuid4().hex
        for kind, x in (("h", h), ("v", v)):
            np.save(f"{folder}/{name}.{kind}.npy", x[order])
            spark.sparkContext.addFile(f"{folder}/{name}.{kind}.npy")
        out.append((k << (64 - bits) if bits else -(1 << 63), name))
    return out


class Lookup:
    """Values by hash from the mapped shards, NaN where there is none; a direct-mapped cache spares most searches."""

    def __init__(self, shards: list[tuple[int, str]], bits: int = 21):
        self.low = np.array([x for x, _ in shards], np.int64)
        self.shards = [tuple(np.load(SparkFiles.get(f"{name}.{kind}.npy"), mmap_mode="r") for kind in "hv") for _, name in shards]
        self.mask = np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.int64), np.full(1 << bits, np.nan, np.float32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        slot = h & self.mask
        out = self.values[slot]
        miss = np.flatnonzero((self.keys[slot] != h) | np.isnan(out))
        if len(miss):
            want, back = np.unique(h[miss], return_inverse=True)
            got, ends = np.empty(len(want), np.float32), np.append(np.searchsorted(want, self.low), len(want))
            for (keys, values), a, b in zip(self.shards, ends[:-1], ends[1:], strict=True):
                if a < b:
                    spot = np.minimum(np.searchsorted(keys, want[a:b]), max(len(keys) - 1, 0))
                    got[a:b] = np.where(keys[spot] == want[a:b], values[spot], np.nan) if len(keys) else np.nan
            out[miss] = got[back]
            at = want & self.mask
            self.keys[at], self.values[at] = want, got
        return out

    def log_p(self, grams: list[np.ndarray], langs: list[str], sizes: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each gram under its text's language, backed off where the gram is new."""
        out = self(gram_hashes(grams, _salts(langs, sizes))).astype(np.float64)
        new, weight = np.flatnonzero(np.isnan(out)), None
        row = np.repeat(np.arange(len(langs)), sizes)[new] if len(new) else None
        weight = np.zeros(len(new))
        for m in range(len(grams) - 1, -1, -1):
            if not len(new):
                break
            salts = lambda kind: _salts([f"{x}\0{kind}" for x in langs], np.ones(len(langs), np.int64))[row]  # noqa: B023, E731
            own = [g[new] for g in grams[len(grams) - m - 1 :]] if m < len(grams) else grams
            if m:
                back = self(gram_hashes(own[:-1], salts(f"b{m}")))
                weight += np.where(np.isnan(back), 0.0, back)  # an unseen context has no say
            got = self(gram_hashes(own[1:], salts(f"p{m}")) if m else gram_hashes([], salts("p0")))
            known = ~np.isnan(got)
            out[new[known]] = weight[known] + got[known]
            new, row, weight = new[~known], row[~known], weight[~known]
        out[new] = -20.0  # a language that the model has no symbol of
        return out


_lookups: dict[str, Lookup] = {}


def _lookup(shards: list[tuple[int, str]]) -> Lookup:
    who = shards[0][1]
    if who not in _lookups:
        _lookups.clear()
        _lookups[who] = Lookup(shards)
    return _lookups[who]


def _forgets(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the model's maps and cache go, too."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _lookups.clear()

    return lets_go(whole)


def _words(cp: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each word with the white space after it, number of words with a letter or digit in each text)."""
    begin = cp != 32
    begin[1:] &= cp[:-1] == 32
    begin[offs[:-1][offs[:-1] < len(cp)]] = True
    at = np.flatnonzero(begin)
    letter = ((cp >= 97) & (cp <= 122)) | (cp == 48) | (cp >= 170)
    lettered = np.append(0, np.cumsum(np.maximum.reduceat(letter, at))) if len(at) else np.zeros(1, np.int64)
    return at, np.diff(lettered[np.searchsorted(at, offs)])


def score(rows: DataFrame, shards: list[tuple[int, str]]) -> DataFrame:
    """Of rows (k, l, t, h): k, lang, text hash, n_bytes, n_points, the base counts, lettered (words with a letter or digit) and cost,
    the negative log probability under the text's own language."""
    kind = rows.schema["k"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("l").to_pylist()
            cols: dict[str, list[np.ndarray]] = {x: [] for x in ["n_bytes", "n_points", *names, "lettered", "cost"]}
            for _, _, buf, offs in chunks(batch.column("t"), CHUNK):
                got = base(buf, offs)
                for x in names:
                    cols[x].append(got[x])
                cols["n_bytes"].append(np.diff(offs))
            for a, b, cp, offs in symbols(batch.column("t")):
                sums, sizes = np.zeros(len(cp) + 1), np.diff(offs)
                if len(cp):
                    np.cumsum(_lookup(shards).log_p(windows(cp, offs), langs[a:b], sizes), out=sums[1:])
                cols["n_points"].append(sizes)
                cols["lettered"].append(_words(cp, offs)[1])
                cols["cost"].append(sums[offs[:-1]] - sums[offs[1:]])
            flat = {k: np.concatenate(v) if v else np.zeros(0) for k, v in cols.items()}
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("l"), batch.column("h"), *(pa.array(v.astype(float if x == "cost" else np.int64)) for x, v in flat.items())], names=["k", "lang", "h", *flat])

    return rows.select("k", "l", "t", "h").mapInArrow(_forgets(judge), f"k {kind}, lang string, h long, n_bytes long, n_points long, {', '.join(f'{x} long' for x in names)}, lettered long, cost double")


def best_costs(rows: DataFrame, shards: list[tuple[int, str]], languages: list[str]) -> DataFrame:
    """Of rows (l, h, t): lang, h and `best`, the cost if each word has whichever of the languages, its text's own among them, fits it best."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, best = batch.column("l").to_pylist(), []
            for a, b, cp, offs in symbols(batch.column("t")):
                at, sizes, least = _words(cp, offs)[0], np.diff(offs), None
                grams = windows(cp, offs)
                for own in [langs[a:b], *([x] * (b - a) for x in languages)]:
                    cost = np.add.reduceat(-_lookup(shards).log_p(grams, own, sizes), at) if len(at) else np.zeros(0)
                    least = cost if least is None else np.minimum(least, cost)
                sums = np.append(0.0, np.cumsum(least))
                spot = np.searchsorted(at, offs)
                best.append(sums[spot[1:]] - sums[spot[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column("l"), batch.column("h"), pa.array(np.concatenate(best) if best else np.zeros(0))], names=["lang", "h", "best"])

    return rows.select("l", "h", "t").mapInArrow(_forgets(judge), "lang string, h long, best double")


def quality_rules(
    docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", lang: str = "lang",
    min_words: int = 10, max_repeat_percent: int = 20, below: float = 3.0, above: float = 3.2, by_word: float = 5.5, length_bytes: int = 300,
    most_languages: int = 16,
) -> DataFrame:
    """One row per document: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    and lang_key, log_ppl, ppl_low, ppl_high, word_ppl, word_low, word_high.

    base_failed: fewer words than min_words, or more than max_repeat_percent of the words stand in repeated
    five-word windows. kept is false if base_failed, or if the log perplexity a code point lies outside the band of its language:
    [median - below * s, median + above * s], s = median - first decile of that language's different texts (copies count
    once, in the model too), widened by sqrt(1 + length_bytes / n_bytes) for short texts. The log perplexity a word (with a
    letter or digit) has a band of its own, by_word * s on either side: marks on every word are as likely, sign by sign, as
    letters, and show only there. A text above its bands is measured once more with each word under whichever of the
    most_languages largest languages fits it best, so that mixed texts stay. A null text counts as empty (no words, base_failed); a null
    lang is a language of its own. Ties, repeated rows and long texts are judged like any other row; a language
    with one document keeps it, as its band is centred on it. An empty table gives no rows. Extra columns are ignored.
    """
    shards = shard_model(fit_model(count_grams(distinct_texts(docs, text, lang, scratch)), scratch), scratch)
    rows = _hashed(docs, text, lang, F.col(key).alias("k"))
    scored = scratch.table(score(rows, shards), "scored")
    per = lambda cost: {"log_ppl": F.when(F.col("n_points") > 0, cost / F.col("n_points")), "word_ppl": F.when(F.col("lettered") > 0, cost / F.col("lettered"))}
    # two quantiles a language and measure, from mergeable sketches of all different texts
    texts = scored.where(F.col("n_words") >= min_words).withColumns(per(F.col("cost"))).groupBy("lang", "h").agg(F.first("log_ppl").alias("log_ppl"), F.first("word_ppl").alias("word_ppl"))
    bands = scratch.table(texts.groupBy("lang").agg(F.count("*").alias("texts"), F.percentile_approx("log_ppl", [0.1, 0.5], 10000).alias("q"), F.percentile_approx("word_ppl", [0.1, 0.5], 10000).alias("w")), "bands")
    wide = F.sqrt(1 + F.lit(float(length_bytes)) / F.greatest("n_bytes", F.lit(1)))
    s, t = (F.greatest(F.col(c)[1] - F.col(c)[0], F.lit(0.005)) * wide for c in "qw")
    edges = {"ppl_low": F.col("q")[1] - below * s, "ppl_high": F.col("q")[1] + above * s, "word_low": F.col("w")[1] - by_word * t, "word_high": F.col("w")[1] + by_word * t}
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    judged = scored.join(F.broadcast(bands.drop("texts")), "lang", "left").withColumns(edges | per(F.col("cost")) | {"base_failed": failed})
    # what is too unlikely for its own language is looked at once more, word by word in the most frequent languages
    above_ = ~F.col("base_failed") & ((F.col("log_ppl") > F.col("ppl_high")) | F.coalesce(F.col("word_ppl") > F.col("word_high"), F.lit(False)))
    judged = scratch.table(judged.withColumn("again", F.coalesce(above_, F.lit(False))), "judged")
    again = scratch.table(judged.where("again").select("lang", "h").distinct(), "again")
    languages = [r[0] for r in bands.orderBy(F.desc("texts"), "lang").limit(most_languages).select("lang").collect()]
    asked = id_filter(rows.select("l", "h", "t"), "h", again.select("h")).groupBy("l", "h").agg(F.first("t").alias("t"))
    best = scratch.table(best_costs(asked, shards, languages), "best")
    second = judged.where("again").join(best, ["lang", "h"], "left").withColumns(per(F.coalesce("best", "cost"))).drop("best")
    out = judged.where("not again").unionByName(second)
    inside = F.coalesce(F.col("log_ppl").between(F.col("ppl_low"), F.col("ppl_high")), F.lit(True)) & F.coalesce(F.col("word_ppl").between(F.col("word_low"), F.col("word_high")), F.lit(True))
    return out.select(
        F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"),
        F.col("lang").alias("lang_key"), "log_ppl", "ppl_low", "ppl_high", "word_ppl", "word_low", "word_high",
    )
