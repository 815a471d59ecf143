"""Fill-in-the-middle, ball k-means and toxicity against brute-force versions, on tables with nulls, copies, ties and long texts."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.ball_kmeans import ball_kmeans, nearest, squared
from tidemark.llm.common import Scratch, read_table
from tidemark.llm.fill_middle import Boundaries, fill_in_middle, restored
from tidemark.llm.toxicity import BlockMax, calibrated, terms, toxicity_scores, vote
from tests.conftest import DATA

DOCS = "doc_id long, text string, k string, t string, d string, u long, n long, h string, row string, key long, maybe boolean, w string, salt long"


def table(spark, rows):
    """(key, text) rows with names that clash with the operators' own."""
    return spark.createDataFrame([(k, t, "x", "y", "z", 1, 2, "h", "r", 3, True, "w", 4) for k, t in rows], DOCS).repartition(3)


def scratch(spark):
    return Scratch(spark, "test")


# --- fill in the middle ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "a", "naïve ü", "日本語" * 50, "a😀b" * 300, "😀" * 999, "x" * 5000, "\x00é\x7f"])
def test_boundary_lists_give_every_place(text):
    places = Boundaries.of(np.frombuffer(text.encode(), np.uint8))
    want = [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert places.n == len(text) and [places[k] for k in range(len(text) + 1)] == want


def fim_brute(key, text, plain_from=90, spm_below=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain_from:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "a", "<", "<P", "P>S>M>", "with <S> mark", "<<P<S<M", "日本 😀 naïve", "copy " * 30, "long é " * 60_000, "\n\n", "éé", "\x00"]
    rows = [(i, rng.choice(texts) if i >= len(texts) else texts[i]) for i in range(160)] + [(None, "no key"), (None, None), (7, "other text, same key"), (3, "<"), (3, "<")]
    rows += [(1000 + i, "hot text 😀") for i in range(200)]
    out = fill_in_middle(table(spark, rows), scratch(spark), share=16)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = Counter((r[0], r[1], r[2], r[3], r[4], r[5]) for r in out.collect())
    assert got == Counter((k, *fim_brute(k, t)) for k, t in rows)
    back = Counter(r[0] for r in out.select(restored()).collect())
    assert back == Counter(t or "" for _, t in rows)
    assert {"plain", "psm", "spm"} <= {x[2] for x in got}


def test_fill_in_middle_of_no_rows_and_other_parameters(spark):
    assert fill_in_middle(table(spark, []), scratch(spark)).count() == 0
    rows = [(i, f"text {i} <" + "é" * i) for i in range(50)]
    out = fill_in_middle(table(spark, rows), scratch(spark), plain_from=100, spm_below=100)
    assert {(r[0], *r[1:]) for r in out.collect()} == {(k, *fim_brute(k, t, 100, 100)) for k, t in rows}


# --- ball k-means ------------------------------------------------------------------------------------------------------


def lloyd(rows, dims, k, rounds, seed="2", scale=256):
    """Plain rounds in Python integers."""
    rows = [(key, [math.floor(scale * float(x)) for x in v]) for key, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [assign(v)[1] for _, v in rows]
        for j in range(len(c)):
            if members := [v for (_, v), o in zip(rows, own, strict=True) if o == j]:
                c[j] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    last = [(key, *assign(v)[::-1]) for key, v in rows]
    share = Counter()
    for _, j, d in last:
        share[j] += d
    name = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return Counter((key, j, d, share[j], sum(share.values()), name[j]) for key, j, d in last)


VEC = "vec_id long, embedding array<double>, k long, v string, m string, ids string, cluster string, sums string"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, 0, "v", "m", "i", "c", "s") for k, v in rows], VEC).repartition(3)


def clustered(spark, rows, **kw):
    out = ball_kmeans(vectors(spark, rows), scratch(spark), **kw)
    return Counter(tuple(r) for r in out.drop("compared").collect()), out


def test_ball_kmeans_against_plain_rounds(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6))
    rows = [(i, (base[i % 12] + rng.normal(size=6) * 0.05 * (i % 7)).tolist()) for i in range(600)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, rows[9][1]), (None, rows[10][1]), (700, None), (701, [1.0] * 5), (702, [float("nan")] + [0.0] * 5), (703, [float("inf")] * 6), (704, [None] * 6), (705, [0.0] * 6), (706, [])]
    got, out = clustered(spark, rows, dims=6, clusters=15, rounds=4)
    assert got == lloyd(rows, 6, 15, 4)
    assert out.agg(F.avg("compared")).first()[0] < 7  # of 14: balls spare most comparisons


def test_ball_kmeans_keeps_ties_and_large_numbers_exact(spark):
    grid = [(i, [float(x), float(y)]) for i, (x, y) in enumerate((x, y) for x in range(6) for y in range(6))]  # many equal distances
    got, _ = clustered(spark, grid, dims=2, clusters=9, rounds=3, scale=1)
    assert got == lloyd(grid, 2, 9, 3, scale=1)
    same = [(i, [0.25, 0.25]) for i in range(40)]
    assert clustered(spark, same, dims=2, clusters=5, rounds=2)[0] == lloyd(same, 2, 5, 2)
    far = [(i, [(-1) ** i * 400_000.0 + i, float(i)]) for i in range(60)]
    assert clustered(spark, far, dims=2, clusters=4, rounds=5)[0] == lloyd(far, 2, 4, 5)
    few = [(1, [0.5, 1.5]), (2, [0.0, -3.25])]
    assert clustered(spark, few, dims=2, clusters=40, rounds=5)[0] == lloyd(few, 2, 40, 5)
    assert clustered(spark, [(1, None), (2, [])], dims=2)[0] == Counter()
    assert clustered(spark, [], dims=2)[0] == Counter()
    with pytest.raises(Exception, match="too large"):
        clustered(spark, [(1, [1e9, 0.0])], dims=2)


def test_nearest_meets_only_what_may_be_nearer():
    rng = np.random.default_rng(1)
    for wide in (40, 1 << 26):
        x, c = rng.integers(-wide, wide, (400, 3)), rng.integers(-wide, wide, (30, 3))
        full = np.stack([((x - y) ** 2).sum(1) for y in c], axis=1)
        assert (squared(x, c) == full).all()
        label, dist, met = nearest(x, c, rng.integers(0, 30, 400))
        assert (label == full.argmin(1)).all() and (dist == full.min(1)).all()
        label, dist, met = nearest(x, c, full.argmin(1))
        assert (label == full.argmin(1)).all() and met.mean() < 25


def test_op12_on_the_table(spark):
    from tidemark.llm.queries import op12_centroid_clustering

    got = Counter(tuple(r) for r in op12_centroid_clustering(spark, DATA).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())
    assert got == lloyd([(r.vec_id, r.embedding) for r in read_table(spark, DATA, "embeddings").collect()], 64, 40, 5)


# --- toxicity ----------------------------------------------------------------------------------------------------------


def test_terms_are_whole_words():
    import pyarrow as pa

    texts = ["Idiot, idiot! you'RE", "", "a-b a", "x" * 70 + " " + "x" * 70 + " ÜBER über", None, "!!", "end"]
    got = []
    for _, _, row, _, f in terms(pa.array([t or "" for t in texts])):
        got += list(zip(row.tolist(), f.tolist(), strict=True))
    want = Counter()
    for i, t in enumerate(texts):
        word = ""
        for ch in [*(t or "").lower(), " "]:
            if ch.isalnum():
                word += ch
            elif word:
                want[i, word] += 1
                word = ""
    assert Counter(got) == Counter((i, n) for (i, _), n in want.items())


def test_block_max_search_equals_all_cosines():
    rng = np.random.default_rng(11)
    n, words = 700, 40
    dense = np.where(rng.random((n, words)) < 0.12, rng.random((n, words)), 0)
    dense[5] = dense[4]
    dense[10:14] = 0
    norm = np.sqrt((dense**2).sum(1, keepdims=True))
    dense = dense / np.where(norm > 0, norm, 1)
    doc, w = np.nonzero(dense)
    index = BlockMax.build(words, doc, w, dense[doc, w], rng.integers(0, 2, n), list(range(n)))
    name = np.array(index.name)
    ww, xx, offs = index.vectors()
    for i in range(0, n, 7):
        own = slice(offs[i], offs[i + 1])
        assert np.allclose(dense[name[i]][ww[own]], xx[own]) and np.count_nonzero(dense[name[i]]) == len(ww[own])
        for but in (-1, i):
            who, cos = index.search(ww[own], xx[own], 15, but)
            full = dense[name] @ dense[name[i]]
            if but >= 0:
                full[but] = 0
            best = np.sort(full[full > 0])[::-1][:15]
            assert len(cos) == len(best) and np.allclose(cos, best) and np.allclose(full[who], cos)
    assert len(index.search(np.zeros(0, np.int64), np.zeros(0), 5)[0]) == 0


def test_votes_and_calibration():
    assert vote(np.array([1, 0]), np.array([0.9, 0.1]), 0.0) > 0.9 and vote(np.zeros(0), np.zeros(0), 0.5) == 0
    rng = np.random.default_rng(2)
    v = rng.random(4000)
    a, b = calibrated(v, (rng.random(4000) < 1 / (1 + np.exp(-(-3 + 6 * v)))).astype(float))
    assert abs(a + 3) < 0.4 and abs(b - 6) < 0.6
    assert calibrated(np.zeros(0), np.zeros(0)) == (0.0, 0.0)


def test_toxicity_on_odd_tables(spark):
    rng = random.Random(4)
    nice, foul = [f"word{i}" for i in range(60)], ["vile", "rotten", "fool"]
    make = lambda bad: " ".join(rng.choice(nice) for _ in range(30)) + (" " + " ".join(rng.sample(foul, 2)) if bad else "")
    rows = [(i, make(i % 5 == 1)) for i in range(400)]
    extra = [(500, None), (501, ""), (502, "!!!"), (None, "vile rotten"), (None, None), (503, "good " * 50_000 + "vile rotten fool"), (504, "vile rotten"), (504, "vile rotten"), (1, rows[1][1])]
    labels = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(400)] + [(0, None), (None, 1), (2, 1), (500, 0), (504, 1)], "doc_id long, toxic int").withColumns({"k": F.lit(1), "y": F.lit(2), "t": F.lit("t")})
    out = toxicity_scores(table(spark, rows + extra), labels, scratch(spark))
    got = [(r.doc_id, r.held_out, r.score, r.predicted, r.vote, r.evidence) for r in out.collect()]
    assert Counter(r[0] for r in got) == Counter(k for k, _ in rows + extra)
    by = {r[0]: r for r in got}
    fresh = [r for r in got if r[0] is not None and r[0] < 400 and r[1]]
    assert fresh and all(r[3] == int(r[0] % 5 == 1) for r in fresh)
    assert by[503][3] == 1 and by[504][3] == 1 and by[500][3] == by[501][3] == by[502][3] == 0
    assert by[500][2] == by[501][2] == by[502][2] and not by[500][5]
    assert by[None][1] is None and all(0 <= r[2] <= 1 for r in got)
    assert by[504][5][0].cosine > 0.5 and by[504][5][0].toxic == 1 and sorted((e.cosine for e in by[504][5]), reverse=True) == [e.cosine for e in by[504][5]]
    assert all(r[1] == (Counter([r[0]]) and __import__("zlib").crc32(str(r[0]).encode()) % 5 == 0) for r in got if r[0] is not None)


def test_toxicity_without_two_classes(spark):
    rows, none = [(i, f"text {i}") for i in range(30)], spark.createDataFrame([], "doc_id long, toxic int")
    assert {r[0] for r in toxicity_scores(table(spark, rows), none, scratch(spark)).select("predicted").collect()} <= {0, 1}
    one = spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int")
    assert {r[0] for r in toxicity_scores(table(spark, rows), one, scratch(spark)).select("predicted").collect()} == {0}
    assert toxicity_scores(table(spark, []), one, scratch(spark)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    from tidemark.llm.queries import op13_toxicity

    d = DATA.replace("0.001", "0.01")
    said = op13_toxicity(spark, d).join(read_table(spark, d, "labels"), "doc_id").where("held_out")
    good, n = said.agg(F.sum((F.col("predicted") == F.col("toxic")).cast("int")), F.count("*")).first()
    assert good / n >= 0.95
