import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import kernels as k
from tidemark.llm.common import chunks
from tidemark.llm.measures import FEATURES, base, features

WORD = "[^\x20\x09-\x0d]+"


def texts(seed=1, n=200):
    rng = random.Random(seed)
    out = ["", " ", "\n", "one", "a b c d", "a b c d e", "x" * 5000, "é è\tà\x0bb c d e f", "a b c d e a b c d e", "l\nl\n\nl", "  \n  \n"]
    return out + ["".join(rng.choice("ab \n\té#*!A1　") for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_words_and_base_counts(most):
    t = texts()
    for a, b, buf, offs in chunks(pa.array(t), most):
        starts, ends, at = k.words(buf, offs)
        got = base(buf, offs)
        for i in range(b - a):
            w = re.findall(WORD, t[a + i])
            assert [buf[s:e].tobytes().decode() for s, e in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]], strict=True)] == w
            seen, dup, rep, where = set(), 0, set(), {}
            for line in t[a + i].split("\n"):
                if re.search(WORD, line):
                    dup += line in seen
                    seen.add(line)
            for j in range(len(w) - 4):
                where.setdefault(tuple(w[j : j + 5]), []).append(j)
            for js in where.values():
                if len(js) > 1:
                    rep.update(x for j in js for x in range(j, j + 5))
            want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t[a + i])), dup, len(rep))
            assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_hashes_name_content_not_place():
    buf = np.frombuffer(b"abcXabcYabd", np.uint8)
    h = k.Prefix(buf).spans(np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert h[0] == h[1] != h[2]
    low = k.Prefix(np.frombuffer(b"AbCabc", np.uint8), lower=True).spans(np.array([0, 3]), np.array([3, 6]))
    assert low[0] == low[1]


def test_distinct_spans_compare_bytes(monkeypatch):
    buf = np.frombuffer(b"aa bb aa c bb", np.uint8)
    a, b = np.array([0, 3, 6, 9, 11]), np.array([2, 5, 8, 10, 13])
    for clash in (False, True):
        if clash:  # every hash the same
            monkeypatch.setattr(k.Prefix, "spans", lambda self, a, b: np.zeros(len(a), np.uint64))
        pick, back = k.distinct_spans(buf, a, b)
        assert [buf[a[i] : b[i]].tobytes() for i in pick[back]] == [b"aa", b"bb", b"aa", b"c", b"bb"] and len(pick) == 3


def test_grams_stay_in_their_text():
    h = np.arange(1, 12, dtype=np.uint64)
    g, first = k.grams(h, np.array([0, 3, 9, 9, 11]), 3)
    assert first.tolist() == [0, 1, 5, 5, 5] and len(g) == 5 and len(set(g.tolist())) == 5


@pytest.mark.parametrize("w", [1, 2, 3, 7, 64, 77])
def test_sliding_min(w):
    x = np.random.default_rng(w).integers(0, 1000, 200).astype(np.uint64)
    assert k.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(200 - w + 1)]


def test_features_are_per_text():
    t = texts(3)
    whole = np.concatenate([features(buf, offs) for _, _, buf, offs in chunks(pa.array(t))])
    alone = np.concatenate([features(buf, offs) for x in t for _, _, buf, offs in chunks(pa.array([x]))])
    assert whole.shape == (len(t), len(FEATURES)) and np.array_equal(whole, alone)


def test_null_counts_as_empty():
    (_, _, buf, offs), = chunks(pa.array([None, "a", None]))
    assert offs.tolist() == [0, 0, 1, 1] and buf.tobytes() == b"a"
