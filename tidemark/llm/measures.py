"""Counts over whole texts that quality rules and the quality classifier share."""

from __future__ import annotations

import numpy as np

from tidemark.llm.kernels import SPACE, Prefix, counts, grams, mix, words

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[0xC3:0xF5] = True  # letters of other scripts count by their lead byte
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:?'\"()-")] = True


def _distinct(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each text has."""
    order = np.argsort(both := mix(key ^ (doc.astype(_U) * _U(0x9E3779B97F4A7C15))), kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = both[order][1:] != both[order][:-1]
    return np.bincount(doc[order[new]], minlength=n)


def base(buf: np.ndarray, offs: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text, and further counts for features."""
    n = len(offs) - 1
    starts, ends, at = words(buf, offs)
    sums = Prefix(buf)
    n_words = np.diff(at)
    word_doc = np.repeat(np.arange(n), n_words)
    lead = (buf & 0xC0) != 0x80
    inside = ~SPACE[buf]
    h = sums.spans(starts, ends)
    out = {"n_words": n_words, "word_chars": counts(lead & inside, offs), "n_symbols": counts(_SYMBOL[buf], offs)}
    # lines: from a text's start or after a line feed, to the next line feed or the text's end
    feeds = np.flatnonzero(buf == 10)
    feed_doc = np.searchsorted(offs, feeds, "right") - 1
    begin = np.concatenate([offs[:-1], feeds + 1])
    doc = np.concatenate([np.arange(n), feed_doc])
    order = np.lexsort((begin, doc))  # a line after a text's last line feed begins where the next text does
    begin, doc = begin[order], doc[order]
    end = np.empty_like(begin)
    if len(begin):
        end[:-1] = np.where(doc[1:] == doc[:-1], begin[1:] - 1, offs[doc[:-1] + 1])
        end[-1] = offs[-1]
    full = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, doc = begin[full], end[full], doc[full]
    n_lines = np.bincount(doc, minlength=n)
    out["n_lines"] = n_lines
    out["n_dup_lines"] = n_lines - _distinct(sums.spans(begin, end), doc, n)
    # words inside windows that stand twice or more in their text
    g, first = grams(h, at, window)
    full = np.diff(first)
    gdoc = np.repeat(np.arange(n), full)
    place = np.repeat(at[:-1] - first[:-1], full) + np.arange(len(g))
    both = mix(g ^ (gdoc.astype(_U) * _U(0x9E3779B97F4A7C15)))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, place[twice], 1)
    np.add.at(step, place[twice] + window, -1)
    covered = np.cumsum(step)[:-1] > 0
    out["n_repeat_words"] = np.bincount(word_doc[covered], minlength=n)
    out |= {"hashes": h, "word_doc": word_doc, "at": at}
    return out


FEATURES = (
    "log_words", "word_length", "upper_share", "digit_share", "exclaims_a_word", "symbols_a_word", "stops_a_word", "wide_share",
    "dup_line_share", "words_a_line", "repeat_share", "distinct_share", "echo_share", "space_share",
)


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Float32 (texts, len(FEATURES)); all zero for an empty text."""
    b = base(buf, offs)
    n, size = len(offs) - 1, np.diff(offs)
    w, one = np.maximum(b["n_words"], 1), np.maximum(size, 1)
    alpha = np.maximum(counts(_ALPHA[buf], offs), 1)
    h, doc = b["hashes"], b["word_doc"]
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    cols = [
        np.log1p(b["n_words"]), b["word_chars"] / w, counts(_UPPER[buf], offs) / alpha, counts(_DIGIT[buf], offs) / one, counts(buf == 33, offs) / w,
        b["n_symbols"] / w, counts(_STOP[buf], offs) / w, counts(buf >= 0xC2, offs) / one, b["n_dup_lines"] / np.maximum(b["n_lines"], 1),
        b["n_words"] / np.maximum(b["n_lines"], 1), b["n_repeat_words"] / w, _distinct(h, doc, n) / w, np.bincount(doc[echo], minlength=n) / w, counts(SPACE[buf], offs) / one,
    ]
    return np.stack(cols, axis=1).astype(np.float32)
