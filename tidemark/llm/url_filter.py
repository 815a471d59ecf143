"""URL rules as globs, matched by a bit-parallel automaton (Shift-And over multiword masks).

A glob is literal bytes, '?' (any one byte) and '*' (any bytes, also none), and must match the whole subject.
All globs share one row of bits: one bit per literal or '?', and one start bit per glob. A '*' is a self-loop on
the bit before it. One step per byte moves every glob of every URL at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks

_U = np.uint64
#: Stands between host and path of a canonical URL; no UTF-8 text has this byte.
SEAM = b"\xff"


@dataclass(frozen=True)
class UrlRule:
    """verdict ('allow' or 'block') for host, its subdomains, and paths that start with path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[bytes, bytes]:
        """For the host itself and for its subdomains; SEAM keeps a host's '*' from reaching into the path."""
        g = self.host.encode() + SEAM + self.path.encode() + b"*"
        return g, b"*." + g


#: The production rules: fixed values.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


class GlobSet:
    """Many globs compiled into one Shift-And automaton. `literal` escapes nothing: '*' and '?' are always wild."""

    def __init__(self, globs: Sequence[str | bytes]):
        self.n = len(globs)
        bits: list[tuple[int, int]] = []  # (byte, or -1 any, or -2 a start bit)
        loops, starts, finals = [], [], []
        for glob in globs:
            g = glob.encode() if isinstance(glob, str) else glob
            starts.append(len(bits))
            bits.append((-2, 0))
            for c in g:
                if c == 42:
                    loops.append(len(bits) - 1)
                else:
                    bits.append((-1 if c == 63 else c, 0))
            finals.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.masks = np.zeros((256, self.words), _U)
        self.loop, self.start = self._of(loops), self._of(starts)
        for k, (c, _) in enumerate(bits):
            if c != -2:
                self.masks[slice(None) if c == -1 else c, k // 64] |= _U(1 << (k % 64))
        self.final_word = np.array([k // 64 for k in finals], np.int64)
        self.final_bit = np.array([k % 64 for k in finals], _U)

    def _of(self, spots: list[int]) -> np.ndarray:
        out = [0] * self.words
        for k in spots:
            out[k // 64] |= 1 << (k % 64)
        return np.array(out, _U)

    def match(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """bool (texts, globs): which globs match each whole text."""
        n = len(offs) - 1
        sizes = np.diff(offs)
        order = np.argsort(-sizes, kind="stable")
        begin, ordered = offs[:-1][order], sizes[order]
        state = np.broadcast_to(self.start, (n, self.words)).copy()
        live = n
        for j in range(int(ordered[0]) if n else 0):
            live = int(np.searchsorted(-ordered[:live], -j, "left"))  # texts longer than j
            cur = state[:live]
            moved = cur << _U(1)
            if self.words > 1:
                moved[:, 1:] |= cur[:, :-1] >> _U(63)
            moved &= self.masks[buf[begin[:live] + j]]
            moved |= cur & self.loop
            state[:live] = moved
        hits = (state[:, self.final_word] >> self.final_bit) & _U(1)
        out = np.empty((n, self.n), bool)
        out[order] = hits.astype(bool)
        return out


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without '://'."""
    if url is None:
        return "", ""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    cut = len(rest)
    for c in "/?#":
        k = rest.find(c)
        if k >= 0:
            cut = min(cut, k)
    host, rest = rest[:cut], rest[cut:]
    for c in "?#":
        rest = rest.partition(c)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), rest


def url_verdicts(pages: DataFrame, rules: Sequence[UrlRule] = RULES, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, rule (text of the longest fitting rule, else null), verdict.

    A null url, one without '://' and one that no rule fits get the default verdict and a null rule. Of rules
    equally long, the one with the longer host wins, then the first in text order. Long URLs are matched
    whole. Repeated rows stay. Extra columns are ignored. Nothing is shuffled; the rules go out with the task.
    '*' and '?' inside a URL are ordinary bytes; inside a rule they are wild.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    auto = GlobSet([g for r in ranked for g in r.globs()])
    texts, verdicts = [r.text for r in ranked], [r.verdict for r in ranked]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [host_and_path(u) for u in batch.column(1).to_pylist()]
            subject = pa.array([h.encode() + SEAM + p.encode() for h, p in parts], pa.large_binary())
            hit = np.concatenate([auto.match(buf, offs) for _, _, buf, offs in chunks(subject)] or [np.zeros((0, auto.n), bool)])
            by_rule = hit[:, 0::2] | hit[:, 1::2]
            best = np.where(by_rule.any(axis=1), by_rule.argmax(axis=1) if by_rule.size else 0, -1) if ranked else np.full(len(parts), -1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([texts[k] if k >= 0 else None for k in best], pa.string()),
                    pa.array([verdicts[k] if k >= 0 else default for k in best], pa.string()),
                ],
                names=["k", "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u")).mapInArrow(judge, f"k {kind}, host string, path string, rule string, verdict string").withColumnRenamed("k", key)
