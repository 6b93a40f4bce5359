"""Five-word runs of texts as hashes, a batch of texts at a time, in array operations.

Words are those of the plain form, ignoring case; a run is a sequence of ``size`` adjacent words. A text of
fewer words has none, so have null and empty texts. The hash of a run depends on its words and their order
only, so equal runs hash alike in every task and session. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from corpusloom.llm.plain import _TOP, WORD, plain_form, tables

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64(0xFFFF)
PORTION = 400_000  # code points looked at together


_TAG = re.compile(r"</?[A-Za-z][^<>]*>")


def untagged(text: str | None) -> str:
    """The text with a space for each mark-up tag; null as empty."""
    return _TAG.sub(" ", text) if text and "<" in text else text or ""


def words(text: str | None) -> list[str]:
    """The words of one text, for tests and small inputs; a tag separates words and is none."""
    return WORD.findall(plain_form(untagged(text)).lower())


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    """A random value by code point, the same for a letter and its capital."""
    lower = np.arange(_TOP + 1, dtype=np.uint64)
    for i in range(_TOP + 1):
        if (c := chr(i)).isupper() and len(low := c.lower()) == 1:
            lower[i] = ord(low)
    value = (lower + np.uint64(1)) * _MIX
    value ^= value >> np.uint64(29)
    value *= _BASE
    return value ^ (value >> np.uint64(32))


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line break, and where each text begins."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(lens) - lens
    return np.minimum(codes, _TOP), starts


def suspects(texts: Sequence[str]) -> np.ndarray:
    """For each text, whether it holds a character for which its plain form may differ."""
    if not len(texts):
        return np.zeros(0, bool)
    codes, starts = _codes(texts)
    return np.logical_or.reduceat(tables()[3][codes], starts)


def plain_batch(texts: Sequence[str | None]) -> list[str]:
    """Plain forms; null as empty."""
    out = [t or "" for t in texts]
    for i in np.flatnonzero(suspects(out)):
        out[i] = plain_form(out[i])
    return out


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Layout:
    """Where the words of a batch of plain texts are, and their hashes."""

    def __init__(self, texts: Sequence[str]):
        self.codes, self.starts = _codes(texts) if len(texts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        empty = np.zeros(0, np.int64)
        self.begin = self.end = self.owner = empty
        self.hashed = empty.astype(np.uint64)
        inside = tables()[1][self.codes]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1 if len(inside) else empty
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        if not len(edge):
            return
        self.begin, self.end = edge[0::2], edge[1::2]  # the last code point is a line break, so runs are closed
        n = len(self.codes)
        up, down = _powers(1 << max(16, n.bit_length()))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(np.where(inside, _values()[self.codes], np.uint64(0)) * up[:n], out=total[1:])
        hashed = (total[self.end] - total[self.begin]) * down[self.begin]
        hashed ^= hashed >> np.uint64(32)
        hashed *= _MIX
        hashed ^= hashed >> np.uint64(29)
        self.hashed = hashed
        self.owner = np.searchsorted(self.starts, self.begin, side="right") - 1


def batch_words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of every word of every text, in order."""
    layout = Layout(plain_batch([untagged(t) for t in texts]))
    return layout.hashed, layout.owner


def runs_of(hashed: np.ndarray, owner: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of every run of ``size`` words, in the order of the text, repeats included."""
    total = len(hashed)
    if total < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = total - size + 1
    runs = hashed[:count].copy()
    for k in range(1, size):
        runs *= _BASE
        runs ^= runs >> np.uint64(29)
        runs += hashed[k : count + k]
    runs ^= runs >> np.uint64(31)
    runs *= _MIX
    runs ^= runs >> np.uint64(30)
    inside = owner[:count] == owner[size - 1 :]
    return runs[inside], owner[:count][inside]


def distinct(runs: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, owner), sorted by hash, for owners under 2**16; a hash keeps its upper 48 bits."""
    key = runs & ~_LOW
    key |= owner.astype(np.uint64)
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key & ~_LOW, (key & _LOW).astype(np.int64)


def batch_runs(texts: Sequence[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owners): the distinct runs of every text; the owner is the text's place. Low 16 bits are 0."""
    ready = plain_batch([untagged(t) for t in texts])
    ends = np.cumsum(np.fromiter(map(len, ready), np.int64, len(ready)))
    found, at = [], 0
    while at < len(ready):  # some texts at a time, to keep the arrays small
        to = min(at + 50_000, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, side="right"))))
        layout = Layout(ready[at:to])
        runs, owner = distinct(*runs_of(layout.hashed, layout.owner, size))
        found.append((runs, owner + at))
        at = to
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([r for r, _ in found]), np.concatenate([o for _, o in found])
