"""Counts over all records that the models of problem 5 are made of.

What is counted (words by language, terms of articles, how sentences end and how they go on) goes by the 21 upper bits
of its hash, so that each kind of count has at most ``1 << BITS`` rows whatever the input; counts of a task are added up in arrays
and leave it once. Nothing depends on the order of the records or on their partitions.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from corpusloom.llm.plain import _TOP, tables
from corpusloom.llm.sentences import tally
from corpusloom.llm.shingles import _BASE, _MIX, Layout, _powers, _values

BITS = 21
PENDING = 2_000_000  # counts that are held before they are added up
_ALL = (1 << 64) - 1
_SHIFT = np.uint64(64 - BITS)
#: What a count is of: kind << BITS | bucket. Kinds 0 to 2 are the words of the languages, from TERMS on the terms of articles.
GOES_ON, ENDS, TOTALS, TERMS = 8, 9, 10, 16
FINE = 4  # kinds of GOES_ON and ENDS for longer runs are so much higher, as those are many and words must be told from unknown ones


def word_hash(word: str) -> int:
    """The hash that a Layout gives a word, whatever its case."""
    values, total, power = _values(), 0, 1
    for c in word:
        total += int(values[min(ord(c), _TOP)]) * power
        power = power * int(_BASE) & _ALL
    total &= _ALL
    total ^= total >> 32
    total = total * int(_MIX) & _ALL
    return total ^ (total >> 29)


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, sorted; faster than np.unique, which hashes them first."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def holds(own: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys are among the sorted ones."""
    slots = lambda k: ((k * _MIX) >> np.uint64(42)).astype(np.int64)
    seen = np.zeros(1 << 22, bool)
    seen[slots(own)] = True
    out = seen[slots(keys)]
    at = np.flatnonzero(out)  # only those in a slot that is taken have to be searched for
    if len(at):
        out[at] = own[np.minimum(np.searchsorted(own, keys[at]), len(own) - 1)] == keys[at]
    return out


def buckets(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> _SHIFT).astype(np.int64)


class Table(dict):
    """Values by term, kept by bucket in sorted arrays; terms that were looked up are remembered, ``default`` is for those not counted."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default=None):
        super().__init__()
        self.keys_, self.values_, self.default = keys, values, default

    def __reduce__(self):
        return Table, (self.keys_, self.values_, self.default)

    def __missing__(self, term: str):
        if len(self) > 200_000:
            self.clear()
        key = word_hash(term) >> (64 - BITS)
        at = int(np.searchsorted(self.keys_, key))
        found = self.default
        if at < len(self.keys_) and self.keys_[at] == key:
            value = self.values_[at].tolist()
            found = tuple(value) if isinstance(value, list) else value
        self[term] = found
        return found

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Where the buckets are in the values, -1 for those not counted."""
        if not len(self.keys_):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys_, keys), len(self.keys_) - 1)
        return np.where(self.keys_[at] == keys, at, -1)


class Tally:
    """Counts by key (kind << BITS | bucket), added up in arrays."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, kind: int | np.ndarray, bucket: np.ndarray) -> None:
        """One for each of the buckets."""
        keys, counts = np.unique((np.asarray(kind, np.int64) << BITS) | bucket, return_counts=True)
        self.parts.append((keys, counts))
        self.pending += len(keys)
        if self.pending > PENDING:
            self.parts = [self.total()]
            self.pending = len(self.parts[0][0]) // 2  # so that large totals are not added up at every turn

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, place = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        return keys, np.bincount(place, np.concatenate([n for _, n in self.parts]), len(keys)).astype(np.int64)


def of_kind(keys: np.ndarray, counts: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of a kind, from sorted keys."""
    a, b = np.searchsorted(keys, (kind << BITS, (kind + 1) << BITS))
    return keys[a:b] - (kind << BITS), counts[a:b]


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: digit, space, of a script without spaces between words, full stop or closing mark."""
    chars = [chr(c) for c in range(_TOP + 1)]
    digit = np.fromiter((c.isdigit() for c in chars), bool, _TOP + 1)
    space = np.fromiter((c.isspace() for c in chars), bool, _TOP + 1)
    close = np.zeros(_TOP + 1, bool)  # the same as _CLOSE of defects
    close[0xE00:0xE80] = close[0x3040:0xA000] = True
    mark = np.zeros(_TOP + 1, bool)
    mark[[ord(c) for c in STOPS + CLOSERS]] = True
    return digit, space, close, mark


CLOSERS = "\"”’»」』)）]】 \t\r\n​"
STOPS = ".!?…。！？｡"
_RUNS = (2, 3, 4, 6, 8, 11)  # characters of an ending where words are not told apart
_NUMBER = np.uint64(0x5851F42D4C957F2D)


def _mixed(h: np.ndarray, more: np.ndarray | int) -> np.ndarray:
    out = (h * _BASE) ^ (h >> np.uint64(31))
    out += np.asarray(more, np.uint64)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


class Tails:
    """How the texts of a layout end at given places, as buckets from the coarsest to the finest."""

    def __init__(self, layout: Layout):
        self.layout = layout
        digit, *_ = _classes()
        codes = layout.codes
        self.hashed = np.where(digit[codes[layout.begin]], _NUMBER, layout.hashed) if len(layout.begin) else layout.hashed
        up, down = _powers(1 << max(16, len(codes).bit_length()))
        self.down = down
        self.total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_values()[codes] * up[: len(codes)], out=self.total[1:])

    def of(self, at: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether words are not told apart, buckets) of what lies from ``begin`` up to ``at``."""
        layout, (digit, _, close, _) = self.layout, _classes()
        last = layout.codes[at - 1]
        apart = close[last]
        # the last sign itself; any letter is as good as another, so is any digit
        sign = np.where(apart, np.uint64(1), np.where(digit[last], np.uint64(2), np.where(tables()[1][last], np.uint64(3), _values()[last])))
        out = np.full((len(at), 1 + len(_RUNS)), -1, np.int64)
        base = _mixed(sign, 7)
        out[:, 0] = buckets(base)
        rows = np.flatnonzero(~apart)
        if len(rows) and len(layout.begin):
            j = np.searchsorted(layout.begin, at[rows], "left") - 1
            h = base[rows]
            for k in range(3):
                held = (j - k >= 0) & (layout.begin[np.maximum(j - k, 0)] >= begin[rows])
                h = _mixed(h, np.where(held, self.hashed[np.maximum(j - k, 0)], np.uint64(0)))
                out[rows, 1 + k] = buckets(h)
        rows = np.flatnonzero(apart)
        for k, n in enumerate(_RUNS):
            a = np.maximum(begin[rows], at[rows] - n)
            h = (self.total[at[rows]] - self.total[a]) * self.down[a]
            out[rows, 1 + k] = buckets(_mixed(h, n))
        return apart, out


def count_endings(layout: Layout, places: list[list], into: Tally) -> None:
    """Counts how whole sentences end (ENDS) and what they go on after (GOES_ON); places: (end, begin of the next, label) by text."""
    _, space, close, mark = _classes()
    codes = layout.codes
    if not len(codes):
        return
    breaks, ends = [0], []
    for base, seen in zip(layout.starts.tolist(), places, strict=True):
        breaks += [base + to for _, to, label in seen if label is not False]
        ends += [base + end for end, _, label in seen if label]
    breaks = np.concatenate((breaks, np.flatnonzero(codes == 10) + 1))  # a text ends with a line break
    ends = np.array(ends, np.int64)
    ends = distinct(ends[mark[codes[ends - 1]] | (codes[ends - 1] >= 0xE00) & (codes[ends - 1] < 0xE80)])
    first = layout.starts[np.searchsorted(layout.starts, ends, "right") - 1]
    while (marked := (ends > first) & mark[codes[ends - 1]]).any():  # without their full stops and closing marks
        ends = ends - marked
    ends = distinct(ends[ends > first])
    tails = Tails(layout)
    begun = np.zeros(len(codes) + 1, np.int64)  # where the sentence of each place begins
    begun[breaks] = breaks
    sentence = np.maximum.accumulate(begun).__getitem__
    begin = sentence(ends - 1)
    enough = ends - begin >= 12
    ends, begin = ends[enough], begin[enough]
    # a sentence that goes on: after each word that a space and more words follow, after each character where there are no spaces
    spaces = np.flatnonzero(space[codes])
    begins, words_end = layout.begin, layout.end
    gaps = begins[:0]
    if len(begins) > 1:
        nxt = spaces[np.minimum(np.searchsorted(spaces, words_end[:-1], "left"), len(spaces) - 1)]
        goes_on = (nxt < begins[1:]) & (nxt >= words_end[:-1]) & (sentence(begins[:-1]) == sentence(begins[1:]))
        gaps = nxt[goes_on]
        gaps = gaps[~close[codes[gaps - 1]]]
    p = np.flatnonzero(close[codes[:-1]]) + 1
    p = p[~(space[codes[p]] | mark[codes[p]]) & (sentence(p - 1) == sentence(p))]
    gaps = np.concatenate((gaps, p))
    for kind, at, start in ((ENDS, ends, begin), (GOES_ON, gaps, sentence(gaps - 1) if len(gaps) else gaps)):
        if len(at):
            apart, keys = tails.of(at, start)
            into.add(kind, keys[:, :2][keys[:, :2] >= 0])
            into.add(kind + FINE, keys[:, 2:][keys[:, 2:] >= 0])
            into.add(TOTALS, (kind - GOES_ON) * 2 + apart.astype(np.int64))


def places_of(texts: list[str], counts: dict[tuple, list[int]]) -> list[list]:
    """The candidate boundaries of plain texts, which are also counted for the boundary classifier."""
    out: list[list] = []
    for text in texts:
        tally(text, counts, seen := [], plain=True)
        out.append(seen)
    return out
