"""Sentence boundaries across languages and scripts (problem 2).

Candidate boundaries are generated in each line of a text (a line break always ends a unit): after a full stop,
exclamation or question mark of any script with its closing quotation marks, and at a space between two Thai
words. A maximum-entropy classifier decides on each by its neighbouring tokens, their case, length, digits and
script, and by where the candidate stands towards quotation marks. It is trained on boundaries that are sure:
ends of lines, marks after plain words before a capital, against marks before small letters and digits, inside
quotations, after seed abbreviations and initials.

Offsets are code points of the text as stored. Null, blank and invisible texts have no units; texts are read
whole and in one piece; a line without any mark is a unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.plain import _TOP, tables
from corpusloom.session import ship

# Seed abbreviations that a name or number follows; the last part of a dotted one counts.
_BEFORE = frozenset(
    "ts ths bs pgs gs bscki bsckii ck cki ckii tp q p h tx tt ths đt sđt gđ nxb stt "
    "dr mr mrs ms prof st mt ste m mme mlle pr me vs no fig vol rev gen col sgt hon jr sr".split()
)
# Seed abbreviations within a sentence that may also end one.
_WITHIN = frozenset("v.v v.v.v etc e.g i.e a.m p.m vv".split())
_OPEN, _CLOSE = "“«「『‘", "”»」』’"
_PAIRS = dict(zip(_CLOSE, _OPEN, strict=True))
# Full stops and question marks of scripts without capitals: Arabic, Devanagari, Khmer, Armenian, Ethiopic, Burmese.
_CASELESS = "؟۔।॥។៕։።፧။"
# the set in front lets a line without any be passed over at once
_MARK = re.compile(
    rf"[.!?…。！？｡{_CASELESS}](?:(?<=[。！？｡{_CASELESS}])[。！？｡{_CASELESS}]*|(?<=[.!?…])[.!?…]*(?![0-9a-zà-öø-ÿ/@]))"
    rf"(?:[\"”’»」』)\]）]|[   ]»)*"
)
_THAI_SPACE = re.compile("(?<=[฀-๿])​* +​*(?=[฀-๿])")
_THAI = re.compile("[฀-๿]")
_QUOTES = re.compile('["“”«»「」『』]')
_HIDDEN = re.compile("[​­͏]")
LINE_BREAKS = "\r\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_LINE = re.compile(r"[^\r\n\x0b\x0c\x1c-\x1e\x85  ]+")
_TOKEN = re.compile(r"[^\s\"“”«»「」『』(（\[]*$")
_END = MARKS = ".!?…。！？｡" + _CASELESS


@lru_cache(maxsize=1)
def _view_table() -> np.ndarray:
    """Replacement by code point that keeps the length: look-alikes and odd forms as plain letters, hidden as U+200B."""
    from corpusloom.llm.plain import _CYRILLIC, _GREEK, _LATIN

    table = tables()[0].copy()
    table[table == 0] = 0x200B
    table[0] = 0
    for source in (_CYRILLIC, _LATIN, {k: v for k, v in _GREEK.items() if k not in "αικρυ"}):
        for char, to in source.items():
            table[ord(char)] = ord(to)
    return table


def view(text: str) -> str:
    """The text in plain letters, place for place."""
    if text.isascii():
        return text
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(codes, _TOP)
    if not tables()[3][low].any():
        return text
    to = _view_table()[low]
    return np.where(low < _TOP, to, codes).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


@lru_cache(maxsize=20_000)
def _kind(char: str) -> str:
    if not char:
        return "end"
    if char.isdigit():
        return "digit"
    code = ord(char)
    if 0xE00 <= code < 0xE80:
        return "thai"
    if 0x3041 <= code < 0x3097:
        return "kana"
    if 0x3040 <= code < 0xA000 and char.isalpha() or 0x20000 <= code < 0x32000:
        return "han"
    if char.isupper():
        return "upper"
    if char.isalpha():
        return "lower"
    if char in "\"“«「『":
        return "open"
    return "dash" if char in "-–—" else "other"


def _shape(token: str) -> str:
    """Case, length, digits and script of a token in one word."""
    if not token:
        return "none"
    if token[-1].isdigit():
        return "number"
    kind = _kind(token[-1])
    if kind in ("thai", "han", "kana"):
        return kind
    if not any(c.isalpha() for c in token):
        return "sign"
    letters = [c for c in token if c.isalpha()]
    if len(letters) == 1 and len(token) == 1:
        return "initial" if letters[0].isupper() else "letter"
    case = "caps" if token.isupper() else "title" if token[0].isupper() else "small"
    return f"{case}{min(len(letters), 5)}"


@lru_cache(maxsize=50_000)
def _tail(piece: str) -> tuple[str, int, str, str, str, str]:
    """(word, length of its token, last part, kind before a full stop, kind before other marks, short form) of what stands before a mark."""
    token = _TOKEN.search(piece)[0]
    word = _HIDDEN.sub("", token)
    last = word.rpartition(".")[2]
    low = word.lower()
    if low in _WITHIN or low.strip(".;,") in _WITHIN:
        kind = other = "within"
    else:
        kind = other = _shape(last)
        if last[:1].isupper() and last.lower() in _BEFORE:
            kind = "before"
    short = [last.lower() if len(last) <= 4 and k not in ("number", "han", "kana", "thai") else "" for k in (kind, other)]
    return word, len(token), kind, short[0], other, short[1]


@lru_cache(maxsize=50_000)
def _common(piece: str, mark: str, nxt: str) -> tuple | None:
    """Features of the most frequent candidates, a lone mark outside quotations at the end of a line or before one space; None where more has to be looked at."""
    word, _, kind, short, other, other_short = _tail(piece)
    if mark != ".":
        kind, short = other, other_short
    if mark in _CASELESS or kind == "initial" or kind == "number" and len(word) < 3 and word.isdigit():
        return None
    return "..." if mark == "…" else mark, kind, "word" if kind in ("number", "before", "letter") else "", short, "none", "tight" if nxt == "end" else "gap", nxt


_PLACE = {"none": 0, "in": 1, "first": 2, "after": 3}


def candidates(line: str) -> Iterator[tuple[int, int, tuple]]:
    """(end of the unit, begin of the next, features) of every candidate boundary of a line in plain letters."""
    spans: list[tuple[int, int]] = []
    if _QUOTES.search(line):
        at = -1
        opener = ""
        for match in _QUOTES.finditer(line):
            char = match[0]
            if at < 0:
                if char == '"' or char in _OPEN:
                    at, opener = match.start(), char
            elif char == opener == '"' or _PAIRS.get(char) == opener:
                spans.append((at, match.start()))
                at = -1
    length = len(line)
    for match in _MARK.finditer(line):
        begin, end = match.span()
        place = "none"
        for a, b in spans:
            if a < begin and b >= end:
                place = "in"
            elif a < begin < b < end:
                before = line[:a].rstrip(" ​")
                place = "first" if not before or before[-1] in _END + _CLOSE + '"' else "after"
        piece = line[begin - 24 if begin > 24 else 0 : begin]
        piece = piece.rsplit(None, 1)[-1] if piece and not piece[-1].isspace() else ""
        if end - begin == 1 and place == "none":
            after = line[end : end + 2]
            if not after or after[0] == " " and after[1:] not in ("", " ", "\t", "​"):
                if features := _common(piece, line[begin], _kind(after[1:])):
                    yield end, end + 1 if after else end, features
                    continue
        to = end
        while to < length and line[to] in " \t​":
            to += 1
        gap = "gap" if to > end else "tight"
        nxt = _kind(line[to : to + 1])
        if nxt == "upper" and gap == "tight":
            nxt = "upper1" if _kind(line[to + 1 : to + 2]) in ("upper", "digit") or line[to + 1 : to + 2] == "." else "upper2"
        word, size, kind, short, other, other_short = _tail(piece)
        mark = line[begin]
        caseless = mark in _CASELESS
        if caseless and (nxt == "lower" and not line[to : to + 1].islower()):
            nxt = "han"  # a letter that has no case, as after the full stops that the tables hold
        dots = "..." if mark == "…" or end - begin > 2 and line.startswith("...", begin) else "。" if caseless else mark
        if caseless:
            kind, short = "han", ""
        elif mark != ".":
            kind, short = other, other_short
        ahead = "word" if kind in ("initial", "number", "before", "letter") else ""
        if kind == "initial" or kind == "number" and len(word) < 3 and word.isdigit():
            at = begin - size
            earlier = line[max(0, at - 16) : at].rstrip(" ​")
            if kind == "number":
                ahead = earlier[-1] if earlier[-1:] in (":", ";") else "word"
            elif earlier[-1:] == "." or earlier[-1:] not in (":", ";") and _shape(re.split(r"[\s.]", earlier)[-1]).startswith(("title", "initi", "caps")):
                ahead = "name"
        yield end, to, (dots, kind, ahead, short, place, gap, nxt)
    if _THAI.search(line):
        for match in _THAI_SPACE.finditer(line):
            place = "in" if any(a < match.start() < b for a, b in spans) else "none"
            yield match.start(), match.end(), ("space", "thai", "", "", place, "gap", "thai")


_NAMES = ("mark", "kind", "ahead", "short", "place", "gap", "next")


def active(features: tuple) -> list[str]:
    """Names of the binary features that hold, single and in the pairs that matter."""
    mark, kind, ahead, short, place, gap, nxt = features
    out = [f"{n}={v}" for n, v in zip(_NAMES, features, strict=True) if v]
    out += [f"{kind}|{ahead}|{nxt}", f"{place}|{nxt}", f"{mark}|{kind}", f"{mark}|{nxt}", f"{gap}|{nxt}|{kind}", f"{place}|{gap}"]
    return out


@lru_cache(maxsize=50_000)
def sure(features: tuple, at_end: bool) -> bool | None:
    """True or false where a candidate is sure to be a boundary or none, null where it is not."""
    mark, kind, ahead, short, place, gap, nxt = features
    if place == "in":
        return False
    if mark == "space":
        return True
    if at_end or nxt == "end":
        return True
    if nxt in ("lower", "dash") or (nxt == "other" and place != "none"):
        return False
    if place == "first":
        return False if nxt in ("han", "kana", "upper", "lower", "dash", "other") else None
    if place == "after":
        return nxt in ("upper", "upper2", "open", "digit", "thai", "han") if nxt != "other" else None
    if kind == "before" and nxt in ("upper", "upper1", "upper2", "digit"):
        return False
    if kind == "initial":
        return ahead == "word" if nxt in ("upper", "open") else None
    if kind == "number" and ahead in (":", ";"):
        return False
    if nxt == "upper1":
        return kind not in ("before", "initial") and not kind.startswith("caps")
    if mark in "!?。！？｡" and nxt in ("upper", "upper2", "han", "kana", "digit", "open", "thai"):
        return True
    if mark == "..." and nxt == "lower":
        return False
    if kind in ("small5", "small4", "title5", "within") and nxt in ("upper", "upper2", "open"):
        return True
    return None


class Boundaries:
    """A fitted classifier; decisions are remembered by feature tuple, of which there are few."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "known": {}}

    def decide(self, features: tuple) -> bool:
        if (found := self.known.get(features)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            get = self.weights.get
            found = self.known[features] = self.bias + sum(get(n, 0.0) for n in active(features)) > 0
        return found

    def units(self, text: str | None, plain: bool = False) -> list[tuple[int, int]]:
        """(start, end) of the sentence units of a text; plain: it is in plain form already."""
        if not text:
            return []
        return list(self.each(text, plain))

    def each(self, text: str, plain: bool = False) -> Iterator[tuple[int, int]]:
        """``units`` one after the other, so that what lies after the last one asked for is not looked at."""
        for found in _LINE.finditer(text if plain else view(text)):
            yield from self._of_line(found)

    def last(self, text: str) -> tuple[int, int] | None:
        """The last unit of a plain text."""
        for found in reversed(list(_LINE.finditer(text))):
            if units := list(self._of_line(found)):
                return units[-1]
        return None

    def _of_line(self, match: re.Match) -> Iterator[tuple[int, int]]:
        base, line = match.start(), match[0]
        begin = 0
        found = candidates(line)
        if _THAI.search(line):
            found = sorted(found)  # those at spaces come after those at marks
        for end, to, features in chain(found, [(len(line), len(line), None)]):
            if features and not self.decide(features):
                continue
            a, b = begin, end
            while a < b and line[a].isspace():
                a += 1
            while b > a and line[b - 1].isspace():
                b -= 1
            if a < b and (b - a > 8 or line[a:b].strip("​ ")):
                yield base + a, base + b
            begin = max(begin, to)

    def sentences(self, text: str | None, plain: bool = False) -> list[str]:
        return [text[a:b] for a, b in self.units(text, plain)]


def tally(text: str | None, counts: dict[tuple, list[int]], seen: list | None = None, plain: bool = False) -> None:
    """Adds the sure candidates of a text to ``counts``; ``seen`` gets (end, begin of the next, label) of every candidate."""
    if not text:
        return
    found = [(m.start(), m[0]) for m in _LINE.finditer(text if plain else view(text))]
    follows, follow = [], ""  # what the next line that is not blank begins with
    for _, line in reversed(found):
        follows.append(follow)
        follow = line.lstrip(" ​")[:1] or follow
    for (base, line), follow in zip(found, reversed(follows), strict=True):
        full = len(line.rstrip(" ​"))
        for end, to, features in candidates(line):
            at_end = to >= full
            label = sure(features, at_end)
            if seen is not None:
                seen.append((base + end, base + to, label))
            if label is None:
                continue
            if at_end and follow and features[0] != "space":  # as if the next line followed in this one
                features = (*features[:5], "gap", _kind(follow))
                if features[6] not in ("upper", "han", "kana", "digit", "thai", "open"):
                    continue
            if (own := counts.get(features)) is None:
                own = counts[features] = [0, 0]
            own[label] += 1


def fit(texts: Iterable[str | None], rounds: int = 60, rate: float = 0.5, ridge: float = 1e-4) -> Boundaries:
    """A maximum-entropy classifier from the sure candidates of the texts."""
    counts: dict[tuple, list[int]] = {}
    for text in texts:
        tally(text, counts)
    return fit_counts(counts, rounds, rate, ridge)


def fit_counts(counts: dict[tuple, list[int]], rounds: int = 60, rate: float = 0.5, ridge: float = 1e-4) -> Boundaries:
    """The classifier from the numbers of sure candidates, (no boundary, boundary) by features."""
    if not counts:
        return Boundaries({}, 1.0)
    names: dict[str, int] = {}
    rows = [[names.setdefault(n, len(names)) for n in active(f)] for f in counts]
    width = max(map(len, rows))
    place = np.array([r + [len(names)] * (width - len(r)) for r in rows])
    total = np.array([sum(c) for c in counts.values()], float)
    share = np.array([c[1] for c in counts.values()], float) / total
    weigh = np.sqrt(total)  # frequent contexts must not drown rare ones
    weigh /= weigh.sum()
    w, bias = np.zeros(len(names) + 1), 0.0
    m = np.zeros_like(w)
    v = np.zeros_like(w)
    for step in range(1, rounds * 10 + 1):
        p = 1 / (1 + np.exp(-(w[place].sum(1) + bias)))
        gap = (p - share) * weigh
        grad = np.bincount(place.ravel(), np.repeat(gap, width), len(w)) + ridge * 0.01 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w[-1] = 0
        bias -= rate * gap.sum()
    return Boundaries({n: float(w[i]) for n, i in names.items()}, float(bias))


#: Most rows the classifier is fitted on; they are those with the smallest hashes of their ids.
FIT_ROWS = 3000


def sample_rows(records: DataFrame, id_col: str, columns: list[str], rows: int) -> list:
    """At most ``rows`` rows, those with the smallest hashes of their ids; few more than that leave the tasks."""
    total = records.count()
    narrow = records.select(F.xxhash64(f"`{id_col}`").alias("h"), *columns)
    if total > 2 * rows:
        narrow = narrow.filter(F.col("h") < F.lit(int(-(1 << 63) + (1 << 64) * (1.3 * rows + 50) / total)))
    return narrow.orderBy("h").limit(rows).collect()


def fit_rows(records: DataFrame, id_col: str, text_col: str, rows: int = FIT_ROWS) -> Boundaries:
    """The classifier fitted on a bounded sample of the texts."""
    return fit(r[1] for r in sample_rows(records, id_col, [text_col], rows))


_SCHEMA = pa.schema([("id", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64())])


def _split(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                units = own.units(text)
                ids += [i] * len(units)
                starts += [a for a, _ in units]
                ends += [b for _, b in units]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, ends)], schema=_SCHEMA)

    return run


def sentence_units(records: DataFrame, id_col: str = "pair_id", text_col: str = "article", rows: int = FIT_ROWS) -> DataFrame:
    """(id_col, start_char, end_char) of every sentence unit."""
    spark = ship(records.sparkSession)
    model = spark.sparkContext.broadcast(fit_rows(records, id_col, text_col, rows))
    narrow = records.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return narrow.mapInArrow(_split(model), "id long, start_char long, end_char long").withColumnRenamed("id", id_col)
