"""Similarity join by vertical partitioning of the n-gram order.

All pairs of texts whose sets of five-word runs have a Jaccard likeness of at least ``threshold``, exactly:

1. Every text becomes its set of run hashes, by a function of the caller's. The order of runs is that of their hashes; it is cut into ``fragments``
   of equal width, and each fragment holds the part of every set that falls into it, packed by blocks of texts.
2. Pass B joins the parts within each fragment. If a pair has likeness t, then in some fragment its parts have
   likeness t as well. There the runs are ordered by the number of parts that hold them, rare first, and every part
   has a prefix: its rarest ``n - ceil(t*n) + 1`` runs, n being the part's size, filled up to a whole rarity class. Parts of
   likeness t share a run inside both prefixes; a pair is reported if the shared prefix runs plus the smaller of the
   two tails can reach that, and then the parts' exact overlap does. No partner is capped. Parts of short texts are
   alike by a single run, so these carry marks of all their runs: a mark that only one of two texts has is a run
   that they do not share, and pairs that cannot reach the threshold by that bound are left out.
3. Pass C counts the exact overlap of the reported pairs in every fragment where both have runs; the partial overlaps
   are summed per pair and give the exact likeness.

The number of fragments is a parameter and does not grow with the rows, as a part must keep some runs to tell texts
apart. What grows with the rows are the ``slots`` of a fragment, by blocks of texts: every part is shipped once, to its
text's slot, where pass C finds it; a pair of two slots carries the one part to the other. In pass B the slots of a
fragment are one task, which keeps the parts in a scratch file and compares them cell by cell: a part is looked at in
the cells of the first ``n - ceil(t*n) + 1`` of its runs, hot runs (by a bounded sample) last and otherwise by hash. Parts
of likeness t have one of those in common and so meet in a cell. Cells grow with the postings, so that one of them fits
into memory, and copies of parts are in memory only, those of one cell at a time.

Texts with equal sets are one class: one member is compared, the rest are listed as members, so a large group
of copies costs its size and not its square. Hashes are of 64 bits, of which a fragment keeps 32 besides its own number; a
clash could only add to an overlap of a pair that already shares a third of its runs.

Null and empty texts and texts under five words have no runs and are in no pair, nor are rows with a null id. Repeated ids are treated as
separate rows. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ship, tidy

#: (hashes, owners) of the distinct runs of texts, also what each text has besides, as rows of bytes, if anything
RunsOf = Callable[[list], tuple]
BLOCK = 4096
_STEP = 2  # rarity classes: half powers of two
_CLASSES = 40
_CHUNK = 500_000  # pairs looked at together
_MARKS = 128  # bits a text
_SHORT = 96  # runs of a text that marks are of use for
FRAGMENTS = 16
COARSE = 2  # fragments that are one for fields of short texts
SHORT_BYTES = 600  # mean length of the texts of such a field, at most
SLOT_BYTES = 512 << 20  # of text for each slot, about
CELL = 4_000_000  # postings that are compared together, about
_SLICE = 50_000  # parts that are routed together, under 2**16
HOT_ROWS = 3000  # texts that hot runs are told by
_PROBE, _HOME = 1, 2  # roles of a copy of a part
_KIND_BITS = 8  # field << 4 | split; split 0 is the left side of a join of two sides

_ENTRY = "key int, block long, idx binary, runs binary, texts binary, sizes binary, marks binary, ids binary, prints binary, held binary, extra binary, gone binary"


def _mur(key: int) -> int:
    """Spark's hash of an int, for keys that spread evenly over partitions."""
    m = 0xFFFFFFFF
    k = (key & m) * 0xCC9E2D51 & m
    k = ((k << 15) | (k >> 17)) * 0x1B873593 & m
    h = 42 ^ k
    h = ((h << 13) | (h >> 19)) & m
    h = (h * 5 + 0xE6546B64) & m
    h ^= 4
    for shift, mul in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> shift)) * mul & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def even_keys(n: int, partitions: int) -> list[int]:
    """n distinct ints that hash partitioning spreads over the partitions as evenly as can be."""
    found: dict[int, list[int]] = {}
    most, key, out = math.ceil(n / partitions), 0, []
    while len(out) < n:
        place = _mur(key) % partitions
        if len(found.setdefault(place, [])) < most:
            found[place].append(key)
            out.append(key)
        key += 1
    return out


def fragment_keys(fragments: int, slots: int, partitions: int) -> list[int]:
    """A distinct int for each fragment and slot; those of a fragment are in one partition, each fragment in another."""
    found: list[list[int]] = [[] for _ in range(fragments)]
    key = left = 0
    while left < fragments * slots:
        place = _mur(key) % partitions
        if place < fragments and len(found[place]) < slots:
            found[place].append(key)
            left += 1
        key += 1
    return sum(found, [])


def _entries(keys: np.ndarray, slots: int, coarse: frozenset[int] = frozenset(), *, runs_of: RunsOf):
    """Texts to packed entries, one for each fragment and block. Columns: id, kind, text; a block is of one kind.

    coarse: fields of short texts, of which ``COARSE`` fragments are one, so that a part tells more and marks are fewer.

    An entry holds its postings (idx, runs), part by part, the texts that have any, and for short texts their sizes
    and marks. The entry of a block's first fragment tells of the whole block as well: ids, sizes, prints and the
    fragments that each text has runs in, and what runs_of tells besides.
    """
    fragments = len(keys) // slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            kinds = batch.column(1).to_numpy(zero_copy_only=False)
            for kind in np.unique(kinds).tolist():
                whole = batch if (kinds == kind).all() else batch.filter(pa.array(kinds == kind))
                for at in range(0, whole.num_rows, BLOCK):
                    piece = whole.slice(at, BLOCK)
                    block = (((part << 20) + number) << _KIND_BITS) + kind
                    number += 1
                    yield pack(piece, block, kind)
            tidy()

    def pack(piece: pa.RecordBatch, block: int, kind: int) -> pa.RecordBatch:
        runs, owner, *more = runs_of(piece.column(2).to_pylist())
        runs = of_field(runs, kind)
        count = piece.num_rows
        n = np.bincount(owner, minlength=count).astype(np.uint32)
        prints = np.zeros(count, np.uint64)
        order = np.argsort(owner, kind="stable")
        if len(runs):
            some = np.flatnonzero(n)
            prints[some] = np.add.reduceat((runs * np.uint64(0xD6E8FEB86659FD93))[order], np.cumsum(n, dtype=np.int64)[some] - n[some])
        marks = None
        if np.median(n) <= _SHORT:
            flags = np.zeros((count, _MARKS), bool)
            flags[owner, ((runs >> np.uint64(32)) % np.uint64(_MARKS)).astype(np.int64)] = True
            marks = np.packbits(flags, axis=1)
        runs, owner = runs[order], owner[order]
        place = frag_of(runs, fragments)
        if kind >> 4 in coarse:
            place -= place % COARSE
        held = np.zeros((count, -(-fragments // 64) * 64), bool)
        held[owner, place] = True
        # one row for each fragment and text: a part, its postings side by side
        order = np.argsort(place, kind="stable")
        runs, owner, place = runs[order], owner[order], place[order]
        begin = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])))) if len(runs) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(runs)))
        home = (block >> _KIND_BITS) % slots
        slot = place[begin] * slots + home
        text = owner[begin]
        low = (runs >> np.uint64(16)).astype(np.uint32)
        idx = owner.astype(np.uint16)
        own = np.unique(np.append(slot, home))  # the first fragment's home entry is always there
        a, b = np.searchsorted(slot, own), np.searchsorted(slot, own, side="right")
        ends = np.concatenate(([0], np.cumsum(size)))
        first = own == home
        cut = lambda x, lo, hi: [x[i:j].tobytes() for i, j in zip(lo, hi, strict=True)]
        ids = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        once = lambda x: [x.tobytes() if f else None for f in first]
        few = [None] * len(own)
        return pa.RecordBatch.from_pydict(
            {
                "key": keys[own],
                "block": [block] * len(own),
                "idx": cut(idx, ends[a], ends[b]),
                "runs": cut(low, ends[a], ends[b]),
                "texts": cut(text.astype(np.uint16), a, b),
                "sizes": few if marks is None else cut(n[text], a, b),
                "marks": few if marks is None else cut(marks[text], a, b),
                "ids": once(ids),
                "prints": once(np.stack((prints, n.astype(np.uint64)))),
                "held": once(np.packbits(held, axis=1, bitorder="little")),
                "extra": once(more[0]) if more else few,
                "gone": few,
            },
            schema=_ENTRY_SCHEMA,
        )

    return run


def _routes(
    runs: np.ndarray, begin: np.ndarray, size: np.ndarray, home: int, slots: int, threshold: float, hot: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, part, role) of every copy of every part; runs: postings part by part."""
    every = np.arange(len(begin))
    if slots == 1:
        return np.zeros(len(begin), np.int64), every, np.full(len(begin), _PROBE | _HOME, np.uint8)
    part = np.repeat(every, size)
    late = np.zeros(len(runs), bool)
    if len(hot):
        late = hot[np.minimum(np.searchsorted(hot, runs), len(hot) - 1)] == runs
    order = np.lexsort((runs, late, part))
    place = np.arange(len(runs)) - np.repeat(begin, size)
    prefix = place < (size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1)[part]
    chosen = order[prefix]
    mixed = ((runs[chosen] >> np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    key = np.unique(part[prefix] * slots + (mixed % np.uint64(slots)).astype(np.int64))
    both = np.concatenate((key * 2, (every * slots + home) * 2 + 1))
    both.sort()
    key, is_home = both >> 1, (both & 1).astype(np.uint8)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    role = np.bitwise_or.reduceat(np.where(is_home, _HOME, _PROBE).astype(np.uint8), first) if len(key) else np.zeros(0, np.uint8)
    return key[first] % slots, key[first] // slots, role


_ENTRY_SCHEMA = pa.schema(
    [("key", pa.int32()), ("block", pa.int64())]
    + [(k, pa.binary()) for k in ("idx", "runs", "texts", "sizes", "marks", "ids", "prints", "held", "extra", "gone")]
)


class _Part:
    """Texts' parts in one fragment, numbered through in the order of docs, and their postings: run << 32 | number."""

    def __init__(self, docs: np.ndarray, key: np.ndarray):
        self.docs, self.key, self.total = docs, key, len(docs)

    @classmethod
    def of(cls, entries: pa.Table) -> _Part:
        """All parts of the entries, which are sorted by block."""
        docs, keys, total = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        columns = [entries.column(k) for k in ("idx", "runs", "texts")]
        for i, block in enumerate(entries.column("block").to_pylist()):
            idx, runs, texts = (np.frombuffer(c[i].as_buffer(), t) for c, t in zip(columns, (np.uint16, np.uint32, np.uint16), strict=True))
            at = np.zeros(1 << 16, np.uint64)
            at[texts] = np.arange(total, total + len(texts), dtype=np.uint64)
            keys.append((runs.astype(np.uint64) << np.uint64(32)) | at[idx])
            docs.append((block << 16) | texts.astype(np.int64))
            total += len(texts)
        return cls(np.concatenate(docs), np.concatenate(keys))

    def by_run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, begin, length): owners sorted by run, and where each run's group begins and how long it is."""
        self.key.sort()
        run = (self.key >> np.uint64(32)).astype(np.uint32)
        begin = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else np.zeros(0, np.int64)
        return self.key.astype(np.uint32).astype(np.int32), begin, np.diff(np.append(begin, len(run)))

    def classes_of(self, owner: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """How many entries of each class every text has; texts in slices, to keep the counts small."""
        most = int(np.bincount(owner).max()) if len(owner) else 0
        out = np.empty((self.total, _CLASSES), np.uint16 if most < 1 << 16 else np.uint32)
        for at in range(0, self.total, 50_000):
            to = min(at + 50_000, self.total)
            some = (owner >= at) & (owner < to)
            key = (owner[some] - at) * _CLASSES + cls[some]
            out[at:to] = np.bincount(key, minlength=(to - at) * _CLASSES).reshape(to - at, _CLASSES)
        return out

    def by_text(self) -> tuple[np.ndarray, np.ndarray]:
        """(held, ends): text << 32 | run, sorted, and where each text begins."""
        high = self.key >> np.uint64(32)
        self.key <<= np.uint64(32)
        self.key |= high
        del high
        self.key.sort()
        return self.key, np.searchsorted(self.key, np.arange(self.total + 1, dtype=np.uint64) << np.uint64(32))

    def number(self, docs: np.ndarray) -> np.ndarray:
        """Global text numbers (block << 16 | place) to places here; -1 for texts that are not here."""
        if not self.total:
            return np.full(len(docs), -1, np.int64)
        at = np.minimum(np.searchsorted(self.docs, docs), self.total - 1)
        return np.where(self.docs[at] == docs, at, -1)


def _classes(owner: np.ndarray, begin: np.ndarray, length: np.ndarray, side: np.ndarray | None) -> np.ndarray:
    """Rarity class of every entry; 0 if its run has no partner. side: for pairs between two sides only."""
    if side is None:
        cost = np.where(length > 1, length.astype(float), 0)
    else:
        left = np.add.reduceat(side[owner].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
        cost = np.where((left > 0) & (left < length), 2 * left * (length - left) / np.maximum(length, 1) + 1, 0)
    cls = np.zeros(len(begin), np.uint8)
    some = cost > 0
    cls[some] = np.clip(_STEP * np.log2(cost[some]) + 1e-9, 1, _CLASSES - 1).astype(np.uint8)
    return np.repeat(cls, length)


def _side(part: _Part) -> np.ndarray:
    return ((part.docs >> 16) & 15) > 0


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text with runs, from the entries that tell of whole blocks."""
    for batch in batches:
        for row in batch.filter(batch.column("ids").is_valid()).select(_WHOLE).to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            prints, n = np.frombuffer(row["prints"], np.int64).reshape(2, -1)
            some = np.flatnonzero(n)
            held = np.frombuffer(row["held"], np.int64).reshape(len(ids), -1)[some]
            words = pa.FixedSizeListArray.from_arrays(pa.array(held.ravel()), held.shape[1]).cast(pa.list_(pa.int64()))
            columns = [pa.array(x) for x in ((row["block"] << 16) + some, ids[some], n[some], prints[some])]
            extra = row["extra"] or b""
            width = len(extra) // len(ids)
            cut = pa.array([extra[k * width : (k + 1) * width] for k in some.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, words, cut], schema=_TEXT_SCHEMA)


_WHOLE = ["block", "ids", "prints", "held", "extra"]
_TEXT_SCHEMA = pa.schema([(k, pa.int64()) for k in ("doc", "id", "n", "print")] + [("held", pa.list_(pa.int64())), ("extra", pa.binary())])
_PAIR_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_PART = "a long, b long, na long, nb long, frag int, shared long, part binary"
_PART_SCHEMA = pa.schema([(k, pa.int64()) for k in ("a", "b", "na", "nb")] + [("frag", pa.int32()), ("shared", pa.int64()), ("part", pa.binary())])
_ASKED = ("a", "b", "na", "nb", "frag")


def _overlaps(held: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact overlaps of the parts of texts a and b. held: (text << 32 | run), sorted; ends: by text."""
    shared = np.zeros(len(a), np.int64)
    size = np.diff(ends)
    for at in range(0, len(a), 20_000):
        x, y = a[at : at + 20_000], b[at : at + 20_000]
        swap = size[x] > size[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        count = size[x]
        total = int(count.sum())
        if not total:
            continue
        pair = np.repeat(np.arange(len(x)), count)
        take = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends[x], count)
        want = (held[take] & np.uint64(0xFFFFFFFF)) | (y[pair].astype(np.uint64) << np.uint64(32))
        found = np.searchsorted(held, want)
        hit = held[np.minimum(found, len(held) - 1)] == want
        shared[at : at + 20_000] = np.bincount(pair[hit], minlength=len(x))
    return shared


def _postings(entries: pa.Table) -> pa.Table:
    """The entries that hold postings, by block."""
    entries = entries.filter(entries.column("idx").is_valid())
    return entries.take(np.argsort(entries.column("block").to_numpy(zero_copy_only=False), kind="stable"))


def _marked(entries: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(n, marks) of the texts of entries by block; n is -1 where a block has no marks."""
    n, marks = [np.zeros(0, np.int64)], [np.zeros((0, _MARKS // 64), np.uint64)]
    texts, sizes, own = (entries.column(k) for k in ("texts", "sizes", "marks"))
    for i in range(entries.num_rows):
        if own[i].is_valid:
            n.append(np.frombuffer(sizes[i].as_buffer(), np.uint32).astype(np.int64))
            marks.append(np.frombuffer(own[i].as_buffer(), np.uint64).reshape(-1, _MARKS // 64))
        else:
            count = len(texts[i].as_buffer()) // 2
            n.append(np.full(count, -1, np.int64))
            marks.append(np.zeros((count, _MARKS // 64), np.uint64))
    return np.concatenate(n), np.concatenate(marks)


def _within_reach(n: np.ndarray, marks: np.ndarray, a: np.ndarray, b: np.ndarray, need: float) -> np.ndarray:
    """Whether whole texts a and b can reach the threshold: every mark of one alone is a run of one alone."""
    only_a = np.bitwise_count(marks[a] & ~marks[b]).sum(1, dtype=np.int64)
    only_b = np.bitwise_count(marks[b] & ~marks[a]).sum(1, dtype=np.int64)
    most = np.minimum(n[a] - only_a, n[b] - only_b)
    return (n[a] < 0) | (n[b] < 0) | (most >= need * (n[a] + n[b]) - 1e-9)


def _places(block: int, gone) -> np.ndarray:
    return (block << 16) | np.frombuffer(gone.as_buffer(), np.uint16).astype(np.int64)


def _pass_b(cross: bool, threshold: float):
    """Pairs whose parts in this fragment are alike enough. Left: entries; right: the texts of each block that are copies."""
    join = _alike(cross, threshold)

    def run(entries: pa.Table, copies: pa.Table) -> pa.Table:
        if not entries.num_rows:
            return _PAIR_SCHEMA.empty_table()
        tidy()
        entries = _postings(entries)
        gone = [_places(b, g) for b, g in zip(copies.column("block").to_pylist(), copies.column("gone"), strict=True)]
        return join(_Part.of(entries), gone, lambda: _marked(entries))

    return run


def _pass_b_cells(frags: dict[int, int], cross: bool, threshold: float, hot: np.ndarray, cell: int):
    """The same for fragments of many slots: rows of one partition, which are entries and lists of copies. frags: by key."""
    join = _alike(cross, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[int, _Store] = {}
        for batch in batches:
            for i, key in enumerate(batch.column("key").to_pylist()):
                frag = frags[key]
                if frag not in stores:
                    stores[frag] = _Store()
                stores[frag].add(batch, i)
        for frag in list(stores):
            tidy()
            place = frag_of(hot, len(set(frags.values())))
            own = hot[(place == frag) | (place - place % COARSE == frag)]
            yield from stores.pop(frag).pairs(join, threshold, own, cell)

    return run


class _Store:
    """The parts of one fragment in scratch files: postings and, for each part, its text, first posting, size and marks.

    What the parts of an entry have in common is held once: block, first part, first posting and first mark (-1: none).
    """

    def __init__(self):
        self.gone: list[np.ndarray] = []
        self.entries: list[tuple[int, int, int, int]] = []
        self.runs, self.parts, self.marks = (_scratch() for _ in range(3))
        self.postings = self.count = self.marked = 0

    def add(self, batch: pa.RecordBatch, i: int) -> None:
        block = batch.column("block")[i].as_py()
        if (gone := batch.column("gone")[i]).is_valid:
            self.gone.append(_places(block, gone))
            return
        idx = np.frombuffer(batch.column("idx")[i].as_buffer(), np.uint16)
        texts = np.frombuffer(batch.column("texts")[i].as_buffer(), np.uint16)
        begin = np.flatnonzero(np.concatenate(([True], idx[1:] != idx[:-1]))) if len(idx) else np.zeros(0, np.int64)
        rows = np.zeros(len(texts), _PART_ROW)
        rows["text"], rows["begin"], rows["size"] = texts, begin, np.diff(np.append(begin, len(idx)))
        own = batch.column("marks")[i]
        self.entries.append((block, self.count, self.postings, self.marked if own.is_valid else -1))
        if own.is_valid:
            marks = np.zeros(len(texts), _MARK_ROW)
            marks["n"] = np.frombuffer(batch.column("sizes")[i].as_buffer(), np.uint32)
            marks["marks"] = np.frombuffer(own.as_buffer(), np.uint64).reshape(-1, _MARKS // 64)
            self.marked += len(texts)
            self.marks.write(marks.tobytes())
        self.runs.write(batch.column("runs")[i].as_buffer())
        self.parts.write(rows.tobytes())
        self.postings += len(idx)
        self.count += len(texts)

    def pairs(self, join, threshold: float, hot: np.ndarray, cell: int) -> Iterator[pa.RecordBatch]:
        if not self.count:  # copies alone
            return
        runs, parts, marks = _mapped(self.runs, np.uint32), _mapped(self.parts, _PART_ROW), _mapped(self.marks, _MARK_ROW)
        gone = [np.sort(np.concatenate(self.gone))] if self.gone else []
        # about as many copies of a part as it has runs in its prefix
        cells = max(1, math.ceil(self.postings * (self.postings * (1 - threshold) / max(self.count, 1) + 1) / cell)) if self.postings > cell else 1
        hot = np.unique(hot >> np.uint64(16) << np.uint64(16) & np.uint64(0xFFFFFFFFFFFF))
        entries = np.array(self.entries, np.int64).reshape(-1, 4)

        def of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """(doc, begin, size, mark) of parts by number."""
            block, part, posting, mark = entries[np.searchsorted(entries[:, 1], own, side="right") - 1].T
            rows = parts[own]
            mark = np.where(mark >= 0, mark + own - part, -1)
            return (block << 16) | rows["text"].astype(np.int64), posting + rows["begin"], rows["size"].astype(np.int64), mark

        lists, ends = _scratch(), []
        for at in range(0, self.count, _SLICE):
            _, begin, size, _ = of(np.arange(at, min(at + _SLICE, self.count)))
            first = int(begin[0])
            own = runs[first : first + int(size.sum())].astype(np.uint64) << np.uint64(16)
            where, part, role = _routes(own, begin - first, size, 0, cells, threshold, hot)
            probe = (role & _PROBE) > 0
            where, part = where[probe], part[probe]
            order = np.argsort(where, kind="stable")
            lists.write(part[order].astype(np.uint16).tobytes())  # within the slice
            ends.append(np.searchsorted(where[order], np.arange(cells + 1)))
        held = _mapped(lists, np.uint16)
        starts = np.cumsum([0, *(int(e[-1]) for e in ends)])
        for c in range(cells):
            own = np.concatenate([held[s + e[c] : s + e[c + 1]].astype(np.int64) + k * _SLICE for k, (s, e) in enumerate(zip(starts, ends, strict=False))])
            if len(own) < 2:
                continue
            doc, begin, size, mark = of(own)
            order = np.argsort(doc)
            doc, begin, size, mark = doc[order], begin[order], size[order], mark[order]
            number = np.repeat(np.arange(len(doc)), size)
            take = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - begin, size)
            part = _Part(doc, (runs[take].astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64))
            del number, take

            def marked(mark: np.ndarray = mark) -> tuple[np.ndarray, np.ndarray]:
                n, bits = np.full(len(mark), -1, np.int64), np.zeros((len(mark), _MARKS // 64), np.uint64)
                some = np.flatnonzero(mark >= 0)
                if len(some):
                    found = marks[mark[some]]
                    n[some], bits[some] = found["n"], found["marks"]
                return n, bits

            yield from join(part, gone, marked).to_batches()


_PART_ROW = np.dtype([("begin", np.uint32), ("size", np.uint32), ("text", np.uint16)])  # begin: within the entry
_MARK_ROW = np.dtype([("n", np.uint32), ("marks", np.uint64, _MARKS // 64)])


def _scratch():
    """A file in the executor's scratch folder that goes with its last use."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None, buffering=1 << 16)


def _mapped(file, kind) -> np.ndarray:
    file.flush()
    return np.memmap(file, kind, "r") if os.fstat(file.fileno()).st_size else np.zeros(0, kind)


def _alike(cross: bool, threshold: float):
    """join(part, gone, marked): pairs of parts that are alike enough; gone: sorted texts that take no part."""
    need = threshold / (1 + threshold)

    def join(part: _Part, copies: list[np.ndarray], marked) -> pa.Table:
        side = _side(part) if cross else None
        owner, begin, length = part.by_run()
        cls = _classes(owner, begin, length, side)
        del begin
        upto = part.classes_of(owner, cls)
        np.cumsum(upto, axis=1, out=upto)  # within the type: a row's sum is a text's entries
        size = upto[:, -1].astype(np.int64)
        prefix = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
        cut = (upto >= prefix[:, None]).argmax(1).astype(np.uint8)
        for gone in copies:
            own = part.number(gone)
            cut[own[own >= 0]] = 255
        # entries inside prefixes; 255 marks texts that take no part (copies of another text)
        run_no = np.repeat(np.arange(len(length), dtype=np.int32), length)
        keep = (cls > 0) & (cls <= cut[owner]) & (cut[owner] < 255)
        owner, run_no = owner[keep], run_no[keep]
        if side is not None:  # within a run first the left side, then the right
            order = np.lexsort((side[owner], run_no))
            owner, run_no = owner[order], run_no[order]
        del keep, cls, length
        last = np.searchsorted(run_no, run_no, side="right").astype(np.int32)
        if side is None:
            first = np.arange(len(owner), dtype=np.int32) + np.int32(1)
        else:
            key = run_no * 2 + side[owner]
            first = np.searchsorted(key, run_no * 2 + 1).astype(np.int32)
            last = np.where(side[owner], first, last)
            first = np.where(side[owner], last, first)
        count = last - first
        order = np.argsort(owner, kind="stable").astype(np.int32)
        order = order[count[order] > 0]
        owner_o, first_o, count_o = owner[order], first[order], count[order]
        del last, first, count, run_no
        steps = np.cumsum(count_o, dtype=np.int64)
        likely, at = [], 0
        while at < len(owner_o):
            to = int(np.searchsorted(steps, (steps[at - 1] if at else 0) + _CHUNK, side="right"))
            to = max(to, at + 1)
            while to < len(owner_o) and owner_o[to] == owner_o[to - 1]:  # a text's partners are counted together
                to += 1
            c = count_o[at:to]
            right = np.repeat(first_o[at:to] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
            key = (np.repeat(owner_o[at:to], c).astype(np.uint64) << np.uint64(32)) | owner[right].astype(np.uint64)
            key.sort()
            fresh = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            shared = np.diff(np.append(fresh, len(key)))
            key = key[fresh]
            a, b = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            least = np.minimum(cut[a], cut[b])
            tail = np.minimum(size[a] - upto[a, least], size[b] - upto[b, least])
            likely.append(key[shared + tail >= need * (size[a] + size[b]) - 1e-9])
            at = to
        if not likely:
            return _PAIR_SCHEMA.empty_table()
        del owner, order, owner_o, first_o, count_o, steps, upto, cut
        key = np.concatenate(likely)
        a, b = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        some = _within_reach(*marked(), a, b, need)
        a, b = a[some], b[some]
        ok = _overlaps(*part.by_text(), a, b) >= need * (size[a] + size[b]) - 1e-9
        pairs = (part.docs[a[ok]], part.docs[b[ok]])
        return pa.Table.from_arrays([pa.array(x) for x in pairs], schema=_PAIR_SCHEMA)

    return join


def _pass_c(entries: pa.Table, pairs: pa.Table) -> pa.Table:
    """Partial overlaps of the pairs in this slot; where only the first text is at home here, its part goes on."""
    if not entries.num_rows or not pairs.num_rows:
        return _PART_SCHEMA.empty_table()
    tidy()
    part = _Part.of(_postings(entries))
    held, ends = part.by_text()
    a, b = (pairs.column(k).to_numpy() for k in ("a", "b"))
    x, y = part.number(a), part.number(b)
    both = (x >= 0) & (y >= 0)
    shared = np.zeros(len(a), np.int64)
    shared[both] = _overlaps(held, ends, x[both], y[both])
    some = (shared > 0) | (~both & (x >= 0))
    low = (held & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    parts = [None if done else low[ends[i] : ends[i + 1]].tobytes() for i, done in zip(x[some].tolist(), both[some].tolist(), strict=True)]
    columns = [pairs.column(k).filter(pa.array(some)) for k in _ASKED]
    return pa.Table.from_arrays([*columns, pa.array(shared[some]), pa.array(parts, pa.binary())], schema=_PART_SCHEMA)


def _pass_d(entries: pa.Table, carried: pa.Table) -> pa.Table:
    """Partial overlaps of the parts that were carried here, to the home of the second text."""
    if not entries.num_rows or not carried.num_rows:
        return _PART_SCHEMA.empty_table()
    part = _Part.of(_postings(entries))
    held, ends = part.by_text()
    low = (held & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    y = part.number(carried.column("b").to_numpy())
    shared = np.zeros(carried.num_rows, np.int64)
    for k, (i, own) in enumerate(zip(y.tolist(), carried.column("part"), strict=True)):
        if i >= 0:
            shared[k] = len(np.intersect1d(low[ends[i] : ends[i + 1]], np.frombuffer(own.as_buffer(), np.uint32)))
    columns = [carried.column(k) for k in _ASKED]
    return pa.Table.from_arrays([*columns, pa.array(shared), pa.nulls(len(shared), pa.binary())], schema=_PART_SCHEMA)


def _gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of copies to the bytes of their places."""
    for batch in batches:
        places = [np.sort(np.array(x, np.int64) & 0xFFFF).astype(np.uint16).tobytes() for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(places, pa.binary())], names=["key", "block", "gone"])


def frag_of(runs: np.ndarray, fragments: int) -> np.ndarray:
    return ((runs >> np.uint64(48)) * np.uint64(fragments) >> np.uint64(16)).astype(np.int64)


def of_field(runs: np.ndarray, kind: int) -> np.ndarray:
    """The runs of a kind's field: equal ones of different fields are different runs."""
    return runs ^ np.uint64((kind >> 4) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def hot_runs(texts: DataFrame, total: int, runs_of: RunsOf, rows: int = HOT_ROWS) -> np.ndarray:
    """Runs that several of a bounded sample of texts hold; they only decide where parts meet, not what is found."""
    fields: dict[int, list[str]] = {}
    hashed = texts.withColumn("h", F.xxhash64("id"))
    if total > 2 * rows:  # few more than that leave the tasks
        hashed = hashed.filter(F.col("h") < F.lit(int(-(1 << 63) + (1 << 64) * (1.3 * rows + 50) / total)))
    for r in hashed.orderBy("h").limit(rows).collect():
        fields.setdefault(r["kind"] >> 4, []).append(r["text"])
    found = [of_field(runs_of(own)[0], field << 4) for field, own in fields.items()]
    runs, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
    return runs[count > 2]


def similar_texts(
    texts: DataFrame, threshold: float = 0.8, cross: bool = False, fragments: int = FRAGMENTS, slots: int | None = None, cell: int = CELL, *, runs_of: RunsOf, once: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of texts of at least ``threshold`` likeness.

    texts: id BIGINT, kind INT, text STRING. kind is split + 16 * field: texts of different fields are never
    compared; with ``cross`` only texts of split 0 with those of other splits are, else all are.
    pairs: a, b, likeness DOUBLE between class representatives, split 0 first when ``cross``.
    members: doc, rep, id, kind, extra for every text that has runs; rep is its class, of texts of equal sets and one kind. Pairs
    inside a class are not listed.
    slots: groups of blocks of a fragment; if left out, one for every ``SLOT_BYTES`` of text. cell: postings compared together.
    once: with one slot, texts that are dear to read are worked out once, as what is told of whole blocks is read from the exchange of all entries.
    """
    spark = ship(texts.sparkSession)
    texts = texts.select(F.col("id").cast("long"), F.col("kind").cast("int"), F.col("text").cast("string")).filter("id is not null")
    field = F.shiftright("kind", 4).alias("field")
    lengths = texts.groupBy(field).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("n")).collect()
    if slots is None:
        slots = max(1, -(-sum(r["bytes"] for r in lengths) // SLOT_BYTES))
    # of all texts of a field, so that its blocks agree
    coarse = frozenset(r["field"] for r in lengths if r["bytes"] <= SHORT_BYTES * r["n"])
    hot = hot_runs(texts, sum(r["n"] for r in lengths), runs_of) if slots > 1 else np.zeros(0, np.uint64)
    tasks = fragments * slots
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # with several slots as many partitions as Spark takes by itself, so that no join of them ships the entries again
    parts = min(tasks, parts) if slots == 1 else max(fragments, parts)
    keys = np.array(even_keys(tasks, parts) if slots == 1 else fragment_keys(fragments, slots, parts), np.int32)
    packed = texts.mapInArrow(_entries(keys, slots, coarse, runs_of=runs_of), _ENTRY)
    entries = packed.repartition(parts, "key")
    # behind an exchange, as blocks are numbered by task and a task's number changes where a stage is a union
    whole = entries if once and slots == 1 else entries.filter("ids is not null").select(*_WHOLE)
    docs = whole.mapInArrow(_texts, "doc long, id long, n long, print long, held array<long>, extra binary")
    kind = F.shiftright("doc", 16).bitwiseAND(F.lit((1 << _KIND_BITS) - 1)).cast("int")
    classes = docs.groupBy("print", "n", kind.alias("kind")).agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))
    copied = classes.filter("copies > 1").select("print", "n", "kind", "rep")
    classed = docs.withColumn("kind", kind).join(copied, ["print", "n", "kind"], "left")
    members = classed.select("doc", F.coalesce("rep", "doc").alias("rep"), "id", "kind", "extra")
    # one row for each fragment and slot: fragments and slots are few
    table = spark.createDataFrame([(k, k // slots, k % slots, int(key)) for k, key in enumerate(keys)], "task int, frag int, slot int, key int")
    gone = (
        # to every fragment, as telling which have a part of the text would ship more than the lists
        classed.filter("doc <> rep").groupBy(F.shiftright("doc", 16).alias("block")).agg(F.collect_list("doc").alias("gone"))  # of one block, so few
        .withColumn("slot", F.pmod(F.shiftright("block", _KIND_BITS), F.lit(slots)).cast("int")).join(F.broadcast(table), "slot")
        .select("key", "block", "gone").mapInArrow(_gone, "key int, block long, gone binary")
    )
    if slots == 1:
        found = entries.groupBy("key").cogroup(gone.groupBy("key")).applyInArrow(_pass_b(cross, threshold), "a long, b long").distinct()
    else:
        # one exchange for both passes; packed stands first in the union, so its blocks keep their numbers
        entries = packed.unionByName(gone, allowMissingColumns=True).repartition(parts, "key")
        frags = {int(key): k // slots for k, key in enumerate(keys)}
        found = entries.mapInArrow(_pass_b_cells(frags, cross, threshold, hot, cell), "a long, b long").distinct()
    size = docs.select("doc", "n", "held")
    sized = found.join(size.toDF("a", "na", "ha"), "a").join(size.toDF("b", "nb", "hb"), "b")
    # only the fragments in which both texts have runs
    common = F.expr(f"filter(sequence(0, {fragments - 1}), f -> shiftright(ha[f div 64] & hb[f div 64], cast(f % 64 as int)) & 1 = 1)")
    home = lambda c: F.pmod(F.shiftright(c, 16 + _KIND_BITS), F.lit(slots)).cast("int").alias("slot")
    asked = sized.select("a", "b", "na", "nb", home("a"), F.explode(common).alias("frag")).join(F.broadcast(table), ["frag", "slot"])
    counted = entries.groupBy("key").cogroup(asked.select("key", *_ASKED).groupBy("key")).applyInArrow(_pass_c, _PART)
    if slots > 1:
        # counted is worked out twice, from the same exchanges; a checkpoint would end the plan and ship the entries again
        carried = counted.filter("part is not null").withColumn("slot", home("b")).join(F.broadcast(table), ["frag", "slot"])
        carried = carried.select("key", *_ASKED, "part")
        counted = counted.unionByName(entries.groupBy("key").cogroup(carried.groupBy("key")).applyInArrow(_pass_d, _PART))
    pairs = (
        counted.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
        .withColumn("likeness", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
        .filter(F.col("likeness") >= threshold - 1e-12).select("a", "b", "likeness")
    )
    return pairs, members
