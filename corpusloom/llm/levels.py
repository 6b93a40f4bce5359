"""Reading level of each document (problem 9): gradient-boosted trees over the measures of its sentences.

Every sentence is measured by its length, vocabulary, syntax and cohesion: the number of words and the distribution of
their lengths, the grades of its words in the graded samples and the share of words unknown there, commas, brackets,
hyphens, digits and capitals, and the words it shares with the sentence before. Boosted trees grade the sentences; cut
points that are calibrated on held-out folds turn grades into levels; a document has the level of most of its
sentences, the mean grade deciding ties. Sentences of held-out passages (most of whose five-word runs are an item's) do
not count, and mark-up is taken out first.

``level_accuracy`` tells of samples that took part in nothing: neither trees nor word grades nor cut points saw them,
once in folds of all sources and once without their whole source.

The samples are few and fixed and are read to the driver up to ``MOST_SAMPLES`` rows (a bounded sample to fit on). Held-out
passages of any number are looked up, in shards of ``SHARD`` passages. Documents without a
sentence, null ones included, get the level nearest to the samples' mean. Repeated documents each have a row.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.plain import _TOP, tables
from corpusloom.llm.sentences import _BEFORE
from corpusloom.llm.shingles import _LOW, Layout, batch_runs, plain_batch, runs_of
from corpusloom.llm.trees import BoostedTrees
from corpusloom.session import ship

MOST_SAMPLES = 20_000
SHARD = 20_000
FOLDS = 5
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_END, _COMMA, _BRACKET, _HYPHEN = ".!?…。！？", ",;:、，；：", "()[]（）", "-–/"
_ABBREVIATIONS = [w for w in _BEFORE] + ["v", "vv"]
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("reading_level", pa.int64()), ("grade", pa.float64()), ("sentences", pa.int64())])


def cleaned(texts: list[str | None]) -> list[str]:
    """Plain texts without mark-up."""
    out = []
    for text in texts:
        text = text or ""
        if "<" in text:
            text = _TAG.sub("\n", text)
        if "&" in text:
            text = html.unescape(text)
        out.append(text)
    return plain_batch(out)


def _flags() -> np.ndarray:
    """Kind of each code point: 1 end mark, 2 comma, 3 bracket, 4 hyphen, 5 digit, 6 capital, 7 line break, 8 space."""
    if not hasattr(_flags, "table"):
        table = np.zeros(_TOP + 1, np.uint8)
        for kind, chars in ((1, _END), (2, _COMMA), (3, _BRACKET), (4, _HYPHEN), (7, "\r\n"), (8, " \t")):
            table[[ord(c) for c in chars]] = kind
        for code in range(0x250 + 0x1F00):
            if (c := chr(code)).isdigit():
                table[code] = 5
            elif c.isupper():
                table[code] = 6
        _flags.table = table
    return _flags.table


class Measured:
    """Sentences of a batch of plain texts: owner, and the measures that need no training."""

    def __init__(self, texts: list[str], held_runs: np.ndarray | None = None):
        lay = Layout(texts)
        n = len(lay.begin)
        self.words, self.size = lay.hashed, np.zeros(0)
        if not n:
            self.owner = self.first = np.zeros(0, np.int64)
            self.held = np.zeros(0, bool)
            self.base = np.zeros((0, 13))
            return
        kind = _flags()[lay.codes]
        count = {k: np.concatenate(([0], np.cumsum(kind == k))) for k in range(1, 9)}
        length = lay.end - lay.begin
        capital = kind[lay.begin] == 6
        after = np.append(lay.begin[1:], len(lay.codes))  # the gap after a word reaches to the next one
        gap = {k: count[k][after] - count[k][lay.end] for k in (1, 7, 8)}
        known = np.isin(lay.hashed, _abbreviation_hashes())
        starred = np.append(False, capital[:-1]) & (np.append(-1, lay.owner[:-1]) == lay.owner)
        barred = (known & capital) | ((length == 1) & capital & starred)
        next_capital = np.append(capital[1:], True)
        cut = (gap[1] > 0) & (gap[8] > 0) & next_capital & ~barred | (gap[7] > 0)
        cut |= np.append(lay.owner[1:] != lay.owner[:-1], True)
        first = np.flatnonzero(np.append(True, cut[:-1]))
        last = np.append(first[1:], n) - 1
        self.first, self.owner, self.size = first, lay.owner[first], (last - first + 1).astype(float)
        a, b = lay.begin[first], lay.end[last]
        per = {k: (count[k][b] - count[k][a]) / self.size for k in (2, 3, 4, 5, 6)}
        sentence = np.repeat(np.arange(len(first)), last - first + 1)
        # cohesion: words that the sentence before has as well
        key = (lay.hashed >> np.uint64(24)) ^ (sentence.astype(np.uint64) << np.uint64(40))
        before = (lay.hashed >> np.uint64(24)) ^ ((sentence.astype(np.uint64) + np.uint64(1)) << np.uint64(40))
        before.sort()
        at = np.minimum(np.searchsorted(before, key), n - 1)
        shared = np.add.reduceat((before[at] == key).astype(float), first) / self.size
        self.base = np.stack(
            [
                self.size, np.add.reduceat(length, first) / self.size, np.maximum.reduceat(length, first),
                np.add.reduceat((length > 6).astype(float), first) / self.size, *per.values(), shared,
                (count[1][b] - count[1][a]) / self.size,
                np.add.reduceat((length > 9).astype(float), first) / self.size, self._spread(length, first),
            ],
            1,
        )
        self.held = np.zeros(len(first), bool)
        if held_runs is not None and len(held_runs) and n >= 5:
            runs, _ = runs_of(lay.hashed, np.zeros(n, np.int64))
            runs &= ~_LOW  # as the held-out runs are kept
            at = np.minimum(np.searchsorted(held_runs, runs), len(held_runs) - 1)
            hit = np.zeros(n)
            hit[: len(runs)] = held_runs[at] == runs
            total = np.concatenate(([0], np.cumsum(hit)))
            upto = np.maximum(last - 3, first + 1)  # runs that begin and end inside the sentence
            self.held = (total[upto] - total[first]) >= 0.5 * np.maximum(upto - first, 1)


    def _spread(self, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Standard deviation of the words' lengths."""
        mean = np.add.reduceat(length, first) / self.size
        return np.sqrt(np.maximum(np.add.reduceat(length.astype(float) ** 2, first) / self.size - mean**2, 0))


def _abbreviation_hashes() -> np.ndarray:
    if not hasattr(_abbreviation_hashes, "value"):
        _abbreviation_hashes.value = np.sort(Layout([" ".join(_ABBREVIATIONS)]).hashed)
    return _abbreviation_hashes.value


class Grader:
    """Trained on graded samples: the words' grades, the trees and the cut points."""

    def __init__(self, texts: list[str | None], levels: list[int]):
        ready, levels = cleaned(texts), np.array(levels, float)
        measured = Measured(ready)
        fold = np.arange(len(ready)) % FOLDS
        y = levels[measured.owner] if len(levels) else np.zeros(0)
        grade = np.zeros(len(y))
        for k in range(FOLDS):
            out = fold[measured.owner] == k
            if out.any() and (~out).any():
                self._learn(measured, y, ~out)
                grade[out] = self.trees.predict(self._features(measured)[out])
        self.levels = np.unique(levels).astype(int) if len(levels) else np.array([1])
        self.cuts = self._calibrate(grade, measured, levels)
        self._learn(measured, y, np.ones(len(y), bool))
        self.mean = float(levels.mean()) if len(levels) else 1.0

    def _learn(self, m: Measured, y: np.ndarray, use: np.ndarray) -> None:
        """Grades of words, leaving each sentence's own text out of its words' grades, then trees."""
        sentence = np.repeat(np.arange(len(m.size)), m.size.astype(int))
        text = m.owner[sentence]
        keep = use[sentence]
        self.mid = float(y[use].mean()) if use.any() else 0.0
        self.vocabulary, place = np.unique(m.words[keep], return_inverse=True)
        gain = y[sentence[keep]] - self.mid
        total, n = np.bincount(place, gain, len(self.vocabulary)), np.bincount(place, minlength=len(self.vocabulary))
        self.word_grade = total / (n + 0.5)
        # without the text itself
        own = text[keep] * np.int64(len(self.vocabulary) + 1) + place
        _, inverse, times = np.unique(own, return_inverse=True, return_counts=True)
        times = times[inverse]
        others = (total[place] - gain * times) / (n[place] - times + 0.5)
        known = n[place] > times
        features = self._features(m, use, others, known)
        self.trees = BoostedTrees().fit(features, y[use])

    def _features(self, m: Measured, use: np.ndarray | None = None, grades: np.ndarray | None = None, known: np.ndarray | None = None) -> np.ndarray:
        if not len(m.size):
            return np.zeros((0, m.base.shape[1] + 4))
        if use is None:
            at = np.minimum(np.searchsorted(self.vocabulary, m.words), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == m.words if len(self.vocabulary) else np.zeros(len(m.words), bool)
            grades, size, base = (np.where(known, self.word_grade[at], 0.0) if known.any() else np.zeros(len(known))), m.size, m.base
        else:
            size, base = m.size[use], m.base[use]
            grades = np.where(known, grades, 0.0)
        first = np.concatenate(([0], np.cumsum(size.astype(int))[:-1]))
        known = known.astype(float)
        return np.column_stack(
            [
                base, np.add.reduceat(grades, first) / size, np.minimum.reduceat(grades, first),
                np.maximum.reduceat(grades, first), 1 - np.add.reduceat(known, first) / size,
            ]
        )

    def _calibrate(self, grade: np.ndarray, m: Measured, levels: np.ndarray) -> np.ndarray:
        """Cut points between levels that make most samples' votes right on held-out folds; the middle on ties."""
        cuts = (self.levels[:-1] + self.levels[1:]) / 2.0
        self.cuts = cuts
        for _ in range(2):
            for k in range(len(cuts)):
                tried = []
                for shift in np.arange(-0.3, 0.31, 0.05):
                    self.cuts = cuts.copy()
                    self.cuts[k] = (self.levels[k] + self.levels[k + 1]) / 2.0 + shift
                    right = (self._vote(grade, m.owner, len(levels), np.ones(len(grade), bool))[0] == levels).mean()
                    tried.append((right, -abs(shift), self.cuts[k]))
                cuts[k] = max(tried)[2]
        return cuts

    def _vote(self, grade: np.ndarray, owner: np.ndarray, texts: int, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        level = np.searchsorted(self.cuts, grade, side="left")
        n = np.bincount(owner[use], minlength=texts)
        k = len(self.levels)
        votes = np.bincount(owner[use] * k + level[use], minlength=texts * k).reshape(texts, k).astype(float)
        mean = np.bincount(owner[use], grade[use], texts) / np.maximum(n, 1)
        mean = np.where(n > 0, mean, getattr(self, "mean", self.levels.mean()))
        votes -= np.abs(self.levels[None, :] - mean[:, None]) * 1e-3  # ties
        return self.levels[votes.argmax(1)], mean, n

    def grade(self, texts: list[str | None], held_runs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(level, mean grade, sentences that count) of every text."""
        m = Measured(cleaned(texts), held_runs)
        use = ~m.held
        every = np.bincount(m.owner[use], minlength=len(texts)) == 0
        if len(m.owner):
            use |= every[m.owner]  # a text of held-out sentences alone is graded by them
        return self._vote(self.trees.predict(self._features(m)), m.owner, len(texts), use)


def _grade(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grader, held = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                own = held
                if batch.num_columns > 2:  # runs that earlier shards knew
                    known = [np.frombuffer(x, np.uint64) for x in piece.column(2).to_pylist() if x]
                    own = np.unique(np.concatenate([held, *known]))
                level, mean, n = grader.grade(piece.column(1).to_pylist(), own)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(level, pa.int64()), pa.array(mean), pa.array(n, pa.int64())], schema=_SCHEMA
                )

    return run


def _look_up(shard):
    """Adds the runs of each document that the shard's passages hold to those found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shard.value
        for batch in batches:
            before = batch.column(2).to_pylist()
            lay = Layout(cleaned(batch.column(1).to_pylist()))
            runs, owner = runs_of(lay.hashed, lay.owner)
            runs = runs & ~_LOW
            hit = held[np.minimum(np.searchsorted(held, runs), len(held) - 1)] == runs if len(held) else np.zeros(len(runs), bool)
            runs, owner = runs[hit], owner[hit]
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            after = [x + runs[i:j].tobytes() for x, i, j in zip(before, ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(after, pa.binary())], names=["doc_id", "text", "held"])

    return run


def _samples(samples: DataFrame, *more: str) -> list:
    columns = ("sample_id", "text", F.col("reading_level").cast("long").alias("reading_level"), *more)
    rows = samples.select(*columns).orderBy("sample_id").limit(MOST_SAMPLES).collect()
    return [r for r in rows if r["reading_level"] is not None]


def reading_levels(
    documents: DataFrame, samples: DataFrame, held_out: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD
) -> DataFrame:
    """(id_col, reading_level, grade, sentences) of every document."""
    spark = ship(documents.sparkSession)
    rows = _samples(samples)
    grader = Grader([r["text"] for r in rows], [r["reading_level"] for r in rows])
    narrow = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    held = None
    if held_out is not None:
        shards = max(1, -(-held_out.count() // shard))
        place = F.pmod(F.xxhash64("text"), F.lit(shards))
        if shards > 1:
            narrow = narrow.withColumn("held", F.lit(b""))
        for k in range(shards):
            passages = [r["text"] for r in held_out.filter(place == k).select("text").collect()]
            held = np.unique(batch_runs(passages)[0])
            if k + 1 < shards:
                narrow = narrow.mapInArrow(_look_up(spark.sparkContext.broadcast(held)), "doc_id long, text string, held binary")
    model = spark.sparkContext.broadcast((grader, held))
    out = narrow.mapInArrow(_grade(model), "doc_id long, reading_level long, grade double, sentences long")
    return out.withColumnRenamed("doc_id", id_col)


def level_accuracy(samples: DataFrame, source_col: str = "lang") -> DataFrame:
    """(source, samples, right, right_unseen): samples whose level comes out right by source.

    right: by a grader that was fitted and calibrated on the other folds, which hold all sources. right_unseen: by one
    that saw no sample of the source at all.
    """
    rows = _samples(samples, source_col)
    texts, levels = [r["text"] for r in rows], np.array([r["reading_level"] for r in rows], np.int64)
    sources = np.array([str(r[source_col]) for r in rows])
    right, unseen = np.zeros(len(rows), bool), np.zeros(len(rows), bool)

    def test(out: np.ndarray, result: np.ndarray) -> None:
        if out.any() and (~out).any():
            grader = Grader([t for t, o in zip(texts, out, strict=True) if not o], levels[~out].tolist())
            result[out] = grader.grade([t for t, o in zip(texts, out, strict=True) if o])[0] == levels[out]

    place = np.zeros(len(rows), np.int64)  # folds take from every source and level in turn
    for s in np.unique(sources):
        for level in np.unique(levels):
            own = np.flatnonzero((sources == s) & (levels == level))
            place[own] = np.arange(len(own)) % FOLDS
    for k in range(FOLDS):
        test(place == k, right)
    for s in np.unique(sources):
        test(sources == s, unseen)
    found = [(s, int((sources == s).sum()), int(right[sources == s].sum()), int(unseen[sources == s].sum())) for s in np.unique(sources).tolist()]
    return samples.sparkSession.createDataFrame(found, f"{source_col} string, samples long, right long, right_unseen long")
