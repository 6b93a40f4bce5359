"""Subject area of each document (problem 4): one-versus-rest linear classifiers on hashed word n-grams.

Sentences are the unit. Weak labels come from the metadata: the titles and scope notes of the areas, with a few keywords
for the languages that those lack. They only start the training: a mixture model of areas and of neutral text is then
fitted to all sentences of a bounded sample by what stands together in a document, its summary included, so that most
labels come from their neighbours and not from the keywords. One classifier per area learns these labels over hashed
words and word pairs, and character pairs where a script has no spaces. Its threshold is calibrated on sentences of
documents that it did not see and that hold no keyword. A sentence may be of several areas; a document has every area
that at least ``share`` of its sentences are about.

Null, blank and stub documents (fewer than ``STUB`` words and one sentence) have no areas; neutral sentences count
in the whole but for no area; texts are read whole; repeated documents each have their rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.area_words import KEYWORDS
from corpusloom.llm.defects import Languages
from corpusloom.llm.plain import WORD, plain_form
from corpusloom.llm.sentences import Boundaries, fit, sample_rows
from corpusloom.llm.shingles import Layout, plain_batch, runs_of
from corpusloom.session import ship

FIT_ROWS = 3000
STUB = 8
BITS = 16
TOGETHER = 0.005
LONG = 50  # sentences that a document counts for in the fit, at most
_SCHEMA = pa.schema([("id", pa.int64()), ("area_code", pa.string()), ("share", pa.float64())])


def sentence_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, owner) of the n-grams of plain sentences, sorted by owner: words, word pairs, character pairs."""
    lay = Layout(texts)
    if not len(lay.codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs, pair_owner = runs_of(lay.hashed, lay.owner, 2)
    codes = lay.codes.astype(np.uint64)
    close = ((codes >= 0xE00) & (codes < 0xE80)) | ((codes >= 0x3040) & (codes < 0xA000))
    at = np.flatnonzero(close[:-1] & close[1:])
    chars = (codes[at] * np.uint64(0x9E3779B97F4A7C15) + codes[at + 1]) * np.uint64(0xBF58476D1CE4E5B9)
    char_owner = np.searchsorted(lay.starts, at, side="right") - 1
    digit = (lay.codes[lay.begin] >= 0x30) & (lay.codes[lay.begin] < 0x3A)
    hashed = np.concatenate((lay.hashed[~digit], pairs, chars))
    owner = np.concatenate((lay.owner[~digit], pair_owner, char_owner))
    bucket = (hashed >> np.uint64(64 - BITS)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


def keywords_of(areas: list[tuple[str, str | None, str | None]], more: dict[str, str] = KEYWORDS) -> dict[str, set[str]]:
    """Keywords by area from (code, title, scope note): word pairs of a title, longer words of a note; shared ones are left out."""
    found: dict[str, set[str]] = {}
    for code, title, note in areas:
        own = {w.strip() for w in more.get(code, "").split(";") if w.strip()}
        words = WORD.findall(plain_form(title or "").lower())
        own |= {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if len(a) > 2 and len(b) > 1}
        own |= {w.rstrip("s") for w in WORD.findall(plain_form(note or "").lower()) if len(w) > 5}
        found[code] = own
    count: dict[str, int] = {}
    for own in found.values():
        for w in own:
            count[w] = count.get(w, 0) + 1
    return {code: {w for w in own if count[w] == 1} for code, own in found.items()}


def keyword_hits(
    sentences: list[str], names: list[str], keywords: dict[str, set[str]], document: np.ndarray, language: np.ndarray
) -> np.ndarray:
    """How many keywords of each area every sentence holds; a keyword begins a word where words are told apart.

    A single keyword says little, as it may be a common word of something else: an area counts in a language only if
    two of its keywords stand in one document in at least ``TOGETHER`` of the language's documents.
    """
    import ahocorasick

    finder = ahocorasick.Automaton()
    for k, name in enumerate(names):
        for phrase in keywords.get(name, ()):
            finder.add_word(phrase, (phrase, bool(re.match(r"[A-Za-zÀ-ɏḀ-ỿ]", phrase)), k))
    out = np.zeros((len(sentences), len(names)))
    if not len(finder):
        return out
    finder.make_automaton()
    held: dict[tuple[str, int, int], set[str]] = {}
    for i, sentence in enumerate(sentences):
        low = sentence.lower()
        for last, (phrase, spaced, k) in finder.iter(low):
            if not spaced or last < len(phrase) or not low[last - len(phrase)].isalnum():
                out[i, k] += 1
                held.setdefault((language[i], int(document[i]), k), set()).add(phrase)
    for code in np.unique(language):
        documents = len(np.unique(document[language == code]))
        for k in range(len(names)):
            together = sum(len(w) > 1 for (own, _, area), w in held.items() if own == code and area == k)
            if together < max(2, TOGETHER * documents):
                out[language == code, k] = 0
    return out


def neighbour_labels(
    bucket: np.ndarray, owner: np.ndarray, document: np.ndarray, hits: np.ndarray, rounds: int = 25, seed_weight: float = 2.0
) -> np.ndarray:
    """Share of each area, and of neutral text in the last column, in every sentence of one language.

    A mixture of one word distribution for each area and one of neutral text, with each document's own shares of the
    areas, fitted by expectation maximization from the sentences that hold keywords.
    """
    n, k = hits.shape
    if not n or not hits.any():
        return np.zeros((n, k + 1))
    if len(used := np.flatnonzero(hits.any(0))) < k:  # areas that the language has not
        out = np.zeros((n, k + 1))
        out[:, [*used, k]] = neighbour_labels(bucket, owner, document, hits[:, used], rounds, seed_weight)
        return out
    some, place = np.unique(bucket, return_inverse=True)
    width = len(some)
    size = np.maximum(np.bincount(owner, minlength=n), 1)
    weight = (1 / np.sqrt(size)[owner]).astype(np.float32)  # n-grams of a sentence are not independent
    share = np.zeros((n, k + 1))
    share[:, :k] = hits / np.maximum(hits.sum(1, keepdims=True), 1)
    around = np.zeros((document.max() + 1, k))
    np.add.at(around, document, share[:, :k])
    around /= np.maximum(around.sum(1, keepdims=True), 1)
    none = hits.sum(1) == 0
    share[none, :k] = 0.5 * around[document[none]]  # at first the rest is half of what its document is about
    share[:, k] = 1 - share[:, :k].sum(1)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    length = np.bincount(document, minlength=len(around))
    counted = np.minimum(1, LONG / np.maximum(length, 1))[document][owner]  # so that no long document makes a word distribution
    for step in range(rounds):
        theta = np.stack([np.bincount(place, share[owner, c] * counted, width) for c in range(k + 1)], 1)
        theta = np.log((theta + 0.05) / (theta.sum(0) + 0.05 * width)).astype(np.float32)
        near = np.zeros_like(around)
        np.add.at(near, document, share[:, :k])
        near = (near + 0.05) / (length + 0.05 * k)[:, None]
        general = share[:, k].mean()
        prior = np.log(np.column_stack((near[document], np.full(n, max(general, 0.02)))))
        like = np.zeros((n, k + 1))
        if len(first):
            like[owner[first]] = np.add.reduceat(theta[place] * weight[:, None], first, axis=0)
        score = like * min(3.0, 1.0 + 0.15 * step) + prior
        score[:, :k] += seed_weight * np.minimum(hits, 2)
        score -= score.max(1, keepdims=True)
        share = np.exp(score)
        share /= share.sum(1, keepdims=True)
    return share


class AreaModel:
    """Fitted one-versus-rest classifiers with their thresholds."""

    def __init__(self, sentences: list[str], target: np.ndarray, fold: np.ndarray, check: np.ndarray, names: list[str], rounds: int = 20, rate: float = 2.0):
        """target: share of each area in every sentence; fold: sentences kept out of training; check: those of them to calibrate on."""
        self.names = names
        k = len(names)
        bucket, owner = sentence_features(sentences)
        n = np.maximum(np.bincount(owner, minlength=len(sentences)), 1)
        scale = (1 / np.sqrt(n))[owner]
        size = 1 << BITS
        self.weights = np.zeros((size, k))
        y = target
        self.bias = np.full(k, -2.0)
        train = ~fold
        keep = train[owner]
        b, o, sc = bucket[keep], owner[keep], scale[keep]
        square = np.full((size, k), 1e-3)
        for _ in range(rounds if train.any() else 0):
            score = self._sum(self.weights, b, o, sc, len(sentences)) + self.bias
            gap = (1 / (1 + np.exp(-score)) - y) * train[:, None]
            for c in range(k):
                grad = np.bincount(b, gap[o, c] * sc, size) / max(1, int(train.sum())) * 100 + 1e-4 * self.weights[:, c]
                square[:, c] += grad**2
                self.weights[:, c] -= rate * 0.5 * grad / np.sqrt(square[:, c])
            self.bias -= 0.5 * gap.mean(0)
        # thresholds on sentences kept out: the cut with the best F1, nearest to one half on ties
        self.threshold, self.held_out = np.full(k, 0.5), 0.0
        if check.any():
            own = check[owner]
            score = self._sum(self.weights, bucket[own], owner[own], scale[own], len(sentences)) + self.bias
            p, wanted = 1 / (1 + np.exp(-score[check])), y[check] > 0.5
            for c in range(k):
                tried = []
                for cut in np.arange(0.2, 0.81, 0.05):
                    hit = p[:, c] >= cut
                    good = (hit & wanted[:, c]).sum()
                    tried.append((2 * good / max(1, hit.sum() + wanted[:, c].sum()), -abs(cut - 0.5), cut))
                self.threshold[c] = max(tried)[2]
            self.held_out = float(((p >= self.threshold) == wanted).all(1).mean())
        self.weights = self.weights.astype(np.float32)

    @staticmethod
    def _sum(weights: np.ndarray, bucket: np.ndarray, owner: np.ndarray, scale: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, weights.shape[1]))
        if len(bucket):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            out[owner[first]] = np.add.reduceat(weights[bucket], first, axis=0) * scale[first][:, None]
        return out

    def about(self, sentences: list[str]) -> np.ndarray:
        """Whether each sentence is about each area."""
        if not sentences:
            return np.zeros((0, len(self.names)), bool)
        bucket, owner = sentence_features(sentences)
        n = np.maximum(np.bincount(owner, minlength=len(sentences)), 1)
        score = self._sum(self.weights, bucket, owner, (1 / np.sqrt(n))[owner], len(sentences)) + self.bias
        return 1 / (1 + np.exp(-score)) >= self.threshold


def fit_areas(
    records: list[tuple[str | None, ...]], areas: list[tuple[str, str | None, str | None]], more: dict[str, str] = KEYWORDS
) -> tuple[Boundaries, AreaModel]:
    """records: the texts of each document (its article and summary); areas: (code, title, scope note)."""
    names = [code for code, *_ in areas]
    splitter = fit([t for r in records for t in r])
    texts = [[plain_form(t or "") for t in r] for r in records]
    speech = Languages([t for r in texts for t in r])
    sentences, document, language = [], [], []
    for d, r in enumerate(texts):
        for t in r:
            units = splitter.sentences(t, plain=True)
            sentences += units
            document += [d] * len(units)
            language += [speech.of(t) or ""] * len(units)
    doc, tongue = np.array(document, np.int64), np.array(language)
    hits = keyword_hits(sentences, names, keywords_of(areas, more), doc, tongue)
    share = np.zeros((len(sentences), len(names) + 1))
    for code in np.unique(tongue):
        own = np.flatnonzero(tongue == code)
        bucket, owner = sentence_features([sentences[i] for i in own])
        share[own] = neighbour_labels(bucket, owner, doc[own], hits[own])
    sure = np.flatnonzero(share.max(1) >= 0.7)
    fold = doc[sure] % 5 == 4
    check = fold & (hits[sure].sum(1) == 0)
    return splitter, AreaModel([sentences[i] for i in sure], share[sure, :-1], fold, check, names)


def _assign(model, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, areas = model.value
        names, k = areas.names, len(areas.names)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                texts = plain_batch(piece.column(1).to_pylist())
                units = [splitter.sentences(t, plain=True) for t in texts]
                counts = np.array([len(u) for u in units])
                stub = np.array([len(u) < 2 and len(t.split()) < STUB and len(t) < 40 for u, t in zip(units, texts, strict=True)], bool)
                owner = np.repeat(np.arange(len(units)), counts)
                about = areas.about([s for u in units for s in u])
                unit, area = np.nonzero(about)
                hits = np.bincount(owner[unit] * k + area, minlength=len(units) * k).reshape(len(units), k)
                part = hits / np.maximum(counts, 1)[:, None]
                doc, area = np.nonzero((part >= share - 1e-9) & ~stub[:, None])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array(doc)), pa.array([names[a] for a in area], pa.string()), pa.array(part[doc, area])],
                    schema=_SCHEMA,
                )

    return run


def subject_areas(
    records: DataFrame, areas: DataFrame, id_col: str = "pair_id", text_col: str = "article", share: float = 0.25,
    more_cols: tuple[str, ...] = ("summary",), more: dict[str, str] = KEYWORDS, rows: int = FIT_ROWS,
) -> DataFrame:
    """(id_col, area_code, share): the areas of each document and the share of its sentences about them.

    areas: (area_code, title_vi, scope_note), a closed list small enough for the driver. more_cols: further texts of a
    document that the fit learns from. more: keywords by area. rows: documents to fit on, at most.
    """
    spark = ship(records.sparkSession)
    table = [tuple(r) for r in areas.select("area_code", "title_vi", "scope_note").orderBy("area_code").collect()]
    columns = [text_col, *(c for c in more_cols if c in records.columns)]
    model = fit_areas([tuple(r)[1:] for r in sample_rows(records, id_col, columns, rows)], table, more)
    narrow = records.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = narrow.mapInArrow(_assign(spark.sparkContext.broadcast(model), share), "id long, area_code string, share double")
    return out.withColumnRenamed("id", id_col)
