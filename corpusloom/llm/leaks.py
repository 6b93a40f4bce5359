"""Evaluation texts leaking into training text (problem 8): a BM25 index of the items, searched by block-max WAND.

The held-out items are indexed by their five-word runs: postings in the order of the items with BM25 weights, and for
each block of items the largest weight. Every document is a query. As the runs of a document count once, an item of
which a share ``least`` is held has a score of at least the sum of its lightest weights; that sum is the item's
threshold, so retrieving all items above their thresholds loses none. A document whose terms' largest weights together
stay below every threshold is left at once. For the others cursors run over the postings: the pivot is the first item
whose cursors' largest weights can reach a threshold; cursors before it skip there, and whole blocks are skipped
where the blocks' largest weights cannot reach the block's lowest threshold. What is retrieved is verified by the number
of runs that it shares.

The items are cut into shards of at most about ``shard_bytes`` of text; each shard's index goes to every task once and
all documents are searched in it, so the size of an index in memory is bounded and any number of items is handled
alike. Scores use the statistics of the shard.

Null, empty and very short texts hold no item; an item under five words has no runs and leaks nowhere; repeated
documents each have their rows. Items with a null id are left out; of items with equal ids each is searched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shingles import batch_runs
from corpusloom.session import ship

K1, B = 1.2, 0.75
ITEMS_A_BLOCK = 16
SHARD_BYTES = 16 << 20  # of item text; an index has some 12 times that
_EPS = 1e-9
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("held", pa.int64()), ("score", pa.float64())])


class ItemIndex:
    """Inverted index of the items' runs with BM25 weights, block maxima and lossless thresholds."""

    def __init__(self, ids: list[int], texts: list[str | None], least: float):
        runs, owner = batch_runs(texts)
        self.ids = np.array(ids, np.int64)
        self.size = np.bincount(owner, minlength=len(ids))
        order = np.argsort(runs, kind="stable")
        runs, self.item = runs[order], owner[order]
        self.terms, self.begin, df = np.unique(runs, return_index=True, return_counts=True)
        self.count = df
        n = max(1, int((self.size > 0).sum()))
        mean = max(1.0, float(self.size[self.size > 0].mean())) if (self.size > 0).any() else 1.0
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = (K1 + 1) / (1 + K1 * (1 - B + B * self.size / mean))
        self.weight = np.repeat(idf, df) * norm[self.item]
        # an item's threshold: the lightest weights that make up the share
        self.need = np.ceil(least * self.size - 1e-9).astype(np.int64)
        self.threshold = np.full(len(ids), np.inf)
        by_item = np.lexsort((self.weight, self.item))
        ends = np.searchsorted(self.item[by_item], np.arange(len(ids) + 1))
        for i in range(len(ids)):
            if self.size[i]:
                self.threshold[i] = self.weight[by_item[ends[i] : ends[i] + max(1, self.need[i])]].sum()
        # block maxima of every term
        block = self.item // ITEMS_A_BLOCK
        term = np.repeat(np.arange(len(df)), df)
        self.blocks = -(-len(ids) // ITEMS_A_BLOCK)
        key, first = np.unique(term * max(1, self.blocks) + block, return_index=True)
        self.block_of, self.block_max = key % max(1, self.blocks), np.maximum.reduceat(self.weight, first) if len(first) else first
        self.block_begin = np.searchsorted(key // max(1, self.blocks), np.arange(len(df) + 1))
        self.top = np.maximum.reduceat(self.weight, self.begin) if len(df) else np.zeros(0)
        self.block_need = np.array([self.threshold[b * ITEMS_A_BLOCK : (b + 1) * ITEMS_A_BLOCK].min() for b in range(self.blocks)])
        self.lowest = float(self.threshold.min()) if len(ids) else np.inf
        self.postings = self.read = 0  # of the terms searched for, and of those what was read

    def search(self, runs: np.ndarray, owner: np.ndarray, docs: int) -> list[tuple[int, int, int, float]]:
        """(document, item place, runs held, score) of all items of which the documents hold the share."""
        found: list[tuple[int, int, int, float]] = []
        if not len(self.terms) or not len(runs):
            return found
        at = np.minimum(np.searchsorted(self.terms, runs), len(self.terms) - 1)
        hit = self.terms[at] == runs
        term, doc = at[hit], owner[hit]
        keep = (np.bincount(doc, self.top[term], docs) >= self.lowest - _EPS)[doc]
        term, doc = term[keep], doc[keep]
        order = np.argsort(doc, kind="stable")
        term, doc = term[order], doc[order]
        if not len(doc):
            return found
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        for a, b in zip(first, np.append(first[1:], len(doc)), strict=True):
            found += [(int(doc[a]), *x) for x in self.retrieve(term[a:b])]
        return found

    def retrieve(self, terms: np.ndarray) -> list[tuple[int, int, float]]:
        """(item place, runs held, score) of the items above their thresholds, by block-max WAND."""
        cursors = []  # [item, place in the postings, items, weights, largest weight, largest weight by block]
        for t in terms.tolist():
            a, b = self.begin[t], self.begin[t] + self.count[t]
            c, d = self.block_begin[t], self.block_begin[t + 1]
            items = self.item[a:b].tolist()
            blocks = dict(zip(self.block_of[c:d].tolist(), self.block_max[c:d].tolist(), strict=True))
            cursors.append([items[0], 0, items, self.weight[a:b].tolist(), float(self.top[t]), blocks])
            self.postings += len(items)
        found = []
        while cursors:
            cursors.sort(key=itemgetter(0))
            most, p = 0.0, -1
            for p, cursor in enumerate(cursors):
                most += cursor[4]
                if most >= self.lowest - _EPS:
                    break
            else:
                break  # no item that is left can reach any threshold
            pivot = cursors[p][0]
            while p + 1 < len(cursors) and cursors[p + 1][0] == pivot:
                p += 1
            block = pivot // ITEMS_A_BLOCK
            if sum(c[5].get(block, 0.0) for c in cursors[: p + 1]) < self.block_need[block] - _EPS:
                to = (block + 1) * ITEMS_A_BLOCK
                if p + 1 < len(cursors):
                    to = min(to, cursors[p + 1][0])
            elif cursors[0][0] == pivot:
                score, held = sum(c[3][c[1]] for c in cursors[: p + 1]), p + 1
                self.read += held
                if score >= self.threshold[pivot] - _EPS and held >= self.need[pivot]:
                    found.append((pivot, held, score))
                to = pivot + 1
            else:
                to = pivot
            ended = False
            for c in cursors[: p + 1]:
                if c[0] < to:
                    c[1] = bisect_left(c[2], to, c[1] + 1)
                    if c[1] < len(c[2]):
                        c[0] = c[2][c[1]]
                    else:
                        c[0], ended = -1, True
            if ended:
                cursors = [c for c in cursors if c[0] >= 0]
        return found


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                piece = batch.slice(at, 2000)
                runs, owner = batch_runs(piece.column(1).to_pylist())
                found = own.search(runs, owner, piece.num_rows)
                doc, item, held, score = ([x[k] for x in found] for k in range(4))
                ids = piece.column(0).take(pa.array(doc, pa.int64()))
                columns = [ids, pa.array(own.ids[item], pa.int64()), pa.array(held, pa.int64()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

    return run


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
    least: float = 0.4, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(doc_id, item_id, held, score): documents that hold at least ``least`` of an item's five-word runs anywhere."""
    spark = ship(documents.sparkSession)
    narrow = documents.select(F.col(f"`{doc_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    asked = asked.filter("item_id is not null and text is not null")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    shards = max(1, -(-size // shard_bytes))
    out = []
    for k in range(shards):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k).collect()
        index = ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], least)
        out.append(narrow.mapInArrow(_search(spark.sparkContext.broadcast(index)), "doc_id long, item_id long, held long, score double"))
    return reduce(DataFrame.unionByName, out)


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, item_kind, documents) of every item, leaked or not."""
    n = found.groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id", "item_kind").join(n, "item_id", "left").fillna(0, ["documents"])
