"""Near-duplicate articles: candidates that share a bottom-k hash, exact Jaccard, greedy survivors in order.

Everything works on distinct canonical keys: rows of equal key share their fate, because a row is only compared
with kept rows of other keys. Pairs come from the vertical join of the shingles (``vertical.py``), which ships every shingle
once and loses no pair; the shared bottom-k hash is then required as well, so the result is that of a bottom-k index.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from corpusloom.functions import text as T
from corpusloom.operators.splits import TEST_FIRST, rank_of
from corpusloom.operators.vertical import similar_texts
from corpusloom.session import checkpoint, ship

BOTTOM_K = 32
_HASH = 16  # bytes of a key's hash


def distinct_texts(keyed: DataFrame, priority: tuple[str, ...] = TEST_FIRST) -> DataFrame:
    """(key, first) of every distinct canonical key: first is the (rank, row_ord) of its first row."""
    at = F.struct(rank_of(F.col("split"), priority).alias("rank"), F.col("row_ord"))
    return keyed.select(F.col("article_key").alias("key"), at.alias("at")).groupBy("key").agg(F.min("at").alias("first"))


def with_shingles(texts: DataFrame) -> DataFrame:
    ship(texts.sparkSession)
    return texts.withColumn("sh", T.key_shingles(F.col("key"))).withColumn("n", F.size("sh"))


def key_runs(keys: list[str | None], k: int = BOTTOM_K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs, owner, extra) of canonical keys for the vertical join: shingles with their CRC in the bits that it keeps.

    extra: the hash of the key (``T.key_hash``) and its bottom-k shingles, a text with fewer repeats its first.
    """
    sets = [np.array(T.shingles_of(key), np.uint64) for key in keys]
    crc = np.concatenate([np.zeros(0, np.uint64), *sets])
    mixed = crc * np.uint64(0x9E3779B97F4A7C15)
    runs = (mixed >> np.uint64(48) << np.uint64(48)) | (crc << np.uint64(16)) | (mixed >> np.uint64(32) & np.uint64(0xFFFF))
    extra = np.zeros((len(keys), _HASH + 4 * k), np.uint8)
    for row, key, own in zip(extra, keys, sets, strict=True):
        if len(own):
            least = np.full(k, own[0], np.uint32)
            least[: len(own)] = own[:k]
            row[:_HASH] = np.frombuffer(hashlib.md5(key.encode()).digest(), np.uint8)
            row[_HASH:] = least.view(np.uint8)
    return runs, np.repeat(np.arange(len(keys)), [len(own) for own in sets]), extra


@pandas_udf(BooleanType())
def _share_least(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two texts have one of their bottom-k shingles in common; both by their extra."""
    least = lambda x: np.frombuffer(x, np.uint32, offset=_HASH)
    return pd.Series([bool(np.isin(least(x), least(y)).any()) for x, y in zip(a, b, strict=True)], dtype=bool)


def similar_classes(keyed: DataFrame, threshold: float, priority: tuple[str, ...] = TEST_FIRST, k: int = BOTTOM_K) -> tuple[DataFrame, DataFrame]:
    """(pairs, own): classes of equal shingle sets within a split that are alike, and the distinct keys with shingles.

    pairs: a, b, likeness. own: hash of the key, first, rep (its class). Keys of one class have a likeness of 1 and are not listed.
    """
    texts = keyed.select(F.col("row_ord").alias("id"), rank_of(F.col("split"), priority).alias("kind"), F.col("article_key").alias("text"))
    pairs, members = similar_texts(texts, threshold, runs_of=partial(key_runs, k=k), once=True)
    extra = members.select("doc", "extra")
    pairs = pairs.filter(F.col("likeness") >= threshold).join(extra.toDF("a", "xa"), "a").join(extra.toDF("b", "xb"), "b")
    pairs = pairs.filter(_share_least("xa", "xb")).select("a", "b", "likeness")
    named = members.select(F.substring("extra", 1, _HASH).alias("hash"), F.struct(F.col("kind").alias("rank"), F.col("id").alias("row_ord"), "rep").alias("at"))
    own = named.groupBy("hash").agg(F.min("at").alias("at"))
    return pairs, own.select("hash", F.struct("at.rank", "at.row_ord").alias("first"), F.col("at.rep").alias("rep"))


def _between(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(first_a, first_b, likeness), a before b, of pairs of classes and rows (rep, first)."""
    both = pairs.join(firsts.select(F.col("rep").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("rep").alias("b"), F.col("first").alias("y")), "b")
    return both.select(F.least("x", "y").alias("first_a"), F.greatest("x", "y").alias("first_b"), "likeness")


def similar_keys(keyed: DataFrame, threshold: float, priority: tuple[str, ...] = TEST_FIRST, k: int = BOTTOM_K) -> DataFrame:
    """(first_a, first_b, likeness) of distinct keys, a before b, that share a bottom-k hash and reach the threshold."""
    pairs, own = similar_classes(keyed, threshold, priority, k)
    left, right = own.select("rep", F.col("first").alias("first_a")), own.select("rep", F.col("first").alias("first_b"))
    copies = left.join(right, "rep").filter("first_a < first_b").select("first_a", "first_b", F.lit(1.0).alias("likeness"))
    return _between(pairs, own).unionByName(copies)


def greedy_survivors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(first, dropped) of every node that has an edge: dropped if it is like an earlier node that is kept.

    Rounds over data frames: a node whose earlier neighbours are all dropped is kept, one with a kept earlier
    neighbour is dropped; each round settles at least the first open node, chains settle link by link.
    """
    edges = checkpoint(edges.select("first_a", "first_b"))
    state = edges.select(F.col("first_a").alias("first")).union(edges.select("first_b")).distinct()
    state = checkpoint(state.withColumn("dropped", F.lit(None).cast("boolean")))
    while state.filter("dropped is null").limit(1).count():
        before = edges.join(state.toDF("first_a", "was"), "first_a")
        seen = before.groupBy(F.col("first_b").alias("first")).agg(
            F.max(F.coalesce(~F.col("was"), F.lit(False))).alias("kept_before"), F.max(F.col("was").isNull()).alias("open_before")
        )
        now = F.when(F.coalesce("kept_before", F.lit(False)), F.lit(True)).when(~F.coalesce("open_before", F.lit(False)), F.lit(False))
        state = checkpoint(state.join(seen, "first", "left").select("first", F.coalesce("dropped", now).alias("dropped")))
    return state


def _settled(keyed: DataFrame, threshold: float, priority: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(pairs, own): those of similar_classes, checkpointed; own also has lead, the first of its class, and whether lead and key are dropped.

    Keys of a class have the same neighbours, so all but the lead are dropped: for the lead, or for what the lead is dropped for.
    """
    pairs, own = similar_classes(keyed, threshold, priority)
    both = checkpoint(pairs.unionByName(own, allowMissingColumns=True))  # in one run, so that texts are read once for both
    pairs, own = both.filter("a is not null").select(*pairs.columns), both.filter("rep is not null").select(*own.columns)
    leads = own.groupBy("rep").agg(F.min("first").alias("lead"))
    state = greedy_survivors(leads, _between(pairs, leads.withColumnRenamed("lead", "first")))
    own = own.join(leads, "rep").join(state.toDF("lead", "lead_dropped"), "lead", "left").withColumn("lead_dropped", F.coalesce("lead_dropped", F.lit(False)))
    return pairs, own.withColumn("dropped", F.col("lead_dropped") | (F.col("first") > F.col("lead")))


def remove_near_duplicates(keyed: DataFrame, threshold: float = 0.8, priority: tuple[str, ...] = TEST_FIRST) -> DataFrame:
    """The rows that survive; a threshold of 0 keeps all."""
    if threshold <= 0:
        return keyed
    dropped = _settled(keyed, threshold, priority)[1].filter("dropped").select(F.col("hash").alias("_hash"))
    return keyed.withColumn("_hash", T.key_hash(F.col("article_key"))).join(dropped, "_hash", "left_anti").drop("_hash")


def near_duplicate_examples(keyed: DataFrame, threshold: float = 0.8, priority: tuple[str, ...] = TEST_FIRST, most: int = 20) -> DataFrame:
    """The first dropped texts in processing order with the kept text they are most like (the earliest on ties)."""
    pairs, own = _settled(keyed, threshold, priority)
    kept = own.filter("not dropped").select(F.col("rep").alias("a"), F.col("first").alias("first_a"))
    gone = own.filter("dropped").select(F.col("rep").alias("b"), F.col("first").alias("first_b"))
    either = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "likeness"))
    edges = either.join(kept, "a").join(gone, "b").filter("first_a < first_b").select("first_a", "first_b", "likeness")
    copies = own.filter("dropped and not lead_dropped").select(F.col("lead").alias("first_a"), F.col("first").alias("first_b"), F.lit(1.0).alias("likeness"))
    best = (
        edges.unionByName(copies).groupBy("first_b")
        .agg(F.min_by(F.struct("first_a", "likeness"), F.struct(-F.col("likeness"), F.col("first_a"))).alias("best"))
    )
    split = lambda rank: F.element_at(F.array(*map(F.lit, priority)), (rank + 1).cast("int"))
    return best.orderBy("first_b").limit(most).select(
        split(F.col("first_b.rank")).alias("dropped_split"), F.col("first_b.row_ord").alias("dropped_row"),
        split(F.col("best.first_a.rank")).alias("kept_split"), F.col("best.first_a.row_ord").alias("kept_row"),
        F.round("best.likeness", 6).alias("word_5gram_jaccard"),
    )
