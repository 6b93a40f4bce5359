"""Split ownership: overlaps, leakage policies and deterministic re-splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.dedup import hashed_keys, keep_first

TEST_FIRST = ("test", "validation", "train")
TRAIN_FIRST = ("train", "validation", "test")


def rank_of(split: Column, priority: tuple[str, ...]) -> Column:
    out = F.lit(len(priority))
    for k, name in reversed(list(enumerate(priority))):
        out = F.when(split == name, k).otherwise(out)
    return out


def overlap_counts(rows: DataFrame, key: str = "article_key") -> DataFrame:
    """(train_validation, train_test, validation_test): keys that two splits share, in one pass over the keys."""
    has = [F.max((F.col("split") == s).cast("int")).alias(s) for s in TRAIN_FIRST]
    rows, (key,) = hashed_keys(rows, [key])
    per = rows.groupBy(key).agg(*has)
    both = lambda a, b: F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).cast("bigint").alias(f"{a}_{b}")
    return per.agg(both("train", "validation"), both("train", "test"), both("validation", "test"))


def by_priority(rows: DataFrame, priority: tuple[str, ...] = TEST_FIRST, key: str = "article_key") -> DataFrame:
    """Rows whose split is the best-ranked holder of their key.

    Only keys that several splits hold can lose a row, and only their losing splits are joined back: one small row
    for each, whatever the number of rows of a key.
    """
    ranked, (name,) = hashed_keys(rows.withColumn("_rank", rank_of(F.col("split"), priority)), [key])
    held = ranked.groupBy(name).agg(F.min("_rank").alias("_best"), F.max("_rank").alias("_worst"))
    losing = held.filter("_best < _worst").select(name, F.explode(F.sequence(F.col("_best") + 1, "_worst")).alias("_rank"))
    return ranked.join(losing, [name, "_rank"], "left_anti").select(*rows.columns)


def assign_split(key: Column, train: float = 0.8, validation: float = 0.1) -> Column:
    """Split by the stable bucket of the key; the second bound is the float sum."""
    bucket = T.stable_bucket(key)
    return F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test")


def resplit(rows: DataFrame, keys: list[str], train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """First row of every key over all splits (train, validation, test order), then split by hash; old label kept."""
    ranked = rows.withColumn("split_rank", rank_of(F.col("split"), TRAIN_FIRST)).withColumnRenamed("split", "input_split")
    first = keep_first(ranked, keys, ["split_rank", "row_ord"]).drop("split_rank")
    return first.withColumn("split", assign_split(F.col("article_key"), train, validation))


def resolve_leakage(rows: DataFrame, policy: str, keys: list[str], train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """test-priority, train-priority, resplit, or error when splits overlap."""
    if policy == "error":
        before = overlap_counts(rows).first()
        if any(before):
            raise ValueError(f"articles are shared between splits: {before.asDict()}")
        return rows
    if policy == "resplit":
        return resplit(rows, keys, train, validation)
    if policy not in ("test-priority", "train-priority"):
        raise ValueError(f"unknown leakage policy {policy}")
    return by_priority(rows, TRAIN_FIRST if policy == "train-priority" else TEST_FIRST)
