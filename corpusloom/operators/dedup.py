"""Exact duplicates by key, keep-first, and sentences repeated inside a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def hashed_keys(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows with a hash of 128 bits beside every key that is a text, and the names to group by in place of the keys."""
    kinds = dict(rows.dtypes)
    names = [f"_hash_{k}" if kinds[k] == "string" and k.endswith("_key") else k for k in keys]
    return rows.withColumns({n: T.key_hash(F.col(k)) for n, k in zip(names, keys, strict=True) if n != k}), names


def first_ordinals(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The order columns of the first row of every key; one aggregation with map-side combine."""
    rows, keys = hashed_keys(rows, keys)
    rest = [c for c in order if c not in keys]
    if len(rest) == 1:  # a plain minimum is hashed, one of a struct would be sorted
        return rows.groupBy(*keys).agg(F.min(rest[0]).alias(rest[0])).select(*order)
    first = rows.select(*keys, F.struct(*order).alias("_at")).groupBy(*keys).agg(F.min("_at").alias("_first"))
    return first.select(*(F.col(f"_first.{c}").alias(c) for c in order))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by the order, which must be total.

    The first ordinals joined back: a key that a third of the rows share is not sorted in one task, as a window
    would, and no text is shuffled to find them.
    """
    return rows.join(first_ordinals(rows, keys, order), order, "left_semi").select(*rows.columns)


def duplicate_counts(rows: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """(by, rows, distinct_keys, duplicates): rows beyond the first of their key."""
    rows, keys = hashed_keys(rows, keys)
    per_key = rows.groupBy(*by, *keys).agg(F.count("*").alias("n"))
    return per_key.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.count("*").alias("distinct_keys"), (F.sum("n") - F.count("*")).alias("duplicates")
    )


def remove_repeated_sentences(rows: DataFrame, column: str = "article", min_chars: int = 30) -> DataFrame:
    """Later copies of sentences whose key has at least ``min_chars`` are taken out; adds ``sentences_removed``."""
    text = F.col(column)
    sentences = T.split_sentences(text)
    # the key of each sentence: the text's key with the same cuts
    marked = F.array_join(sentences, "\u0001")
    keys = F.transform(F.split(T.fold_nfkc(marked), "\u0001"), lambda s: T.collapse(s))
    out = rows.withColumn("_sentences", sentences).withColumn("_keys", keys)
    kept = F.filter(
        F.col("_sentences"),
        lambda s, i: (F.length(F.get(F.col("_keys"), i)) < min_chars)
        | (F.array_position(F.col("_keys"), F.get(F.col("_keys"), i)) == i + 1),
    )
    out = out.withColumn("_kept", kept)
    removed = (F.size("_sentences") - F.size("_kept")).cast("bigint")
    return out.withColumn("sentences_removed", removed).withColumn(column, F.array_join("_kept", " ")).drop("_sentences", "_keys", "_kept")


def repeated_sentence_counts(cleaned: DataFrame) -> DataFrame:
    """(split, articles_with_repeats, sentences_removed)."""
    n = F.col("sentences_removed")
    return cleaned.groupBy("split").agg(
        F.sum(F.when(n > 0, 1).otherwise(0)).alias("articles_with_repeats"), F.sum(n).alias("sentences_removed")
    )
