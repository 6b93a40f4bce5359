"""Quality ladder: the first matching reject reason of every row, and its counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.session import ship

# Reject reasons in ladder order.
REASONS = (
    "empty_article", "empty_summary", "article_too_short", "summary_too_short", "summary_equals_article",
    "summary_not_shorter_than_article", "summary_too_long",
)


@dataclass(frozen=True)
class QualityRules:
    min_article_words: int = 10
    min_summary_words: int = 3
    max_summary_ratio: float = 1.0


def with_keys(pairs: DataFrame, remove_repeats: bool = False, min_repeated_chars: int = 30) -> DataFrame:
    """article and summary normalized, with keys, word counts and whether normalization changed them."""
    ship(pairs.sparkSession)
    # one Arrow pass: what it returns is a plain column, so no rule works a text out again
    out = pairs.withColumn("_f", T.pair_forms(F.col("article").cast("string"), F.col("summary").cast("string")))
    out = (
        out.withColumn("article_changed", ~F.col("article").eqNullSafe(F.col("_f.a_text")))
        .withColumn("summary_changed", ~F.col("summary").eqNullSafe(F.col("_f.s_text")))
        .withColumn("article", F.col("_f.a_text")).withColumn("summary", F.col("_f.s_text"))
        .withColumn("article_key", F.col("_f.a_key")).withColumn("summary_key", F.col("_f.s_key"))
        .withColumn("article_words", F.col("_f.a_words")).withColumn("summary_words", F.col("_f.s_words")).drop("_f")
    )
    if not remove_repeats:
        return out
    from corpusloom.operators.dedup import remove_repeated_sentences

    out = remove_repeated_sentences(out, "article", min_repeated_chars).withColumn("_a", T.text_forms(F.col("article")))
    return out.withColumn("article_key", F.col("_a.key")).withColumn("article_words", F.col("_a.words")).drop("_a")


def quality_reasons(keyed: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Adds ``reason``; null for rows that pass. An article without words has no ratio and passes that rule."""
    a, s = F.col("article_words"), F.col("summary_words")
    ratio = F.when(a > 0, s / a)
    tests = (
        F.col("article") == "", F.col("summary") == "", a < rules.min_article_words, s < rules.min_summary_words,
        F.col("article_key") == F.col("summary_key"), s >= a, ratio > rules.max_summary_ratio,
    )
    reason = F.lit(None).cast("string")
    for name, test in reversed(list(zip(REASONS, tests, strict=True))):
        reason = F.when(test, name).otherwise(reason)
    return keyed.withColumn("reason", reason)


def reject_counts(decided: DataFrame) -> DataFrame:
    """(split, reason, rows) of rejected rows."""
    return decided.filter("reason is not null").groupBy("split", "reason").agg(F.count("*").alias("rows"))


def normalized_counts(keyed: DataFrame) -> DataFrame:
    """(split, rows, normalized_articles, normalized_summaries); a null original counts as changed."""
    one = lambda c: F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0).cast("bigint"))
    return keyed.groupBy("split").agg(
        F.count("*").alias("rows"), one("article_changed").alias("normalized_articles"), one("summary_changed").alias("normalized_summaries")
    )
