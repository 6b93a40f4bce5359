"""Length statistics, conflicts and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T

_POINTS = ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))


def length_statistics(keyed: DataFrame, digits: int = 3) -> DataFrame:
    """(split, measure, rows, min, p50, p90, p95, p99, max) with linear interpolation; a ratio needs article words."""
    a, s = F.col("article_words").cast("double"), F.col("summary_words").cast("double")
    measures = F.array(
        F.struct(F.lit("article_words").alias("measure"), a.alias("value")),
        F.struct(F.lit("summary_words").alias("measure"), s.alias("value")),
        F.struct(F.lit("summary_article_ratio").alias("measure"), F.when(a > 0, s / a).alias("value")),
    )
    long = keyed.select("split", F.explode(measures).alias("m")).select("split", "m.measure", "m.value")
    r = lambda c: F.round(c, digits)
    found = percentiles(long, ["split", "measure"], "value", [p for p, _ in _POINTS])
    return found.select(
        "split", "measure", "rows", r(F.col("lo")).alias("min"), *(r(F.col(f"q{k}")).alias(n) for k, (_, n) in enumerate(_POINTS)),
        r(F.col("hi")).alias("max"),
    )


def percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, rows, lo, hi, q0, q1, …): exact percentiles with linear interpolation; null values count as rows only.

    Rows are counted by value first; running sums over the sorted values of a group then tell which value has which
    rank. The values of a group are sorted on disk if need be and never held in one buffer.
    """
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    known = F.coalesce(F.sum(F.when(F.col(value).isNotNull(), F.col("n"))), F.lit(0))
    total = counts.groupBy(*by).agg(F.sum("n").alias("rows"), known.alias("_known"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.filter(F.col(value).isNotNull()).withColumn("_to", upto).join(F.broadcast(total.select(*by, "_known")), by)  # one row a group
    picks = []
    for k, share in enumerate(shares):
        at = F.lit(share) * (F.col("_known") - 1)
        for name, rank in (("a", F.floor(at)), ("b", F.ceil(at))):
            inside = (F.col("_to") > rank) & (F.col("_to") - F.col("n") <= rank)
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{name}{k}"))
    found = total.join(F.broadcast(ranked.groupBy(*by).agg(*picks)), by, "left")
    between = []
    for k, share in enumerate(shares):
        at = F.lit(share) * (F.col("_known") - 1)
        mixed = (F.ceil(at) - at) * F.col(f"_a{k}") + (at - F.floor(at)) * F.col(f"_b{k}")
        between.append(F.when(F.floor(at) == F.ceil(at), F.col(f"_a{k}")).otherwise(mixed).alias(f"q{k}"))
    return found.select(*by, "rows", "lo", "hi", *between)


def summary_conflicts(keyed: DataFrame) -> DataFrame:
    """(conflicts): articles with more than one distinct summary, over all splits."""
    pairs = keyed.select("article_key", "summary_key").distinct()
    per = pairs.groupBy("article_key").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum((F.col("n") > 1).cast("bigint")), F.lit(0).cast("bigint")).alias("conflicts"))


def dataset_manifest(pairs: DataFrame) -> DataFrame:
    """(split, rows, article/summary words mean and median, empty rows, duplicate articles) by manifest key."""
    rows = pairs.select(
        "split", T.word_count(F.col("article")).alias("aw"), T.word_count(F.col("summary")).alias("sw"),
        ((F.trim(F.coalesce("article", F.lit(""))) == "") | (F.trim(F.coalesce("summary", F.lit(""))) == "")).alias("blank"),
        T.manifest_key(F.col("article")).alias("key"),
    )
    lengths = rows.groupBy("split").agg(
        F.count("*").alias("rows"), F.sum(F.col("blank").cast("bigint")).alias("empty_rows"),
        F.round(F.avg("aw"), 2).alias("article_words_mean"), F.round(F.median("aw"), 2).alias("article_words_median"),
        F.round(F.avg("sw"), 2).alias("summary_words_mean"), F.round(F.median("sw"), 2).alias("summary_words_median"),
    )
    keys = rows.groupBy("split", "key").agg(F.count("*").alias("n"))
    copies = keys.groupBy("split").agg((F.sum("n") - F.count("*")).alias("duplicate_articles"))
    return lengths.join(copies, "split")


def head_cap(rows: DataFrame, caps: dict[str, int | None], order: str = "row_ord") -> DataFrame:
    """The first rows of every split by the order; a cap of 0 or None is off."""
    out = None
    for split, cap in caps.items():
        part = rows.filter(F.col("split") == split)
        if cap:
            part = part.orderBy(order).limit(cap)
        out = part if out is None else out.unionByName(part)
    return out
